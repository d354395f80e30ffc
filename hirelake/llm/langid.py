"""Language identification by hyperdimensional profiles.

Each letter has a random bipolar vector.  An n-gram's vector binds (multiplies) its letters'
vectors, each rolled by its place; a text's vector bundles (adds) those of its n-grams; a
language's prototype bundles its training texts.  A text gets the language whose prototype has
the largest cosine.  Letters are lower-cased, everything else is one blank.

Bundling is linear, so a text's vector is its n-gram counts times the n-gram vectors, a matrix
product over a batch.  Prototypes are sums of whole numbers, so their order doesn't matter, and
have one row for each language and dimension whatever the corpus' size.

Cases: a null text, or one without a letter, is ``und`` with score 0; rows without a label teach
nothing; with no labelled row at all everything is ``und``; equal cosines take the label that
sorts first; repeated rows are predicted (and learnt) once each; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, only

DIMENSIONS, ORDER, SEED, UNKNOWN = 1024, 3, 20240501, "und"
#: Letters beyond a-z share these places by code point; place 0 is the blank.
ALPHABET, OWN = 128, 26
_BATCH_CHARS = 1 << 19
#: n-gram vectors that a worker keeps; 16 MB of them.
_KEPT = 1 << 14


class Space:
    """Letter codes and n-gram vectors; the vectors of n-grams met so far are kept."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED):
        self.order = order
        letters = np.random.default_rng(seed).integers(0, 2, (ALPHABET, dimensions), dtype=np.int8) * 2 - 1
        self.rolled = [np.roll(letters, order - 1 - k, axis=1) for k in range(order)]
        self.code = np.zeros(0x3000, dtype=np.uint8)
        for c in range(len(self.code)):
            self.code[c] = self._place(c)
        self.place = np.full(ALPHABET**order, -1, dtype=np.int32)
        self.vectors = np.zeros((0, dimensions), dtype=np.int8)

    @staticmethod
    def _place(c: int) -> int:
        ch = chr(c).lower()[0]
        if "a" <= ch <= "z":
            return ord(ch) - 96
        return OWN + 1 + ord(ch) % (ALPHABET - OWN - 1) if unicodedata.category(ch)[0] == "L" else 0

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of all texts, a blank before and after each, and each code's text."""
        joined = " ".join(["", *texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        low = np.minimum(points, len(self.code) - 1)
        codes = self.code[low].astype(np.int32)
        for i in np.flatnonzero(points >= len(self.code)):
            codes[i] = self._place(int(points[i]))
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        return codes, np.append(owner, len(texts) - 1)  # a blank belongs to the text behind it

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """n-gram counts (texts x n-grams met) and each text's number of letters."""
        codes, owner = self.codes(texts)
        letters = np.bincount(owner[codes > 0], minlength=len(texts))
        keep = np.ones(len(codes), dtype=bool)
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)  # runs of blanks are one blank
        codes, owner = codes[keep], owner[keep]
        n = len(codes) - self.order + 1
        if n <= 0:
            return np.zeros((len(texts), 0), dtype=np.float32), letters
        grams = np.zeros(n, dtype=np.int32)
        for k in range(self.order):
            grams = grams * ALPHABET + codes[k : k + n]
        places = self.place[grams]
        if (new := places < 0).any():
            self._meet(np.unique(grams[new]))
            places = self.place[grams]
        # The n-gram belongs to its middle letter's text: no n-gram but "x_y" spans two texts.
        at = owner[1 : 1 + n].astype(np.int64) * len(self.vectors) + places
        got = np.bincount(at, minlength=len(texts) * len(self.vectors))
        return got.reshape(len(texts), -1).astype(np.float32), letters

    def _meet(self, grams: np.ndarray) -> None:
        made = np.ones((len(grams), self.vectors.shape[1]), dtype=np.int8)
        rest = grams.copy()
        for k in range(self.order - 1, -1, -1):
            made *= self.rolled[k][rest % ALPHABET]
            rest //= ALPHABET
        self.place[grams] = len(self.vectors) + np.arange(len(grams))
        self.vectors = np.concatenate([self.vectors, made])

    def bundled(self, counts: np.ndarray, kind: type) -> np.ndarray:
        """counts times the vectors, which are widened some at a time."""
        used = np.flatnonzero(counts.any(axis=0))
        out = np.zeros((len(counts), self.vectors.shape[1]), dtype=kind)
        for k in range(0, len(used), 2048):
            part = used[k : k + 2048]
            out += counts[:, part].astype(kind) @ self.vectors[part].astype(kind)
        return out


def _space(*key) -> Space:
    got = held(("langid", key), lambda: [Space(*key)])
    if len(got[0].vectors) > _KEPT:  # bounds the memory on texts in many scripts
        got[0] = Space(*key)
    return got[0]


def _groups(texts: list[str], chars: int):
    """Slices of the batch of about so many characters, and of 128 texts at most."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and (held + len(t) > chars or i - first >= 128):
            yield slice(first, i)
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def prototypes(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED) -> dict[str, np.ndarray]:
    """Each language's bundle, summed by Spark; one vector a language reaches the driver."""

    def learn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _groups(texts, _BATCH_CHARS):
                space = _space(dimensions, order, seed)
                counts, _ = space.counts(texts[part])
                names, at = np.unique(langs[part], return_inverse=True)
                total = np.zeros((len(names), counts.shape[1]))
                np.add.at(total, at, counts)
                for name, row in zip(names, np.rint(space.bundled(total, np.float64)).astype(np.int64)):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(row)), pa.array(np.arange(len(row))), pa.array(row)], names=["lang", "dim", "total"])

    rows = only(labelled, lang=lang_col, text=text_col).dropna()
    sums = rows.mapInArrow(learn, "lang string, dim long, total long").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    gathered = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "total"))).alias("v")).collect()
    return {r.lang: np.array([x.total for x in r.v], dtype=np.float64) for r in sorted(gathered, key=lambda r: r.lang)}


def _scored(learnt: dict[str, np.ndarray], space_key: tuple):
    """texts -> (labels, scores), for use inside a task."""
    names = list(learnt)
    unit = np.array([v / max(np.linalg.norm(v), 1e-9) for v in learnt.values()], dtype=np.float32).reshape(len(names), space_key[0])

    def score_texts(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        texts = [t or "" for t in texts]
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for part in _groups(texts, _BATCH_CHARS) if names else ():
            space = _space(*space_key)
            counts, letters = space.counts(texts[part])
            vectors = space.bundled(counts, np.float32)
            cosine = vectors @ unit.T / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            best = cosine.argmax(axis=1)
            for i in np.flatnonzero(letters):
                lang[part.start + i], score[part.start + i] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
        return lang, score

    return score_texts


def predict(documents: DataFrame, learnt: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) of every row."""
    score_texts = _scored(learnt, (dimensions, order, seed))

    def run(batches):
        for batch in batches:
            lang, score = score_texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = only(documents, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, lang_pred string, score double")


def accepted(documents: DataFrame, learnt: dict[str, np.ndarray], least: float, text_col: str = "text", dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """The rows, with all their columns, that have a language and a score of ``least`` or more."""
    score_texts, place = _scored(learnt, (dimensions, order, seed)), documents.columns.index(text_col)

    def run(batches):
        for batch in batches:
            lang, score = score_texts(batch.column(place).to_pylist())
            yield batch.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(lang, score)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that teach nothing: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled rows that aren't held out, then predict every row."""
    learnt = prototypes(documents.where(~held_out(id_col)), lang_col, text_col)
    found = predict(documents, learnt, id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
