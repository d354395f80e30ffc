"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary labelled text.  A text is cut into
windows of a few words; each window is compressed under both, and what the toxic dictionary saves
is its advantage.  The shares of a text's windows whose advantage reaches each of a few levels, and the mean
advantage, become a score by a logistic curve that is fitted to texts which the dictionaries have not seen.

Training counts, in Spark, in how many toxic and ordinary texts each word occurs.  Both dictionaries begin with
the same common words, so that an ordinary window is as short under one as under the other; the toxic one goes on with
the words that toxic texts hold significantly more often (log-likelihood ratio), the ordinary one with as many bytes of further
common words.  Small frames are stored unless compression gains some bytes; every window therefore opens with a fixed lead
that both dictionaries end with, and each further match shows in the length.

Labels: at most ``SAMPLE`` labelled rows of each class, those of smallest hash, are learnt from; their weights keep the classes'
shares.  Texts that share their smallest hash of three words, such as copies of a text, teach once.  The curve is fitted across two
folds: each fold is scored by dictionaries of the other one.  What reaches the driver is the words of a dictionary,
a few counts, and one small vector a sampled row.

Cases: a null or empty text has no window and gets the score of a text that shows nothing; without a labelled row of both
classes every score is the share of toxic ones (0 without any); a row without a label or id teaches nothing; an id with several
labels is toxic if one says so; words longer than ``LONGEST`` bytes are cut into pieces; long texts are worked on in pieces; repeated
rows are scored one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, saved
from .importance import words
from .langid import held_out

SAMPLE, FOLDS, SIGNIFICANT, THRESHOLD = 10_000, 2, 12.0, 0.3
#: Bytes of the common part and, at most, of a class's own part.
COMMON, OWN = 24 << 10, 2 << 10
#: Words of a window, bytes of a word, windows compressed at once, words counted before they leave a task.
WIDTH, LONGEST, TOGETHER, COUNTED = 6, 64, 1 << 14, 1 << 18
#: Bytes that no UTF-8 text holds in this order.
LEAD = bytes(range(128, 160))
LEVELS = (2, 3, 4, 5, 6)
FEATURES = len(LEVELS) + 1
PARAMETERS = {"window_log": 17, "hash_log": 15, "chain_log": 14, "search_log": 5, "min_match": 5, "target_length": 64, "strategy": zstandard.STRATEGY_LAZY2, "write_content_size": 0, "write_dict_id": 0}


def _words(text: str | None) -> Iterator[list[bytes]]:
    """Lower-case words, a piece of the text at a time."""
    for some in words((text or "").lower()):
        if some and max(map(len, some)) > LONGEST:
            some = [w[i : i + LONGEST] for w in some for i in range(0, len(w), LONGEST)]
        yield some


def windows(text: str | None, width: int = WIDTH) -> Iterator[list[bytes]]:
    """The windows of a text, a piece of it at a time."""
    for some in _words(text):
        yield [b"%s %s " % (LEAD, b" ".join(some[i : i + width])) for i in range(0, len(some), width)]


class Pair:
    """The two dictionaries, ready to compress."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        parameters = zstandard.ZstdCompressionParameters(**PARAMETERS)
        self.sides = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(content + LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=parameters)
            self.sides.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=held))

    def advantages(self, some: list[bytes]) -> np.ndarray:
        """How many bytes shorter each window is under the toxic dictionary."""
        out = []
        for at in range(0, len(some), TOGETHER):
            part = some[at : at + TOGETHER]
            sizes = np.fromiter(map(len, part), dtype=np.uint64, count=len(part))
            segments = np.column_stack([np.cumsum(sizes) - sizes, sizes]).astype("<u8").tobytes()
            buffer = zstandard.BufferWithSegments(b"".join(part), segments)
            lengths = [np.fromiter(map(len, side.multi_compress_to_buffer(buffer, threads=1)), dtype=np.int64, count=len(part)) for side in self.sides]
            out.append(lengths[0] - lengths[1])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text: the shares of windows at each level, and the mean advantage."""
        totals = np.zeros((len(texts), FEATURES + 1))
        held, owner = [], []

        def emptied():
            found, who = self.advantages(held), np.array(owner, dtype=np.int64)
            for k, level in enumerate(LEVELS):
                totals[:, k] += np.bincount(who[found >= level], minlength=len(texts))
            totals[:, -2] += np.bincount(who, weights=found, minlength=len(texts))
            totals[:, -1] += np.bincount(who, minlength=len(texts))
            held.clear(), owner.clear()

        for i, text in enumerate(texts):
            for some in windows(text):
                held += some
                owner += [i] * len(some)
                if len(held) >= TOGETHER:
                    emptied()
        emptied()
        return totals[:, :-1] / np.maximum(totals[:, -1:], 1)


def sampled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, text and toxic of at most ``sample`` rows a class, and weight (rows of the class a sampled one)."""
    marked = only(labels, doc_id="doc_id", toxic=label_col).dropna().groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marked = saved(marked.where(~held_out() & F.col("toxic").isin(0, 1)), "toxicity-labels")
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [marked.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in sizes]
    if not parts:
        return saved(documents.sparkSession.createDataFrame([], "doc_id long, text string, toxic int, weight double"), "toxicity-sample")
    ids = parts[0]
    for p in parts[1:]:
        ids = ids.union(p)
    weight = F.coalesce(*[F.when(F.col("toxic") == k, max(1.0, n / sample)) for k, n in sizes.items()])
    # At most ``sample`` rows a class: small enough for every task.
    docs = only(documents, doc_id=id_col, text=text_col)
    return saved(docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic", weight.alias("weight")), "toxicity-sample")


def _signature(text: str) -> int:
    least = 1 << 32
    for some in _words(text):
        for i in range(max(1, len(some) - 2)):
            least = min(least, zlib.crc32(b" ".join(some[i : i + 3])))
    return least


def _apart(sample: DataFrame) -> DataFrame:
    """One row of each signature and class, and its fold."""

    def sign(batches):
        for batch in batches:
            yield batch.append_column("signature", pa.array([_signature(t or "") for t in batch.column("text").to_pylist()], pa.int64()))

    schema = f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, text string, toxic int, weight double, signature long"
    first = sample.mapInArrow(sign, schema).groupBy("signature", "toxic").agg(F.min(F.struct(F.xxhash64("doc_id", "text"), "doc_id", "text", "weight")).alias("r"))
    fold = F.pmod(F.xxhash64("signature"), F.lit(FOLDS)).cast("int")
    return saved(first.select("r.doc_id", "r.text", "toxic", "r.weight", fold.alias("fold")), "toxicity-texts")


def word_counts(texts: DataFrame) -> DataFrame:
    """word, fold, toxic, n: in how many texts of the fold and class a word occurs."""

    def fold(batches):
        seen: Counter = Counter()

        def emptied():
            found = list(seen.items())
            seen.clear()
            columns = [pa.array([w for (w, _, _), _ in found], pa.binary()), *(pa.array([x[0][k] for x in found], pa.int32()) for k in (1, 2)), pa.array([n for _, n in found], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "fold", "toxic", "n"])

        for batch in batches:
            for text, part, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))):
                own: set[bytes] = set()
                for some in _words(text):
                    own.update(some)
                seen.update((w, part, toxic) for w in own if len(w) > 2)
                if len(seen) > COUNTED:
                    yield emptied()
        yield emptied()

    parts = texts.select("text", "fold", "toxic").mapInArrow(fold, "word binary, fold int, toxic int, n long")
    return saved(parts.groupBy("word", "fold", "toxic").agg(F.sum("n").alias("n")), "toxicity-words")


def _log_likelihood(k: Column, n: int, m: Column, size: int) -> Column:
    """Twice the log-likelihood ratio of k in n and m in size against one common share."""
    part = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    alone = lambda x: float(x * np.log(x)) if x else 0.0
    return 2 * (part(k) + part(n - k) + part(m) + part(size - m) - part(k + m) - part(n + size - k - m) - alone(n) - alone(size) + alone(n + size))


def _content(some: list[bytes], size: int) -> tuple[bytes, int]:
    """The first words that ``size`` bytes hold, the best ones last, and how many they are."""
    n = at = 0
    while n < len(some) and at + len(some[n]) < size:
        at += len(some[n]) + 1
        n += 1
    return b" " + b"".join(w + b" " for w in reversed(some[:n])), n


def trained(counts: DataFrame, sizes: dict[tuple[int, int], int], folds: tuple[int, ...]) -> tuple[bytes, bytes]:
    """The contents of the toxic and the ordinary dictionary, from the texts of some folds."""
    toxic, ordinary = (sum(sizes.get((f, k), 0) for f in folds) for k in (1, 0))
    per = counts.where(F.col("fold").isin(*folds)).groupBy("word").agg(*(F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "k"), (0, "m"))))
    k, m = F.col("k"), F.col("m")
    own = (k * ordinary > m * toxic) & (_log_likelihood(k, toxic, m, ordinary) >= SIGNIFICANT)
    per = per.select("word", k, m, own.alias("own"), _log_likelihood(k, toxic, m, ordinary).alias("g"))
    # A word takes three bytes at least, so these limits cut nothing that would fit.
    best = [bytes(r.word) for r in per.where("own").orderBy(F.desc("g"), "word").limit(OWN // 3).select("word").collect()]
    worth = (k + m) * (F.length("word") - 2)
    common = [bytes(r.word) for r in per.where(~F.col("own") & (k + m >= 3)).orderBy(worth.desc(), "word").limit((COMMON + OWN) // 3).select("word").collect()]
    mine, _ = _content(best, OWN)
    shared, n = _content(common, COMMON)
    theirs, _ = _content(common[n:], len(mine))
    return shared + mine, shared + theirs


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic coefficients, the last one constant, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    penalty = np.diag(np.append(np.full(x.shape[1] - 1, ridge), 1e-6))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, slope)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def _shape(features: np.ndarray) -> np.ndarray:
    """Shares as square roots, so that small ones stand apart."""
    return np.column_stack([np.sqrt(features[:, :-1]) * 10, features[:, -1]])


class Model:
    """Dictionaries and curve, or one score for all."""

    def __init__(self, contents: tuple[bytes, bytes] | None, curve: np.ndarray):
        self.contents, self.curve = contents, curve

    def scores(self):
        """texts -> scores, for use inside a task."""
        if self.contents is None:
            return lambda texts: np.full(len(texts), self.curve[-1])
        pair = Pair(*self.contents)
        return lambda texts: 1 / (1 + np.exp(-np.clip(np.column_stack([_shape(pair.features(texts)), np.ones(len(texts))]) @ self.curve, -30, 30)))


def _features(texts: DataFrame, contents: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the sampled texts; fold f is measured by the dictionaries at f."""

    def run(batches):
        pairs = [Pair(*c) for c in contents]
        for batch in batches:
            folds = batch.column("fold").to_numpy()
            out = np.zeros((len(folds), FEATURES))
            texts = batch.column("text").to_pylist()
            for f, pair in enumerate(pairs):
                at = np.flatnonzero(folds == f)
                out[at] = pair.features([texts[i] for i in at])
            yield pa.RecordBatch.from_arrays([pa.array(out.tolist(), pa.list_(pa.float64())), batch.column("toxic"), batch.column("weight")], names=["x", "toxic", "weight"])

    rows = texts.select("text", "fold", "toxic", "weight").mapInArrow(run, "x array<double>, toxic int, weight double").collect()
    rows.sort(key=lambda r: (r.toxic, r.weight, r.x))  # sums don't depend on the order in which tasks ended
    return np.array([r.x for r in rows]), np.array([r.toxic for r in rows]), np.array([r.weight for r in rows])


def learnt(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    texts = _apart(sampled(documents, labels, sample, id_col, text_col, label_col))
    sizes = {(r.fold, r.toxic): r.n for r in texts.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    if any(sizes.get((f, k), 0) == 0 for f in range(FOLDS) for k in (0, 1)):
        n = sum(sizes.values())
        return Model(None, np.array([sum(v for (_, k), v in sizes.items() if k == 1) / max(n, 1)]))
    counts = word_counts(texts)
    others = [tuple(g for g in range(FOLDS) if g != f) for f in range(FOLDS)]
    x, y, weight = _features(texts, [trained(counts, sizes, o) for o in others])
    return Model(trained(counts, sizes, tuple(range(FOLDS))), fitted(_shape(x), y, weight))


def scored(documents: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batches):
        score = model.scores()
        for batch in batches:
            got = score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    docs = only(documents, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, score double, predicted int")


def classified(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learn from the labelled rows that aren't held out, then score every row."""
    found = scored(documents, learnt(documents, labels, sample, id_col, text_col, label_col), threshold, id_col, text_col)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
