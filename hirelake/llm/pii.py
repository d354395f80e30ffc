"""Personal data: base patterns, and contextual patterns bootstrapped from what they find.

One pass finds the base spans of each text and other strings of similar shape (candidates), each
with its lexical contexts: the word before it, and the two words before it.  Contexts that
precede several distinct values are counted over all texts in a second pass.  Spark then scores
the graph of patterns (context, kind) and instances (kind, value) in rounds: a pattern's
confidence is the share of its occurrences that known instances fill, an instance's the chance
that at least one of its patterns is right.  Instances above a threshold become known and
support further patterns; their mentions are added to the base spans.

Cases: null text: empty; repeated rows are searched one by one; an empty table gives an empty
result; added spans never overlap base spans; extra columns are kept by ``redacted`` only.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held, only, saved
from .ngram_join import _bit, _place_bits
from .words import mixed

KINDS = ("email", "ip", "card", "phone")
#: Distinct values that a context needs, least confidence of a pattern and of an instance, rounds.
VALUES, PATTERN_SURE, INSTANCE_SURE, ROUNDS = 5, 0.5, 0.6, 3
CONTEXT_PLACES = 1 << 22

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LIKE_NUMBER = re.compile(r"(?<![\w.+-])\+?\(?[0-9][0-9 ().-]{5,}[0-9](?![\w])")
_LIKE_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?[\[(]?(?:\.|dot|DOT)[\])]?\s?[0-9]{1,3}){3}(?![\w])")
_LIKE_HOST = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?![\w.-])")
_LIKE_EMAIL = re.compile(r"(?<=[\s<(\[{])(?:at|AT)(?=[\s>)\]}])")
_MAIL_LEFT = re.compile(r"([A-Za-z0-9._%+-]+)\s?[<(\[{]?\Z")
_MAIL_RIGHT = re.compile(r"[>)\]}]?\s?[A-Za-z0-9-]+\s?[<(\[{]?(?:\.|\s(?:dot|DOT)\s|(?:dot|DOT))[>)\]}]?\s?[A-Za-z]{2,}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @; an @ without both sides is passed over."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = max(done, at - 64)
        left = _LOCAL.search(text, first, at)
        while left and left.start() == first > done:  # a longer local part
            first = max(done, first - 4096)
            left = _LOCAL.search(text, first, at)
        if left and (right := _DOMAIN.match(text, at + 1)):
            yield left.start(), right.end()
            done = right.end()
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def candidate_spans(text: str) -> list[tuple[int, int, int]]:
    """Strings shaped like an entity that the base patterns don't ask for: numbers without a plus or a right check
    digit, addresses in words or without a top domain, dotted quads in words or out of range."""
    out = []
    for m in _LIKE_NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        if 7 <= n <= 12:
            out.append((3, *m.span()))
        elif 13 <= n <= 19:
            out.append((2, *m.span()))
    out += [(1, *m.span()) for m in _LIKE_IP.finditer(text)]
    if "@" in text:
        out += [(0, *m.span()) for m in _LIKE_HOST.finditer(text)]
    for m in _LIKE_EMAIL.finditer(text):
        right = _MAIL_RIGHT.match(text, m.end())
        if right:
            first = max(0, m.start() - 80)
            left = _MAIL_LEFT.search(text, first, m.start())
            while left and left.start() == first > 0:  # a longer local part
                first = max(0, first - 4096)
                left = _MAIL_LEFT.search(text, first, m.start())
            if left:
                out.append((0, left.start(), right.end()))
    return out


_DIGIT = re.compile("[0-9]")


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class ContextHashes(dict):
    """Signed 64-bit hash of a context word: lower case, digits as 0; emptied when full."""

    def __missing__(self, word: str) -> int:
        got = _hash(_DIGIT.sub("0", word.lower()))
        if len(self) > 100_000:
            self.clear()
        if len(word) <= 40:
            self[word] = got
        return got


def _contexts() -> ContextHashes:
    return held(("pii",), ContextHashes)


def _two(second_last: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(second_last.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.astype(np.int64).view(np.uint64)).view(np.int64)


def _before(text: str, start: int, context: ContextHashes) -> tuple[int, int] | None:
    """Hashes of the last word, and the last two words, before a span; null at a text's start."""
    first = start
    words: list[str] = []
    while first and len(words) < 3:  # two whole words have a third, or the text's start, before them
        first = max(0, first - max(160, start - first))
        words = text[first:start].split()
    words = words[-2:]
    if not words:
        return None
    h = [context[w] for w in words]
    return h[-1], int(_two(np.array(h[:1]), np.array(h[1:]))[0]) if len(h) == 2 else h[-1]


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("known", pa.bool_()), ("value", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])


def mentions(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash and the base spans and candidates of each text."""

    def found(text: str, contexts: ContextHashes) -> list[dict]:
        base = base_spans(text)
        out = [(s, True) for s in base]
        for c in candidate_spans(text):
            if all(c[2] <= s[1] or s[2] <= c[1] for s in base):
                out.append((c, False))
        rows = []
        for (kind, start, end), known in out:
            context = _before(text, start, contexts) or (0, 0)
            rows.append({"kind": kind, "start": start, "end": end, "known": known, "value": _hash(text[start:end].lower()), "c1": context[0], "c2": context[1]})
        return rows

    def run(batches):
        contexts = _contexts()
        for batch in batches:
            rows = [found(text.as_py() or "", contexts) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(_MENTION))], names=["doc_id", "text_hash", "mentions"])

    schema = "doc_id long, text_hash long, mentions array<struct<kind:int,start:int,end:int,known:boolean,value:long,c1:long,c2:long>>"
    return documents.mapInArrow(run, schema)


def context_totals(documents: DataFrame, places: np.ndarray) -> DataFrame:
    """(context, total): how often each context in the bitmap stands before a word."""

    def run(batches):
        context = _contexts()
        for batch in batches:
            got = []
            for text in batch.column(1):
                words = (text.as_py() or "").split()
                if len(words) < 2:
                    continue
                h = np.fromiter(map(context.__getitem__, words[:-1]), dtype=np.int64, count=len(words) - 1)
                got.append(h[_bit(places, (h.view(np.uint64) % np.uint64(CONTEXT_PLACES)).astype(np.int64))])
                two = _two(h[:-1], h[1:])
                got.append(two[_bit(places, (two.view(np.uint64) % np.uint64(CONTEXT_PLACES)).astype(np.int64))])
            keys, counts = np.unique(np.concatenate(got) if got else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["context", "total"])

    return documents.mapInArrow(run, "context long, total long").groupBy("context").agg(F.sum("total").alias("total"))


def bootstrap(edges: DataFrame, totals: DataFrame, values: int = VALUES, pattern_sure: float = PATTERN_SURE, instance_sure: float = INSTANCE_SURE, rounds: int = ROUNDS) -> DataFrame:
    """Accepted (kind, value) that weren't known. edges: context, kind, value, known, n."""
    edges = checkpointed(edges.join(totals, "context", "left").withColumn("total", F.coalesce("total", F.lit(0))))
    known = edges.where("known").select("kind", "value").distinct()
    for _ in range(rounds):
        marked = edges.join(known.withColumn("sure", F.lit(True)), ["kind", "value"], "left")
        n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
        patterns = (
            marked.groupBy("context", "kind")
            .agg(n(F.col("sure")).alias("hits"), F.count("sure").alias("values"), F.sum("n").alias("seen"), F.max("total").alias("total"))
            .where(F.col("values") >= values)
            .withColumn("confidence", F.col("hits") / F.greatest("total", "seen"))
            .where(F.col("confidence") >= pattern_sure)
        )
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))
        accepted = edges.join(patterns.select("context", "kind", "confidence"), ["context", "kind"]).groupBy("kind", "value").agg((1 - doubt).alias("score")).where(F.col("score") >= instance_sure)
        known = checkpointed(known.union(accepted.select("kind", "value")).distinct())
    return known.join(edges.where("known").select("kind", "value").distinct(), ["kind", "value"], "left_anti")


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = only(documents, doc_id=id_col, text=text_col)
    return docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, base and spans (arrays of kind, start, end; kind as a place in KINDS)."""
    docs = keyed(documents, id_col, text_col)
    found = saved(mentions(docs), "pii-mentions")
    each = found.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    context = F.explode(F.array_distinct(F.array("c1", "c2")))
    edges = checkpointed(each.select(context.alias("context"), "kind", "value", "known").where("context <> 0").groupBy("context", "kind", "value").agg(F.bool_or("known").alias("known"), F.count("*").alias("n")))
    many = edges.groupBy("context", "kind").agg(F.count("*").alias("values")).where(F.col("values") >= VALUES)
    supported = edges.join(many, ["context", "kind"], "left_semi")
    place = F.expr(f"pmod(cast(cast(context as decimal(20,0)) + if(context < 0, 18446744073709551616, 0) as decimal(20,0)), {CONTEXT_PLACES})").cast("long")
    places = _place_bits(many.select(place.alias("place")).distinct(), CONTEXT_PLACES)
    accepted = bootstrap(supported, context_totals(docs, places))
    extra = each.where("not known").join(accepted, ["kind", "value"], "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("extra"))
    extra = saved(extra, "pii-extra").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    spans = lambda c: F.transform(c, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    base = spans(F.filter("mentions", lambda m: m["known"]))
    joined = found.join(extra, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    both = F.array_union(base, F.coalesce("extra", F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")))
    return joined.select("doc_id", "text_hash", F.sort_array(base).alias("base"), F.sort_array(both).alias("spans"))


def span_text(spans) -> F.Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(name, m["kind"]), m["start"], m["end"])), ",")


def report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, the digest of the base spans, all spans."""
    found = find(documents, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def redacted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same rows and columns with each span of the text replaced by <KIND>."""
    spans = find(documents, id_col, text_col).where(F.size("spans") > 0).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("spans").alias("__s")).dropDuplicates(["__d", "__h"])
    spans = saved(spans, "pii-spans")
    text = F.col(f"`{text_col}`")

    # From the start of the text; where spans overlap, the first and longest names them all.
    def clean(spans):
        by_start = F.sort_array(F.transform(spans, lambda m: F.struct(m["start"].alias("start"), (-m["end"]).alias("before"), m["kind"].alias("kind"), m["end"].alias("end"))))
        name = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        step = lambda acc, m: F.when(m["start"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], m["end"]).alias("at"))).otherwise(F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, m["start"] - acc["at"]), F.get(name, m["kind"])).alias("out"), m["end"].alias("at")))
        return F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    on = F.col(f"`{id_col}`").eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("__h"))
    return documents.join(spans, on, "left").withColumn(text_col, F.when(F.col("__s").isNull(), text).otherwise(clean("__s"))).drop("__d", "__h", "__s")
