"""Importance resampling towards a target's word distribution.

A text's UTF-8 bytes go through one 256-byte table, which lower-cases A-Z and turns every ASCII
byte but letters and digits into a blank; ``bytes.split`` then yields the words.  Features are runs of
one to ``longest`` words; a run's bucket is the crc32 of its bytes, and a longer run goes on from
the crc32 of the shorter one.  Counters fold a task's words before a checksum is taken once a distinct
run, and Spark adds up one row a bucket and task.

Both distributions are counts over all texts.  A bucket's gain is the logarithm of its smoothed share in
the target over that in the corpus, in whole thousandths, so that weights are whole numbers and no
sum depends on its order.  Documents are drawn without repeats by adding noise to the weight that
the id alone fixes (Gumbel top-k).

Ranks come from a range sort whose result is written with each row's place in its part, so that
a rank is a place and the sizes of the parts before; no task sees all rows.  What reaches
the driver is one count a bucket and one a part.

Cases: a null or empty text has no feature, weight 0 and no rank; an id that is null is noised as an
empty one; repeated rows are scored and drawn one by one; equal scores go to the smaller id, null last; an
empty target or corpus leaves the smoothing alone; an empty table gives an empty result; a text is
worked on in pieces of ``PIECE`` bytes, cut between words; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, saved

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
PIECE = 1 << 20
#: Distinct runs that a task remembers.
REMEMBERED = 1 << 18
BLANK = 32


def _table() -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if c.isalnum() else BLANK
    return bytes(table)


TABLE = _table()


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, a piece of it at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def runs(text: str | None, longest: int) -> Iterator[list[tuple[bytes, ...]] | list[bytes]]:
    """Runs of one to ``longest`` words, a piece at a time; one-word runs are bare words."""
    before: list[bytes] = []
    for some in words(text):
        if longest == 1:
            yield some
            continue
        # Runs that end in this piece; they may begin in the last one.
        held, first = before + some, len(before)
        yield [tuple(held[i - n + 1 : i + 1]) for i in range(first, len(held)) for n in range(1, longest + 1) if n <= i + 1]
        before = held[-(longest - 1) :]


class Buckets(dict):
    """run -> bucket, worked out once a distinct run; forgotten when there are too many."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        if isinstance(run, bytes):
            crc = zlib.crc32(run)
        else:
            crc = zlib.crc32(run[0])
            for word in run[1:]:
                crc = zlib.crc32(b" " + word, crc)
        self[run] = found = crc % self.buckets
        return found


def counted(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def fold(batches):
        total, bucket_of = np.zeros(buckets, dtype=np.int64), Buckets(buckets)
        seen: Counter = Counter()

        def emptied():
            for run, n in seen.items():
                total[bucket_of[run]] += n
            seen.clear()

        for batch in batches:
            for text in batch.column(0):
                for some in runs(text.as_py(), longest):
                    seen.update(some)
                    if len(seen) > REMEMBERED:
                        emptied()
        emptied()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    parts = only(texts, text=text_col).mapInArrow(fold, "bucket int, n long")
    total = np.zeros(buckets, dtype=np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the corpus."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def weighed(documents: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of every row."""
    gain_of = gain.tolist()

    def run(batches):
        bucket_of = Buckets(len(gain_of))
        for batch in batches:
            n_words, n_features, weight = [], [], []
            for text in batch.column(1):
                features = total = w = 0
                text = text.as_py()
                for some in runs(text, longest):
                    features += len(some)
                    w += len(some) if longest == 1 else sum(len(x) == 1 for x in some)
                    total += sum(gain_of[bucket_of[x]] for x in some)
                n_words.append(w), n_features.append(features), weight.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    docs = only(documents, doc_id=id_col, text=text_col)
    return docs.mapInArrow(run, f"doc_id {docs.dtypes[0][1]}, n_words long, n_features long, weight long")


def noise(seed: str = SEED) -> Column:
    """floor(1000 times a Gumbel variate) that seed and id fix."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(uniform)))


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``scored`` with the places 1 .. ``drawn`` by falling score, then id."""
    order = scored.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    # The identifier holds a row's part in its high bits and its place there in the low 33.
    order = saved(order.withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", 33).cast("int")
    sizes = {r.part: r.n for r in order.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for k in range(max(sizes, default=0) + 1):
        starts.append(before)
        before += sizes.get(k, 0)
    rank = F.get(F.array(*map(F.lit, starts)).cast("array<long>"), part) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return order.withColumn("rank", F.when(rank <= drawn, rank)).drop("at")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rows not drawn have no rank.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred are drawn.
    """
    gain = gains(counted(documents, text_col, buckets, longest), counted(target, target_col, buckets, longest))
    rows = saved(weighed(documents, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise(seed)), "importance-scored")
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    drawn = ranked(rows.where(enough), percent * n // 100)
    return drawn.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
