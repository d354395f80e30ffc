"""Corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage works on all rows that its predecessor kept, and all but the last return the columns
of ``documents``.  No stage can be stated in SQL as a whole (trained prototypes, raking and
best-fit packing), so the pipeline is tested against the operators' brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import langid, mixing, ngram_join, packing, pii
from hirelake.llm.common import freeing, saved, ship, table
from hirelake.llm.queries import tokenizer_path

#: Below this cosine with every prototype a text is in none of the languages: three deviations of unrelated vectors, whose
#: cosines are about normal with a deviation of 1 / sqrt(dimensions).
LEAST_SCORE = 3 / langid.DIMENSIONS**0.5

#: Bytes of word ids that a worker keeps while packing: the stages before have left the executors' heaps full.
WORD_MEMORY = (24 << 20, 24 << 20)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter or without likeness to any language that was learnt."""
    ship(spark)
    learnt = langid.prototypes(docs.where(~langid.held_out()))
    return langid.accepted(docs, learnt, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest doc_id stays, once; a null id comes last.

    Rows are known by a hash of id and text, as ids may be null or repeated.  Texts without a
    shingle link with nothing and all stay.
    """
    ship(spark)
    key = F.xxhash64("doc_id", "text", F.length("text"))
    keyed = docs.select(key.alias("row_key"), "text")
    linked = ngram_join.linked(keyed, percent=80, words=5, id_col="row_key").withColumnRenamed("doc_id", "row_key")
    with freeing(spark):
        linked = saved(linked, "pipeline-linked")
        # Only rows in groups are told apart; a group is known by its smallest key.
        groups = linked.where("n_shingles > 0").groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
        grouped = linked.where("n_shingles > 0").join(groups, "component_id", "left_semi").select("row_key", "component_id").distinct()
        return _firsts(docs, key, linked, saved(grouped, "pipeline-grouped"))


def _firsts(docs: DataFrame, key: Column, linked: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows without those of a group's other keys, and once where a key is repeated."""
    named = docs.select(key.alias("row_key"), "doc_id").join(grouped, "row_key")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")).select("first.row_key")
    gone = saved(grouped.select("row_key").join(first, "row_key", "left_anti"), "pipeline-gone")
    kept = docs.withColumn("row_key", key).join(gone, "row_key", "left_anti")
    repeated = saved(linked.where("n_shingles > 0").groupBy("row_key").agg(F.count("*").alias("n")).where("n > 1").select("row_key"), "pipeline-repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])
        kept = kept.join(repeated, "row_key", "left_anti").unionByName(once)
    return kept.select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kinds; n_chars follows the text."""
    ship(spark)
    columns = docs.columns
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.kept(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer_path(), memory=WORD_MEMORY)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn; each result is written and read again, the last one returned as is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
