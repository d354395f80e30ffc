"""Reproducible samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank_key(seed: str, *columns: str) -> Column:
    """A seeded digest to order by."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in columns]), 256)


def hash_sample(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """The n rows of smallest digest: a top-k, not a full sort."""
    return rows.withColumn("__k", rank_key(seed, key)).orderBy("__k", key).limit(n).drop("__k")


def quotas(rows: DataFrame, n: int, seed: str, stratum: str) -> DataFrame:
    """(stratum, quota): proportional, floors first, largest remainders next, hashed ties.

    The strata table is small: its ranks are taken over the aggregated counts.
    """
    counts = rows.groupBy(stratum).agg(F.count("*").alias("size"))
    all_ = F.sum("size").over(W.partitionBy())
    share = F.lit(n) * F.col("size") / all_
    c = counts.withColumn("share", share).withColumn("base", F.floor("share").cast("long")).withColumn("rest", F.round(F.col("share") - F.col("base"), 9))
    place = F.row_number().over(W.orderBy(F.desc("rest"), rank_key(seed, stratum)))
    left = F.lit(n) - F.sum("base").over(W.partitionBy())
    return c.select(stratum, "size", (F.col("base") + F.when(place <= left, 1).otherwise(0)).alias("quota"))


def stratified_sample(rows: DataFrame, n: int, seed: str, stratum: str, key: str) -> DataFrame:
    """Each stratum's quota of smallest digests. A rank within the largest quota is cut in every task before rows move."""
    q = quotas(rows, n, seed, stratum).select(stratum, "quota")
    most = q.agg(F.max("quota")).first()[0] or 0
    rank = F.row_number().over(W.partitionBy(stratum).orderBy("__k", key))
    first = rows.withColumn("__k", rank_key(seed, key)).withColumn("__r", rank).where(F.col("__r") <= most)
    return first.join(q, stratum).where("__r <= quota").drop("__r", "__k", "quota")


def quota_sample(rows: DataFrame, families: list[tuple[str, Column, int]], seed: str, title: str, key: str) -> DataFrame:
    """Families in order, each with its quota; a title is used once over all families."""
    used, out = None, None
    for name, condition, n in families:
        pool = rows.where(condition)
        if used is not None:
            pool = pool.join(used, title, "left_anti")
        first = pool.withColumn("__k", rank_key(seed, key)).withColumn("__r", F.row_number().over(W.partitionBy(title).orderBy("__k", key))).where("__r = 1")
        picked = first.orderBy("__k", key).limit(n).drop("__k", "__r").withColumn("family", F.lit(name))
        out = picked if out is None else out.unionByName(picked)
        used = out.select(title).distinct()
    return out


def round_robin(rows: DataFrame, group: str, bucket: str, n: int, cap: int, seed: str, key: str) -> DataFrame:
    """Turns over the buckets: each row's turn is its place in its bucket; at most ``cap`` of a group, ``n`` in all.

    A bucket's rows beyond n can be wanted only where the cap passes over earlier ones, so the cap is applied to each
    group's first rows of each bucket before turns are given.
    """
    ranked = rows.withColumn("__k", rank_key(seed, key))
    near = ranked.withColumn("__g", F.row_number().over(W.partitionBy(group, bucket).orderBy("__k", key))).where(F.col("__g") <= cap).drop("__g")
    turned = near.withColumn("turn", F.row_number().over(W.partitionBy(bucket).orderBy("__k", key)))
    within = F.row_number().over(W.partitionBy(group).orderBy("turn", bucket, key))
    return turned.withColumn("__c", within).where(F.col("__c") <= cap).drop("__c", "__k").orderBy("turn", bucket, key).limit(n)


def group_split(rows: DataFrame, group: str, cluster: str, parts: int, seed: str) -> DataFrame:
    """Group-disjoint parts; rows whose cluster is also in an earlier part are purged."""
    part = F.pmod(F.conv(F.substring(rank_key(seed, group), 1, 8), 16, 10).cast("long"), F.lit(parts))
    marked = rows.withColumn("part", part.cast("int"))
    first = marked.groupBy(cluster).agg(F.min("part").alias("first_part"))
    return marked.join(first, cluster).withColumn("purged", F.col("part") > F.col("first_part")).drop("first_part")


def holdout_guard(rows: DataFrame, known: DataFrame, seen: DataFrame, own_sources: list[str]) -> DataFrame:
    """rows: doc_id, final, source, h, with the reason why an example may not be scored, or ``accepted``.

    known: h of texts that were developed on; seen: doc_id of examples shown before; own_sources: sources that label
    their own examples.  The first reason counts: unresolved, contaminated, exposed, self-labelled.
    """
    j = rows.join(known.withColumn("__known", F.lit(True)), "h", "left").join(seen.withColumn("__seen", F.lit(True)), "doc_id", "left")
    reason = F.when(F.col("final") == "unresolved", "unresolved").when(F.col("__known"), "contaminated").when(F.col("__seen"), "exposed").when(F.col("source").isin(own_sources), "self-labelled").otherwise("accepted")
    return j.withColumn("reason", reason).drop("__known", "__seen")
