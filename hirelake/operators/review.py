"""Human review: status of cases, fresh observations, selection of new cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelake.operators.clusters import written

#: Fixed weights of reasons, least score, caps of a batch.
REASONS = {"new_employer": 2.0, "rare_tokens": 1.0, "rule_conflict": 3.0, "title_only": 3.0}
LEAST_NEW, LEAST_CASES, LEAST_EMPLOYERS = 25, 10, 3
LEAST_SCORE, MOST_CASES, PER_EMPLOYER, TWIN = 4.0, 24, 6, 0.8


def review_status(queue: DataFrame, revisions: DataFrame) -> DataFrame:
    """Latest revision of each queued case and whether it disagrees with the machine."""
    last = revisions.groupBy("case_id").agg(F.max(F.struct("revision", "decision")).alias("r")).select("case_id", "r.*")
    j = queue.join(last, "case_id", "left")
    return j.withColumn("state", F.coalesce("decision", F.lit("open"))).withColumn("disagrees", F.col("decision") != F.col("machine"))


def fresh_observations(observations: DataFrame, ledger: DataFrame, start) -> DataFrame:
    """One row per key, newer than the ledger's start and not in it: the earliest."""
    new = observations.where(F.col("ts") > F.lit(start)).join(ledger.select("key"), "key", "left_anti")
    return new.groupBy("key").agg(F.min(F.struct("ts", "event_id")).alias("o")).select("key", "o.ts", "o.event_id")


def select_review_cases(cases: DataFrame, prior: DataFrame, least: float = LEAST_SCORE, most: int = MOST_CASES, per_employer: int = PER_EMPLOYER, twin: float = TWIN) -> DataFrame:
    """cases: case_id, employer, tokens, reasons (arrays). Scored by their reasons; those too like a
    reviewed case are skipped; then employers take turns, each with its best cases, up to the caps.

    Cases meet reviewed ones by shared tokens.  A case's tokens are read once: its words are counted by reviewed case where
    they are, as the few words of reviewed cases go to all tasks while they are small.
    """
    weights = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])
    score = F.aggregate("reasons", F.lit(0.0), lambda a, r: a + F.coalesce(weights[r], F.lit(0.0)))
    scored = cases.withColumn("score", score).where(F.col("score") >= least)
    reviewed = written(prior.select(F.col("case_id").alias("p"), F.size("tokens").alias("m"), F.explode("tokens").alias("t")), "reviewed-words")
    words = scored.select("case_id", "employer", "score", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("t")).join(reviewed, "t", "left")
    shared = words.groupBy("case_id", "employer", "score", "n", "p", "m").agg(F.count("*").alias("k"))
    alike = F.coalesce(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), F.lit(0.0))  # words of no reviewed case are one group without p
    left = shared.groupBy("case_id", "employer", "score").agg(F.max(alike).alias("alike")).where(F.col("alike") < twin).select("case_id", "employer", "score")
    # A rank that is bounded by a constant is cut in every task before rows move.
    turn = F.row_number().over(W.partitionBy("employer").orderBy(F.desc("score"), "case_id"))
    order = ["turn", F.desc("score"), "case_id"]
    top = left.withColumn("turn", turn).where(F.col("turn") <= per_employer).orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).select("case_id", "employer", "score", "place")


def review_due(selected: DataFrame, new_keys: DataFrame, observations: int = LEAST_NEW, cases: int = LEAST_CASES, employers: int = LEAST_EMPLOYERS) -> DataFrame:
    """One row: new observations, selected cases and their employers, and whether all three suffice for a review."""
    n = new_keys.agg(F.count("*").alias("observations"))
    c = selected.agg(F.count("*").alias("cases"), F.count_distinct("employer").alias("employers"))
    return n.crossJoin(F.broadcast(c)).withColumn("due", (F.col("observations") >= observations) & (F.col("cases") >= cases) & (F.col("employers") >= employers))
