"""Evaluation metrics of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelake.operators.identity import ranked


def ratio(a: Column, b: Column, zero: bool = False) -> Column:
    """a / b; without b it is null, or 0 by the other policy."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0) if zero else F.lit(None).cast("double"))


def reference_labels(a: DataFrame, b: DataFrame, adjudicated: DataFrame, keys: list[str]) -> DataFrame:
    """Two passes of judgments: agreements stand, others take the adjudication or stay unresolved."""
    both = a.withColumnRenamed("judgment", "judgment_a").join(b.withColumnRenamed("judgment", "judgment_b"), keys).join(adjudicated.withColumnRenamed("judgment", "decided"), keys, "left")
    agreed = F.col("judgment_a") == F.col("judgment_b")
    return both.select(*keys, "judgment_a", "judgment_b", agreed.alias("agreed"), F.when(agreed, F.col("judgment_a")).otherwise(F.coalesce("decided", F.lit("unresolved"))).alias("final"))


def confusion(pairs: DataFrame, by: list[str], zero: bool = False) -> DataFrame:
    """pairs: by, predicted (bool), actual (bool, null unresolved)."""
    p, a = F.col("predicted"), F.col("actual")
    counts = pairs.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"), F.count_if(a.isNull()).alias("unresolved"))
    return scored_counts(counts, zero)


def scored_counts(counts: DataFrame, zero: bool = False) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp, zero), "recall": ratio(tp, tp + fn, zero), "f1": ratio(2 * tp, 2 * tp + fp + fn, zero)})


def macro_micro(conf: DataFrame) -> DataFrame:
    """One row: macro means over defined values, micro values from pooled counts."""
    pooled = conf.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    return scored_counts(pooled).withColumnsRenamed({"precision": "micro_precision", "recall": "micro_recall", "f1": "micro_f1"})


def pr_curve(scored: DataFrame, by: list[str]) -> DataFrame:
    """Points at each distinct score, highest first: counts are folded per score beforehand."""
    at = scored.groupBy(*by, "score").agg(F.count_if("actual").alias("pos"), F.count("*").alias("n"))
    total = at.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    w = W.partitionBy(*by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    run = at.withColumns({"tp": F.sum("pos").over(w), "picked": F.sum("n").over(w)}).join(total, by)
    return run.select(*by, "score", "tp", "picked", ratio(F.col("tp"), F.col("picked")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"))


def average_precision(curve: DataFrame, by: list[str]) -> DataFrame:
    before = F.lag("recall", 1, 0.0).over(W.partitionBy(*by).orderBy(F.desc("score")))
    return curve.withColumn("step", (F.col("recall") - before) * F.col("precision")).groupBy(*by).agg(F.sum("step").alias("average_precision"))


def keep_metrics(scored: DataFrame, threshold: float, slices: list[str]) -> DataFrame:
    """Keep recall, false rejects, rejection rate and reject precision, overall and per slice.

    One expansion over grouping sets; a row's slice is named ``slice`` and its value ``value``.
    """
    each = F.array(F.struct(F.lit("all").alias("slice"), F.lit("").alias("value")), *[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in slices])
    rows = scored.withColumn("rejected", F.col("score") < threshold).select("actual", "rejected", F.inline(each))
    keep, rej = F.col("actual"), F.col("rejected")
    c = rows.groupBy("slice", "value").agg(F.count("*").alias("n"), F.count_if(keep).alias("keeps"), F.count_if(keep & rej).alias("false_rejects"), F.count_if(rej).alias("rejects"))
    return c.select("slice", "value", "n", "false_rejects", ratio(F.col("keeps") - F.col("false_rejects"), F.col("keeps")).alias("keep_recall"), ratio(F.col("rejects"), F.col("n")).alias("rejection_rate"), ratio(F.col("rejects") - F.col("false_rejects"), F.col("rejects")).alias("reject_precision"))


def choose_threshold(scored: DataFrame, recall: float, by: str = "fold") -> DataFrame:
    """Per fold the score at place floor((1 - recall) * n + 1e-9) among the rows to keep, over counts per score."""
    at = scored.where("actual").groupBy(by, "score").agg(F.count("*").alias("n"))
    total = at.groupBy(by).agg(F.sum("n").alias("all")).withColumn("place", F.floor((1 - recall) * F.col("all") + 1e-9) + 1)
    run = at.withColumn("upto", F.sum("n").over(W.partitionBy(by).orderBy("score").rowsBetween(W.unboundedPreceding, 0)))
    return run.join(total, by).where(F.col("upto") >= F.col("place")).groupBy(by).agg(F.min("score").alias("threshold"))


def threshold_sweep(scored: DataFrame, grid: list[float], by: list[str]) -> DataFrame:
    """Counts at each threshold: rows are folded per score before they meet the grid."""
    at = scored.groupBy(*by, "score").agg(F.count_if("actual").alias("pos"), F.count("*").alias("n"))
    each = at.select("*", F.explode(F.array(*[F.lit(g) for g in grid])).alias("threshold"))
    low = F.col("score") < F.col("threshold")
    s = each.groupBy(*by, "threshold").agg(F.sum(F.when(low, F.col("n")).otherwise(0)).alias("rejects"), F.sum(F.when(low, F.col("pos")).otherwise(0)).alias("false_rejects"), F.sum("pos").alias("keeps"))
    return s.select(*by, "threshold", "rejects", "false_rejects", ratio(F.col("keeps") - F.col("false_rejects"), F.col("keeps")).alias("keep_recall"))


def fold_frontier(scored: DataFrame, budget: int) -> DataFrame:
    """(fold, threshold, rejects, false_rejects, total_rejects, total_false_rejects): one threshold a fold, which
    together reject most with at most ``budget`` false rejects.

    scored: fold, score, actual (to keep).  A fold's options are the scores of its first budget + 1 rows to keep; a threshold
    rejects what is below it.  Folds are combined by a min-plus convolution over the false rejects used so far: a state for each number
    of them holds the most rejects and the options chosen, so that ``folds * budget ** 2`` sums decide, whatever the number of rows.
    Equal sums go to fewer false rejects, then to lower thresholds, earlier folds first.  A fold without a row to keep has no threshold
    and rejects nothing.
    """
    at = scored.where("score is not null").groupBy("fold", "score").agg(F.count("*").alias("n"), F.count_if("actual").alias("pos"))
    w = W.partitionBy("fold").orderBy("score")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    below = at.select("fold", "score", "pos", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rejects"), F.coalesce(F.sum("pos").over(before), F.lit(0)).alias("false_rejects"))
    options = below.where((F.col("pos") > 0) & (F.col("false_rejects") <= budget)).select("fold", F.col("false_rejects").cast("int").alias("f"), "rejects", F.col("score").alias("threshold"))
    none = scored.select("fold").distinct().select("fold", F.lit(0).alias("f"), F.lit(0).cast("long").alias("rejects"), F.lit(None).cast("double").alias("threshold"))
    # A fold's own options of no false reject come before the empty one.
    each = options.unionByName(none).groupBy("fold", "f").agg(F.max(F.struct(F.col("threshold").isNotNull().alias("own"), "rejects", "threshold")).alias("o"))
    per = each.groupBy("fold").agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("o.rejects", "o.threshold")))).alias("options"))
    folds = per.agg(F.array_sort(F.collect_list(F.struct("fold", F.transform(F.sequence(F.lit(0), F.lit(budget)), lambda f: F.try_element_at("options", f)).alias("options")))).alias("folds"))
    pick = f"array<struct<fold:{scored.schema['fold'].dataType.simpleString()},threshold:double,rejects:bigint,false_rejects:int>>"
    state = f"struct<rejects:bigint,low:array<double>,picks:{pick}>"
    start = F.transform(F.sequence(F.lit(0), F.lit(budget)), lambda t: F.when(t == 0, F.expr(f"cast(named_struct('rejects', 0L, 'low', array(), 'picks', array()) as {state})")))

    def joined(acc: Column, x: Column, t: Column, f: Column) -> Column:
        was, own = F.get(acc, t - f), F.get(x["options"], f)
        added = F.struct(
            (was["rejects"] + own["rejects"]).alias("rejects"),
            F.concat(was["low"], F.array(-F.coalesce(own["threshold"], F.lit(float("-inf"))))).alias("low"),
            F.concat(was["picks"], F.array(F.struct(x["fold"].alias("fold"), own["threshold"].alias("threshold"), own["rejects"].alias("rejects"), f.alias("false_rejects")))).alias("picks"),
        )
        return F.when(was.isNotNull() & own.isNotNull(), added)

    def step(acc: Column, x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(budget)), lambda t: F.array_max(F.transform(F.sequence(F.lit(0), t), lambda f: joined(acc, x, t, f))))

    ends = folds.select(F.posexplode(F.aggregate("folds", start, step)).alias("used", "s")).where("s is not null")
    best = ends.agg(F.max(F.struct("s.rejects", (-F.col("used")).alias("unused"), "s.low", "s.picks")).alias("b")).where("b is not null")
    return best.select(F.inline("b.picks"), F.col("b.rejects").alias("total_rejects"), (-F.col("b.unused")).cast("int").alias("total_false_rejects"))


def calibration(scored: DataFrame, least: float = 1e-12) -> DataFrame:
    """Ten bins with mean score and share of rows to keep, and a row of all (bin -1) with the expected calibration
    error, the Brier score and the cross entropy (scores no nearer than ``least`` to 0 and 1)."""
    y = F.col("actual").cast("double")
    p = F.least(F.greatest("score", F.lit(least)), F.lit(1 - least))
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    bins = scored.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(y).alias("k"), F.sum((F.col("score") - y) ** 2).alias("b"), F.sum(loss).alias("c"))
    none = F.lit(None).cast("double")
    each = bins.select("bin", "n", (F.col("s") / F.col("n")).alias("mean_score"), (F.col("k") / F.col("n")).alias("keep_share"), none.alias("ece"), none.alias("brier"), none.alias("cross_entropy"))
    total = F.sum("n")
    whole = bins.agg(F.lit(-1).cast("long").alias("bin"), total.alias("n"), (F.sum("s") / total).alias("mean_score"), (F.sum("k") / total).alias("keep_share"), (F.sum(F.abs(F.col("s") - F.col("k"))) / total).alias("ece"), (F.sum("b") / total).alias("brier"), (F.sum("c") / total).alias("cross_entropy"))
    return each.unionByName(whole)


def changed_decisions(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: actual (to keep), base and candidate (rejected). Per cohort: changes, errors that go, come and stay, the
    rate of flips, and whether the candidate is a safety regression (more new than recovered errors)."""
    a, b, c = F.col("actual"), F.col("base"), F.col("candidate")
    n = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(b != c).alias("changed"), F.count_if(a & b & ~c).alias("recovered"), F.count_if(a & ~b & c).alias("new_errors"), F.count_if(a & b & c).alias("persistent"))
    return n.withColumns({"flip_rate": F.col("changed") / F.col("n"), "regression": F.col("new_errors") > F.col("recovered")})


def curve_consistency(stored: DataFrame, recomputed: DataFrame, key: str, now, stale_days: int = 45, tolerance: float = 1e-12) -> DataFrame:
    """stored: key, run_id, completed, average_precision; recomputed: key, average_precision.

    Whether a stored figure differs from the recomputed one, how old it is, and the figure of the run before.
    """
    j = stored.join(recomputed.select(key, F.col("average_precision").alias("again")), key)
    before = F.lag("average_precision").over(W.partitionBy(key).orderBy("completed", "run_id"))
    differs = F.abs(F.col("average_precision") - F.col("again")) > tolerance
    fresh = F.when(F.datediff(F.lit(now), "completed") > stale_days, "STALE").otherwise("CURRENT")
    return j.select(key, "run_id", "average_precision", F.coalesce(differs, F.lit(True)).alias("differs"), fresh.alias("freshness"), before.alias("previous"))


def release_gate(base: DataFrame, candidate: DataFrame, key: str, gain: float = 0.05, floor: float = 0.5, loss: float = 0.03, support: int = 10) -> DataFrame:
    """base, candidate: key, tp, fp, fn, tn, precision, f1, average_precision.

    accept: F1 gains enough, precision stays above the floor and loses little, average precision is kept; review:
    too few positives or negatives; else reject.
    """
    old = base.select(key, *[F.col(c).alias(f"old_{c}") for c in ("precision", "f1", "average_precision")])
    j = candidate.join(old, key)
    few = (F.col("tp") + F.col("fn") < support) | (F.col("fp") + F.col("tn") < support)
    good = (F.col("f1") - F.col("old_f1") >= gain) & (F.col("precision") >= floor) & (F.col("old_precision") - F.col("precision") <= loss) & (F.col("average_precision") >= F.col("old_average_precision"))
    return j.select(key, F.when(few, "review").when(good, "accept").otherwise("reject").alias("verdict"))


def triage_reference(decisions: DataFrame, hard: list[str], positive: list[str], irrelevant: list[str], id_col: str = "posting_no") -> DataFrame:
    """decisions: id, concept_id, final (present, absent, unresolved). Per posting whether it is worth sending, whether it
    is kept for doubt alone, and why, by precedence: hard conflict, irrelevant occupation without any evidence for it,
    positive evidence, unresolved evidence, nothing conclusive."""
    among = lambda ids, final: F.array_join(F.array_sort(F.collect_set(F.when(F.col("concept_id").isin(ids) & (F.col("final") == final), F.col("concept_id")))), ",")
    g = decisions.groupBy(id_col).agg(among(hard, "present").alias("h"), among(positive, "present").alias("p"), among(positive, "unresolved").alias("u"), among(irrelevant, "present").alias("i"))
    barred = (F.col("h") != "") | ((F.col("i") != "") & (F.col("p") == "") & (F.col("u") == ""))
    basis = F.when(F.col("h") != "", F.concat(F.lit("hard conflict: "), "h")).when(barred, F.concat(F.lit("irrelevant: "), "i")).when(F.col("p") != "", F.concat(F.lit("evidence: "), "p")).when(F.col("u") != "", F.concat(F.lit("unresolved: "), "u")).otherwise("inconclusive")
    return g.select(id_col, (~barred).alias("worth_sending"), (~barred & (F.col("p") == "")).alias("ambiguous"), basis.alias("basis"))


def label_conflicts(rows: DataFrame, keys: dict[str, Column], label: str, part: str) -> DataFrame:
    """(kind, key, n, labels, parts) of the values of each key that occur more than once with several labels or parts."""
    each = rows.select(F.col(label).alias("label"), F.col(part).alias("part"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()])))
    g = each.where("key is not null").groupBy("kind", "key").agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"), F.count_distinct("part").alias("parts"))
    return g.where("n > 1 and (labels > 1 or parts > 1)")


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each group: values are ranked by a range sort, and only the places asked for are read."""
    placed = ranked(rows.select(by, value).where(F.col(value).isNotNull()), [by, value])
    groups = placed.groupBy(by).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    asks = groups.select(by, "first", "n", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(v) * (F.col("n") - 1)).alias("at")) for k, v in shares.items()])))
    asks = asks.select(by, "name", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k"), "first").withColumn("place", F.col("first") + F.col("k"))
    met = placed.select("place", value).join(asks, "place")
    part = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("k")))
    wide = met.groupBy(by, "name").agg(F.sum(F.col(value) * part).alias("x"))
    return wide.groupBy(by).agg(*[F.max(F.when(F.col("name") == k, F.col("x"))).alias(k) for k in shares])


def audit_estimates(rows: DataFrame, stratum: str) -> DataFrame:
    """rows: stratum, sampled, actual (to keep), rejected. Per stratum: population, sample, weight, and design-weighted
    totals of rows to keep and false rejects, with the recall that they imply."""
    smp, a, rej = F.col("sampled"), F.col("actual"), F.col("rejected")
    g = rows.groupBy(stratum).agg(F.count("*").alias("pop"), F.count_if(smp).alias("smp"), F.count_if(smp & a).alias("k"), F.count_if(smp & a & rej).alias("fr")).where("smp > 0")
    w = F.col("pop") / F.col("smp")
    return g.select(stratum, "pop", "smp", w.alias("weight"), (F.col("k") * w).alias("keeps"), (F.col("fr") * w).alias("false_rejects"), ratio(F.col("k") - F.col("fr"), F.col("k")).alias("recall"))


def untouched_parity(base: DataFrame, candidate: DataFrame, concept: str, id_col: str = "posting_no") -> DataFrame:
    """base, candidate: id, concept_id of positive decisions. Decisions of the other concepts that a candidate loses or gains."""
    b = base.where(F.col("concept_id") != concept).select(id_col, "concept_id", F.lit(True).alias("b"))
    c = candidate.where(F.col("concept_id") != concept).select(id_col, "concept_id", F.lit(True).alias("c"))
    both = b.join(c, [id_col, "concept_id"], "full")
    return both.groupBy("concept_id").agg(F.count_if("b").alias("n"), F.count_if(F.col("c").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("gained"))


def span_coverage(spans: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Share of each span (start, end) inside the merged windows (start, end) of its key."""
    w = W.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    run = windows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = run.groupBy(key, "island").agg(F.min("start").alias("ws"), F.max("end").alias("we"))
    met = spans.join(merged, key, "left")
    inside = F.greatest(F.least("end", "we") - F.greatest("start", "ws"), F.lit(0))
    per = met.groupBy(key, "start", "end").agg(F.sum(F.coalesce(inside, F.lit(0))).alias("covered"))
    return per.withColumn("share", F.col("covered") / (F.col("end") - F.col("start")))
