"""Mixing to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic, with their tokens (words, unless a column holds counts).  Cell weights
start at the tokens and are raked: scaled so that each margin in turn has its target, until all
margins hold.  A cell's keeping probability is its weight over its tokens, times one constant
that is calibrated so that the expected tokens are the budget, and 1 at most.  A document is
kept when a hash of its id and the seed falls below its cell's probability.

Cells are aggregated before anything else; a raking step works on the cell table alone, in
Spark, and margins are joined back as Spark's size statistics allow.  Only a few sums reach the driver.

Cases: null source, language or topic is a value of its own (shown as null); a null text has no
tokens and keeps its cell's probability; cells without tokens keep probability 1; repeated
rows share their id's draw; an empty table gives an empty result; a margin value without a
target gets its share, by tokens, of what the named ones leave; a target of 0 drops its cells; margins that no weights
can meet are raked until they stop getting nearer, the last one exactly; columns other than those named pass through ``kept``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, saved

MARGINS = ("source", "lang", "topic")
#: Exponents that flatten the natural shares into targets, share of tokens to keep.
TEMPERATURE = {"source": 0.7, "lang": 0.8, "topic": 0.9}
BUDGET, SWEEPS, TOLERANCE, SEED = 0.8, 12, 1e-3, "mix-1"
_NONE = "\x00"


def topic_of(text) -> F.Column:
    """A coarse topic from the text's shape, for tables without a topic column: tables, marked-up
    text, shouting, notes (under 60 words) or prose."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    return (
        F.when(share("\\|") > 0.02, "table")
        .when(share("[#*$%&<>]") > 0.03, "markup")
        .when(share("[A-Z]") > 0.4, "shout")
        .when(n < 360, "note")
        .otherwise("prose")
    )


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(cells: DataFrame, temperature: dict[str, float], wanted: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Per margin (value, share) for every value with tokens.

    ``wanted`` maps a margin to {value: share} (None for a null value); the values it doesn't name divide what is left
    by their tokens.  Without that, the natural token shares are raised to the power of the temperature.
    """
    out = {}
    for m in {**temperature, **(wanted or {})}:
        sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
        given = (wanted or {}).get(m)
        if given is None:
            sums = sums.withColumn("t", F.pow("t", F.lit(temperature[m])))
        else:
            if min(given.values(), default=0) < 0 or sum(given.values()) > 1 + 1e-9:
                raise ValueError(f"shares of {m} must be positive and sum to 1 at most")
            rows = [(_NONE if k is None else k, float(v)) for k, v in given.items()]
            named = cells.sparkSession.createDataFrame(rows, "value string, given double")
            sums = checkpointed(sums.join(named, sums[m] == named.value, "left").drop("value"))
            held, free = sums.agg(F.coalesce(F.sum("given"), F.lit(0.0)), F.sum(F.when(F.col("given").isNull(), F.col("t")))).first()
            share = F.col("t") * F.lit(max(0.0, 1 - held) / free) if free else F.lit(0.0)
            sums = sums.select(m, F.coalesce("given", share).alias("t"))
        total = sums.agg(F.sum("t").alias("total"))
        out[m] = sums.join(F.broadcast(total)).select(m, (F.col("t") / F.col("total")).alias("share"))
    return out


def raked(cells: DataFrame, wanted: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (margins, tokens) with weight: raked until each margin is within the tolerance.

    Every step reads the table twice, so each is checkpointed: the plan of three steps in a row would read it eight times.
    """
    now = checkpointed(cells.withColumn("weight", F.col("tokens").cast("double")))
    goal = {m: checkpointed(df) for m, df in wanted.items()}
    before = None
    for _ in range(sweeps):
        for m, df in goal.items():
            sums = now.groupBy(m).agg(F.sum("weight").alias("has")).join(df, m, "left")
            factor = F.when(F.col("has") > 0, F.coalesce("share", F.lit(0.0)) * F.lit(1.0) / F.col("has")).otherwise(0.0)
            now = checkpointed(now.join(sums.select(m, factor.alias("factor")), m).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor"))
        worst = _worst(now, goal)
        # Margins that no weights can meet stop improving.
        if (worst or 0) <= tolerance or before is not None and worst > 0.99 * before:
            break
        before = worst
    return now


def _worst(now: DataFrame, goal: dict[str, DataFrame]) -> float | None:
    """The largest relative distance of a margin's sum from its share, all margins summed in one pass."""
    named = lambda m, value: F.struct(F.lit(m).alias("margin"), F.col(value).cast("string").alias("value"))
    each = now.select(F.explode(F.array(*[named(m, m) for m in goal])).alias("of"), "weight").groupBy("of").agg(F.sum("weight").alias("has"))
    shares = functools.reduce(DataFrame.union, [df.where("share > 0").select(named(m, m).alias("of"), "share") for m, df in goal.items()])
    return each.join(shares, "of").agg(F.max(F.abs(F.col("has") - F.col("share")) / F.col("share"))).first()[0]


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with probability: min(1, c * weight / tokens), c such that the expected tokens are ``budget`` times all tokens.

    The sum is at most c times all weights and complete at the largest tokens / weight, which bounds c from both sides
    however far the rates lie apart; geometric steps over sums of the cell table narrow it, and between the last two
    values the sum is linear.  Where the cells of positive weight hold fewer tokens than asked for, all of them stay.
    """
    rate = F.col("weight") / F.col("tokens")
    spoken = cells.where("tokens > 0 and weight > 0")
    weights, held, high = spoken.agg(F.sum("weight"), F.sum("tokens"), F.max(1 / rate)).first()
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.withColumn("probability", F.lit(1.0))
    c, goal = high or 0.0, budget * total
    if high and held > goal:
        low = min(goal / weights, high)
        while high > low * (1 + 1e-6):
            # So many values of c are tried by one pass over the cells.
            tried = [low * (high / low) ** (k / 16) for k in range(1, 16)]
            sums = spoken.agg(*[F.sum(F.least(F.lit(1.0), F.lit(x) * rate) * F.col("tokens")) for x in tried]).first()
            low, high = max([low, *(x for x, s in zip(tried, sums) if s <= goal)]), min([high, *(x for x, s in zip(tried, sums) if s > goal)])
        full, rest = spoken.agg(F.sum(F.when(F.lit(low) * rate >= 1, F.col("tokens")).otherwise(0)), F.sum(F.when(F.lit(low) * rate < 1, F.col("weight")).otherwise(0.0))).first()
        c = min(max(low, (goal - full) / rest), high) if rest else low
    kept = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(c) * rate)).otherwise(0.0)
    return cells.withColumn("probability", F.when(F.col("tokens") > 0, kept).otherwise(1.0))


def _margins(documents: DataFrame, text_col: str, topic_col: str | None) -> dict[str, F.Column]:
    none = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(_NONE))
    return {"__source": none("source"), "__lang": none("lang"), "__topic": none(topic_col) if topic_col else topic_of(F.col(f"`{text_col}`"))}


def drawn(seed: str, id_col: str) -> F.Column:
    """A number in [0, 1) for each id."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha1(key), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def _keyed(documents: DataFrame, id_col: str, text_col: str, topic_col: str | None, tokens_col: str | None) -> DataFrame:
    tokens = F.col(f"`{tokens_col}`").cast("long") if tokens_col else word_count(F.col(f"`{text_col}`"))
    margins = _margins(documents, text_col, topic_col).items()
    return documents.select(F.col(f"`{id_col}`").alias("doc_id"), *[c.alias(m[2:]) for m, c in margins], F.coalesce(tokens, F.lit(0)).alias("tokens"))


def probabilities(keyed: DataFrame, temperature: dict[str, float] | None = None, budget: float = BUDGET, wanted: dict[str, dict] | None = None) -> DataFrame:
    """The cell table: source, lang, topic (null as a marker), tokens, weight, probability."""
    cells = checkpointed(keyed.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")))
    return saved(calibrated(raked(cells, targets(cells, temperature or TEMPERATURE, wanted)), budget), "mix-cells")


def mixed(documents: DataFrame, temperature: dict[str, float] | None = None, budget: float = BUDGET, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, tokens_col: str | None = None, wanted: dict[str, dict] | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept of every row.  Texts are read once."""
    rows = saved(_keyed(documents, id_col, text_col, topic_col, tokens_col), "mix-rows")
    cells = probabilities(rows, temperature, budget, wanted)
    table = cells.select(*MARGINS, "probability")
    back = [F.when(F.col(m) != _NONE, F.col(m)).alias(m) for m in MARGINS]
    return rows.join(table, list(MARGINS)).select("doc_id", *back, "tokens", "probability", (drawn(seed, "doc_id") < F.col("probability")).alias("kept"))


def kept(documents: DataFrame, temperature: dict[str, float] | None = None, budget: float = BUDGET, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, tokens_col: str | None = None, wanted: dict[str, dict] | None = None) -> DataFrame:
    """The sampled rows with all their columns; rows of one id go or stay together in a cell."""
    cells = probabilities(_keyed(documents, id_col, text_col, topic_col, tokens_col), temperature, budget, wanted)
    keys = _margins(documents, text_col, topic_col)
    table = cells.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], F.col("probability").alias("__probability"))
    joined = documents.withColumns(keys).join(table, list(keys))
    return joined.where(drawn(seed, id_col) < F.col("__probability")).select(*[f"`{c}`" for c in documents.columns])
