"""Search, filters and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import remote_named

#: Age groups in days, fixed values; rows without a date are unknown.
AGE_GROUPS = (("today", 0), ("yesterday", 1), ("2-7", 7), ("8-14", 14), ("15-30", 30))
#: States of the US by code, with the names that labels give them (fixed values).
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia",
    "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine",
    "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}


def terms(raw: list[str]) -> list[str]:
    return sorted({t.strip().lower() for t in raw if t.strip()})


def keyword_match(text: Column, include: list[str], exclude: list[str]) -> Column:
    """Any included term (or none asked for) and no excluded one; an unknown text passes."""
    low = F.lower(text)
    has = lambda ts: F.array_contains(F.array(*[F.coalesce(F.contains(low, F.lit(t)), F.lit(False)) for t in ts]), True)
    inc, exc = terms(include), terms(exclude)
    found = has(inc) if inc else F.lit(True)
    return text.isNull() | (found & ~has(exc) if exc else found)


def age_group(days: Column) -> Column:
    out = F.when(days.isNull(), "unknown")
    for name, most in AGE_GROUPS:
        out = out.when(days <= most, name)
    return out.otherwise("31+")


def headroom(desired: Column, low: Column, high: Column) -> Column:
    """Place of the desired pay in the range, 0 to 1."""
    return F.when(high > low, F.least(F.greatest((desired - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def facets(rows: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Per key its first label in order and the number of rows."""
    return rows.groupBy(*keys).agg(F.min_by(label, order).alias("label"), F.count("*").alias("n"))


#: Shapes of US labels: (pattern, group of the state, group of the place, whether the state is a name).
SHAPES = (
    ("(?i)^us\\s*,\\s*([A-Z]{2})\\s*,\\s*(.+)$", 1, 2, False),
    ("^(.+?)\\s*,\\s*([A-Z]{2})\\s*,\\s*(?:[Uu]nited [Ss]tates).*$", 2, 1, False),
    ("(?i)^united states-([a-z ]+)-(.+)$", 1, 2, True),
    ("(?i)^us-([a-z]{2})-(.+)$", 1, 2, False),
    ("(?i)^us - ([a-z]{2}),\\s*(.+)$", 1, 2, False),
    ("^(.+)\\s*,\\s*([A-Z]{2})$", 2, 1, False),
    ("^([A-Z]{2}) - (.+)$", 1, 2, False),
)


def us_location(label: Column) -> Column:
    """struct(state, place) of the first of the seven label shapes with a known state; else null."""
    codes = F.create_map(*[x for c, n in STATES.items() for x in (F.lit(n.lower()), F.lit(c))])
    found = []
    for pattern, at, rest, by_name in SHAPES:
        raw, place = F.regexp_extract(label, pattern, at), F.trim(F.regexp_extract(label, pattern, rest))
        state = F.try_element_at(codes, F.lower(raw)) if by_name else F.when(F.upper(raw).isin(*STATES), F.upper(raw))
        found.append(F.when(label.rlike(pattern) & state.isNotNull() & (place != ""), F.struct(state.alias("state"), place.alias("place"))))
    return F.coalesce(*found)


def state_groups(labels: DataFrame) -> DataFrame:
    """labels: label, n. Per state (``Other`` for the rest, which comes last): its name, number of rows and places."""
    where = us_location(F.col("label"))
    names = F.create_map(*[x for c, n in STATES.items() for x in (F.lit(c), F.lit(n))])
    rows = labels.withColumns({"where": where}).select(F.coalesce("where.state", F.lit("Other")).alias("state"), F.coalesce("where.place", "label").alias("place"), "n")
    per = rows.groupBy("state").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("place")), ";").alias("places"))
    return per.select("state", F.coalesce(F.try_element_at(names, F.col("state")), F.lit("Other locations")).alias("name"), "n", "places", (F.col("state") != "Other").alias("mapped"))


def placed(metadata: Column, location: Column, body: Column) -> Column:
    """Whether a posting is remote or in a state of the US."""
    return remote_named(metadata, body) | us_location(location).isNotNull()


def acceptable() -> Column:
    """Whether a row of facts passes its reader's filter of pay and strict requirements.

    Columns: period, maximum (pay), desired_pay, education_kind, clearance_kind, authorization_kind, away_confidence.
    Only annual pay below the wish hides; unknown pay passes.
    """
    pay = F.coalesce((F.col("period") != "annual") | F.col("maximum").isNull() | (F.col("maximum") >= F.col("desired_pay")), F.lit(True))
    strict = (F.col("education_kind") == "requiredGap") | (F.col("clearance_kind") == "strictGap") | (F.col("authorization_kind") == "mismatch") | (F.col("away_confidence") == "strong")
    return pay & ~strict
