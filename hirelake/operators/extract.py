"""Observations from posting text: every amount of money, and every clause that speaks of a domain, with its scope,
obligation, polarity, timing and alternatives; links between claims that contradict; checks of observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelake.functions.text import once

_CURRENCY, _NUMBER = "(usd|cad|eur|gbp|\\$|€|£)", "([0-9][0-9,]*(?:\\.[0-9]+)?)(k?)"
#: One amount, or a range of two: currency, digits, scale, and the same of the upper bound.
MONEY = f"(?i){_CURRENCY}\\s?{_NUMBER}\\b(?:\\s*(?:-|to)\\s*{_CURRENCY}?\\s?{_NUMBER}\\b)?"
#: Codes by sign; a dollar sign alone names no currency.
CURRENCIES = {"usd": "USD", "cad": "CAD", "eur": "EUR", "gbp": "GBP", "€": "EUR", "£": "GBP"}
HEADING = "(?i)^[a-z ]{3,30}$"
UNITS = (("hour", "(?i)per hour|hourly|/hr"), ("month", "(?i)per month|a month|monthly"), ("year", "(?i)annual|per year|a year|salary|pay range"))
BASIS = (("bonus", "(?i)\\bbonus\\b"), ("stipend", "(?i)\\bstipend\\b"), ("base", "(?i)\\bbase\\b|salary|pay"))
PAY_CONTEXT = "(?i)\\b(?:pay|salary|compensation|bonus|stipend)\\b"

OBLIGATION = (("not-required", "(?i)\\b(?:no|not)\\b[^.]*\\b(?:needed|required)\\b"), ("required", "(?i)\\b(?:required|must|requires)\\b"), ("preferred", "(?i)\\b(?:preferred|useful|plus)\\b"), ("optional", "(?i)\\b(?:optional|may)\\b"))
NEGATED = "(?i)\\b(?:no|not|unable|without)\\b"
TIMING = (("now-or-later", "(?i)now or in the future"), ("up-to-share", "(?i)up to [0-9]+%"), ("recurring", "(?i)\\b(?:days a week|per week|weekly)\\b"))
#: What a claim of a domain says (domain, value, pattern), the first that holds.
VALUES = (("sponsorship", "notAvailable", "(?i)unable to sponsor|without sponsorship|not available"), ("sponsorship", "available", "(?i)sponsorship is available|will sponsor"), ("arrangement", "remote", "(?i)work remotely|fully remote"), ("arrangement", "onsite", "(?i)on site|report to the office"))
CLAUSE_END, BRANCH = "(?i)[;.]\\s+|[;.]$", "(?i) or "


def named(text: Column, table, none=None) -> Column:
    """Name of the first pattern that the text matches."""
    return F.coalesce(*[F.when(text.rlike(row[-1]), row[0]) for row in table], F.lit(none).cast("string"))


def amount(digits: Column, k: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * F.when(F.lower(k) == "k", 1000).otherwise(1)


def last_heading(key: str) -> Column:
    """The heading at or above a line."""
    return F.last(F.when(F.col("line").rlike(HEADING), F.col("line")), True).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))


def money(lines: DataFrame, key: str) -> DataFrame:
    """lines: key, line_no, line. Every amount or range: kind, bounds, currencies, unit, basis, qualifier, heading.

    Bounds of two currencies keep no upper value; unit and basis come from the line, else from the heading above it.
    """
    g = [F.regexp_extract_all("line", F.lit(MONEY), F.lit(k)) for k in range(7)]
    code = lambda c: F.coalesce(*[F.when(F.lower(c) == k, v) for k, v in CURRENCIES.items()], F.lit(None).cast("string"))
    rows = lines.withColumn("heading", last_heading(key)).select(key, "line_no", "line", "heading", F.posexplode(F.arrays_zip(*[c.alias(f"g{k}") for k, c in enumerate(g)])).alias("place", "m"))
    is_range = F.col("m.g5") != ""
    rows = rows.withColumns({"is_range": is_range, "lower": amount(F.col("m.g2"), F.col("m.g3")), "upper": F.when(is_range, amount(F.col("m.g5"), F.col("m.g6"))), "currency": code(F.col("m.g1")), "second": F.when(F.col("m.g4") != "", code(F.col("m.g4"))).otherwise(code(F.col("m.g1")))})
    mismatch = F.coalesce(F.col("is_range") & (F.col("currency") != F.col("second")), F.lit(False))
    reversed_ = F.coalesce(F.col("lower") > F.col("upper"), F.lit(False))
    explicit = F.col("line").rlike(PAY_CONTEXT) | F.coalesce(F.col("heading"), F.lit("")).rlike(PAY_CONTEXT)
    qualifier = F.when(mismatch, "currency-mismatch-review").when(reversed_, "reversed-range-review").when(explicit, "explicit").otherwise("monetary-context-unresolved")
    near = lambda table: F.coalesce(named(F.col("line"), table), named(F.coalesce(F.col("heading"), F.lit("")), table))
    return rows.select(
        key, "line_no", "place", F.when(F.col("is_range"), "range").otherwise("amount").alias("kind"), F.col("m.g0").alias("raw"), "lower", F.when(~mismatch, F.col("upper")).alias("upper"),
        "currency", F.when(F.col("is_range"), F.col("second")).alias("upper_currency"), near(UNITS).alias("unit"), near(BASIS).alias("basis"), qualifier.alias("qualifier"), "heading",
    )


def clauses(lines: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    """Every pattern's hits in the branches of each line's clauses.

    A hit has a stable id, its span in the line, what its clause obliges to, polarity, timing, the heading above it, the
    value that it claims, and the ids of hits in other branches of its clause, to which it is an alternative.
    """
    each = lines.withColumn("heading", last_heading(key)).select(key, "line_no", "line", "heading", F.posexplode(F.split("line", CLAUSE_END)).alias("clause_no", "clause")).where(F.trim("clause") != "")

    def hits(branch: Column, no: Column) -> Column:
        rows = []
        for domain, pattern in patterns.items():
            oid = F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), "line_no", "clause_no", no, F.lit(domain)), 256), 1, 16)
            value = named(branch, [v[1:] for v in VALUES if v[0] == domain], "") if any(v[0] == domain for v in VALUES) else F.lit("")
            hit = F.regexp_extract(branch, pattern, 0)
            rows.append(F.when(branch.rlike(pattern), F.struct(oid.alias("observation_id"), no.alias("branch_no"), F.lit(domain).alias("domain"), hit.alias("hit"), value.alias("value"))))
        return F.array_compact(F.array(*rows))

    either = "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns.values())  # one search leaves out most branches
    numbered = F.transform(F.split("clause", BRANCH), lambda b, i: F.struct(b.alias("text"), i.alias("no")))
    spoken = once(each, branches=F.filter(numbered, lambda b: b["text"].rlike(either))).where(F.size("branches") > 0)
    found = once(spoken, all=F.flatten(F.transform("branches", lambda b: hits(b["text"], b["no"])))).where(F.size("all") > 0)
    rows = found.select("*", F.explode("all").alias("o"))
    others = F.array_sort(F.transform(F.filter("all", lambda x: x["branch_no"] != F.col("o.branch_no")), lambda x: x["observation_id"]))
    return rows.select(
        key, "o.observation_id", "line_no", "clause_no", "o.branch_no", "o.domain", "o.hit", F.instr(F.col("line"), F.col("o.hit")).alias("start"), "line", named(F.col("clause"), OBLIGATION, "stated").alias("obligation"),
        F.when(F.col("clause").rlike(NEGATED), "negated").otherwise("affirmed").alias("polarity"), named(F.col("clause"), TIMING, "").alias("timing"), F.coalesce("heading", F.lit("")).alias("heading"), "o.value", others.alias("alternatives"),
    )


def contradictions(observations: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """(key, kind, observation_id, other_id) of claims to be reviewed.

    Opposite claims of sponsorship; required here and not required there in one domain; and body claims of an
    arrangement other than the one that the provider declares (declared: key, arrangement).  A posting's claims are
    few, so those that can contradict are one array a posting, read once, and pairs are made within it.
    """
    sponsor = (F.col("domain") == "sponsorship") & F.col("value").isin("notAvailable", "available")
    placed = (F.col("domain") == "arrangement") & (F.col("value") != "")
    claim = F.struct(F.col("observation_id").alias("id"), "domain", "obligation", "value")
    claims = observations.where(sponsor | placed | F.col("obligation").isin("not-required", "required")).groupBy(key).agg(F.collect_list(claim).alias("c"))
    said = claims.join(declared.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list("arrangement").alias("d")), key, "left").where(F.col(key).isNotNull())
    row = lambda kind, a, other: F.struct(F.lit(kind).alias("kind"), a["id"].alias("observation_id"), other.alias("other_id"))

    def pairs(kind: str, left, right) -> Column:
        return F.flatten(F.transform(F.filter("c", left), lambda a: F.transform(F.filter("c", lambda b: right(b) & (b["domain"] == a["domain"])), lambda b: row(kind, a, b["id"]))))

    sponsored = lambda value: lambda x: (x["domain"] == "sponsorship") & (x["value"] == value)
    obliged = lambda value: lambda x: x["obligation"] == value
    place = F.filter("c", lambda x: (x["domain"] == "arrangement") & (x["value"] != ""))
    other = F.flatten(F.transform(place, lambda a: F.transform(F.filter("d", lambda d: d != a["value"]), lambda d: row("provider-arrangement", a, F.concat(F.lit("provider:"), d)))))
    found = F.concat(pairs("opposite-sponsorship", sponsored("notAvailable"), sponsored("available")), pairs("obligation", obliged("not-required"), obliged("required")), F.coalesce(other, F.expr("cast(array() as array<struct<kind:string,observation_id:string,other_id:string>>)")))
    return said.select(key, F.inline(found))


def integrity(observations: DataFrame) -> DataFrame:
    """Per domain: observations, ids that occur again, spans that aren't the hit, and alternatives that don't exist.

    One pass: an observation is a row of its own id and one of each id that it names, and these meet by the id.
    """
    span = (F.col("start") > 0) & (F.substring(F.col("line"), F.col("start"), F.length("hit")) == F.col("hit"))
    row = lambda oid, own, bad: F.struct(oid.alias("id"), F.col("domain").alias("domain"), own.alias("own"), bad.alias("bad"))
    no, yes = F.lit(False), F.lit(True)
    rows = observations.select(F.inline(F.concat(F.array(row(F.col("observation_id"), yes, F.coalesce(~span, no))), F.transform("alternatives", lambda x: row(x, no, no)))))
    # Ids are digests, hardly two of them alike, so rows are dealt by id as they are.
    per = rows.repartition("id").groupBy("id", "domain").agg(F.count_if("own").alias("own"), F.count_if("bad").alias("bad"), F.count_if(~F.col("own")).alias("named"))
    ids = per.groupBy("id").agg(F.sum("own").alias("copies"), F.collect_list(F.struct("domain", "own", "bad", "named")).alias("by"))
    each = ids.select("copies", F.inline("by"))
    sums = each.groupBy("domain").agg(F.sum("own").alias("n"), F.sum(F.greatest(F.col("own") - 1, F.lit(0))).alias("repeated"), F.sum("bad").alias("bad_spans"), F.sum(F.when(F.col("copies") == 0, F.col("named")).otherwise(0)).alias("dangling"))
    return sums.where("n > 0")
