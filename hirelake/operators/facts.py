"""Facts from posting text by rule tables: salary, work authorization, remote work, away assignments,
geographic restriction and clearance.

Rules are arguments, compiled into constant patterns of one projection, so nothing is shuffled.  Segments of a body
stay in one array and are folded in order.  Patterns keep to what both Java's and RE2's syntax know.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_AMOUNT = "\\$?\\s?([0-9][0-9,]*(?:\\.[0-9]+)?)\\s?(k?)"
_RANGE = f"{_AMOUNT}\\s*(?:-|to|and)\\s*{_AMOUNT}(.{{0,40}})"
#: Pay patterns (name, priority, pattern): groups are minimum, its scale, maximum, its scale and what follows.
SALARY = (
    ("specific-role-range", 0, f"(?i)salary for this role is {_RANGE}"),
    ("usd-pay-range", 2, f"(?i)\\busd {_RANGE}"),
    ("standard-pay-range", 3, f"(?i)salary: {_RANGE}"),
    ("compensation-range", 4, f"(?i)compensation range: {_RANGE}"),
    ("separate-salary-bounds", 5, f"(?i)minimum salary: {_AMOUNT}\\.? maximum salary: {_AMOUNT}(.{{0,40}})"),
)
SUMMARY_PRIORITY, SUMMARY_NAME = 1, "summary-pay-range"
SUMMARY_HEADING, SUMMARY_RANGE, SECTION_RANGE = "(?i)^pay ranges?\\b", f"(?i)pay range: {_RANGE}", f"(?i)^[a-z ]{{0,30}}: {_RANGE}"
HOURLY, ANNUAL, ANNUAL_FROM = "(?i)per hour|hourly|/hr", "(?i)annual|per year|a year", 10_000
UNPARSEABLE = "(?i)salary depends on|not disclosed"


@dataclass(frozen=True)
class Sponsorship:
    result: str
    strength: str
    pattern: str
    unless: str | None = None


@dataclass(frozen=True)
class Eligibility:
    """``strength`` section follows the section; ``weak`` results give way to later ones."""

    result: str
    strength: str
    pattern: str
    country: str | None = None
    any_of: str | None = None
    unless: str | None = None
    conditional: str | None = None
    weak: bool = False


SECTIONS = (("preferred", "(?i)^preferred(?: qualifications| skills)?:?$"), ("required", "(?i)^(?:required|minimum)(?: qualifications| skills)?:?$"), ("mentioned", "(?i)^(?:about us|benefits|more)$"))
SPONSORSHIP = (
    Sponsorship("notAvailable", "strict", "(?i)unable to sponsor|sponsorship is not available|without (?:visa )?sponsorship", "(?i)\\bunless\\b"),
    Sponsorship("available", "none", "(?i)sponsorship is available|will sponsor"),
)
ELIGIBILITY = (
    Eligibility("exportControlled", "strict", "(?i)export control", None, weak=True),
    Eligibility("usCitizenOrPermanentResident", "section", "(?i)citizen or (?:lawful )?permanent resident", "US", conditional="(?i)\\bif\\b"),
    Eligibility("usCitizen", "section", "(?i)\\bcitizen(?:ship)?\\b", "US", any_of="(?i)u\\.s\\.|united states", unless="(?i)permanent resident|not required"),
    Eligibility("authorizedToWork", "section", "(?i)authorized to work", "US", any_of="(?i)united states|u\\.s\\."),
)
MOST_EVIDENCE = 6


@dataclass(frozen=True)
class Signal:
    category: str
    level: str
    reason: str
    pattern: str
    unless: str | None = None
    override: str | None = None
    override_level: str | None = None
    override_reason: str | None = None


REMOTE_NAMED, REMOTE_ROLE = "(?i)\\bremote\\b", "(?i)work remotely|fully remote"
HISTORICAL, CURRENT = "(?i)previous role|prior experience|in the past", "(?i)\\b(?:must|required|requires)\\b"
REMOTE = (
    Signal("office-presence", "strong", "Regular presence at an office is required", "(?i)report to the office|days a week in the office|on site every day"),
    Signal("office-visits", "questionable", "Office visits may be asked for", "(?i)office visits", None, "(?i)\\boptional\\b", "none", "Office visits are optional"),
    Signal("residence", "strong", "A residence near a site is required", "(?i)must (?:live|reside) (?:within|in)", "relocation is paid"),
    Signal("relocation", "questionable", "Relocation is mentioned", "(?i)relocation"),
)
TRAVEL = "(?i)travel (?:of |up to )?([0-9]{1,3})(?:-([0-9]{1,3}))?%"
#: Largest share of travel, category and level, in order.
BANDS = ((10, "travel-light", "informational"), (49, "travel-some", "questionable"), (100, "travel-heavy", "strong"))
FREQUENT = Signal("travel-frequent", "questionable", "Frequent travel is expected", "(?i)frequent travel|extensive travel")
MOST_REMOTE, MOST_AWAY = 4, 5

AWAY = (
    Signal("deployment", "strong", "Deployment is part of the work", "(?i)\\bdeployment\\b", "may be"),
    Signal("rotation", "strong", "Work goes by rotation", "(?i)rotational schedule|\\brotation\\b"),
    Signal("relocation", "questionable", "Relocation is asked for", "(?i)relocation (?:to|is required)"),
)
PRESENCE, DEFINITE, CONDITIONAL = "(?i)on site|overseas|deployment|rotational", "(?i)\\b(?:required|requires|must|will)\\b", "(?i)\\bmay be\\b"
DURATION = "(?i)\\b([0-9]+|one|two|three|four|six|eight|ten|twelve)[ -](day|week|month|year)s?\\b"
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "six": 6, "eight": 8, "ten": 10, "twelve": 12}
DAYS, LEAST_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}, 28
EXTENDED = Signal("extended-away", "strong", "A long stay away is required", "")
DESTINATIONS = (("Alaska", "(?i)\\balaska\\b"), ("Germany", "(?i)\\bgermany\\b"), ("Texas", "(?i)\\btexas\\b|\\btx\\b"), ("overseas", "(?i)\\boverseas\\b"))
NOWHERE = "an unstated place"

GEO = (
    Signal("state-residence", "", "", "(?i)must reside in [a-z]+", "(?i)\\bunless\\b"),
    Signal("near-site", "", "", "(?i)must live within [0-9]+ miles"),
    Signal("country", "", "", "(?i)located in the united states|hire for [a-z]+ in (?:united|france|germany)"),
)
SNIPPET = 340

#: Clearance levels in order of priority.
CLEARANCE = (("topSecretSCI", "(?i)top secret/sci|ts/sci"), ("topSecret", "(?i)top secret"), ("secret", "(?i)\\bsecret\\b"), ("publicTrust", "(?i)public trust"))
CLEARANCE_NEGATED, CLEARANCE_CONTEXT, POLYGRAPH = "(?i)no clearance (?:is )?(?:needed|required)", "(?i)clearance|secret|polygraph|public trust", "(?i)polygraph"
#: (result, pattern, unless), in order.
CLEARANCE_NEED = (("activeRequired", "(?i)\\bactive\\b", None), ("mustPossess", "(?i)clearance[^.]*required|must (?:have|possess)", "(?i)able to obtain"), ("mustObtain", "(?i)able to obtain", None))
#: Words that put what follows under a wish, and those that end it.
PREFERRED_MARK, RESET_MARK, LOOK_BACK = "preferred:", "required:", 220


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def cued(texts: Column, *patterns: str) -> Column:
    """The texts that match any of the patterns, by one search: others can't add to a fold over these patterns."""
    either = "(?i)" + "|".join(f"(?:{p.removeprefix('(?i)')})" for p in patterns)
    return F.filter(texts, lambda s: s.rlike(either))


def number(digits: Column, scale: Column) -> Column:
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * F.when(F.lower(scale) == "k", 1000.0).otherwise(1.0)


def pay(text: Column, name: str, priority: int, pattern: str) -> Column:
    """struct(priority, status, period, minimum, maximum, dollar) of the first match, or null.

    The text is searched once; the groups are read from what matched.
    """

    def row(m: Column) -> Column:
        g = [F.regexp_extract(m, pattern, k) for k in range(5)]
        low, high = number(g[1], g[2]), number(g[3], g[4])
        hourly, annual = m.rlike(HOURLY), m.rlike(ANNUAL) | (high >= ANNUAL_FROM)
        status = F.when(hourly, "hourly-unconverted").when(annual, name).otherwise("ambiguous-period")
        period = F.when(hourly, "hourly").when(annual, "annual").otherwise("unknown")
        return F.when(m != "", F.struct(F.lit(priority).alias("priority"), status.alias("status"), period.alias("period"), low.alias("minimum"), high.alias("maximum"), m.contains("$").alias("dollar")))

    return bound(F.regexp_extract(text, pattern, 0), row)


def salary(body: Column, lines: Column, rules=SALARY) -> Column:
    """struct(minimum, maximum, period, status) of a body: the family of least priority wins.

    Ranges under a summary heading, in it or on the lines that follow it without a gap, are one family: their
    least and largest bounds, unless their periods differ.
    """
    flat = F.array_compact(F.array(*[pay(body, *r) for r in rules]))
    kind = F.coalesce(pay(F.lit("x"), SUMMARY_NAME, SUMMARY_PRIORITY, SUMMARY_RANGE), F.lit(None))
    none = F.filter(F.array(kind), lambda x: F.lit(False))

    def read(line: Column) -> Column:
        heading = line.rlike(SUMMARY_HEADING)
        row = F.when(heading, pay(line, SUMMARY_NAME, SUMMARY_PRIORITY, SUMMARY_RANGE)).otherwise(pay(line, SUMMARY_NAME, SUMMARY_PRIORITY, SECTION_RANGE))
        return F.struct(heading.alias("heading"), row.alias("row"))

    def step(acc: Column, x: Column) -> Column:
        counts = (x["heading"] | acc["inside"]) & x["row"].isNotNull()
        return F.struct((x["heading"] | counts).alias("inside"), F.when(counts, F.concat(acc["rows"], F.array(x["row"]))).otherwise(acc["rows"]).alias("rows"))

    lines = F.transform(lines, read)
    found = F.aggregate(lines, F.struct(F.lit(False).alias("inside"), none.alias("rows")), step, lambda acc: acc["rows"])
    fine = F.filter(found, lambda r: r["dollar"] | (r["period"] != "unknown") | (r["maximum"] >= ANNUAL_FROM))
    periods = lambda rows: F.size(F.array_distinct(F.transform(rows, lambda r: r["period"])))
    out = lambda low, high, period, status: F.struct(low.cast("double").alias("minimum"), high.cast("double").alias("maximum"), period.alias("period"), status.alias("status"))
    null, unknown = F.lit(None), F.lit("unknown")

    def chosen(both: Column) -> Column:
        flat, rows = both["flat"], both["rows"]
        first = F.try_element_at(flat, F.lit(1))
        several = F.size(rows) > 1
        status = F.when(~several, rows[0]["status"]).when(rows[0]["period"] == "hourly", "hourly-unconverted-summary-aggregate").when(rows[0]["period"] == "unknown", "ambiguous-period-summary-aggregate").otherwise("summary-pay-range-aggregate")
        low, high = F.array_min(F.transform(rows, lambda r: r["minimum"])), F.array_max(F.transform(rows, lambda r: r["maximum"]))
        summary = F.when(periods(rows) > 1, out(null, null, unknown, F.lit("ambiguous-mixed-periods"))).otherwise(out(low, high, rows[0]["period"], status))
        empty = F.when(F.trim(body) == "", "description-unavailable").when(body.rlike(UNPARSEABLE), "unparseable").otherwise("not-found")
        flat_first = F.when(first.isNotNull(), out(first["minimum"], first["maximum"], first["period"], first["status"]))
        before = first.isNotNull() & (first["priority"] < SUMMARY_PRIORITY)
        return F.when(before, flat_first).when(F.size(rows) > 0, summary).when(first.isNotNull(), flat_first).otherwise(out(null, null, unknown, empty))

    return bound(F.struct(flat.alias("flat"), fine.alias("rows")), chosen)


def first_name(text: Column, table, none=None) -> Column:
    """The first entry's name whose pattern matches."""
    return F.coalesce(*[F.when(text.rlike(row[-1]), F.lit(row[0])) for row in table], F.lit(none).cast("string"))


def work_authorization(segments: Column) -> Column:
    """struct(eligibility, sponsorship, strength, sponsorship_strength, country, evidence, status), by an ordered fold.

    A segment that is a section's heading changes the section.  Every sponsorship rule of a segment counts, the last
    decides; of the eligibility rules the first that holds does, and only over weak results.
    """
    empty = F.expr("cast(array() as array<string>)")
    text = lambda x: F.lit(x).cast("string")
    start = F.struct(F.lit("mentioned").alias("section"), text("noneSpecified").alias("eligibility"), text("noneSpecified").alias("sponsorship"), text("none").alias("strength"), text("none").alias("sponsorship_strength"), text(None).alias("country"), empty.alias("evidence"))

    def held(rule, s: Column) -> Column:
        c = s.rlike(rule.pattern)
        if rule.unless:
            c = c & ~s.rlike(rule.unless)
        if getattr(rule, "any_of", None):
            c = c & s.rlike(rule.any_of)
        return c

    def read(s: Column) -> Column:
        asked = [F.when(held(r, s), F.struct(F.lit(r.result).alias("r"), F.lit(r.strength).alias("s"))) for r in reversed(SPONSORSHIP)]
        rows = []
        for r in ELIGIBILITY:
            strength = F.when(s.rlike(r.conditional), "conditional").otherwise(r.strength) if r.conditional else F.lit(r.strength)
            rows.append(F.when(held(r, s), F.struct(F.lit(r.result).alias("r"), strength.alias("s"), text(r.country).alias("c"), F.lit(r.weak).alias("w"))))
        return F.struct(s.alias("s"), first_name(s, SECTIONS).alias("section"), F.coalesce(*asked).alias("asked"), F.coalesce(*rows).alias("mine"))

    def step(acc: Column, x: Column) -> Column:
        mine, asked, section = x["mine"], x["asked"], x["section"]
        weak = [r.result for r in ELIGIBILITY if r.weak]
        strength = F.when(mine["s"] == "section", F.when(acc["section"] == "preferred", "preferred").otherwise("strict")).otherwise(mine["s"])
        takes = mine.isNotNull() & F.when(mine["w"], acc["eligibility"] == "noneSpecified").otherwise(acc["eligibility"].isin("noneSpecified", *weak))
        free, says = section.isNull(), asked.isNotNull()
        keep = lambda name, value, when: F.when(free & when, value).otherwise(acc[name]).alias(name)
        return F.struct(
            F.coalesce(section, acc["section"]).alias("section"), keep("eligibility", mine["r"], takes), keep("sponsorship", asked["r"], says),
            keep("strength", strength, takes), keep("sponsorship_strength", asked["s"], says), keep("country", F.coalesce(mine["c"], acc["country"]), takes),
            keep("evidence", F.array_distinct(F.concat(acc["evidence"], F.array(x["s"]))), says | takes),
        )

    def end(acc: Column) -> Column:
        nothing = (acc["eligibility"] == "noneSpecified") & (acc["sponsorship"] == "noneSpecified")
        status = F.when(nothing, "not-mentioned").when(acc["strength"].isin("strict", "preferred") | (acc["sponsorship_strength"] == "strict"), "parsed").otherwise("review")
        return F.struct(*[acc[c].alias(c) for c in ("eligibility", "sponsorship", "strength", "sponsorship_strength", "country")], F.slice(acc["evidence"], 1, MOST_EVIDENCE).alias("evidence"), status.alias("status"))

    spoken = cued(segments, *[p for _, p in SECTIONS], *[r.pattern for r in (*SPONSORSHIP, *ELIGIBILITY)])
    return F.aggregate(F.transform(spoken, read), start, step, end)


def clean_sentence(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "^[ .;]+", ""), "[ .;]+$", "")


def _row(s: Column, category, level, reason) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(category).alias("category"), lit(level).alias("level"), lit(reason).alias("reason"), s.alias("evidence"))


def _signal(s: Column, r: Signal) -> Column:
    hit = s.rlike(r.pattern)
    if r.unless:
        hit = hit & ~F.lower(s).contains(r.unless.lower())
    row = _row(s, r.category, r.level, r.reason)
    if r.override:
        row = F.when(s.rlike(r.override), _row(s, r.category, r.override_level, r.override_reason)).otherwise(row)
    return F.when(hit, row)


def historical(s: Column) -> Column:
    return s.rlike(HISTORICAL) & ~s.rlike(CURRENT)


def top_signals(signals: Column, most: int) -> Column:
    """Distinct by category and evidence, strong ones first, then by category and place."""
    placed = F.transform(signals, lambda r, i: F.struct((r["level"] != "strong").alias("after"), r["category"].alias("category"), i.alias("i"), r.alias("r")))
    once = lambda rows: F.filter(rows, lambda p: ~F.exists(rows, lambda q: (q["i"] < p["i"]) & (q["r"]["category"] == p["r"]["category"]) & (q["r"]["evidence"] == p["r"]["evidence"])))
    return bound(placed, lambda rows: F.transform(F.slice(F.array_sort(once(rows)), 1, most), lambda p: p["r"]))


def remote_named(metadata: Column, body: Column) -> Column:
    """Whether a posting's title, place or body calls it remote."""
    return metadata.rlike(REMOTE_NAMED) | body.rlike(REMOTE_ROLE)


def remote_work(metadata: Column, body: Column, sentences: Column) -> Column:
    """struct(is_remote, level, summary, categories, status)."""

    def travel(s: Column) -> Column:
        low = F.transform(F.regexp_extract_all(s, F.lit(TRAVEL), F.lit(1)), lambda x: x.cast("int"))
        high = F.transform(F.regexp_extract_all(s, F.lit(TRAVEL), F.lit(2)), lambda x: F.when(x != "", x.cast("int")))
        both = F.filter(F.zip_with(low, high, lambda a, b: F.struct(a.alias("a"), F.coalesce(b, a).alias("b"))), lambda p: (p["a"] <= 100) & (p["b"] <= 100) & (p["b"] >= p["a"]))
        band = lambda p, k: F.coalesce(*[F.when(p["b"] <= most, F.lit((category, level)[k])) for most, category, level in BANDS])
        share = lambda p: F.when(p["a"] == p["b"], F.concat(p["b"].cast("string"), F.lit("%"))).otherwise(F.concat(p["a"].cast("string"), F.lit("-"), p["b"].cast("string"), F.lit("%")))
        return F.transform(both, lambda p: _row(s, band(p, 0), band(p, 1), F.concat(F.lit("Travel of "), share(p))))

    def signals(s: Column) -> Column:
        own = F.array_compact(F.array(*[_signal(s, r) for r in REMOTE]))
        return F.concat(own, travel(s), F.array_compact(F.array(_signal(s, FREQUENT))))

    is_remote = remote_named(metadata, body)
    now = F.filter(cued(sentences, *[r.pattern for r in REMOTE], TRAVEL, FREQUENT.pattern), lambda s: ~historical(s))
    top = top_signals(F.flatten(F.transform(now, signals)), MOST_REMOTE)

    def summed(both: Column) -> Column:
        top, is_remote = both["top"], both["is_remote"]
        has = lambda level: F.exists(top, lambda r: r["level"] == level)
        reasons = F.slice(F.array_distinct(F.transform(top, lambda r: r["reason"])), 1, 2)
        level = F.when(~is_remote, "none").when(has("strong"), "strong").when(has("questionable"), "questionable").otherwise("none")
        status = F.when(~is_remote, "not-remote-designated").when(F.trim(body) == "", "description-unavailable").when(F.size(top) > 0, "parsed").otherwise("no-concern-detected")
        said = is_remote & (F.size(top) > 0)
        return F.struct(is_remote.alias("is_remote"), level.alias("level"), F.when(said, F.concat(F.array_join(reasons, "; "), F.lit("."))).alias("summary"), F.when(said, F.array_join(F.transform(top, lambda r: r["category"]), ",")).otherwise("").alias("categories"), status.alias("status"))

    return bound(F.struct(top.alias("top"), is_remote.alias("is_remote")), summed)


def stay_days(s: Column) -> Column:
    """The longest duration of a sentence in days, or null."""
    found = F.regexp_extract_all(s, F.lit(DURATION), F.lit(1))
    unit = F.regexp_extract_all(s, F.lit(DURATION), F.lit(2))
    named = lambda x, table: F.coalesce(*[F.when(F.lower(x) == k, F.lit(v)) for k, v in table.items()])
    count = lambda n: F.coalesce(named(n, NUMBERS), F.when(n.rlike("^[0-9]{1,5}$"), n.cast("int")))
    return F.array_max(F.zip_with(found, unit, lambda n, u: count(n) * named(u, DAYS)))


def away_requirements(title: Column, location: Column, body: Column, sentences: Column) -> Column:
    """struct(confidence, destination, days, categories, status) of a posting; the title counts as a sentence.

    A stay of LEAST_DAYS or more in a sentence that speaks of presence and duty is a signal of its own.  The
    destination comes from the first signal, the title, the location or the body, in this order.
    """
    long_stay = lambda s: s.rlike(PRESENCE) & s.rlike(DEFINITE) & (~s.rlike(CONDITIONAL) | s.rlike(CURRENT)) & (F.coalesce(stay_days(s), F.lit(0)) >= LEAST_DAYS)
    signals = lambda s: F.array_compact(F.array(F.when(long_stay(s), _row(s, EXTENDED.category, EXTENDED.level, EXTENDED.reason)), *[_signal(s, r) for r in AWAY]))
    now = F.filter(cued(F.concat(F.array(title), sentences), PRESENCE, *[r.pattern for r in AWAY]), lambda s: ~historical(s))
    top = top_signals(F.flatten(F.transform(now, signals)), MOST_AWAY)
    place = lambda x: first_name(x, DESTINATIONS)

    def summed(top: Column) -> Column:
        level = F.when(F.exists(top, lambda r: r["level"] == "strong"), "strong").when(F.size(top) > 0, "questionable").otherwise("none")
        first = F.try_element_at(top, F.lit(1))["evidence"]
        where = F.when(F.size(top) > 0, F.coalesce(place(first), place(title), place(location), place(body), F.lit(NOWHERE)))
        status = F.when(F.trim(body) == "", "description-unavailable").when(F.size(top) > 0, "parsed").otherwise("no-requirement-detected")
        days = F.array_max(F.transform(F.filter(top, lambda r: r["category"] == EXTENDED.category), lambda r: stay_days(r["evidence"])))
        return F.struct(level.alias("confidence"), where.alias("destination"), days.alias("days"), F.array_join(F.transform(top, lambda r: r["category"]), ",").alias("categories"), status.alias("status"))

    return F.transform(F.array(top), summed)[0]


def geo_restriction(sentences: Column, rules=GEO) -> Column:
    """struct(category, snippet) of the first rule by priority, then by sentence, that no guard undoes; or null."""

    def hits(r: Signal) -> Column:
        good = F.filter(sentences, lambda s: s.rlike(r.pattern) & (~s.rlike(r.unless) if r.unless else F.lit(True)))
        return F.transform(F.slice(good, 1, 1), lambda s: F.struct(F.lit(r.category).alias("category"), F.substring(s, 1, SNIPPET).alias("snippet")))

    return F.try_element_at(F.concat(*[hits(r) for r in rules]), F.lit(1))


def last_place(text: Column, mark: str) -> Column:
    """The last place of a mark in lower-cased text, from 1; 0 without one."""
    back = F.instr(F.reverse(F.lower(text)), mark[::-1])
    return F.when(back > 0, F.length(text) - back - len(mark) + 2).otherwise(0)


def clearance(body: Column) -> Column:
    """struct(level, requirement, polygraph, status).

    Negated phrases go first.  Levels are tried in order; a mention under a preferred mark (within LOOK_BACK characters,
    no reset after it) counts only if no level has a mention elsewhere, and then as preferred.
    """
    return bound(F.regexp_replace(body, CLEARANCE_NEGATED, " "), lambda text: _clearance(text, body))


def _clearance(text: Column, body: Column) -> Column:
    def mentions(pattern: str) -> Column:
        # What stands before each match, by splitting; rebuilt as the text up to the match.
        hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gap = F.split(text, pattern, -1)
        start = F.struct(F.lit("").alias("text"), F.expr("cast(array() as array<string>)").alias("before"))
        step = lambda acc, x: F.struct(F.concat(acc["text"], x["g"], x["h"]).alias("text"), F.concat(acc["before"], F.array(F.concat(acc["text"], x["g"]))).alias("before"))
        pairs = F.filter(F.arrays_zip(gap.alias("g"), hit.alias("h")), lambda x: x["h"].isNotNull())
        return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["before"])).otherwise(F.expr("cast(array() as array<string>)"))

    def wished(before: Column) -> Column:
        near = F.right(before, F.lit(LOOK_BACK))
        preferred = last_place(near, PREFERRED_MARK)
        return (preferred > 0) & (preferred > last_place(near, RESET_MARK))

    free_of = lambda m: F.exists(m, lambda b: ~wished(b))
    named = F.array(*[bound(mentions(p), lambda m: F.struct((F.size(m) > 0).alias("any"), free_of(m).alias("free"))) for _, p in CLEARANCE])

    def judged(x: Column) -> Column:
        named, sentences = x["named"], x["sentences"]
        free = F.coalesce(*[F.when(named[k]["free"], F.lit(level)) for k, (level, _) in enumerate(CLEARANCE)])
        any_level = F.coalesce(*[F.when(named[k]["any"], F.lit(level)) for k, (level, _) in enumerate(CLEARANCE)])
        level = F.coalesce(free, any_level, F.when(x["polygraph"], "other"), F.lit("noneMentioned"))
        context = F.when(F.size(sentences) > 0, F.array_join(sentences, " ")).otherwise(text)
        need = reduce(lambda c, r: c.when(context.rlike(r[1]) & (~context.rlike(r[2]) if r[2] else F.lit(True)), r[0]), CLEARANCE_NEED, F.when(level == "noneMentioned", "none").when(free.isNull() & any_level.isNotNull(), "preferred")).otherwise("ambiguous")
        return F.struct(level.alias("level"), need.alias("requirement"), x["polygraph"].alias("polygraph"))

    sentences = F.filter(F.split(text, "(?<=[.!?])\\s+(?=[A-Z#*])"), lambda s: s.rlike(CLEARANCE_CONTEXT))
    found = bound(F.struct(named.alias("named"), sentences.alias("sentences"), text.rlike(POLYGRAPH).alias("polygraph")), judged)
    status = lambda r: F.when(F.trim(body) == "", "description-unavailable").when(r["level"] == "noneMentioned", "not-mentioned").when((r["level"] == "other") | (r["requirement"] == "ambiguous"), "ambiguous").otherwise("parsed")
    return bound(found, lambda r: F.struct(r["level"].alias("level"), r["requirement"].alias("requirement"), r["polygraph"].alias("polygraph"), status(r).alias("status")))


#: Degrees with their ranks, from the highest; fields of study; words that tell a wish from a duty.
DEGREES = (("doctorate", 5, "(?i)\\bph\\.?d|\\bdoctorate\\b"), ("master", 4, "(?i)\\bmaster'?s?\\b"), ("bachelor", 3, "(?i)\\bbachelor'?s?\\b"), ("associate", 2, "(?i)\\bassociate degree"), ("highSchool", 1, "(?i)high school|\\bged\\b"))
FIELDS = (("computer science", "(?i)computer science"), ("engineering", "(?i)\\bengineering\\b"), ("mathematics", "(?i)\\bmathematics\\b"), ("technical", "(?i)technical field"))
DEGREE_SECTIONS = (("preferred", "(?i)^preferred(?: qualifications| skills)?:?$"), ("required", "(?i)^(?:required|minimum)(?: qualifications| skills)?:?$"))
WISH, DUTY, BRANCH, YEARS = "(?i)preferred|\\ba plus\\b|desired", "(?i)required|\\bmust\\b", ", or ", "([0-9]+)\\+? years"


def degree_requirements(segments: Column) -> Column:
    """struct(minimum_level, requirement, preferred_levels, years, paths) of a body, or null without a degree.

    A section's heading sets what its segments mean, unless their own words do.  Each branch of a segment gives a path
    for each degree that it names, with the years and fields beside it.  The minimum is the lowest level that isn't a
    mere wish, else the lowest one; the requirement is the strongest of any path; the years are the least of the
    minimum level's paths.
    """
    empty = F.expr("cast(array() as array<struct<rank:int,level:string,requirement:string,years:int,fields:string>>)")

    def paths(s: Column, section: Column) -> Column:
        def branch(b: Column) -> Column:
            need = F.when(b.rlike(WISH), "preferred").when(b.rlike(DUTY), "required").otherwise(section)
            years = F.regexp_extract(b, YEARS, 1).try_cast("int")
            fields = F.array_join(F.array_compact(F.array(*[F.when(b.rlike(p), n) for n, p in FIELDS])), "+")
            return F.array_compact(F.array(*[F.when(b.rlike(p), F.struct(F.lit(r).alias("rank"), F.lit(n).alias("level"), need.alias("requirement"), years.alias("years"), fields.alias("fields"))) for n, r, p in DEGREES]))

        return F.flatten(F.transform(F.split(s, BRANCH), branch))

    read = lambda s: F.struct(first_name(s, DEGREE_SECTIONS).alias("section"), paths(s, F.lit(None).cast("string")).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        own = F.transform(x["rows"], lambda r: F.struct(r["rank"].alias("rank"), r["level"].alias("level"), F.coalesce(r["requirement"], acc["section"]).alias("requirement"), r["years"].alias("years"), r["fields"].alias("fields")))
        return F.struct(F.coalesce(x["section"], acc["section"]).alias("section"), F.when(x["section"].isNull(), F.concat(acc["rows"], own)).otherwise(acc["rows"]).alias("rows"))

    spoken = cued(segments, *[p for _, p in DEGREE_SECTIONS], *[p for *_, p in DEGREES])
    said = F.filter(F.transform(spoken, read), lambda x: x["section"].isNotNull() | (F.size(x["rows"]) > 0))
    found = F.aggregate(said, F.struct(F.lit("stated").alias("section"), empty.alias("rows")), step, lambda acc: F.array_distinct(acc["rows"]))

    def reduced(rows: Column) -> Column:
        firm = F.filter(rows, lambda r: r["requirement"] != "preferred")
        least = F.array_min(F.transform(F.when(F.size(firm) > 0, firm).otherwise(rows), lambda r: r["rank"]))
        own = F.filter(F.when(F.size(firm) > 0, firm).otherwise(rows), lambda r: r["rank"] == least)
        has = lambda need: F.exists(rows, lambda r: r["requirement"] == need)
        need = F.when(has("required"), "required").when(has("stated"), "stated").otherwise("preferred")
        wished = F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda r: r["requirement"] == "preferred"), lambda r: r["level"])))
        text = F.transform(rows, lambda r: F.concat_ws("/", r["level"], r["requirement"], F.coalesce(r["years"].cast("string"), F.lit("")), r["fields"]))
        return F.when(F.size(rows) > 0, F.struct(own[0]["level"].alias("minimum_level"), need.alias("requirement"), F.array_join(wished, ",").alias("preferred_levels"), F.array_min(F.transform(own, lambda r: r["years"])).alias("years"), F.array_join(F.array_sort(text), ";").alias("paths")))

    return F.transform(F.array(found), reduced)[0]
