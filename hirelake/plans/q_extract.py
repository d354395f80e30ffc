"""Queries of fact extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import extract as E
from hirelake.operators import facts as X
from hirelake.operators import rules as R

from .fixtures import POSTINGS_SQL, postings
from .q_rules import bodies
from .q_text import BODY, sql_lines
from .registry import query

LINES = f"WITH postings AS ({POSTINGS_SQL}), ll AS (SELECT posting_no, {sql_lines('html')} AS ls FROM postings), lines AS (SELECT posting_no, unnest(range(len(ls)))::INT AS line_no, unnest(ls) AS line FROM ll)"


def lines(spark, sf):
    return postings(spark, sf).select("posting_no", F.posexplode(T.html_to_lines(F.col("html"))).alias("line_no", "line"))


def first_sql(x: str, table, none: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{row[-1].replace(chr(39), chr(39) * 2)}') THEN '{row[0]}'" for row in table) + f" ELSE {none} END"


SEGMENTS = BODY + f""", sl AS (SELECT *, {sql_lines('html')} AS ls FROM bodies),
sg AS (SELECT * EXCLUDE (ls), ls, list_filter(list_transform(flatten(list_transform(ls, lambda l: string_split(regexp_replace(l, '([.!?])\\s+([A-Z#*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)))), lambda z: regexp_replace(regexp_replace(z, '^[ .;]+', ''), '[ .;]+$', '')), lambda z: z <> '') AS ss FROM sl)"""


def sentences_of(lines):
    return F.filter(F.transform(F.flatten(F.transform(lines, T.split_sentences)), X.clean_sentence), lambda z: z != "")


def texts(spark, sf):
    """Postings with their body and its lines."""
    b = T.once(postings(spark, sf).select("posting_no", "title", "primary_location", "html"), body=T.html_to_text(F.col("html")), lines=T.html_to_lines(F.col("html")))
    return b.drop("html")


def segmented(spark, sf):
    """Postings with their body, its lines and its sentences."""
    return T.once(texts(spark, sf), sentences=sentences_of(F.col("lines")))


def quoted(p: str) -> str:
    return p.replace("'", "''")


def pay_sql(x: str, name: str, priority: int, pattern: str) -> str:
    p = quoted(pattern)
    n = lambda a, b: f"(TRY_CAST(replace(regexp_extract({x}, '{p}', {a}), ',', '') AS DOUBLE) * CASE WHEN lower(regexp_extract({x}, '{p}', {b})) = 'k' THEN 1000 ELSE 1 END)"
    return f"{priority} AS pr, '{name}' AS name, regexp_extract({x}, '{p}', 0) AS m, {n(1, 2)} AS low, {n(3, 4)} AS high"


PAY = SEGMENTS + f""", lx AS (SELECT posting_no, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM sg),
lf AS (SELECT *, regexp_matches(line, '{X.SUMMARY_HEADING}') AS h, regexp_matches(line, '{X.SECTION_RANGE}') AS g FROM lx),
li AS (SELECT *, coalesce(last_value(CASE WHEN h THEN 1 WHEN NOT g THEN 0 END IGNORE NULLS) OVER (PARTITION BY posting_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM lf),
raw AS ({" UNION ALL ".join(f"SELECT posting_no, -1 AS i, {pay_sql('body', *r)} FROM sg WHERE regexp_matches(body, '{quoted(r[2])}')" for r in X.SALARY)}
UNION ALL SELECT posting_no, i, {pay_sql('line', X.SUMMARY_NAME, X.SUMMARY_PRIORITY, X.SUMMARY_RANGE)} FROM li WHERE h AND regexp_matches(line, '{X.SUMMARY_RANGE}')
UNION ALL SELECT posting_no, i, {pay_sql('line', X.SUMMARY_NAME, X.SUMMARY_PRIORITY, X.SECTION_RANGE)} FROM li WHERE NOT h AND inside AND g),
one AS (SELECT *, CASE WHEN regexp_matches(m, '{X.HOURLY}') THEN 'hourly' WHEN regexp_matches(m, '{X.ANNUAL}') OR high >= {X.ANNUAL_FROM} THEN 'annual' ELSE 'unknown' END AS period FROM raw),
st AS (SELECT *, CASE period WHEN 'hourly' THEN 'hourly-unconverted' WHEN 'annual' THEN name ELSE 'ambiguous-period' END AS status FROM one WHERE pr <> 1 OR contains(m, '$') OR period <> 'unknown' OR high >= {X.ANNUAL_FROM}),
best AS (SELECT posting_no, min(pr) AS pr FROM st GROUP BY 1), fam AS (SELECT st.* FROM st JOIN best USING (posting_no, pr)),
pick AS (SELECT posting_no, CASE WHEN count(DISTINCT period) > 1 THEN NULL ELSE min(low) END AS minimum, CASE WHEN count(DISTINCT period) > 1 THEN NULL ELSE max(high) END AS maximum, CASE WHEN count(DISTINCT period) > 1 THEN 'unknown' ELSE min(period) END AS period,
  CASE WHEN count(DISTINCT period) > 1 THEN 'ambiguous-mixed-periods' WHEN count(*) = 1 THEN min(status) WHEN min(period) = 'hourly' THEN 'hourly-unconverted-summary-aggregate' WHEN min(period) = 'unknown' THEN 'ambiguous-period-summary-aggregate' ELSE 'summary-pay-range-aggregate' END AS status FROM fam GROUP BY 1),
salaries AS (SELECT sg.posting_no, minimum, maximum, coalesce(period, 'unknown') AS period, coalesce(status, CASE WHEN trim(body) = '' THEN 'description-unavailable' WHEN regexp_matches(body, '{X.UNPARSEABLE}') THEN 'unparseable' ELSE 'not-found' END) AS status FROM sg LEFT JOIN pick USING (posting_no))"""


def salaries(spark, sf):
    return segmented(spark, sf).select("posting_no", X.salary(F.col("body"), F.col("lines")).alias("s")).select("posting_no", "s.*")


@query(PAY + " SELECT * FROM salaries")
def extract_salary(spark, sf):
    return salaries(spark, sf)


def before_sql(pattern: str) -> str:
    """What stands before each match of a pattern in t."""
    g, h = f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}')"
    return f"list_transform(range(1, len({h}) + 1), lambda i: array_to_string(list_transform(range(1, i + 1), lambda j: {g}[j] || CASE WHEN j < i THEN {h}[j] ELSE '' END), ''))"


def mark_sql(x: str, mark: str) -> str:
    n = f"instr(reverse(lower({x})), '{mark[::-1]}')"
    return f"CASE WHEN {n} > 0 THEN length({x}) - {n} - {len(mark)} + 2 ELSE 0 END"


def _wished(b: str) -> str:
    near = f"right({b}, {X.LOOK_BACK})"
    return f"({mark_sql(near, X.PREFERRED_MARK)} > 0 AND {mark_sql(near, X.PREFERRED_MARK)} > {mark_sql(near, X.RESET_MARK)})"


CLEARED = BODY + f""", t AS (SELECT posting_no, body, regexp_replace(body, '{X.CLEARANCE_NEGATED}', ' ', 'g') AS t FROM bodies),
b AS (SELECT *, {", ".join(f"{before_sql(p)} AS b_{n}" for n, p in X.CLEARANCE)} FROM t),
l AS (SELECT *, CASE {" ".join(f"WHEN len(list_filter(b_{n}, lambda b: NOT {_wished('b')})) > 0 THEN '{n}'" for n, _ in X.CLEARANCE)} END AS free, CASE {" ".join(f"WHEN len(b_{n}) > 0 THEN '{n}'" for n, _ in X.CLEARANCE)} END AS anyl, regexp_matches(t, '{X.POLYGRAPH}') AS polygraph,
  list_filter(string_split(regexp_replace(t, '([.!?])\\s+([A-Z#*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda z: regexp_matches(z, '{X.CLEARANCE_CONTEXT}')) AS rel FROM b),
c AS (SELECT *, coalesce(free, anyl, CASE WHEN polygraph THEN 'other' END, 'noneMentioned') AS level, CASE WHEN len(rel) > 0 THEN array_to_string(rel, ' ') ELSE t END AS ctx FROM l),
n AS (SELECT *, CASE WHEN level = 'noneMentioned' THEN 'none' WHEN free IS NULL AND anyl IS NOT NULL THEN 'preferred' {" ".join(f"WHEN regexp_matches(ctx, '{p}')" + (f" AND NOT regexp_matches(ctx, '{u}')" if u else "") + f" THEN '{r}'" for r, p, u in X.CLEARANCE_NEED)} ELSE 'ambiguous' END AS requirement FROM c),
cleared AS (SELECT posting_no, level, requirement, polygraph, CASE WHEN trim(body) = '' THEN 'description-unavailable' WHEN level = 'noneMentioned' THEN 'not-mentioned' WHEN level = 'other' OR requirement = 'ambiguous' THEN 'ambiguous' ELSE 'parsed' END AS status FROM n)"""


def clearances(spark, sf):
    return bodies(spark, sf).select("posting_no", X.clearance(F.col("body")).alias("c")).select("posting_no", "c.*")


@query(CLEARED + " SELECT * FROM cleared")
def extract_clearance(spark, sf):
    return clearances(spark, sf)


DEGREED = SEGMENTS + f""", x AS (SELECT posting_no, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM sg), z AS (SELECT *, {first_sql('s', X.DEGREE_SECTIONS)} AS head FROM x),
y AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY posting_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'stated') AS section FROM z), br AS (SELECT posting_no, section, unnest(string_split(s, '{X.BRANCH}')) AS b FROM y WHERE head IS NULL),
bf AS (SELECT *, CASE WHEN regexp_matches(b, '{X.WISH}') THEN 'preferred' WHEN regexp_matches(b, '{X.DUTY}') THEN 'required' ELSE section END AS requirement, TRY_CAST(regexp_extract(b, '{X.YEARS}', 1) AS INT) AS years,
  array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(b, '{p}') THEN '{n}' END" for n, p in X.FIELDS)}], lambda z: z IS NOT NULL), '+') AS fields FROM br),
pa AS ({" UNION ".join(f"SELECT posting_no, {r} AS rnk, '{n}' AS level, requirement, years, fields FROM bf WHERE regexp_matches(b, '{quoted(p)}')" for n, r, p in X.DEGREES)}),
mn AS (SELECT posting_no, coalesce(min(rnk) FILTER (requirement <> 'preferred'), min(rnk)) AS least, bool_or(requirement <> 'preferred') AS firm FROM pa GROUP BY 1),
degrees AS (SELECT posting_no, min(level) FILTER (rnk = least) AS minimum_level, CASE WHEN bool_or(requirement = 'required') THEN 'required' WHEN bool_or(requirement = 'stated') THEN 'stated' ELSE 'preferred' END AS requirement,
  coalesce(array_to_string(list_sort(list(DISTINCT level) FILTER (requirement = 'preferred')), ','), '') AS preferred_levels, min(years) FILTER (rnk = least AND (NOT firm OR requirement <> 'preferred')) AS years,
  array_to_string(list_sort(list(level || '/' || requirement || '/' || coalesce(years::VARCHAR, '') || '/' || fields)), ';') AS paths FROM pa JOIN mn USING (posting_no) GROUP BY 1)"""


def degree_facts(spark, sf):
    # Of an array of one or none, so that no filter repeats the extraction.
    d = X.degree_requirements(F.col("sentences"))
    return segmented(spark, sf).select("posting_no", F.inline(F.array_compact(F.array(d))))


@query(DEGREED + " SELECT * FROM degrees")
def extract_degree_requirements(spark, sf):
    return degree_facts(spark, sf)


def _held(r, x: str = "s") -> str:
    c = [f"regexp_matches({x}, '{quoted(r.pattern)}')"]
    if r.unless:
        c.append(f"NOT regexp_matches({x}, '{quoted(r.unless)}')")
    if getattr(r, "any_of", None):
        c.append(f"regexp_matches({x}, '{quoted(r.any_of)}')")
    return " AND ".join(c)


_STRENGTH = "CASE WHEN section = 'preferred' THEN 'preferred' ELSE 'strict' END"


def _eligible(k: int, r) -> str:
    strength = _STRENGTH if r.strength == "section" else f"'{r.strength}'"
    if r.conditional:
        strength = f"CASE WHEN regexp_matches(s, '{r.conditional}') THEN 'conditional' ELSE {strength} END"
    country = f"'{r.country}'" if r.country else "NULL"
    return f"SELECT posting_no, i, s, {k} AS k, '{r.result}' AS result, {strength} AS strength, {country} AS country, {str(r.weak).lower()} AS weak FROM q WHERE {_held(r)}"


AUTHORIZED = SEGMENTS + f""", x AS (SELECT posting_no, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM sg), z AS (SELECT *, {first_sql('s', X.SECTIONS)} AS head FROM x),
y AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY posting_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'mentioned') AS section FROM z), q AS (SELECT * FROM y WHERE head IS NULL),
sp AS ({" UNION ALL ".join(f"SELECT posting_no, i, s, {k} AS k, '{r.result}' AS result, '{r.strength}' AS strength FROM q WHERE {_held(r)}" for k, r in enumerate(X.SPONSORSHIP))}),
el AS ({" UNION ALL ".join(_eligible(k, r) for k, r in enumerate(X.ELIGIBILITY))}), el1 AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY posting_no, i ORDER BY k) = 1),
ef AS (SELECT *, row_number() OVER (PARTITION BY posting_no ORDER BY weak, i) AS r, row_number() OVER (PARTITION BY posting_no, weak ORDER BY i) AS rw, min(i) FILTER (NOT weak) OVER (PARTITION BY posting_no) AS firm FROM el1),
el2 AS (SELECT * FROM ef WHERE rw = 1 AND (NOT weak OR firm IS NULL OR i < firm)), e AS (SELECT posting_no, arg_max(result, i) AS eligibility, arg_max(strength, i) AS strength, max(country) AS country FROM el2 GROUP BY 1),
sl2 AS (SELECT posting_no, arg_max(result, (i, k)) AS sponsorship, arg_max(strength, (i, k)) AS sponsorship_strength FROM sp GROUP BY 1),
ev AS (SELECT posting_no, list(s ORDER BY i)[1:{X.MOST_EVIDENCE}] AS evidence FROM (SELECT posting_no, s, min(i) AS i FROM (SELECT posting_no, i, s FROM sp UNION SELECT posting_no, i, s FROM el2) GROUP BY 1, 2) GROUP BY 1),
au AS (SELECT sg.posting_no, coalesce(eligibility, 'noneSpecified') AS eligibility, coalesce(sponsorship, 'noneSpecified') AS sponsorship, coalesce(strength, 'none') AS strength, coalesce(sponsorship_strength, 'none') AS sponsorship_strength, e.country AS country, coalesce(array_to_string(evidence, ' | '), '') AS evidence FROM sg LEFT JOIN e USING (posting_no) LEFT JOIN sl2 USING (posting_no) LEFT JOIN ev USING (posting_no)),
authorized AS (SELECT *, CASE WHEN eligibility = 'noneSpecified' AND sponsorship = 'noneSpecified' THEN 'not-mentioned' WHEN strength IN ('strict', 'preferred') OR sponsorship_strength = 'strict' THEN 'parsed' ELSE 'review' END AS status FROM au)"""


def authorizations(spark, sf):
    a = segmented(spark, sf).select("posting_no", X.work_authorization(F.col("sentences")).alias("a")).select("posting_no", "a.*")
    return a.withColumn("evidence", F.array_join("evidence", " | "))


@query(AUTHORIZED + " SELECT * FROM authorized")
def extract_work_authorization(spark, sf):
    return authorizations(spark, sf)


def signal_sql(k: int, r) -> str:
    hit = f"regexp_matches(s, '{quoted(r.pattern)}')" + (f" AND NOT contains(lower(s), '{quoted(r.unless.lower())}')" if r.unless else "")
    pick = lambda a, b: f"CASE WHEN regexp_matches(s, '{quoted(r.override)}') THEN '{b}' ELSE '{a}' END" if r.override else f"'{a}'"
    return f"SELECT posting_no, i, {k} AS k, 0 AS j, s, '{r.category}' AS category, {pick(r.level, r.override_level)} AS level, {pick(r.reason, r.override_reason)} AS reason FROM x WHERE {hit}"


NOW = f"NOT (regexp_matches(s, '{X.HISTORICAL}') AND NOT regexp_matches(s, '{X.CURRENT}'))"
TOP = "d AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY posting_no, category, s ORDER BY i, k, j) = 1), top AS (SELECT *, row_number() OVER (PARTITION BY posting_no ORDER BY level <> 'strong', category, i, k, j) AS r FROM d QUALIFY r <= {most})"
TR = lambda k, name: f"unnest(regexp_extract_all(s, '{X.TRAVEL}', {k})) AS {name}"


REMOTE_SQL = SEGMENTS + f""", x0 AS (SELECT posting_no, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM sg), x AS (SELECT * FROM x0 WHERE {NOW}),
tv0 AS (SELECT posting_no, i, s, unnest(range(len(regexp_extract_all(s, '{X.TRAVEL}')))) AS j, {TR(1, 'a')}, {TR(2, 'b')} FROM x), tv AS (SELECT posting_no, i, s, j, a::INT AS a, coalesce(TRY_CAST(b AS INT), a::INT) AS b FROM tv0),
sig AS ({" UNION ALL ".join(signal_sql(k, r) for k, r in enumerate(X.REMOTE))}
UNION ALL SELECT posting_no, i, 50, j, s, {"CASE " + " ".join(f"WHEN b <= {m} THEN '{c}'" for m, c, _ in X.BANDS) + " END"}, {"CASE " + " ".join(f"WHEN b <= {m} THEN '{v}'" for m, _, v in X.BANDS) + " END"}, 'Travel of ' || CASE WHEN a = b THEN b || '%' ELSE a || '-' || b || '%' END FROM tv WHERE a <= 100 AND b <= 100 AND b >= a
UNION ALL {signal_sql(60, X.FREQUENT)}), {TOP.format(most=X.MOST_REMOTE)},
re AS (SELECT posting_no, list(reason ORDER BY r) AS rs, string_agg(category, ',' ORDER BY r) AS categories, bool_or(level = 'strong') AS strong, bool_or(level = 'questionable') AS quest FROM top GROUP BY 1),
u AS (SELECT sg.posting_no, body, regexp_matches(title || ' ' || primary_location, '{X.REMOTE_NAMED}') OR regexp_matches(body, '{X.REMOTE_ROLE}') AS is_remote, re.* EXCLUDE (posting_no) FROM sg LEFT JOIN re USING (posting_no))
SELECT posting_no, is_remote, CASE WHEN NOT is_remote THEN 'none' WHEN strong THEN 'strong' WHEN quest THEN 'questionable' ELSE 'none' END AS level,
  CASE WHEN is_remote AND rs IS NOT NULL THEN array_to_string(list_filter(rs, lambda z, i: list_position(rs, z) = i)[1:2], '; ') || '.' END AS summary, CASE WHEN is_remote THEN coalesce(categories, '') ELSE '' END AS categories,
  CASE WHEN NOT is_remote THEN 'not-remote-designated' WHEN trim(body) = '' THEN 'description-unavailable' WHEN rs IS NOT NULL THEN 'parsed' ELSE 'no-concern-detected' END AS status FROM u"""


@query(REMOTE_SQL)
def extract_remote_work(spark, sf):
    """Designation from metadata or body, and the signals of its sentences that put it in doubt."""
    metadata = F.concat_ws(" ", "title", "primary_location")
    return segmented(spark, sf).select("posting_no", X.remote_work(metadata, F.col("body"), F.col("sentences")).alias("r")).select("posting_no", "r.*")


_COUNT = "CASE lower(n[q]) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.NUMBERS.items()) + " ELSE TRY_CAST(CASE WHEN regexp_matches(n[q], '^[0-9]{1,5}$') THEN n[q] END AS INT) END"
_UNIT = "CASE lower(u[q]) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.DAYS.items()) + " END"
STAY = f"list_max(list_transform(range(1, len(n) + 1), lambda q: {_COUNT} * {_UNIT}))"
_PLACE = lambda x: "CASE " + " ".join(f"WHEN regexp_matches({x}, '{p}') THEN '{n}'" for n, p in X.DESTINATIONS) + " END"


AWAY_SQL = SEGMENTS + f""", x0 AS (SELECT posting_no, unnest(range(len(ss) + 1)) AS i, unnest(list_concat([title], ss)) AS s FROM sg), x1 AS (SELECT *, regexp_extract_all(s, '{X.DURATION}', 1) AS n, regexp_extract_all(s, '{X.DURATION}', 2) AS u FROM x0 WHERE {NOW}), x AS (SELECT *, {STAY} AS days FROM x1),
sig AS (SELECT posting_no, i, -1 AS k, 0 AS j, s, '{X.EXTENDED.category}' AS category, '{X.EXTENDED.level}' AS level, '{X.EXTENDED.reason}' AS reason FROM x WHERE regexp_matches(s, '{X.PRESENCE}') AND regexp_matches(s, '{X.DEFINITE}') AND (NOT regexp_matches(s, '{X.CONDITIONAL}') OR regexp_matches(s, '{X.CURRENT}')) AND days >= {X.LEAST_DAYS}
UNION ALL {" UNION ALL ".join(signal_sql(k, r) for k, r in enumerate(X.AWAY))}), {TOP.format(most=X.MOST_AWAY)},
a AS (SELECT top.posting_no, string_agg(category, ',' ORDER BY r) AS categories, bool_or(level = 'strong') AS strong, min_by(top.s, r) AS first, max(days) FILTER (category = '{X.EXTENDED.category}') AS days FROM top JOIN x ON x.posting_no = top.posting_no AND x.i = top.i GROUP BY 1)
SELECT sg.posting_no, CASE WHEN strong THEN 'strong' WHEN categories IS NOT NULL THEN 'questionable' ELSE 'none' END AS confidence, CASE WHEN categories IS NOT NULL THEN coalesce({_PLACE('first')}, {_PLACE('title')}, {_PLACE('primary_location')}, {_PLACE('body')}, '{X.NOWHERE}') END AS destination, days::INT AS days, coalesce(categories, '') AS categories,
  CASE WHEN trim(body) = '' THEN 'description-unavailable' WHEN categories IS NOT NULL THEN 'parsed' ELSE 'no-requirement-detected' END AS status FROM sg LEFT JOIN a USING (posting_no)"""


@query(AWAY_SQL)
def extract_away_requirements(spark, sf):
    found = X.away_requirements(F.col("title"), F.col("primary_location"), F.col("body"), F.col("sentences"))
    return segmented(spark, sf).select("posting_no", found.alias("a")).select("posting_no", "a.*")


@query(SEGMENTS + f""", x AS (SELECT posting_no, unnest(range(len(ss))) AS i, unnest(ss) AS s FROM sg WHERE regexp_matches(title || primary_location, '(?i)remote') OR regexp_matches(body, '{X.REMOTE_ROLE}')),
h AS ({" UNION ALL ".join(f"SELECT posting_no, {k} AS k, '{r.category}' AS category, i, s FROM x WHERE regexp_matches(s, '{r.pattern}')" + (f" AND NOT regexp_matches(s, '{r.unless}')" if r.unless else "") for k, r in enumerate(X.GEO))})
SELECT posting_no, category, left(s, {X.SNIPPET}) AS snippet FROM h QUALIFY row_number() OVER (PARTITION BY posting_no ORDER BY k, i) = 1""")
def extract_geo_restriction(spark, sf):
    """For remote postings the first rule by priority, then by sentence, that no guard undoes."""
    remote = F.concat("title", "primary_location").rlike("(?i)remote") | F.col("body").rlike(X.REMOTE_ROLE)
    return segmented(spark, sf).where(remote).select("posting_no", F.inline(F.array_compact(F.array(X.geo_restriction(F.col("sentences"))))))


#: credential, group, alias, own pattern.
CREDENTIALS = (("sql", "skill", "SQL", None), ("linux", "skill", "Linux", None), ("bachelor", "degree", "Bachelor's", None), ("ged", "degree", "GED", None), ("ged", "degree", "high school equivalency", "(?i)high school (?:diploma|equivalency)"), ("clearance", "security", "clearance", "(?i)(?:top )?secret(?:/sci)? clearance"), ("polygraph", "security", "polygraph", None))


def _credential_pattern(alias: str, own: str | None) -> str:
    return (own or f"(?i)(?:^|[^\\p{{L}}\\p{{N}}]){alias}(?:$|[^\\p{{L}}\\p{{N}}])").replace("'", "''")


@query(BODY + ", h AS (" + " UNION ALL ".join(f"SELECT posting_no, '{g}' AS grp, '{c}' AS credential FROM bodies WHERE regexp_matches(body, '{_credential_pattern(a, p)}')" for c, g, a, p in CREDENTIALS) + ") SELECT posting_no, grp, string_agg(DISTINCT credential, ',' ORDER BY credential) AS credentials, count(*) AS mentions FROM h GROUP BY 1, 2")
def credential_mentions(spark, sf):
    """A catalogue of aliases and own patterns."""
    return R.credential_mentions(bodies(spark, sf), CREDENTIALS)


HEADED = LINES + f", hd AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '{E.HEADING}') THEN line END IGNORE NULLS) OVER (PARTITION BY posting_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM lines)"
_CODE = lambda x: f"CASE lower({x}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.CURRENCIES.items()) + " END"
_NUM = lambda n, k: f"(TRY_CAST(replace({n}, ',', '') AS DOUBLE) * CASE WHEN lower({k}) = 'k' THEN 1000 ELSE 1 END)"
_NEAR = lambda t: f"coalesce({first_sql('line', t)}, {first_sql(chr(99) + 'oalesce(heading, ' + chr(39) * 2 + ')', t)})"


@query(HEADED + f""", m AS (SELECT posting_no, line_no, line, heading, unnest(range(len(regexp_extract_all(line, '{E.MONEY}'))))::INT AS place, {", ".join(f"unnest(regexp_extract_all(line, '{E.MONEY}', {k})) AS g{k}" for k in range(7))} FROM hd),
v AS (SELECT *, g5 <> '' AS is_range, {_NUM('g2', 'g3')} AS lower, CASE WHEN g5 <> '' THEN {_NUM('g5', 'g6')} END AS up, {_CODE('g1')} AS currency, CASE WHEN g4 <> '' THEN {_CODE('g4')} ELSE {_CODE('g1')} END AS second FROM m),
w AS (SELECT *, coalesce(is_range AND currency <> second, false) AS mismatch FROM v)
SELECT posting_no, line_no, place, CASE WHEN is_range THEN 'range' ELSE 'amount' END AS kind, g0 AS raw, lower, CASE WHEN NOT mismatch THEN up END AS upper, currency, CASE WHEN is_range THEN second END AS upper_currency, {_NEAR(E.UNITS)} AS unit, {_NEAR(E.BASIS)} AS basis,
  CASE WHEN mismatch THEN 'currency-mismatch-review' WHEN lower > up THEN 'reversed-range-review' WHEN regexp_matches(line, '{E.PAY_CONTEXT}') OR regexp_matches(coalesce(heading, ''), '{E.PAY_CONTEXT}') THEN 'explicit' ELSE 'monetary-context-unresolved' END AS qualifier, heading FROM w""")
def money_observations(spark, sf):
    return E.money(lines(spark, sf), "posting_no")


DOMAINS = {"clearance": "(?i)clearance", "degree": "(?i)degree|diploma|\\bged\\b", "travel": "(?i)travel", "sponsorship": "(?i)sponsor", "arrangement": "(?i)work remotely|on site|report to the office"}
_VALUE = "CASE " + " ".join(f"WHEN domain = '{d}' AND regexp_matches(branch, '{p}') THEN '{v}'" for d, v, p in E.VALUES) + " ELSE '' END"
CL = HEADED + f""", c AS (SELECT posting_no, line_no, line, coalesce(heading, '') AS heading, string_split_regex(line, '{E.CLAUSE_END}') AS cs FROM hd), c2 AS (SELECT * EXCLUDE (cs), unnest(range(len(cs)))::INT AS clause_no, unnest(cs) AS clause FROM c),
b AS (SELECT *, string_split_regex(clause, '{E.BRANCH}') AS bs FROM c2 WHERE trim(clause) <> ''), b2 AS (SELECT * EXCLUDE (bs), unnest(range(len(bs)))::INT AS branch_no, unnest(bs) AS branch FROM b),
o AS MATERIALIZED ({" UNION ALL ".join(f"SELECT *, '{n}' AS domain, regexp_extract(branch, '{p}', 0) AS hit FROM b2 WHERE regexp_matches(branch, '{p}')" for n, p in DOMAINS.items())}),
obs AS MATERIALIZED (SELECT posting_no, sha256(posting_no || '|' || line_no || '|' || clause_no || '|' || branch_no || '|' || domain)[1:16] AS observation_id, line_no, clause_no, branch_no, domain, hit, instr(line, hit)::INT AS start, line, {first_sql('clause', E.OBLIGATION, "'stated'")} AS obligation,
  CASE WHEN regexp_matches(clause, '{E.NEGATED}') THEN 'negated' ELSE 'affirmed' END AS polarity, {first_sql('clause', E.TIMING, "''")} AS timing, heading, {_VALUE} AS value FROM o),
grouped AS (SELECT posting_no, line_no, clause_no, list(struct_pack(b := branch_no, i := observation_id)) AS others FROM obs GROUP BY ALL),
alt AS MATERIALIZED (SELECT observation_id, array_to_string(list_sort(list_transform(list_filter(others, lambda o: o.b <> branch_no), lambda o: o.i)), ',') AS alternatives FROM obs JOIN grouped USING (posting_no, line_no, clause_no))"""


def observations(spark, sf):
    return E.clauses(lines(spark, sf), "posting_no", DOMAINS)


@query(CL + " SELECT obs.* EXCLUDE (line), coalesce(alternatives, '') AS alternatives FROM obs LEFT JOIN alt USING (observation_id)")
def clause_observations(spark, sf):
    return observations(spark, sf).drop("line").withColumn("alternatives", F.array_join("alternatives", ","))


@query(CL + """, d AS (SELECT posting_no, CASE WHEN primary_location LIKE 'Remote%' THEN 'remote' ELSE 'onsite' END AS arrangement FROM postings)
SELECT a.posting_no, 'opposite-sponsorship' AS kind, a.observation_id, b.observation_id AS other_id FROM obs a JOIN obs b USING (posting_no) WHERE a.domain = 'sponsorship' AND b.domain = 'sponsorship' AND a.value = 'notAvailable' AND b.value = 'available'
UNION ALL SELECT a.posting_no, 'obligation', a.observation_id, b.observation_id FROM obs a JOIN obs b USING (posting_no, domain) WHERE a.obligation = 'not-required' AND b.obligation = 'required'
UNION ALL SELECT posting_no, 'provider-arrangement', observation_id, 'provider:' || arrangement FROM obs JOIN d USING (posting_no) WHERE domain = 'arrangement' AND value <> '' AND value <> arrangement""")
def contradiction_links(spark, sf):
    """Claims of a posting that may contradict each other or what its provider declares."""
    declared = postings(spark, sf).select("posting_no", F.when(F.col("primary_location").startswith("Remote"), "remote").otherwise("onsite").alias("arrangement"))
    return E.contradictions(observations(spark, sf), declared, "posting_no")


@query(CL + " SELECT domain, count(*) AS n, (count(*) - count(DISTINCT observation_id))::BIGINT AS repeated, count(*) FILTER (line[start:start + length(hit) - 1] <> hit OR start < 1) AS bad_spans, 0::BIGINT AS dangling FROM obs GROUP BY 1")
def observation_integrity(spark, sf):
    return E.integrity(observations(spark, sf))
