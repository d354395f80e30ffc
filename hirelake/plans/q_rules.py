"""Queries of rule classification and fit scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import fit as FIT
from hirelake.operators import rules as R

from . import fixtures as X
from .fixtures import postings, table
from .q_text import BODY
from .registry import query

MATCHES = BODY + f""", rules AS ({X.RULES_SQL}), sc AS (SELECT posting_no, 'title' AS scope, title AS txt FROM bodies UNION ALL SELECT posting_no, 'posting', body FROM bodies UNION ALL SELECT posting_no, 'corpus', title || chr(10) || body FROM bodies),
h AS (SELECT posting_no, concept_id, rule_id, kind, context_group, regexp_extract(txt, pattern) AS evidence FROM sc JOIN rules USING (scope) WHERE regexp_matches(txt, pattern)),
ok AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.posting_no = h.posting_no AND x.concept_id = h.concept_id AND x.kind = 'exclusion')
  AND (kind <> 'context' OR (SELECT count(*) FROM rules r WHERE r.concept_id = h.concept_id AND r.context_group = h.context_group AND r.kind = 'context') = (SELECT count(*) FROM h y WHERE y.posting_no = h.posting_no AND y.concept_id = h.concept_id AND y.context_group = h.context_group AND y.kind = 'context'))),
matches AS (SELECT posting_no, concept_id, rule_id, trim(regexp_replace(evidence, '\\s+', ' ', 'g')) AS evidence FROM ok)"""


def bodies(spark, sf):
    """Postings with their body, which is made once a row, after the rows are dealt."""
    return T.once(postings(spark, sf).select("posting_no", "company_id", "title", "html", "primary_location", "start_date"), body=T.html_to_text(F.col("html"))).drop("html")


def matched(spark, sf):
    """Postings with their body and the array of their matches."""
    return R.matched_rules(bodies(spark, sf).select("posting_no", "title", "body"), X.RULES)


def matches(spark, sf):
    return R.match_rules(bodies(spark, sf).select("posting_no", "title", "body"), X.RULES)


@query(MATCHES + " SELECT * FROM matches")
def match_concepts(spark, sf):
    return matches(spark, sf)


_FIRST = ("team", "pay", "salary", "travel", "secret", "clearance", "degree", "master", "bachelor", "visa", "sql", "office", "remote", "relocation", "deployment", "citizen", "sponsor", "bonus", "stipend", "associate", "warehouse", "nurse", "bridges", "analyst", "network")
_THEN = ("required", "preferred", "experience", "available", "annually", "people", "hour", "useful", "overseas", "week", "engineer", "administrator")
#: A large rule table: two words of one sentence; some rules are context groups of two, some vetoes.
MANY_RULES = tuple(
    (f"m{12 * i + j:03d}", f"pair.{a}", "exclusion" if (i, j) in ((2, 4), (7, 1)) else "context" if j in (0, 1) else "title", "g" if j in (0, 1) else "", ("posting", "corpus", "title")[(i + j) % 3 if j > 9 else j % 2], f"(?i)\\b{a}[a-z]*\\b[^.]*\\b{b}\\b")
    for i, a in enumerate(_FIRST)
    for j, b in enumerate(_THEN)
)


@query(MATCHES.replace(X.RULES_SQL, X.duck_values(MANY_RULES, "rule_id, concept_id, kind, context_group, scope, pattern")) + " SELECT * FROM matches")
def match_rule_table(spark, sf):
    """Three hundred rules, looked up by the literals of their patterns."""
    return R.match_rules(bodies(spark, sf).select("posting_no", "title", "body"), MANY_RULES)


NEGATED = BODY + """, z AS (SELECT posting_no, string_split_regex(body, '(?i)clearance|travel') AS b, regexp_extract_all(body, '(?i)clearance|travel') AS h FROM bodies),
f AS (SELECT posting_no, list_filter(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN NOT regexp_matches(rtrim(right(b[i], 60)), '""" + R.NEGATION.replace("'", "''") + """') THEN h[i] END), lambda x: x IS NOT NULL) AS hits FROM z)
SELECT posting_no, hits[1] AS hit FROM f"""


@query(NEGATED)
def negated_match(spark, sf):
    """First mention of a clearance or travel that isn't negated closely before."""
    return bodies(spark, sf).select("posting_no", R.first_not_negated(F.col("body"), "(?i)clearance|travel").alias("hit"))


@query(MATCHES + " SELECT posting_no, concept_id, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, string_agg(evidence, '; ' ORDER BY rule_id) AS evidence FROM (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY posting_no, concept_id, lower(evidence) ORDER BY rule_id) = 1) GROUP BY ALL")
def merge_evidence(spark, sf):
    return R.merge_evidence(matches(spark, sf))


@query(MATCHES + f", c AS ({X.CONCEPTS_SQL}) SELECT posting_no, concept_id, EXISTS (SELECT 1 FROM matches m WHERE m.posting_no = b.posting_no AND m.concept_id = c.concept_id) AS matched FROM bodies b CROSS JOIN c")
def dense_predictions(spark, sf):
    return R.dense_predictions(postings(spark, sf), X.concepts(spark), matches(spark, sf))


#: A small predicate graph in the shape of the reject rules.
GRAPH = {
    "medical-title": {"scope": "title", "pattern": "(?i)\\bnurse\\b"},
    "physical-title": {"scope": "title", "pattern": "(?i)warehouse|bridges"},
    "technical-title": {"scope": "titlePrefix", "pattern": "(?i)software|network|systems|data"},
    "technical-body": {"scope": "body", "pattern": "(?i)\\b(sql|linux)\\b"},
    "clearance-body": {"scope": "body", "pattern": "(?i)[a-z/]+ clearance", "ignore": "(?i)^no "},
    "guard": {"all": ["technical-title"], "any": ["technical-body", "clearance-body"]},
    "manual": {"any": ["medical-title", "physical-title"], "none": ["technical-body"]},
}
ORDERED = [("keep-technical", "KEEP", "guard"), ("reject-medical", "REJECT", "medical-title"), ("reject-manual", "REJECT", "manual")]
FLAGS = BODY + """, f AS (SELECT posting_no, company_id, regexp_matches(title, '(?i)\\bnurse\\b') AS med, regexp_matches(title, '(?i)warehouse|bridges') AS phys, regexp_matches(string_split(title, ' - ')[1], '(?i)software|network|systems|data') AS tech,
  regexp_matches(body, '(?i)\\b(sql|linux)\\b') AS tb, len(list_filter(regexp_extract_all(body, '(?i)[a-z/]+ clearance'), lambda m: NOT regexp_matches(m, '(?i)^no '))) > 0 AS cl, start_date FROM bodies),
d AS (SELECT *, tech AND (tb OR cl) AS guard, (med OR phys) AND NOT tb AS manual FROM f),
decided AS (SELECT posting_no, company_id, start_date, CASE WHEN guard OR NOT (med OR manual) THEN 'KEEP' ELSE 'REJECT' END AS decision,
  CASE WHEN guard THEN 'keep-technical' WHEN med AND manual THEN 'reject-medical,reject-manual' WHEN med THEN 'reject-medical' WHEN manual THEN 'reject-manual' ELSE 'default-keep' END AS rule_ids FROM d)"""


def decided(spark, sf):
    return R.triage_decide(bodies(spark, sf), GRAPH, ORDERED)


@query(FLAGS + " SELECT posting_no, decision, rule_ids FROM decided")
def triage_decide(spark, sf):
    return decided(spark, sf).select("posting_no", "decision", "rule_ids")


#: Ten kinds of evidence.
BUCKETS = {
    "code": "(?i)sql|linux|software", "place": "(?i)remotely|overseas|site", "degree": "(?i)bachelor|master|associate", "clearance": "(?i)secret|clearance|polygraph", "pay": "(?i)salary|pay|compensation", "travel": "(?i)travel|deployment",
    "people": "(?i)team|people", "law": "(?i)citizen|visa|export", "field": "(?i)computer|engineering|mathematics", "perks": "(?i)benefits|bonus|stipend",
}


@query(BODY + """, s AS (SELECT posting_no, regexp_matches(title, '(?i)nurse|warehouse|bridges') AS physical, regexp_matches(title, '(?i)software|network|systems|data|electrical') AS technical, body FROM bodies),
b AS (SELECT *, """ + ", ".join(f"list_sort(list_distinct(list_transform(regexp_extract_all(body, '{p}'), lambda z: lower(z))))[1:5] AS b_{n}" for n, p in BUCKETS.items()) + """ FROM s)
SELECT posting_no, CASE WHEN physical AND NOT regexp_matches(body, '(?i)sql|linux') THEN 1 WHEN NOT technical THEN 2 ELSE 0 END AS rejected_at, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN len(b_{n}) > 0 THEN '{n}:' || array_to_string(b_{n}, ',') END" for n in BUCKETS) + """], lambda z: z IS NOT NULL), '|') AS evidence FROM b""")
def two_stage_triage(spark, sf):
    physical, technical = F.col("title").rlike("(?i)nurse|warehouse|bridges"), F.col("title").rlike("(?i)software|network|systems|data|electrical")
    stage = F.when(physical & ~F.col("body").rlike("(?i)sql|linux"), 1).when(~technical, 2).otherwise(0)
    return bodies(spark, sf).select("posting_no", stage.alias("rejected_at"), R.buckets(F.col("body"), BUCKETS).alias("evidence"))


#: Families (title, body) and the eight variants that use them.
FAMILIES = {"care": ("(?i)nurse", "(?i)people"), "storage": ("(?i)warehouse", "(?i)site|travel"), "civil": ("(?i)civil|bridges", "(?i)degree|experience"), "electrical": ("(?i)electrical", "(?i)clearance|travel"), "service": ("(?i)technician", "(?i)travel|office")}
BASE, ALL, DUTY, NOISE, PROTECT = ["care", "storage"], ["care", "storage", "civil", "electrical", "service"], "(?i)[a-z]+ of sql|linux", "(?i)knowledge of sql", "(?i)software|network|systems"
VARIANTS = {
    "title": {"families": BASE}, "title-body": {"families": BASE, "body": True}, "guarded": {"families": BASE, "body": True, "veto": DUTY}, "protected": {"families": BASE, "body": True, "veto": DUTY, "protect": PROTECT},
    "noise-aware": {"families": BASE, "body": True, "veto": DUTY, "noise": NOISE}, "extended": {"families": ALL, "body": True, "veto": DUTY, "noise": NOISE}, "electrical-safe": {"families": [f for f in ALL if f != "electrical"], "body": True, "veto": DUTY, "noise": NOISE, "protect": PROTECT},
    "aggressive": {"families": ALL},
}


def _variant_sql(v: dict) -> str:
    keep = ["false"]
    if v.get("protect"):
        keep.append(f"regexp_matches(title, '{v['protect']}')")
    if v.get("veto"):
        duties = f"regexp_extract_all(body, '{v['veto']}')"
        keep.append(f"len(list_filter({duties}, lambda m: NOT regexp_matches(m, '{v['noise']}'))) > 0" if v.get("noise") else f"len({duties}) > 0")
    hits = ", ".join(f"CASE WHEN regexp_matches(title, '{FAMILIES[n][0]}')" + (f" AND regexp_matches(body, '{FAMILIES[n][1]}')" if v.get("body") else "") + f" THEN '{n}' END" for n in v["families"])
    return f"CASE WHEN {' OR '.join(keep)} THEN '' ELSE array_to_string(list_filter([{hits}], lambda z: z IS NOT NULL), ',') END"


@query(BODY + ", d AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, posting_no, {_variant_sql(v)} AS families FROM bodies" for n, v in VARIANTS.items()) + ") SELECT variant, posting_no, families, families <> '' AS reject FROM d")
def family_triage(spark, sf):
    """Title families, their proof in the body, technical vetoes and protected titles, in eight named variants."""
    rows = F.array(*[F.struct(F.lit(n).alias("variant"), R.family_decision(F.col("title"), F.col("body"), FAMILIES, v).alias("families")) for n, v in VARIANTS.items()])
    return bodies(spark, sf).select("posting_no", F.inline(rows)).select("variant", "posting_no", "families", (F.col("families") != "").alias("reject"))


@query(FLAGS + """, o AS (SELECT d.posting_no, d.company_id AS employer, p.country AS provider, CASE WHEN p.is_available THEN decision WHEN med THEN 'REJECT' ELSE 'UNDETERMINED' END AS decision, p.is_available AS has_body, CASE WHEN d.start_date < DATE '1995-01-01' THEN 'rules-0' ELSE 'rules-1' END AS ruleset, d.start_date AS made FROM decided d JOIN postings p USING (posting_no) JOIN f USING (posting_no)),
e AS (SELECT * EXCLUDE (employer, provider), unnest(['all', 'employer', 'provider']) AS slice, unnest(['', employer, provider]) AS value FROM o), n AS (SELECT slice, value, count(*) AS n, count(*) FILTER (decision = 'KEEP') AS keep, count(*) FILTER (decision = 'REJECT') AS reject, count(*) FILTER (decision = 'UNDETERMINED') AS undetermined, count(*) FILTER (NOT has_body AND decision <> 'UNDETERMINED') AS title_only, count(*) FILTER (has_body) AS described, count(*) FILTER (ruleset <> 'rules-1') AS stale, max(made) AS latest FROM e GROUP BY 1, 2)
SELECT *, round(CASE WHEN keep + reject > 0 THEN 100.0 * reject / (keep + reject) END, 6) AS reject_percent FROM n""")
def triage_status(spark, sf):
    """Postings that are gone have no body: their titles decide, or nothing does."""
    p = postings(spark, sf).select("posting_no", F.col("country").alias("provider"), F.col("is_available").alias("has_body"))
    j = decided(spark, sf).join(p, "posting_no")
    alone = F.when(F.col("title").rlike(GRAPH["medical-title"]["pattern"]), "REJECT").otherwise("UNDETERMINED")
    o = j.select(F.col("company_id").alias("employer"), "provider", "has_body", F.when(F.col("has_body"), F.col("decision")).otherwise(alone).alias("decision"), F.when(F.col("start_date") < "1995-01-01", "rules-0").otherwise("rules-1").alias("ruleset"), F.col("start_date").alias("at"))
    return R.triage_status(o, "rules-1", ["employer", "provider"])


@query(BODY + """, f AS (SELECT posting_no, title, body, regexp_matches(title || ' ' || primary_location, '(?i)\\bremote\\b') OR regexp_matches(body, '(?i)work remotely|fully remote') AS remote FROM bodies)
SELECT posting_no, 'arrangement.remote' AS concept_id, 'f1' AS rule_id, 'true' AS evidence FROM f WHERE remote UNION ALL SELECT posting_no, 'technical.software', 'f2', regexp_extract(title, '(?i)software engineer') FROM f WHERE regexp_matches(title, '(?i)software engineer')""")
def match_fact_selectors(spark, sf):
    """Concepts by extracted facts beside text rules."""
    from hirelake.operators import facts as FACTS

    remote = F.concat_ws(" ", "title", "primary_location").rlike(FACTS.REMOTE_NAMED) | F.col("body").rlike(FACTS.REMOTE_ROLE)
    rules = [("f1", "arrangement.remote", "positive", "", "fact:is_remote", "true"), ("f2", "technical.software", "title", "", "title", "(?i)software engineer")]
    return R.match_rules(bodies(spark, sf).withColumn("is_remote", remote), rules, facts=["is_remote"])


@query(MATCHES + """, cu AS (SELECT posting_no, list_sort(list(DISTINCT concept_id)) AS now FROM matches GROUP BY 1), ol AS (SELECT posting_no, list_sort(list(DISTINCT concept_id)) AS was FROM matches WHERE rule_id NOT IN ('r05', 'r12') GROUP BY 1),
s AS (SELECT p.posting_no, p.start_date < DATE '1995-01-01' AS stale, coalesce(now, []) AS now, coalesce(was, []) AS was FROM postings p LEFT JOIN cu USING (posting_no) LEFT JOIN ol USING (posting_no))
SELECT stale AS recomputed, count(*) AS inspected, count(*) FILTER (stale AND now <> was) AS repaired, sum(len(now))::BIGINT AS concepts FROM s GROUP BY 1""")
def reconcile_stale(spark, sf):
    """Rows of before 1995 were classified by an older rule table; only they are classified again."""
    b = bodies(spark, sf)
    old = [r for r in X.RULES if r[0] not in ("r05", "r12")]
    sets = lambda rules: R.match_rules(b.select("posting_no", "title", "body"), rules).groupBy("posting_no").agg(F.array_sort(F.collect_set("concept_id")).alias("c"))
    before = F.col("start_date") < "1995-01-01"
    j = b.select("posting_no", "start_date").join(sets(old).withColumnRenamed("c", "was"), "posting_no", "left").join(sets(list(X.RULES)).withColumnRenamed("c", "now"), "posting_no", "left")
    empty = F.expr("cast(array() as array<string>)")
    stored = j.select("posting_no", F.when(before, "rules-0").otherwise("rules-1").alias("version"), F.coalesce(F.when(before, F.col("was")).otherwise(F.col("now")), empty).alias("concepts"))
    out = R.reconciled(stored, b.select("posting_no", "title", "body"), list(X.RULES), "rules-1")
    return out.groupBy("recomputed").agg(F.count("*").alias("inspected"), F.count_if("repaired").alias("repaired"), F.sum(F.size("concepts").cast("long")).alias("concepts"))


USAGE = "SELECT event_type AS rule_id, count(*) AS matches, count(*) FILTER (value < 10) AS timeouts, max(ts) AS last_match FROM events GROUP BY 1"


def usage(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("rule_id")).agg(F.count("*").alias("matches"), F.count_if(F.col("value") < 10).alias("timeouts"), F.max("ts").alias("last_match"))


@query(USAGE)
def rule_usage(spark, sf):
    return usage(spark, sf)


@query(f"""WITH u AS ({USAGE}), nw AS (SELECT (max(ts)::DATE + 29) AS d FROM events), r AS (SELECT rule_id, state, nw.d - days AS since, days, nw.d FROM (VALUES ('click', 'active', 10), ('view', 'active', 45), ('error', 'retired', 100), ('signup', 'retired', 200), ('never', 'active', 31), ('young', 'active', 29)) v(rule_id, state, days), nw)
SELECT r.rule_id, coalesce(u.matches, 0)::BIGINT AS matches, CASE WHEN state = 'active' AND d - greatest(since, coalesce(last_match::DATE, since)) >= 30 THEN 'review-due' WHEN state = 'retired' AND days >= 180 THEN 'deleted' ELSE state END AS state FROM r LEFT JOIN u USING (rule_id)""")
def rule_lifecycle(spark, sf):
    """29 days after the last event, so that matched rules are still in use."""
    now = table(spark, sf, "events").agg(F.date_add(F.to_date(F.max("ts")), 29)).first()[0]
    rows = [("click", "active", 10), ("view", "active", 45), ("error", "retired", 100), ("signup", "retired", 200), ("never", "active", 31), ("young", "active", 29)]
    r = spark.createDataFrame(rows, "rule_id string, state string, days int").select("rule_id", "state", F.date_sub(F.lit(now), F.col("days")).alias("since"))
    return R.rule_lifecycle(r, usage(spark, sf), now)


PREFERENCES = ("ideal", "positive", "negative", "hardConflict", "neutral")
SIGNALS_SQL = "signals AS (SELECT c_custkey AS user_id, concept_id, (['ideal', 'positive', 'negative', 'hardConflict', 'neutral'])[1 + (c_custkey * 7 + length(concept_id)) % 5] AS preference FROM customer, c)"
WEIGHT = "CASE preference WHEN 'ideal' THEN 2.0 WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -3.0 WHEN 'hardConflict' THEN -6.0 ELSE 0.0 END::DOUBLE"


@query(MATCHES + f""", c AS ({X.CONCEPTS_SQL}), {SIGNALS_SQL}, pr AS ({X.PROFILES_SQL}),
a0 AS (SELECT DISTINCT posting_no, pr.user_id, m.concept_id, dimension, CASE WHEN conflict_group <> '' AND m.concept_id LIKE conflict_group || '.%' THEN 'hardConflict' ELSE preference END AS preference FROM matches m JOIN pr USING (posting_no) JOIN c USING (concept_id) JOIN signals s ON s.user_id = pr.user_id AND s.concept_id = m.concept_id),
a AS (SELECT * FROM a0 WHERE preference <> 'neutral'),
k AS (SELECT * FROM a WHERE NOT (concept_id = 'technical.network' AND EXISTS (SELECT 1 FROM a b WHERE b.posting_no = a.posting_no AND b.user_id = a.user_id AND b.concept_id = 'technical.software'))),
d AS (SELECT posting_no, user_id, dimension, sum({WEIGHT}) AS w, count(*) FILTER (preference = 'hardConflict') AS h FROM k GROUP BY ALL),
l AS (SELECT *, CASE dimension WHEN 'Work Arrangement' THEN greatest(least(w, 1), -2) WHEN 'Role Type / Career Direction' THEN greatest(least(w, 2.5), -3) WHEN 'Technical Domain' THEN greatest(least(w, 1.5), -2) WHEN 'Work Environment' THEN greatest(least(w, 1), -3) WHEN 'Responsibility Shape' THEN greatest(least(w, 1.5), -2) ELSE greatest(least(w, 1), -2) END AS c_w FROM d),
s AS (SELECT posting_no, user_id, least(greatest(floor(5 + sum(c_w) + 0.5), 1), 10)::BIGINT AS score, sum(h)::BIGINT AS hard_conflicts FROM l GROUP BY ALL)
SELECT posting_no, user_id, CASE WHEN hard_conflicts > 0 THEN least(score, 2) ELSE score END AS score, hard_conflicts FROM s""")
def job_fit(spark, sf):
    """Every posting for its reader, the customer of its order; some readers bar a group of concepts as a whole."""
    concepts = X.concepts(spark)
    choice = F.array(*[F.lit(p) for p in PREFERENCES])
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    signals = users.crossJoin(F.broadcast(concepts.select("concept_id"))).withColumn("preference", F.get(choice, ((F.col("user_id") * 7 + F.length("concept_id")) % 5).cast("int")))
    over = spark.createDataFrame([("technical.software", "technical.network")], "concept_id string, superseded string")
    readers = X.profiles(spark, sf).select("posting_no", "user_id", "conflict_group")
    barred = readers.where("conflict_group <> ''").select("user_id", "conflict_group").distinct()
    barred = barred.join(F.broadcast(concepts), concepts.concept_id.startswith(F.concat("conflict_group", F.lit(".")))).select("user_id", "concept_id")
    return FIT.job_fit(matches(spark, sf).select("posting_no", "concept_id"), signals, concepts, over, readers.select("posting_no", "user_id"), barred)


@query(BODY + """, t AS (SELECT posting_no, CASE WHEN regexp_matches(body, 'No travel') THEN 0 ELSE TRY_CAST(regexp_extract(body, 'ravel up to ([0-9]+)%', 1) AS INT) END AS pct FROM bodies),
l AS (SELECT posting_no, pct, CASE WHEN pct <= 0 THEN 0 WHEN pct <= 10 THEN 3 WHEN pct <= 25 THEN 4 WHEN pct <= 50 THEN 5 ELSE 6 END AS level FROM t WHERE pct IS NOT NULL)
SELECT posting_no, level, CASE WHEN level - 4 >= 2 THEN 'hardConflict' WHEN level > 4 THEN 'negative' ELSE 'neutral' END AS fit FROM l""")
def travel_requirement(spark, sf):
    """Highest travel share a body names, as a level, against a tolerance of 4."""
    shares = F.transform(F.regexp_extract_all("body", F.lit("ravel up to ([0-9]+)%"), F.lit(1)), lambda x: x.cast("int"))
    pct = F.when(F.col("body").contains("No travel"), 0).otherwise(F.array_max(shares))
    b = bodies(spark, sf).select("posting_no", pct.alias("pct")).where("pct is not null").withColumn("level", FIT.travel_level(F.col("pct")))
    return b.select("posting_no", "level", FIT.travel_fit(F.col("level"), F.lit(4)).alias("fit"))


#: Cadence rules: pattern, level (0 remote to 5 always on site) and priority.
CADENCE = (
    ("(?i)three days a week", 4, 1), ("(?i)remotely two days", 3, 2), ("(?i)office visits are optional", 1, 3), ("(?i)office visits may be", 2, 4), ("(?i)rotational schedule", 5, 5),
    ("(?i)relocation to the site", 5, 6), ("(?i)deployment", 5, 7), ("(?i)must live within", 3, 8),
)


@query(BODY + ", k AS (" + " UNION ALL ".join(f"SELECT posting_no, {lv} AS level, {pr} AS priority FROM bodies WHERE regexp_matches(body, '{p}')" for p, lv, pr in CADENCE) + " UNION ALL SELECT posting_no, 0, 0 FROM bodies WHERE regexp_matches(title || primary_location, '(?i)remote')) SELECT posting_no, level, ([1, 0, -1, -2, -3, -4])[1 + abs(level - 3)] AS impact FROM k QUALIFY row_number() OVER (PARTITION BY posting_no ORDER BY priority, level) = 1")
def work_location_level(spark, sf):
    """Ordered cadence rules give a level; its distance to the preferred one has an impact."""
    remote = F.concat("title", "primary_location").rlike("(?i)remote")
    found = F.array_compact(F.array(F.when(remote, F.struct(F.lit(0).alias("priority"), F.lit(0).alias("level"))), *[F.when(F.col("body").rlike(p), F.struct(F.lit(pr).alias("priority"), F.lit(lv).alias("level"))) for p, lv, pr in CADENCE]))
    b = T.once(bodies(spark, sf), level=F.array_min(found)["level"]).where("level is not null")
    return b.select("posting_no", "level", F.get(F.array(*[F.lit(x) for x in FIT.DISTANCE_IMPACT]), F.abs(F.col("level") - 3)).alias("impact"))
