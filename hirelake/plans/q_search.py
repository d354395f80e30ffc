"""Queries of history, workflow, search and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import history as H
from hirelake.operators import search as S

from .fixtures import POSTINGS_SQL, postings, table
from .q_text import BODY
from .registry import query

ID = "CASE WHEN trim(coalesce(requisition_id, '')) <> '' THEN company_id || ':' || requisition_id ELSE company_id || ':path:' || external_path END"
P = f"WITH postings AS ({POSTINGS_SQL}), j AS (SELECT company_id || ':' || posting_no AS stable_id, * FROM postings)"
STATE = "CASE posting_no % 6 WHEN 0 THEN 'saved' WHEN 1 THEN 'applied' WHEN 2 THEN 'hidden' WHEN 3 THEN 'closed' ELSE 'normal' END"


def jobs(spark, sf):
    return postings(spark, sf).withColumn("stable_id", F.concat_ws(":", "company_id", F.col("posting_no").cast("string")))


def state():
    return F.expr(STATE)


@query(P + f""", history AS (SELECT CASE WHEN posting_no % 5 = 1 THEN 'old-' || posting_no ELSE stable_id END AS stable_id, company_id, external_path, {STATE} AS state, cached_at AS last_seen FROM j WHERE posting_no % 4 <> 3),
cur AS (SELECT stable_id, company_id, external_path, cached_at + INTERVAL 1 DAY AS seen_at FROM j WHERE posting_no % 7 <> 0),
free AS (SELECT * FROM cur WHERE stable_id NOT IN (SELECT stable_id FROM history)),
b AS (SELECT h.*, c.seen_at AS now_ FROM history h LEFT JOIN cur c USING (stable_id)),
m AS (SELECT b.*, f.stable_id AS new_id, f.seen_at FROM b LEFT JOIN free f ON b.now_ IS NULL AND f.company_id = b.company_id AND f.external_path = b.external_path)
SELECT coalesce(new_id, stable_id) AS stable_id, company_id, external_path, state, greatest(last_seen, coalesce(now_, seen_at, last_seen)) AS last_seen,
  CASE WHEN now_ IS NOT NULL THEN 'kept' WHEN new_id IS NOT NULL THEN 'rekeyed' ELSE 'unlisted' END AS action FROM m
UNION ALL SELECT stable_id, company_id, external_path, 'normal', seen_at, 'inserted' FROM free WHERE stable_id NOT IN (SELECT new_id FROM m WHERE new_id IS NOT NULL)""")
def reconcile_history(spark, sf):
    j, n = jobs(spark, sf), F.col("posting_no")
    history = j.where("posting_no % 4 <> 3").select(F.when(n % 5 == 1, F.concat(F.lit("old-"), n.cast("string"))).otherwise(F.col("stable_id")).alias("stable_id"), "company_id", "external_path", state().alias("state"), F.col("cached_at").alias("last_seen"))
    current = j.where("posting_no % 7 <> 0").select("stable_id", "company_id", "external_path", (F.col("cached_at") + F.expr("interval 1 day")).alias("seen_at"))
    return H.reconcile_history(history, current)


ACTION = "CASE event_type WHEN 'click' THEN 'saved' WHEN 'view' THEN 'normal' WHEN 'purchase' THEN 'applied' WHEN 'signup' THEN 'closed' ELSE 'hidden' END"
FOLD_SQL = f"""WITH RECURSIVE e AS (SELECT user_id AS job_id, ts, {ACTION} AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
ok AS (SELECT * FROM (VALUES {', '.join(f"('{a}','{b}')" for a, ts in H.TRANSITIONS.items() for b in (*ts, a))}) v(a, b)),
f AS (SELECT job_id, 0::BIGINT AS n, 'normal' AS state, NULL::TIMESTAMP AS applied_at, NULL::TIMESTAMP AS closed_at, 0 AS ignored FROM (SELECT DISTINCT job_id FROM e)
UNION ALL SELECT f.job_id, e.n, CASE WHEN ok.a IS NOT NULL THEN e.t ELSE f.state END,
  CASE WHEN ok.a IS NULL OR e.t = f.state THEN f.applied_at WHEN e.t = 'applied' THEN e.ts WHEN e.t IN ('normal', 'saved') THEN NULL ELSE f.applied_at END,
  CASE WHEN ok.a IS NULL OR e.t = f.state THEN f.closed_at WHEN e.t = 'closed' THEN e.ts END, f.ignored + CASE WHEN ok.a IS NULL THEN 1 ELSE 0 END
FROM f JOIN e ON e.job_id = f.job_id AND e.n = f.n + 1 LEFT JOIN ok ON ok.a = f.state AND ok.b = e.t)
SELECT job_id, state, applied_at, closed_at, ignored FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC) = 1"""


def workflow_events(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.expr(ACTION).alias("to_state"))


@query(FOLD_SQL)
def fold_workflow(spark, sf):
    return H.fold_workflow(workflow_events(spark, sf)).drop("events")


@query(P + """, r AS (SELECT CASE WHEN posting_no % 2 = 0 THEN stable_id ELSE 'x' || posting_no END AS stable_id, company_id, posting_no % 3 = 0 AS saved, posting_no % 4 = 0 AS applied, posting_no % 5 = 0 AS dismissed, posting_no % 8 = 0 AS closed, CASE WHEN posting_no % 16 = 0 THEN start_date END AS applied_on FROM j)
SELECT CASE WHEN contains(stable_id, ':') THEN stable_id ELSE company_id || ':' || stable_id END AS stable_id,
  CASE WHEN closed THEN CASE WHEN applied_on IS NOT NULL THEN 'closed' ELSE 'applied' END WHEN applied THEN 'applied' WHEN dismissed THEN 'hidden' WHEN saved THEN 'saved' ELSE 'normal' END AS state FROM r""")
def migrate_history(spark, sf):
    n = F.col("posting_no")
    r = jobs(spark, sf).select(F.when(n % 2 == 0, F.col("stable_id")).otherwise(F.concat(F.lit("x"), n.cast("string"))).alias("stable_id"), "company_id", (n % 3 == 0).alias("saved"), (n % 4 == 0).alias("applied"), (n % 5 == 0).alias("dismissed"), (n % 8 == 0).alias("closed"), F.when(n % 16 == 0, F.col("start_date")).alias("applied_on"))
    return H.migrate_history(r).select("stable_id", "state")


HIST = P + f", h AS (SELECT stable_id, {STATE} AS state FROM j WHERE posting_no % 3 <> 1), s AS (SELECT j.*, coalesce(h.state, 'normal') AS state FROM j LEFT JOIN h USING (stable_id))"


def with_states(spark, sf):
    j = jobs(spark, sf)
    return H.job_states(j, j.where("posting_no % 3 <> 1").select("stable_id", state().alias("state")))


@query(HIST + " SELECT stable_id, state, is_available OR state IN ('saved', 'applied', 'closed') AS visible FROM s")
def job_states(spark, sf):
    return with_states(spark, sf).select("stable_id", "state", "visible")


@query(HIST + " SELECT company_id, count(*) FILTER (state = 'normal' AND is_available AND title ILIKE '%engineer%') AS normal, count(*) FILTER (state = 'saved') AS saved, count(*) FILTER (state = 'applied') AS applied, count(*) FILTER (state = 'closed') AS closed, count(*) FILTER (state = 'hidden') AS hidden FROM s GROUP BY company_id")
def workflow_tabs(spark, sf):
    """Tab counts; only the normal tab is narrowed by the filters."""
    narrow = F.col("is_available") & F.lower("title").contains("engineer")
    tab = lambda s: F.count_if((F.col("state") == s) & (narrow if s == "normal" else F.lit(True))).alias(s)
    return with_states(spark, sf).groupBy("company_id").agg(*[tab(s) for s in ("normal", "saved", "applied", "closed", "hidden")])


@query(HIST + " SELECT stable_id, state, external_path FROM s WHERE state <> 'normal'")
def curated_export(spark, sf):
    return with_states(spark, sf).where("state <> 'normal'").select("stable_id", "state", "external_path")


@query(P + f""", cur AS (SELECT stable_id, {STATE} AS state FROM j WHERE posting_no % 3 <> 1), inc AS (SELECT stable_id, 'saved' AS state FROM j WHERE posting_no % 4 = 0 UNION ALL SELECT stable_id, 'applied' FROM j WHERE posting_no % 40 = 0),
o AS (SELECT stable_id, count(*) AS n, min(state) AS inc FROM inc GROUP BY 1)
SELECT stable_id, CASE WHEN n > 1 THEN cur.state ELSE coalesce(inc, 'normal') END AS state, CASE WHEN n > 1 THEN 'rejected' WHEN inc IS NULL THEN 'reset' WHEN cur.state IS NULL THEN 'inserted' ELSE 'replaced' END AS action FROM cur FULL JOIN o USING (stable_id)""")
def curated_import(spark, sf):
    j = jobs(spark, sf)
    inc = j.where("posting_no % 4 = 0").select("stable_id", F.lit("saved").alias("state")).union(j.where("posting_no % 40 = 0").select("stable_id", F.lit("applied")))
    return H.curated_import(j.where("posting_no % 3 <> 1").select("stable_id", state().alias("state")), inc)


@query(BODY + " SELECT posting_no FROM bodies WHERE CASE WHEN posting_no % 21 = 0 THEN true ELSE (contains(lower(title || ' ' || body), 'sql') OR contains(lower(title || ' ' || body), 'remote')) AND NOT contains(lower(title || ' ' || body), 'relocation') END")
def keyword_match(spark, sf):
    text = F.when(F.col("posting_no") % 21 != 0, F.concat_ws(" ", "title", T.html_to_text(F.col("html"))))
    return postings(spark, sf).where(S.keyword_match(text, ["SQL ", "remote"], ["relocation"])).select("posting_no")


@query(P + """, a AS (SELECT company_id, CASE WHEN posting_no % 29 <> 0 THEN greatest(date_diff('day', start_date, (SELECT max(start_date) FROM j)), 0) END AS d FROM j)
SELECT company_id, CASE WHEN d IS NULL THEN 'unknown' WHEN d <= 0 THEN 'today' WHEN d <= 1 THEN 'yesterday' WHEN d <= 7 THEN '2-7' WHEN d <= 14 THEN '8-14' WHEN d <= 30 THEN '15-30' ELSE '31+' END AS age_group, count(*) AS n FROM a GROUP BY ALL""")
def age_groups(spark, sf):
    p = postings(spark, sf)
    today = F.broadcast(p.agg(F.max("start_date").alias("today")))  # one row
    days = F.when(F.col("posting_no") % 29 != 0, F.datediff("today", "start_date"))
    return p.crossJoin(today).groupBy("company_id", S.age_group(days).alias("age_group")).agg(F.count("*").alias("n"))


@query(P + " SELECT country, arg_min(primary_location, posting_no) AS label, count(*) AS n FROM j GROUP BY country")
def country_facets(spark, sf):
    return S.facets(postings(spark, sf), ["country"], "primary_location", "posting_no")


@query(P + " SELECT country, lower(replace(primary_location, ' ', '-')) AS location_id, arg_min(primary_location, posting_no) AS label, count(*) AS n FROM j GROUP BY ALL")
def location_facets(spark, sf):
    p = postings(spark, sf).withColumn("location_id", F.lower(F.replace("primary_location", F.lit(" "), F.lit("-"))))
    return S.facets(p, ["country", "location_id"], "primary_location", "posting_no")


_SHAPES = []
for _pattern, _at, _rest, _by_name in S.SHAPES:
    _raw, _place = f"regexp_extract(label, '{_pattern}', {_at})", f"trim(regexp_extract(label, '{_pattern}', {_rest}))"
    _key = f"(SELECT st.code FROM st WHERE lower(st.name) = lower({_raw}))" if _by_name else f"(SELECT st.code FROM st WHERE st.code = upper({_raw}))"
    _SHAPES.append((f"regexp_matches(label, '{_pattern}') AND {_place} <> '' AND {_key} IS NOT NULL", _key, _place))
_STATES = ", ".join(f"('{c}', '{n}')" for c, n in S.STATES.items())


@query(P + f""", st AS (SELECT * FROM (VALUES {_STATES}) v(code, name)), l AS (SELECT primary_location AS label, count(*) AS n FROM j GROUP BY 1),
s AS (SELECT n, coalesce(CASE {" ".join(f"WHEN {w} THEN {k}" for w, k, _ in _SHAPES)} END, 'Other') AS state, coalesce(CASE {" ".join(f"WHEN {w} THEN {p}" for w, _, p in _SHAPES)} END, label) AS place FROM l)
SELECT state, coalesce((SELECT name FROM st WHERE code = state), 'Other locations') AS name, sum(n)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT place)), ';') AS places, state <> 'Other' AS mapped FROM s GROUP BY 1""")
def state_location_groups(spark, sf):
    return S.state_groups(postings(spark, sf).groupBy(F.col("primary_location").alias("label")).agg(F.count("*").alias("n")))


@query(P + """, q AS (SELECT * FROM (VALUES ('q1', 'building', 'US-TX-Austin'), ('q1', 'building', 'Remote, US'), ('q2', 'machinery', 'Denver, CO'), ('q2', 'machinery', 'Remote, US')) v(query_id, company_id, location))
SELECT DISTINCT q.query_id, j.posting_no FROM q JOIN j ON j.company_id = q.company_id AND j.primary_location = q.location""")
def source_filter(spark, sf):
    """Postings of each saved query: its physical locations and the remote one of its country."""
    q = spark.createDataFrame([("q1", "building", ["US-TX-Austin"]), ("q2", "machinery", ["Denver, CO"])], "query_id string, company_id string, places array<string>")
    q = q.select("query_id", "company_id", F.explode(F.array_union("places", F.array(F.lit("Remote, US")))).alias("primary_location"))
    return postings(spark, sf).join(F.broadcast(q), ["company_id", "primary_location"]).select("query_id", "posting_no").distinct()
