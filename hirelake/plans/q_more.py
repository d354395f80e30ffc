"""Queries of sources, clusters, review, streams and the learned baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import clusters as C
from hirelake.operators import identity as I
from hirelake.operators import metrics as M
from hirelake.operators import review as V
from hirelake.sources import cache as S
from hirelake.streaming import jobs as J

from .fixtures import POSTINGS_SQL, postings, table
from .q_search import ACTION, FOLD_SQL
from .q_text import BODY
from .registry import query

P = f"WITH postings AS ({POSTINGS_SQL})"


@query(P + " SELECT company_id, external_path, title, length(html) AS n FROM postings")
def explode_cache_documents(spark, sf):
    """Write postings as cache documents, each of one company and a range of numbers, and read them again."""
    job = F.struct(F.col("external_path").alias("externalPath"), "title", F.col("html").alias("descriptionHtml"), F.lit(None).cast("string").alias("descriptionCompressed"))
    docs = postings(spark, sf).groupBy(F.col("company_id").alias("companyId"), F.floor(F.col("posting_no") / 8000).alias("range")).agg(F.collect_list(job).alias("jobs"))
    path = S.scratch(spark, "cache-documents")
    docs.select(F.lit(1).alias("schemaVersion"), "companyId", "jobs").write.option("maxRecordsPerFile", 1).json(path)
    return S.explode_cache_documents(spark, path).select("company_id", F.col("externalPath").alias("external_path"), "title", F.length("descriptionHtml").cast("long").alias("n"))


@query(P + " SELECT posting_no, CASE WHEN posting_no % 3 = 2 THEN '' ELSE html END AS body, CASE WHEN posting_no % 3 = 2 THEN 'invalid compressed body' END AS error FROM postings")
def inflate_descriptions(spark, sf):
    n = F.col("posting_no")
    p = postings(spark, sf).select("posting_no", F.when(n % 3 == 0, F.col("html")).alias("plain"), F.when(n % 3 == 1, S.gzip_text(F.col("html"))).when(n % 3 == 2, F.lit("bm90IGd6aXA=")).alias("packed"))
    return S.inflate_descriptions(p, "plain", "packed").select("posting_no", "body", "error")


@query("SELECT doc_id AS id, CASE quality WHEN 1 THEN 'KEEP' ELSE 'REJECT' END AS label, length(text) AS n FROM labels JOIN documents USING (doc_id)")
def read_labelled_jsonl(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    path = S.scratch(spark, "labelled")
    d.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "KEEP").otherwise("REJECT").alias("label"), "text").write.json(path)
    return S.read_labelled_jsonl(spark, path, ["KEEP", "REJECT"]).select("id", "label", F.length("text").cast("long").alias("n"))


@query(P + " SELECT posting_no % 4 AS file_no, company_id, count(*) AS records, count(*) FILTER (posting_no % 9 <> 4) AS with_body FROM postings GROUP BY 1, 2")
def cache_inventory(spark, sf):
    """Records and records with a body per file and company."""
    return postings(spark, sf).groupBy((F.col("posting_no") % 4).alias("file_no"), "company_id").agg(F.count("*").alias("records"), F.count_if(F.col("posting_no") % 9 != 4).alias("with_body"))


@query("SELECT count(*) AS n_rows FROM customer")
def publish(spark, sf):
    return S.publish(table(spark, sf, "customer"), S.scratch(spark, "published"), ["c_custkey", "c_name", "c_mktsegment"]).select("n_rows")


LEAF = "coalesce(length({0}) || ':' || {0}, '-')"


@query(P + " SELECT posting_no, sha256(concat_ws(',', " + ", ".join(LEAF.format(c) for c in ("title", "html", "primary_location", "country", "requisition_id", "company_id")) + ")) AS fingerprint FROM postings")
def input_fingerprint(spark, sf):
    """Digest of every input that a classification reads, nested facts included."""
    p = postings(spark, sf).select("posting_no", F.struct("title", "html", F.struct("primary_location", "country").alias("place"), F.struct("requisition_id", "company_id").alias("ids")).alias("input"))
    return p.select("posting_no", I.input_fingerprint(p, "input").alias("fingerprint"))


GRAMS = f"""WITH t AS (SELECT min(p_partkey) AS id, p_name AS title FROM part GROUP BY p_name), p AS (SELECT id, ' ' || lower(title) || ' ' AS s FROM t),
tf AS (SELECT id, g, count(*) AS tf FROM (SELECT id, unnest(list_transform(range(1, length(s) - 1), lambda i: s[i:i + 2])) AS g FROM p) GROUP BY 1, 2),
df AS (SELECT g, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT id, g, tf * (ln((1 + (SELECT count(*) FROM t)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (g)),
u AS (SELECT id, g, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM w)"""


@query(GRAMS + " SELECT a.id AS a, b.id AS b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.8 - 1e-12")
def title_similarity_pairs(spark, sf):
    return C.title_similarity_pairs(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), 0.8)


@query("SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS member_of FROM part")
def title_members(spark, sf):
    return C.title_members(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")))


COMPONENTS = """WITH RECURSIVE e AS (SELECT event_id AS a, -user_id - 1 AS b FROM events UNION SELECT -user_id - 1, -(user_id // 3 * 3) - 1 FROM events), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS t FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.t = u.a), c AS (SELECT node, min(t) AS cluster FROM r GROUP BY 1)"""


def components(spark, sf):
    """Events of a user, and of three neighbouring users, are one cluster."""
    e, user = table(spark, sf, "events"), -F.col("user_id") - 1
    groups = e.select(user.alias("a"), (-F.floor(F.col("user_id") / 3) * 3 - 1).alias("b")).distinct()
    return C.cluster_components(e.select(F.col("event_id").alias("a"), user.alias("b")).union(groups))


@query(COMPONENTS + " SELECT node, cluster FROM c")
def cluster_components(spark, sf):
    return components(spark, sf)


@query(COMPONENTS + """, n AS (SELECT event_id AS node, event_type IN ('click', 'purchase') AS has_body FROM events), m AS (SELECT n.*, cluster, sha256('seed|representative|' || node) AS h FROM n JOIN c USING (node)),
p AS (SELECT cluster, count(*) AS members, arg_min(node, struct_pack(b := NOT has_body, h := h)) AS representative FROM m GROUP BY 1)
SELECT node, cluster, members, representative, node = representative AS is_representative FROM m JOIN p USING (cluster)""")
def cluster_representatives(spark, sf):
    """Which event stands for each cluster: clicks and purchases have a body."""
    nodes = table(spark, sf, "events").select(F.col("event_id").alias("node"), F.col("event_type").isin("click", "purchase").alias("has_body"))
    return C.cluster_representatives(components(spark, sf), nodes, "seed")


QUEUE = "q AS (SELECT posting_no AS case_id, CASE WHEN is_available THEN 'KEEP' ELSE 'REJECT' END AS machine FROM postings), v AS (SELECT l_orderkey AS case_id, l_linenumber AS revision, CASE WHEN l_returnflag = 'R' THEN 'REJECT' ELSE 'KEEP' END AS decision FROM lineitem WHERE l_returnflag <> 'N')"


@query(P + f", {QUEUE}, l AS (SELECT case_id, arg_max(decision, (revision, decision)) AS decision FROM v GROUP BY 1) SELECT coalesce(decision, 'open') AS state, count(*) AS n, count(*) FILTER (decision <> machine) AS disagrees FROM q LEFT JOIN l USING (case_id) GROUP BY 1")
def review_status(spark, sf):
    """Every posting is a case; returned or accepted order lines are its revisions."""
    queue = postings(spark, sf).select(F.col("posting_no").alias("case_id"), F.when(F.col("is_available"), "KEEP").otherwise("REJECT").alias("machine"))
    lines = table(spark, sf, "lineitem").where("l_returnflag <> 'N'")
    s = V.review_status(queue, lines.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("revision"), F.when(F.col("l_returnflag") == "R", "REJECT").otherwise("KEEP").alias("decision")))
    return s.groupBy("state").agg(F.count("*").alias("n"), F.count_if("disagrees").alias("disagrees"))


def start_of(spark, sf):
    return table(spark, sf, "events").agg(F.expr("timestampadd(HOUR, 12, min(ts))")).first()[0]


@query("WITH s AS (SELECT min(ts) + INTERVAL 12 HOUR AS t FROM events), l AS (SELECT user_id || ':' || event_type AS key FROM events WHERE user_id % 5 = 0), o AS (SELECT user_id || ':' || event_type AS key, ts, event_id FROM events WHERE ts > (SELECT t FROM s)) SELECT key, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM o WHERE key NOT IN (SELECT key FROM l) GROUP BY 1")
def fresh_observations(spark, sf):
    e = table(spark, sf, "events").withColumn("key", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return V.fresh_observations(e.select("key", "ts", "event_id"), e.where("user_id % 5 = 0").select("key").distinct(), start_of(spark, sf))


REVIEW = BODY + f""", t AS (SELECT posting_no AS case_id, company_id AS employer, list_sort(list_distinct(list_filter(string_split(regexp_replace(lower(body), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) > 1))) AS tokens,
  CASE WHEN posting_no % 3 = 0 THEN 2.0 ELSE 0 END + CASE WHEN posting_no % 4 = 0 THEN 3.0 ELSE 0 END + CASE WHEN posting_no % 7 = 0 THEN 3.0 ELSE 0 END + CASE WHEN posting_no % 2 = 0 THEN 1.0 ELSE 0 END AS score FROM bodies),
s AS (SELECT * FROM t WHERE score >= 4), prior AS MATERIALIZED (SELECT DISTINCT tokens FROM t WHERE case_id IN (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12)),
f AS (SELECT case_id, employer, score::DOUBLE AS score FROM s WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE len(list_intersect(s.tokens, p.tokens)) / (len(s.tokens) + len(p.tokens) - len(list_intersect(s.tokens, p.tokens))) >= 0.8)),
k AS (SELECT *, row_number() OVER (PARTITION BY employer ORDER BY score DESC, case_id) AS turn FROM f)
SELECT case_id, employer, score, (row_number() OVER (ORDER BY turn, score DESC, case_id))::INT AS place FROM k WHERE turn <= 6 ORDER BY turn, score DESC, case_id LIMIT 24"""


@query(REVIEW)
def select_review_cases(spark, sf):
    """Cases with reasons, unlike the reviewed ones: the postings of the twelve largest orders."""
    n = F.col("posting_no")
    reasons = F.array_compact(F.array(F.when(n % 3 == 0, "new_employer"), F.when(n % 4 == 0, "rule_conflict"), F.when(n % 7 == 0, "title_only"), F.when(n % 2 == 0, "rare_tokens")))
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12).select(F.col("o_orderkey").alias("posting_no"))
    p = postings(spark, sf)
    words = lambda rows: T.once(rows, tokens=T.token_set(T.html_to_text(F.col("html"))))
    cases = words(p).select(n.alias("case_id"), F.col("company_id").alias("employer"), "tokens", reasons.alias("reasons"))
    return V.select_review_cases(cases, words(p.join(F.broadcast(top), "posting_no", "left_semi")).select(n.alias("case_id"), "tokens"))


@query(REVIEW.replace("\nSELECT case_id, employer, score, (row_number()", ", sel AS (SELECT case_id, employer, score, (row_number()").replace("LIMIT 24", "LIMIT 24)") + ", nw AS (SELECT count(DISTINCT user_id || ':' || event_type) AS n FROM events WHERE ts > (SELECT min(ts) + INTERVAL 12 HOUR FROM events)) SELECT any_value(nw.n) AS observations, count(*) AS cases, count(DISTINCT employer) AS employers, any_value(nw.n) >= 25 AND count(*) >= 10 AND count(DISTINCT employer) >= 3 AS due FROM sel, nw")
def review_trigger(spark, sf):
    """Whether the selected cases and the new observations since the ledger's start call for a review."""
    e = table(spark, sf, "events").where(F.col("ts") > F.lit(start_of(spark, sf)))
    return V.review_due(select_review_cases(spark, sf), e.select("user_id", "event_type").distinct())


@query("SELECT time_bucket(INTERVAL 10 SECOND, ts) AS window_start, event_type AS rule_id, count(*) AS matches FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def stream_rule_usage(spark, sf):
    return J.drained(J.stream_rule_usage(J.events_stream(spark, sf)), S.scratch(spark, "rule-usage"))


@query("SELECT DISTINCT user_id || ':' || event_type AS key FROM events WHERE ts > (SELECT min(ts) + INTERVAL 12 HOUR FROM events)")
def stream_discovery(spark, sf):
    """Keys are remembered for longer than the events last."""
    e = J.events_stream(spark, sf, None).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    return J.stream_discovery(e, start_of(spark, sf), S.scratch(spark, "discovery")).select("key")


@query(FOLD_SQL.replace("SELECT job_id, state, applied_at, closed_at, ignored FROM f", "SELECT job_id, state, applied_at, closed_at, n AS events, ignored::BIGINT AS ignored FROM f"))
def stream_workflow(spark, sf):
    e = J.events_stream(spark, sf).select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", F.expr(ACTION).alias("to_state"))
    return J.stream_workflow(e, S.scratch(spark, "workflow")).select("job_id", "state", "applied_at", "closed_at", "events", "ignored")


THIRDS = "CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0 WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"


@query(f"""WITH l AS (SELECT event_type, user_id, {THIRDS} AS batch, arg_max(struct_pack(v := value, p := props), struct_pack(a := ts, b := event_id)) AS row FROM events GROUP BY ALL),
g AS (SELECT k.event_type, k.user_id, b.batch, l.row FROM (SELECT DISTINCT event_type, user_id FROM l) k CROSS JOIN (SELECT unnest([0, 1, 2]) AS batch) b LEFT JOIN l USING (event_type, user_id, batch)),
p AS (SELECT *, lag(row) OVER w AS before, count(row) OVER (PARTITION BY event_type, user_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g WINDOW w AS (PARTITION BY event_type, user_id ORDER BY batch)),
c AS (SELECT event_type, batch, CASE WHEN row IS NULL THEN CASE WHEN before IS NOT NULL THEN 'removed' END WHEN seen = 0 THEN 'added' WHEN before IS NULL OR row <> before THEN 'changed' END AS change FROM p)
SELECT event_type, batch, change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY ALL""")
def stream_refresh(spark, sf):
    """Three batches of events, each the full listing of every event type, are merged into the cache in turn."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("company_id"), F.col("user_id").cast("string").alias("external_path"), "value", "props", "ts", "event_id", F.expr(THIRDS).alias("third"))
    path = S.scratch(spark, "refresh")
    stream = J.in_turn([e.where(F.col("third") == k).drop("third") for k in range(3)], f"{path}/in")
    rows = J.stream_refresh(stream, path, ["value", "props"], ["ts", "event_id"], scope=["company_id"], buckets=16)
    return rows.groupBy(F.col("company_id").alias("event_type"), "batch", "change").agg(F.count("*").alias("n"))


@query()
def tfidf_logistic(spark, sf):
    """Word one- and two-gram TF-IDF with balanced logistic regression; scores of the fold left out."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("label"), (F.crc32("source") % 3).alias("fold"))
    share = d.agg(F.avg("label").alias("share"))
    d = d.crossJoin(F.broadcast(share)).withColumn("weight", F.when(F.col("label") == 1, 0.5 / F.col("share")).otherwise(0.5 / (1 - F.col("share"))))
    stages = [RegexTokenizer(inputCol="text", outputCol="words", pattern="\\W+"), NGram(n=2, inputCol="words", outputCol="pairs"), HashingTF(numFeatures=1 << 12, inputCol="words", outputCol="tf1"), HashingTF(numFeatures=1 << 12, inputCol="pairs", outputCol="tf2"), IDF(inputCol="tf1", outputCol="x1", minDocFreq=2), IDF(inputCol="tf2", outputCol="x2", minDocFreq=2), VectorAssembler(inputCols=["x1", "x2"], outputCol="features"), LogisticRegression(weightCol="weight", maxIter=10, regParam=0.1)]
    out = None
    for fold in range(3):
        model = Pipeline(stages=stages).fit(d.where(F.col("fold") != fold))
        scored = model.transform(d.where(F.col("fold") == fold)).select("doc_id", "fold", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    out = C.written(out, "tfidf-scores")
    # A fold's threshold keeps 95 % of the rows to keep of the other folds.
    each = out.select("score", (F.col("label") == 1).alias("actual"), F.explode(F.array_remove(F.array(*[F.lit(k) for k in range(3)]), F.col("fold"))).alias("fold"))
    return out.join(M.choose_threshold(each, 0.95), "fold").withColumn("keep", F.col("score") >= F.col("threshold"))
