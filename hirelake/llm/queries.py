"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, centroids, html_main, importance, langid, licences, mixing, ngram_join, packing, pii, quality, toxicity, warc
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, u.b FROM r JOIN u ON r.t = u.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT s AS doc_id, min(t) AS component_id FROM r GROUP BY s) m USING (doc_id)
"""


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents")).withColumn("families", F.array_join("families", ","))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(table(spark, sf_dir, "documents")).select(columns)


OP9_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT r, doc_id, text,
        list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM t),
p AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM s WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM p),
d AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) v(k) WHERE c >= 2 GROUP BY r),
m AS (SELECT s.doc_id, len(ws)::BIGINT AS n_words,
        length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(d.n, 0)::BIGINT AS n_repeat_words,
        len(list_filter(ws, lambda w: lower(rtrim(w, '.,;:!?')) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))}))) AS n_stop,
        len(list_filter(ws, lambda w: regexp_matches(w, '\\p{{L}}'))) AS n_alpha,
        len(ls) AS n_lines, len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS n_bullet,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis
      FROM s LEFT JOIN d USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.3 AND n_stop / n_words >= 0.02
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_bullet / greatest(n_lines, 1) <= 0.95
  AND n_ellipsis / greatest(n_lines, 1) <= 0.6 AND n_alpha / n_words >= 0.4 AS kept
FROM b
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = warc.archived(table(spark, sf_dir, "pages"))
    return warc.read_back(index).drop("payload")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS n, d, max(page_id) OVER (PARTITION BY d, octet_length(b)) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> m THEN m END AS refers_to
FROM q
"""


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """The rounds written out one after another."""
    size, rounds = centroids.DIMENSIONS, centroids.ROUNDS
    steps = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor({centroids.SCALE} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = {size})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c
  FROM (SELECT sha256('{centroids.SEED}:' || vec_id) AS h, x FROM k ORDER BY h, x LIMIT {centroids.CLUSTERS}))""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, k.x, min(struct_pack(d := list_sum(list_transform(range(1, {size + 1}), lambda i: (k.x[i] - c.c[i]) * (k.x[i] - c.c[i])))::BIGINT, k := c.k)) AS b
  FROM k, c{i} c GROUP BY r, k.x)""")
        if i < rounds:
            steps.append(f"""s{i} AS MATERIALIZED (SELECT k, p, sum(x[p])::BIGINT AS s, count(*) AS n FROM (SELECT b.k AS k, x, unnest(range(1, {size + 1})) AS p FROM a{i}) GROUP BY k, p)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.c, c.c) AS c FROM c{i} c
  LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM s{i} GROUP BY k) m ON m.k = c.k)""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, b.k::INTEGER AS cluster, b.d AS distance, sum(b.d) OVER (PARTITION BY b.k)::BIGINT AS cluster_inertia, sum(b.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN k USING (r) JOIN c{rounds} c ON c.k = a.b.k"""


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = f"""
WITH bytes AS (SELECT range AS c FROM range(256)),
tbl AS MATERIALIZED (SELECT list(v ORDER BY c) AS t FROM (
  SELECT c, list_reduce(list_prepend(c, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM bytes)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS MATERIALIZED (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w),
bw AS MATERIALIZED (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
crc AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % {importance.BUCKETS} AS bucket
  FROM (SELECT w FROM dw UNION SELECT w FROM bw), tbl),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN crc USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN crc USING (w) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) + {importance.BUCKETS} AS s_all, (SELECT coalesce(sum(t), 0) FROM t) + {importance.BUCKETS} AS t_all),
gain AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * s_all::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS g
  FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT r, sum(n * g)::BIGINT AS weight FROM dw JOIN crc USING (w) JOIN gain USING (bucket) GROUP BY r),
x AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    ('0x' || substr(sha256('{importance.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN w USING (r)),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM y WHERE n_features >= {importance.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {importance.PERCENT} * n // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)
"""


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_mixing, op3_ann, op4_language, op5_pii, op6_ngram_join, op7_licences, op8_html, op9_quality, op10_warc, op11_centroids, op12_importance, op13_toxicity)}
ORACLE_SQL: dict[str, str] = {"op6_ngram_join": OP6_SQL, "op9_quality": OP9_SQL, "op10_warc": OP10_SQL, "op11_centroids": _op11_sql(), "op12_importance": OP12_SQL}
