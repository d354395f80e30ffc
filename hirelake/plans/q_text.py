"""Queries of text normalisation, fingerprints, identity and deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.functions import digests as D
from hirelake.functions import text as T
from hirelake.operators import identity as I

from .fixtures import CONCEPTS, POSTINGS_SQL, postings, table
from .registry import query

P = f"WITH postings AS ({POSTINGS_SQL})"


def sql_unescape(x: str) -> str:
    for a, b in T.ENTITIES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return x


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def sql_text(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(coalesce({x}, ''), '{T.BLOCK_TAGS}', ' ', 'g'), '{T.ANY_TAG}', ' ', 'g')"
    return sql_squeeze(sql_unescape(inner))


def sql_lines(x: str) -> str:
    inner = f"regexp_replace(regexp_replace(coalesce({x}, ''), '{T.BLOCK_TAGS}', chr(10), 'g'), '{T.ANY_TAG}', ' ', 'g')"
    return f"list_filter(list_transform(string_split({sql_unescape(inner)}, chr(10)), lambda z: {sql_squeeze('z')}), lambda z: z <> '')"


BODY = P + f", bodies AS (SELECT *, {sql_text('html')} AS body FROM postings)"


@query(P + f" SELECT posting_no, {sql_text('html')} AS body FROM postings")
def html_to_text(spark, sf):
    return postings(spark, sf).select("posting_no", T.html_to_text(F.col("html")).alias("body"))


@query(f"SELECT page_id, {sql_text('html')} AS body FROM pages")
def pages_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("body"))


@query(P + f", l AS (SELECT posting_no, {sql_lines('html')} AS ls FROM postings) SELECT posting_no, (unnest(range(len(ls))))::INT AS line_no, unnest(ls) AS line FROM l")
def html_to_lines(spark, sf):
    return postings(spark, sf).select("posting_no", F.posexplode(T.html_to_lines(F.col("html"))).alias("line_no", "line"))


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z#*])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda z: z <> '') AS ss FROM documents)
SELECT doc_id, (unnest(range(len(ss))))::INT AS sentence_no, unnest(ss) AS sentence FROM d""")
def split_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query(P + """ SELECT posting_no, regexp_replace(regexp_replace(regexp_replace(replace(replace(html, '<li>', '<p> </p>'), '</li>', '&#10;'),
  '(?i)(&#10;|&#13;|\\\\n)+', '<br>', 'g'), '(?i)(<p>(\\s|&nbsp;)*</p>\\s*)+', '<br>', 'g'), '(?i)(<br\\s*/?>\\s*){3,}', '<br><br>', 'g') AS html FROM postings""")
def clean_provider_html(spark, sf):
    raw = F.replace(F.replace(F.col("html"), F.lit("<li>"), F.lit("<p> </p>")), F.lit("</li>"), F.lit("&#10;"))
    return postings(spark, sf).select("posting_no", T.clean_provider_html(raw).alias("html"))


@query(f"SELECT page_id, lower({sql_squeeze(sql_unescape(f'''regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')'''))}) AS body FROM pages")
def normalize_lower(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.normalize_lower(F.col("html")).alias("body"))


@query(f"SELECT page_id, array_to_string({sql_lines(f'''regexp_replace(coalesce(html, ''), '{T.HIDDEN}', ' ', 'g')''')}, chr(10)) AS body FROM pages")
def visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.visible_text(F.col("html")).alias("body"))


IGNORED = ("and", "the", "we", "in", "of")


@query(BODY + f""" SELECT posting_no, array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_replace(lower(body), '[^a-z]+', ' ', 'g'), ' ')),
  lambda w: length(w) > 1 AND w NOT IN {IGNORED})), ' ') AS tokens FROM bodies""")
def token_set(spark, sf):
    return postings(spark, sf).select("posting_no", F.array_join(T.token_set(T.html_to_text(F.col("html")), IGNORED), " ").alias("tokens"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, n::INT AS n_words,
  list_sort(list_distinct(list_concat(list_concat(range(1, least(n, 40) + 1), range(greatest(1, n // 2 - 20), least(n, greatest(1, n // 2 - 20) + 39) + 1)), range(greatest(1, n - 39), n + 1)))) AS places FROM w WHERE n > 0""")
def select_spans(spark, sf):
    words = F.size(F.filter(F.split("text", "\\s+"), lambda x: x != ""))
    d = table(spark, sf, "documents").select("doc_id", words.alias("n_words")).where("n_words > 0")
    return d.select("doc_id", "n_words", T.span_windows(F.col("n_words"), 120, "head_mid_tail").cast("array<long>").alias("places"))


DUTIES, QUALIFICATIONS = "(?i)\\bmore\\b", "(?i)\\b(?:preferred|required) qualifications\\b"
_WORDS = lambda x: f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"
_PLACE = lambda p: f"CASE WHEN regexp_matches(body, '{p}') THEN len({_WORDS(f'string_split_regex(body, {chr(39)}{p}{chr(39)})[1]')}) + 1 END"


@query(BODY + f""", w AS (SELECT posting_no, len({_WORDS('body')}) AS n, {_PLACE(DUTIES)} AS d, {_PLACE(QUALIFICATIONS)} AS q FROM bodies), s AS (SELECT *, greatest(1, least(coalesce(d, (n - 20) // 2 + 1), n - 19)) AS m, greatest(1, least(coalesce(q, n - 9), n - 9)) AS t FROM w),
k AS (SELECT *, list_distinct(list_concat(list_concat(range(1, least(n, 10) + 1), range(m, least(n, m + 19) + 1)), range(t, least(n, t + 9) + 1))) AS kept FROM s)
SELECT posting_no, n::INT AS n_words, list_sort(list_concat(kept, list_filter(range(1, n + 1), lambda i: NOT list_contains(kept, i))[1:greatest(40 - len(kept), 0)])) AS places FROM k""")
def select_section_spans(spark, sf):
    """Forty words of a body: its head, its duties and its qualifications."""
    body = F.col("body")
    words = F.size(F.filter(F.split(body, "\\s+"), lambda x: x != ""))
    d = postings(spark, sf).select("posting_no", T.html_to_text(F.col("html")).alias("body")).select("posting_no", words.alias("n_words"), T.word_place(body, DUTIES).alias("d"), T.word_place(body, QUALIFICATIONS).alias("q"))
    return d.select("posting_no", "n_words", T.span_windows(F.col("n_words"), 40, "sections", F.col("d"), F.col("q")).cast("array<long>").alias("places"))


@query(BODY + """, a AS (SELECT posting_no, body, instr(lower(body), 'clearance') AS pos FROM bodies WHERE instr(lower(body), 'clearance') > 0),
b AS (SELECT *, greatest(pos - 20, 1) AS s FROM a)
SELECT posting_no, CASE WHEN s > 1 THEN '…' ELSE '' END || trim(substring(body, s, 60)) || CASE WHEN s + 60 <= length(body) THEN '…' ELSE '' END AS excerpt FROM b""")
def evidence_excerpt(spark, sf):
    body = T.html_to_text(F.col("html"))
    d = postings(spark, sf).select("posting_no", body.alias("body"), F.instr(F.lower(body), "clearance").alias("at")).where("at > 0")
    return d.select("posting_no", T.excerpt(F.col("body"), F.col("at"), 60).alias("excerpt"))


@query(BODY + """ SELECT posting_no, regexp_replace(body, '(?i)' || lower(country) || '|' || replace(company_id, '-', '[- ]'), 'the employer', 'g') AS body FROM bodies""")
def mask_employer(spark, sf):
    pattern = F.concat_ws("|", F.lower("country"), F.replace("company_id", F.lit("-"), F.lit("[- ]")))
    return postings(spark, sf).select("posting_no", T.mask_names(T.html_to_text(F.col("html")), pattern).alias("body"))


@query(P + """ SELECT posting_no, sha256(trim(external_path) || chr(10) || trim(title) || chr(10) || trim(primary_location) || chr(10) || trim(coalesce(requisition_id, '')) || chr(10) ||
  array_to_string(list_sort([country, company_id]), chr(10))) AS fingerprint FROM postings""")
def listing_fingerprint(spark, sf):
    return postings(spark, sf).select("posting_no", I.listing_fingerprint(extra=F.array("country", "company_id")).alias("fingerprint"))


@query(BODY + ", c AS (SELECT posting_no, sha256(title || chr(10) || body) AS content_hash FROM bodies) SELECT *, sha256(content_hash || chr(10) || 'rules-1' || chr(10) || 'taxonomy-1') AS classification_fingerprint FROM c")
def content_hash(spark, sf):
    h = postings(spark, sf).select("posting_no", I.content_hash(F.col("title"), T.html_to_text(F.col("html"))).alias("content_hash"))
    return h.withColumn("classification_fingerprint", I.classification_fingerprint(F.col("content_hash"), "rules-1", "taxonomy-1"))


CONCEPT_IDS = sorted(c for c, _ in CONCEPTS)


@query(BODY + f""" SELECT posting_no FROM bodies JOIN orders ON o_orderkey = posting_no WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P' OR o_totalprice > 300000""")
def stale_rows(spark, sf):
    """Rows whose version or content digest isn't the current one, or whose concept set isn't complete.

    Urgent orders' rows were stored by older rules, pending ones' with another text, those of large orders without a concept.
    """
    body = T.html_to_text(F.col("html"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("posting_no"), "o_orderpriority", "o_orderstatus", "o_totalprice")
    full = F.array(*[F.lit(c) for c in reversed(CONCEPT_IDS)])
    stored = F.struct(F.when(F.col("o_orderpriority") == "1-URGENT", "rules-0").otherwise("rules-1").alias("version"), I.content_hash(F.col("title"), F.when(F.col("o_orderstatus") == "P", F.concat(body, F.lit("!"))).otherwise(body)).alias("content"), F.when(F.col("o_totalprice") > 300000, F.slice(full, 2, 99)).otherwise(full).alias("concepts"))
    d = postings(spark, sf).join(o, "posting_no").select("posting_no", stored.alias("stored"), I.content_hash(F.col("title"), body).alias("content"))
    return d.where(I.stale(F.col("stored"), F.lit("rules-1"), F.col("content"), CONCEPT_IDS)).select("posting_no")


@query("""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM orders WHERE o_orderkey % 10 <> 1) b FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 2) a USING (o_orderkey)
WHERE b.o_orderkey IS NULL OR a.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority""".replace("coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey", "o_orderkey"))
def snapshot_diff(spark, sf):
    o = table(spark, sf, "orders")
    after = o.where("o_orderkey % 10 <> 2").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 3, "X").otherwise(F.col("o_orderstatus")))
    return I.snapshot_diff(o.where("o_orderkey % 10 <> 1"), after, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@query("""WITH r AS (SELECT sha256(coalesce(o_orderkey::VARCHAR, '-') || '|' || coalesce(o_orderstatus, '-') || '|' || coalesce(o_orderpriority, '-')) AS h FROM orders), n AS (SELECT count(*) AS n, """ + ", ".join(f"sum(('0x' || h[{15 * k + 1}:{15 * k + 15}])::BIGINT)::HUGEINT AS s{k}" for k in range(4)) + """ FROM r) SELECT n AS n_rows, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS fingerprint FROM n""")
def dataset_fingerprint(spark, sf):
    return D.dataset_fingerprint(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query(P + """, r AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY (posting_no % 5 = 0), NOT is_available, (posting_no % 2 = 0), start_date DESC, cached_at DESC, posting_no) AS place FROM postings)
SELECT company_id, place::INT AS place, posting_no FROM r WHERE place <= 50""")
def backfill_order(spark, sf):
    """Work order of stale rows, the first 50 of each company."""
    from pyspark.sql import Window as W

    closed, seen = F.col("posting_no") % 5 == 0, F.col("posting_no") % 2 == 0
    w = W.partitionBy("company_id").orderBy(closed, ~F.col("is_available"), seen, F.desc("start_date"), F.desc("cached_at"), "posting_no")
    return postings(spark, sf).withColumn("place", F.row_number().over(w)).where("place <= 50").select("company_id", "place", "posting_no")


@query(P + """ SELECT posting_no, CASE WHEN trim(coalesce(requisition_id, '')) <> '' THEN company_id || ':' || requisition_id ELSE company_id || ':path:' || external_path END
  || coalesce(':variant:' || CASE WHEN posting_no % 17 = 0 THEN country END, '') AS stable_id FROM postings""")
def stable_id(spark, sf):
    variant = F.when(F.col("posting_no") % 17 == 0, F.col("country"))
    return postings(spark, sf).select("posting_no", I.stable_id(variant=variant).alias("stable_id"))


@query(P + """, pages_ AS (SELECT CASE WHEN posting_no % 19 = 0 THEN ' ' ELSE '/job/' || (posting_no % 9000) END AS external_path, (posting_no % 7)::BIGINT AS page, posting_no AS position, title FROM postings)
SELECT external_path, page, position, title FROM pages_ WHERE trim(external_path) <> '' QUALIFY row_number() OVER (PARTITION BY external_path ORDER BY page, position) = 1""")
def merge_listing_pages(spark, sf):
    path = F.when(F.col("posting_no") % 19 == 0, " ").otherwise(F.concat(F.lit("/job/"), (F.col("posting_no") % 9000).cast("string")))
    pages = postings(spark, sf).select(path.alias("external_path"), (F.col("posting_no") % 7).alias("page"), F.col("posting_no").alias("position"), "title")
    return I.merge_listing_pages(pages)


@query(P + """, l AS (SELECT external_path, title, primary_location FROM postings), d AS (SELECT external_path, nullif(trim(requisition_id), '') AS req, CAST(start_date AS VARCHAR) AS started, country FROM postings WHERE posting_no % 4 <> 0)
SELECT l.external_path, l.title, coalesce(d.req, 'none') AS requisition_id, CAST(d.started AS DATE) AS start_date,
  array_to_string(list_sort(list_distinct(list_filter([d.country, 'Remote, US', d.country], lambda x: x IS NOT NULL AND x <> l.primary_location))), ';') AS more_locations FROM l LEFT JOIN d USING (external_path)""")
def normalize_posting(spark, sf):
    """Listing joined with its detail: first non-empty fields, merged locations but the primary."""
    p = postings(spark, sf)
    d = p.where("posting_no % 4 <> 0").select("external_path", F.when(~I.blank(F.col("requisition_id")), F.trim("requisition_id")).alias("req"), F.col("start_date").cast("string").alias("started"), "country")
    j = p.select("external_path", "title", "primary_location").join(d, "external_path", "left")
    more = F.array_compact(F.array_distinct(F.array("country", F.lit("Remote, US"))))
    more = F.array_sort(F.array_remove(more, F.col("primary_location")))
    return j.select("external_path", "title", F.coalesce("req", F.lit("none")).alias("requisition_id"), F.to_date("started").alias("start_date"), F.array_join(more, ";").alias("more_locations"))


RAW = P + """, raw AS (SELECT company_id, 'p' || posting_no AS posting_id, requisition_id AS ref_number, CASE WHEN posting_no % 2 = 0 THEN title ELSE upper(title) END AS title,
  CASE WHEN posting_no % 3 = 0 THEN 'full' END AS employment, primary_location AS location, CAST(start_date AS VARCHAR) AS released FROM postings),
k AS (SELECT *, lower(CASE WHEN trim(coalesce(ref_number, '')) = '' THEN 'path:' || posting_id ELSE 'req:' || trim(ref_number) END) AS identity, lower(trim(title) || '|' || coalesce(employment, '')) AS signature FROM raw)"""


@query(RAW + """, m AS (SELECT company_id, identity, signature, min(posting_id) AS external_path, arg_min(title, posting_id) AS title, arg_min(location, posting_id) AS primary_location,
  list(DISTINCT location) AS ls, list(DISTINCT posting_id) AS ps, max(released) AS released, count(*) AS members FROM k GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY company_id, identity ORDER BY signature) AS variant FROM m)
SELECT company_id, identity, variant::INT AS variant, external_path, title, primary_location, array_to_string(list_sort(list_filter(ls, lambda x: x <> primary_location)), ';') AS more_locations,
  array_to_string(list_sort(list_filter(ps, lambda x: x <> external_path)), ';') AS equivalent_paths, released, members, CASE WHEN variant > 1 THEN 'path:' || external_path END AS discriminator FROM v""")
def merge_identity_variants(spark, sf):
    raw = postings(spark, sf).select(
        "company_id", F.concat(F.lit("p"), F.col("posting_no").cast("string")).alias("posting_id"), F.col("requisition_id").alias("ref_number"),
        F.when(F.col("posting_no") % 2 == 0, F.col("title")).otherwise(F.upper("title")).alias("title"), F.when(F.col("posting_no") % 3 == 0, "full").alias("employment"),
        F.col("primary_location").alias("location"), F.col("start_date").cast("string").alias("released"),
    )
    return I.merge_identity_variants(raw)


@query(P + """, k AS (SELECT *, CASE WHEN trim(coalesce(requisition_id, '')) <> '' THEN company_id || ':' || requisition_id ELSE company_id || ':path:' || external_path END AS stable_id FROM postings),
m AS (SELECT stable_id, title, min(posting_no) AS posting_no, count(*) AS members, array_to_string(list_sort(list(DISTINCT primary_location)), ';') AS locations FROM k GROUP BY stable_id, title)
SELECT stable_id, (dense_rank() OVER (PARTITION BY stable_id ORDER BY title))::INT AS variant, posting_no, members, locations FROM m""")
def canonicalize_identities(spark, sf):
    """Rows of one stable id folded into material variants (here: titles) with all locations."""
    from pyspark.sql import Window as W

    m = postings(spark, sf).withColumn("stable_id", I.stable_id()).groupBy("stable_id", "title").agg(F.min("posting_no").alias("posting_no"), F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("primary_location")), ";").alias("locations"))
    return m.select("stable_id", F.dense_rank().over(W.partitionBy("stable_id").orderBy("title")).alias("variant"), "posting_no", "members", "locations")


@query(P + """, listings AS (SELECT company_id, external_path, sha256(title || CASE WHEN posting_no % 9 = 2 THEN 'x' ELSE '' END) AS fingerprint FROM postings WHERE posting_no % 8 <> 0),
cache AS (SELECT company_id, external_path AS cached_path, sha256(title) AS old, ['/job/' || (posting_no + 1)] AS eq FROM postings WHERE posting_no % 6 <> 0),
paths AS (SELECT company_id, cached_path AS external_path, cached_path, old, 0 AS place FROM cache UNION ALL SELECT company_id, unnest(eq), cached_path, old, 1 FROM cache),
best AS (SELECT * FROM paths QUALIFY row_number() OVER (PARTITION BY company_id, external_path ORDER BY place, cached_path, old) = 1),
met AS (SELECT l.company_id, l.external_path, CASE WHEN b.cached_path IS NULL THEN 'new' WHEN b.old = l.fingerprint THEN 'hit' ELSE 'changed' END AS state, b.cached_path FROM listings l LEFT JOIN best b USING (company_id, external_path))
SELECT * FROM met UNION ALL SELECT c.company_id, c.cached_path, 'removed', c.cached_path FROM cache c WHERE NOT EXISTS (SELECT 1 FROM met WHERE met.company_id = c.company_id AND met.cached_path = c.cached_path)""")
def incremental_refresh(spark, sf):
    p = postings(spark, sf)
    now = F.sha2(F.concat("title", F.when(F.col("posting_no") % 9 == 2, "x").otherwise("")), 256)
    listings = p.where("posting_no % 8 <> 0").select("company_id", "external_path", now.alias("fingerprint"))
    next_path = F.array(F.concat(F.lit("/job/"), (F.col("posting_no") + 1).cast("string")))
    cache = p.where("posting_no % 6 <> 0").select("company_id", "external_path", F.sha2("title", 256).alias("fingerprint"), next_path.alias("equivalent_paths"))
    return I.incremental_refresh(listings, cache)


@query(P + """, c AS (SELECT company_id, external_path, posting_no % 40 = 0 AS is_new, posting_no % 3 = 0 AS preliminary_match, CASE WHEN posting_no % 5 <> 0 THEN cached_at END AS validated_at FROM postings),
r AS (SELECT *, CASE WHEN is_new THEN row_number() OVER (PARTITION BY company_id, is_new ORDER BY preliminary_match DESC, external_path) ELSE row_number() OVER (PARTITION BY company_id, is_new ORDER BY validated_at NULLS FIRST, external_path) END AS place,
  sum(is_new::INT) OVER (PARTITION BY company_id) AS n FROM c)
SELECT company_id, external_path, is_new FROM r WHERE CASE WHEN is_new THEN place <= 200 ELSE place <= least(25, greatest(200 - least(n, 200), 0)) END""")
def detail_budget(spark, sf):
    n = F.col("posting_no")
    c = postings(spark, sf).select("company_id", "external_path", (n % 40 == 0).alias("is_new"), (n % 3 == 0).alias("preliminary_match"), F.when(n % 5 != 0, F.col("cached_at")).alias("validated_at"))
    return I.detail_budget(c, 200, 25).select("company_id", "external_path", "is_new")


@query(P + " SELECT posting_no, row_number() OVER (ORDER BY is_available DESC, start_date DESC NULLS LAST, title, posting_no) AS place FROM postings")
def rank_postings(spark, sf):
    return I.ranked(postings(spark, sf).select("posting_no", "is_available", "start_date", "title"), [F.desc("is_available"), F.desc_nulls_last("start_date"), "title", "posting_no"]).select("posting_no", "place")


@query("""WITH r AS (SELECT doc_id, source || '-' || (doc_id % 300) AS key, sha256(lower(text)) AS h, n_chars AS made FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY made DESC, doc_id) AS c FROM r),
b AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY made DESC, doc_id) = 1 THEN 'kept' ELSE 'duplicate_text' END AS reason FROM a WHERE c = 1)
SELECT reason, count(*) AS n, min(doc_id) AS first_id FROM (SELECT * FROM b UNION ALL SELECT doc_id, 'duplicate_id' FROM a WHERE c > 1) GROUP BY reason""")
def dedup_population(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", F.col("doc_id") % 300).alias("key"), F.sha2(F.lower("text"), 256).alias("h"), F.col("n_chars").alias("at"))
    return I.dedup_population(r, "key", "h", "at", "doc_id").groupBy("reason").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH r AS (SELECT 'k' || (doc_id % 400) AS key, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS body, n_chars AS made, sha256(text) AS d, source FROM documents),
b AS (SELECT *, trim(body) <> '' AS has_body FROM r)
SELECT key, has_body, made AS latest_at, d AS digest, count(*) OVER w AS versions, nd AS contents, ss AS sources FROM b JOIN (SELECT key, count(DISTINCT d) AS nd, array_to_string(list_sort(list(DISTINCT source)), ',') AS ss FROM b GROUP BY key) USING (key)
WINDOW w AS (PARTITION BY key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY has_body DESC, made DESC, d DESC) = 1""")
def latest_version(spark, sf):
    r = table(spark, sf, "documents").select(F.concat(F.lit("k"), (F.col("doc_id") % 400).cast("string")).alias("key"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text")).alias("body"), F.col("n_chars").alias("at"), F.sha2("text", 256).alias("d"), "source")
    return I.latest_version(r, "key", "body", "at", "d", "source")


@query(P + """, x AS (SELECT DISTINCT 'title' AS kind, title AS value FROM postings WHERE posting_no < 20 AND posting_no % 9 = 5 UNION SELECT 'external_path', external_path FROM postings WHERE posting_no % 50 = 7)
SELECT posting_no, CASE WHEN title IN (SELECT value FROM x WHERE kind = 'title') THEN 'title' WHEN external_path IN (SELECT value FROM x WHERE kind = 'external_path') THEN 'external_path' END AS reason FROM postings""")
def exclude_known(spark, sf):
    p = postings(spark, sf)
    x = p.where("posting_no < 20 and posting_no % 9 = 5").select(F.lit("title").alias("kind"), F.col("title").alias("value")).union(p.where("posting_no % 50 = 7").select(F.lit("external_path"), "external_path"))
    return I.exclude_known(p.select("posting_no", "title", "external_path"), x, ["title", "external_path"], "posting_no").select("posting_no", "reason")


SHINGLES_SQL = """w AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS id, s FROM s WHERE len(s) > 0 GROUP BY s), e AS (SELECT id, unnest(s) AS g FROM c),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {SHINGLES_SQL}, q AS (SELECT a, b FROM p JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE k / (len(x.s) + len(y.s) - k) >= 0.8),
u AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q), r AS (SELECT id AS n, id AS t FROM c UNION SELECT r.n, u.b FROM r JOIN u ON r.t = u.a), m AS (SELECT n, min(t) AS t FROM r GROUP BY n), l AS (SELECT a, count(*) AS links FROM u GROUP BY 1)
SELECT doc_id, coalesce(c.id, doc_id) AS class_id, coalesce(links, 0)::BIGINT AS links, coalesce(m.t, doc_id) AS component_id FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN l ON l.a = c.id LEFT JOIN m ON m.n = c.id""")
def near_duplicates(spark, sf):
    return I.near_duplicates(table(spark, sf, "documents"), 0.8)
