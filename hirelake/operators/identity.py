"""Identity, fingerprints, deduplication and refresh of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hirelake.functions.text import shingles
from hirelake.operators.clusters import cluster_components, written


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def stable_id(company: str = "company_id", requisition: str = "requisition_id", path: str = "external_path", variant: Column | None = None) -> Column:
    """company:requisition, or company:path:… without one, and a variant's suffix."""
    base = F.when(~blank(F.col(requisition)), F.concat_ws(":", company, requisition)).otherwise(F.concat_ws(":", company, F.lit("path"), path))
    return base if variant is None else F.concat(base, F.coalesce(F.concat(F.lit(":variant:"), variant), F.lit("")))


def listing_fingerprint(path: str = "external_path", title: str = "title", location: str = "primary_location", bullet: str = "requisition_id", extra: Column | None = None) -> Column:
    """Digest of a listing without its relative age text."""
    parts = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in (path, title, location, bullet)]
    more = F.lit("") if extra is None else F.array_join(F.array_sort(extra), "\n")
    return F.sha2(F.concat_ws("\n", *parts, more), 256)


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, text), 256)


def classification_fingerprint(content: Column, ruleset: str, taxonomy: str) -> Column:
    return F.sha2(F.concat_ws("\n", content, F.lit(ruleset), F.lit(taxonomy)), 256)


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def merge_listing_pages(pages: DataFrame) -> DataFrame:
    """Rows of all pages once per path, by page and position; blank paths go."""
    return first_per(pages.where(~blank(F.col("external_path"))), ["external_path"], "page", "position")


def latest_version(rows: DataFrame, key: str, body: str, at: str, digest: str, source: str) -> DataFrame:
    """One row per key: with a body first, then the newest, then by digest; and what there was.

    The pick is a max over one struct, so a key's rows are folded before they are shuffled.
    """
    rank = F.struct((~blank(F.col(body))).alias("has_body"), F.col(at).alias("at"), F.col(digest).alias("digest"))
    return rows.groupBy(key).agg(
        F.max(rank).alias("best"), F.count("*").alias("versions"), F.count_distinct(digest).alias("contents"), F.array_sort(F.collect_set(source)).alias("sources")
    ).select(key, "best.has_body", F.col("best.at").alias("latest_at"), F.col("best.digest").alias("digest"), "versions", "contents", F.array_join("sources", ",").alias("sources"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change) of keys added, removed or changed in any field."""
    hashed = lambda df, name: df.select(key, F.sha2(F.to_json(F.struct(*fields)), 256).alias(name))
    both = hashed(before, "old").join(hashed(after, "new"), key, "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def input_fingerprint(rows: DataFrame, column: str) -> Column:
    """SHA-256 over every leaf of a struct column, nested ones in place, each with its length; null is ``-``."""

    def leaves(name: str, kind) -> list[Column]:
        if hasattr(kind, "fields"):
            return [c for f in kind.fields for c in leaves(f"{name}.`{f.name}`", f.dataType)]
        text = F.col(name).cast("string")
        return [F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))]

    return F.sha2(F.concat_ws(",", *leaves(column, rows.schema[column].dataType)), 256)


def stale(stored: Column, version: Column, content: Column, concepts: list[str]) -> Column:
    """Whether a stored struct (version, content, concepts) no longer equals what is current; its set must be complete."""
    whole = F.coalesce(F.array_sort(F.array_distinct(stored["concepts"])) == F.array(*[F.lit(c) for c in sorted(concepts)]), F.lit(False))
    return ~(stored["version"].eqNullSafe(version) & stored["content"].eqNullSafe(content) & whole)


def dedup_population(rows: DataFrame, key: str, text_hash: str, at: str, tie: str) -> DataFrame:
    """Every row with why it is dropped (older copy of its id, then of its text) or kept."""
    by_key = W.partitionBy(key).orderBy(F.desc(at), tie)
    marked = rows.withColumn("copy", F.row_number().over(by_key))
    kept = marked.where("copy = 1").withColumn("twin", F.row_number().over(W.partitionBy(text_hash).orderBy(F.desc(at), tie)))
    kept = kept.withColumn("reason", F.when(F.col("twin") == 1, "kept").otherwise("duplicate_text")).drop("twin", "copy")
    return kept.unionByName(marked.where("copy > 1").withColumn("reason", F.lit("duplicate_id")).drop("copy"))


def exclude_known(rows: DataFrame, exclusions: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Each row with the reason why it is excluded, or null; one join over all kinds of (kind, value).

    A row is excluded by any of its keys (columns); the first in ``keys`` that matches is its reason.
    """
    each = rows.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for i, k in enumerate(keys)])).alias("k"))
    hits = each.select("*", "k.i", "k.kind", "k.value").join(exclusions.select("kind", "value").distinct(), ["kind", "value"])
    first = hits.groupBy(id_col).agg(F.min_by("kind", "i").alias("reason"))
    return rows.join(first, id_col, "left")


def merge_identity_variants(rows: DataFrame) -> DataFrame:
    """Per company identity and title/reference signature one row; a discriminator from the second.

    rows: company_id, posting_id, ref_number, title, employment, location, released.
    """
    identity = F.lower(F.when(blank(F.col("ref_number")), F.concat(F.lit("path:"), F.trim("posting_id"))).otherwise(F.concat(F.lit("req:"), F.trim("ref_number"))))
    signature = F.lower(F.concat_ws("|", F.trim("title"), F.coalesce("employment", F.lit(""))))
    keyed = rows.withColumns({"identity": identity, "signature": signature, "posting_id": F.trim("posting_id")})
    members = keyed.groupBy("company_id", "identity", "signature").agg(
        F.min(F.struct("posting_id", "title", "location")).alias("first"),
        F.collect_set("location").alias("locations"), F.collect_set("posting_id").alias("paths"), F.max("released").alias("released"), F.count("*").alias("members"),
    )
    rank = F.row_number().over(W.partitionBy("company_id", "identity").orderBy("signature"))
    return members.withColumn("variant", rank).select(
        "company_id", "identity", "variant", F.col("first.posting_id").alias("external_path"), F.col("first.title").alias("title"), F.col("first.location").alias("primary_location"),
        F.array_join(F.array_sort(F.array_remove("locations", F.col("first.location"))), ";").alias("more_locations"),
        F.array_join(F.array_sort(F.array_remove("paths", F.col("first.posting_id"))), ";").alias("equivalent_paths"),
        "released", "members", F.when(F.col("variant") > 1, F.concat(F.lit("path:"), "first.posting_id")).alias("discriminator"),
    )


def incremental_refresh(listings: DataFrame, cache: DataFrame) -> DataFrame:
    """(company_id, external_path, state) of listings and cached rows: hit, changed, new or removed.

    A listing meets a cached row by its path or by one of the row's equivalent paths; the row's
    own path wins over equivalents, then the smallest path.
    """
    paths = cache.select("company_id", F.col("external_path").alias("cached_path"), F.col("fingerprint").alias("old"), F.posexplode(F.concat(F.array("external_path"), F.coalesce("equivalent_paths", F.expr("cast(array() as array<string>)")))).alias("place", "external_path"))
    best = paths.groupBy("company_id", "external_path").agg(F.min(F.struct(F.least("place", F.lit(1)).alias("place"), "cached_path", "old")).alias("c"))
    met = listings.select("company_id", "external_path", "fingerprint").join(best, ["company_id", "external_path"], "left")
    state = F.when(F.col("c").isNull(), "new").when(F.col("c.old") == F.col("fingerprint"), "hit").otherwise("changed")
    listed = met.select("company_id", "external_path", state.alias("state"), F.col("c.cached_path").alias("cached_path"))
    seen = listed.where("cached_path is not null").select("company_id", "cached_path").distinct()
    gone = cache.select("company_id", F.col("external_path").alias("cached_path")).join(seen, ["company_id", "cached_path"], "left_anti")
    return listed.unionByName(gone.select("company_id", F.col("cached_path").alias("external_path"), F.lit("removed").alias("state"), "cached_path"))


def detail_budget(candidates: DataFrame, details: int, revalidations: int, per: str = "company_id") -> DataFrame:
    """Which rows to fetch per company: new rows first, then the oldest within what is left.

    Ranks beyond the limits are cut in every task before rows move; only counts need all rows.
    """
    rank = lambda *o: F.row_number().over(W.partitionBy(per, "is_new").orderBy(*o))
    news = candidates.groupBy(per).agg(F.count_if("is_new").alias("__new"))
    first = candidates.where("is_new").withColumn("place", rank(F.desc("preliminary_match"), "external_path")).where(F.col("place") <= details)
    known = candidates.where("not is_new").withColumn("place", rank(F.asc_nulls_first("validated_at"), "external_path")).where(F.col("place") <= revalidations)
    left = F.least(F.lit(revalidations), F.greatest(F.lit(details) - F.least("__new", F.lit(details)), F.lit(0)))
    chosen = known.join(news, per).where(F.col("place") <= left).drop("__new")
    return first.unionByName(chosen)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """The rows with their ``place`` (from 1) in one order of all of them.

    A range sort deals the order over all tasks; each row's place is its place in its part plus the parts before it,
    of which only the counts are summed up.
    """
    part = rows.sort(*order).withColumn("__part", F.spark_partition_id())
    sorted_rows = written(part.withColumn("__in", F.monotonically_increasing_id()), "ranked")
    counts = sorted_rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))  # one row a part
    inside = F.col("__in") - F.col("__part").cast("long") * F.lit(1 << 33)  # ids count from 0 in each part
    return sorted_rows.join(F.broadcast(starts), "__part").withColumn("place", F.col("__before") + inside + 1).drop("__part", "__in", "__before")


def near_duplicates(docs: DataFrame, threshold: float, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its class (equal shingle sets, by the smallest id), the class's links to classes of
    Jaccard similarity ``threshold`` or more, and the smallest id that links reach.

    Documents without a word are a class, and a component, of their own.
    """
    hashes = F.array_sort(F.transform(shingles(F.col(text_col), size), lambda s: F.xxhash64(s)))
    known = docs.select(F.col(id_col).alias("id"), hashes.alias("s"))
    # A class is known by two hashes of its sorted set; the set itself is carried by one row of it.
    keyed = known.select("id", F.size("s").alias("n"), F.xxhash64("s").alias("k1"), F.xxhash64("s", F.lit(1)).alias("k2"), "s")
    classes = keyed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("class_id"), F.any_value("s").alias("s"))
    classes = written(classes, "duplicate-classes")
    pairs = written(similar_sets(classes.select(F.col("class_id").alias("id"), "n", "s"), threshold), "duplicate-pairs")
    ends = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = ends.groupBy(F.col("a").alias("class_id")).agg(F.count("*").alias("links"))
    found = cluster_components(pairs.select("a", "b")).withColumnRenamed("node", "class_id")
    by_class = classes.select("k1", "k2", "n", "class_id").join(links, "class_id", "left").join(found, "class_id", "left")
    out = keyed.select("id", "k1", "k2", "n").join(by_class, ["k1", "k2", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("cluster", "class_id", "id").alias("component_id"))


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of different sets (id, n, s).

    Candidates share one of their rarest members: sets ordered by corpus frequency meet in their first
    n - ceil(t n) + 1 members, of which those that no other set has can't meet and only use up places.
    """
    each = sets.select("id", "n", F.explode("s").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(shared, "h")
    own = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("m"))
    room = F.col("n") - F.ceil(F.col("n") * threshold) + 1 - (F.col("n") - F.size("m"))
    prefix = own.where(room > 0).select("id", "n", F.explode(F.slice("m", F.lit(1), room.cast("int"))).alias("m")).select("id", "n", "m.h")
    x, y = prefix.alias("x"), prefix.alias("y")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id"))).where(F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("similarity", common / (F.size("sa") + F.size("sb") - common)).where(F.col("similarity") >= threshold).select("a", "b", "similarity")
