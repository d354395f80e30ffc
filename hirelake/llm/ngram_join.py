"""Exact Jaccard self-join on word shingles by universe partitioning, and its components.

A text's set holds the hashes of its distinct word shingles.  Two sets of Jaccard ``t`` or more
differ in at most H = (1-t)/(1+t) * (|r|+|s|) shingles.  Sets are put into size bands; each
band hashes the universe of shingles into m segments.  By the pigeonhole principle r and s agree
in some segment of any choice of H+1 segments, or, in bands of small sets, differ by one
shingle at most in some segment of any choice of (H+1)/2, so that their one-deletion
neighbourhoods meet.  Every set indexes all segments of its own band.  It looks up only as many
as it needs, in its own band and in those of larger partners, and allocates these by cost:
segments that hold a rare shingle first, large ones before small ones, empty ones last.
Equal sets are one set here, known by a 64-bit fingerprint and their size.

Rows of a signature come sorted through a task and are never gathered.  In the first round each
is paired with the first look-up of its signature; exact verification and connected components
follow.  Signatures whose members are still in several components then pair them with other look-ups,
LEAD_ROUNDS times.  In the last round only pairs whose components still differ, and whose sizes and parity sketches
leave room for a link, are made, so no link that could join two components is lost, and a group of near copies costs its size, not its square.

Cases: null text: empty; an empty set links with nothing; repeated rows and copies get one class;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, freeing, only, saved, shuffle_partitions
from .words import chunks, mixed, word_hashes

PERCENT, WORDS = 85, 4
#: Band k holds sizes of up to BAND_BASE * BAND_RATIO**k; bands of small sets use deletions.
BAND_BASE, BAND_RATIO, SMALL = 5, 1.5, 48
#: Places of the fixed-size filters that are sent to the tasks: shingle counts, document ids.
COUNT_PLACES, ID_PLACES = 1 << 20, 1 << 23
#: A shingle counts as frequent from so many documents of one batch.
FREQUENT = 8
#: 64-bit words of a set's parity sketch.
SKETCH_WORDS = 16
#: A set's signatures are listed for its pairs up to so many; beyond, in so many blocks.
LISTED, BLOCKS = 64, 32
#: Times that undecided signatures pair their members with another look-up, before all pairs that are left.
LEAD_ROUNDS = 2

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _chunk_sets(data: np.ndarray, ends: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of UTF-8 texts that end at ``ends``: sorted members, and each set's size."""
    n, docs = len(data), len(ends)
    first = np.append(0, ends[:-1])
    cut = np.zeros(n + 1, dtype=bool)  # places where a text begins
    cut[first], cut[n] = True, True
    begin, _, h = word_hashes(data, ~_SPACE[data], cut)
    word_end = np.searchsorted(begin, ends)
    count = np.diff(np.append(0, word_end))
    made = np.maximum(count - words + 1, 0)
    owner = np.repeat(np.arange(docs), count)
    whole = np.flatnonzero(np.arange(len(h)) + words <= word_end[owner])
    out = np.full(len(whole), words, dtype=np.uint64)
    for k in range(words):
        out = mixed(out * _MIX + h[whole + k])
    few = np.flatnonzero((count > 0) & (count < words))
    if len(few):  # too short for a shingle: the whole sequence is one
        extra = np.empty(len(few), dtype=np.uint64)
        for i, d in enumerate(few):
            x = np.array([count[d]], dtype=np.uint64)
            for w in h[word_end[d] - count[d] : word_end[d]]:
                x = mixed(x * _MIX + w)
            extra[i] = x[0]
        out = np.insert(out, np.cumsum(made)[few], extra)
        made[few] = 1
    stop = np.cumsum(made)
    for a, b in zip(stop - made, stop):
        out[a:b].sort()
    new = np.append(True, out[1:] != out[:-1]) if len(out) else np.zeros(0, dtype=bool)
    new[(stop - made)[made > 0]] = True
    return out[new], np.add.reduceat(np.append(new, False).astype(np.int64), stop - made) * (made > 0) if docs else made


def shingle_sets(texts: pa.Array, words: int):
    """(slice, members, sizes) of the texts, chunk by chunk; null is empty."""
    for part, data, ends in chunks(texts):
        yield part, *_chunk_sets(data, ends, words)


def fingerprints(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each set: a sum of mixed members as a signed 64-bit integer, its lowest bit clear."""
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = np.add.reduceat(mixed(members ^ _MIX), (np.cumsum(sizes) - sizes)[full])
    return (out & np.uint64(2**64 - 2)).view(np.int64)


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


@functools.cache
def bands(percent: int) -> list[tuple[int, int, int, bool]]:
    """(least size, largest size, segments, deletions) of each band, up to 2**31 members."""
    out, low = [], 1
    while low < 1 << 31:
        high = max(low, int(BAND_BASE * BAND_RATIO ** len(out)))
        need = most_apart(high, high, percent) + 1
        small = high <= SMALL and need > 1
        out.append((low, high, math.ceil(need / 2) + (need > 2) if small else math.ceil(1.15 * need) if need > 1 else 1, small))
        low = high + 1
    return out


def signatures(members: np.ndarray, sizes: np.ndarray, prints: np.ndarray, rare: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, member) rows of many sets: the member is a set's fingerprint, its lowest bit
    set where it looks up. rare: by shingle."""
    table = np.array(bands(percent), dtype=np.int64)
    largest = 100 * sizes // percent
    own, last = np.searchsorted(table[:, 1], sizes), np.searchsorted(table[:, 1], largest)
    value = mixed(members ^ np.uint64(0xA5A5A5A5))
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    out_sig, out_member = [], []
    for step in range(int((last - own)[sizes > 0].max(initial=-1)) + 1):
        docs = np.flatnonzero((own + step <= last) & (sizes > 0))
        k = own[docs] + step
        m, small = table[k, 2], table[k, 3] > 0
        need = (100 - percent) * (sizes[docs] + np.minimum(table[k, 1], largest[docs])) // (100 + percent) + 1
        take = np.where(small, -(-need // 2), need)
        place = np.full(len(sizes), -1)
        place[docs] = np.arange(len(docs))
        at = place[doc_of]
        chosen = slice(None) if len(docs) == len(sizes) else np.flatnonzero(at >= 0)
        at, s, v, r = at[chosen], members[chosen], value[chosen], rare[chosen]
        first = np.cumsum(m) - m
        where = first[at] + (mixed(s + k[at].astype(np.uint64)) % m[at].astype(np.uint64)).astype(np.int64)
        bins = int(m.sum())
        size = np.bincount(where, minlength=bins)
        total = np.zeros(bins, dtype=np.uint64)
        np.add.at(total, where, v)
        has_rare = np.bincount(where[r], minlength=bins) > 0
        bin_doc = np.repeat(np.arange(len(docs)), m)
        segment = np.arange(bins) - first[bin_doc]
        # Segments with a rare shingle first, large ones before small ones, empty ones last.
        cost = (bin_doc << 34) | ((size == 0).astype(np.int64) << 33) | ((~has_rare).astype(np.int64) << 32) | ((1 << 31) - size)
        order = np.argsort(cost, kind="stable")
        probe = np.zeros(bins, dtype=bool)
        probe[order] = segment < take[bin_doc]  # sorted by set, so places within it are the same
        base = mixed(segment.astype(np.uint64) + (k[bin_doc].astype(np.uint64) << np.uint64(40)) + _MIX)
        owner = prints[docs]
        keep = slice(None) if step == 0 else probe
        out_sig.append(mixed(total + base)[keep])
        out_member.append((owner[bin_doc] | probe)[keep])
        near = small[at] & (probe[where] if step else True)
        if near.any():
            w = where[near]
            out_sig.append(mixed(total[w] - v[near] + base[w]))
            out_member.append(owner[at[near]] | probe[w])
    if not out_sig:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(out_sig).view(np.int64), np.concatenate(out_member)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Kind 0: doc_id, size and fingerprint; kind 1: the count of a frequent shingle's place."""

    def run(batches):
        for batch in batches:
            seen, sizes, prints = np.zeros(COUNT_PLACES, dtype=np.int64), [], []
            for _, members, size in shingle_sets(batch.column(1), words):
                seen += np.bincount((members % np.uint64(COUNT_PLACES)).astype(np.int64), minlength=COUNT_PLACES)
                sizes.append(size), prints.append(fingerprints(members, size))
            often = np.flatnonzero(seen >= FREQUENT)
            n, none = batch.num_rows, np.zeros(len(often), dtype=np.int64)
            ids = pa.concat_arrays([batch.column(0).cast(pa.int64()), pa.array(often, pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], [n, len(often)]), pa.int32()), ids, pa.array(np.concatenate([*sizes, seen[often]])), pa.array(np.concatenate([*prints, none]))], names=["kind", "id", "n", "fp"])

    return docs.mapInArrow(run, "kind int, id long, n long, fp long")


def _place_bits(places: DataFrame, n: int) -> np.ndarray:
    """Bitmap of a column ``place`` (0..n-1) as bytes: n/8 of them whatever the input's size."""
    p = F.col("place") + 1  # Spark's places start at 1, 32,768 to a bucket
    parts = places.groupBy(F.bitmap_bucket_number(p).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(p)).alias("bits"))
    out = np.zeros(max(n // 8, 4096), dtype=np.uint8)
    for r in parts.collect():
        out[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _bit(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether places are set."""
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0


def _signature_rows(docs: DataFrame, frequent: np.ndarray, percent: int, words: int) -> DataFrame:
    """(sig, member) of every set; copies within a batch leave one row."""

    def run(batches):
        for batch in batches:
            sent = np.zeros(0, dtype=np.int64)
            for _, members, sizes in shingle_sets(batch.column(1), words):
                prints = fingerprints(members, sizes)
                # Sets that this batch has sent before are skipped.
                _, once = np.unique(prints, return_index=True)
                fresh = np.zeros(len(sizes), dtype=bool)
                fresh[once] = ~np.isin(prints[once], sent)
                fresh &= sizes > 0
                sent = np.union1d(sent, prints[fresh])
                members, sizes, prints = members[np.repeat(fresh, sizes)], sizes[fresh], prints[fresh]
                rare = ~_bit(frequent, (members % np.uint64(COUNT_PLACES)).astype(np.int64))
                sig, member = signatures(members, sizes, prints, rare, percent)
                for k in range(0, len(sig), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(sig[k : k + (1 << 16)]), pa.array(member[k : k + (1 << 16)])], names=["sig", "member"])

    return docs.mapInArrow(run, "sig long, member long")


def _stars(sorted_rows: DataFrame) -> DataFrame:
    """Rows sorted by signature, look-ups first: (a, b, sig) with a the first look-up."""

    def run(batches):
        last_sig, lead = None, 0
        for batch in batches:
            sig, member = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(sig):
                continue
            new = np.append(True, sig[1:] != sig[:-1])
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new) - 1
            first = member[starts].copy()
            if last_sig is not None and sig[0] == last_sig:
                first[0] = lead
            leads = first[run_of]
            a, b = leads & ~np.int64(1), member & ~np.int64(1)
            good = ((leads & 1) > 0) & (a != b)
            last_sig, lead = sig[-1], leads[-1]
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[good]), pa.array(a[good]), pa.array(b[good]), pa.array((member[good] & 1) > 0)], names=["sig", "a", "b", "looks"])

    return sorted_rows.mapInArrow(run, "sig long, a long, b long, looks boolean")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (fp, s) have the Jaccard similarity asked for."""
    left = sets.select(F.col("fp").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("fp").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    sized = F.size("sa") + F.size("sb")
    return pairs.join(right, "b").join(left, "a").where(100 * both >= percent * (sized - both)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of undirected links (a, b): the smallest node of each component.

    Alternates large-star and small-star steps; each round is checkpointed.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = checkpointed(small.where("u <> v").distinct())
        # Both steps leave stars as they are, so equal edge sets mean that all are stars.
        before_sum, after_sum = (df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() for df in (edges, after))
        edges = after
        if before_sum == after_sum:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def sketches(members: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity of the members at each of SKETCH_WORDS * 64 places; two sets differ in at least as
    many members as their sketches differ in bits."""
    out = np.zeros((len(sizes), SKETCH_WORDS), dtype=np.uint64)
    place = mixed(members + np.uint64(3)) % np.uint64(64 * SKETCH_WORDS)
    np.bitwise_xor.at(out, (np.repeat(np.arange(len(sizes)), sizes), (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(fp, n, s, sketch) for wanted(fp, doc_id): one document of each; a bitmap of ids prefilters them."""
    bits = _place_bits(wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(ID_PLACES)).alias("place")).distinct(), ID_PLACES)
    keyed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(ID_PLACES)).alias("place"))

    def run(batches):
        for batch in batches:
            hit = _bit(bits, batch.column(2).to_numpy())
            if hit.any():
                part = batch.filter(pa.array(hit))
                for rows, members, sizes in shingle_sets(part.column(1), words):
                    s = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(members.view(np.int64)))
                    sketch = pa.ListArray.from_arrays(pa.array(SKETCH_WORDS * np.arange(len(sizes) + 1), pa.int32()), pa.array(sketches(members, sizes).ravel()))
                    ids = part.column(0).slice(rows.start, rows.stop - rows.start)
                    yield pa.RecordBatch.from_arrays([pa.array(fingerprints(members, sizes)), ids, pa.array(sizes), s, sketch], names=["fp", "doc_id", "n", "s", "sketch"])

    found = keyed.mapInArrow(run, "fp long, doc_id long, n long, s array<long>, sketch array<long>")
    same = (found.fp == wanted.fp) & found.doc_id.eqNullSafe(wanted.doc_id)  # a class may have no other id than null
    one = found.join(wanted, same, "left_semi").withColumn("r", F.expr("row_number() over (partition by fp order by doc_id)"))
    return one.where("r = 1").drop("r", "doc_id")


def linked(documents: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row."""
    docs = only(documents, doc_id=id_col, text=text_col)
    with freeing(documents.sparkSession):
        rows, classes, roots = _linked(docs, percent, words)
    grouped = classes.join(roots, classes.fp == roots.node, "left").select("fp", "n_shingles", "doc_id", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = grouped.join(smallest, "root").select("fp", "n_shingles", "component_id")
    return rows.join(by_class, ["fp", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _linked(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, fp), classes (fp, n_shingles, doc_id) and the components (node, root) of classes."""
    spark = docs.sparkSession
    first = saved(_sets(docs, words), "shingle-sets")
    rows = first.where("kind = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "fp")
    frequent = _place_bits(first.where("kind = 1").select(F.col("id").alias("place")).distinct(), COUNT_PLACES)
    classes = rows.where("n_shingles > 0").groupBy("fp", "n_shingles").agg(F.min("doc_id").alias("doc_id"))

    parts = max(shuffle_partitions(spark), 1)
    ordered = _signature_rows(docs, frequent, percent, words).repartition(parts, "sig").sortWithinPartitions("sig", (F.col("member") % 2 == 0), "member")
    stars = saved(_stars(ordered), "signature-stars")

    pairs = checkpointed(stars.select("a", "b").distinct())
    fps = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = checkpointed(classes.select("fp", "doc_id").join(fps, "fp"))
    sets = saved(_sets_of(docs, wanted, words), "signature-sets")
    links = checkpointed(verified(pairs, sets, percent))
    roots = components(links)
    for k in range(LEAD_ROUNDS):
        more = checkpointed(verified(_led(stars, roots, sets, percent, k), sets, percent))
        if more.isEmpty():
            break
        roots = joined(roots, more)
    rest = checkpointed(_apart(stars, roots, sets, percent))
    if not rest.isEmpty():
        roots = joined(roots, verified(rest, sets, percent))
    return rows, classes, roots


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, root) with more links (a, b)."""
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def _undecided(stars: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, fp, looks, root) of the signatures whose members are in several components."""
    lead = stars.select("sig", F.col("a").alias("fp"), F.lit(True).alias("looks")).distinct()
    members = lead.union(stars.select("sig", F.col("b").alias("fp"), "looks"))
    named = members.join(roots, members.fp == roots.node, "left").select("sig", "fp", "looks", F.coalesce("root", "fp").alias("root"))
    several = named.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi and n > 2").select("sig")
    return named.join(several, "sig", "left_semi")


def _may_link(x: str, y: str, percent: int):
    """Whether components differ and sizes and sketches leave room for a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    apart = F.aggregate(F.zip_with(f"{x}.sketch", f"{y}.sketch", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, v: t + v)
    return (F.col(f"{x}.root") != F.col(f"{y}.root")) & (F.least(n, m) * 100 >= percent * F.greatest(n, m)) & (apart * (100 + percent) <= (100 - percent) * (n + m))


def _led(stars: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (a, b) of each signature's members with one of its look-ups, another one each turn."""
    some = checkpointed(_undecided(stars, roots).join(sets.select("fp", "n", "sketch"), "fp"))
    lead = some.where("looks").groupBy("sig").agg(F.min_by(F.struct("fp", "root", "n", "sketch"), F.xxhash64("fp", "sig", F.lit(turn))).alias("x"))
    both = some.alias("y").join(lead, "sig").where(_may_link("x", "y", percent))
    return both.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def _apart(stars: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of one signature, a look-up among them, that may be linked and weren't tried.

    Their components differ, and their sizes and sketches leave room for a link; signatures
    whose members are all in one component make no pair.
    """
    some = checkpointed(_undecided(stars, roots))
    # A pair comes from the smallest signature that one looks up and the other has, so that it
    # comes once. Sets with more signatures than LISTED list only those of the same block as the
    # row's own, so that their pairs come once a block.
    looked = F.collect_set(F.when(F.col("looks"), F.col("sig")))
    listed = some.groupBy("fp").agg(F.collect_set("sig").alias("has"), looked.alias("asks"), F.count("*").alias("k"))
    listed = listed.select("fp", *[F.when(F.col("k") <= LISTED, F.col(c)).alias(c) for c in ("has", "asks")])
    some = some.withColumn("block", F.pmod("sig", F.lit(BLOCKS)))
    blocks = some.groupBy("fp", "block").agg(F.collect_set("sig").alias("block_has"), looked.alias("block_asks"))
    some = some.join(sets.select("fp", "n", "sketch"), "fp").join(listed, "fp").join(blocks, ["fp", "block"])
    x, y = some.where("looks").alias("x"), some.alias("y")
    near = _may_link("x", "y", percent)
    short = F.col("x.asks").isNotNull() & F.col("y.has").isNotNull()
    first = F.when(short, F.array_min(F.array_intersect("x.asks", "y.has"))).otherwise(F.array_min(F.array_intersect("x.block_asks", "y.block_has")))
    both = x.join(y, (F.col("x.sig") == F.col("y.sig")) & near & (first == F.col("x.sig")))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return both.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
