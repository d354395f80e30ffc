"""Centroid clustering, importance resampling and toxicity: odd inputs and brute-force versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import LONG, ODD, SF, docs

from hirelake.llm import centroids, common, importance, queries, toxicity


def brute_clusters(rows, clusters, rounds):
    """vec_id -> (cluster, distance) by plain integer arithmetic, and the centroids."""
    key = lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    whole = [(i, [math.floor(256 * v) for v in x]) for i, x in rows]
    centers = [x for _, x in sorted(whole, key=key)[:clusters]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        at = [near(x)[1] for _, x in whole]
        for k in range(len(centers)):
            mine = [x for (_, x), c in zip(whole, at) if c == k]
            if mine:
                centers[k] = [sum(v) // len(mine) for v in zip(*mine)]
    return sorted((i, *near(x)[::-1]) for i, x in whole), centers


@pytest.mark.parametrize("seed", range(3))
def test_clusters_by_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    points = (rng.normal(size=(6, 8))[rng.integers(0, 6, 120)] + 0.3 * rng.normal(size=(120, 8))).astype(np.float32)
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    rows += [(200, rows[0][1]), (200, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    common.ship(spark)
    found, centers = centroids.clustered(df, clusters=9, rounds=4, dimensions=8)
    expected, plain = brute_clusters(rows, 9, 4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == expected
    assert centers.tolist() == plain


def test_dot_products_stay_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3000, 3000, (40, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, x array<int>")
    common.ship(spark)
    centers = rng.integers(-3000, 3000, (5, 16))
    state = centroids.begun(df, centers)
    for _ in range(3):
        new = centers.copy()
        new[rng.integers(0, 5), rng.integers(0, 16, 4)] += rng.integers(-500, 500, 4)
        state, centers = common.saved(centroids.moved(state, centers, new), "test"), new
    for r in state.collect():
        assert r.dots == (np.array(r.x) @ centers.T).tolist()
        assert r.distance == min(((np.array(r.x) - c) ** 2).sum() for c in centers)


def test_odd_vectors(spark):
    v = [0.1] * 64
    rows = [(1, v), (1, v), (None, v), (2, None), (3, [0.1] * 63), (4, [None, *v[1:]]), (5, [float("nan"), *v[1:]]), (6, [float("inf"), *v[1:]]), (7, [0.0] * 64), (8, [-1e-9] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("x", "cluster", "dots", "before")})
    common.ship(spark)
    got = centroids.report(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 2, None: 1, 7: 1, 8: 1}
    assert {r.inertia for r in got} == {0}
    assert centroids.report(df.where("1 = 0")).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.report(spark.createDataFrame([(1, [1e9] * 64)], df.select("vec_id", "embedding").schema)).collect()


def brute_importance(texts, target, longest, buckets, percent, least):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    runs = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in texts for f in runs(split(t)))
    t = Counter(bucket(f) for x in target for f in runs(split(x)))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc, text in texts:
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in runs(split(text)))
        out.append([doc, len(split(text)), len(runs(split(text))), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    n = percent * len(enough) // 100
    return sorted(([*r, None] for r in out if r[1] < least), key=repr) + [[*r, k + 1 if k < n else None] for k, r in enumerate(enough)]


@pytest.mark.parametrize(("longest", "least"), [(1, 20), (2, 3), (3, 0)])
def test_importance_by_brute_force(spark, longest, least, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 50)
    common.ship(spark)
    texts = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").limit(60).collect()] + [(r[0], r[1]) for r in ODD]
    target = [r.text for r in common.table(spark, SF, "benchmark").select("text").collect()] + [None]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = importance.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50, least_words=least, buckets=500, longest=longest)
    expected = brute_importance(texts, target, longest, 500, 50, least)
    assert sorted(map(list, got.collect()), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_words_in_pieces(piece, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", piece)
    text = "Éa été-B c3 \x7f ÀÉ\n  zz"
    assert [w.decode() for some in importance.words(text) for w in some] == ["Éa", "été", "b", "c3", "ÀÉ", "zz"]
    pairs = [r for some in importance.runs(text, 2) for r in some]
    assert len(pairs) == 11 and (b"b", b"c3") in pairs


def test_importance_of_odd_documents(spark):
    target = spark.createDataFrame([(1, "the dog")], "item_id long, text string")
    got = importance.resampled(docs(spark), target).collect()
    assert len(got) == len(ODD) and [r.rank for r in got if r.n_words < 20] == [None] * (len(ODD) - 1)
    assert importance.resampled(docs(spark).where("1 = 0"), target).count() == 0
    assert importance.resampled(docs(spark), target.where("1 = 0"), percent=100, least_words=1).where("rank is not null").count() == 5


def spoken(spark, n=900, seed=3):
    """Invented words; a third of the texts hold some of six bad ones, a few are copies."""
    rng = np.random.default_rng(seed)
    plain = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(400)]
    bad = ["grobuk", "vestmur", "qualzik", "drunvex", "hythor", "wyzzlim"]
    rows = []
    for i in range(n):
        ws = list(rng.choice(plain, rng.integers(30, 120)))
        toxic = i % 3 == 0
        for at in rng.integers(0, len(ws), 3 if toxic else 0):
            ws[at] = rng.choice(bad)
        rows.append((i, " ".join(ws), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    common.ship(spark)
    return df.select("doc_id", "text"), df.select("doc_id", "toxic"), {r[0]: r[2] for r in rows}


def test_toxicity_on_held_out_rows(spark):
    documents, labels, truth = spoken(spark)
    got = [r for r in toxicity.classified(documents, labels).collect() if r.held_out]
    right = [r.predicted == truth[r.doc_id] for r in got]
    assert len(got) > 150 and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_held_out_labels_teach_nothing(spark):
    documents, labels, truth = spoken(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = (sorted((r.doc_id, r.score) for r in toxicity.classified(documents, x).collect()) for x in (labels, turned))
    assert one == other


def test_windows_and_advantages():
    import zstandard

    pair = toxicity.Pair(b" zebra quokka ", b" house garden ")
    some = [w for x in toxicity.windows("The zebra saw a quokka in the house garden. " * 3 + "x" * 1000) for w in x]
    assert b"".join(w[len(toxicity.LEAD) :] for w in some).count(b"x" * 64) == 15
    parameters = zstandard.ZstdCompressionParameters(**toxicity.PARAMETERS)
    sizes = []
    for content in (b" house garden ", b" zebra quokka "):
        held = zstandard.ZstdCompressionDict(content + toxicity.LEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append([len(zstandard.ZstdCompressor(compression_params=parameters, dict_data=held).compress(w)) for w in some])
    assert pair.advantages(some).tolist() == [a - b for a, b in zip(*sizes)]


def test_toxicity_of_odd_documents(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (4, 1), (4, 0), (None, 1), (5, None), (99, 0)], "doc_id long, toxic int")
    for d in (docs(spark), docs(spark).where("1 = 0")):
        for marked in (labels, labels.where("1 = 0"), labels.where("toxic = 1")):
            got = toxicity.classified(d, marked).collect()
            assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    documents, marks, _ = spoken(spark, 300)
    odd = documents.union(spark.createDataFrame([(1000, None), (1001, ""), (None, LONG), (3, "grobuk")], documents.schema)).withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.classified(odd, marks).collect()}
    assert got[1000].score == got[1001].score < 0.3


def test_query_columns(spark):
    for name, columns in {"op11_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256", "op12_importance": "doc_id n_features weight score rank", "op13_toxicity": "doc_id held_out score predicted"}.items():
        assert queries.QUERIES[name](spark, SF).columns == columns.split()
