"""Thresholds of several folds within one budget, against every combination."""

import itertools
import random

import pytest

from hirelake.operators import metrics


def exhaustive(rows, budget):
    folds = sorted({r[0] for r in rows})
    options = []
    for f in folds:
        mine = [r for r in rows if r[0] == f]
        marks = sorted({s for _, s, a in mine if a})
        options.append([(f, t, sum(s < t for _, s, _ in mine), sum(s < t and a for _, s, a in mine)) for t in marks] or [(f, None, 0, 0)])
    fits = [c for c in itertools.product(*options) if sum(o[3] for o in c) <= budget]
    return min(fits, key=lambda c: (-sum(o[2] for o in c), sum(o[3] for o in c), [o[1] is not None and o[1] for o in c]))


@pytest.mark.parametrize("seed", range(6))
def test_frontier_against_every_combination(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), rng.randrange(12) / 12, rng.random() < 0.5) for _ in range(60)]
    if seed == 5:
        rows = [(f, s, a and f != 1) for f, s, a in rows]
    budget = rng.randrange(7)
    got = sorted(map(tuple, metrics.fold_frontier(spark.createDataFrame(rows, "fold int, score double, actual boolean"), budget).collect()))
    best = exhaustive(rows, budget)
    assert got == [(*o, sum(x[2] for x in best), sum(x[3] for x in best)) for o in best]


def test_frontier_of_ten_folds(spark):
    rows = spark.range(4000).selectExpr("cast(id % 10 as int) as fold", "(id * 7919 % 1009) / 1009.0D as score", "id % 3 = 0 as actual")
    got = metrics.fold_frontier(rows, 50).collect()
    assert len(got) == 10 and got[0].total_false_rejects == sum(r.false_rejects for r in got) <= 50
    assert got[0].total_rejects == sum(r.rejects for r in got)
    for r in got:
        assert rows.where(f"fold = {r.fold} and score < {r.threshold!r}").count() == r.rejects
    assert metrics.fold_frontier(rows.where("1 = 0"), 3).count() == 0
