"""Mixing: the plans of raking stay small."""

from __future__ import annotations

from hirelake.llm import common, mixing


def test_a_raking_step_reads_its_tables_a_bounded_number_of_times(spark, monkeypatch):
    """Plans that read the cells eight times a sweep filled the driver."""
    common.ship(spark)
    cells = spark.createDataFrame([(s, g, t, 1 + 3 * i + 5 * j * k) for i, s in enumerate("abc") for j, g in enumerate("de") for k, t in enumerate("fg")], "source string, lang string, topic string, tokens long")
    wanted = mixing.targets(mixing.checkpointed(cells), mixing.TEMPERATURE)
    goal = {m: {r[0]: r.share for r in df.collect()} for m, df in wanted.items()}
    leaves = []

    def spied(df):
        leaves.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return common.checkpointed(df)

    monkeypatch.setattr(mixing, "checkpointed", spied)
    got = mixing.raked(cells, wanted).toPandas()
    assert max(leaves[4:]) <= 3  # behind the cells and the three margins
    for m, shares in goal.items():
        sums = got.groupby(m).weight.sum()
        assert all(abs(sums[v] - share) <= mixing.TOLERANCE * share for v, share in shares.items())
