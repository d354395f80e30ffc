"""Streams that stop and go on: state, late rows, buckets."""

import datetime
import os

import pytest

from hirelake.operators import history
from hirelake.sources.cache import scratch
from hirelake.streaming import jobs

START = datetime.datetime(2024, 3, 1)


def hours(n):
    return START + datetime.timedelta(hours=n)


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).parquet(path)


EVENTS = "job_id long, at timestamp, event_id long, to_state string"
STATES = ["saved", "applied", "closed", "hidden", "normal", "nonsense", None]


def moves(n):
    return [(i * 7 % 5, hours(i / 3), i, STATES[i * 11 % 13 % 7]) for i in range(n)]


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_workflow_goes_on(spark, seconds):
    """Stopped after half the events and started again, the states are those of all events at once."""
    path, rows = scratch(spark, "test-workflow"), moves(300)
    for part in (rows[:150][::-1], rows[150:230], [], rows[230:]):
        add(spark, f"{path}/in", part, EVENTS)
        states = jobs.stream_workflow(stream(spark, f"{path}/in", EVENTS), path, seconds)
    plain = history.fold_workflow(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, states.collect())) == sorted(map(tuple, plain.collect()))
    assert {r.job_id for r in states.collect()} == set(range(5))


def test_workflow_of_odd_events(spark):
    path = scratch(spark, "test-workflow")
    rows = [(None, hours(1), 1, "saved"), (1, None, 2, "saved"), (2, hours(1), None, "applied"), (2, hours(1), 3, None), (2, hours(1), 3, None), (3, hours(2), 4, "closed")]
    add(spark, f"{path}/in", rows, EVENTS)
    got = {r.job_id: r for r in jobs.stream_workflow(stream(spark, f"{path}/in", EVENTS), path).collect()}
    assert set(got) == {2, 3}
    assert (got[2].state, got[2].applied_at, got[2].ignored, got[2].events) == ("applied", hours(1), 2, 3)
    assert (got[3].state, got[3].ignored) == ("normal", 1)
    assert sorted(map(tuple, jobs.workflow_states(spark, path).collect())) == sorted(map(tuple, got.values()))


SEEN = "key string, ts timestamp"


def test_discovery_with_late_and_repeated_keys(spark):
    path = scratch(spark, "test-discovery")

    def after(*rows):
        add(spark, f"{path}/in", rows, SEEN)
        return sorted(r.key for r in jobs.stream_discovery(stream(spark, f"{path}/in", SEEN), hours(0), path, "2 hours").collect())

    assert after(("a", hours(1)), ("a", hours(2)), ("old", hours(-1)), (None, hours(1))) == ["a"]
    assert after(("a", hours(1)), ("b", hours(9))) == ["a", "b"]
    # The watermark stands at 9 - 2 hours: an observation before it is too late, one after it isn't.
    assert after(("late", hours(3)), ("c", hours(8)), ("b", hours(10))) == ["a", "b", "c"]
    assert after(("d", hours(30))) == ["a", "b", "c", "d"]
    assert after(("b", hours(31))) == ["a", "b", "b", "c", "d"]  # forgotten since
    assert jobs.drained(stream(spark, f"{path}/in", SEEN).where("1 = 0"), scratch(spark, "test-empty")).count() == 0


LISTING = "company_id string, external_path string, title string, at long"


def refreshed(spark, path, rows, scope=None):
    add(spark, f"{path}/in", rows, LISTING)
    got = jobs.stream_refresh(stream(spark, f"{path}/in", LISTING), path, ["title"], ["at"], scope, buckets=8)
    return sorted((r.batch, r.external_path, r.change) for r in got.collect())


def parts(path):
    folder = f"{path}/cache".removeprefix("file://")
    return {d: sorted(f for f in os.listdir(f"{folder}/{d}") if f.startswith("part-")) for d in os.listdir(folder) if d.startswith("bucket=")}


def cached(spark, path):
    return sorted((r.external_path, r.title, r.is_available) for r in spark.read.parquet(f"{path}/cache").collect())


def test_refresh_writes_touched_buckets_only(spark):
    path = scratch(spark, "test-refresh")
    rows = [("c", f"/{k}", f"t{k}", 1) for k in range(40)]
    assert len(refreshed(spark, path, rows)) == 40
    first = parts(path)
    assert len(first) == 8
    got = refreshed(spark, path, [("c", "/7", "old", 2), ("c", "/7", "new", 3), ("c", "/8", "t8", 3), (None, "/9", "x", 1), ("c", None, "x", 1)])
    assert got[40:] == [(1, "/7", "changed")]
    second = parts(path)
    assert sum(first[d] != second[d] for d in first) == 1
    assert ("/7", "new", True) in cached(spark, path) and len(cached(spark, path)) == 40
    assert refreshed(spark, path, []) == got  # a run without a new row


def test_refresh_of_whole_scopes(spark):
    path = scratch(spark, "test-refresh")
    refreshed(spark, path, [("c", "/1", "a", 1), ("c", "/2", "b", 1), ("d", "/3", "c", 1)], ["company_id"])
    got = refreshed(spark, path, [("c", "/2", "b", 2)], ["company_id"])
    assert got[3:] == [(1, "/1", "removed")]
    assert cached(spark, path) == [("/1", "a", False), ("/2", "b", True), ("/3", "c", True)]
    got = refreshed(spark, path, [("c", "/1", "a", 3), ("c", "/2", "b", 3)], ["company_id"])
    assert got[4:] == [(2, "/1", "changed")]
    assert cached(spark, path) == [("/1", "a", True), ("/2", "b", True), ("/3", "c", True)]


def test_refresh_runs_a_batch_again(spark):
    """Changes that were written before a crash are taken as they are; the cache ends the same."""
    path = scratch(spark, "test-refresh")
    refreshed(spark, path, [("c", "/1", "a", 1), ("c", "/2", "b", 1)])
    got = refreshed(spark, path, [("c", "/2", "new", 2), ("c", "/4", "d", 2)])
    state = f"{path}/state/commits".removeprefix("file://")
    for name in ("1", ".1.crc"):  # as if the driver had died before it noted the end of the batch
        os.remove(f"{state}/{name}")
    before = cached(spark, path)
    again = jobs.stream_refresh(stream(spark, f"{path}/in", LISTING), path, ["title"], ["at"], None, buckets=8)
    assert sorted((r.batch, r.external_path, r.change) for r in again.collect()) == got
    assert cached(spark, path) == before == [("/1", "a", True), ("/2", "new", True), ("/4", "d", True)]


def test_rule_usage_of_nothing(spark):
    path = scratch(spark, "test-usage")
    add(spark, f"{path}/in", [], "event_type string, ts timestamp")
    s = stream(spark, f"{path}/in", "event_type string, ts timestamp").withWatermark("ts", "1 hour")
    assert jobs.drained(jobs.stream_rule_usage(s), path).count() == 0
    assert jobs.stream_rule_usage(s).columns == ["window_start", "rule_id", "matches"]
