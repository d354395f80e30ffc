"""Continuous jobs: rule counters, discovery of new keys, workflow state, refresh batches.

Each job takes the folder that holds its progress.  A job that is started again on its folder goes on where it
ended; a batch that was cut off runs again and leaves what it would have left.  The folder must be one that driver and
executors share.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hirelake.operators.history import TRANSITIONS, composed
from hirelake.operators.identity import incremental_refresh, snapshot_diff
from hirelake.sources.cache import exists, scratch

#: Seconds of a job's events that share one state.
STRETCH = 86_400
#: Parts of a refreshed cache.
BUCKETS = 64
#: Bytes of files that a batch reads at most.
BATCH_BYTES = 4 << 30
#: Columns of a table of workflow states.
WORKFLOW = "job_id long, state string, applied_at timestamp, closed_at timestamp, ignored long, events long"
UNCHANGED, CLEARED = -1, -2
STATES = tuple(TRANSITIONS)


def events_stream(spark: SparkSession, sf_dir: str, late: str | None = "1 hour") -> DataFrame:
    """The events table as a file stream, with a watermark unless ``late`` is None."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxBytesPerTrigger", BATCH_BYTES).parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream if late is None else stream.withWatermark("ts", late)


def drained(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there, into a Parquet table below ``path``, and read it."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def stream_rule_usage(events: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Matches of each rule in tumbling windows."""
    return events.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("rule_id")).agg(F.count("*").alias("matches")).select(F.col("w.start").alias("window_start"), "rule_id", "matches")


def stream_discovery(observations: DataFrame, start, path: str, late: str = "60 days") -> DataFrame:
    """(key, ts) of observations (key, ts) after the ledger's start, each key once; what all runs on ``path`` found.

    The state store holds the keys that were seen within ``late`` of the newest observation and forgets older ones, so
    that a batch costs what it and the store hold, not what earlier batches wrote.  An observation that is later than
    ``late`` is dropped; a key that comes again after so long counts as new.
    """
    fresh = observations.where(F.col("ts") > F.lit(start)).where("key is not null").select("key", "ts").withWatermark("ts", late)
    return drained(fresh.dropDuplicatesWithinWatermark(["key"]), path)


def _moves() -> dict[tuple[int, int], bool]:
    at = {s: k for k, s in enumerate(STATES)}
    return {(at[a], at[b]): b in targets or a == b for a, targets in TRANSITIONS.items() for b in STATES}


MAPS = "state array<int>, applied array<long>, closed array<long>, ignored array<long>, events long"


def stretch_folder() -> Callable:
    """Function of applyInPandasWithState: what a stretch's events do to each of the start states.

    A batch's events of one stretch are kept as three numbers each until they are in order; those of a later batch are
    added after them.
    """
    can, applied_to, closed_to = _moves(), STATES.index("applied"), STATES.index("closed")
    resets = {STATES.index("normal"), STATES.index("saved")}

    def fold(key: tuple, parts: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        columns = [(p["at"].to_numpy(np.int64), p["event_id"].to_numpy(np.int64), p["to"].to_numpy(np.int64)) for p in parts]
        at, order, to = (np.concatenate(c) for c in zip(*columns))
        turn = np.lexsort((order, at))
        if kept.exists:
            state, applied, closed, ignored, events = kept.get
            state, applied, closed, ignored = list(state), list(applied), list(closed), list(ignored)
        else:
            state, applied, closed, ignored, events = list(range(len(STATES))), [UNCHANGED] * len(STATES), [UNCHANGED] * len(STATES), [0] * len(STATES), 0
        for t, goal in zip(at[turn].tolist(), to[turn].tolist()):
            for k, now in enumerate(state):
                if not can.get((now, goal), False):
                    ignored[k] += 1
                elif now != goal:
                    if goal == applied_to:
                        applied[k] = t
                    elif goal in resets:
                        applied[k] = CLEARED
                    closed[k] = t if goal == closed_to else CLEARED
                    state[k] = goal
        kept.update((state, applied, closed, ignored, int(events + len(turn))))
        yield pd.DataFrame({"events": [len(turn)]})

    return fold


def stream_workflow(events: DataFrame, path: str, seconds: int = STRETCH) -> DataFrame:
    """State per job after all events (job_id, at, event_id, to_state) that runs on ``path`` have read.

    The state store holds, for each job and stretch of time, a map from the state before to the state after, with
    the times of application and closure.  Maps compose, so a job of any number of events is dealt to many tasks, and
    a batch touches the stretches of its own events only; no table is written.  Events are in order of time
    between stretches and within a batch; an event that comes in a later batch than younger ones of its stretch counts after
    them.  Events without a job or time are passed over.
    """
    place = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("to_state")), F.lit(0)) - 1
    keyed = events.where("job_id is not null and at is not null").select("job_id", F.floor(F.unix_timestamp("at") / seconds).alias("stretch"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), F.coalesce(F.col("event_id").cast("long"), F.lit(-1)).alias("event_id"), place.alias("to"))
    folded = keyed.groupBy("job_id", "stretch").applyInPandasWithState(stretch_folder(), "events long", MAPS, "update", GroupStateTimeout.NoTimeout)
    q = folded.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return workflow_states(events.sparkSession, path)


def workflow_states(spark: SparkSession, path: str) -> DataFrame:
    """job_id, state, applied_at, closed_at, ignored and events, read from the state store below ``path``."""
    kept = spark.read.format("statestore").load(f"{path}/state").select("key.*", "value.groupState.*")
    names = F.array(*map(F.lit, STATES))
    time = lambda name, k: F.when(F.get(name, k) >= 0, F.timestamp_micros(F.get(name, k)))
    one = lambda k: F.struct(
        F.get(names, k).alias("was"), F.get(names, F.get("state", k)).alias("state"), (F.get("applied", k) != UNCHANGED).alias("applied_changes"), time("applied", k).alias("applied_at"),
        (F.get("closed", k) != UNCHANGED).alias("closed_changes"), time("closed", k).alias("closed_at"), F.get("ignored", k).alias("ignored"),
    )
    maps = kept.select("job_id", "stretch", F.array(*[one(F.lit(k)) for k in range(len(STATES))]).alias("maps"), "events")
    per = maps.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "maps", "events"))).alias("x"))
    none = F.lit(None).cast("timestamp")
    return per.select("job_id", composed(F.col("x"), F.lit("normal"), none, none, F.lit(0), F.lit(0)).alias("s")).select("job_id", "s.*")


def stream_refresh(listings: DataFrame, path: str, fields: list[str], order: list[str], scope: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Changes (company_id, external_path, batch, change) that batches of listings made to the cache below ``path``.

    A batch's latest row of each path meets the cached one (``incremental_refresh``); rows that are new, changed or listed
    again are merged in, and with a ``scope`` (such as company_id) cached rows of a scope that the batch lists, but which it doesn't
    list themselves, become unavailable (``removed``).  The cache is parted by a hash of its key: a batch reads the parts
    that its keys fall into, and writes again only those in which a row differs.  A scope's unlisted rows are found by reading
    keys and fingerprints alone.

    A batch's changes are written before the cache; a batch that runs again takes them as they are and merges once more,
    which leaves the same cache.
    """
    spark, key = listings.sparkSession, ["company_id", "external_path"]
    rows = list(dict.fromkeys([*key, *(scope or []), *fields, *order]))
    cached = listings.select(*rows).withColumns({"fingerprint": F.lit(""), "is_available": F.lit(True), "bucket": F.lit(0)}).schema
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    no_paths = F.expr("cast(array() as array<string>)").alias("equivalent_paths")

    def apply(batch: DataFrame, k: int) -> None:
        own = batch.sparkSession
        old = cache_rows(own, path, cached)
        latest = F.max_by(F.struct(*[c for c in rows if c not in key]), F.struct(*order)).alias("row")
        now = batch.where("company_id is not null and external_path is not null").groupBy(*key).agg(latest).select(*key, "row.*")
        now = now.select(*rows, F.sha2(F.to_json(F.struct(*fields)), 256).alias("fingerprint"), F.lit(True).alias("is_available"), bucket.alias("bucket")).persist()
        try:
            changes = f"{path}/changes/batch={k}"
            if not exists(own, f"{changes}/_SUCCESS"):
                known = _known(old, now, scope).persist()  # as many keys as the batch has, or its scopes
                try:
                    _classified(known, now, no_paths).write.mode("overwrite").parquet(changes)
                finally:
                    known.unpersist()
            change = own.read.schema("company_id string, external_path string, change string, bucket int").parquet(changes)
            touched = [r.bucket for r in change.select("bucket").distinct().collect()]
            if touched:
                gone = change.where("change = 'removed'").select(*key)
                put = now.join(change.where("change <> 'removed'").select(*key), key, "left_semi")
                stay = old.where(F.col("bucket").isin(touched)).join(put.select(*key), key, "left_anti")
                stay = stay.join(gone.withColumn("__gone", F.lit(True)), key, "left").withColumn("is_available", F.col("is_available") & F.col("__gone").isNull())
                # Rows of a part are written by one task each, so that a batch leaves one file a part.
                merged = stay.select(put.columns).unionByName(put).repartition("bucket")
                merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/cache")
        finally:
            now.unpersist()

    run_batches(listings, apply, f"{path}/state", "append")
    if not exists(spark, f"{path}/changes"):
        return spark.createDataFrame([], "company_id string, external_path string, batch int, change string")
    return spark.read.schema("company_id string, external_path string, change string, bucket int, batch int").parquet(f"{path}/changes").select(*key, "batch", "change")


def cache_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The cache below ``path``; without one, no row."""
    return spark.read.schema(schema).parquet(f"{path}/cache") if exists(spark, f"{path}/cache") else spark.createDataFrame([], schema)


SMALL = ["company_id", "external_path", "fingerprint", "is_available", "bucket"]


def _known(old: DataFrame, now: DataFrame, scope: list[str] | None) -> DataFrame:
    """Cached keys that the batch lists, and those that it should have listed."""
    key = ["company_id", "external_path"]
    met = old.where(F.col("bucket").isin([r.bucket for r in now.select("bucket").distinct().collect()]))
    known = met.join(now.select(*key), key, "left_semi").select(*SMALL)
    if scope:  # in any part of the cache
        unlisted = old.where("is_available").join(now.select(*scope).distinct(), scope, "left_semi").join(now.select(*key), key, "left_anti")
        known = known.unionByName(unlisted.select(*SMALL))
    return known


def _classified(known: DataFrame, now: DataFrame, no_paths) -> DataFrame:
    """(company_id, external_path, change, bucket) of keys whose cached row must change."""
    key = ["company_id", "external_path"]
    state = incremental_refresh(now.select(*key, "fingerprint"), known.select(*key, "fingerprint", no_paths)).select(*key, "state")
    removed = known.join(state.where("state = 'removed'").select(*key), key, "left_semi").withColumn("is_available", F.lit(False))
    one = F.to_json(F.struct(*key)).alias("__key")
    after = now.select(*SMALL).unionByName(removed)
    diff = snapshot_diff(known.select("*", one), after.select("*", one), "__key", ["fingerprint", "is_available"])
    change = F.when(F.col("state") == "removed", "removed").otherwise(F.col("change"))
    return after.select(*key, "bucket", one).join(diff, "__key").join(state, key).select(*key, change.alias("change"), "bucket")


def run_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], path: str, mode: str = "update") -> None:
    """Hand each batch to ``apply``, over what is there; ``path`` keeps what has been read."""
    q = stream.writeStream.foreachBatch(apply).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination()


def in_turn(parts: list[DataFrame], path: str) -> DataFrame:
    """Tables as a stream that yields them one after another, a batch each."""
    spark = parts[0].sparkSession
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, f"part={k}"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
