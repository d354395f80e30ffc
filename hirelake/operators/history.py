"""History and workflow state of postings per workspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed transitions of the workflow; a state may always stay.
TRANSITIONS = {
    "normal": ("saved", "applied", "hidden"),
    "saved": ("normal", "applied", "hidden"),
    "applied": ("normal", "closed", "hidden"),
    "closed": ("applied",),
    "hidden": ("normal",),
}
#: Seconds of one job's events that are folded at once.
STRETCH = 3600
VISIBLE_WHEN_GONE = ("saved", "applied", "closed")


def allowed(now: Column, to: Column) -> Column:
    moves = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    return (now == to) | F.concat_ws(">", now, to).isin(moves)


def reconcile_history(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """history (stable_id, company_id, external_path, state, last_seen) against the current jobs
    (stable_id, company_id, external_path, seen_at).

    Rows meet by id; a row whose id is gone is re-keyed to an unmatched job of the same path;
    unseen jobs are inserted; the rest stay as they are.
    """
    h = history.select("stable_id", "company_id", "external_path", "state", "last_seen")
    by_id = h.join(jobs.select("stable_id", F.col("seen_at").alias("now")), "stable_id", "left")
    same = by_id.where("now is not null").select("stable_id", "company_id", "external_path", "state", F.greatest("last_seen", "now").alias("last_seen"), F.lit("kept").alias("action"))
    lost = by_id.where("now is null").drop("now")
    free = jobs.join(h.select("stable_id"), "stable_id", "left_anti")
    target = free.groupBy("company_id", "external_path").agg(F.min(F.struct("stable_id", "seen_at")).alias("job"))
    moved = lost.join(target, ["company_id", "external_path"], "left")
    rekeyed = moved.where("job is not null").groupBy(F.col("job.stable_id").alias("stable_id"), "company_id", "external_path").agg(F.max(F.struct("last_seen", "state")).alias("h"), F.max("job.seen_at").alias("now"))
    rekeyed = rekeyed.select("stable_id", "company_id", "external_path", F.col("h.state").alias("state"), F.greatest("h.last_seen", "now").alias("last_seen"), F.lit("rekeyed").alias("action"))
    stay = moved.where("job is null").select("stable_id", "company_id", "external_path", "state", "last_seen", F.lit("unlisted").alias("action"))
    new = free.join(rekeyed.select("stable_id"), "stable_id", "left_anti").select("stable_id", "company_id", "external_path", F.lit("normal").alias("state"), F.col("seen_at").alias("last_seen"), F.lit("inserted").alias("action"))
    return same.unionByName(rekeyed).unionByName(stay).unionByName(new)


def workflow_maps(events: DataFrame, key: str = "job_id", at: str = "at", to: str = "to_state", order: str = "event_id", seconds: int = STRETCH) -> DataFrame:
    """(key, stretch, maps, events): what the ordered events of a job's stretch of time do to each start state.

    A map holds its start state (``was``), the state it leads to, how many moves it passes over, and whether the
    times of application and closure are kept, set or cleared.  Maps compose, so a job of any number of events is a
    fold of stretches, and a task holds the events of one stretch only.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(order).alias("ord"), F.col(to).alias("to"))))
    none = F.lit(None).cast("timestamp")

    def step(acc: Column, e: Column) -> Column:
        ok = allowed(acc["state"], e["to"])
        moved = ok & (acc["state"] != e["to"])
        applies, resets, closes = moved & (e["to"] == "applied"), moved & e["to"].isin("normal", "saved"), moved & (e["to"] == "closed")
        return F.struct(
            F.when(ok, e["to"]).otherwise(acc["state"]).alias("state"),
            (acc["applied_changes"] | applies | resets).alias("applied_changes"),
            F.when(applies, e["at"]).when(resets, none).otherwise(acc["applied_at"]).alias("applied_at"),
            (acc["closed_changes"] | moved).alias("closed_changes"),
            F.when(closes, e["at"]).when(moved, none).otherwise(acc["closed_at"]).alias("closed_at"),
            (acc["ignored"] + F.when(ok, 0).otherwise(1)).alias("ignored"),
        )

    def folded(was: Column) -> Column:
        start = F.struct(was.alias("state"), F.lit(False).alias("applied_changes"), none.alias("applied_at"), F.lit(False).alias("closed_changes"), none.alias("closed_at"), F.lit(0).alias("ignored"))
        return F.aggregate("steps", start, step, lambda acc: F.struct(was.alias("was"), acc["state"].alias("state"), acc["applied_changes"].alias("applied_changes"), acc["applied_at"].alias("applied_at"), acc["closed_changes"].alias("closed_changes"), acc["closed_at"].alias("closed_at"), acc["ignored"].alias("ignored")))

    stretch = F.floor(F.unix_timestamp(at) / seconds).alias("stretch")
    dealt = events.groupBy(key, stretch).agg(steps.alias("steps"))
    states = F.array(*[F.lit(s) for s in TRANSITIONS])
    return dealt.select(key, "stretch", F.transform(states, folded).alias("maps"), F.size("steps").cast("long").alias("events"))


def composed(stretches: Column, state: Column, applied_at: Column, closed_at: Column, ignored: Column, events: Column) -> Column:
    """The job's struct after ``stretches`` (sorted structs of stretch, maps and events), from a given one."""
    start = F.struct(state.alias("state"), applied_at.alias("applied_at"), closed_at.alias("closed_at"), ignored.cast("long").alias("ignored"), events.cast("long").alias("events"))

    def step(acc: Column, x: Column) -> Column:
        m = F.filter(x["maps"], lambda m: m["was"] == acc["state"])[0]
        return F.transform(
            F.array(m),
            lambda m: F.struct(
                m["state"].alias("state"),
                F.when(m["applied_changes"], m["applied_at"]).otherwise(acc["applied_at"]).alias("applied_at"),
                F.when(m["closed_changes"], m["closed_at"]).otherwise(acc["closed_at"]).alias("closed_at"),
                (acc["ignored"] + m["ignored"]).alias("ignored"),
                (acc["events"] + x["events"]).alias("events"),
            ),
        )[0]

    return F.aggregate(stretches, start, step)


def fold_workflow(events: DataFrame, key: str = "job_id", at: str = "at", to: str = "to_state", order: str = "event_id") -> DataFrame:
    """Per job the state after its ordered events; moves that aren't allowed are passed over and counted."""
    maps = workflow_maps(events, key, at, to, order)
    per = maps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stretch", "maps", "events"))).alias("x"))
    none = F.lit(None).cast("timestamp")
    return per.select(key, composed(F.col("x"), F.lit("normal"), none, none, F.lit(0), F.lit(0)).alias("s")).select(key, "s.state", "s.applied_at", "s.closed_at", F.col("s.ignored").cast("int").alias("ignored"), "s.events")


def continued(states: DataFrame, events: DataFrame, key: str = "job_id") -> DataFrame:
    """The table of states (key, state, applied_at, closed_at, ignored, events) after further events."""
    per = workflow_maps(events, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stretch", "maps", "events"))).alias("x"))
    both = states.join(per, key, "full")
    empty = F.expr("cast(array() as " + per.schema["x"].dataType.simpleString() + ")")
    moved = composed(F.coalesce("x", empty), F.coalesce("state", F.lit("normal")), F.col("applied_at"), F.col("closed_at"), F.coalesce("ignored", F.lit(0)), F.coalesce("events", F.lit(0)))
    return both.select(key, moved.alias("s")).select(key, "s.*")


def migrate_history(rows: DataFrame) -> DataFrame:
    """Old flags become one state by precedence; a closure without an application is undone."""
    state = F.when(F.col("closed"), F.when(F.col("applied_on").isNotNull(), "closed").otherwise("applied")).when(F.col("applied"), "applied").when(F.col("dismissed"), "hidden").when(F.col("saved"), "saved").otherwise("normal")
    key = F.when(F.col("stable_id").contains(":"), F.col("stable_id")).otherwise(F.concat_ws(":", "company_id", "stable_id"))
    return rows.withColumn("state", state).withColumn("stable_id", key)


def job_states(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """Each job with its state (normal by default) and whether lists show it."""
    joined = jobs.join(history.select("stable_id", "state"), "stable_id", "left").withColumn("state", F.coalesce("state", F.lit("normal")))
    return joined.withColumn("visible", F.col("is_available") | F.col("state").isin(*VISIBLE_WHEN_GONE))


def curated_import(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """States after an import: incoming ones win, all others are reset; new ids are inserted.

    An id that comes in twice is rejected with all of its rows.
    """
    once = incoming.groupBy("stable_id").agg(F.count("*").alias("n"), F.min("state").alias("incoming"))
    both = current.select("stable_id", F.col("state").alias("was")).join(once, "stable_id", "full")
    action = F.when(F.col("n") > 1, "rejected").when(F.col("incoming").isNull(), "reset").when(F.col("was").isNull(), "inserted").otherwise("replaced")
    state = F.when(F.col("n") > 1, F.col("was")).otherwise(F.coalesce("incoming", F.lit("normal")))
    return both.select("stable_id", state.alias("state"), action.alias("action"))
