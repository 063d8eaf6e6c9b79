"""Tasks, fixed events and their pressure at many times at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import ceil_slot, hours_until


def open_work(tasks: DataFrame) -> DataFrame:
    """The open tasks of a run by deadline: their number, minutes, minutes weighted by priority, and least id. Clocks meet
    deadlines, of which a run has no more than its calendar has times, whatever the number of its tasks."""
    todo = tasks.filter((F.col("status") != "done") & (F.col("remaining_minutes") > 0))
    return todo.groupBy("run_id", "deadline").agg(F.count(F.lit(1)).alias("n"), F.sum("remaining_minutes").alias("work"), F.sum(F.col("priority") / 10 * F.col("remaining_minutes")).alias("weighted"), F.min("task_id").alias("first_id"))


def open_tasks_at(clocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """clocks (run_id, as_of) with n and work of the run's open tasks that are due after it, where there are any."""
    met = clocks.join(open_work(tasks), "run_id").filter("deadline > as_of")
    return met.groupBy("run_id", "as_of").agg(F.sum("n").alias("n"), F.sum("work").alias("work"))


def overdue_tasks(clocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, as_of, task_id of the open tasks that are overdue at a clock, a row each."""
    todo = tasks.filter((F.col("status") != "done") & (F.col("remaining_minutes") > 0)).select("run_id", "task_id", "deadline")
    return clocks.join(todo, "run_id").filter("deadline <= as_of").select("run_id", "as_of", "task_id")


def deadline_pressure(clocks: DataFrame, tasks: DataFrame) -> DataFrame:
    """run_id, as_of, deadline_pressure, remaining_work_minutes, n_overdue, first_overdue (least id; overdue_tasks() has all)."""
    left = (F.unix_seconds("deadline") - F.unix_seconds("as_of")) / 60
    overdue = F.col("deadline") <= F.col("as_of")
    sums = clocks.join(open_work(tasks), "run_id").groupBy("run_id", "as_of").agg(
        F.sum(F.when(~overdue, F.col("weighted") / F.greatest(left, F.lit(30.0)))).alias("p"), F.sum("work").alias("work"),
        F.sum(F.when(overdue, F.col("n")).otherwise(0)).alias("n_overdue"), F.min(F.when(overdue, F.col("first_id"))).alias("first_overdue"),
    )
    pressure = F.round(F.least(F.coalesce("p", F.lit(0.0)), F.lit(1.0)), 4)
    return clocks.join(sums, ["run_id", "as_of"], "left").select("run_id", "as_of", pressure.alias("deadline_pressure"), *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("work", "remaining_work_minutes"), ("n_overdue", "n_overdue"))], "first_overdue")


def upcoming(tasks: DataFrame, now) -> DataFrame:
    """Deadlines of unfinished tasks, and the hours until each."""
    return tasks.filter(F.col("status") != "done").withColumn("hours_until", hours_until(now, F.col("deadline"))).orderBy("deadline", "task_id")


def latest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def apply_progress(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """tasks after progress (task_id, minutes, expected_version); reports on another version than the task's are left out."""
    current = progress.join(tasks.select("task_id", F.col("version").alias("_v")), "task_id").filter("expected_version = _v")
    done = current.groupBy("task_id").agg(F.sum("minutes").alias("_done"))
    rest = F.greatest(F.col("remaining_minutes") - F.col("_done"), F.lit(0))
    out = tasks.join(done, "task_id", "left")
    touched = F.col("_done").isNotNull()
    return out.withColumns(
        {
            "remaining_minutes": F.when(touched, rest).otherwise(F.col("remaining_minutes")),
            "status": F.when(touched & (rest == 0), "done").when(touched, "in_progress").otherwise(F.col("status")),
            "version": F.col("version") + touched.cast("int"),
        }
    ).drop("_done")


def dedupe_jobs(jobs: DataFrame) -> DataFrame:
    """One job for each (run_id, state_id, versions): the newest that did not fail."""
    key = ["run_id", "state_id", "versions"]
    rest = [c for c in jobs.columns if c not in key]
    return jobs.filter("status <> 'failed'").groupBy(*key).agg(F.max_by(F.struct(*rest), "job_id").alias("r")).select(*key, "r.*")


def pending(jobs: DataFrame, current: DataFrame) -> DataFrame:
    """current (run_id, versions) with pending: an undecided job for just these versions exists."""
    undecided = jobs.filter("status IN ('queued', 'running') OR (status = 'ready' AND has_proposal)").select("run_id", "versions").distinct().withColumn("pending", F.lit(True))
    return current.join(undecided, ["run_id", "versions"], "left").withColumn("pending", F.coalesce("pending", F.lit(False)))


def stale_requests(requests: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """Requests whose version is not the current one."""
    return requests.join(versions.select(key, F.col("version").alias("current")), key, "left").filter(~F.col("version").eqNullSafe(F.col("current")))


def sleep_extension(clocks: DataFrame, sleep: DataFrame, blocks: DataFrame, target_minutes: int, slot: int = 15) -> DataFrame:
    """clocks (plan_id, now) with start and end of the extension before the next protected sleep (plan_id, start, end).

    It reaches back from the sleep to make up for what the sleep lacks of the target, not before
    the next slot, and starts after the last block that lies in its way, blocks taken by start.
    None inside a sleep, where one was added before, or if less than a slot is left.
    """
    from ..operators.readers import as_of, next_after

    found = next_after(clocks, sleep, ["plan_id"], "now", "start", "sleep_start")
    found = as_of(found, sleep, ["plan_id"], "now", "start", ["end"], "_in").filter(~F.coalesce(F.col("_in.end") > F.col("now"), F.lit(False)) & F.col("sleep_start").isNotNull()).drop("_in")
    found = found.join(sleep.select("plan_id", F.col("start").alias("sleep_start"), F.col("end").alias("sleep_end")).distinct(), ["plan_id", "sleep_start"])
    extended = blocks.filter("kind = 'sleep_extension'").select("plan_id", F.col("end").alias("sleep_start")).distinct()
    found = found.join(extended, ["plan_id", "sleep_start"], "left_anti")
    own = (F.unix_seconds("sleep_end") - F.unix_seconds("sleep_start")) / 60
    want = F.greatest(F.lit(target_minutes) - own, F.lit(0)) * 60
    found = found.withColumn("start", F.greatest(ceil_slot(F.col("now"), slot), F.timestamp_seconds(F.unix_seconds("sleep_start") - want)))
    # Only the days that the extension touches can hold blocks in its way.
    days = F.explode(F.sequence(F.date_sub(F.to_date("start"), 1), F.to_date("sleep_start"))).alias("day")
    b = blocks.filter("kind <> 'sleep_protected'").select("plan_id", F.to_date("start").alias("day"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    way = found.select("plan_id", "now", "start", "sleep_start", days).join(b, ["plan_id", "day"]).filter("b_start < sleep_start AND b_end > start")
    pushed = way.groupBy("plan_id", "now").agg(F.max("b_end").alias("_after"))
    out = found.join(pushed, ["plan_id", "now"], "left").withColumn("start", F.greatest("start", F.coalesce("_after", "start")))
    return out.filter((F.unix_seconds("sleep_start") - F.unix_seconds("start")) >= slot * 60).select("plan_id", "now", "start", F.col("sleep_start").alias("end"))
