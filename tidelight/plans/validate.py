"""Plan blocks: overlaps, containment, minutes, diffs, free time. Blocks and intervals are half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_day(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each day that an interval touches: the equi-key of interval joins."""
    last = F.to_date(F.timestamp_micros(F.unix_micros(end) - 1))
    return df.withColumn("day", F.explode(F.sequence(F.to_date(start), F.greatest(last, F.to_date(start)))))


def overlaps(blocks: DataFrame) -> DataFrame:
    """plan_id, first, second for blocks of a plan that overlap, each pair once."""
    b = by_day(blocks.filter("start < end").select("plan_id", "block_id", "start", "end"))
    o = b.select("plan_id", "day", F.col("block_id").alias("second"), F.col("start").alias("s"), F.col("end").alias("e"))
    met = b.join(o, ["plan_id", "day"]).filter("struct(start, end, block_id) < struct(s, e, second) AND s < end AND start < e")
    return met.select("plan_id", F.col("block_id").alias("first"), "second").distinct()


def overlapping_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks that begin before some earlier block of the plan ends: one sorted pass, however many overlap."""
    order = Window.partitionBy("plan_id").orderBy("start", "end", "block_id")
    return blocks.withColumn("_end", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))).filter("start < _end").drop("_end")


def overlaps_with(blocks: DataFrame, others: DataFrame, other_id: str) -> DataFrame:
    """plan_id, block_id and other's id where they overlap."""
    a = by_day(blocks.select("plan_id", "block_id", "start", "end"))
    o = by_day(others.select("plan_id", other_id, F.col("start").alias("s"), F.col("end").alias("e")), "s", "e")
    return a.join(o, ["plan_id", "day"]).filter("start < e AND s < end").select("plan_id", "block_id", other_id).distinct()


def outside_allowed(blocks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Blocks that no allowed interval of the plan holds whole. An interval that does touches the block's first day."""
    a = by_day(allowed.select("plan_id", F.col("start").alias("s"), F.col("end").alias("e")), "s", "e")
    b = blocks.withColumn("day", F.to_date("start"))
    inside = (b.plan_id == a.plan_id) & (b.day == a.day) & (a.s <= b.start) & (b.end <= a.e)
    return b.join(a, inside, "left_anti").drop("day")


def unknown_tasks(blocks: DataFrame, tasks: DataFrame) -> DataFrame:
    return blocks.filter("kind = 'study'").join(tasks, "task_id", "left_anti")


def minutes_of(start: str = "start", end: str = "end"):
    return F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / 60)


def task_minutes(blocks: DataFrame, tasks: DataFrame, unscheduled: DataFrame) -> DataFrame:
    """task_id, scheduled, unscheduled, remaining, conserved for open tasks."""
    got = blocks.filter("kind = 'study'").groupBy("task_id").agg(F.sum(minutes_of()).alias("scheduled"))
    rest = unscheduled.groupBy("task_id").agg(F.sum("minutes").alias("unscheduled"))
    out = tasks.filter("status <> 'done' AND remaining_minutes > 0").join(got, "task_id", "left").join(rest, "task_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("task_id", zero("scheduled"), zero("unscheduled"), F.col("remaining_minutes").alias("remaining")).withColumn("conserved", F.col("scheduled") + F.col("unscheduled") == F.col("remaining"))


def continuous_minutes(blocks: DataFrame, break_minutes: int) -> DataFrame:
    """Per plan and run of study blocks that lie closer than a break: bounds, blocks, minutes."""
    order = Window.partitionBy("plan_id").orderBy("start", "end", "block_id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.unix_seconds("start") - F.unix_seconds(before) >= break_minutes * 60, F.lit(True))
    runs = blocks.filter("kind = 'study'").withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy("plan_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_blocks"), F.sum(minutes_of()).alias("minutes")).drop("run")


def free_segments(allowed: DataFrame, busy: DataFrame) -> DataFrame:
    """Allowed time less busy time per plan, as maximal segments: a sweep over starts and ends."""

    def edges(df: DataFrame, a: int, b: int) -> DataFrame:
        point = F.explode(F.array(*[F.struct(F.col(c).alias("t"), F.lit(s * a).alias("a"), F.lit(s * b).alias("b")) for c, s in (("start", 1), ("end", -1))])).alias("p")
        return df.filter("start < end").select("plan_id", point).select("plan_id", "p.*")

    points = edges(allowed, 1, 0).unionByName(edges(busy, 0, 1)).groupBy("plan_id", "t").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("plan_id").orderBy("t")
    state = points.withColumn("free", (F.sum("a").over(order) > 0) & (F.sum("b").over(order) == 0))
    changes = state.withColumn("was", F.coalesce(F.lag("free").over(order), F.lit(False))).filter("free <> was")
    return changes.withColumn("end", F.lead("t").over(order)).filter("free").select("plan_id", F.col("t").alias("start"), "end")


def capacity_shortfall(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Per task in deadline order: work due by its deadline, free minutes before it, and by how much these fall short.
    A necessary condition for a plan, not a plan."""
    order = Window.partitionBy("plan_id").orderBy("deadline", F.desc("priority"), "task_id")
    due = tasks.filter("status <> 'done' AND remaining_minutes > 0").withColumn("due_minutes", F.sum("remaining_minutes").over(order))
    # Free time before a deadline: whole segments that ended before it, and the part of the one that it cuts.
    sums = Window.partitionBy("plan_id").orderBy("start")
    seg = segments.withColumn("before", F.coalesce(F.sum(F.unix_seconds("end") - F.unix_seconds("start")).over(sums.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    from ..operators.readers import as_of

    at = as_of(due, seg, ["plan_id"], "deadline", "start", ["start", "end", "before"], "s")
    part = F.least(F.unix_seconds("deadline"), F.unix_seconds("s.end")) - F.unix_seconds("s.start")
    free = F.floor(F.coalesce(F.col("s.before") + part, F.lit(0)) / 60)
    return at.withColumn("free_minutes", free).withColumn("shortfall", F.greatest(F.col("due_minutes") - F.col("free_minutes"), F.lit(0))).select("plan_id", "task_id", "due_minutes", "free_minutes", "shortfall")


def plan_diff(old: DataFrame, new: DataFrame, rest_task_ids: list[str] | None = None) -> DataFrame:
    """plan_id, change_id, key, action, reason_code, old_blocks, new_blocks per task (and _sleep) whose times differ."""
    key = F.when(F.col("kind") == "study", F.col("task_id")).when(F.col("kind") == "sleep_extension", "_sleep")
    side = lambda df, name: df.withColumn("key", key).filter("key IS NOT NULL").groupBy("plan_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "block_id"))).alias(name))
    met = side(old, "o").join(side(new, "n"), ["plan_id", "key"], "full")
    times = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: F.struct(x.start, x.end))
    ids = lambda c: F.coalesce(F.transform(c, lambda x: x.block_id), F.array().cast("array<string>"))
    changed = met.filter(F.col("o").isNull() | F.col("n").isNull() | ~times(F.col("o")).eqNullSafe(times(F.col("n"))))
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("moved")
    rest = (F.col("key") == "_sleep") | F.col("key").isin(*(rest_task_ids or [""]))
    order = Window.partitionBy("plan_id").orderBy("key")
    return changed.select(
        "plan_id", F.concat(F.lit("chg-"), F.row_number().over(order)).alias("change_id"), "key", action.alias("action"),
        F.when(rest, "PROTECT_REST").when(F.col("o").isNull(), "MEET_DEADLINE").otherwise("MAKE_ROOM").alias("reason_code"), ids(F.col("o")).alias("old_blocks"), ids(F.col("n")).alias("new_blocks"),
    )


CHECKS = ("no_overlap", "within_allowed", "deadlines_met", "minutes_conserved", "min_block_size", "max_continuous", "protected_sleep")


def interval_faults(blocks: DataFrame, allowed: DataFrame, fixed: DataFrame, sleep: DataFrame) -> DataFrame:
    """plan_id, overlap, outside, asleep of each plan with blocks, by one pass over all intervals of a plan in order of start: of two
    that overlap, the later one begins before the earlier one's end, so the greatest ends so far tell."""

    def tagged(df: DataFrame, tag) -> DataFrame:
        return df.select("plan_id", "start", "end", F.lit(tag).alias("tag") if isinstance(tag, str) else tag.alias("tag"))

    rows = tagged(blocks, F.when(F.col("kind") == "study", "study").otherwise("block"))
    for df, tag in ((allowed, "allowed"), (fixed, "fixed"), (sleep, "sleep")):
        rows = rows.unionByName(tagged(df, tag))
    is_ = lambda *tags: F.col("tag").isin(*tags)
    before = Window.partitionBy("plan_id").orderBy("start", "end", "tag").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("plan_id").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = {f"_{k}": F.max(F.when(is_(*tags), F.col("end"))).over(before) for k, tags in (("blocks", ("study", "block")), ("study", ("study",)), ("fixed", ("fixed",)), ("sleep", ("sleep",)))}
    rows = rows.withColumns(ends | {"_allowed": F.max(F.when(is_("allowed"), F.col("end"))).over(upto)})
    meets = lambda other: (is_("study") & (F.col(f"_{other}") > F.col("start"))) | (is_(other) & (F.col("_study") > F.col("start")))
    any_ = lambda c, name: F.max(F.coalesce(c, F.lit(False))).alias(name)
    overlap = (is_("study", "block") & (F.col("_blocks") > F.col("start"))) | meets("fixed") | meets("sleep")
    outside = is_("study") & ~F.coalesce(F.col("_allowed") >= F.col("end"), F.lit(False))
    return rows.groupBy("plan_id").agg(any_(is_("study", "block"), "_any"), any_(overlap, "overlap"), any_(outside, "outside"), any_(meets("sleep"), "asleep")).filter("_any").drop("_any")


def task_faults(blocks: DataFrame, tasks: DataFrame, unscheduled: DataFrame, max_continuous: int) -> DataFrame:
    """plan_id, late, lost, short, long of plans: study blocks, tasks and unscheduled work meet in one aggregation by plan and task."""
    todo = (F.col("status") != "done") & (F.col("remaining_minutes") > 0)
    task = F.struct("deadline", "remaining_minutes", "minimum_block_minutes", "splittable", todo.alias("todo"))
    rows = tasks.select("plan_id", "task_id", task.alias("task"))
    rows = rows.unionByName(blocks.filter("kind = 'study'").select("plan_id", "task_id", minutes_of().alias("m"), "end"), allowMissingColumns=True)
    rows = rows.unionByName(unscheduled.select("plan_id", "task_id", F.col("minutes").alias("left")), allowMissingColumns=True)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    met = rows.groupBy("plan_id", "task_id").agg(F.first("task", ignorenulls=True).alias("t"), F.count("m").alias("n"), zero("m").alias("got"), F.min("m").alias("least"), F.max("m").alias("most"), F.max("end").alias("end"), zero("left").alias("left"))
    t = F.col("t")
    open_ = F.coalesce(t.todo, F.lit(False))
    faults = {
        "late": open_ & (F.col("end") > t.deadline),
        "lost": (open_ & (F.col("got") + F.col("left") != t.remaining_minutes)) | (t.isNull() & (F.col("n") > 0)),
        "short": open_ & ((F.col("least") < F.least(t.minimum_block_minutes, t.remaining_minutes)) | (~t.splittable & (F.col("n") > 1))),
        "long": open_ & (F.col("most") > max_continuous),
    }
    return met.groupBy("plan_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(k) for k, c in faults.items()])


def validate_plans(blocks: DataFrame, tasks: DataFrame, allowed: DataFrame, fixed: DataFrame, sleep: DataFrame, unscheduled: DataFrame, max_continuous: int = 90) -> DataFrame:
    """A row for each plan with blocks: the checks of CHECKS, and passed. tasks, each once, and unscheduled have plan_id and task_id."""
    faults = interval_faults(blocks, allowed, fixed, sleep).join(task_faults(blocks, tasks, unscheduled, max_continuous), "plan_id", "left")
    of = dict(zip(CHECKS, ("overlap", "outside", "late", "lost", "short", "long", "asleep"), strict=True))
    out = faults.select("plan_id", *[(~F.coalesce(F.col(c), F.lit(False))).alias(k) for k, c in of.items()])
    return out.select("*", F.forall(F.array(*CHECKS), lambda x: x).alias("passed"))


def plan_status(plans: DataFrame) -> DataFrame:
    """plan_id, status from n_unscheduled and n_placed."""
    return plans.withColumn("status", F.when(F.col("n_unscheduled") == 0, "feasible").when(F.col("n_placed") > 0, "partial").otherwise("infeasible"))


def block_titles(blocks: DataFrame, tasks: DataFrame, fixed: DataFrame) -> DataFrame:
    """blocks with title: the task's, or that of the fixed event at exactly the block's time, or the kind's own."""
    t = tasks.select("task_id", F.col("title").alias("_task"))
    f = fixed.groupBy("plan_id", "start", "end").agg(F.min("title").alias("_event"))
    out = blocks.join(t, "task_id", "left").join(f, ["plan_id", "start", "end"], "left")
    title = (
        F.when(F.col("kind") == "study", F.coalesce("_task", F.col("task_id").cast("string"), F.lit("Study block")))
        .when(F.col("kind") == "fixed", F.coalesce("_event", F.lit("Fixed event")))
        .when(F.col("kind") == "sleep_protected", "Protected sleep")
        .when(F.col("kind") == "sleep_extension", "Sleep extension")
        .when(F.col("kind") == "break", "Break")
        .otherwise(F.col("kind"))
    )
    return out.withColumn("title", title).drop("_task", "_event")


def missing_blocks(entries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Calendar entries (plan_id, kind, start, end) that no block equals."""
    return entries.filter("start < end").join(blocks, ["plan_id", "kind", "start", "end"], "left_anti")


def split_midnight(blocks: DataFrame, zone: str) -> DataFrame:
    """A row for each local day of a block: day, start_minute and end_minute of that day's clock time."""
    local = lambda c: F.from_utc_timestamp(c, zone)
    b = blocks.filter("start < end").withColumns({"_s": local("start"), "_e": local("end")})
    days = F.explode(F.sequence(F.to_date("_s"), F.to_date(F.timestamp_micros(F.unix_micros("_e") - 1)))).alias("day")
    out = b.select("*", days)
    base = F.unix_seconds(F.col("day").cast("timestamp"))
    minute = lambda c: (F.unix_seconds(c) - base) / 60
    return out.withColumns({"start_minute": F.greatest(minute("_s"), F.lit(0.0)), "end_minute": F.least(minute("_e"), F.lit(1440.0))}).drop("_s", "_e")
