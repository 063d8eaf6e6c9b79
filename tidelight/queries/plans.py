"""Queries over tasks, plan blocks, intervals and jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..plans import calendar, validate
from . import bindings as b
from .bindings import sql_text as st
from .bindings import table, text
from .registry import query

# orders are tasks, lineitems are blocks; 25 orders make a plan.
TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_orderkey // 25 AS plan_id, 'run-' || (o_custkey % 16) AS run_id, 'Task ' || o_orderkey AS title,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 300 + 15 AS BIGINT) AS remaining_minutes, o_orderdate + INTERVAL 60 DAY AS deadline, 12 - 2 * CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'in_progress' END AS status, o_custkey % 3 <> 0 AS splittable, 30 AS minimum_block_minutes, CAST(o_custkey % 3 AS INTEGER) AS version FROM orders)"""
BLOCKS = """blocks AS (SELECT l_orderkey // 25 AS plan_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS block_id, l_orderkey AS task_id,
  CASE WHEN l_linenumber = 7 THEN 'sleep_extension' WHEN l_returnflag = 'R' THEN 'fixed' ELSE 'study' END AS kind,
  l_shipdate + to_hours(l_linenumber) AS "start", l_shipdate + to_hours(l_linenumber) + to_minutes(CAST(l_quantity AS BIGINT) * 5) AS "end", l_linestatus = 'F' AS locked, l_linenumber, l_partkey, l_shipdate FROM lineitem)"""
CAL = f"""{TASKS}, {BLOCKS}, days AS (SELECT DISTINCT plan_id, l_shipdate AS day FROM blocks),
allowed AS (SELECT plan_id, day AS "start", day + INTERVAL 5 HOUR AS "end" FROM days),
sleep AS (SELECT plan_id, plan_id || '-' || strftime(day, '%Y%m%d') AS interval_id, day + INTERVAL 5 HOUR AS "start", day + INTERVAL 390 MINUTE AS "end" FROM days),
fixed AS (SELECT plan_id, block_id AS event_id, 'Event ' || l_partkey AS title, "start", "end" FROM blocks WHERE kind = 'fixed' AND l_linenumber <= 3),
unscheduled AS (SELECT plan_id, task_id, remaining_minutes // 2 AS minutes FROM tasks WHERE NOT splittable)"""
# Unscheduled minutes of every task.
EVERY = f"{TASKS}, {BLOCKS}, unscheduled AS (SELECT plan_id, task_id, remaining_minutes // 2 AS minutes FROM tasks)"


def tasks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("task_id"), F.floor(F.col("o_orderkey") / 25).alias("plan_id"), F.concat(F.lit("run-"), F.col("o_custkey") % 16).alias("run_id"), F.concat(F.lit("Task "), "o_orderkey").alias("title"),
        (F.floor("o_totalprice") % 300 + 15).alias("remaining_minutes"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 60 days")).alias("deadline"), (12 - 2 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("in_progress").alias("status"), (F.col("o_custkey") % 3 != 0).alias("splittable"), F.lit(30).alias("minimum_block_minutes"), (F.col("o_custkey") % 3).cast("int").alias("version"),
    )


def blocks(spark, sf):
    li = table(spark, sf, "lineitem")
    ship = F.col("l_shipdate").cast("timestamp")
    start = F.timestamp_seconds(F.unix_seconds(ship) + F.col("l_linenumber") * 3600)
    kind = F.when(F.col("l_linenumber") == 7, "sleep_extension").when(F.col("l_returnflag") == "R", "fixed").otherwise("study")
    return li.select(
        F.floor(F.col("l_orderkey") / 25).alias("plan_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("block_id"), F.col("l_orderkey").alias("task_id"), kind.alias("kind"),
        start.alias("start"), F.timestamp_seconds(F.unix_seconds(start) + F.col("l_quantity").cast("long") * 300).alias("end"), (F.col("l_linestatus") == "F").alias("locked"), "l_linenumber", "l_partkey", ship.alias("l_shipdate"),
    )


def plan(df):
    return df.select("plan_id", "block_id", "task_id", "kind", "start", "end", "locked")


def days(bl):
    return bl.select("plan_id", F.col("l_shipdate").alias("day")).distinct()


def allowed(bl):
    return days(bl).select("plan_id", F.col("day").alias("start"), (F.col("day") + F.expr("interval 5 hours")).alias("end"))


def sleep(bl):
    return days(bl).select("plan_id", F.concat("plan_id", F.lit("-"), F.date_format("day", "yyyyMMdd")).alias("interval_id"), (F.col("day") + F.expr("interval 5 hours")).alias("start"), (F.col("day") + F.expr("interval 390 minutes")).alias("end"))


def fixed(bl):
    return bl.filter("kind = 'fixed' AND l_linenumber <= 3").select("plan_id", F.col("block_id").alias("event_id"), F.concat(F.lit("Event "), "l_partkey").alias("title"), "start", "end")


def unscheduled(ts):
    return ts.select("plan_id", "task_id", F.floor(F.col("remaining_minutes") / 2).alias("minutes"))


_MONTHS = "clocks AS (SELECT DISTINCT run_id, date_trunc('quarter', deadline) AS as_of FROM tasks)"


def clocks(ts):
    return ts.select("run_id", F.date_trunc("quarter", "deadline").alias("as_of")).distinct()


@query("j7_task_open_asof", f"WITH {TASKS}, {_MONTHS} SELECT run_id, {st('as_of')} AS as_of, count(*) AS n, CAST(sum(remaining_minutes) AS BIGINT) AS work FROM clocks JOIN tasks USING (run_id) WHERE status <> 'done' AND remaining_minutes > 0 AND deadline > as_of GROUP BY run_id, as_of")
def j7(spark, sf):
    ts = tasks(spark, sf)
    return calendar.open_tasks_at(clocks(ts), ts).select("run_id", text(F.col("as_of")).alias("as_of"), "n", "work")


@query("a8_deadline_pressure", f"WITH {TASKS}, {_MONTHS} SELECT run_id, {st('as_of')} AS as_of, round(least(greatest(coalesce(sum(CASE WHEN deadline > as_of THEN priority / 10 * remaining_minutes / greatest((epoch(deadline) - epoch(as_of)) / 60, 30) END), 0), 0), 1), 4) AS deadline_pressure, CAST(sum(remaining_minutes) AS BIGINT) AS remaining_work_minutes, count(*) FILTER (deadline <= as_of) AS n_overdue, min(CASE WHEN deadline <= as_of THEN task_id END) AS first_overdue FROM clocks JOIN tasks USING (run_id) WHERE status <> 'done' AND remaining_minutes > 0 GROUP BY run_id, as_of")
def a8(spark, sf):
    ts = tasks(spark, sf)
    df = calendar.deadline_pressure(clocks(ts), ts)
    return df.select("run_id", text(F.col("as_of")).alias("as_of"), "deadline_pressure", "remaining_work_minutes", "n_overdue", "first_overdue")


@query("j8_next_exam", f"WITH {TASKS}, c AS (SELECT run_id, deadline - INTERVAL 90 MINUTE AS as_of, task_id FROM tasks), e AS (SELECT run_id, deadline AS s FROM tasks WHERE priority = 10) SELECT task_id, {st('s')} AS next_exam, round((epoch(s) - epoch(as_of)) / 3600, 2) AS hours FROM c ASOF LEFT JOIN e ON c.run_id = e.run_id AND c.as_of < e.s")
def j8(spark, sf):
    from ..operators.readers import next_after

    ts = tasks(spark, sf)
    at = ts.select("run_id", "task_id", (F.col("deadline") - F.expr("interval 90 minutes")).alias("as_of"))
    df = next_after(at, ts.filter("priority = 10").select("run_id", F.col("deadline").alias("s")), ["run_id"], "as_of", "s", "next_exam")
    return df.select("task_id", text(F.col("next_exam")).alias("next_exam"), times.hours_until(F.col("as_of"), F.col("next_exam")).alias("hours"))


_JOBS = "jobs AS (SELECT o_orderkey AS job_id, 'run-' || (o_custkey % 16) AS run_id, 'state-' || (o_orderkey % 50) AS state_id, 'v' || (o_custkey % 7) AS versions, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'ready' ELSE 'queued' END AS status, o_orderkey % 9 = 0 AS has_proposal FROM orders)"


def jobs(spark, sf):
    o = table(spark, sf, "orders")
    c = lambda prefix, x: F.concat(F.lit(prefix), x)
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ready").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("job_id"), c("run-", F.col("o_custkey") % 16).alias("run_id"), c("state-", F.col("o_orderkey") % 50).alias("state_id"), c("v", F.col("o_custkey") % 7).alias("versions"), status.alias("status"), (F.col("o_orderkey") % 9 == 0).alias("has_proposal"))


@query("j10_pending_decision", f"WITH {_JOBS}, c AS (SELECT DISTINCT run_id, versions FROM jobs), u AS (SELECT DISTINCT run_id, versions FROM jobs WHERE (status = 'queued' OR (status = 'ready' AND has_proposal))) SELECT c.run_id, c.versions, u.run_id IS NOT NULL AS pending FROM c LEFT JOIN u USING (run_id, versions)")
def j10(spark, sf):
    js = jobs(spark, sf)
    return calendar.pending(js, js.select("run_id", "versions").distinct())


@query("i7_idempotent_job", f"WITH {_JOBS} SELECT run_id, state_id, versions, max(job_id) AS job_id FROM jobs WHERE status <> 'failed' GROUP BY ALL")
def i7(spark, sf):
    return calendar.dedupe_jobs(jobs(spark, sf)).select("run_id", "state_id", "versions", "job_id")


@query("j11_flexible_block_exists", f"WITH {BLOCKS}, c AS (SELECT DISTINCT plan_id, date_trunc('year', l_shipdate) AS as_of FROM blocks), m AS (SELECT plan_id, max(\"start\") AS last FROM blocks WHERE kind = 'study' AND NOT locked GROUP BY 1) SELECT plan_id, {st('as_of')} AS as_of, coalesce(last >= as_of, false) AS flexible FROM c LEFT JOIN m USING (plan_id)")
def j11(spark, sf):
    bl = blocks(spark, sf)
    last = bl.filter("kind = 'study' AND NOT locked").groupBy("plan_id").agg(F.max("start").alias("last"))
    at = bl.select("plan_id", F.date_trunc("year", "l_shipdate").alias("as_of")).distinct()
    return at.join(last, "plan_id", "left").select("plan_id", text(F.col("as_of")).alias("as_of"), F.coalesce(F.col("last") >= F.col("as_of"), F.lit(False)).alias("flexible"))


@query("j12_block_overlap_self", f'WITH {BLOCKS} SELECT DISTINCT a.plan_id, a.block_id AS first, c.block_id AS second FROM blocks a JOIN blocks c ON a.plan_id = c.plan_id AND a."start" < c."end" AND c."start" < a."end" AND (a."start" < c."start" OR (a."start" = c."start" AND (a."end" < c."end" OR (a."end" = c."end" AND a.block_id < c.block_id))))')
def j12(spark, sf):
    return validate.overlaps(blocks(spark, sf))


@query("j13_block_overlap_fixed", f"WITH {CAL} SELECT DISTINCT a.plan_id, a.block_id, interval_id FROM blocks a JOIN sleep c ON a.plan_id = c.plan_id AND a.\"start\" < c.\"end\" AND c.\"start\" < a.\"end\" WHERE a.kind = 'study'")
def j13(spark, sf):
    bl = blocks(spark, sf)
    return validate.overlaps_with(bl.filter("kind = 'study'"), sleep(bl), "interval_id")


@query("j14_block_containment", f"WITH {CAL} SELECT plan_id, block_id FROM blocks a WHERE kind = 'study' AND NOT EXISTS (SELECT 1 FROM allowed c WHERE c.plan_id = a.plan_id AND c.\"start\" <= a.\"start\" AND a.\"end\" <= c.\"end\")")
def j14(spark, sf):
    bl = blocks(spark, sf)
    return validate.outside_allowed(bl.filter("kind = 'study'"), allowed(bl)).select("plan_id", "block_id")


@query("j15_unknown_task", f"WITH {TASKS}, {BLOCKS} SELECT block_id FROM blocks WHERE kind = 'study' AND task_id NOT IN (SELECT task_id FROM tasks WHERE status <> 'done')")
def j15(spark, sf):
    return validate.unknown_tasks(blocks(spark, sf), tasks(spark, sf).filter("status <> 'done'")).select("block_id")


@query("j16_block_task_title", f"WITH {CAL}, f AS (SELECT plan_id, \"start\", \"end\", min(title) AS title FROM fixed GROUP BY ALL) SELECT a.plan_id, block_id, CASE kind WHEN 'study' THEN coalesce(t.title, CAST(a.task_id AS VARCHAR)) WHEN 'fixed' THEN coalesce(f.title, 'Fixed event') ELSE 'Sleep extension' END AS title FROM blocks a LEFT JOIN tasks t ON t.task_id = a.task_id LEFT JOIN f ON f.plan_id = a.plan_id AND f.\"start\" = a.\"start\" AND f.\"end\" = a.\"end\"")
def j16(spark, sf):
    bl = blocks(spark, sf)
    return validate.block_titles(plan(bl), tasks(spark, sf), fixed(bl)).select("plan_id", "block_id", "title")


@query("j17_missing_calendar_blocks", f"WITH {CAL} SELECT plan_id, interval_id FROM sleep s WHERE NOT EXISTS (SELECT 1 FROM blocks a WHERE a.plan_id = s.plan_id AND a.kind = 'study' AND a.\"start\" = s.\"start\" AND a.\"end\" = s.\"end\")")
def j17(spark, sf):
    bl = blocks(spark, sf)
    return validate.missing_blocks(sleep(bl).withColumn("kind", F.lit("study")), plan(bl)).select("plan_id", "interval_id")


@query("a16_study_minutes_by_task", f"WITH {EVERY}, g AS (SELECT task_id, sum(epoch(\"end\") - epoch(\"start\")) // 60 AS m FROM blocks WHERE kind = 'study' GROUP BY 1) SELECT t.task_id, CAST(coalesce(m, 0) AS BIGINT) AS scheduled, coalesce(minutes, 0) AS unscheduled, remaining_minutes AS remaining, CAST(coalesce(m, 0) AS BIGINT) + coalesce(minutes, 0) = remaining_minutes AS conserved FROM tasks t LEFT JOIN g USING (task_id) LEFT JOIN unscheduled u ON u.task_id = t.task_id WHERE status <> 'done'")
def a16(spark, sf):
    ts = tasks(spark, sf)
    return validate.task_minutes(blocks(spark, sf), ts, unscheduled(ts))


@query("w12_contiguous_study_minutes", f"WITH {BLOCKS}, o AS (SELECT *, max(\"end\") OVER (PARTITION BY plan_id ORDER BY \"start\", \"end\", block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM blocks WHERE kind = 'study'), r AS (SELECT *, sum(CASE WHEN pe IS NULL OR epoch(\"start\") - epoch(pe) >= 900 THEN 1 ELSE 0 END) OVER (PARTITION BY plan_id ORDER BY \"start\", \"end\", block_id ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT plan_id, {st('min(\"start\")')} AS \"start\", {st('max(\"end\")')} AS \"end\", count(*) AS n_blocks, CAST(sum((epoch(\"end\") - epoch(\"start\")) // 60) AS BIGINT) AS minutes FROM r GROUP BY plan_id, run")
def w12(spark, sf):
    df = validate.continuous_minutes(blocks(spark, sf), 15)
    return df.withColumns({c: text(F.col(c)) for c in ("start", "end")})


@query("w13_latest_version", f"WITH {TASKS} SELECT run_id, version, task_id FROM (SELECT run_id, version, task_id, row_number() OVER (PARTITION BY run_id ORDER BY version * 10000000 + task_id DESC) AS k FROM tasks) WHERE k = 1")
def w13(spark, sf):
    ts = tasks(spark, sf).withColumn("v", F.col("version") * 10000000 + F.col("task_id"))
    return calendar.latest_version(ts.select("run_id", "version", "task_id", "v"), "run_id", "v").drop("v")


_FREE = """pts AS (SELECT plan_id, t, sum(a) AS a, sum(b) AS b FROM (SELECT plan_id, "start" AS t, 1 AS a, 0 AS b FROM allowed UNION ALL SELECT plan_id, "end", -1, 0 FROM allowed UNION ALL SELECT plan_id, "start", 0, 1 FROM blocks UNION ALL SELECT plan_id, "end", 0, -1 FROM blocks) GROUP BY plan_id, t),
fs AS (SELECT plan_id, t, sum(a) OVER (PARTITION BY plan_id ORDER BY t) > 0 AND sum(b) OVER (PARTITION BY plan_id ORDER BY t) = 0 AS free FROM pts),
ch AS (SELECT plan_id, t, free FROM (SELECT *, coalesce(lag(free) OVER (PARTITION BY plan_id ORDER BY t), false) AS was FROM fs) WHERE free <> was),
segments AS (SELECT plan_id, t AS "start", e AS "end" FROM (SELECT plan_id, t, free, lead(t) OVER (PARTITION BY plan_id ORDER BY t) AS e FROM ch) WHERE free)"""


@query("i1_free_segments", f'WITH {CAL}, {_FREE} SELECT plan_id, {st(chr(34) + "start" + chr(34))} AS "start", {st(chr(34) + "end" + chr(34))} AS "end" FROM segments')
def i1(spark, sf):
    bl = blocks(spark, sf)
    df = validate.free_segments(allowed(bl), bl.select("plan_id", "start", "end"))
    return df.withColumns({c: text(F.col(c)) for c in ("start", "end")})


@query("w14_edf_capacity", f"WITH {CAL}, {_FREE}, due AS (SELECT *, CAST(sum(remaining_minutes) OVER (PARTITION BY plan_id ORDER BY deadline, priority DESC, task_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS due_minutes FROM tasks WHERE status <> 'done'), fr AS (SELECT d.plan_id, d.task_id, CAST(floor(coalesce(sum(epoch(least(s.\"end\", d.deadline)) - epoch(s.\"start\")), 0) / 60) AS BIGINT) AS free_minutes FROM due d LEFT JOIN segments s ON s.plan_id = d.plan_id AND s.\"start\" <= d.deadline GROUP BY ALL) SELECT plan_id, task_id, due_minutes, free_minutes, greatest(due_minutes - free_minutes, 0) AS shortfall FROM due JOIN fr USING (plan_id, task_id)")
def w14(spark, sf):
    bl = blocks(spark, sf)
    return validate.capacity_shortfall(tasks(spark, sf), validate.free_segments(allowed(bl), bl.select("plan_id", "start", "end")))


# The new plan leaves out the blocks of every seventh part and moves those of every fifth by half an hour.
_NEW = """nb AS (SELECT plan_id, block_id, task_id, kind, CASE WHEN l_partkey % 5 = 0 THEN "start" + INTERVAL 30 MINUTE ELSE "start" END AS "start", CASE WHEN l_partkey % 5 = 0 THEN "end" + INTERVAL 30 MINUTE ELSE "end" END AS "end" FROM blocks WHERE l_partkey % 7 <> 0)"""


@query(
    "i3_plan_diff",
    f"""WITH {BLOCKS}, {_NEW}, ob AS (SELECT * FROM blocks WHERE l_partkey % 11 <> 0),
    o AS (SELECT plan_id, CASE WHEN kind = 'study' THEN CAST(task_id AS VARCHAR) ELSE '_sleep' END AS key, list(block_id ORDER BY "start", "end", block_id) AS ids, list({{'a': "start", 'b': "end"}} ORDER BY "start", "end", block_id) AS ts FROM ob WHERE kind <> 'fixed' GROUP BY ALL),
    n AS (SELECT plan_id, CASE WHEN kind = 'study' THEN CAST(task_id AS VARCHAR) ELSE '_sleep' END AS key, list(block_id ORDER BY "start", "end", block_id) AS ids, list({{'a': "start", 'b': "end"}} ORDER BY "start", "end", block_id) AS ts FROM nb WHERE kind <> 'fixed' GROUP BY ALL),
    m AS (SELECT plan_id, key, o.ids AS oi, n.ids AS ni FROM o FULL JOIN n USING (plan_id, key) WHERE o.ts IS DISTINCT FROM n.ts)
    SELECT plan_id, 'chg-' || row_number() OVER (PARTITION BY plan_id ORDER BY key) AS change_id, key, CASE WHEN oi IS NULL THEN 'added' WHEN ni IS NULL THEN 'removed' ELSE 'moved' END AS action,
      CASE WHEN key = '_sleep' THEN 'PROTECT_REST' WHEN oi IS NULL THEN 'MEET_DEADLINE' ELSE 'MAKE_ROOM' END AS reason_code, coalesce(oi, []) AS old_blocks, coalesce(ni, []) AS new_blocks FROM m""",
)
def i3(spark, sf):
    bl = blocks(spark, sf).withColumn("task_id", F.col("task_id").cast("string"))
    moved = F.when(F.col("l_partkey") % 5 == 0, F.expr("interval 30 minutes")).otherwise(F.expr("interval 0 minutes"))
    new = bl.filter("l_partkey % 7 <> 0").withColumns({c: F.col(c) + moved for c in ("start", "end")})
    return validate.plan_diff(bl.filter("l_partkey % 11 <> 0"), new)


_VALID = f"""{CAL}, study AS (SELECT * FROM blocks WHERE kind = 'study'), todo AS (SELECT * FROM tasks WHERE status <> 'done'),
mine AS (SELECT s.*, t.deadline, t.minimum_block_minutes, t.remaining_minutes, t.splittable, (epoch(s."end") - epoch(s."start")) // 60 AS m FROM study s JOIN todo t ON t.plan_id = s.plan_id AND t.task_id = s.task_id),
b1 AS (SELECT DISTINCT plan_id FROM (SELECT plan_id, "start", max("end") OVER (PARTITION BY plan_id ORDER BY "start", "end", block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM blocks) WHERE "start" < pe
  UNION SELECT s.plan_id FROM study s JOIN fixed f ON s.plan_id = f.plan_id AND s."start" < f."end" AND f."start" < s."end" UNION SELECT s.plan_id FROM study s JOIN sleep f ON s.plan_id = f.plan_id AND s."start" < f."end" AND f."start" < s."end"),
b2 AS (SELECT DISTINCT plan_id FROM study s WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.plan_id = s.plan_id AND a."start" <= s."start" AND s."end" <= a."end")),
b3 AS (SELECT DISTINCT plan_id FROM mine WHERE "end" > deadline),
b4 AS (SELECT DISTINCT t.plan_id FROM todo t LEFT JOIN (SELECT plan_id, task_id, sum(m) AS g FROM mine GROUP BY ALL) g ON g.plan_id = t.plan_id AND g.task_id = t.task_id LEFT JOIN unscheduled u ON u.plan_id = t.plan_id AND u.task_id = t.task_id WHERE coalesce(g.g, 0) + coalesce(u.minutes, 0) <> t.remaining_minutes
  UNION SELECT plan_id FROM study s WHERE NOT EXISTS (SELECT 1 FROM tasks t WHERE t.plan_id = s.plan_id AND t.task_id = s.task_id)),
b5 AS (SELECT plan_id FROM mine WHERE m < least(minimum_block_minutes, remaining_minutes) UNION SELECT plan_id FROM (SELECT plan_id, task_id FROM mine WHERE NOT splittable GROUP BY ALL HAVING count(*) > 1)),
b6 AS (SELECT DISTINCT plan_id FROM mine WHERE m > 240),
b7 AS (SELECT DISTINCT s.plan_id FROM study s JOIN sleep f ON s.plan_id = f.plan_id AND s."start" < f."end" AND f."start" < s."end"),
plans AS (SELECT DISTINCT plan_id FROM blocks), v AS (SELECT plan_id, plan_id NOT IN (FROM b1) AS no_overlap, plan_id NOT IN (FROM b2) AS within_allowed, plan_id NOT IN (FROM b3) AS deadlines_met, plan_id NOT IN (FROM b4) AS minutes_conserved, plan_id NOT IN (FROM b5) AS min_block_size, plan_id NOT IN (FROM b6) AS max_continuous, plan_id NOT IN (FROM b7) AS protected_sleep FROM plans)"""


@query("i4_plan_validation", f"WITH {_VALID} SELECT *, no_overlap AND within_allowed AND deadlines_met AND minutes_conserved AND min_block_size AND max_continuous AND protected_sleep AS passed FROM v")
def i4(spark, sf):
    bl, ts = blocks(spark, sf), tasks(spark, sf)
    return validate.validate_plans(plan(bl), ts, allowed(bl), fixed(bl), sleep(bl), unscheduled(ts.filter("NOT splittable")), 240)


@query("i5_plan_status", f"WITH {EVERY}, u AS (SELECT plan_id, count(*) AS n_unscheduled FROM unscheduled GROUP BY 1), p AS (SELECT plan_id, count(*) AS n_placed FROM blocks WHERE kind = 'study' GROUP BY 1), a AS (SELECT DISTINCT plan_id FROM blocks) SELECT plan_id, coalesce(n_unscheduled, 0) AS n_unscheduled, coalesce(n_placed, 0) AS n_placed, CASE WHEN n_unscheduled IS NULL THEN 'feasible' WHEN n_placed IS NOT NULL THEN 'partial' ELSE 'infeasible' END AS status FROM a LEFT JOIN u USING (plan_id) LEFT JOIN p USING (plan_id)")
def i5(spark, sf):
    bl = blocks(spark, sf)
    u = unscheduled(tasks(spark, sf)).groupBy("plan_id").agg(F.count(F.lit(1)).alias("u"))
    p = bl.filter("kind = 'study'").groupBy("plan_id").agg(F.count(F.lit(1)).alias("p"))
    df = bl.select("plan_id").distinct().join(u, "plan_id", "left").join(p, "plan_id", "left").select("plan_id", F.coalesce("u", F.lit(0)).alias("n_unscheduled"), F.coalesce("p", F.lit(0)).alias("n_placed"))
    return validate.plan_status(df)


# Progress: shipped quantities, some reported against an old version.
_PROGRESS = "progress AS (SELECT l_orderkey AS task_id, CAST(l_quantity AS BIGINT) AS minutes, CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN 1 ELSE 2 END AS INTEGER) AS expected_version FROM lineitem)"


def progress(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_quantity").cast("long").alias("minutes"), (F.col("l_partkey") % 3).cast("int").alias("expected_version"))


@query("i6_task_progress", f"WITH {TASKS}, {_PROGRESS}, d AS (SELECT p.task_id, CAST(sum(minutes) AS BIGINT) AS done FROM progress p JOIN tasks t ON t.task_id = p.task_id AND version = expected_version GROUP BY 1) SELECT task_id, CASE WHEN done IS NULL THEN remaining_minutes ELSE greatest(remaining_minutes - done, 0) END AS remaining_minutes, CASE WHEN done IS NULL THEN status WHEN done >= remaining_minutes THEN 'done' ELSE 'in_progress' END AS status, version + CASE WHEN done IS NULL THEN 0 ELSE 1 END AS version FROM tasks LEFT JOIN d USING (task_id)")
def i6(spark, sf):
    return calendar.apply_progress(tasks(spark, sf), progress(spark, sf)).select("task_id", "remaining_minutes", "status", "version")


@query("i8_stale_version_check", f"WITH {TASKS}, {_PROGRESS} SELECT task_id, count(*) AS n FROM progress LEFT JOIN tasks USING (task_id) WHERE expected_version IS DISTINCT FROM version GROUP BY 1")
def i8(spark, sf):
    r = progress(spark, sf).withColumnRenamed("expected_version", "version")
    return calendar.stale_requests(r, tasks(spark, sf), "task_id").groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


_NOW = "clocks AS (SELECT DISTINCT plan_id, day + INTERVAL 100 MINUTE AS now FROM days)"


@query(
    "i2_sleep_extension",
    f"""WITH {CAL}, {_NOW}, ext AS (SELECT DISTINCT plan_id, "end" AS ss FROM blocks WHERE kind = 'sleep_extension'),
    nx AS (SELECT c.plan_id, c.now, s."start" AS ss, s."end" AS se FROM clocks c ASOF JOIN sleep s ON c.plan_id = s.plan_id AND c.now < s."start"),
    k AS (SELECT * FROM nx WHERE NOT EXISTS (SELECT 1 FROM sleep s WHERE s.plan_id = nx.plan_id AND s."start" <= now AND now < s."end") AND NOT EXISTS (SELECT 1 FROM ext WHERE ext.plan_id = nx.plan_id AND ext.ss = nx.ss)),
    st0 AS (SELECT *, greatest(make_timestamp(CAST(ceil(epoch_us(now) / 900000000.0) AS BIGINT) * 900000000), ss - to_seconds(CAST(greatest(240 - (epoch(se) - epoch(ss)) / 60, 0) * 60 AS BIGINT))) AS st FROM k),
    pu AS (SELECT st0.plan_id, st0.now, max(b."end") AS af FROM st0 JOIN blocks b ON b.plan_id = st0.plan_id AND b."start" < ss AND b."end" > st GROUP BY ALL)
    SELECT plan_id, {st('now')} AS now, {st('greatest(st, coalesce(af, st))')} AS "start", {st('ss')} AS "end" FROM st0 LEFT JOIN pu USING (plan_id, now) WHERE epoch(ss) - epoch(greatest(st, coalesce(af, st))) >= 900""",
)
def i2(spark, sf):
    bl = blocks(spark, sf)
    now = days(bl).select("plan_id", (F.col("day") + F.expr("interval 100 minutes")).alias("now"))
    df = calendar.sleep_extension(now, sleep(bl), plan(bl), 240)
    return df.withColumns({c: text(F.col(c)) for c in ("now", "start", "end")})


@query("d9_split_at_local_midnight", f"WITH {BLOCKS}, l AS (SELECT plan_id, block_id, \"start\" AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS s, \"end\" AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS e FROM blocks), d AS (SELECT *, CAST(unnest(generate_series(date_trunc('day', s), e - INTERVAL 1 MICROSECOND, INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM l) SELECT plan_id, block_id, strftime(day, '%Y-%m-%d') AS day, greatest((epoch(s) - epoch(day)) / 60, 0) AS start_minute, least((epoch(e) - epoch(day)) / 60, 1440) AS end_minute FROM d")
def d9(spark, sf):
    df = validate.split_midnight(blocks(spark, sf), b.P.zone)
    return df.select("plan_id", "block_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "start_minute", "end_minute")


@query("k5_upcoming_deadlines", f"WITH {TASKS} SELECT task_id, title, {st('deadline')} AS deadline, round((epoch(deadline) - epoch(TIMESTAMP '1998-06-01 09:20:00')) / 3600, 2) AS hours_until, remaining_minutes FROM tasks WHERE status <> 'done' ORDER BY deadline, task_id")
def k5(spark, sf):
    df = calendar.upcoming(tasks(spark, sf), F.lit("1998-06-01 09:20:00").cast("timestamp"))
    return df.select("task_id", "title", text(F.col("deadline")).alias("deadline"), "hours_until", "remaining_minutes")
