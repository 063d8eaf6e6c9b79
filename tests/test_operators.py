"""Operators on small frames with results written by hand, and against plain loops."""

import collections
import datetime as dt
import itertools
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidelight.config import Params, Rules
from tidelight.functions import scalars, times
from tidelight.operators import baseline, minutes, nights, quality, readers, state, trigger
from tidelight.plans import calendar, validate
from tidelight.sources import files, sinks

NY = "America/New_York"
T0 = dt.datetime(2026, 10, 12, 2, 0)


def ts(s):
    return F.lit(s).cast("timestamp")


def one(spark, column):
    return spark.range(1).select(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSS").alias("x")).first().x


@pytest.mark.parametrize(
    ("local", "utc"),
    [("2026-11-01 01:30:00", None), ("2026-03-08 02:30:00", None), ("2026-11-01 00:30:00", "2026-11-01 04:30:00.000"), ("2026-11-01 02:00:00", "2026-11-01 07:00:00.000"), ("2026-03-08 03:00:00", "2026-03-08 07:00:00.000"), ("2020-02-13 12:00:00", "2020-02-13 17:00:00.000")],
)
def test_localize(spark, local, utc):
    assert one(spark, times.localize(ts(local), NY)) == utc


def test_calendar_shift_keeps_the_wall_clock(spark):
    assert one(spark, times.shift_days(ts("2020-02-13 17:00:00"), 2430, NY)) == "2026-10-09 16:00:00.000"
    assert one(spark, times.shift_days(ts("2020-03-10 16:00:00.125"), 2430, NY)) == "2026-11-04 17:00:00.125"


@pytest.mark.parametrize(("text", "utc"), [("2026-10-12T02:00:00Z", "2026-10-12 02:00:00.000"), ("2026-10-12T02:00:00+02:00", "2026-10-12 00:00:00.000"), ("20261012", None), ("", None), ("broken", None), ("2026-10-12 02:00:00", "2026-10-12 06:00:00.000")])
def test_parse_ts(spark, text, utc):
    assert one(spark, times.parse_ts(F.lit(text), NY)) == utc


def test_naive_time_needs_a_zone(spark):
    with pytest.raises(Exception, match="needs a zone"):
        one(spark, times.parse_ts(F.lit("2026-10-12 02:00:00")))


def test_nights_have_nine_to_eleven_hours(spark):
    for day, hours in (("2026-10-31", 11), ("2026-03-07", 9), ("2026-06-01", 10)):
        a, b = times.night_bounds(F.lit(day).cast("date"), NY, 22, 8)
        assert spark.range(1).select(((F.unix_seconds(b) - F.unix_seconds(a)) / 3600).alias("h")).first().h == hours


def test_small_functions(spark):
    got = spark.range(1).select(
        scalars.clamp01(F.lit(None).cast("double")).alias("null"), scalars.clamp01(F.lit(3.0)).alias("one"), scalars.duration_text(F.lit(125)).alias("hm"), scalars.duration_text(F.lit(120)).alias("h"), scalars.duration_text(F.lit(5)).alias("m"),
        scalars.parse_array_text(F.lit("['a','b']")).alias("list"), scalars.parse_array_text(F.lit(None).cast("string")).alias("none"), scalars.safe_identifier(F.lit("../x")).alias("bad"),
    ).first()
    assert (got.null, got.one, got.hm, got.h, got.m, got.list, got.none, got.bad) == (None, 1.0, "2 h 5 m", "2 h", "5 m", ["a", "b"], [], False)


def test_csv_scan_and_labels(spark, tmp_path):
    (tmp_path / "001").mkdir()
    lines = ["Timestamp, Value"]
    for i in range(20):
        at = (T0 + dt.timedelta(seconds=9 if i == 10 else i)).strftime("%Y-%m-%dT%H:%M:%SZ")
        lines.append({3: "broken,73", 5: f"{at},NaN", 8: f"{at},inf", 12: f"{at},-2"}.get(i, f"{at},{70 + i}"))
    (tmp_path / "001" / "HR.csv").write_text("\n".join(lines) + "\n")
    raw = files.scan_signal_csv(spark, f"file://{tmp_path}", "hr")
    assert raw.count() == 20
    rows = raw.select(F.lit("001").alias("participant_id"), F.lit("hr").alias("signal"), times.parse_ts(F.col("Timestamp")).alias("source_timestamp"), quality.cast_number(F.col("Value")).alias("value"), *[F.lit(None).cast("double").alias(c) for c in "xyz"], "source_row", F.lit("bpm").alias("unit"))
    by = ["participant_id", "signal"]
    got = {r.source_row: r for r in quality.label_quality(quality.flag_order(quality.flag_duplicates(rows, by), by)).collect()}
    assert sorted(k for k, r in got.items() if r.quality == "dropped") == [3, 5, 8]
    assert got[9].quality_reason == got[10].quality_reason == "duplicate_timestamp;"
    assert got[12].quality_reason == "negative_measurement;nonpositive_hr_or_ibi;"
    assert got[3].quality_reason == "invalid_or_ambiguous_timestamp;"


def test_csv_without_the_value_column_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Timestamp,Number\n2026-01-01T00:00:00Z,1\n")
    with pytest.raises(Exception, match="columns missing"):
        files.scan_signal_csv(spark, f"file://{tmp_path}", "hr").collect()


def test_two_files_for_a_signal_are_an_error(spark):
    listing = spark.createDataFrame([("d/001/HR.csv",), ("d/001/HR_001.csv",)], "path string")
    with pytest.raises(Exception, match="more than one file"):
        files.resolve_files(listing).collect()


def events(spark, rows):
    schema = "source_kind string, signal string, unit string, quality string, values map<string,double>"
    return spark.createDataFrame(rows, schema)


def test_policies(spark):
    hr = events(spark, [("recorded_replay", "hr", "bpm", q, {"value": v}) for q, v in (("valid", 70.0), ("flagged", 70.0), ("dropped", 70.0), ("valid", 500.0))])
    assert quality.usable_scalar(hr, "hr", 30, 220).count() == 1
    v = {"x": 1.0, "y": 2.0, "z": 3.0}
    acc = events(spark, [("synthetic_fixture", "acc", u, q, v) for u, q in (("unverified", "valid"), ("unverified", "flagged"), ("g", "flagged"), ("unverified", "dropped"))])
    assert quality.usable_vector(acc).count() == 2
    assert quality.usable_vector(acc, "exclude").count() == 1
    nan = events(spark, [("synthetic_fixture", "acc", "unverified", "flagged", v | {"y": float("nan")})])
    assert quality.usable_vector(nan).count() == 0


def silver_frame(spark, values, p, coverage=1.0):
    rows = [("r", "e", T0 + dt.timedelta(seconds=i * p.width_s), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, participant_id string, window_start timestamp, hr_mean double").withColumn("eda_mean", F.col("hr_mean") / 100)


def test_baseline_equals_a_loop_and_never_looks_ahead(spark):
    p = Params(refresh=5, max_history=40, warmup=12)
    rng = random.Random(5)
    values = [None if rng.random() < 0.2 else round(rng.uniform(50, 90), 2) for _ in range(130)]
    got = [r.hr_z for r in baseline.add_z(silver_frame(spark, values, p), p).orderBy("window_start").collect()]
    for i, v in enumerate(values):
        at = i - i % 5
        hist, prior = [x for x in values[max(0, at - 40) : at] if x is not None], sum(x is not None for x in values[:at])
        want = None
        if v is not None and prior >= 12 and hist:
            med = statistics.median(hist)
            want = (v - med) / max(1.4826 * statistics.median(abs(x - med) for x in hist), 1.0)
        assert got[i] == pytest.approx(want)
    changed = values[:100] + [200.0] * 30
    again = [r.hr_z for r in baseline.add_z(silver_frame(spark, changed, p), p).orderBy("window_start").collect()]
    assert again[:100] == got[:100]


def rest_loop(observed, candidate, bridge):
    """The longest run, by walking minute by minute."""
    best, i = (0, None), 0
    while i < len(candidate):
        if not candidate[i]:
            i += 1
            continue
        last, gap, n = i, 0, 0
        for j in range(i, len(candidate)):
            if candidate[j]:
                last, gap, n = j, 0, n + 1
            elif not observed[j]:
                break
            else:
                gap += 1
                if gap > bridge:
                    break
        if n > best[0]:
            best = (n, i)
        i = last + 1
    return best


def test_rest_runs_equal_a_loop(spark):
    rng, p = random.Random(3), Params(bridge=2, min_rest=1)
    rows, want = [], {}
    for night in range(60):
        observed = [rng.random() < 0.9 for _ in range(40)]
        candidate = [o and rng.random() < 0.55 for o in observed]
        want[f"rest-{night}"] = rest_loop(observed, candidate, 2)
        for i in range(40):
            rows.append(("r", "e", f"rest-{night}", T0, T0 + dt.timedelta(minutes=40), T0 + dt.timedelta(minutes=i), observed[i], candidate[i], 0.0))
    grid = spark.createDataFrame(rows, "run_id string, participant_id string, night_id string, night_start timestamp, night_end timestamp, window_start timestamp, observed boolean, candidate boolean, hr_z double")
    for r in nights.rest_runs(grid, p).withColumn("at", ((F.unix_seconds("run_start") - F.unix_seconds("night_start")) / 60).cast("int")).collect():
        assert (r.minutes, r.at) == want[r.night_id]


def test_gap_is_null_and_coverage_zero(spark):
    p = Params(expected={"hr": 60, "eda": 60, "acc": 60})
    rows = [("r", "e", "recorded_replay", "hr", "bpm", "valid", T0 + dt.timedelta(minutes=m, seconds=s), {"value": 70.0}, m * 60 + s + 1) for m in (0, 1, 4) for s in range(30)]
    bronze = spark.createDataFrame(rows, "run_id string, participant_id string, source_kind string, signal string, unit string, quality string, event_time timestamp, values map<string,double>, source_row long")
    got = minutes.silver(bronze, p).orderBy("window_start").collect()
    assert [r.hr_mean for r in got] == [70.0, 70.0, None, None, 70.0]
    assert [r.hr_coverage for r in got] == [0.5, 0.5, 0.0, 0.0, 0.5]


def trigger_row(spark, **changes):
    base = {"sustained": True, "recovery_score": 0.3, "overnight_coverage": 0.9, "deadline_pressure": 0.5, "baseline_id": "b", "status": "sufficient", "activity_confound": False, "has_flexible": True, "pending": False, "cooling": False, "armed": True} | changes
    df = spark.range(1)
    for k, v in base.items():
        df = df.withColumn(k, F.lit(v).cast("double" if k in ("recovery_score", "overnight_coverage", "deadline_pressure") else "string" if k in ("baseline_id", "status") else "boolean"))
    return trigger.evaluate(df.withColumns({"as_of": ts("2026-10-13 03:20:00"), "baseline_cutoff": ts("2026-10-13 03:10:00")}), Rules()).first()


@pytest.mark.parametrize(
    ("changes", "code"),
    [({"recovery_score": None}, "RECOVERY_UNKNOWN"), ({"overnight_coverage": 0.2}, "INSUFFICIENT_OVERNIGHT_EVIDENCE"), ({"baseline_id": None}, "INSUFFICIENT_BASELINE"), ({"status": "limited"}, "INSUFFICIENT_DATA"), ({"activity_confound": True}, "ACTIVITY_CONFOUND"), ({"has_flexible": False}, "NO_FLEXIBLE_BLOCK"), ({"pending": True}, "PENDING_DECISION"), ({"cooling": True}, "COOLDOWN"), ({"armed": False}, "AWAITING_RESET")],
)
def test_each_gate_suppresses(spark, changes, code):
    r = trigger_row(spark, **changes)
    assert r.suppressed == [code]
    assert not r.fire


def test_trigger_fires(spark):
    r = trigger_row(spark)
    assert r.reason_codes == ["SUSTAINED_LOAD", "LIMITED_ESTIMATED_REST", "HIGH_PRESSURE"]
    assert r.fire
    assert trigger_row(spark, sustained=False).fire is False


def test_as_of_takes_the_last_not_later_row(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z")], "k string, t int, v string")
    got = {(r.k, r.at): r.found and r.found.v for r in readers.as_of(left, right, ["k"], "at", "t", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None}
    nxt = {(r.k, r.at): r.n for r in readers.next_after(left, right, ["k"], "at", "t", "n").collect()}
    assert nxt == {("a", 5): 6, ("a", 1): 2, ("b", 9): None}


def test_next_after_reads_each_row_once(spark):
    """Rows of one clock are one; nothing follows a clock or key that is null, and each frame grows by a row."""
    left = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 6, 3), ("a", None, 4), (None, 1, 5), ("c", 1, 6), ("a", -3, 7)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 6), ("a", 6), ("a", 2), ("a", None), (None, 3), ("b", 7)], "k string, t int")
    df = readers.next_after(left, right, ["k"], "at", "t", "n")
    assert df.columns == ["k", "at", "id", "n"]
    assert {r.id: r.n for r in df.collect()} == {1: 6, 2: 6, 3: None, 4: None, 5: None, 6: None, 7: 2}
    assert "unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString()


def test_state_needs_a_reason_for_every_null(spark):
    q = '{"status":"limited","missing_reasons":{"physiological_load":"baseline_warmup"}}'
    rows = [(70.0, None, 0.1, 5, 0.2, q), (None, None, 0.1, 5, 0.2, q), (70.0, 1.5, 0.1, -5, 0.2, q)]
    df = spark.createDataFrame(rows, "heart_rate_bpm double, physiological_load double, activity_level double, estimated_rest_minutes int, recovery_score double, quality_json string")
    assert sorted(r.broken for r in state.state_violations(df).collect()) == [["heart_rate_bpm_null_without_reason"], ["physiological_load_out_of_range", "negative_rest"]]


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def block_frame(spark, rows):
    return spark.createDataFrame([(1, f"b{i}", t, k, at(s), at(e), False) for i, (t, k, s, e) in enumerate(rows)], "plan_id int, block_id string, task_id string, kind string, start timestamp, end timestamp, locked boolean")


def spans(spark, rows, name="interval_id"):
    return spark.createDataFrame([(1, f"i{i}", at(s), at(e)) for i, (s, e) in enumerate(rows)], f"plan_id int, {name} string, start timestamp, end timestamp")


def test_free_segments(spark):
    got = validate.free_segments(spans(spark, [(0, 100), (100, 120), (200, 300)]), spans(spark, [(10, 20), (15, 30), (90, 210), (300, 400)])).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(at(0), at(10)), (at(30), at(90)), (at(210), at(300))]


def test_overlaps_across_midnight(spark):
    blocks = block_frame(spark, [("a", "study", 1200, 1500), ("b", "study", 1400, 1600), ("c", "study", 1600, 1700)])
    assert [(r.first, r.second) for r in validate.overlaps(blocks).collect()] == [("b0", "b1")]
    assert [r.block_id for r in validate.overlapping_blocks(blocks).collect()] == ["b1"]


def test_plan_diff_of_equal_plans_is_empty(spark):
    plan = block_frame(spark, [("a", "study", 0, 60), ("b", "study", 60, 90), (None, "sleep_extension", 100, 160)])
    assert validate.plan_diff(plan, plan).count() == 0
    new = block_frame(spark, [("a", "study", 0, 60), ("c", "study", 60, 90)])
    got = {r.key: (r.change_id, r.action, r.reason_code) for r in validate.plan_diff(plan, new).collect()}
    assert got == {"_sleep": ("chg-1", "removed", "PROTECT_REST"), "b": ("chg-2", "removed", "MAKE_ROOM"), "c": ("chg-3", "added", "MEET_DEADLINE")}


def test_validation_finds_study_in_sleep(spark):
    tasks = spark.createDataFrame([(1, "a", 60, "open", at(5000), True, 30)], "plan_id int, task_id string, remaining_minutes int, status string, deadline timestamp, splittable boolean, minimum_block_minutes int")
    none = spark.createDataFrame([], "plan_id int, task_id string, minutes int")
    check = lambda rows, sleep: validate.validate_plans(block_frame(spark, rows), tasks, spans(spark, [(0, 600)]), spans(spark, [], "event_id"), spans(spark, sleep), none).first()
    assert check([("a", "study", 0, 60)], [(600, 900)]).passed
    bad = check([("a", "study", 0, 60)], [(30, 900)])
    assert (bad.passed, bad.protected_sleep, bad.no_overlap, bad.deadlines_met) == (False, False, False, True)


def faults_of(blocks, tasks, allowed, fixed, sleep, left, longest):
    """The checks of one plan, each by its definition; rows as in the test below."""
    study = [b for b in blocks if b[1] == "study"]
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    span = lambda b: b[2:4]
    known = {t[0]: t for t in tasks}
    todo = {k: t for k, t in known.items() if t[2] != "done" and t[1] > 0}
    mine = {k: [b[3] - b[2] for b in study if b[0] == k] for k in todo}
    asleep = any(meets(span(b), x) for b in study for x in sleep)
    return {
        "no_overlap": not (asleep or any(meets(span(a), span(b)) for a, b in itertools.combinations(blocks, 2)) or any(meets(span(b), x) for b in study for x in fixed)),
        "within_allowed": all(any(a <= b[2] and b[3] <= z for a, z in allowed) for b in study),
        "deadlines_met": all(b[3] <= todo[b[0]][3] for b in study if b[0] in todo),
        "minutes_conserved": all(sum(mine[k]) + sum(m for o, m in left if o == k) == t[1] for k, t in todo.items()) and all(b[0] in known for b in study),
        "min_block_size": all(m >= min(t[5], t[1]) for k, t in todo.items() for m in mine[k]) and all(t[4] or len(mine[k]) < 2 for k, t in todo.items()),
        "max_continuous": all(m <= longest for k in todo for m in mine[k]),
        "protected_sleep": not asleep,
    }


def test_validation_equals_brute_force(spark):
    rng, plans = random.Random(12), []
    for _ in range(150):
        tasks = [(k, rng.choice([30, 60, 90]), rng.choice(["open", "open", "done"]), rng.choice([200, 2000]), rng.random() < 0.7, rng.choice([15, 45])) for k in "ab"]
        blocks, t = [], 0
        for _ in range(rng.randint(1, 4)):
            t += rng.choice([-15, 0, 0, 30])
            n = rng.choice([30, 60, 60, 90])
            blocks.append((rng.choice("aabc"), rng.choice(["study", "study", "fixed"]), max(t, 0), max(t, 0) + n))
            t += n
        some = lambda n, far: [(a, a + rng.choice([60, 400])) for a in (rng.randint(0, far) for _ in range(rng.randint(0, n)))]
        plans.append((blocks, tasks, [(0, rng.choice([200, 600])), *some(1, 300)], some(1, 600), some(1, 900), [(k, rng.choice([30, 60])) for k in "ab" if rng.random() < 0.3]))
    of = lambda rows: [(p, *r) for p, plan in enumerate(plans) for r in rows(plan)]
    b = spark.createDataFrame([(p, f"b{i}", k, kind, at(s), at(e)) for p, plan in enumerate(plans) for i, (k, kind, s, e) in enumerate(plan[0])], "plan_id int, block_id string, task_id string, kind string, start timestamp, end timestamp")
    t = spark.createDataFrame(of(lambda plan: [(k, m, s, at(d), x, n) for k, m, s, d, x, n in plan[1]]), "plan_id int, task_id string, remaining_minutes int, status string, deadline timestamp, splittable boolean, minimum_block_minutes int")
    frames = [spark.createDataFrame(of(lambda plan, i=i: [(at(s), at(e)) for s, e in plan[i]]), "plan_id int, start timestamp, end timestamp") for i in (2, 3, 4)]
    left = spark.createDataFrame(of(lambda plan: plan[5]), "plan_id int, task_id string, minutes int")
    got = {r.plan_id: r for r in validate.validate_plans(b, t, *frames, left, 60).collect()}
    seen = collections.Counter()
    for p, plan in enumerate(plans):
        want = faults_of(*plan, 60)
        assert {c: got[p][c] for c in validate.CHECKS} == want, plan
        assert got[p].passed == all(want.values())
        seen.update(c for c, ok in want.items() if ok)
    assert all(5 < seen[c] < 149 for c in validate.CHECKS)


def test_progress_and_versions(spark):
    tasks = spark.createDataFrame([("a", 50, "open", 1), ("b", 20, "open", 1)], "task_id string, remaining_minutes int, status string, version int")
    progress = spark.createDataFrame([("a", 20, 1), ("a", 10, 1), ("b", 99, 1), ("b", 5, 0)], "task_id string, minutes int, expected_version int")
    got = {r.task_id: (r.remaining_minutes, r.status, r.version) for r in calendar.apply_progress(tasks, progress).collect()}
    assert got == {"a": (20, "in_progress", 2), "b": (0, "done", 2)}


def test_sinks_are_idempotent(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    u = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    once = sinks.upsert(t, u, ["k"])
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, sinks.upsert(once, u, ["k"]).collect()), key=repr) == [(1, "a"), (2, None), (3, "c")]
    assert sorted(map(tuple, sinks.update_columns(t, u, ["k"], ["v"]).collect())) == [(1, "a"), (2, None)]
    assert [r.k for r in sinks.insert_new(t, u.unionAll(u), ["k"]).collect()] == [3]


def test_insert_reads_the_batch_range_of_the_target(spark, tmp_path):
    path = f"file://{tmp_path}/target"
    spark.range(100).select((F.col("id") % 10).alias("day"), "id").write.partitionBy("day").parquet(path)
    target = spark.read.schema("id long, day int").parquet(path)
    batch = spark.createDataFrame([(3, 4), (3, 13), (4, 999), (4, 999), (5, 15)], "day int, id long")
    new = sinks.insert_new(target, batch, ["day", "id"], within="day")
    assert sorted(map(tuple, new.select("day", "id").collect())) == [(3, 4), (4, 999)]
    assert "PartitionFilters: [isnotnull(day" in new._jdf.queryExecution().executedPlan().toString()
    assert sinks.insert_new(target, batch.limit(0), ["day", "id"], within="day").count() == 0
    odd = spark.createDataFrame([(None, 1)], "day int, id long")
    assert sinks.insert_new(target, odd, ["day", "id"], within="day").count() == 1


def test_manifest_refuses_other_content(spark, tmp_path):
    df = spark.createDataFrame([("r", "hr", 1.0), ("r", "eda", 2.0)], "run_id string, signal string, v double")
    root = f"file://{tmp_path}/landing"
    first = sorted(map(tuple, files.write_with_manifest(df, root, "b1").collect()))
    assert first == sorted(map(tuple, files.write_with_manifest(df, root, "b1").collect()))
    with pytest.raises(ValueError, match="other content"):
        files.write_with_manifest(df.withColumn("v", F.col("v") + 1), root, "b1")


def test_export_refuses_recorded_rows(spark, tmp_path):
    df = spark.createDataFrame([("recorded_replay", T0)], "source_kind string, window_end timestamp")
    with pytest.raises(ValueError, match="may not be exported"):
        sinks.export_state(df, f"file://{tmp_path}/x")
