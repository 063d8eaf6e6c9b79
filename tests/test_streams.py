"""Streams against the batch operators on the same rows."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from tidelight.config import Params, Rules
from tidelight.operators import baseline, minutes, nights, state, trigger
from tidelight.sources.layers import new_path
from tidelight.streaming import stateful, streams

T0 = dt.datetime(2026, 10, 12)
P = Params(expected={"hr": 2, "eda": 2, "acc": 2}, trailing_s=120, refresh=5, max_history=20, warmup=5)
EVENT = "run_id string, event_id string, participant_id string, source_kind string, signal string, unit string, quality string, event_time timestamp, values map<string,double>, source_row long"


def events(spark):
    """Two entities over an hour; the second says nothing for twenty minutes. Seconds are odd, so that parts are cut inside a minute."""
    rng, rows = random.Random(7), []
    for who in ("a", "b"):
        for s in range(7, 3600, 13):
            if who == "b" and 1200 < s < 2400:
                continue
            signal = rng.choice(["hr", "eda", "acc"])
            values = {k: rng.uniform(40, 90) for k in "xyz"} if signal == "acc" else {"value": rng.uniform(40, 90)}
            n = len(rows) + 1
            rows.append(("r", f"e{n}", who, "synthetic_fixture", signal, "unverified" if signal == "acc" else "u", "valid", T0 + dt.timedelta(seconds=s), values, n))
    return spark.createDataFrame(rows, EVENT)


def in_files(df, path, cuts):
    """A file for each part of the seconds since T0."""
    seconds = F.unix_micros("event_time") / 1_000_000 - T0.replace(tzinfo=dt.UTC).timestamp()
    for a, b in itertools.pairwise(cuts):
        df.filter((seconds >= a) & (seconds < b)).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain(df, columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=repr)


Z = ["participant_id", "window_start", "hr_mean", "eda_mean", "acc_mean", "stillness", "acc_coverage", "hr_z", "hr_z_reason", "eda_z", "baseline_n_valid", "baseline_cutoff"]


def test_layers_in_parts_equal_one_batch(spark):
    df, root, src = events(spark), new_path(spark, "layers"), new_path(spark, "source")
    in_files(df, src, [0, 631, 1411, 2003, 3600])
    streams.run_available(stream(spark, src, df.schema), f"{root}-checkpoint", each=streams.layers_batch(root, P, 120))
    end = F.lit(T0 + dt.timedelta(seconds=3595 - 120))  # the newest event is at 3595
    want = baseline.add_z(minutes.silver(df, P), P).filter(F.col("window_end") <= end)
    assert plain(spark.read.parquet(f"{root}/silver_z"), Z) == plain(want, Z)


def days_of_events(spark, days=4):
    """Two entities, an event each 20 minutes, two a night silent; half of the heart rates are of no use on the second day."""
    rng, rows = random.Random(3), []
    for who in ("a", "b"):
        for s in range(300, days * 86_400, 1200):
            if who == "b" and 90_000 < s < 120_000:
                continue
            signal = ("hr", "eda", "acc")[s // 1200 % 3]
            still = 1.0 if s // 3600 % 24 < 9 else rng.uniform(0, 60)
            values = dict.fromkeys("xyz", still) if signal == "acc" else {"value": 500.0 if signal == "hr" and 86_400 < s < 172_800 and rng.random() < 0.7 else rng.uniform(50, 90)}
            n = len(rows) + 1
            rows.append(("r", f"e{n}", who, "synthetic_fixture", signal, "unverified" if signal == "acc" else "u", "valid", T0 + dt.timedelta(seconds=s), values, n))
    return spark.createDataFrame(rows, EVENT)


HOURLY = Params(width_s=3600, expected={"hr": 1, "eda": 1, "acc": 1}, trailing_s=7200, still_below=0.4, refresh=4, max_history=24, warmup=6, activity_full=1.0, still_ratio=0.5, bridge=1, min_rest=1, min_overnight=0.3, target_rest=10, recent=5)
GOLD = ["participant_id", "window_end", "physiological_load", "estimated_rest_minutes", "recovery_score", "quality_json", "evidence_ids"]


def test_what_layers_carry_is_bounded(spark):
    """Batch after batch over days: the result is that of one batch, and what a batch reads is as much at the end as at first."""
    df, root = days_of_events(spark), new_path(spark, "layers")
    each = streams.layers_batch(root, HOURLY, 120)
    seconds = F.unix_micros("event_time") / 1_000_000 - T0.replace(tzinfo=dt.UTC).timestamp()
    cuts = [0, 40_000, 90_001, 170_000, 250_000, 4 * 86_400]
    carried = []
    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
        batch = df.filter((seconds >= a) & (seconds < b))
        each(batch, k)
        if k == 2:
            each(batch, k)  # a replay
        carried.append({name: spark.read.parquet(f"{root}/carry/{name}/{k}").count() for name in ("rows", "buckets", "windows", "progress")})
    end = F.lit(T0 + dt.timedelta(seconds=4 * 86_400 - 1200 + 300 - 120))
    z = baseline.add_z(minutes.silver(df, HOURLY), HOURLY)
    assert plain(spark.read.parquet(f"{root}/silver_z"), Z) == plain(z.filter(F.col("window_end") <= end), Z)
    rest = nights.rest_runs(nights.night_grid(z, nights.night_bounds(z, HOURLY), HOURLY), HOURLY)
    want = plain(state.gold(nights.attach_night(z, rest), HOURLY).filter(F.col("window_end") <= end), GOLD)
    assert plain(spark.read.parquet(f"{root}/gold"), GOLD) == want
    assert sum(r[2] is not None for r in want) > 20 and len({r[4] for r in want}) > 2
    bound = {"rows": 2 * 3 * 6, "buckets": 2 * 7, "windows": 2 * 26, "progress": 2}
    assert all(c[k] <= bound[k] for c in carried for k in bound), carried


def test_a_key_is_taken_once(spark):
    src, out = new_path(spark, "again"), new_path(spark, "once")
    batch = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "2")], "run_id string, event_id string")
    for _ in range(2):
        batch.coalesce(1).write.mode("append").parquet(src)
        streams.run_available(streams.once(stream(spark, src, batch.schema), ["run_id", "event_id"]), f"{out}-checkpoint", out)
    assert spark.read.parquet(out).count() == 2
    target = new_path(spark, "parts")
    for _ in range(3):
        streams.append_once(target)(batch, 0)
    assert spark.read.parquet(target).count() == 3


MARK = "run_id string, participant_id string, at timestamp, kind int, load double"


def at(m):
    return T0 + dt.timedelta(minutes=m)


def decided(spark, parts, rules, **kw):
    src, out = new_path(spark, "marks"), new_path(spark, "decisions")
    for part in parts:
        spark.createDataFrame([("r", e, at(m), k, v) for e, m, k, v in part], MARK).coalesce(1).write.mode("append").parquet(src)
    df = stateful.decisions(stream(spark, src, MARK), rules, **kw)
    streams.run_available(df, f"{out}-checkpoint", out)
    return sorted((r.participant_id, r.window_end, r.armed, r.cooling) for r in spark.read.schema(df.schema).parquet(out).collect())


def test_decisions_are_the_batch_rules_whatever_the_cuts(spark):
    rules, rng = Rules(reset=0.3, cooldown_minutes=25), random.Random(8)
    marks = [(e, m, 1, rng.choice([None, 0.1, 0.5, 0.9])) for e in "ab" for m in range(0, 200, 5)]
    marks += [(e, m, 2, None) for e in "ab" for m in rng.sample(range(200), 6)] + [("a", 40, 2, None)]
    marks.sort(key=lambda m: m[1])
    df = spark.createDataFrame([("r", e, at(m), k, v) for e, m, k, v in marks], MARK)
    loads = df.filter("kind = 1").select("run_id", "participant_id", F.col("at").alias("window_end"), F.col("at").alias("as_of"), F.col("load").alias("physiological_load"))
    used = df.filter("kind = 2").select("run_id", "participant_id", F.col("at").alias("consumed_at"))
    batch = trigger.cooldown(trigger.armed(loads, used, rules), used.withColumnRenamed("consumed_at", "applied_at"), 25, ["run_id", "participant_id"])
    clock = {e: max(m for x, m, *_ in marks if x == e) for e in "ab"}
    want = sorted((r.participant_id, r.window_end, r.armed, r.cooling) for r in batch.collect() if r.window_end < at(clock[r.participant_id]))
    assert len({w[2:] for w in want}) >= 3
    assert decided(spark, [marks], rules) == want
    assert decided(spark, [marks[:17], marks[17:18], marks[18:60], marks[60:]], rules) == want


def test_marks_out_of_order_wait_for_their_entity(spark):
    """b lags far behind a; within the delay marks may come in any order."""
    rules = Rules(reset=0.3, cooldown_minutes=25)
    a = [("a", 100, 1, 0.9), ("a", 90, 2, None), ("a", 130, 1, 0.9)]
    b = [("b", 10, 1, 0.9), ("b", 5, 2, None), ("b", 40, 1, 0.2), ("b", 80, 1, 0.9)]
    got = decided(spark, [a[:1], a[1:], b[:1], b[1:]], rules, delay_s=1200)
    assert got == [("a", at(100), False, True), ("b", at(10), False, True), ("b", at(40), True, False)]


EVENTS = "run_id string, participant_id string, event_time timestamp, v double"


def windows_of(spark, parts, **kw):
    src, out = new_path(spark, "beats"), new_path(spark, "windows")
    for part in parts:
        spark.createDataFrame([("r", e, T0 + dt.timedelta(seconds=s), v) for e, s, v in part], EVENTS).coalesce(1).write.mode("append").parquet(src)
    df = stateful.entity_windows(stream(spark, src, EVENTS), P, **kw)
    streams.run_available(df, f"{out}-checkpoint", out)
    return sorted((r.participant_id, (r.window_start - T0).seconds, r["mean"], r["min"], r["max"], r.n) for r in spark.read.schema(df.schema).parquet(out).collect())


def test_a_lagging_entity_loses_nothing_that_is_on_time_for_itself(spark):
    ahead = [("a", s, float(s)) for s in (10, 70, 4000, 5000)]
    behind = [[("b", 20, 1.0), ("b", 50, 3.0)], [("b", 30, None), ("b", 65, 7.0), ("b", 200, 5.0)], [("b", 40, 9.0), ("b", 400, 1.0)]]
    got = windows_of(spark, [ahead, *behind], delay_s=120)
    # 40 is late for b itself: its window came out when b was at 200.
    assert got == [("a", 0, 10.0, 10.0, 10.0, 1), ("a", 60, 70.0, 70.0, 70.0, 1), ("a", 3960, 4000.0, 4000.0, 4000.0, 1), ("b", 0, 2.0, 1.0, 3.0, 2), ("b", 60, 7.0, 7.0, 7.0, 1), ("b", 180, 5.0, 5.0, 5.0, 1)]


def test_timers_release_an_entity_that_has_gone_silent(spark):
    parts = [[("a", 10, 1.0), ("b", 20, 2.0)], [("b", 2000, 4.0)], [("b", 2500, 5.0)]]
    assert windows_of(spark, parts, delay_s=120) == [("b", 0, 2.0, 2.0, 2.0, 1), ("b", 1980, 4.0, 4.0, 4.0, 1)]
    assert windows_of(spark, parts, delay_s=120, patience_s=900) == [("a", 0, 1.0, 1.0, 1.0, 1), ("b", 0, 2.0, 2.0, 2.0, 1), ("b", 1980, 4.0, 4.0, 4.0, 1)]


def test_late_rows_correct_the_view(spark):
    view = streams.LateView(spark, new_path(spark, "view"), P)
    rows = lambda *x: spark.createDataFrame([("r", "a", T0 + dt.timedelta(seconds=s), v) for s, v in x], EVENTS)
    view(rows((10, 1.0), (70, 2.0)), 0)
    view(rows((100_000, 3.0), (30, None)), 1)
    view(rows((20, 5.0)), 2)
    view(rows((20, 5.0)), 2)  # a replay
    want = [(0, 3.0, 1.0, 5.0, 2), (60, 2.0, 2.0, 2.0, 1), (99_960, 3.0, 3.0, 3.0, 1)]
    told = lambda v: sorted((round((r.window_start - T0).total_seconds()), r["mean"], r["min"], r["max"], r.n) for r in v.rows().collect())
    assert told(view) == want
    small = view.compact(new_path(spark, "compact"))
    assert told(small) == want and small.parts().count() == 3 and view.parts().count() == 5


def test_the_session_keeps_its_settings(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with streams.settings(spark, {key: "other", "spark.tidelight.none": "x"}):
        assert spark.conf.get(key) == "other"
    assert spark.conf.get(key) == before and spark.conf.get("spark.tidelight.none", None) is None


def test_a_run_has_no_limit_of_its_own(spark):
    """However long a stream takes it is done; only a limit that the caller names stops it."""
    waits = []

    class Query:
        def awaitTermination(self, *limit):  # noqa: N802
            waits.append(limit)
            return not limit or None

        def stop(self):
            waits.append("stopped")

    class Writer:
        sparkSession = spark  # noqa: N815
        writeStream = property(lambda self: self)  # noqa: N815
        outputMode = option = trigger = format = lambda self, *a, **k: self  # noqa: N815

        def start(self):
            return Query()

    streams.run_available(Writer(), "checkpoint", "path")
    assert waits == [()]
    try:
        streams.run_available(Writer(), "checkpoint", "path", timeout_s=1)
    except TimeoutError:
        waits.append("error")
    assert waits == [(), (1,), "stopped", "error"]
