"""Keys of any size: what is dealt over tasks equals one window, one sort or one read."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelight.config import ENTITY
from tidelight.operators import hrv, minutes, profile, quality, sharded
from tidelight.sources import files
from tidelight.streaming.streams import settings

T0 = dt.datetime(2026, 10, 12)


def folder(tmp_path, texts):
    for name, text in texts.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text)
    return str(tmp_path)


@pytest.mark.parametrize("split", [37, 500, 1 << 20])
def test_rows_of_split_files_have_their_places(spark, tmp_path, split):
    rng = random.Random(split)
    lines = {w: [f"{'x' * rng.randint(0, 30)}{i},{i}" if i % 7 else "" for i in range(rng.randint(5, 90))] + ["z,0"] for w in ("a", "b", "c")}
    path = folder(tmp_path, {f"{w}/HR.csv": "\n".join([" Timestamp , Value", *x]).encode() + b"\n" * (w != "b") for w, x in lines.items()})
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}):
        df = files.scan_signal_csv(spark, path, "hr")
        got = df.collect()
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    for who, x in lines.items():
        told = sorted((r.source_row, r.Timestamp, r.Value) for r in got if f"/{who}/" in r.source_file)
        assert told == [(k, *(v.split(",") if v else ("", None))) for k, v in enumerate(x)]
    # The only window is over the splits' counts.
    assert plan.count("Window [") <= 2 and "row_number" not in plan


def test_headers_that_lack_a_column_are_an_error(spark, tmp_path):
    path = folder(tmp_path, {"HR.csv": b"Timestamp,Other\n1,2\n"})
    with pytest.raises(Exception, match="columns missing"):
        files.scan_signal_csv(spark, path, "hr").collect()


def test_fingerprints_from_lines_are_those_of_the_bytes(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"f{k}": b"\n".join(rng.randbytes(rng.randint(0, 60)).replace(b"\n", b"") for _ in range(rng.randint(1, 400))) + tail for k, tail in enumerate([b"", b"\n", b"\n\n", b"\r\n", b"\r", b"x"])}
    texts |= {"one": b"\n", "plain": b"a", "empty": b""}
    path = folder(tmp_path, texts)
    want = {(k, hashlib.sha256(v).hexdigest(), len(v)) for k, v in texts.items() if v}
    for split, whole in ((100, 0), (1 << 20, 0), (100, 2000), (1 << 20, 1 << 20)):
        with settings(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}):
            got = files.file_fingerprints(spark, path, whole).collect()
        assert {(r.path.rsplit("/", 1)[1], r.sha256, r.size) for r in got} == want


def rows_of(spark, n=400, seed=5):
    rng = random.Random(seed)
    rows = [("r", rng.choice("aab"), None if rng.random() < 0.05 else T0 + dt.timedelta(seconds=rng.randint(0, 3000)), i, rng.uniform(0, 9)) for i in range(n)]
    return spark.createDataFrame(rows, "run_id string, participant_id string, event_time timestamp, source_row long, v double")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 7, 64, 10_000])
def test_order_flags_and_gaps_wherever_the_cuts_are(spark, size):
    df = rows_of(spark)
    by = ["participant_id"]
    before = F.lag("event_time").over(Window.partitionBy(*by).orderBy("source_row"))
    assert same(quality.flag_order(df, by, "event_time", size=size), df.withColumn("backwards", F.coalesce(F.col("event_time") < before, F.lit(False))))
    before = F.lag("event_time").over(Window.partitionBy(*by).orderBy("event_time", "source_row"))
    want = df.withColumn("gap", (F.unix_micros("event_time") - F.unix_micros(before)) / 1_000_000)
    assert same(profile.gaps(df, by, "event_time", size), want)
    t = df.withColumnRenamed("event_time", "source_timestamp")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("gap"), "source_row"))
    top = want.filter("gap IS NOT NULL").withColumn("_k", place).filter("_k <= 5").drop("_k").withColumnRenamed("event_time", "source_timestamp")
    assert same(profile.largest_gaps(t, by, 5, size), top)


def test_previous_across_empty_ranges_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1, "p"), (None, 900, "q"), ("k", 5, "r"), ("k", 6, None), ("k", 5000, "s")], "k string, at long, v string")
    got = {(r.k, r["at"]): r.previous and r.previous.v for r in sharded.previous(df, ["k"], ["at"], ["v"], sharded.by_place("at", 10)).collect()}
    assert got == {(None, 1): None, (None, 900): "p", ("k", 5): None, ("k", 6): "r", ("k", 5000): None}
    assert sharded.previous(df.limit(0), ["k"], ["at"], ["v"], sharded.by_place("at", 10)).count() == 0


@pytest.mark.parametrize("shard", [1, 13, 600, 100_000])
def test_trailing_means_with_a_halo(spark, shard):
    df = rows_of(spark).filter("event_time IS NOT NULL")
    frame = Window.partitionBy(*ENTITY).orderBy(F.unix_micros("event_time")).rangeBetween(-10_000_000 + 1, 0)
    r = lambda x: x.select(*df.columns, F.round("trailing", 9).alias("t"))
    assert same(r(minutes.trailing_mean(df, "v", 10, shard_s=shard)), r(df.withColumn("trailing", F.avg("v").over(frame))))


@pytest.mark.parametrize("bins,few", [(2, 1), (16, 3), (1024, 10_000)])
def test_quantiles_by_rounds_are_exact(spark, bins, few):
    rng = random.Random(bins)
    rows = [("hot", rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5)), 1e9 * rng.random()])) for _ in range(700)]
    rows += [("two", 1.0), ("two", 2.0), ("one", 3.5), ("none", None), ("flat", 2.0), ("flat", 2.0), (None, -1.0), (None, 1e-300), (None, 5.0), ("nan", float("nan")), ("nan", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.9) if bins > 2 else (0.5,):
        got = {r.k: r.x for r in sharded.quantile(df, ["k"], "v", q, "x", bins, few).collect()}
        want = {r.k: r.x for r in df.filter("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.percentile("v", F.lit(q)).alias("x")).collect()}
        assert got == pytest.approx(want, rel=1e-12), q


def variability(beats, seconds, gap):
    """rows are (time, row, value) of one entity in order."""
    out = []
    for i, (t, _, _) in enumerate(beats):
        own = [b for b in beats[: i + 1] if b[0] > t - seconds]
        own += [b for b in beats[i + 1 :] if b[0] == t]
        clean = len(own) > 1 and own[0][0] - (t - seconds + 1) <= gap and all(b[0] - a[0] <= gap for a, b in itertools.pairwise(own))
        v = [b[2] for b in own]
        rmssd = math.sqrt(sum((b - a) ** 2 for a, b in itertools.pairwise(v)) / (len(v) - 1)) if clean else None
        out.append((clean, rmssd, statistics.stdev(v) if clean else None))
    return out


@pytest.mark.parametrize("shard", [3, 50, 100_000])
def test_variability_is_of_segments_without_a_gap(spark, shard):
    rng, beats, t = random.Random(6), [], 0.0
    for i in range(300):
        t += 8.0 if i in (90, 200) else rng.choice([0.0, 0.7, 0.9, 1.1])
        beats.append((t, i, rng.uniform(0.6, 1.2)))
    rows = [("r", "a", T0 + dt.timedelta(microseconds=round(1e6 * t)), i, v) for t, i, v in beats] + [("r", "b", T0, 0, 1.0)]
    df = spark.createDataFrame(rows, "run_id string, participant_id string, event_time timestamp, source_row long, v double")
    got = hrv.variability(df, seconds=20, max_gap_s=2.5, shard_s=shard).orderBy("participant_id", "source_row").collect()
    want = variability([(round(1e6 * t), i, v) for t, i, v in beats], 20_000_000, 2_500_000)
    for r, (clean, rmssd, sdnn) in zip(got[:-1], want, strict=True):
        assert r.clean == clean and (r.rmssd, r.sdnn) == (pytest.approx(rmssd, abs=1e-7), pytest.approx(sdnn, abs=1e-9)), r
    assert sum(w[0] for w in want) > 100 and not got[-1].clean


def slides(df):
    """Whether a plan has a frame whose start moves with the row, which Spark sums up anew for each row."""
    return re.search(r"specifiedwindowframe\(RangeFrame, -\d", df._jdf.queryExecution().analyzed().toString()) is not None


def test_variability_adds_each_beat_once(spark):
    """4,000 beats in a frame of 4,000, many at one time, before 1970 and around it, and two without a time."""
    rng = random.Random(9)
    beats = sorted((rng.randint(-2_000, 2_000), i, rng.uniform(0.6, 1.2)) for i in range(4_000))
    beats = [(t, i, v) for i, (t, _, v) in enumerate(beats)]
    zero = dt.datetime(1970, 1, 1)
    rows = [("r", "a", zero + dt.timedelta(seconds=t), i, v) for t, i, v in beats] + [("r", "a", None, -k, 1.0) for k in (1, 2)]
    df = spark.createDataFrame(rows, "run_id string, participant_id string, event_time timestamp, source_row long, v double")
    got = hrv.variability(df, seconds=4_000, max_gap_s=60)
    assert not slides(got)
    rows = got.orderBy("source_row").collect()
    assert [r.clean for r in rows[:2]] == [None, None]
    last = beats[-1][0]
    for r, (t, _, _) in list(zip(rows[2:], beats, strict=True))[-500::50]:
        own = [b for b in beats if t - 4_000 < b[0] <= t]
        clean = own[0][0] - (t - 4_000) <= 60
        assert clean == r.clean
        if clean:
            v = [b[2] for b in own]
            assert (r.rmssd, r.sdnn) == (pytest.approx(math.sqrt(sum((b - a) ** 2 for a, b in itertools.pairwise(v)) / (len(v) - 1)), abs=1e-9), pytest.approx(statistics.stdev(v), abs=1e-9))
    assert any(r.clean for r in rows if r.event_time is not None and (r.event_time - zero).total_seconds() == last)
