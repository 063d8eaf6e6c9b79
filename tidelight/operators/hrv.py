"""Variability of heart beats over trailing segments that have no gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ENTITY
from . import sharded


def variability(beats: DataFrame, value: str = "v", seconds: int = 300, max_gap_s: float = 2.5, time: str = "event_time", shard_s: int = sharded.SECONDS) -> DataFrame:
    """Of each beat (ENTITY, time, source_row, interval): clean, rmssd and sdnn over the seconds that end with it. A segment is
    clean if it holds two beats, no two neighbours in it are more than the gap apart, and its first is no more than that after
    the segment's start; else both are null. rmssd takes differences of neighbours that both lie in the segment, so none
    bridges a gap or the start. An entity's beats are dealt over tasks by time."""
    reach, gap = int(seconds * 1_000_000), int(max_gap_s * 1_000_000)
    at = F.unix_micros(time)
    rows = sharded.previous(beats, ENTITY, [time, "source_row"], [time, value], sharded.by_seconds(time, shard_s), "_before")
    rows = rows.withColumns({"_d2": F.pow(F.col(value) - F.col(f"_before.{value}"), 2), "_broken": F.when(at - F.unix_micros(f"_before.{time}") > gap, at)})
    of = lambda c: {
        "n": F.count(c(F.lit(1))), "a": F.min(c("_at")), "gap": F.max(c("_broken")), "mean": F.avg(c(value)), "spread": F.var_pop(c(value)),
        "s2": F.sum(c("_d2")), "first": F.min_by(F.struct(F.col("_d2").alias("d2")), c(F.struct("_at", "source_row"))),
    }
    df = sharded.trailing(rows.withColumn("_at", at), ENTITY, time, "source_row", reach, of, shard_s)
    both = lambda c, none: [F.coalesce(F.col(f"{part}.{c}"), F.lit(none)) for part in ("_early", "_late")]
    (n0, n1), (m0, m1), (q0, q1), (s0, s1) = both("n", 0), both("mean", 0.0), both("spread", 0.0), both("s2", 0.0)
    n = n0 + n1
    # Squares about the means of two parts, and of all about theirs.
    squares = q0 * n0 + q1 * n1 + F.pow(m1 - m0, 2) * n0 * n1 / n
    df = df.withColumns({
        "_n": n, "_a": F.coalesce("_early.a", "_late.a"), "_gap": F.greatest("_early.gap", "_late.gap"), "sdnn": F.when(n > 1, F.sqrt(squares / (n - 1))),
        # The first beat's difference is from one before the segment.
        "_s2": s0 + s1 - F.coalesce(F.when(n0 > 0, F.col("_early.first")).otherwise(F.col("_late.first"))["d2"], F.lit(0.0)),
    })
    clean = (F.col("_n") >= 2) & (F.col("_a") - (at - reach + 1) <= gap) & (F.col("_gap").isNull() | (F.col("_gap") <= F.col("_a")))
    df = df.withColumn("clean", clean).withColumns({"rmssd": F.when(F.col("clean"), F.sqrt(F.greatest(F.col("_s2"), F.lit(0.0)) / (F.col("_n") - 1))), "sdnn": F.when(F.col("clean"), F.col("sdnn"))})
    return df.select(*beats.columns, "clean", "rmssd", "sdnn")
