"""Window features: aggregates, coverage, dynamic acceleration, the complete grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTITY, Params
from ..functions.scalars import magnitude
from ..functions.times import floor_window
from . import sharded
from .quality import usable_scalar, usable_vector


def minute_scalar(rows: DataFrame, p: Params) -> DataFrame:
    """Per window mean, min, max, standard deviation (null for one value) and count of value."""
    return (
        rows.select(*ENTITY, floor_window(F.col("event_time"), p.width_s).alias("window_start"), F.col("values")["value"].alias("v"))
        .groupBy(*ENTITY, "window_start")
        .agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.stddev_samp("v").alias("std"), F.count("v").alias("n"))
    )


def coverage(n, expected: float):
    """Share of the expected samples that came, at most 1; 0 where none did."""
    return F.least(F.coalesce(n, F.lit(0)) / expected, F.lit(1.0))


def trailing_mean(df: DataFrame, column: str, seconds: float, time: str = "event_time", shard_s: int = sharded.SECONDS, row: str = "source_row"):
    """Mean over the seconds that end with a row, its peers at the same time included, those exactly so many seconds before
    not. An entity's rows are dealt over tasks by ranges of time, each with the rows that its first ones look back to."""
    of = lambda c: {"n": F.count(c(column)), "total": F.sum(c(column))}
    met = sharded.trailing(df, ENTITY, time, row, int(seconds * 1_000_000), of, shard_s)
    n = F.col("_early.n") + F.col("_late.n")
    total = F.coalesce("_early.total", F.lit(0.0)) + F.coalesce("_late.total", F.lit(0.0))
    return met.withColumn("trailing", F.when(n > 0, total / n)).drop("_early", "_late")


def dynamic(rows: DataFrame, p: Params) -> DataFrame:
    """dyn: distance of the acceleration's magnitude from its trailing mean, scaled."""
    v = F.col("values")
    df = rows.select(*ENTITY, "event_time", "source_row", magnitude(v["x"], v["y"], v["z"]).alias("mag"))
    return trailing_mean(df, "mag", p.trailing_s).withColumn("dyn", F.abs(F.col("mag") - F.col("trailing")) * p.acc_scale)


def minute_vector(rows: DataFrame, p: Params) -> DataFrame:
    return (
        dynamic(rows, p)
        .groupBy(*ENTITY, floor_window(F.col("event_time"), p.width_s).alias("window_start"))
        .agg(F.avg("dyn").alias("acc_mean"), F.stddev_samp("dyn").alias("acc_std"), F.max("dyn").alias("acc_max"), F.avg((F.col("dyn") < p.still_below).cast("double")).alias("stillness"), F.count("dyn").alias("acc_n"))
    )


def minute_grid(windows: DataFrame, p: Params) -> DataFrame:
    """Every window between an entity's first and last."""
    span = windows.groupBy(*ENTITY).agg(F.min("window_start").alias("a"), F.max("window_start").alias("b"))
    return span.select(*ENTITY, F.explode(F.sequence("a", "b", F.expr(f"interval {p.width_s} seconds"))).alias("window_start"))


def silver(bronze: DataFrame, p: Params, since: DataFrame | None = None) -> DataFrame:
    """A row for each window of the grid with all signals side by side; the scalars come from one aggregation.
    since (entity, window_start) lets an entity's grid begin before its first row, where earlier windows are known."""
    hr, eda = usable_scalar(bronze, "hr", *p.hr_range), usable_scalar(bronze, "eda", *p.eda_range)
    rows = hr.unionByName(eda).select(*ENTITY, "signal", floor_window(F.col("event_time"), p.width_s).alias("window_start"), F.col("values")["value"].alias("v"))
    of = lambda s: F.when(F.col("signal") == s, F.col("v"))
    scalars = rows.groupBy(*ENTITY, "window_start").agg(
        F.avg(of("hr")).alias("hr_mean"), F.min(of("hr")).alias("hr_min"), F.max(of("hr")).alias("hr_max"), F.stddev_samp(of("hr")).alias("hr_std"), F.count(of("hr")).alias("hr_n"),
        F.avg(of("eda")).alias("eda_mean"), F.stddev_samp(of("eda")).alias("eda_std"), F.count(of("eda")).alias("eda_n"),
    )
    vectors = minute_vector(usable_vector(bronze), p)
    key = [*ENTITY, "window_start"]
    met = scalars.join(vectors, key, "full")
    kinds = bronze.groupBy(*ENTITY).agg(F.max("source_kind").alias("source_kind"))
    known = met.select(*key) if since is None else met.select(*key).unionByName(since.select(*key))
    out = minute_grid(known, p).join(met, key, "left").join(kinds, ENTITY)
    out = out.withColumns({"window_end": F.col("window_start") + F.expr(f"interval {p.width_s} seconds"), **{f"{s}_coverage": coverage(F.col(f"{s}_n"), p.expected[s]) for s in ("hr", "eda", "acc")}})
    return delta(out, "eda_mean", "eda_delta").drop("hr_n", "eda_n", "acc_n")


def delta(grid: DataFrame, column: str, name: str) -> DataFrame:
    """Difference from the previous window of the grid; null if either is missing."""
    return grid.withColumn(name, F.col(column) - F.lag(column).over(Window.partitionBy(*ENTITY).orderBy("window_start")))
