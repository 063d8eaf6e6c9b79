"""Nights: their bounds, their complete grids, and the longest rest run of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTITY, Params
from ..functions import times
from ..functions.scalars import night_id


def night_bounds(silver: DataFrame, p: Params) -> DataFrame:
    """night_id, night_start, night_end for every local date from the day before the first window on; nights that end after the last window are left out."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c, p.zone))
    span = silver.groupBy(*ENTITY).agg(F.min("window_start").alias("a"), F.max("window_end").alias("b"))
    days = span.select(*ENTITY, "b", F.explode(F.sequence(F.date_sub(local(F.col("a")), 1), local(F.col("b")))).alias("day"))
    start, end = times.night_bounds(F.col("day"), p.zone, p.night_start, p.night_end)
    return days.select(*ENTITY, "b", night_id(F.col("day")).alias("night_id"), start.alias("night_start"), end.alias("night_end")).filter("night_end <= b").drop("b")


def nights_since(spans: DataFrame, p: Params) -> DataFrame:
    """The nights that end after `since` and at or before `until`, of rows of entity, since and until; where since is null,
    those of night_bounds for windows from `first` on."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c, p.zone))
    days = spans.select(*ENTITY, "since", "until", F.explode(F.sequence(F.date_sub(local(F.coalesce("since", "first")), 1), local(F.col("until")))).alias("day"))
    start, end = times.night_bounds(F.col("day"), p.zone, p.night_start, p.night_end)
    return days.select(*ENTITY, "since", "until", night_id(F.col("day")).alias("night_id"), start.alias("night_start"), end.alias("night_end")).filter("night_end <= until AND (since IS NULL OR night_end > since)").drop("since", "until")


def night_grid(silver: DataFrame, nights: DataFrame, p: Params) -> DataFrame:
    """A row for each window of each night, with silver's columns where there are any; observed says whether there are enough samples."""
    step = F.expr(f"interval {p.width_s} seconds")
    grid = nights.select(*ENTITY, "night_id", "night_start", "night_end", F.explode(F.sequence(F.col("night_start"), F.col("night_end") - step, step)).alias("window_start"))
    rows = grid.join(silver.select(*ENTITY, "window_start", "acc_coverage", "stillness", "hr_z"), [*ENTITY, "window_start"], "left")
    observed = F.coalesce(F.col("acc_coverage"), F.lit(0.0)) >= p.min_coverage
    return rows.withColumn("observed", observed).withColumn("candidate", observed & (F.coalesce(F.col("stillness"), F.lit(0.0)) >= p.still_ratio) & (F.col("hr_z").isNull() | (F.col("hr_z") <= p.compatible_z)))


def rest_runs(grid: DataFrame, p: Params) -> DataFrame:
    """Per night: coverage, checked share, and the longest run of candidates in windows and its bounds.

    Candidates are one run while at most `bridge` observed others lie between two of them and no
    unobserved window does. Ties go to the earliest run; runs under min_rest count as 0.
    """
    night = [*ENTITY, "night_id", "night_start", "night_end"]
    order = Window.partitionBy(*night).orderBy("window_start")
    rows = grid.withColumns({"unobserved": F.sum((~F.col("observed")).cast("int")).over(order), "at": F.row_number().over(order)})
    c = rows.filter("candidate")
    fresh = F.coalesce((F.col("at") - F.lag("at").over(order) - 1 > p.bridge) | (F.col("unobserved") != F.lag("unobserved").over(order)), F.lit(True))
    runs = c.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order)).groupBy(*night, "run")
    runs = runs.agg(F.count(F.lit(1)).alias("n"), F.min("window_start").alias("a"), F.max("window_start").alias("b"), F.count("hr_z").alias("checked"))
    best = runs.groupBy(*night).agg(F.min_by(F.struct("n", "a", "b"), F.struct(-F.col("n"), F.col("a"))).alias("r"), (F.sum("checked") / F.sum("n")).alias("checked"))
    whole = grid.groupBy(*night).agg(F.avg(F.col("observed").cast("double")).alias("coverage"))
    step = F.expr(f"interval {p.width_s} seconds")
    return whole.join(best, night, "left").select(
        *night, "coverage", F.coalesce("checked", F.lit(0.0)).alias("checked"),
        F.when(F.coalesce(F.col("r.n"), F.lit(0)) >= p.min_rest, F.col("r.n")).otherwise(0).alias("minutes"),
        F.col("r.a").alias("run_start"), (F.col("r.b") + step).alias("run_end"),
    )


def attach_night(silver: DataFrame, nights: DataFrame) -> DataFrame:
    """silver with last_night: the night that ended last at or before the window's end. A union and a running last, not a range join."""
    night = F.struct("night_id", "night_end", "coverage", "checked", "minutes")
    both = silver.withColumns({"_at": F.col("window_end"), "_kind": F.lit(1), "_night": F.lit(None)}).unionByName(
        nights.select(*ENTITY, F.col("night_end").alias("_at"), F.lit(0).alias("_kind"), night.alias("_night")), allowMissingColumns=True
    )
    order = Window.partitionBy(*ENTITY).orderBy("_at", "_kind")
    return both.withColumn("last_night", F.last("_night", ignorenulls=True).over(order)).filter("_kind = 1").drop("_at", "_kind", "_night")
