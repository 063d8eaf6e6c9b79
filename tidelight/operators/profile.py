"""Profiles of files and tables: gaps, rates, overnight coverage, ranking, keys, spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..sources.layers import kept
from . import sharded

NEEDED = ("hr", "eda", "acc")


def ordered_events(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).orderBy("event_time", "signal", "source_row")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_left, only_right: how many rows (with repeats) only one of the two has."""
    left, right = a.exceptAll(b), b.exceptAll(a)
    both = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("only_left"), F.coalesce(F.sum("r"), F.lit(0)).alias("only_right"))


def gaps(rows: DataFrame, by: list[str], time: str = "source_timestamp", seconds: int = sharded.SECONDS) -> DataFrame:
    """gap: seconds since the row before in time. A key's rows are dealt over tasks by ranges of time."""
    out = sharded.previous(rows, by, [time, "source_row"], [time], sharded.by_seconds(time, seconds), "_previous")
    return out.withColumn("gap", (F.unix_micros(time) - F.unix_micros(F.col(f"_previous.{time}"))) / 1_000_000).drop("_previous")


def largest_gaps(rows: DataFrame, by: list[str], n: int, seconds: int = sharded.SECONDS) -> DataFrame:
    found = gaps(rows, by, seconds=seconds).filter("gap IS NOT NULL")
    return sharded.top(found, by, [F.desc("gap"), "source_row"], n, sharded.by_seconds("source_timestamp", seconds))


def profile(labelled: DataFrame, by: list[str], long_gap_s: float) -> DataFrame:
    """Counts, times and rate of each file. The rate is one over the exact median of the gaps, found by rounds of histograms
    over stored counts."""
    g = F.col("gap")
    rows = kept(gaps(labelled.filter("source_timestamp IS NOT NULL"), by).select(*by, "source_timestamp", "quality", "duplicate", "gap"), "gaps")
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("quality") == "dropped").alias("dropped"), F.count_if(F.col("quality") == "flagged").alias("flagged"),
        F.count_if("duplicate").alias("duplicates"), F.min("source_timestamp").alias("first_time"), F.max("source_timestamp").alias("last_time"),
        # In order of time a row of another time than the one before is a new time.
        F.count_if(g.isNull() | (g > 0)).alias("unique_times"), F.count_if(g > long_gap_s).alias("long_gaps"), F.max("gap").alias("largest_gap"),
    )
    medians = sharded.quantile(rows.filter(g > 0), by, "gap", 0.5, "_median")
    met = counts.alias("c").join(medians.alias("m"), [F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by], "left")
    return met.select("c.*", (1 / F.col("m._median")).alias("hz"))


def reason_counts(labelled: DataFrame, by: list[str]) -> DataFrame:
    return labelled.filter("quality_reason <> ''").groupBy(*by, "quality_reason").agg(F.count(F.lit(1)).alias("n"))


def overnight_coverage(rows: DataFrame, by: list[str], per_minute: float, zone: str) -> DataFrame:
    """Per file and night that meets its data: share of the night's expected samples, each minute's capped at one, distinct times only."""
    at = rows.filter("source_timestamp IS NOT NULL").select(*by, F.col("source_timestamp").alias("t")).distinct()
    minute = at.groupBy(*by, times.floor_window(F.col("t"), 60).alias("m")).agg(F.least(F.count(F.lit(1)) / per_minute, F.lit(1.0)).alias("c"))
    span = at.groupBy(*by).agg(F.min("t").alias("f"), F.max("t").alias("l"))
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    days = span.select(*by, "f", "l", F.explode(F.sequence(F.date_sub(local("f"), 1), local("l"))).alias("day"))
    start, end = times.night_bounds(F.col("day"), zone, 22, 8)
    nights = days.withColumns({"ns": start, "ne": end}).filter("ns <= l AND ne > f")
    # Each minute belongs to at most one night: that of its local date twelve hours earlier.
    night_of = F.to_date(F.from_utc_timestamp("m", zone) - F.expr("interval 12 hours"))
    inside = minute.withColumn("day", night_of).join(nights.select(*by, "day", "ns", "ne"), [*by, "day"]).filter("m >= ns AND m < ne").groupBy(*by, "day").agg(F.sum("c").alias("c"))
    whole = (F.unix_seconds("ne") - F.unix_seconds("ns")) / 60
    return nights.join(inside, [*by, "day"], "left").select(*by, F.date_format("day", "yyyy-MM-dd").alias("night"), F.round(F.coalesce("c", F.lit(0.0)) / whole, 6).alias("coverage"))


def common_nights(nights: DataFrame) -> DataFrame:
    """participant_id, night, least: nights that all needed signals cover."""
    needed = nights.filter(F.col("signal").isin(*NEEDED))
    return needed.groupBy("participant_id", "night").agg(F.countDistinct("signal").alias("n"), F.min("coverage").alias("least")).filter(F.col("n") == len(NEEDED)).drop("n")


def rank_entities(nights: DataFrame, spans: DataFrame, min_hours: int, demo_hours: int) -> DataFrame:
    """The participant with the best covered common nights, among those whose signals overlap long enough."""
    score = common_nights(nights).groupBy("participant_id").agg(F.sum("least").alias("score"))
    shared = spans.filter(F.col("signal").isin(*NEEDED)).groupBy("participant_id").agg(F.max("first_time").alias("common_start"), F.min("last_time").alias("end"))
    long_enough = F.unix_seconds("end") - F.unix_seconds("common_start") >= min_hours * 3600
    start = F.col("common_start")
    return (
        score.join(shared.filter(long_enough), "participant_id")
        .orderBy(F.desc("score"), "participant_id")
        .limit(1)
        .withColumns({"demo_start": start + F.expr("interval 48 hours"), "demo_end": F.least(F.col("end") + F.expr("interval 1 second"), start + F.expr(f"interval {48 + demo_hours} hours"))})
    )


def duplicate_keys(df: DataFrame, keys: list[str], more_than: int = 1) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def row_span(df: DataFrame, time: str, by: list[str], distinct: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias("n_ids"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def history_cap(df: DataFrame, time: str, hours: int) -> DataFrame:
    """The last hours of a table, counted back from its newest row."""
    newest = df.agg(F.max(time).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(time) > F.col("_newest") - F.expr(f"interval {hours} hours")).drop("_newest")
