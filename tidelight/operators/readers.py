"""Readers and reports over state rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTITY
from . import sharded


def latest_state(gold: DataFrame) -> DataFrame:
    """The newest row of each entity, aggregated before the shuffle."""
    rest = [c for c in gold.columns if c not in ENTITY]
    return gold.groupBy(*ENTITY).agg(F.max_by(F.struct(*rest), "window_end").alias("r")).select(*ENTITY, "r.*")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, columns: list[str], name: str = "found") -> DataFrame:
    """left with name: the columns (as a struct) of right's last row at or before left_at. One sort of both sides, no range join."""
    both = left.withColumns({"_at": F.col(left_at), "_kind": F.lit(1), "_x": F.lit(None)}).unionByName(right.select(*keys, F.col(right_at).alias("_at"), F.lit(0).alias("_kind"), F.struct(*columns).alias("_x")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_kind")
    return both.withColumn(name, F.last("_x", ignorenulls=True).over(order)).filter("_kind = 1").drop("_at", "_kind", "_x")


def next_after(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, name: str) -> DataFrame:
    """left with name: right's first right_at strictly after left_at; null where left_at is, as with a null key. Rows of left meet
    what follows their clock, of which there is a row for each key and clock, whatever the number of rows with that clock."""
    times = right.select(*keys, F.col(right_at).alias("_at")).distinct().select("*", F.lit(0).alias("_kind"), F.col("_at").alias("_x"))
    clocks = left.select(*keys, F.col(left_at).alias("_at")).distinct().withColumns({"_kind": F.lit(1), "_x": F.lit(None)})
    # From the last row back, so that what was met last is what comes next. A clock comes before rows of its own time.
    order = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = clocks.unionByName(times).dropna(subset=[*keys, "_at"]).withColumn(name, F.last("_x", ignorenulls=True).over(order)).filter("_kind = 1").select(*keys, F.col("_at").alias("_clock"), name)
    met = left.alias("l").join(found.alias("f"), [*[F.col(f"l.{k}") == F.col(f"f.{k}") for k in keys], F.col(f"l.{left_at}") == F.col("f._clock")], "left")
    return met.select("l.*", f"f.{name}")


def state_as_of(gold: DataFrame, clocks: DataFrame) -> DataFrame:
    """clocks (entity, clock) with the newest state that each may know."""
    return as_of(clocks, gold, ENTITY, "clock", "as_of", ["as_of", "physiological_load", "recovery_score"], "state")


def history(gold: DataFrame, start: Column, end: Column, clock: Column, max_hours: int = 6, rows: int = 2000) -> DataFrame:
    """Rows in (start, end], at most max_hours before the end and never past the clock, in order."""
    stop = F.least(end, clock)
    begin = F.greatest(start, stop - F.expr(f"interval {max_hours} hours"))
    return gold.filter((F.col("window_end") > begin) & (F.col("window_end") <= stop)).orderBy("window_end", *ENTITY).limit(rows)


def status_counts(gold: DataFrame) -> DataFrame:
    return gold.groupBy(F.get_json_object("quality_json", "$.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def null_reasons(gold: DataFrame) -> DataFrame:
    return gold.groupBy(F.get_json_object("quality_json", "$.missing_reasons.physiological_load").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def rest_by_night(gold: DataFrame) -> DataFrame:
    night = F.get(F.filter("evidence_ids", lambda x: x.startswith("rest-")), F.lit(0))
    return gold.filter("estimated_rest_minutes IS NOT NULL").groupBy(*ENTITY, night.alias("night_id")).agg(F.min("estimated_rest_minutes").alias("estimated_rest_minutes"))


def tail_share(gold: DataFrame, n: int, least: float) -> DataFrame:
    """Of each entity's last n rows, how many have a load of at least so much."""
    order = Window.partitionBy(*ENTITY).orderBy(F.desc("window_end"))
    last = gold.select(*ENTITY, "window_end", "physiological_load").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= n)
    return last.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("physiological_load") >= least).alias("n_high"))


def window_compare(gold: DataFrame, clock: Column, minutes: list[int], metric: str, least: float = 0.7) -> DataFrame:
    """Per entity and trailing span up to the clock: count, mean, min, max of a metric over rows of sufficient data, rows at or over least, last three evidence ids."""
    rows = gold.filter((F.get_json_object("quality_json", "$.status") == "sufficient") & (F.col("window_end") <= clock))
    rows = rows.select(*ENTITY, "window_end", F.col(metric).alias("v"), F.get("evidence_ids", F.lit(0)).alias("evidence"))
    spans = F.explode(F.array(*[F.lit(m) for m in minutes])).alias("minutes")
    inside = F.unix_seconds("window_end") > F.unix_seconds(clock) - F.col("minutes") * 60
    of = lambda df: df.select("*", spans).filter(inside).groupBy(*ENTITY, "minutes")
    sums = of(rows).agg(F.count("v").alias("valid"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(F.col("v") >= least).alias("n_high"))
    # A span's last rows are an entity's last, so three rows an entity are collected.
    last = of(sharded.top(rows, ENTITY, [F.desc("window_end")], 3, sharded.by_seconds("window_end"))).agg(F.transform(F.array_sort(F.collect_list(F.struct("window_end", "evidence"))), lambda x: x.evidence).alias("evidence_ids"))
    return sums.join(last, [*ENTITY, "minutes"])


def load_quantiles(gold: DataFrame, probabilities: list[float], least: float = 0.7, exact: bool = True) -> DataFrame:
    """Quantiles of the load; exact=False gives a mergeable estimate for large tables."""
    q = (F.percentile if exact else F.percentile_approx)("physiological_load", F.array(*map(F.lit, probabilities)))
    return gold.agg(q.alias("q"), F.avg((F.col("physiological_load") >= least).cast("double")).alias("share_high")).select(*[F.get("q", F.lit(i)).alias(f"q{int(p * 100)}") for i, p in enumerate(probabilities)], "share_high")


def processed_time(gold: DataFrame, published: DataFrame) -> DataFrame:
    """Per run: the newest as_of, the newest published time, and by how many seconds the first lags."""
    a = gold.groupBy("run_id").agg(F.max("as_of").alias("processed"))
    b = published.groupBy("run_id").agg(F.max("event_time").alias("published"))
    return b.join(a, "run_id", "left").withColumn("lag_s", F.greatest(F.unix_seconds("published") - F.unix_seconds("processed"), F.lit(0)))


def staleness(arrivals: DataFrame, idle_s: int, behind_s: int) -> DataFrame:
    """arrivals (entity, as_of, arrived): seconds that the row before trails and waited; stale where both go over their bounds."""
    order = Window.partitionBy(*ENTITY).orderBy("arrived")
    idle = F.unix_seconds("arrived") - F.unix_seconds(F.lag("arrived").over(order))
    behind = F.greatest(F.unix_seconds("arrived") - F.unix_seconds(F.lag("as_of").over(order)), F.lit(0))
    return arrivals.withColumns({"idle_s": idle, "behind_s": behind}).withColumn("stale", F.coalesce((F.col("idle_s") > idle_s) & (F.col("behind_s") > behind_s), F.lit(False)))
