"""Causal robust baselines: median and MAD of what lies strictly before each refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTITY, Params

MAD_SCALE = 1.4826


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def indexed(silver: DataFrame, p: Params) -> DataFrame:
    """idx: place of a window in its entity's grid; bucket: the refresh that it belongs to."""
    first = silver.groupBy(*ENTITY).agg(F.min("window_start").alias("_first"))
    idx = F.floor((F.unix_micros("window_start") - F.unix_micros("_first")) / (p.width_s * 1_000_000))
    return silver.join(first, ENTITY).withColumn("idx", idx).withColumn("bucket", F.floor(F.col("idx") / p.refresh)).drop("_first")


def baseline_stats(rows: DataFrame, column: str, epsilon: float, p: Params) -> DataFrame:
    """Per entity and bucket: prior (valid values before it, ever), median and scale of the last max_history windows
    before it, null in warm-up. Windows carry arrays of at most max_history doubles."""
    if p.max_history % p.refresh:
        raise ValueError("max_history must be a multiple of refresh")
    per = rows.groupBy(*ENTITY, "bucket").agg(F.collect_list(column).alias("vals"), F.count(column).alias("cnt"), F.min("window_start").alias("cutoff"))
    order = Window.partitionBy(*ENTITY).orderBy("bucket")
    kept = order.rangeBetween(-(p.max_history // p.refresh), -1)
    before = per.withColumns({"hist": F.flatten(F.collect_list("vals").over(kept)), "prior": F.coalesce(F.sum("cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    ready = (F.col("prior") >= p.warmup) & (F.size("hist") > 0)
    med = before.select(*ENTITY, "bucket", "cutoff", "prior", "hist", F.when(ready, median(F.col("hist"))).alias("med"))
    mad = median(F.transform("hist", lambda x: F.abs(x - F.col("med"))))
    return med.select(*ENTITY, "bucket", "cutoff", "prior", "med", F.when(F.col("med").isNotNull(), F.greatest(mad * MAD_SCALE, F.lit(epsilon))).alias("scale"))


def add_z(silver: DataFrame, p: Params) -> DataFrame:
    """silver with z-scores and reasons of heart rate and log1p skin conductance, baseline_id, baseline_n_valid, baseline_cutoff."""
    rows = indexed(silver, p).withColumn("_eda", F.log1p("eda_mean"))
    for s, column, epsilon in (("hr", "hr_mean", p.hr_epsilon), ("eda", "_eda", p.eda_epsilon)):
        stats = baseline_stats(rows, column, epsilon, p)
        keep = [F.col("prior").alias("baseline_n_valid"), F.col("cutoff").alias("baseline_cutoff")] if s == "hr" else []
        rows = rows.join(stats.select(*ENTITY, "bucket", F.col("med").alias("_med"), F.col("scale").alias("_scale"), *keep), [*ENTITY, "bucket"])
        v = F.col(column)
        rows = rows.withColumns({f"{s}_z": (v - F.col("_med")) / F.col("_scale"), f"{s}_z_reason": F.when(v.isNull(), "no_value").when(F.col("_med").isNull(), "baseline_warmup")}).drop("_med", "_scale")
    return rows.withColumn("baseline_id", F.lit(p.baseline_id)).drop("_eda", "idx", "bucket")


#: What a baseline needs to go on: the values of the last buckets, and how many there were before each.
BUCKETS = "run_id string, participant_id string, first timestamp, bucket long, cutoff timestamp, hr_vals array<double>, hr_prior long, eda_vals array<double>, eda_prior long"


def carried_z(new: DataFrame, buckets: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """add_z for silver rows that follow those seen before, and the buckets to carry on: of each entity the last
    max_history windows' values and the number of older ones, whatever its history. buckets has the columns of BUCKETS."""
    if p.max_history % p.refresh:
        raise ValueError("max_history must be a multiple of refresh")
    reach = p.max_history // p.refresh
    known = buckets.groupBy(*ENTITY).agg(F.min("first").alias("_known"))
    first = new.groupBy(*ENTITY).agg(F.min("window_start").alias("_first")).join(known, ENTITY, "left").select(*ENTITY, F.coalesce("_known", "_first").alias("first"))
    width = p.width_s * 1_000_000 * p.refresh
    rows = new.join(first, ENTITY).withColumn("bucket", F.floor((F.unix_micros("window_start") - F.unix_micros("first")) / width)).withColumn("_eda", F.log1p("eda_mean"))
    mine = rows.groupBy(*ENTITY, "first", "bucket").agg(F.min("window_start").alias("cutoff"), F.collect_list("hr_mean").alias("hr_vals"), F.collect_list("_eda").alias("eda_vals"))
    # A bucket may be cut by the parts; its cutoff is its first window's.
    both = buckets.unionByName(mine, allowMissingColumns=True).groupBy(*ENTITY, "first", "bucket")
    both = both.agg(F.min("cutoff").alias("cutoff"), *[f for s in ("hr", "eda") for f in (F.flatten(F.collect_list(f"{s}_vals")).alias(f"{s}_vals"), F.max(f"{s}_prior").alias(f"{s}_told"))])
    order = Window.partitionBy(*ENTITY).orderBy("bucket")
    before, kept = order.rowsBetween(Window.unboundedPreceding, -1), order.rangeBetween(-reach, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for s in ("hr", "eda"):
        older = F.coalesce(F.first(f"{s}_told").over(whole), F.lit(0))
        both = both.withColumns({f"{s}_prior": older + F.coalesce(F.sum(F.size(f"{s}_vals")).over(before), F.lit(0)), f"{s}_hist": F.flatten(F.collect_list(f"{s}_vals").over(kept))})
    carry = both.withColumn("_last", F.max("bucket").over(whole)).filter(F.col("bucket") >= F.col("_last") - reach).select(*[f.name for f in buckets.schema])
    stats = both.select(*ENTITY, "bucket", F.col("hr_prior").alias("baseline_n_valid"), F.col("cutoff").alias("baseline_cutoff"), *[
        F.when((F.col(f"{s}_prior") >= p.warmup) & (F.size(f"{s}_hist") > 0), F.struct(median(F.col(f"{s}_hist")).alias("med"), F.col(f"{s}_hist").alias("hist"))).alias(f"_{s}_b") for s in ("hr", "eda")
    ])
    for s, epsilon in (("hr", p.hr_epsilon), ("eda", p.eda_epsilon)):
        b = F.col(f"_{s}_b")
        mad = median(F.transform(b.hist, lambda x: F.abs(x - b.med)))
        stats = stats.withColumn(f"_{s}_b", F.struct(b.med.alias("med"), F.when(b.isNotNull(), F.greatest(mad * MAD_SCALE, F.lit(epsilon))).alias("scale")))
    out = rows.join(stats, [*ENTITY, "bucket"])
    for s, column in (("hr", "hr_mean"), ("eda", "_eda")):
        v, b = F.col(column), F.col(f"_{s}_b")
        out = out.withColumns({f"{s}_z": (v - b.med) / b.scale, f"{s}_z_reason": F.when(v.isNull(), "no_value").when(b.med.isNull(), "baseline_warmup")})
    return out.withColumn("baseline_id", F.lit(p.baseline_id)).drop("_eda", "bucket", "first", "_hr_b", "_eda_b"), carry
