"""State rows: load, activity, rest, status, reasons for every null, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTITY, Params
from ..functions.scalars import clamp01, present, reasons_map, sorted_json, window_id


def load_reason(p: Params) -> Column:
    """Why there is no load; null where there is one."""
    return (
        F.when((F.col("hr_coverage") < p.min_coverage) | F.col("hr_mean").isNull(), "hr_coverage_below_threshold")
        .when((F.col("eda_coverage") < p.min_coverage) | F.col("eda_mean").isNull(), "eda_coverage_below_threshold")
        .when(F.col("hr_z").isNull(), F.coalesce("hr_z_reason", F.lit("hr_baseline_unavailable")))
        .when(F.col("eda_z").isNull(), F.coalesce("eda_z_reason", F.lit("eda_baseline_unavailable")))
    )


def load_score(p: Params) -> Column:
    part = lambda z: clamp01(F.col(z) / p.z_full)
    return F.when(load_reason(p).isNull(), F.round((part("hr_z") * p.weight_hr + part("eda_z") * p.weight_eda) / (p.weight_hr + p.weight_eda), 4))


def activity(p: Params) -> Column:
    return F.when((F.col("acc_coverage") >= p.min_coverage) & F.col("acc_mean").isNotNull(), F.round(clamp01(F.col("acc_mean") / p.activity_full), 4))


def top_evidence(df: DataFrame, n: int, load: str = "physiological_load", of: str = "window_id") -> DataFrame:
    """top_id: id of the highest of the last n loads that are not null, the latest id on ties; null where the load is."""
    known = F.col(load).isNotNull()
    order = Window.partitionBy(*ENTITY, known).orderBy("window_end").rowsBetween(-(n - 1), 0)
    return df.withColumn("top_id", F.when(known, F.max(F.struct(load, of)).over(order)[of]))


def status(p: Params) -> Column:
    least = F.least("hr_coverage", "eda_coverage", "acc_coverage")
    limited = F.col("physiological_load").isNull() | F.col("estimated_rest_minutes").isNull() | (least < p.sufficient_coverage)
    return F.when(F.col("physiological_load").isNull() & F.col("hr_mean").isNull(), "unavailable").when(limited, "limited").otherwise("sufficient")


def gold(silver_z: DataFrame, p: Params, acc_reason: str = "acc_unavailable", earlier: DataFrame | None = None) -> DataFrame:
    """From silver with z-scores and last_night: one interpreted row a window. earlier (ENTITY, window_end, physiological_load,
    window_id) are the last loads before these windows, where windows come in parts."""
    night = F.col("last_night")
    enough = night.isNotNull() & (night.coverage >= p.min_overnight)
    df = silver_z.withColumns({"window_id": window_id(F.col("window_start")), "physiological_load": load_score(p), "activity_level": activity(p), "estimated_rest_minutes": F.when(enough, night.minutes.cast("int")), "overnight_coverage": F.round(night.coverage, 4)})
    if earlier is None:
        df = top_evidence(df, p.recent)
    else:
        both = df.withColumn("_new", F.lit(True)).unionByName(earlier.select(*ENTITY, "window_end", "physiological_load", "window_id"), allowMissingColumns=True)
        df = top_evidence(both, p.recent).filter("_new").drop("_new")
    df = df.withColumn("recovery_score", F.round(clamp01(F.col("estimated_rest_minutes") / p.target_rest), 4))
    no_rest = F.when(night.isNull(), "no_completed_night").when(~enough, "overnight_coverage_below_minimum")
    reasons = {
        "heart_rate_bpm": F.when(F.col("hr_mean").isNull(), "no_valid_hr_in_window"),
        "physiological_load": load_reason(p),
        "activity_level": F.when(F.col("activity_level").isNull(), acc_reason),
        "estimated_rest_minutes": no_rest,
        "recovery_score": F.when(no_rest.isNotNull(), "estimated_rest_unavailable"),
        "rest_hr_check": F.when(enough & (night.checked < 1), "hr_baseline_unavailable_for_part_of_night"),
    }
    quality = {f"{s}_coverage": F.round(f"{s}_coverage", 4) for s in ("hr", "eda", "acc")}
    return df.select(
        *ENTITY, F.col("window_end").alias("as_of"), "window_start", "window_end", F.round("hr_mean", 2).alias("heart_rate_bpm"), "physiological_load", "activity_level",
        "estimated_rest_minutes", F.lit(p.target_rest).alias("target_rest_minutes"), "recovery_score",
        sorted_json(status=status(p), overnight_coverage=F.col("overnight_coverage"), missing_reasons=reasons_map(**reasons), **quality).alias("quality_json"),
        "baseline_id", "baseline_cutoff", present(F.col("window_id"), F.when(enough, night.night_id), F.col("top_id")).alias("evidence_ids"),
        F.coalesce(F.col("activity_level") >= p.confound_level, F.lit(False)).alias("activity_confound"), "source_kind",
    )


QUALITY = "struct<status string, hr_coverage double, eda_coverage double, acc_coverage double, overnight_coverage double, missing_reasons map<string,string>>"


def state_violations(states: DataFrame) -> DataFrame:
    """States that break their contract, with the rules that they break."""
    q = F.from_json("quality_json", QUALITY)
    has = lambda c: F.coalesce(F.map_contains_key(q.missing_reasons, c), F.lit(False))
    score = lambda c: ~F.coalesce(F.col(c).between(0, 1), F.lit(True))
    rules = {f"{c}_out_of_range": score(c) for c in ("physiological_load", "activity_level", "recovery_score")}
    rules["negative_rest"] = F.coalesce(F.col("estimated_rest_minutes") < 0, F.lit(False))
    rules["bad_status"] = ~F.coalesce(q.status.isin("sufficient", "limited", "unavailable"), F.lit(False))
    rules["no_quality"] = F.col("quality_json").isNull()
    rules |= {f"{c}_null_without_reason": F.col(c).isNull() & ~has(c) for c in ("heart_rate_bpm", "physiological_load", "activity_level", "estimated_rest_minutes", "recovery_score")}
    broken = F.array_compact(F.array(*[F.when(c, k) for k, c in rules.items()]))
    return states.withColumn("broken", broken).filter(F.size("broken") > 0)
