"""Trigger rules over states, calendars and decisions, for all entities and times at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ENTITY, Rules


def sustained(gold: DataFrame, rules: Rules, width_s: int) -> DataFrame:
    """sustained: whether the last `window` windows are all there with a load, at least so many of them high."""
    span = (rules.window - 1) * width_s
    frame = Window.partitionBy(*ENTITY).orderBy(F.unix_seconds("window_end")).rangeBetween(-span, 0)
    load = F.when(F.col("status") != "unavailable", F.col("physiological_load"))
    return gold.withColumn("sustained", (F.count(load).over(frame) == rules.window) & (F.count_if(load >= rules.load).over(frame) >= rules.at_least))


def armed(gold: DataFrame, consumed: DataFrame, rules: Rules) -> DataFrame:
    """armed: true until a recommendation is consumed, and again from the first load under the reset level after it, its own row included."""
    marks = gold.withColumns({"_kind": F.lit(1), "_at": F.col("window_end")}).unionByName(consumed.select(*ENTITY, F.col("consumed_at").alias("_at"), F.lit(2).alias("_kind")), allowMissingColumns=True)
    order = Window.partitionBy(*ENTITY).orderBy("_at", "_kind")
    used = F.max(F.when(F.col("_kind") == 2, F.struct("_at", "_kind"))).over(order)
    reset = F.max(F.when((F.col("_kind") == 1) & (F.col("physiological_load") < rules.reset), F.struct("_at", "_kind"))).over(order)
    return marks.withColumn("armed", used.isNull() | F.coalesce(reset > used, F.lit(False))).filter("_kind = 1").drop("_kind", "_at")


def cooldown(clocks: DataFrame, applied: DataFrame, minutes: int, keys: list[str]) -> DataFrame:
    """cooling: whether the last applied decision at or before as_of is less than so many minutes old."""
    from .readers import as_of

    df = as_of(clocks, applied, keys, "as_of", "applied_at", ["applied_at"], "_last")
    age = F.unix_seconds("as_of") - F.unix_seconds("_last.applied_at")
    return df.withColumn("cooling", F.coalesce(age < minutes * 60, F.lit(False))).drop("_last")


def evaluate(inputs: DataFrame, rules: Rules) -> DataFrame:
    """reason_codes, suppressed and fire from sustained, recovery_score, overnight_coverage, deadline_pressure, baseline_id,
    baseline_cutoff, as_of, status, activity_confound, has_flexible, pending, cooling, armed."""
    c = F.col
    low_night = c("overnight_coverage").isNull() | (c("overnight_coverage") < rules.overnight)
    codes = [
        F.when(c("sustained"), "SUSTAINED_LOAD"),
        F.when(~low_night & (c("recovery_score") < rules.recovery), "LIMITED_ESTIMATED_REST"),
        F.when(c("deadline_pressure") >= rules.pressure, "HIGH_PRESSURE"),
    ]
    suppressed = [
        F.when(c("recovery_score").isNull(), "RECOVERY_UNKNOWN").when(low_night, "INSUFFICIENT_OVERNIGHT_EVIDENCE"),
        F.when(c("baseline_id").isNull() | c("baseline_cutoff").isNull() | (c("baseline_cutoff") > c("as_of")), "INSUFFICIENT_BASELINE"),
        F.when(c("status") != "sufficient", "INSUFFICIENT_DATA"),
        F.when(c("activity_confound"), "ACTIVITY_CONFOUND"),
        F.when(~c("has_flexible"), "NO_FLEXIBLE_BLOCK"),
        F.when(c("pending"), "PENDING_DECISION"),
        F.when(c("cooling"), "COOLDOWN"),
        F.when(~c("armed"), "AWAITING_RESET"),
    ]
    out = inputs.withColumns({"reason_codes": F.array_compact(F.array(*codes)), "suppressed": F.array_compact(F.array(*suppressed)), "rule_version": F.lit(rules.version)})
    return out.withColumn("fire", (F.size("reason_codes") == 3) & (F.size("suppressed") == 0))
