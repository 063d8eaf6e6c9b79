"""Quality labels, policies and contract checks over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from . import sharded

UNITS = {"hr": "bpm", "eda": "uS", "acc": "unverified", "ibi": "s", "temp": "C"}
OVERRIDES = {"acc": ("g",)}
SIGNALS = tuple(UNITS)
QUALITIES = ("valid", "flagged", "dropped")
SOURCE_KINDS = ("recorded_replay", "synthetic_fixture", "synthetic_injection")
COLUMNS = ("schema_version", "run_id", "event_id", "participant_id", "source_kind", "source_timestamp", "event_time", "ingested_at", "signal", "values", "unit", "quality", "source_file", "source_row")


def cast_number(text: Column) -> Column:
    """Text as a finite double, else null."""
    x = text.try_cast("double")
    return F.when(finite(x), x)


def drop_nonfinite(df: DataFrame, columns: list[str]) -> DataFrame:
    ok = F.lit(True)
    for c in columns:
        ok &= finite(F.col(c))
    return df.filter(ok)


def flag_duplicates(df: DataFrame, by: list[str], time: str = "source_timestamp") -> DataFrame:
    """duplicate: whether the time occurs more than once in its file. Times are counted first, so one popular time is one row of the join."""
    often = df.filter(F.col(time).isNotNull()).groupBy(*by, time).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return df.join(often, [*by, time], "left").withColumn("duplicate", F.col("_n").isNotNull()).drop("_n")


def flag_order(df: DataFrame, by: list[str], time: str = "source_timestamp", row: str = "source_row", size: int = sharded.ROWS, then: tuple[str, ...] = ()) -> DataFrame:
    """backwards: whether the time lies before that of the previous physical row. A file's rows are dealt over tasks by ranges of
    places; where rows share a place, `then` puts them in order, without which any order of theirs may be met."""
    out = sharded.previous(df, by, [row, *then], [time], sharded.by_place(row, size), "_previous")
    return out.withColumn("backwards", F.coalesce(F.col(time) < F.col(f"_previous.{time}"), F.lit(False))).drop("_previous")


def assign_unit(signal: Column, verified: Column | None = None) -> Column:
    """Unit of a signal; a verified unit must be one that the signal allows."""
    own = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), signal)
    if verified is None:
        return own
    allowed = F.lit(False)
    for s, units in OVERRIDES.items():
        allowed |= (signal == s) & verified.isin(*units)
    return F.when(verified.isNull(), own).when(allowed, verified).otherwise(F.raise_error(F.concat(F.lit("unit not allowed: "), verified)).cast("string"))


def label_quality(df: DataFrame) -> DataFrame:
    """quality and quality_reason of raw rows: signal, source_timestamp, value (or x, y, z), unit, duplicate, backwards."""
    v, signal = F.col("value"), F.col("signal")
    flags = [
        (F.col("duplicate"), "duplicate_timestamp"),
        (F.col("backwards"), "out_of_order"),
        (signal.isin("hr", "eda", "ibi") & (v < 0), "negative_measurement"),
        (signal.isin("hr", "ibi") & (v <= 0), "nonpositive_hr_or_ibi"),
        ((signal == "hr") & (v > 220), "hr_above_engineering_range"),
        (F.col("unit") == "unverified", "unit_unverified"),
    ]
    measured = F.when(signal == "acc", finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))).otherwise(finite(v))
    drops = [(F.col("source_timestamp").isNull(), "invalid_or_ambiguous_timestamp"), (~measured, "missing_or_nonfinite_measurement")]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), r) for c, r in flags + drops]))
    any_of = lambda rules: F.greatest(*[F.coalesce(c, F.lit(False)) for c, _ in rules])
    return df.withColumns(
        {
            "quality": F.when(any_of(drops), "dropped").when(any_of(flags), "flagged").otherwise("valid"),
            "quality_reason": F.concat_ws("", F.transform(reasons, lambda r: F.concat(r, F.lit(";")))),
        }
    )


def label_simple(df: DataFrame) -> DataFrame:
    """quality by the first rule that holds; dropped rows are left out, source_row stays the raw position."""
    v, signal = F.col("value"), F.col("signal")
    acc = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))
    hr = F.when(~finite(v), "dropped").when((v == 0) | (v > 220) | F.col("duplicate"), "flagged")
    eda = F.when(~finite(v), "dropped").when(v < 0, "flagged")
    other = F.when(~finite(v), "dropped")
    label = F.when(signal == "hr", hr).when(signal == "eda", eda).when(signal == "acc", F.when(acc, "flagged").otherwise("dropped")).otherwise(other)
    return df.withColumn("quality", F.coalesce(label, F.lit("valid"))).filter("quality <> 'dropped'")


def usable_scalar(bronze: DataFrame, signal: str, low: float, high: float) -> DataFrame:
    """Valid rows of a signal inside the range; what lies outside is absent, never clipped."""
    return bronze.filter((F.col("signal") == signal) & (F.col("quality") == "valid") & F.col("values")["value"].between(low, high))


def usable_vector(bronze: DataFrame, policy: str | None = None) -> DataFrame:
    """Acceleration rows by policy: assume keeps unverified units alone, exclude keeps verified ones; by default fixtures assume."""
    unverified = F.col("unit") == "unverified"
    assumed = (F.col("source_kind") == "synthetic_fixture") if policy is None else F.lit(policy == "assume")
    ok = F.when(assumed, unverified).otherwise(~unverified)
    axes = [F.col("values")[a] for a in "xyz"]
    return bronze.filter((F.col("signal") == "acc") & (F.col("quality") != "dropped") & ok & finite(axes[0]) & finite(axes[1]) & finite(axes[2]))


def pivot_values(bronze: DataFrame) -> DataFrame:
    """value, x, y, z from the values map."""
    return bronze.withColumns({k: F.col("values")[k] for k in ("value", "x", "y", "z")}).drop("values")


def check_columns(df: DataFrame, required: tuple[str, ...] = COLUMNS) -> DataFrame:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bad_values(df: DataFrame) -> DataFrame:
    """column, bad_value, n for values outside their domain; nulls are ignored."""
    domains = {"source_kind": SOURCE_KINDS, "signal": SIGNALS, "quality": QUALITIES}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("bad_value"), F.col(c).isin(*d).alias("ok")) for c, d in domains.items()]))
    return df.select(pairs.alias("p")).filter("NOT p.ok").groupBy("p.column", "p.bad_value").agg(F.count(F.lit(1)).alias("n"))


def event_valid(run_id: str) -> Column:
    """Whether an event keeps the contract: nothing null, own run and schema, the signal's keys, finite values."""
    nulls = F.lit(False)
    for c in COLUMNS:
        nulls |= F.col(c).isNull()
    keys = F.when(F.col("signal") == "acc", F.array(*map(F.lit, "xyz"))).otherwise(F.array(F.lit("value")))
    values = F.map_values("values")
    good = F.sort_array(F.map_keys("values")).eqNullSafe(keys) & F.forall(values, finite)
    return ~nulls & F.col("run_id").eqNullSafe(F.lit(run_id)) & F.col("schema_version").eqNullSafe(F.lit("1.0")) & F.coalesce(good, F.lit(False)) & (F.col("source_row") > 0)


def bad_events(df: DataFrame, run_id: str) -> DataFrame:
    return df.filter(~F.coalesce(event_valid(run_id), F.lit(False)))


def bad_intervals(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    return df.filter(F.coalesce(F.col(start) >= F.col(end), F.lit(True)))


def for_run(df: DataFrame, run_id: str, participant_id: str | None = None) -> DataFrame:
    df = df.filter(F.col("run_id") == run_id)
    return df if participant_id is None else df.filter(F.col("participant_id") == participant_id)


def segment(df: DataFrame, start: Column, end: Column, time: str = "event_time") -> DataFrame:
    return df.filter((F.col(time) >= start) & (F.col(time) < end))


def out_of_domain(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).distinct()


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by order. Aggregated before the shuffle, so a key of any size is cheap."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
