"""Keyed writes without a table format: each takes frames and returns the new target, for one writer at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of updates replace those with equal keys and are added where there are none. The same updates again change nothing."""
    return target.join(updates.select(*keys).distinct(), keys, "left_anti").unionByName(updates.dropDuplicates(keys))


def update_columns(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Only the named columns of matched rows change; a matched null overwrites; nothing is added."""
    u = updates.dropDuplicates(keys).select(*keys, F.struct(*columns).alias("_u"))
    out = target.join(u, keys, "left")
    return out.withColumns({c: F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in columns}).drop("_u")


def insert_new(target: DataFrame, batch: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The rows of a batch whose keys the target lacks, each key once; rows that are there never change. within names a key
    column by whose values the target is partitioned or sorted: only the batch's range of it is read of the target."""
    if within:
        span = batch.agg(F.min(within).alias("a"), F.max(within).alias("b"), F.count_if(F.col(within).isNull()).alias("n")).first()
        inside = F.col(within).between(F.lit(span.a), F.lit(span.b)) if span.a is not None else F.lit(False)
        target = target.filter(inside | F.col(within).isNull() if span.n else inside)
    return batch.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def export_state(df: DataFrame, path: str, kinds: tuple[str, ...] = ("synthetic_fixture",), min_year: int = 2024) -> None:
    """CSV and Parquet of a state table, only if every row is of an allowed kind and not before min_year."""
    bad = df.agg(F.count_if(~F.coalesce(F.col("source_kind").isin(*kinds), F.lit(False)) | ~F.coalesce(F.year("window_end") >= min_year, F.lit(False))).alias("n")).first().n
    if bad:
        raise ValueError(f"{bad} rows may not be exported")
    text = {c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    df.withColumns(text).write.option("header", True).csv(f"{path}/csv")
    df.write.parquet(f"{path}/parquet")


def scan_state_csv(spark, path: str, schema: str) -> DataFrame:
    """An exported CSV read back: ids stay text, arrays are parsed, NaN is null."""
    from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

    wanted = StructType.fromDDL(schema)
    flat = StructType([StructField(f.name, StringType() if isinstance(f.dataType, ArrayType) else f.dataType) for f in wanted])
    df = spark.read.schema(flat).option("header", True).csv(f"{path}/csv")

    def fixed(f) -> Column:
        if isinstance(f.dataType, ArrayType):
            return F.coalesce(F.from_json(f.name, f.dataType), F.array().cast(f.dataType)).alias(f.name)
        return F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name)

    return df.select(*map(fixed, wanted))
