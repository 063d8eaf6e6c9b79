"""Structured Streaming: finalised windows, insert-once, incremental layers, a view with late corrections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import ENTITY, Params
from ..functions.scalars import window_id
from ..functions.times import floor_window
from ..operators import baseline, minutes, nights, state
from ..sources.layers import remove
from .stateful import ROCKSDB


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, each: Callable | None = None, mode: str = "append", timeout_s: int | None = None) -> None:
    """Process what is there and stop, however long it takes; a query that takes longer than a given timeout is stopped and is an
    error. State is kept in RocksDB; the session's own setting is as it was before."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer = writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)
    with settings(df.sparkSession, ROCKSDB):  # a query has a copy of the session as it is when it starts
        query = writer.start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"not done in {timeout_s} s")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings for a while."""
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_minutes(events: DataFrame, p: Params, delay: str = "2 minutes") -> DataFrame:
    """Scalar window features of a stream of events (ENTITY, event_time, v): a window comes out once, when the
    newest event is the delay past its end; events for windows that are out are dropped. For a clock of each
    entity's own see stateful.entity_windows, for windows before they are out LateView."""
    return (
        events.withWatermark("event_time", delay)
        .groupBy(*ENTITY, F.window("event_time", f"{p.width_s} seconds").alias("w"))
        .agg(F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
        .select(*ENTITY, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "mean", "min", "max", "n")
    )


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def once(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a stream whose keys it has not had before. Keys are looked up one by one in the query's state, so a batch
    reads what it may clash with and not the target, however long that is."""
    return stream.dropDuplicates(keys)


def batch_folder(root: str, name: str, batch_id: int) -> str:
    """A batch's part of a table: a batch that runs again writes the same part again, and the target is not read."""
    return f"{root}/{name}/batch={batch_id}"


def append_once(target: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: add a batch to target; a batch that is replayed replaces itself."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return each


#: What the layers carry from batch to batch, of each entity.
PROGRESS = "run_id string, participant_id string, first timestamp, last_start timestamp, last_end timestamp, night struct<night_id: string, night_end: timestamp, coverage: double, checked: double, minutes: bigint>, loads array<struct<window_end: timestamp, physiological_load: double, window_id: string>>"
NIGHT_WINDOWS = "run_id string, participant_id string, window_start timestamp, acc_coverage double, stillness double, hr_z double"
#: Longer than any night.
NIGHT = "interval 24 hours"


def layers_batch(root: str, p: Params, delay_s: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch over bronze events, each once: root/bronze, root/silver, root/silver_z and root/gold grow, append-only.

    Windows come out when the newest event so far is delay_s past their end. A batch reads its own events and what the one
    before has left in root/carry, which is as much after a hundred batches as after ten: of each entity the raw rows of its
    open windows and of a halo before them (the trailing mean's reach and two windows), the values of the last max_history
    windows and how many were before them, the windows of the last day, the last night, and the last loads that are not
    null. Rows that are out never change; later events for their windows are kept in bronze alone. A batch that is replayed
    writes its own parts of the tables again.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = lambda name, schema: _read(spark, f"{root}/carry/{name}/{batch_id - 1}", schema)

        def kept(df: DataFrame, name: str) -> DataFrame:
            return stored_copy(df, f"{root}/carry/{name}/{batch_id}")

        added = stored_copy(batch, batch_folder(root, "bronze", batch_id))
        progress = old("progress", PROGRESS)
        rows = old("rows", batch.schema).unionByName(added)
        newest = rows.agg(F.max("event_time").alias("t")).first().t
        if newest is None:
            return
        held = progress.filter("last_end IS NOT NULL").select(*ENTITY, F.col("last_start").alias("window_start"), F.col("last_end").alias("_last"))
        last = held.select(*ENTITY, "_last")
        halo = F.expr(f"interval {int(p.trailing_s) + 2 * p.width_s} seconds")
        # Each entity goes on from its own last window, however long it was silent or late.
        rows = rows.join(last, ENTITY, "left").filter(F.col("_last").isNull() | (F.col("event_time") >= F.col("_last") - halo)).drop("_last")
        final = F.unix_micros("window_end") <= F.unix_micros(F.lit(newest)) - delay_s * 1_000_000
        silver = minutes.silver(rows, p, held).join(last, ENTITY, "left").filter(final & (F.col("_last").isNull() | (F.col("window_end") > F.col("_last")))).drop("_last")
        silver = stored_copy(silver, batch_folder(root, "silver", batch_id))

        z, buckets = baseline.carried_z(silver, old("buckets", baseline.BUCKETS), p)
        z = stored_copy(z, batch_folder(root, "silver_z", batch_id))
        kept(buckets, "buckets")

        span = z.groupBy(*ENTITY).agg(F.min("window_start").alias("first"), F.max("window_start").alias("_start"), F.max("window_end").alias("until"))
        spans = span.join(progress.select(*ENTITY, F.col("last_end").alias("since")), ENTITY, "left")
        windows = old("windows", NIGHT_WINDOWS).unionByName(z.select(*[f.name for f in StructType.fromDDL(NIGHT_WINDOWS)]))
        rest = nights.rest_runs(nights.night_grid(windows, nights.nights_since(spans, p), p), p)
        known = progress.filter("night IS NOT NULL").select(*ENTITY, "night.*")
        # The grid has a row for each window of a night, so the rest is small; it is read twice.
        rest = kept(rest.select(*known.columns).unionByName(known), "nights")
        attached = nights.attach_night(z, rest)
        loads = progress.select(*ENTITY, F.inline("loads"))
        gold = stored_copy(state.gold(attached, p, earlier=loads), batch_folder(root, "gold", batch_id))

        recent = loads.unionByName(gold.filter("physiological_load IS NOT NULL").select(*ENTITY, "window_end", "physiological_load", window_id(F.col("window_start")).alias("window_id")))
        place = F.row_number().over(Window.partitionBy(*ENTITY).orderBy(F.desc("window_end")))
        recent = recent.withColumn("_k", place).filter(F.col("_k") < p.recent).groupBy(*ENTITY).agg(F.collect_list(F.struct("window_end", "physiological_load", "window_id")).alias("loads"))
        night = rest.groupBy(*ENTITY).agg(F.max_by(F.struct("night_id", "night_end", "coverage", "checked", "minutes"), "night_end").alias("night"))
        before = progress.select(*ENTITY, F.col("first").alias("_first"), F.col("last_start").alias("_last_start"), F.col("last_end").alias("_last_end"))
        done = before.join(span, ENTITY, "full").join(night, ENTITY, "left").join(recent, ENTITY, "left")
        done = kept(done.select(*ENTITY, F.coalesce("_first", "first").alias("first"), F.coalesce("_start", "_last_start").alias("last_start"), F.coalesce("until", "_last_end").alias("last_end"), "night", "loads"), "progress")
        ends = done.select(*ENTITY, "last_end")
        # Where no window is out yet, rows older than all that is open make up none.
        oldest = F.coalesce("last_end", F.lit(newest) - F.expr(f"interval {delay_s + p.width_s} seconds")) - halo
        kept(rows.join(ends, ENTITY, "left").filter(F.col("event_time") >= oldest).drop("last_end"), "rows")
        kept(windows.join(ends, ENTITY).filter(F.col("window_start") >= F.col("last_end") - F.expr(NIGHT)).drop("last_end"), "windows")
        for name in ("rows", "buckets", "windows", "nights", "progress"):  # a replay needs the carry before; those further back are no longer read
            remove(spark, f"{root}/carry/{name}/{batch_id - 2}")

    return each


def stored_copy(df: DataFrame, path: str) -> DataFrame:
    """df as a table of its own; a batch that runs again writes the same one again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class LateView:
    """foreachBatch: windows as they stand, with a bound on the stream's state. Each batch's rows are summed up by window and
    appended to the view's folder of partial sums; reading adds them up. No row is late: what comes after any delay is one more
    partial sum. compact() writes the sums of what there is as one part, so that a window has few."""

    SUMS = "run_id string, participant_id string, window_start timestamp, total double, min double, max double, n bigint"

    def __init__(self, spark: SparkSession, path: str, p: Params):
        self.spark, self.path, self.p = spark, path, p

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        at = floor_window(F.col("event_time"), self.p.width_s)
        sums = batch.groupBy(*ENTITY, at.alias("window_start")).agg(F.sum("v").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def parts(self) -> DataFrame:
        return _read(self.spark, self.path, self.SUMS)

    def merged(self) -> DataFrame:
        return self.parts().groupBy(*ENTITY, "window_start").agg(F.sum("total").alias("total"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n").alias("n"))

    def rows(self) -> DataFrame:
        """Windows with mean, min, max and n, as stream_minutes has them."""
        step = F.expr(f"interval {self.p.width_s} seconds")
        return self.merged().select(*ENTITY, "window_start", (F.col("window_start") + step).alias("window_end"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "min", "max", "n")

    def compact(self, path: str) -> LateView:
        """The same view in one part at another path."""
        self.merged().write.mode("overwrite").parquet(f"{path}/batch=-1")
        return LateView(self.spark, path, self.p)
