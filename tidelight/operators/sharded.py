"""Windows over keys of any size: one key's rows are dealt over many tasks by ranges of their order, and what crosses a
range's edge is carried by small tables. Results equal those of one window a key, wherever the ranges are cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layers import kept

#: Rows of a range by place, and seconds of a range by time.
ROWS, SECONDS = 1_000_000, 6 * 3600


def by_place(row: str, size: int = ROWS) -> Column:
    """Range of a row by its place."""
    return F.floor(F.col(row) / size)


def by_seconds(time: str, seconds: int = SECONDS) -> Column:
    """Range of a row by its time; rows without one are before all others."""
    return F.coalesce(F.floor(F.unix_micros(time) / (seconds * 1_000_000)), F.lit(-(1 << 62)))


def previous(df: DataFrame, by: list[str], order: list[str], values: list[str], shard: Column, name: str = "previous") -> DataFrame:
    """df with a struct of values of the row before in order, null for the first of a key. shard must not fall where the order
    rises. Rows meet by key and shard; of each shard only its last row goes on to the next."""
    own = F.struct(*values)
    key = [*by, "_shard"]
    rows = df.withColumn("_shard", shard)
    lasts = rows.groupBy(*key).agg(F.max_by(own, F.struct(*order)).alias("_last"))
    edges = lasts.select(*key, F.lag("_last").over(Window.partitionBy(*by).orderBy("_shard")).alias("_edge"))
    inside = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumns({"_inside": F.lag(own).over(inside), "_first": F.row_number().over(inside) == 1})
    met = rows.alias("r").join(edges.alias("e"), [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in key])
    return met.select(*[F.col(f"r.{c}") for c in df.columns], F.when(F.col("r._first"), F.col("e._edge")).otherwise(F.col("r._inside")).alias(name))


def with_halo(df: DataFrame, time: str, reach_micros: int, seconds: int = SECONDS) -> DataFrame:
    """df with each row in the shard of its time and, where it lies less than reach before a later one's rows, there as well:
    _shard, and _own for the first. A frame that looks back by less than the reach finds all that it needs within a shard."""
    span = max(seconds * 1_000_000, reach_micros)
    at = F.unix_micros(time)
    shards = F.array_distinct(F.array(F.floor(at / span), F.floor((at + reach_micros - 1) / span)))
    return df.select("*", F.posexplode(shards).alias("_place", "_shard")).withColumn("_own", F.col("_place") == 0).drop("_place")


def trailing(df: DataFrame, by: list[str], time: str, row: str, reach_micros: int, of: Callable[[Callable[[str | Column], Column]], dict[str, Column]], seconds: int = SECONDS) -> DataFrame:
    """df with _early and _late, structs of aggregates over the two parts of the frame that ends with a row and looks back by less
    than the reach, its peers in time included. Time is cut into blocks as long as the reach, so a frame is the end of the block
    before (_early) and the start of its own (_late), and each row is added to a running aggregate once a part, however many
    rows a frame holds. of makes the aggregates from a function that gives a part's values, null for rows that are not of it;
    in _late rows come by time, in _early by time and row from the last back to the frame's first. Rows without a time are one frame."""
    at = F.unix_micros(time)
    block = at - F.pmod(at, F.lit(reach_micros))
    place = lambda block, early, stop: F.struct(block.alias("_block"), F.lit(early).alias("_copy"), stop.alias("_stop"))
    # A copy of each row goes to the block after its own, where it is met by the rows whose frames begin before or at it.
    places = F.array_compact(F.array(place(block, False, at - reach_micros + 1), F.when(at.isNotNull(), place(block + reach_micros, True, at))))
    # A task has the rows of a shard, whose blocks are cut inside it.
    rows = with_halo(df, time, reach_micros, seconds).repartition(*by, "_shard").select("*", F.inline(places))
    key = [*by, "_shard", "_block"]
    late = Window.partitionBy(*key, "_copy").orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    early = Window.partitionBy(*key).orderBy(F.desc("_stop"), F.desc("_copy"), F.desc(row)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda copies, frame: F.struct(*[x.over(frame).alias(n) for n, x in of(lambda c: F.when(F.col("_copy") == copies, F.col(c) if isinstance(c, str) else c)).items()])
    out = rows.withColumn("_early", part(True, early)).withColumn("_late", part(False, late))
    return out.filter("_own AND NOT _copy").select(*df.columns, "_early", "_late")


def top(df: DataFrame, by: list[str], order: list, n: int, shard: Column) -> DataFrame:
    """The first n rows of a key, by way of the first n of each shard."""
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = df.withColumn("_shard", shard).withColumn("_k", place([*by, "_shard"])).filter(F.col("_k") <= n)
    return some.withColumn("_k", place(by)).filter(F.col("_k") <= n).drop("_shard", "_k")


def quantile(df: DataFrame, by: list[str], value: str, q: float, name: str, bins: int = 1024, few: int = 10_000) -> DataFrame:
    """The exact quantile of a key's values that are not null, interpolated as percentile() does, by rounds of histograms: each
    counts the values of the range that still holds the wanted rank in bins and keeps the one bin that the rank falls into,
    until it holds few distinct values, which are then ranked. Values are counted by (key, value) first, so equal values are
    one row, and no key's values meet in a task. What a round starts from is a table in the shared folder."""
    v = F.col("_v")
    counts = kept(df.select(*by, F.col(value).alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    place = (F.col("_n") - 1) * q
    # Two ranks, of the values below and above the place; _before is how many values lie under the range.
    ends = F.explode(F.array(*[F.struct(f(place).cast("long").alias("rank"), F.lit(k).alias("end")) for k, f in enumerate((F.floor, F.ceil))]))
    open_ = kept(whole.select(*by, "_n", "_distinct", "_a", "_b", F.lit(0).cast("long").alias("_before"), ends.alias("_w")).select("*", "_w.*").drop("_w"), "ranges")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    settled = None
    while True:
        ready = open_.filter((F.col("_distinct") <= few) | (F.col("_a") == F.col("_b")))
        settled = ready if settled is None else settled.unionByName(ready)
        rest = open_.filter((F.col("_distinct") > few) & (F.col("_a") != F.col("_b")))
        if not rest.head(1):
            break
        inside = counts.alias("l").join(rest.alias("r"), [*same, F.col("l._v").between(F.col("r._a"), F.col("r._b"))])
        bin_ = F.least(F.floor((F.col("l._v") - F.col("r._a")) / (F.col("r._b") - F.col("r._a")) * bins), F.lit(bins - 1))
        bar = inside.select(*[F.col(f"r.{c}") for c in [*by, "_n", "_before", "rank", "end"]], F.col("l._v"), F.col("l._n").alias("_c"), bin_.alias("_bin"))
        bars = bar.groupBy(*by, "_n", "_before", "rank", "end", "_bin").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        under = F.sum("_c").over(Window.partitionBy(*by, "end").orderBy("_bin"))
        held = bars.withColumn("_upto", F.col("_before") + under).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
        open_ = kept(held.select(*by, "_n", "_distinct", "_a", "_b", (F.col("_upto") - F.col("_c")).alias("_before"), "rank", "end"), "ranges")
    inside = counts.alias("l").join(settled.alias("r"), [*same, F.col("l._v").between(F.col("r._a"), F.col("r._b"))])
    few_rows = inside.select(*[F.col(f"r.{c}") for c in by], F.col("r._n").alias("_all"), "r._before", "r.rank", "r.end", F.col("l._v"), F.col("l._n").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "end").orderBy("_v"))
    at = few_rows.withColumn("_upto", upto).filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_c")))
    low, high = (F.max(F.when(F.col("end") == k, v)) for k in (0, 1))
    part = (F.max("_all") - 1) * q
    return at.groupBy(*by).agg((low + (high - low) * (part - F.floor(part))).alias(name))
