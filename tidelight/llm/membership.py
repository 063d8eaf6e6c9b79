"""A bounded bitmap of ids, which spares most rows of a large table the shuffle of a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^27 bits in bitmaps of 4 KB each: 16 MB at most, whatever the number of ids.
BITS = 27
_PER_BITMAP = 32_768


def _place(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(1 << BITS))


def split_by(df: DataFrame, column: str, ids: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, rows whose id is certainly not). Null ids are certainly not.

    The bitmap is broadcast, as its size is bounded. It errs to one side only, so a join of the
    first part with ids gives exactly what a join of df would. Where ids are so many that most
    bits are set, most rows are in the first part, and the join shuffles them as it would anyway.
    """
    place = _place(F.col(id_))
    bitmaps = ids.filter(F.col(id_).isNotNull()).groupBy(F.floor(place / _PER_BITMAP).alias("_tl_bucket")).agg(F.bitmap_construct_agg(place % _PER_BITMAP).alias("_tl_bits"))
    own = _place(F.col(column))
    at = (own % _PER_BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring("_tl_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = F.col("_tl_bits").isNotNull() & F.col(column).isNotNull() & (F.getbit(byte, at % 8) == 1)
    tested = df.withColumn("_tl_bucket", F.floor(own / _PER_BITMAP)).join(F.broadcast(bitmaps), "_tl_bucket", "left").withColumn("_tl_known", F.coalesce(known, F.lit(False)))
    return tested.filter("_tl_known").select(*df.columns), tested.filter("NOT _tl_known").select(*df.columns)
