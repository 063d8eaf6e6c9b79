"""Number, text, id and evidence functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(x: Column) -> Column:
    """x held to 0..1; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def event_id(participant: Column, signal: Column, row: Column) -> Column:
    return F.format_string("%s-%s-%09d", participant, signal, row)


def window_id(start: Column) -> Column:
    return F.date_format(start, "'window-'yyyyMMdd'T'HHmm'Z'")


def night_id(day: Column) -> Column:
    return F.date_format(day, "'rest-'yyyyMMdd")


def plan_key(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 10)


def duration_text(minutes: Column) -> Column:
    """Minutes as `2 h 5 m`, `2 h` or `5 m`."""
    n = F.round(minutes).cast("long")
    h, m = F.floor(n / 60).cast("string"), (n % 60).cast("string")
    return F.when((n >= 60) & (n % 60 != 0), F.concat(h, F.lit(" h "), m, F.lit(" m"))).when(n >= 60, F.concat(h, F.lit(" h"))).otherwise(F.concat(m, F.lit(" m")))


def local_clock_text(utc: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(utc, zone), "EEE h:mm a")


def percent_text(x: Column) -> Column:
    return F.bround(x * 100).cast("long").cast("string")


def safe_identifier(x: Column) -> Column:
    return x.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$")


def present(*items: Column) -> Column:
    """The non-null items, in order, each once."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def with_prefix(ids: Column, prefix: str) -> Column:
    return F.filter(ids, lambda x: x.startswith(prefix))


def reasons_map(**reasons: Column) -> Column:
    """Map of field -> reason without the fields whose reason is null."""
    return F.map_from_entries(F.array_compact(F.array(*[F.when(r.isNotNull(), F.struct(F.lit(k), r)) for k, r in reasons.items()])))


def sorted_json(**fields: Column) -> Column:
    """JSON text with keys in order and nulls written out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def parse_array_text(text: Column) -> Column:
    """`['a', 'b']` as an array; null as an empty one."""
    return F.coalesce(F.from_json(F.regexp_replace(text, "'", '"'), "array<string>"), F.array().cast("array<string>"))
