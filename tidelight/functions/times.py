"""Time functions over TIMESTAMP columns; the session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"(?i)(Z|[+-]\d{2}:?\d{2})$"


def localize(local: Column, zone: str) -> Column:
    """A wall-clock time of a zone as UTC; null where the zone skips it or has it twice.

    Spark maps both silently. A skipped time comes back as another; an ambiguous one is hit again
    by the UTC time an hour before or after.
    """
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("interval 1 hour")
    back = [F.from_utc_timestamp(t, zone) == local for t in (utc, utc - hour, utc + hour)]
    return F.when(back[0] & ~back[1] & ~back[2], utc)


def parse_ts(text: Column, zone: str | None = None) -> Column:
    """Text to UTC. Blank or purely numeric text is null; without an offset the zone counts, and without a zone it is an error."""
    text = F.trim(text)
    usable = (text != "") & ~text.rlike(r"^[+-]?\d+(\.\d+)?$")
    aware = F.try_to_timestamp(text)
    plain = F.try_to_timestamp(text)
    naive = localize(plain, zone) if zone else F.when(plain.isNotNull(), F.raise_error(F.lit("a time without an offset needs a zone")).cast("timestamp"))
    return F.when(usable, F.when(text.rlike(_ZONED), aware).otherwise(naive))


def shift_days(utc: Column, days: int, zone: str) -> Column:
    """The same wall-clock time so many calendar days on; null where that time does not exist once."""
    local = F.from_utc_timestamp(utc, zone).cast("timestamp_ntz")
    return localize((local + F.make_dt_interval(F.lit(days))).cast("timestamp"), zone)


def night_bounds(day: Column, zone: str, start_hour: int, end_hour: int) -> tuple[Column, Column]:
    """UTC bounds of the night that begins on a local date."""
    at = lambda d, h: F.to_utc_timestamp((d.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(h))).cast("timestamp"), zone)
    return at(day, start_hour), at(F.date_add(day, 1), end_hour)


def floor_window(ts: Column, width_s: int) -> Column:
    """Start of the half-open window that a time falls into."""
    return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (width_s * 1_000_000)) * width_s)


def ceil_slot(ts: Column, minutes: int = 15) -> Column:
    width = minutes * 60_000_000
    return F.timestamp_seconds(F.ceil(F.unix_micros(ts) / width) * (minutes * 60))


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, rounded down."""
    return F.floor((F.unix_micros(b) - F.unix_micros(a)) / 60_000_000)


def hours_until(now: Column, then: Column) -> Column:
    return F.round((F.unix_micros(then) - F.unix_micros(now)) / 3_600_000_000, 2)


def is_night(utc: Column, zone: str, start_hour: int = 22, end_hour: int = 8) -> Column:
    hour = F.hour(F.from_utc_timestamp(utc, zone))
    return (hour >= start_hour) | (hour < end_hour)


def offset_map(ts: Column, source_start: Column, scenario_start: Column) -> Column:
    """Source time moved by the distance between two anchors; both or neither must be there."""
    moved = F.timestamp_micros(F.unix_micros(ts) + F.unix_micros(scenario_start) - F.unix_micros(source_start))
    one = source_start.isNull() != scenario_start.isNull()
    return F.when(one, F.raise_error(F.lit("one anchor without the other")).cast("timestamp")).when(source_start.isNull(), ts).otherwise(moved)
