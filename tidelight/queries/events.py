"""Queries over single events: casts, labels, policies, checks, ids, times, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, times
from ..operators import hrv, profile, quality
from . import bindings as b
from .bindings import EV, LAB, table, text
from .bindings import sql_text as st
from .registry import query

# Numbers as text with what goes wrong in files: NaN, inf, blanks, words.
_TEXT = "CASE WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN 'inf' WHEN event_id % 23 = 0 THEN '' WHEN event_id % 29 = 0 THEN 'broken' ELSE CAST(value AS VARCHAR(40)) END"


@query("p1_cast_values", f"SELECT event_id, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 OR event_id % 29 = 0 THEN NULL ELSE value END AS number FROM events")
def p1(spark, sf):
    return table(spark, sf, "events").select("event_id", quality.cast_number(F.expr(_TEXT.replace("VARCHAR(40)", "STRING"))).alias("number"))


@query("p2_nonfinite_filter", "SELECT event_id, value FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND value IS NOT NULL")
def p2(spark, sf):
    x = F.expr("CASE WHEN event_id % 17 = 0 THEN double('NaN') WHEN event_id % 19 = 0 THEN double('-inf') WHEN event_id % 23 = 0 THEN NULL ELSE value END")
    return quality.drop_nonfinite(table(spark, sf, "events").select("event_id", x.alias("value")), ["value"])


@query("p3_event_quality_label", f"WITH {LAB} SELECT eid AS event_id, quality, quality_reason FROM lab")
def p3(spark, sf):
    return b.bronze(spark, sf).select("event_id", "quality", "quality_reason")


@query(
    "p4_simple_quality_label",
    f"""WITH {LAB} SELECT eid AS event_id, CASE WHEN signal = 'hr' AND (value = 0 OR value > 220 OR dup) THEN 'flagged' WHEN signal = 'eda' AND value < 0 THEN 'flagged' WHEN signal = 'acc' THEN 'flagged' ELSE 'valid' END AS quality, source_row FROM lab""",
)
def p4(spark, sf):
    rows = quality.label_simple(quality.flag_duplicates(b.raw(spark, sf), b.FILE))
    return rows.select(scalars.event_id(F.col("participant_id"), F.col("signal"), F.col("source_row")).alias("event_id"), "quality", "source_row")


@query("p5_unit_projection", f"WITH {EV} SELECT signal, unit, count(*) AS n FROM ev GROUP BY ALL")
def p5(spark, sf):
    return b.raw(spark, sf).groupBy("signal", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("p6_quality_policy_scalar", f"WITH {LAB} SELECT eid AS event_id, value FROM lab WHERE signal = 'hr' AND quality = 'valid' AND value BETWEEN 30 AND 220")
def p6(spark, sf):
    return quality.usable_scalar(b.bronze(spark, sf), "hr", *b.P.hr_range).select("event_id", F.col("values")["value"].alias("value"))


@query("p7_quality_policy_vector", f"WITH {LAB} SELECT eid AS event_id, unit FROM lab WHERE signal = 'acc' AND CASE WHEN source_kind = 'synthetic_fixture' THEN unit = 'unverified' ELSE unit <> 'unverified' END")
def p7(spark, sf):
    return quality.usable_vector(b.bronze(spark, sf)).select("event_id", "unit")


@query("p8_values_pivot", f"WITH {LAB} SELECT eid AS event_id, CASE WHEN signal <> 'acc' THEN value END AS value, CASE WHEN signal = 'acc' THEN value END AS x, CASE WHEN signal = 'acc' THEN y END AS y, CASE WHEN signal = 'acc' THEN z END AS z FROM lab")
def p8(spark, sf):
    return quality.pivot_values(b.bronze(spark, sf)).select("event_id", "value", "x", "y", "z")


@query("p9_contract_columns_check", "SELECT count(*) AS n, 14 AS columns FROM events")
def p9(spark, sf):
    df = quality.check_columns(b.bronze(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("columns", F.lit(len([c for c in df.columns if c in quality.COLUMNS])))


@query(
    "p10_contract_values_check",
    f"""WITH {LAB}, d AS (SELECT CASE WHEN source_row % 50 = 0 THEN 'invented' ELSE source_kind END AS source_kind, CASE WHEN source_row % 70 = 0 THEN 'bvp' ELSE signal END AS signal, CASE WHEN source_row % 90 = 0 THEN 'good' ELSE quality END AS quality FROM lab)
    SELECT * FROM (SELECT 'source_kind' AS "column", source_kind AS bad_value, count(*) AS n FROM d WHERE source_kind = 'invented' GROUP BY 2 UNION ALL SELECT 'signal', signal, count(*) FROM d WHERE signal = 'bvp' GROUP BY 2 UNION ALL SELECT 'quality', quality, count(*) FROM d WHERE quality = 'good' GROUP BY 2)""",
)
def p10(spark, sf):
    row = F.col("source_row")
    df = b.bronze(spark, sf).withColumns({"source_kind": F.when(row % 50 == 0, "invented").otherwise(F.col("source_kind")), "signal": F.when(row % 70 == 0, "bvp").otherwise(F.col("signal")), "quality": F.when(row % 90 == 0, "good").otherwise(F.col("quality"))})
    return quality.bad_values(df)


@query("p11_event_validity", f"WITH {LAB} SELECT eid AS event_id, signal FROM lab WHERE source_row % 40 = 0 OR source_row % 60 = 0 OR source_row % 44 = 0")
def p11(spark, sf):
    row = F.col("source_row")
    df = b.bronze(spark, sf).withColumns(
        {
            "run_id": F.when(row % 40 == 0, "other").otherwise(F.col("run_id")),
            "values": F.when(row % 60 == 0, F.create_map(F.lit("w"), F.lit(1.0))).when(row % 44 == 0, F.transform_values("values", lambda k, v: F.lit(float("nan")))).otherwise(F.col("values")),
        }
    )
    return quality.bad_events(df, b.RUN).select("event_id", "signal")


_INTERVALS = "SELECT l_orderkey, l_linenumber, l_shipdate AS start, l_shipdate + to_minutes(CAST(l_quantity AS BIGINT) - 10) AS \"end\" FROM lineitem"


@query("p13_interval_validity", f'SELECT l_orderkey, l_linenumber FROM ({_INTERVALS}) WHERE start >= "end"')
def p13(spark, sf):
    minutes = (F.col("l_quantity").cast("long") - 10) * 60
    start = F.col("l_shipdate").cast("timestamp")
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", start.alias("start"), F.timestamp_seconds(F.unix_seconds(start) + minutes).alias("end"))
    return quality.bad_intervals(df).select("l_orderkey", "l_linenumber")


@query("p14_run_participant_filter", f"WITH {LAB} SELECT eid AS event_id FROM lab WHERE participant_id = 'p1'")
def p14(spark, sf):
    return quality.for_run(b.bronze(spark, sf), b.RUN, "p1").select("event_id")


@query("p15_bounded_segment", f"WITH {LAB} SELECT eid AS event_id FROM lab WHERE ts >= TIMESTAMP '2024-01-10 17:00:00' AND ts < TIMESTAMP '2024-01-14 05:00:00'")
def p15(spark, sf):
    bound = lambda t: times.localize(F.lit(t).cast("timestamp_ntz").cast("timestamp"), b.P.zone)
    return quality.segment(b.bronze(spark, sf), bound("2024-01-10 12:00:00"), bound("2024-01-14 00:00:00")).select("event_id")


_COARSE = "date_trunc('minute', ts)"


@query("w1_duplicate_timestamp_flag", f"WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY participant_id, signal, {_COARSE}) > 1 AS duplicate FROM ev")
def w1(spark, sf):
    df = b.raw(spark, sf).withColumn("source_timestamp", F.date_trunc("minute", "source_timestamp"))
    return quality.flag_duplicates(df, b.FILE).select((F.col("source_row") - 1).alias("event_id"), "duplicate")


@query("w2_out_of_order_flag", f"WITH {EV} SELECT event_id, coalesce(source_timestamp < lag(source_timestamp) OVER (PARTITION BY participant_id, signal ORDER BY (event_id * 7919) % 1000003), false) AS backwards FROM ev")
def w2(spark, sf):
    df = b.raw(spark, sf).withColumn("event_id", F.col("source_row") - 1).withColumn("source_row", (F.col("event_id") * 7919) % 1000003)
    # From 1,000,003 events on places repeat, and the SQL leaves the order of those open.
    return quality.flag_order(df, b.FILE, then=("event_id",)).select("event_id", "backwards")


@query("k1_stable_event_order", f"WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY participant_id, signal ORDER BY source_timestamp, source_row) AS place FROM ev")
def k1(spark, sf):
    order = Window.partitionBy("participant_id", "signal").orderBy("source_timestamp", "source_row")
    return b.raw(spark, sf).select((F.col("source_row") - 1).alias("event_id"), F.row_number().over(order).cast("long").alias("place"))


@query("k2_merge_signals_ordered", f"WITH {LAB} SELECT eid AS event_id, {st('ts')} AS event_time, signal FROM lab WHERE signal IN ('hr', 'eda', 'acc') ORDER BY ts, signal, source_row")
def k2(spark, sf):
    return profile.ordered_events(*[b.bronze(spark, sf).filter(F.col("signal") == s) for s in ("hr", "eda", "acc")]).select("event_id", text(F.col("event_time")).alias("event_time"), "signal")


@query("u1_union_signals", f"WITH {LAB} SELECT eid AS event_id, signal FROM lab WHERE signal IN ('hr', 'eda')")
def u1(spark, sf):
    df = b.bronze(spark, sf).select("event_id", "signal")
    return df.filter("signal = 'hr'").unionByName(df.filter("signal = 'eda'"))


@query("u3_set_equality", f"WITH {LAB}, a AS (SELECT DISTINCT participant_id, unit FROM lab WHERE quality = 'valid'), c AS (SELECT DISTINCT participant_id, unit FROM lab) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)) AS only_left, (SELECT count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM a)) AS only_right")
def u3(spark, sf):
    df = b.bronze(spark, sf)
    return profile.set_difference(df.filter("quality = 'valid'").select("participant_id", "unit").distinct(), df.select("participant_id", "unit").distinct())


@query("u4_domain_difference", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def u4(spark, sf):
    return quality.out_of_domain(table(spark, sf, "events"), "event_type", ["click", "view", "purchase"])


@query("u5_distinct_reason_codes", f"WITH {LAB} SELECT participant_id, signal, coalesce(list_sort(list_distinct(flatten(list(list_filter(string_split(quality_reason, ';'), lambda x: x <> ''))))), []) AS codes, coalesce(list_has_any(flatten(list(string_split(quality_reason, ';'))), ['unit_unverified']), false) AS protect FROM lab GROUP BY ALL")
def u5(spark, sf):
    codes = F.explode_outer(F.filter(F.split("quality_reason", ";"), lambda x: x != ""))
    df = b.bronze(spark, sf).select("participant_id", "signal", codes.alias("code")).groupBy("participant_id", "signal").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return df.withColumn("protect", F.arrays_overlap("codes", F.array(F.lit("unit_unverified"))))


@query("u6_keep_last_per_key", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def u6(spark, sf):
    return quality.keep_last(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("m1_clamp01", "SELECT event_id, least(greatest(value / 100 - 0.2, 0), 1) AS score FROM events")
def m1(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.clamp01(F.col("value") / 100 - 0.2).alias("score"))


@query("m2_vector_magnitude", f"WITH {EV} SELECT event_id, round(sqrt(value * value + y * y + z * z), 9) AS mag FROM ev WHERE signal = 'acc'")
def m2(spark, sf):
    return b.raw(spark, sf).filter("signal = 'acc'").select((F.col("source_row") - 1).alias("event_id"), F.round(scalars.magnitude(F.col("x"), F.col("y"), F.col("z")), 9).alias("mag"))


@query("m3_log1p_value", "SELECT event_id, round(ln(1 + value), 9) AS log_value FROM events WHERE event_type = 'view'")
def m3(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'view'").select("event_id", F.round(F.log1p("value"), 9).alias("log_value"))


@query("x1_event_id", f"WITH {EV} SELECT event_id, printf('%s-%s-%09d', participant_id, signal, source_row) AS id FROM ev")
def x1(spark, sf):
    return b.raw(spark, sf).select((F.col("source_row") - 1).alias("event_id"), scalars.event_id(F.col("participant_id"), F.col("signal"), F.col("source_row")).alias("id"))


@query("x2_window_ids", "SELECT event_id, 'window-' || strftime(date_trunc('minute', ts), '%Y%m%dT%H%MZ') AS window_id, 'rest-' || strftime(ts, '%Y%m%d') AS night_id, 'baseline-median-mad-1.4826-w24-r6' AS baseline_id FROM events")
def x2(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", scalars.window_id(times.floor_window(ts, 60)).alias("window_id"), scalars.night_id(ts).alias("night_id"), F.lit(b.P.baseline_id).alias("baseline_id"))


@query("x3_proposal_key", "SELECT event_id, substr(sha1(event_type || '|' || user_id || '|' || event_id), 1, 10) AS plan_key FROM events")
def x3(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.plan_key(F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("plan_key"))


_HM = "CASE WHEN n >= 60 AND n % 60 <> 0 THEN (n // 60) || ' h ' || (n % 60) || ' m' WHEN n >= 60 THEN (n // 60) || ' h' ELSE n || ' m' END"


@query("x4_duration_text", f"SELECT l_orderkey, l_linenumber, {_HM} AS duration, strftime((l_shipdate + to_hours(l_linenumber)) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%a %-I:%M %p') AS clock FROM (SELECT *, CAST(l_quantity * 7 AS BIGINT) AS n FROM lineitem)")
def x4(spark, sf):
    at = F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_linenumber") * 3600)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.duration_text(F.col("l_quantity") * 7).alias("duration"), scalars.local_clock_text(at, b.P.zone).alias("clock"))


@query("x5_safe_identifier", "SELECT page_id, regexp_full_match(url, '[A-Za-z0-9][A-Za-z0-9_.-]{0,127}') AS whole, regexp_full_match(split_part(url, '/', 3), '[A-Za-z0-9][A-Za-z0-9_.-]{0,127}') AS host FROM pages")
def x5(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.safe_identifier(F.col("url")).alias("whole"), scalars.safe_identifier(F.split_part("url", F.lit("/"), F.lit(3))).alias("host"))


@query("r4_values_map", f"WITH {LAB} SELECT eid AS event_id, CASE WHEN signal = 'acc' THEN 3 ELSE 1 END AS keys, round(CASE WHEN signal = 'acc' THEN value + y + z ELSE value END, 6) AS total FROM lab")
def r4(spark, sf):
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, x: a + x)
    return b.bronze(spark, sf).select("event_id", F.size("values").alias("keys"), F.round(total, 6).alias("total"))


@query("r6_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS missing FROM events")
def r6(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("r7_array_text_parse", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN [] ELSE [event_type, CAST(user_id AS VARCHAR)] END AS ids FROM events")
def r7(spark, sf):
    written = F.when(F.col("event_id") % 5 != 0, F.format_string("['%s', '%s']", "event_type", "user_id"))
    return table(spark, sf, "events").select("event_id", scalars.parse_array_text(written).alias("ids"))


_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query(
    "d1_parse_timestamp",
    f"""SELECT event_id, {st("CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL 5 HOUR WHEN 2 THEN date_trunc('second', ts) AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' END")} AS utc FROM events""",
)
def d1(spark, sf):
    stamp, k = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 5
    written = F.when(k == 0, F.concat(stamp, F.lit("Z"))).when(k == 1, F.concat(stamp, F.lit("-05:00"))).when(k == 2, stamp).when(k == 3, F.lit("20240105"))
    return table(spark, sf, "events").select("event_id", text(times.parse_ts(written, b.P.zone)).alias("utc"))


# A wall-clock time of the zone as UTC, where it exists once: tried an hour to either side.
_LOCAL = "u AS (SELECT *, local AT TIME ZONE 'America/New_York' AT TIME ZONE 'UTC' AS t FROM l), n AS (SELECT *, {0} = local AND {1} <> local AND {2} <> local AS once FROM u)".format(*[f"(t + to_hours({h})) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York'" for h in (0, -1, 1)])


@query("d2_dst_safe_localize", f"WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2026-03-08 00:00:00' ELSE TIMESTAMP '2026-11-01 00:00:00' END + to_minutes(o_orderkey % 240) AS local FROM orders), {_LOCAL} SELECT o_orderkey, {st('local')} AS local, {st('CASE WHEN once THEN t END')} AS utc FROM n")
def d2(spark, sf):
    """Order dates moved onto the two days a year on which the zone's clock jumps."""
    hour = (F.col("o_orderkey") % 240) * 60
    spring, autumn = "2026-03-08 00:00:00", "2026-11-01 00:00:00"
    local = F.timestamp_seconds(F.unix_seconds(F.when(F.col("o_orderkey") % 2 == 0, F.lit(spring)).otherwise(F.lit(autumn)).cast("timestamp")) + hour)
    return table(spark, sf, "orders").select("o_orderkey", text(local).alias("local"), text(times.localize(local, b.P.zone)).alias("utc"))


@query("d3_shift_local_days", f"WITH a AS (SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS at_utc FROM orders), l AS (SELECT *, at_utc AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' + INTERVAL 100 DAY AS local FROM a), {_LOCAL} SELECT o_orderkey, {st('at_utc')} AS utc, {st('CASE WHEN once THEN t END')} AS shifted FROM n")
def d3(spark, sf):
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + (F.col("o_orderkey") % 24) * 3600)
    return table(spark, sf, "orders").select("o_orderkey", text(at).alias("utc"), text(times.shift_days(at, 100, b.P.zone)).alias("shifted"))


@query("d5_offset_map", f"SELECT event_id, {st('ts + (TIMESTAMP ' + chr(39) + '2026-10-09 16:00:00' + chr(39) + ' - TIMESTAMP ' + chr(39) + '2024-01-01 00:00:00' + chr(39) + ')')} AS event_time FROM events")
def d5(spark, sf):
    at = lambda t: F.lit(t).cast("timestamp")
    return table(spark, sf, "events").select("event_id", text(times.offset_map(F.col("ts").cast("timestamp"), at("2024-01-01 00:00:00"), at("2026-10-09 16:00:00"))).alias("event_time"))


@query("d6_floor_minute", f"SELECT event_id, {st('date_trunc(' + chr(39) + 'minute' + chr(39) + ', ts)')} AS minute FROM events")
def d6(spark, sf):
    return table(spark, sf, "events").select("event_id", text(times.floor_window(F.col("ts").cast("timestamp"), 60)).alias("minute"))


@query("d7_ceil_slot_15", f"SELECT event_id, {st('make_timestamp(CAST(ceil(epoch_us(ts) / 900000000.0) AS BIGINT) * 900000000)')} AS slot FROM events")
def d7(spark, sf):
    return table(spark, sf, "events").select("event_id", text(times.ceil_slot(F.col("ts").cast("timestamp"))).alias("slot"))


@query("d8_minutes_between", "SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 60000000.0) AS BIGINT) AS minutes, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 3600000000.0, 2) AS hours FROM events")
def d8(spark, sf):
    now, ts = F.lit("2024-01-15 12:00:00").cast("timestamp"), F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", times.minutes_between(now, ts).alias("minutes"), times.hours_until(now, ts).alias("hours"))


@query("d10_is_night_phase", "SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') >= 22 OR hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') < 8 AS night FROM events")
def d10(spark, sf):
    return table(spark, sf, "events").select("event_id", times.is_night(F.col("ts").cast("timestamp"), b.P.zone).alias("night"))


# Profiles of whole files.
@query(
    "a5_signal_profile",
    f"""WITH {LAB}, g AS (SELECT participant_id, signal, (epoch_us(source_timestamp) - epoch_us(lag(source_timestamp) OVER (PARTITION BY participant_id, signal ORDER BY source_timestamp))) / 1000000.0 AS gap FROM lab),
    gg AS (SELECT participant_id, signal, 1 / median(gap) FILTER (gap > 0) AS hz, count(*) FILTER (gap > 3600) AS long_gaps, max(gap) AS largest_gap FROM g GROUP BY ALL)
    SELECT participant_id, signal, count(*) AS n_rows, count(*) FILTER (quality = 'dropped') AS dropped, count(*) FILTER (quality = 'flagged') AS flagged, count(DISTINCT source_timestamp) AS unique_times, count(*) FILTER (dup) AS duplicates,
      {st('min(source_timestamp)')} AS first_time, {st('max(source_timestamp)')} AS last_time, round(any_value(hz), 9) AS hz, any_value(long_gaps) AS long_gaps, any_value(largest_gap) AS largest_gap
    FROM lab JOIN gg USING (participant_id, signal) GROUP BY participant_id, signal""",
)
def a5(spark, sf):
    df = profile.profile(b.labelled(spark, sf), b.FILE, 3600)
    return df.select(*b.FILE, "n_rows", "dropped", "flagged", "unique_times", "duplicates", text(F.col("first_time")).alias("first_time"), text(F.col("last_time")).alias("last_time"), F.round("hz", 9).alias("hz"), "long_gaps", "largest_gap")


@query("a6_reason_histogram", f"WITH {LAB} SELECT signal, quality_reason, count(*) AS n FROM lab WHERE quality_reason <> '' GROUP BY ALL")
def a6(spark, sf):
    return profile.reason_counts(b.labelled(spark, sf), ["signal"])


@query("a12_duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 20")
def a12(spark, sf):
    return profile.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"], 20)


@query("a13_row_span", f"WITH {LAB} SELECT signal, count(*) AS n, count(DISTINCT eid) AS n_ids, {st('min(ts)')} AS first_time, {st('max(ts)')} AS last_time FROM lab GROUP BY 1")
def a13(spark, sf):
    df = profile.row_span(b.bronze(spark, sf), "event_time", ["signal"], "event_id")
    return df.withColumns({c: text(F.col(c)) for c in ("first_time", "last_time")})


@query("a14_distinct_source_kinds", f"WITH {EV} SELECT DISTINCT source_kind FROM ev")
def a14(spark, sf):
    return b.raw(spark, sf).select("source_kind").distinct()


@query("a20_signal_quality_matrix", f"WITH {LAB} SELECT signal, quality, unit, count(*) AS n FROM lab GROUP BY ALL")
def a20(spark, sf):
    return b.labelled(spark, sf).groupBy("signal", "quality", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("k6_largest_gaps", f"WITH {EV}, g AS (SELECT participant_id, signal, event_id, source_row, (epoch_us(source_timestamp) - epoch_us(lag(source_timestamp) OVER (PARTITION BY participant_id, signal ORDER BY source_timestamp, source_row))) / 1000000.0 AS gap FROM ev) SELECT participant_id, signal, event_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, signal ORDER BY gap DESC, source_row) AS k FROM g WHERE gap IS NOT NULL) WHERE k <= 8")
def k6(spark, sf):
    return profile.largest_gaps(b.raw(spark, sf), b.FILE, 8).select(*b.FILE, (F.col("source_row") - 1).alias("event_id"), "gap")


_NIGHTCOV = f"""{LAB}, spans AS (SELECT participant_id, signal, min(source_timestamp) AS f, max(source_timestamp) AS l FROM lab GROUP BY ALL),
dd AS (SELECT *, CAST(unnest(generate_series(CAST(CAST(f AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) - 1 AS TIMESTAMP), CAST(CAST(l AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS TIMESTAMP) AS day FROM spans),
nn AS (SELECT participant_id, signal, strftime(day, '%Y-%m-%d') AS night, f, l, ((day + INTERVAL 22 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ns, ((day + INTERVAL 32 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ne FROM dd),
mc AS (SELECT participant_id, signal, date_trunc('minute', t) AS m, least(count(*) / 1.0, 1.0) AS c FROM (SELECT DISTINCT participant_id, signal, source_timestamp AS t FROM lab) GROUP BY ALL),
nc AS (SELECT n.participant_id, n.signal, n.night, round(coalesce(sum(c), 0) / (epoch(ne - ns) / 60), 6) AS coverage FROM nn n LEFT JOIN mc ON mc.participant_id = n.participant_id AND mc.signal = n.signal AND m >= ns AND m < ne WHERE ns <= l AND ne > f GROUP BY n.participant_id, n.signal, n.night, ns, ne)"""


@query("a4_overnight_coverage", f"WITH {_NIGHTCOV} SELECT participant_id, signal, night, coverage FROM nc")
def a4(spark, sf):
    return profile.overnight_coverage(b.labelled(spark, sf), b.FILE, 1.0, b.P.zone)


@query("u2_common_nights", f"WITH {_NIGHTCOV} SELECT participant_id, night FROM nc WHERE signal IN ('hr', 'eda', 'acc') GROUP BY ALL HAVING count(*) = 3")
def u2(spark, sf):
    return profile.common_nights(profile.overnight_coverage(b.labelled(spark, sf), b.FILE, 1.0, b.P.zone)).select("participant_id", "night")


@query(
    "a7_participant_ranking",
    f"""WITH {_NIGHTCOV}, cm AS (SELECT participant_id, night, min(coverage) AS c FROM nc WHERE signal IN ('hr', 'eda', 'acc') GROUP BY ALL HAVING count(*) = 3),
    sc AS (SELECT participant_id, sum(c) AS score FROM cm GROUP BY 1), sp AS (SELECT participant_id, max(f) AS a, min(l) AS b FROM spans WHERE signal IN ('hr', 'eda', 'acc') GROUP BY 1)
    SELECT participant_id, round(score, 6) AS score, {st('a')} AS common_start, {st('a + INTERVAL 48 HOUR')} AS demo_start, {st('least(b + INTERVAL 1 SECOND, a + INTERVAL 84 HOUR)')} AS demo_end
    FROM sc JOIN sp USING (participant_id) WHERE b - a >= INTERVAL 60 HOUR ORDER BY score DESC, participant_id LIMIT 1""",
)
def a7(spark, sf):
    rows = b.labelled(spark, sf)
    nights = profile.overnight_coverage(rows, b.FILE, 1.0, b.P.zone)
    spans = rows.groupBy(*b.FILE).agg(F.min("source_timestamp").alias("first_time"), F.max("source_timestamp").alias("last_time"))
    df = profile.rank_entities(nights, spans, 60, 36)
    return df.select("participant_id", F.round("score", 6).alias("score"), *[text(F.col(c)).alias(c) for c in ("common_start", "demo_start", "demo_end")])


_HRV = """WITH {ev}, i AS (SELECT participant_id, event_id, ts, epoch_us(ts) AS t, value / 10 AS v, (value / 10 - lag(value / 10) OVER o) ^ 2 AS d2, epoch_us(ts) - lag(epoch_us(ts)) OVER o AS gap FROM ev WHERE signal = 'ibi' AND value > 0 WINDOW o AS (PARTITION BY participant_id ORDER BY ts, event_id)),
f AS (SELECT *, count(*) OVER w AS n, stddev_samp(v) OVER w AS sd, sum(d2) OVER w - coalesce(first_value(d2) OVER w, 0) AS s2, min(t) OVER w AS a, max(CASE WHEN gap > {gap} THEN t END) OVER w AS broken FROM i WINDOW w AS (PARTITION BY participant_id ORDER BY t RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)),
h AS (SELECT *, n >= 2 AND a - (t - {span}) <= {gap} AND (broken IS NULL OR broken <= a) AS clean FROM f)
SELECT participant_id, event_id, clean, CASE WHEN clean THEN round(sqrt(greatest(s2, 0) / (n - 1)), 6) END AS rmssd, CASE WHEN clean THEN round(sd, 6) END AS sdnn FROM h""".format(ev=EV, span=2 * 86_400_000_000 - 1, gap=5 * 3_600_000_000)


@query("v1_rmssd_sdnn", _HRV)
def v1(spark, sf):
    """Beats are sparse here: a segment is two days, a gap is five hours."""
    beats = b.raw(spark, sf).filter("signal = 'ibi' AND value > 0").withColumn("v", F.col("value") / 10)
    df = hrv.variability(beats, "v", seconds=2 * 86_400, max_gap_s=5 * 3600)
    return df.select("participant_id", (F.col("source_row") - 1).alias("event_id"), "clean", F.round("rmssd", 6).alias("rmssd"), F.round("sdnn", 6).alias("sdnn"))
