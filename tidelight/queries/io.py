"""Queries over sources, sinks, manifests and streams. Files are written from the driver's tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ENTITY
from ..operators.grounding import grounding_audit
from ..sources import files, sinks
from ..sources.layers import new_path
from ..streaming import stateful, streams
from . import bindings as b
from .bindings import EV, GOLD, LAB, P, table, text
from .bindings import sql_text as st
from .registry import query
from .states import RULES, _ARMED, _CONSUMED, _COOL, _SUS, consumed


@query("s1_scan_signal_csv", f"WITH {EV} SELECT participant_id, CAST(row_number() OVER (PARTITION BY participant_id ORDER BY event_id) - 1 AS BIGINT) AS source_row, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS \"Timestamp\", value FROM ev WHERE signal = 'hr'")
def s1(spark, sf):
    """Every row of the files, with its physical place."""
    path = new_path(spark, "csv")
    hr = b.raw(spark, sf).filter("signal = 'hr'").repartition("participant_id").sortWithinPartitions("participant_id", "source_row")
    hr.select("participant_id", F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(" Timestamp"), F.col("value").alias("Value ")).write.partitionBy("participant_id").option("header", True).csv(path)
    rows = files.scan_signal_csv(spark, path, "hr")
    who = F.regexp_extract("source_file", "participant_id=([^/]+)", 1)
    return rows.select(who.alias("participant_id"), F.col("source_row").cast("long").alias("source_row"), "Timestamp", F.col("Value").cast("double").alias("value"))


@query("s2_resolve_signal_files", f"WITH {EV} SELECT DISTINCT CAST(user_id AS VARCHAR) AS participant_id, signal, 'data/' || user_id || '/' || upper(signal) || CASE WHEN user_id % 2 = 0 THEN '_' || user_id ELSE '' END || '.csv' AS path FROM ev")
def s2(spark, sf):
    e = table(spark, sf, "events")
    signal = F.element_at(F.create_map(*[F.lit(x) for kv in b.SIGNAL.items() for x in kv]), F.col("event_type"))
    own = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("_"), "user_id")).otherwise("")
    return files.resolve_files(e.select(F.concat(F.lit("data/"), "user_id", F.lit("/"), F.upper(signal), own, F.lit(".csv")).alias("path")).distinct())


def landed(spark, sf):
    path = new_path(spark, "jsonl")
    b.bronze(spark, sf).drop("quality_reason").write.json(path)
    return path


@query("s3_scan_bronze_jsonl", f"WITH {LAB} SELECT eid AS event_id, signal, quality, unit, source_row, {st('ts')} AS event_time, CASE WHEN signal = 'acc' THEN y ELSE value END AS value FROM lab")
def s3(spark, sf):
    df = files.scan_events_json(spark, landed(spark, sf))
    return df.select("event_id", "signal", "quality", "unit", "source_row", text(F.col("event_time")).alias("event_time"), F.coalesce(F.col("values")["y"], F.col("values")["value"]).alias("value"))


def manifest(spark, sf, root=None):
    return files.write_with_manifest(b.bronze(spark, sf).drop("quality_reason"), root or new_path(spark, "landing"), "batch-1")


_COUNTS = f"WITH {LAB} SELECT 'run-1' AS run_id, signal, count(*) AS row_count FROM lab GROUP BY ALL"


@query("s4_stream_markers", _COUNTS)
def s4(spark, sf):
    root, out = new_path(spark, "landing"), new_path(spark, "markers")
    manifest(spark, sf, root)
    df = files.stream_markers(spark, f"{root}/manifest")
    streams.run_available(df, f"{out}-checkpoint", out)
    return spark.read.schema(files.MARKER).parquet(out).groupBy("run_id", "signal").agg(F.sum("row_count").alias("row_count"))


@query("s5_stream_table", f"WITH {LAB} SELECT eid AS event_id, signal FROM lab WHERE participant_id = 'p1'")
def s5(spark, sf):
    src, out = new_path(spark, "events"), new_path(spark, "own")
    df = b.bronze(spark, sf).select("run_id", "participant_id", "event_id", "signal")
    df.write.parquet(src)
    streams.run_available(files.stream_events(spark, src, df.schema).filter((F.col("run_id") == b.RUN) & (F.col("participant_id") == "p1")), f"{out}-checkpoint", out)
    return spark.read.schema(df.schema).parquet(out).select("event_id", "signal")


_PRINTS = f"WITH {EV}, l AS (SELECT signal, event_id // 5000 AS part, event_id || chr(9) || props || chr(10) AS line, event_id FROM ev) SELECT signal, part, sha256(string_agg(line, '' ORDER BY event_id)) AS sha256, CAST(sum(strlen(line)) AS BIGINT) AS size FROM l GROUP BY ALL"


@query("s6_file_fingerprint", _PRINTS)
def s6(spark, sf):
    """Files of lines, those over 20 kB hashed as they pass."""
    path = new_path(spark, "lines")
    e = b.raw(spark, sf).select("signal", (F.col("source_row") - 1).alias("event_id")).join(table(spark, sf, "events").select("event_id", "props"), "event_id")
    e = e.withColumn("part", F.floor(F.col("event_id") / 5000)).repartition("signal", "part").sortWithinPartitions("signal", "part", "event_id")
    e.select("signal", "part", F.concat(F.col("event_id").cast("string"), F.lit("\t"), "props").alias("value")).write.partitionBy("signal", "part").text(path)
    of = lambda name: F.regexp_extract("path", f"{name}=([^/]+)", 1)
    return files.file_fingerprints(spark, path, 20_000).select(of("signal").alias("signal"), of("part").cast("long").alias("part"), "sha256", "size")


@query("s7_manifest_sink", _COUNTS)
def s7(spark, sf):
    root = new_path(spark, "landing")
    manifest(spark, sf, root)
    return manifest(spark, sf, root).groupBy("run_id", "signal").agg(F.sum("row_count").alias("row_count"))  # the second call changes nothing


def halves(spark, sf):
    """events as target and updates: a row is in one or in both, by its user and value, none in neither."""
    e = table(spark, sf, "events").select("event_id", "user_id", "value")
    side = (F.floor(F.col("value") * 100) + F.col("user_id")) % 3
    return e.filter(side != 2), e.filter(side != 0).withColumn("value", F.when(F.col("user_id") % 3 != 0, F.col("value") + 1))


_SIDE = "(CAST(floor(value * 100) AS BIGINT) + user_id) % 3"
_HALVES = f"t AS (SELECT event_id, user_id, value FROM events WHERE {_SIDE} <> 2), u AS (SELECT event_id, user_id, CASE WHEN user_id % 3 <> 0 THEN value + 1 END AS value FROM events WHERE {_SIDE} <> 0)"


@query("s8_upsert_sink", f"WITH {_HALVES} SELECT * FROM u UNION ALL SELECT * FROM t WHERE event_id NOT IN (SELECT event_id FROM u)")
def s8(spark, sf):
    t, u = halves(spark, sf)
    return sinks.upsert(t, u, ["event_id"])


@query("s9_update_only_sink", f"WITH {_HALVES} SELECT t.event_id, t.user_id, CASE WHEN u.event_id IS NULL THEN t.value ELSE u.value END AS value FROM t LEFT JOIN u USING (event_id)")
def s9(spark, sf):
    t, u = halves(spark, sf)
    return sinks.update_columns(t, u, ["event_id"], ["value"])


@query("s10_insert_once_sink", f"WITH {_HALVES} SELECT event_id, user_id FROM u WHERE event_id NOT IN (SELECT event_id FROM t)")
def s10(spark, sf):
    t, u = halves(spark, sf)
    return sinks.insert_new(t, u.unionAll(u), ["event_id"], within="event_id").select("event_id", "user_id")


_EXPORTED = f"WITH {GOLD} SELECT participant_id, {st('window_end')} AS window_end, physiological_load, evidence_ids FROM gold WHERE source_kind = 'synthetic_fixture'"
_STATE = "participant_id string, window_end timestamp, physiological_load double, evidence_ids array<string>, source_kind string"


def exported(spark, sf):
    path = new_path(spark, "export")
    columns = ["participant_id", "window_end", "physiological_load", "evidence_ids", "source_kind"]
    sinks.export_state(b.gold(spark, sf).filter("source_kind = 'synthetic_fixture'").select(*columns), path)
    return path


@query("s11_export_state", _EXPORTED)
def s11(spark, sf):
    df = spark.read.schema(_STATE).parquet(f"{exported(spark, sf)}/parquet")
    return df.select("participant_id", text(F.col("window_end")).alias("window_end"), "physiological_load", "evidence_ids")


@query("s12_scan_state_csv", _EXPORTED)
def s12(spark, sf):
    df = sinks.scan_state_csv(spark, exported(spark, sf), _STATE)
    return df.select("participant_id", text(F.col("window_end")).alias("window_end"), "physiological_load", "evidence_ids")


@query("s13_explode_nested_calendar", f"SELECT 'run-' || (o_custkey % 16) AS run_id, CAST(o_orderkey AS VARCHAR) AS task_id, CAST(CAST(floor(o_totalprice) AS BIGINT) % 300 AS INTEGER) AS remaining_minutes, {st('o_orderdate')} AS deadline FROM orders")
def s13(spark, sf):
    o = table(spark, sf, "orders")
    task = F.struct(F.col("o_orderkey").cast("string").alias("task_id"), (F.floor("o_totalprice") % 300).alias("remaining_minutes"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("deadline"))
    # A document holds the tasks of a hundred orders of a run.
    docs = o.groupBy(F.concat(F.lit("run-"), F.col("o_custkey") % 16).alias("run_id"), F.floor(F.col("o_orderkey") / 1600)).agg(F.to_json(F.struct(F.collect_list(task).alias("tasks"))).alias("body"))
    return files.explode_calendar(docs)["tasks"].select("run_id", "task_id", "remaining_minutes", text(F.col("deadline")).alias("deadline"))


@query("j18_manifest_reconcile", f"WITH {LAB}, e AS (SELECT signal, count(*) AS n FROM lab GROUP BY 1), a AS (SELECT signal, count(*) AS n FROM lab WHERE signal <> 'temp' AND NOT (signal = 'hr' AND source_row % 5 = 0) GROUP BY 1) SELECT signal, CAST(e.n AS BIGINT) AS expected, CAST(a.n AS BIGINT) AS actual, CASE WHEN a.n IS NULL THEN 'missing' WHEN a.n <> e.n THEN 'row_count' ELSE 'ok' END AS status FROM e LEFT JOIN a USING (signal)")
def j18(spark, sf):
    rows = b.bronze(spark, sf)
    count = lambda df: df.groupBy("signal").agg(F.count(F.lit(1)).alias("row_count"))
    return files.reconcile(count(rows), count(rows.filter("signal <> 'temp' AND NOT (signal = 'hr' AND source_row % 5 = 0)")), ["signal"])


@query("j19_marker_verify", f"WITH {LAB} SELECT signal, CASE signal WHEN 'hr' THEN 'malformed' ELSE 'other_content' END AS problem, count(*) AS row_count FROM lab WHERE signal IN ('hr', 'eda') GROUP BY ALL")
def j19(spark, sf):
    """The markers of a landing, spoiled: other counts for heart rate, other hashes for skin conductance."""
    root = new_path(spark, "landing")
    told = manifest(spark, sf, root)
    m = told.withColumns({"row_count": F.when(F.col("signal") == "hr", 0).otherwise(F.col("row_count")), "sha256": F.when(F.col("signal") == "eda", F.sha2("sha256", 256)).otherwise(F.col("sha256"))})
    prints = files.file_fingerprints(spark, f"{root}/data").withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    found = files.verify_markers(m, prints, b.RUN).join(told.select("path", "signal", "row_count"), "path")
    return found.groupBy("signal", "problem").agg(F.sum("row_count").alias("row_count"))


@query("x6_grounding_audit", r"""WITH t AS (SELECT conv_id, role, text AS body, regexp_replace(text, '\b\d{1,2}:\d{2}\b', ' ', 'g') AS rest FROM conversations WHERE text IS NOT NULL),
tok AS (SELECT conv_id, role, unnest(list_concat(regexp_extract_all(body, '\b\d{1,2}:\d{2}\b'), list_transform(regexp_extract_all(' ' || rest, '[^\w.](\d+(\.\d+)?)'), lambda x: x[2:]))) AS token FROM t),
said AS (SELECT DISTINCT conv_id, token FROM tok WHERE role = 'assistant'), known AS (SELECT DISTINCT conv_id, token FROM tok WHERE role <> 'assistant'),
m AS (SELECT s.conv_id, s.token, k.token IS NOT NULL AS ok FROM said s LEFT JOIN known k USING (conv_id, token)),
g AS (SELECT conv_id, count(*) FILTER (NOT contains(token, ':')) AS n_numbers, count(*) FILTER (contains(token, ':')) AS n_clocks, list_sort(coalesce(list(token) FILTER (NOT ok), [])) AS ungrounded FROM m GROUP BY 1)
SELECT c.conv_id, coalesce(n_numbers, 0) AS n_numbers, coalesce(n_clocks, 0) AS n_clocks, coalesce(ungrounded, []) AS ungrounded, len(coalesce(ungrounded, [])) = 0 AS grounded FROM (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant') c LEFT JOIN g USING (conv_id)""")
def x6(spark, sf):
    c = table(spark, sf, "conversations")
    return grounding_audit(c.filter("role = 'assistant'").select("conv_id", "text"), c.filter("role <> 'assistant'").select("conv_id", "text"), "conv_id")


#: Files of a part of a stream; a batch takes as many.
FILES = 4


def in_parts(spark, df, place, parts=4):
    """df in files of its parts by number, one part after the other so that a file source takes them in order."""
    path = new_path(spark, "parts")
    for i in range(parts):
        df.filter(place == i).repartition(FILES).write.mode("append").parquet(path)
    return path


def by_time(df, time, parts=4):
    """Number of a row's part, of parts of consecutive times."""
    bounds = df.agg(F.min(F.unix_micros(time)).alias("a"), F.max(F.unix_micros(time)).alias("z")).first()
    return F.least(F.floor((F.unix_micros(time) - bounds.a) * parts / F.lit(bounds.z - bounds.a + 1)), F.lit(parts - 1))


def hr(spark, sf):
    return b.bronze(spark, sf).filter("signal = 'hr'").select(*ENTITY, "event_id", "event_time", "source_row", F.col("values")["value"].alias("v"))


_WINDOWS = "SELECT participant_id, {s} AS window_start, round(avg(value), 9) AS mean, min(value) AS min, max(value) AS max, count(*) AS n FROM lab WHERE signal = 'hr' {w} GROUP BY participant_id, date_trunc('hour', ts)".format
_FINAL = f"WITH {LAB}, w AS ({_WINDOWS(s=st('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)'), w='{w}')}) SELECT * FROM w WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 MINUTE FROM lab WHERE signal = 'hr')"


def windows_out(df):
    return df.select("participant_id", text(F.col("window_start")).alias("window_start"), F.round("mean", 9).alias("mean"), "min", "max", "n")


def finalised(spark, path, schema, windows):
    out = new_path(spark, "minutes")
    streamed = windows(files.stream_events(spark, path, schema, FILES), P)
    streams.run_available(streamed, f"{out}-checkpoint", out)
    return windows_out(spark.read.schema(streamed.schema).parquet(out))


@query("t1_finalize_minutes", _FINAL.format(w=""))
def t1(spark, sf):
    df = hr(spark, sf)
    return finalised(spark, in_parts(spark, df, by_time(df, "event_time")), df.schema, streams.stream_minutes)


# Rows of the first half that arrive after all others: their windows are out.
_LATE = "AND NOT (source_row % 10 = 0 AND ts < TIMESTAMP '2024-01-15 00:00:00')"
_OWN_CLOCK = f"WITH {LAB}, own AS (SELECT participant_id, max(ts) AS clock FROM lab WHERE signal = 'hr' GROUP BY 1), w AS ({_WINDOWS(s=st('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)'), w=_LATE)}) SELECT w.* FROM w JOIN own USING (participant_id) WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + INTERVAL 1 HOUR <= clock - INTERVAL 2 MINUTE"


@query("t2_late_data", _OWN_CLOCK)
def t2(spark, sf):
    """One participant's month comes after the other's, which by one watermark for all were late; last come rows that are late by their own clock."""
    df = hr(spark, sf)
    late = (F.col("source_row") % 10 == 0) & (F.col("event_time") < F.lit("2024-01-15 00:00:00").cast("timestamp"))
    place = F.when(late, 4).otherwise(by_time(df, "event_time", 2) + F.when(F.col("participant_id") == "p1", 2).otherwise(0))
    return finalised(spark, in_parts(spark, df, place, 5), df.schema, stateful.entity_windows)


def streamed_layers(spark, sf, parts=3):
    """The layers that a stream of bronze in three parts leaves behind."""
    from ..sources.layers import _stored

    key = (spark.sparkContext.applicationId, sf, "streamed")
    if key not in _stored:
        df, root = b.bronze(spark, sf).drop("quality_reason"), new_path(spark, "streamed")
        path = in_parts(spark, df, by_time(df, "event_time", parts), parts)
        events = streams.once(files.stream_events(spark, path, df.schema, FILES), ["run_id", "event_id"])
        streams.run_available(events, f"{root}-checkpoint", each=streams.layers_batch(root, P, 120))
        _stored[key] = (root, None)
    return _stored[key][0]


_CLOSED = "(SELECT max(ts) - INTERVAL 2 MINUTE FROM lab)"


@query("t3_lookback", f"WITH {b.SILVER} SELECT participant_id, {st('ws')} AS window_start, round(hr_mean, 9) AS hr_mean, round(acc_mean, 7) AS acc_mean, stillness, acc_coverage FROM silver WHERE we <= {_CLOSED}")
def t3(spark, sf):
    df = spark.read.parquet(f"{streamed_layers(spark, sf)}/silver")
    return df.select("participant_id", text(F.col("window_start")).alias("window_start"), F.round("hr_mean", 9).alias("hr_mean"), F.round("acc_mean", 7).alias("acc_mean"), "stillness", "acc_coverage")


@query("t4_baseline_stream", f"WITH {b.Z} SELECT participant_id, {st('ws')} AS window_start, round(hr_z, 7) AS hr_z, hr_z_reason, round(eda_z, 7) AS eda_z, baseline_n_valid FROM z WHERE we <= {_CLOSED}")
def t4(spark, sf):
    df = spark.read.parquet(f"{streamed_layers(spark, sf)}/silver_z")
    return df.select("participant_id", text(F.col("window_start")).alias("window_start"), F.round("hr_z", 7).alias("hr_z"), "hr_z_reason", F.round("eda_z", 7).alias("eda_z"), "baseline_n_valid")


@query("t5_gold_stream", f"WITH {GOLD} SELECT participant_id, {st('window_end')} AS window_end, physiological_load, recovery_score, evidence_ids FROM gold WHERE window_end <= {_CLOSED}")
def t5(spark, sf):
    df = spark.read.parquet(f"{streamed_layers(spark, sf)}/gold")
    return df.select("participant_id", text(F.col("window_end")).alias("window_end"), "physiological_load", "recovery_score", "evidence_ids")


_OUT = "clock AS (SELECT participant_id, max(t) AS clock FROM (SELECT participant_id, window_end AS t FROM gold UNION ALL SELECT participant_id, consumed.at FROM consumed) GROUP BY 1)"


@query("t6_hysteresis_stream", f"WITH {GOLD}, {_SUS}, {_CONSUMED}, {_ARMED}, {_COOL}, {_OUT} SELECT participant_id, {st('window_end')} AS window_end, armed, cooling FROM cool JOIN clock USING (participant_id) WHERE window_end < clock")
def t6(spark, sf):
    """What g1 calls AWAITING_RESET and COOLDOWN, from a stream of loads and consumptions."""
    loads = b.gold(spark, sf).select(*ENTITY, F.col("window_end").alias("at"), F.lit(1).alias("kind"), F.col("physiological_load").alias("load"))
    used = consumed(spark, sf).select(*ENTITY, F.col("consumed_at").alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("double").alias("load"))
    marks, out = loads.unionByName(used), new_path(spark, "decisions")
    path = in_parts(spark, marks, by_time(marks, "at", 3), 3)
    decided = stateful.decisions(files.stream_events(spark, path, marks.schema, FILES), RULES)
    streams.run_available(decided, f"{out}-checkpoint", out)
    return spark.read.schema(decided.schema).parquet(out).select("participant_id", text(F.col("window_end")).alias("window_end"), "armed", "cooling")


@query("t7_exactly_once_insert", f"WITH {LAB} SELECT eid AS event_id, signal FROM lab")
def t7(spark, sf):
    """Every part arrives twice."""
    df, out = b.bronze(spark, sf).select("run_id", "event_id", "signal", "event_time"), new_path(spark, "once")
    both = df.withColumn("again", F.lit(0)).unionAll(df.withColumn("again", F.lit(1)))
    path = in_parts(spark, both, by_time(df, "event_time", 2) + 2 * F.col("again"))
    stream = streams.once(files.stream_events(spark, path, both.schema, FILES), ["run_id", "event_id"])
    streams.run_available(stream, f"{out}-checkpoint", out)
    return spark.read.schema(df.schema).parquet(out).select("event_id", "signal")


@query("t8_available_now", f"WITH {LAB} SELECT eid AS event_id, signal FROM lab")
def t8(spark, sf):
    """Two runs over one checkpoint: the second takes what came after the first."""
    df, out, src = b.bronze(spark, sf).select("event_id", "signal", "source_row"), new_path(spark, "now"), new_path(spark, "now-source")
    for part in ("source_row % 2 = 0", "source_row % 2 = 1"):
        df.filter(part).write.mode("append").parquet(src)
        streams.run_available(files.stream_events(spark, src, df.schema), f"{out}-checkpoint", out)
    return spark.read.schema(df.schema).parquet(out).select("event_id", "signal")


@query("t10_minute_upsert_view", f"WITH {LAB} {_WINDOWS(s=st('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts)'), w='')}")
def t10(spark, sf):
    """Windows as they stand, unfinished ones included, with corrections by rows that come long after their window."""
    df, out = hr(spark, sf), new_path(spark, "view")
    late = F.col("source_row") % 10 == 0
    path = in_parts(spark, df, F.when(late, 4).otherwise(by_time(df, "event_time")), 5)
    view = streams.LateView(spark, out, P)
    streams.run_available(files.stream_events(spark, path, df.schema, FILES), f"{out}-checkpoint", each=view)
    return windows_out(view.compact(f"{out}-compact").rows())
