"""How the driver's tables stand in for the library's: as DataFrames, and as SQL CTEs for the oracles.

events -> raw rows and bronze; orders -> tasks and exams; lineitem -> plan blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Params
from ..functions.scalars import event_id
from ..operators import baseline, minutes, nights, quality, state
from ..sources.layers import stored

#: Hourly windows, as the events are sparse; widths and counts follow.
P = Params(
    width_s=3600, expected={"hr": 2, "eda": 2, "acc": 2}, trailing_s=10_800, still_below=0.4, refresh=6, max_history=120, warmup=24, activity_full=1.0,
    still_ratio=0.5, bridge=1, min_rest=1, min_overnight=0.3, target_rest=10, sufficient_coverage=0.5,
)
RUN = "run-1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(ts: Column) -> Column:
    """Times as text, so that results compare alike in any engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def sql_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


SIGNAL = {"click": "hr", "view": "eda", "purchase": "acc", "error": "temp", "signup": "ibi"}


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    signal = F.element_at(F.create_map(*[F.lit(x) for kv in SIGNAL.items() for x in kv]), F.col("event_type"))
    acc = signal == "acc"
    number = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.lit("1.0").alias("schema_version"), F.lit(RUN).alias("run_id"), F.concat(F.lit("p"), F.col("user_id") % 2).alias("participant_id"),
        F.when(F.col("user_id") % 2 == 0, "synthetic_fixture").otherwise("recorded_replay").alias("source_kind"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("source_timestamp"), F.col("ts").cast("timestamp").alias("event_time"),
        (F.col("ts").cast("timestamp") + F.expr("interval 5 seconds")).alias("ingested_at"), signal.alias("signal"),
        F.when(~acc, F.col("value")).alias("value"), F.when(acc, F.col("value")).alias("x"), F.when(acc, number).alias("y"), F.when(acc, (F.col("user_id") % 64).cast("double")).alias("z"),
        quality.assign_unit(signal, F.when(acc & (F.col("user_id") % 4 == 3), "g")).alias("unit"), F.concat(F.col("event_type"), F.lit(".csv")).alias("source_file"), (F.col("event_id") + 1).alias("source_row"),
    )


FILE = ["participant_id", "signal"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.flag_order(quality.flag_duplicates(raw(spark, sf_dir), FILE), FILE)
    return quality.label_quality(rows)


def build_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    values = F.when(F.col("signal") == "acc", F.create_map(*[v for a in "xyz" for v in (F.lit(a), F.col(a))])).otherwise(F.create_map(F.lit("value"), F.col("value")))
    df = df.withColumn("event_id", event_id(F.col("participant_id"), F.col("signal"), F.col("source_row")))
    return df.withColumn("values", values).select(*quality.COLUMNS, "quality_reason")


# The layers are tables, as they would be in use; each is built from the one before and read by many queries.
def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "bronze", lambda: build_bronze(spark, sf_dir))


def build_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minutes.silver(bronze(spark, sf_dir), P)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "silver", lambda: build_silver(spark, sf_dir))


def build_silver_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.add_z(silver(spark, sf_dir), P)


def silver_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "silver_z", lambda: build_silver_z(spark, sf_dir))


def rests(z: DataFrame) -> DataFrame:
    return nights.rest_runs(nights.night_grid(z, nights.night_bounds(z, P), P), P)


def with_nights(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = silver_z(spark, sf_dir)
    return nights.attach_night(z, rests(z))


def build_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.gold(with_nights(spark, sf_dir), P)


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "gold", lambda: build_gold(spark, sf_dir))


EV = """ev AS (
  SELECT event_id, ts, user_id, value, props, event_type, 'p' || (user_id % 2) AS participant_id,
    CASE event_type WHEN 'click' THEN 'hr' WHEN 'view' THEN 'eda' WHEN 'purchase' THEN 'acc' WHEN 'error' THEN 'temp' ELSE 'ibi' END AS signal,
    CASE WHEN user_id % 2 = 0 THEN 'synthetic_fixture' ELSE 'recorded_replay' END AS source_kind,
    date_trunc('second', ts) AS source_timestamp, event_id + 1 AS source_row,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, CAST(user_id % 64 AS DOUBLE) AS z,
    CASE event_type WHEN 'click' THEN 'bpm' WHEN 'view' THEN 'uS' WHEN 'purchase' THEN CASE WHEN user_id % 4 = 3 THEN 'g' ELSE 'unverified' END WHEN 'error' THEN 'C' ELSE 's' END AS unit
  FROM events
)"""
LAB = f"""{EV}, fl AS (
  SELECT *, count(*) OVER (PARTITION BY participant_id, signal, source_timestamp) > 1 AS dup,
    coalesce(source_timestamp < lag(source_timestamp) OVER (PARTITION BY participant_id, signal ORDER BY source_row), false) AS back
  FROM ev
), lab AS (
  SELECT *, CASE WHEN r = '' THEN 'valid' ELSE 'flagged' END AS quality, r AS quality_reason,
    printf('%s-%s-%09d', participant_id, signal, source_row) AS eid
  FROM (SELECT *, (CASE WHEN dup THEN 'duplicate_timestamp;' ELSE '' END) || (CASE WHEN back THEN 'out_of_order;' ELSE '' END)
    || (CASE WHEN signal IN ('hr', 'eda', 'ibi') AND value < 0 THEN 'negative_measurement;' ELSE '' END)
    || (CASE WHEN signal IN ('hr', 'ibi') AND value <= 0 THEN 'nonpositive_hr_or_ibi;' ELSE '' END)
    || (CASE WHEN signal = 'hr' AND value > 220 THEN 'hr_above_engineering_range;' ELSE '' END)
    || (CASE WHEN unit = 'unverified' THEN 'unit_unverified;' ELSE '' END) AS r FROM fl)
)"""
SCALARS = f"""{LAB}, hr AS (
  SELECT participant_id, date_trunc('hour', ts) AS ws, avg(value) AS m, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd, count(*) AS n
  FROM lab WHERE signal = 'hr' AND quality = 'valid' AND value BETWEEN 30 AND 220 GROUP BY ALL
), eda AS (
  SELECT participant_id, date_trunc('hour', ts) AS ws, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n
  FROM lab WHERE signal = 'eda' AND quality = 'valid' AND value BETWEEN 0 AND 100 GROUP BY ALL
)"""
ACC = """dynrows AS (
  SELECT participant_id, ts, source_row, mag, tr, abs(mag - tr) / 64 AS dyn FROM (
    SELECT *, avg(mag) OVER (PARTITION BY participant_id ORDER BY epoch_us(ts) RANGE BETWEEN 10799999999 PRECEDING AND CURRENT ROW) AS tr
    FROM (SELECT *, sqrt(value * value + y * y + z * z) AS mag FROM lab
          WHERE signal = 'acc' AND CASE WHEN source_kind = 'synthetic_fixture' THEN unit = 'unverified' ELSE unit <> 'unverified' END))
), acc AS (
  SELECT participant_id, date_trunc('hour', ts) AS ws, avg(dyn) AS m, stddev_samp(dyn) AS sd, max(dyn) AS hi, avg(CASE WHEN dyn < 0.4 THEN 1.0 ELSE 0.0 END) AS still, count(*) AS n
  FROM dynrows GROUP BY ALL
)"""
SILVER = f"""{SCALARS}, {ACC}, span AS (
  SELECT participant_id, min(ws) AS a, max(ws) AS b FROM (SELECT participant_id, ws FROM hr UNION ALL SELECT participant_id, ws FROM eda UNION ALL SELECT participant_id, ws FROM acc) GROUP BY 1
), grid AS (SELECT participant_id, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ws FROM span),
kinds AS (SELECT participant_id, max(source_kind) AS source_kind FROM lab GROUP BY 1),
silver AS (
  SELECT g.participant_id, g.ws, g.ws + INTERVAL 1 HOUR AS we, hr.m AS hr_mean, hr.lo AS hr_min, hr.hi AS hr_max, hr.sd AS hr_std, least(coalesce(hr.n, 0) / 2, 1.0) AS hr_coverage,
    eda.m AS eda_mean, eda.sd AS eda_std, eda.m - lag(eda.m) OVER (PARTITION BY g.participant_id ORDER BY g.ws) AS eda_delta, least(coalesce(eda.n, 0) / 2, 1.0) AS eda_coverage,
    acc.m AS acc_mean, acc.sd AS acc_std, acc.hi AS acc_max, acc.still AS stillness, least(coalesce(acc.n, 0) / 2, 1.0) AS acc_coverage, source_kind
  FROM grid g LEFT JOIN hr USING (participant_id, ws) LEFT JOIN eda USING (participant_id, ws) LEFT JOIN acc USING (participant_id, ws) JOIN kinds USING (participant_id)
)"""


def _stats(name: str, column: str, epsilon: float) -> str:
    return f"""{name}_b AS (SELECT participant_id, bucket, coalesce(list({column}) FILTER ({column} IS NOT NULL), []) AS vals, count({column}) AS cnt, min(ws) AS cutoff FROM ix GROUP BY ALL),
{name}_h AS (SELECT participant_id, bucket, cutoff,
    flatten(list(vals) OVER (PARTITION BY participant_id ORDER BY bucket RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS hist,
    coalesce(CAST(sum(cnt) OVER (PARTITION BY participant_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS prior FROM {name}_b),
{name}_m AS (SELECT *, CASE WHEN prior >= 24 AND len(hist) > 0 THEN list_aggregate(hist, 'median') END AS med FROM {name}_h),
{name}_s AS (SELECT participant_id, bucket, cutoff, prior, med, CASE WHEN med IS NOT NULL THEN greatest(1.4826 * list_aggregate(list_transform(hist, lambda x: abs(x - med)), 'median'), {epsilon}) END AS scale FROM {name}_m)"""


Z = f"""{SILVER}, ix AS (
  SELECT s.*, ln(1 + eda_mean) AS eda_log, CAST(floor(date_diff('hour', f.a, ws) / 6) AS BIGINT) AS bucket FROM silver s JOIN span f USING (participant_id)
), {_stats("hrb", "hr_mean", 1.0)}, {_stats("edab", "eda_log", 0.02)}, z AS (
  SELECT ix.*, (hr_mean - h.med) / h.scale AS hr_z, CASE WHEN hr_mean IS NULL THEN 'no_value' WHEN h.med IS NULL THEN 'baseline_warmup' END AS hr_z_reason,
    (eda_log - e.med) / e.scale AS eda_z, CASE WHEN eda_log IS NULL THEN 'no_value' WHEN e.med IS NULL THEN 'baseline_warmup' END AS eda_z_reason,
    'baseline-median-mad-1.4826-w24-r6' AS baseline_id, h.prior AS baseline_n_valid, h.cutoff AS baseline_cutoff
  FROM ix JOIN hrb_s h USING (participant_id, bucket) JOIN edab_s e USING (participant_id, bucket)
)"""
NIGHTS = f"""{Z}, days AS (
  SELECT participant_id, b, CAST(unnest(generate_series(CAST(CAST((a AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) - 1 AS TIMESTAMP), CAST(CAST((b AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS TIMESTAMP) AS day
  FROM (SELECT participant_id, min(ws) AS a, max(we) AS b FROM silver GROUP BY 1)
), nights AS (
  SELECT participant_id, 'rest-' || strftime(day, '%Y%m%d') AS night_id, ((day + INTERVAL 22 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ns,
    ((day + INTERVAL 32 HOUR) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS ne, b FROM days
), nb AS (SELECT participant_id, night_id, ns, ne FROM nights WHERE ne <= b),
ng0 AS (SELECT participant_id, night_id, ns, ne, unnest(generate_series(ns, ne - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS ws FROM nb),
ng AS (
  SELECT n.*, z.acc_coverage, z.stillness, z.hr_z, coalesce(z.acc_coverage, 0) >= 0.5 AS observed,
    coalesce(z.acc_coverage, 0) >= 0.5 AND coalesce(z.stillness, 0) >= 0.5 AND (z.hr_z IS NULL OR z.hr_z <= 0.5) AS candidate
  FROM ng0 n LEFT JOIN z USING (participant_id, ws)
), rr AS (
  SELECT *, sum(CASE WHEN observed THEN 0 ELSE 1 END) OVER w AS un, row_number() OVER w AS rn FROM ng WINDOW w AS (PARTITION BY participant_id, night_id ORDER BY ws)
), cc AS (
  SELECT *, CASE WHEN rn - lag(rn) OVER w - 1 > 1 OR un <> lag(un) OVER w OR lag(rn) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM rr WHERE candidate WINDOW w AS (PARTITION BY participant_id, night_id ORDER BY ws)
), runs AS (
  SELECT participant_id, night_id, run, count(*) AS n, min(ws) AS a, max(ws) AS b, count(hr_z) AS checked
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY participant_id, night_id ORDER BY ws) AS run FROM cc) GROUP BY ALL
), best AS (
  SELECT participant_id, night_id, n, a, b FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, night_id ORDER BY n DESC, a) AS k FROM runs) WHERE k = 1
), chk AS (SELECT participant_id, night_id, sum(checked) / sum(n) AS checked FROM runs GROUP BY ALL),
rest AS (
  SELECT c.participant_id, c.night_id, c.ns, c.ne, c.coverage, coalesce(k.checked, 0) AS checked, coalesce(b.n, 0) AS minutes, b.a AS run_start, b.b + INTERVAL 1 HOUR AS run_end
  FROM (SELECT participant_id, night_id, ns, ne, avg(CASE WHEN observed THEN 1.0 ELSE 0.0 END) AS coverage FROM ng GROUP BY ALL) c LEFT JOIN best b USING (participant_id, night_id) LEFT JOIN chk k USING (participant_id, night_id)
)"""
GOLD = f"""{NIGHTS}, an AS (
  SELECT z.*, r.night_id, r.coverage AS ncov, r.checked, r.minutes FROM z ASOF LEFT JOIN rest r ON z.participant_id = r.participant_id AND z.we >= r.ne
), sc AS (
  SELECT *, 'window-' || strftime(ws, '%Y%m%dT%H%MZ') AS window_id,
    CASE WHEN hr_coverage < 0.5 OR hr_mean IS NULL THEN 'hr_coverage_below_threshold' WHEN eda_coverage < 0.5 OR eda_mean IS NULL THEN 'eda_coverage_below_threshold'
         WHEN hr_z IS NULL THEN coalesce(hr_z_reason, 'hr_baseline_unavailable') WHEN eda_z IS NULL THEN coalesce(eda_z_reason, 'eda_baseline_unavailable') END AS load_reason,
    CASE WHEN acc_coverage >= 0.5 AND acc_mean IS NOT NULL THEN round(least(greatest(acc_mean / 1.0, 0), 1), 4) END AS activity_level,
    CASE WHEN night_id IS NULL THEN 'no_completed_night' WHEN ncov < 0.3 THEN 'overnight_coverage_below_minimum' END AS rest_reason
  FROM an
), ld AS (
  SELECT *, CASE WHEN load_reason IS NULL THEN round((0.5 * least(greatest(hr_z / 3, 0), 1) + 0.5 * least(greatest(eda_z / 3, 0), 1)) / 1.0, 4) END AS load,
    CASE WHEN rest_reason IS NULL THEN CAST(minutes AS INTEGER) END AS rest_minutes FROM sc
), tp AS (
  SELECT *, CASE WHEN load IS NOT NULL THEN max({{'l': load, 'w': window_id}}) OVER (PARTITION BY participant_id, load IS NOT NULL ORDER BY we ROWS BETWEEN 19 PRECEDING AND CURRENT ROW).w END AS top_id FROM ld
), gold AS (
  SELECT 'run-1' AS run_id, participant_id, we AS as_of, ws AS window_start, we AS window_end, round(hr_mean, 2) AS heart_rate_bpm, load AS physiological_load, activity_level,
    rest_minutes AS estimated_rest_minutes, CASE WHEN rest_minutes IS NOT NULL THEN round(least(greatest(rest_minutes / 10, 0), 1), 4) END AS recovery_score, round(ncov, 4) AS overnight_coverage,
    CASE WHEN load IS NULL AND hr_mean IS NULL THEN 'unavailable' WHEN load IS NULL OR rest_minutes IS NULL OR least(hr_coverage, eda_coverage, acc_coverage) < 0.5 THEN 'limited' ELSE 'sufficient' END AS status,
    load_reason, rest_reason, checked, hr_coverage, eda_coverage, acc_coverage, baseline_id, baseline_cutoff, window_id, night_id, top_id,
    evidence AS evidence_ids, coalesce(activity_level >= 0.35, false) AS activity_confound, source_kind
  FROM (SELECT *, list_filter([window_id, CASE WHEN rest_reason IS NULL THEN night_id END, CASE WHEN top_id <> window_id THEN top_id END], lambda x: x IS NOT NULL) AS evidence FROM tp)
)"""
