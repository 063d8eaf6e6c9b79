"""Queries over windows, baselines, nights, states, readers and the trigger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import ENTITY, Rules
from ..functions.scalars import present, with_prefix
from ..operators import baseline, minutes, nights, profile, quality, readers, state, trigger
from . import bindings as b
from .bindings import ACC, GOLD, LAB, NIGHTS, P, SCALARS, SILVER, Z, text
from .bindings import sql_text as st
from .registry import query


def r9(c):
    return F.round(c, 9).alias(c)


def start(df, *columns):
    return df.select("participant_id", text(F.col("window_start")).alias("window_start"), *columns)


@query("a1_minute_scalar", f"WITH {SCALARS} SELECT participant_id, {st('ws')} AS window_start, round(m, 9) AS mean, lo AS min, hi AS max, round(sd, 9) AS std, n FROM hr")
def a1(spark, sf):
    return start(minutes.minute_scalar(quality.usable_scalar(b.bronze(spark, sf), "hr", *P.hr_range), P), r9("mean"), "min", "max", r9("std"), "n")


@query("a2_coverage", f"WITH {SILVER} SELECT participant_id, {st('ws')} AS window_start, hr_coverage, eda_coverage, acc_coverage FROM silver")
def a2(spark, sf):
    return start(b.silver(spark, sf), "hr_coverage", "eda_coverage", "acc_coverage")


@query("a3_minute_vector", f"WITH {LAB}, {ACC} SELECT participant_id, {st('ws')} AS window_start, round(m, 7) AS acc_mean, round(sd, 7) AS acc_std, round(hi, 7) AS acc_max, round(still, 9) AS stillness, n AS acc_n FROM acc")
def a3(spark, sf):
    return start(minutes.minute_vector(quality.usable_vector(b.bronze(spark, sf)), P), *[F.round(c, 7).alias(c) for c in ("acc_mean", "acc_std", "acc_max")], r9("stillness"), "acc_n")


@query("w3_trailing_mean_10s", f"WITH {LAB}, {ACC} SELECT participant_id, source_row, round(mag, 7) AS mag, round(tr, 7) AS trailing FROM dynrows")
def w3(spark, sf):
    return minutes.dynamic(quality.usable_vector(b.bronze(spark, sf)), P).select("participant_id", "source_row", F.round("mag", 7).alias("mag"), F.round("trailing", 7).alias("trailing"))


@query("j1_align_signals", f"WITH {SILVER} SELECT participant_id, {st('ws')} AS window_start, round(hr_mean, 9) AS hr_mean, hr_min, hr_max, round(hr_std, 9) AS hr_std, round(eda_mean, 9) AS eda_mean, round(eda_std, 9) AS eda_std, round(acc_mean, 7) AS acc_mean, round(acc_max, 7) AS acc_max, source_kind FROM silver")
def j1(spark, sf):
    return start(b.silver(spark, sf), r9("hr_mean"), "hr_min", "hr_max", r9("hr_std"), r9("eda_mean"), r9("eda_std"), F.round("acc_mean", 7).alias("acc_mean"), F.round("acc_max", 7).alias("acc_max"), "source_kind")


@query("j2_minute_grid", f"WITH {SCALARS}, s AS (SELECT participant_id, min(ws) AS a, max(ws) AS z FROM hr GROUP BY 1), g AS (SELECT participant_id, unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS ws FROM s) SELECT participant_id, {st('ws')} AS window_start, n IS NOT NULL AS present FROM g LEFT JOIN hr USING (participant_id, ws)")
def j2(spark, sf):
    hr = minutes.minute_scalar(quality.usable_scalar(b.bronze(spark, sf), "hr", *P.hr_range), P)
    return start(minutes.minute_grid(hr, P).join(hr, [*ENTITY, "window_start"], "left"), F.col("n").isNotNull().alias("present"))


@query("w4_eda_delta", f"WITH {SILVER} SELECT participant_id, {st('ws')} AS window_start, round(eda_delta, 9) AS eda_delta FROM silver")
def w4(spark, sf):
    return start(b.silver(spark, sf), r9("eda_delta"))


@query("a21_coverage_means", f"WITH {SILVER} SELECT participant_id, round(avg(hr_coverage), 9) AS hr, round(avg(eda_coverage), 9) AS eda, round(avg(acc_coverage), 9) AS acc FROM silver GROUP BY 1")
def a21(spark, sf):
    return b.silver(spark, sf).groupBy("participant_id").agg(*[F.round(F.avg(f"{s}_coverage"), 9).alias(s) for s in ("hr", "eda", "acc")])


@query("w5_prior_valid_count", f"WITH {Z} SELECT participant_id, bucket, prior FROM hrb_s")
def w5(spark, sf):
    return baseline.baseline_stats(baseline.indexed(b.silver(spark, sf), P), "hr_mean", P.hr_epsilon, P).select("participant_id", "bucket", "prior")


@query("w6_causal_baseline", f"WITH {Z} SELECT participant_id, bucket, {st('cutoff')} AS cutoff, round(med, 8) AS med, round(scale, 8) AS scale FROM hrb_s")
def w6(spark, sf):
    df = baseline.baseline_stats(baseline.indexed(b.silver(spark, sf), P), "hr_mean", P.hr_epsilon, P)
    return df.select("participant_id", "bucket", text(F.col("cutoff")).alias("cutoff"), F.round("med", 8).alias("med"), F.round("scale", 8).alias("scale"))


@query("w7_baseline_z", f"WITH {Z} SELECT participant_id, {st('ws')} AS window_start, round(hr_z, 7) AS hr_z, hr_z_reason, round(eda_z, 7) AS eda_z, eda_z_reason, baseline_n_valid, {st('baseline_cutoff')} AS baseline_cutoff, baseline_id FROM z")
def w7(spark, sf):
    return start(b.silver_z(spark, sf), F.round("hr_z", 7).alias("hr_z"), "hr_z_reason", F.round("eda_z", 7).alias("eda_z"), "eda_z_reason", "baseline_n_valid", text(F.col("baseline_cutoff")).alias("baseline_cutoff"), "baseline_id")


@query("d4_night_bounds", f"WITH {NIGHTS} SELECT participant_id, night_id, {st('ns')} AS night_start, {st('ne')} AS night_end FROM nb")
def d4(spark, sf):
    return nights.night_bounds(b.silver(spark, sf), P).select("participant_id", "night_id", text(F.col("night_start")).alias("night_start"), text(F.col("night_end")).alias("night_end"))


@query("j3_night_grid", f"WITH {NIGHTS} SELECT participant_id, night_id, {st('ws')} AS window_start, observed, candidate FROM ng")
def j3(spark, sf):
    z = b.silver_z(spark, sf)
    return start(nights.night_grid(z, nights.night_bounds(z, P), P), "night_id", "observed", "candidate")


@query("w8_rest_runs", f"WITH {NIGHTS} SELECT participant_id, night_id, round(coverage, 9) AS coverage, round(checked, 9) AS checked, minutes, {st('run_start')} AS run_start, {st('run_end')} AS run_end FROM rest")
def w8(spark, sf):
    return b.rests(b.silver_z(spark, sf)).select("participant_id", "night_id", r9("coverage"), r9("checked"), "minutes", text(F.col("run_start")).alias("run_start"), text(F.col("run_end")).alias("run_end"))


@query("j4_state_asof_night", f"WITH {GOLD} SELECT participant_id, {st('we')} AS window_end, night_id, minutes FROM an")
def j4(spark, sf):
    return b.with_nights(spark, sf).select("participant_id", text(F.col("window_end")).alias("window_end"), "last_night.night_id", "last_night.minutes")


def end(df, *columns):
    return df.select("participant_id", text(F.col("window_end")).alias("window_end"), *columns)


def q_status():
    return F.get_json_object("quality_json", "$.status").alias("status")


_G = f"WITH {GOLD} SELECT participant_id, {st('window_end')} AS window_end,"


@query("m4_load_score", f"{_G} physiological_load, load_reason FROM gold")
def m4(spark, sf):
    return end(b.gold(spark, sf), "physiological_load", F.get_json_object("quality_json", "$.missing_reasons.physiological_load").alias("load_reason"))


@query("m5_activity_score", f"{_G} activity_level, activity_confound FROM gold")
def m5(spark, sf):
    return end(b.gold(spark, sf), "activity_level", "activity_confound")


@query("m6_recovery_score", f"{_G} estimated_rest_minutes, recovery_score FROM gold")
def m6(spark, sf):
    return end(b.gold(spark, sf), "estimated_rest_minutes", "recovery_score")


@query("m7_quality_status", f"{_G} status FROM gold")
def m7(spark, sf):
    return end(b.gold(spark, sf), q_status())


@query("w9_top_recent_evidence", f"{_G} top_id FROM gold")
def w9(spark, sf):
    z = b.with_nights(spark, sf).withColumns({"window_id": state.window_id(F.col("window_start")), "physiological_load": state.load_score(P)})
    return end(state.top_evidence(z, P.recent), "top_id")


@query("r1_evidence_array", f"{_G} evidence_ids FROM gold")
def r1(spark, sf):
    return end(b.gold(spark, sf), "evidence_ids")


@query("r2_evidence_lookup", f"WITH {GOLD} SELECT participant_id, evidence, strftime(min(window_end), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS n FROM (SELECT participant_id, window_end, unnest(list_filter(evidence_ids, lambda x: x LIKE 'rest-%')) AS evidence FROM gold) GROUP BY ALL")
def r2(spark, sf):
    rows = b.gold(spark, sf).select("participant_id", "window_end", F.explode(with_prefix(F.col("evidence_ids"), "rest-")).alias("evidence"))
    return rows.groupBy("participant_id", "evidence").agg(text(F.min("window_end")).alias("first_seen"), F.count(F.lit(1)).alias("n"))


@query("r3_missing_reasons_map", f"WITH {GOLD} SELECT field, reason, count(*) AS n FROM (SELECT unnest([{{'f': 'physiological_load', 'r': load_reason}}, {{'f': 'estimated_rest_minutes', 'r': rest_reason}}, {{'f': 'heart_rate_bpm', 'r': CASE WHEN heart_rate_bpm IS NULL THEN 'no_valid_hr_in_window' END}}, {{'f': 'activity_level', 'r': CASE WHEN activity_level IS NULL THEN 'acc_unavailable' END}}, {{'f': 'recovery_score', 'r': CASE WHEN rest_reason IS NOT NULL THEN 'estimated_rest_unavailable' END}}, {{'f': 'rest_hr_check', 'r': CASE WHEN rest_reason IS NULL AND checked < 1 THEN 'hr_baseline_unavailable_for_part_of_night' END}}]) AS m FROM gold), (SELECT 1) WHERE m.r IS NOT NULL GROUP BY m.f, m.r".replace("SELECT field, reason", "SELECT m.f AS field, m.r AS reason"))
def r3(spark, sf):
    reasons = F.from_json("quality_json", state.QUALITY).missing_reasons
    return b.gold(spark, sf).select(F.explode(reasons).alias("field", "reason")).groupBy("field", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("r5_quality_json", f"{_G} status, round(hr_coverage, 4) AS hr_coverage, round(eda_coverage, 4) AS eda_coverage, round(acc_coverage, 4) AS acc_coverage, overnight_coverage FROM gold")
def r5(spark, sf):
    return end(b.gold(spark, sf).withColumn("q", F.from_json("quality_json", state.QUALITY)), "q.status", "q.hr_coverage", "q.eda_coverage", "q.acc_coverage", "q.overnight_coverage")


@query("p12_state_contract_check", f"WITH {GOLD} SELECT participant_id, {st('window_end')} AS window_end, list_filter([CASE WHEN physiological_load > 0.9 THEN 'physiological_load_out_of_range' END, CASE WHEN hour(window_end) = 5 THEN 'bad_status' END, CASE WHEN heart_rate_bpm IS NULL AND hour(window_end) = 5 THEN 'heart_rate_bpm_null_without_reason' END, CASE WHEN physiological_load IS NULL AND hour(window_end) = 5 THEN 'physiological_load_null_without_reason' END, CASE WHEN activity_level IS NULL AND hour(window_end) = 5 THEN 'activity_level_null_without_reason' END, CASE WHEN estimated_rest_minutes IS NULL AND hour(window_end) = 5 THEN 'estimated_rest_minutes_null_without_reason' END, CASE WHEN recovery_score IS NULL AND hour(window_end) = 5 THEN 'recovery_score_null_without_reason' END], lambda x: x IS NOT NULL) AS broken FROM gold WHERE physiological_load > 0.9 OR hour(window_end) = 5")
def p12(spark, sf):
    """States spoiled at five o'clock (their quality replaced) and where the load is very high (moved out of range)."""
    spoiled = b.gold(spark, sf).withColumns({"quality_json": F.when(F.hour("window_end") == 5, F.lit('{"status": "fine"}')).otherwise(F.col("quality_json")), "physiological_load": F.when(F.col("physiological_load") > 0.9, F.col("physiological_load") + 1).otherwise(F.col("physiological_load"))})
    return end(state.state_violations(spoiled), "broken")


@query("a9_status_counts", f"WITH {GOLD} SELECT status, count(*) AS n FROM gold GROUP BY 1")
def a9(spark, sf):
    return readers.status_counts(b.gold(spark, sf))


@query("a10_null_reason_counts", f"WITH {GOLD} SELECT load_reason AS reason, count(*) AS n FROM gold GROUP BY 1")
def a10(spark, sf):
    return readers.null_reasons(b.gold(spark, sf))


@query("a11_rest_by_night", f"WITH {GOLD} SELECT participant_id, night_id, min(estimated_rest_minutes) AS estimated_rest_minutes FROM gold WHERE estimated_rest_minutes IS NOT NULL GROUP BY ALL")
def a11(spark, sf):
    return readers.rest_by_night(b.gold(spark, sf)).drop("run_id")


@query("a17_tail_share", f"WITH {GOLD} SELECT participant_id, count(*) AS n, count(*) FILTER (physiological_load >= 0.1) AS n_high FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY window_end DESC) AS k FROM gold) WHERE k <= 20 GROUP BY 1")
def a17(spark, sf):
    return readers.tail_share(b.gold(spark, sf), 20, 0.1).drop("run_id")


@query("a18_load_quantiles", f"WITH {GOLD} SELECT round(quantile_cont(physiological_load, 0.1), 9) AS q10, round(quantile_cont(physiological_load, 0.5), 9) AS q50, round(quantile_cont(physiological_load, 0.9), 9) AS q90, round(quantile_cont(physiological_load, 0.99), 9) AS q99, round(avg(CASE WHEN physiological_load >= 0.2 THEN 1.0 WHEN physiological_load IS NOT NULL THEN 0.0 END), 9) AS share_high FROM gold")
def a18(spark, sf):
    return readers.load_quantiles(b.gold(spark, sf), [0.1, 0.5, 0.9, 0.99], 0.2).select(*map(r9, ("q10", "q50", "q90", "q99", "share_high")))


@query("a19_processed_time", f"WITH {GOLD}, p AS (SELECT max(ts) AS published FROM events), a AS (SELECT max(as_of) AS processed FROM gold WHERE status <> 'unavailable') SELECT 'run-1' AS run_id, {st('processed')} AS processed, {st('published')} AS published, greatest(CAST(floor(epoch(published)) - floor(epoch(processed)) AS BIGINT), 0) AS lag_s FROM p, a")
def a19(spark, sf):
    df = readers.processed_time(b.gold(spark, sf).filter(q_status() != "unavailable"), b.raw(spark, sf))
    return df.withColumns({c: text(F.col(c)) for c in ("processed", "published")})


@query("j6_latest_state", f"WITH {GOLD} SELECT participant_id, {st('window_end')} AS window_end, physiological_load, recovery_score, status FROM (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY window_end DESC) AS k FROM gold) WHERE k = 1")
def j6(spark, sf):
    return end(readers.latest_state(b.gold(spark, sf)), "physiological_load", "recovery_score", q_status())


@query("k4_latest_one", f"WITH {LAB} SELECT participant_id, signal, eid AS event_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY participant_id, signal ORDER BY source_row DESC) AS k FROM lab) WHERE k = 1")
def k4(spark, sf):
    return quality.keep_last(b.bronze(spark, sf).select("participant_id", "signal", "event_id", "quality", "source_row"), ["participant_id", "signal"], "source_row").drop("source_row")


_CLOCKS = "SELECT participant_id, ts AS clock, event_id FROM ev WHERE event_type = 'signup'"


def clocks(spark, sf):
    return b.raw(spark, sf).filter("signal = 'ibi'").select("run_id", "participant_id", F.col("event_time").alias("clock"), (F.col("source_row") - 1).alias("event_id"))


@query("j5_read_asof_clock", f"WITH {GOLD}, c AS ({_CLOCKS}) SELECT c.participant_id, c.event_id, {st('g.as_of')} AS as_of, g.physiological_load, g.recovery_score FROM c ASOF LEFT JOIN gold g ON c.participant_id = g.participant_id AND c.clock >= g.as_of")
def j5(spark, sf):
    df = readers.state_as_of(b.gold(spark, sf), clocks(spark, sf))
    return df.select("participant_id", "event_id", text(F.col("state.as_of")).alias("as_of"), "state.physiological_load", "state.recovery_score")


@query("k3_history_bounded", f"{_G} physiological_load FROM gold WHERE window_end > TIMESTAMP '2024-01-20 06:00:00' AND window_end <= TIMESTAMP '2024-01-20 12:00:00' ORDER BY window_end, participant_id LIMIT 2000")
def k3(spark, sf):
    at = lambda t: F.lit(t).cast("timestamp")
    return end(readers.history(b.gold(spark, sf), at("2024-01-19 00:00:00"), at("2024-01-21 00:00:00"), at("2024-01-20 12:00:00")), "physiological_load")


@query(
    "a15_baseline_compare",
    f"""WITH {GOLD}, s AS (SELECT participant_id, window_end, physiological_load AS v, window_id, unnest([1200, 3600, 7200]) AS minutes FROM gold WHERE status = 'sufficient')
    SELECT participant_id, minutes, count(v) AS valid, round(avg(v), 9) AS mean, min(v) AS min, max(v) AS max, count(*) FILTER (v >= 0.7) AS n_high, list_slice(list(window_id ORDER BY window_end), -3, -1) AS evidence_ids
    FROM s WHERE window_end <= TIMESTAMP '2024-01-28 00:00:00' AND window_end > TIMESTAMP '2024-01-28 00:00:00' - to_minutes(minutes) GROUP BY ALL""",
)
def a15(spark, sf):
    df = readers.window_compare(b.gold(spark, sf), F.lit("2024-01-28 00:00:00").cast("timestamp"), [1200, 3600, 7200], "physiological_load")
    return df.select("participant_id", "minutes", "valid", r9("mean"), "min", "max", "n_high", "evidence_ids")


# Hourly, sparse data: shorter streaks and lower levels, so that every branch is taken.
RULES = Rules(version="hourly", load=0.05, window=4, at_least=2, recovery=0.5, overnight=0.4, pressure=0.1, cooldown_minutes=360, reset=0.02)
_SUS = "sus AS (SELECT *, count(CASE WHEN status <> 'unavailable' THEN physiological_load END) OVER w = 4 AND count(CASE WHEN status <> 'unavailable' AND physiological_load >= 0.05 THEN 1 END) OVER w >= 2 AS sustained FROM gold WINDOW w AS (PARTITION BY participant_id ORDER BY window_end RANGE BETWEEN INTERVAL 3 HOUR PRECEDING AND CURRENT ROW))"


def with_status(spark, sf):
    q = F.from_json("quality_json", state.QUALITY)
    return b.gold(spark, sf).withColumns({"status": q.status, "overnight_coverage": q.overnight_coverage})


@query("w10_sustained_load", f"WITH {GOLD}, {_SUS} SELECT participant_id, {st('window_end')} AS window_end, sustained FROM sus")
def w10(spark, sf):
    return end(trigger.sustained(with_status(spark, sf), RULES, P.width_s), "sustained")


# Decisions: a recommendation is consumed at every tenth signup of a participant.
_CONSUMED = "consumed AS (SELECT participant_id, ts AS at FROM ev WHERE event_type = 'signup' AND event_id % 10 = 0)"
_ARMED = "arm AS (SELECT s.*, u.at AS used_at, r.window_end AS reset_at, u.at IS NULL OR coalesce(r.window_end > u.at, false) AS armed FROM sus s ASOF LEFT JOIN consumed u ON s.participant_id = u.participant_id AND s.window_end > u.at ASOF LEFT JOIN (SELECT participant_id, window_end FROM gold WHERE physiological_load < 0.02) r ON s.participant_id = r.participant_id AND s.window_end >= r.window_end)"


def consumed(spark, sf):
    return clocks(spark, sf).filter("event_id % 10 = 0").select(*ENTITY, F.col("clock").alias("consumed_at"))


@query("w11_hysteresis_armed", f"WITH {GOLD}, {_SUS}, {_CONSUMED}, {_ARMED} SELECT participant_id, {st('window_end')} AS window_end, armed FROM arm")
def w11(spark, sf):
    return end(trigger.armed(b.gold(spark, sf), consumed(spark, sf), RULES), "armed")


_COOL = "cool AS (SELECT a.*, coalesce(epoch(a.window_end) - floor(epoch(u.at)) < 21600, false) AS cooling FROM arm a ASOF LEFT JOIN consumed u ON a.participant_id = u.participant_id AND a.window_end >= u.at)"


@query("j9_cooldown_join", f"WITH {GOLD}, {_SUS}, {_CONSUMED}, {_ARMED}, {_COOL} SELECT participant_id, {st('window_end')} AS window_end, cooling FROM cool")
def j9(spark, sf):
    applied = consumed(spark, sf).withColumnRenamed("consumed_at", "applied_at")
    return end(trigger.cooldown(b.gold(spark, sf), applied, RULES.cooldown_minutes, ENTITY), "cooling")


def inputs(spark, sf):
    """States with everything that the rules look at. Pressure, flexible blocks and pending jobs come from the entity's own events of the hour."""
    g = trigger.armed(trigger.sustained(with_status(spark, sf), RULES, P.width_s), consumed(spark, sf), RULES)
    g = trigger.cooldown(g, consumed(spark, sf).withColumnRenamed("consumed_at", "applied_at"), RULES.cooldown_minutes, ENTITY)
    e = b.raw(spark, sf).filter("signal = 'temp'").groupBy(*ENTITY, F.date_trunc("hour", "event_time").alias("window_start"))
    e = e.agg(F.round(F.avg("value") / 300, 4).alias("deadline_pressure"), (F.max(F.col("source_row") % 7) > 1).alias("has_flexible"), (F.max(F.col("source_row") % 11) == 10).alias("pending"))
    g = g.join(e, [*ENTITY, "window_start"], "left")
    return g.withColumns({"has_flexible": F.coalesce("has_flexible", F.lit(False)), "pending": F.coalesce("pending", F.lit(False))})


_IN = "tin AS (SELECT participant_id, date_trunc('hour', ts) AS window_start, round(avg(value) / 300, 4) AS deadline_pressure, max(source_row % 7) > 1 AS has_flexible, max(source_row % 11) = 10 AS pending FROM ev WHERE signal = 'temp' GROUP BY ALL)"
_TRIG = f"""WITH {GOLD}, {_SUS}, {_CONSUMED}, {_ARMED}, {_COOL}, {_IN}, tr AS (
  SELECT c.participant_id, c.window_end,
    list_filter([CASE WHEN sustained THEN 'SUSTAINED_LOAD' END, CASE WHEN overnight_coverage >= 0.4 AND recovery_score < 0.5 THEN 'LIMITED_ESTIMATED_REST' END, CASE WHEN deadline_pressure >= 0.1 THEN 'HIGH_PRESSURE' END], lambda x: x IS NOT NULL) AS reason_codes,
    list_filter([CASE WHEN recovery_score IS NULL THEN 'RECOVERY_UNKNOWN' WHEN overnight_coverage IS NULL OR overnight_coverage < 0.4 THEN 'INSUFFICIENT_OVERNIGHT_EVIDENCE' END,
      CASE WHEN baseline_id IS NULL OR baseline_cutoff IS NULL OR baseline_cutoff > as_of THEN 'INSUFFICIENT_BASELINE' END, CASE WHEN status <> 'sufficient' THEN 'INSUFFICIENT_DATA' END, CASE WHEN activity_confound THEN 'ACTIVITY_CONFOUND' END,
      CASE WHEN NOT coalesce(has_flexible, false) THEN 'NO_FLEXIBLE_BLOCK' END, CASE WHEN coalesce(pending, false) THEN 'PENDING_DECISION' END, CASE WHEN cooling THEN 'COOLDOWN' END, CASE WHEN NOT armed THEN 'AWAITING_RESET' END], lambda x: x IS NOT NULL) AS suppressed
  FROM cool c LEFT JOIN tin t ON c.participant_id = t.participant_id AND c.window_start = t.window_start)"""


@query("g1_trigger_eval", f"{_TRIG} SELECT participant_id, {st('window_end')} AS window_end, reason_codes, suppressed, len(reason_codes) = 3 AND len(suppressed) = 0 AS fire FROM tr")
def g1(spark, sf):
    return end(trigger.evaluate(inputs(spark, sf), RULES), "reason_codes", "suppressed", "fire")


@query("g2_compose_state", f"{_TRIG}, c2 AS ({_CLOCKS}) SELECT c.participant_id, c.event_id, {st('t.window_end')} AS as_of, coalesce(t.reason_codes, []) AS reason_codes, CASE WHEN t.window_end IS NULL OR epoch(c.clock) - epoch(t.window_end) > 3000 THEN list_append(coalesce(t.suppressed, []), 'STALE_STATE') ELSE t.suppressed END AS suppressed FROM c2 c ASOF LEFT JOIN tr t ON c.participant_id = t.participant_id AND c.clock >= t.window_end")
def g2(spark, sf):
    """What a reader at each clock gets: the newest state that it may know, judged, with STALE_STATE where it is old."""
    judged = trigger.evaluate(inputs(spark, sf), RULES)
    df = readers.as_of(clocks(spark, sf), judged, ENTITY, "clock", "window_end", ["window_end", "reason_codes", "suppressed"], "s")
    none = F.array().cast("array<string>")
    stale = F.col("s").isNull() | (F.unix_micros("clock") - F.unix_micros("s.window_end") > 3_000_000_000)
    supp = F.coalesce("s.suppressed", none)
    return df.select("participant_id", "event_id", text(F.col("s.window_end")).alias("as_of"), F.coalesce("s.reason_codes", none).alias("reason_codes"), F.when(stale, F.array_append(supp, "STALE_STATE")).otherwise(supp).alias("suppressed"))


@query("g3_staleness", f"WITH {GOLD}, a AS (SELECT participant_id, as_of, as_of + to_seconds(CAST((epoch(as_of) // 3600) % 7 * 200 AS BIGINT)) AS arrived FROM gold WHERE status <> 'unavailable'), l AS (SELECT *, CAST(epoch(arrived) - epoch(lag(arrived) OVER w) AS BIGINT) AS idle_s, CAST(greatest(epoch(arrived) - epoch(lag(as_of) OVER w), 0) AS BIGINT) AS behind_s FROM a WINDOW w AS (PARTITION BY participant_id ORDER BY arrived)) SELECT participant_id, {st('as_of')} AS as_of, idle_s, CASE WHEN idle_s IS NOT NULL THEN behind_s ELSE 0 END AS behind_s, coalesce(idle_s > 3600 AND behind_s > 4500, false) AS stale FROM l")
def g3(spark, sf):
    hours = F.floor(F.unix_seconds("as_of") / 3600)
    a = b.gold(spark, sf).filter(q_status() != "unavailable").select(*ENTITY, "as_of", F.timestamp_seconds(F.unix_seconds("as_of") + hours % 7 * 200).alias("arrived"))
    return readers.staleness(a, 3600, 4500).select("participant_id", text(F.col("as_of")).alias("as_of"), "idle_s", "behind_s", "stale")


@query("t9_history_cap", f"WITH {SILVER}, c AS (SELECT participant_id, ws, (SELECT max(ws) FROM silver) AS last FROM silver) SELECT participant_id, {st('ws')} AS window_start FROM c WHERE ws > last - INTERVAL 72 HOUR")
def t9(spark, sf):
    s = b.silver(spark, sf)
    return start(profile.history_cap(s, "window_start", 72))
