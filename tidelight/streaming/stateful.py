"""Per-entity state with a clock of each entity's own: windows and decisions that a lagging entity loses no row of.

Spark's watermark is one for the whole stream, so an entity that sends late loses what another's clock has passed. Here
each entity's newest event is its clock, kept in its state (RocksDB), and only that decides what is out. Event-time timers
look at the stream's watermark: they release what an entity holds back once it has been silent for long, and forget
cooldowns that have run out. The column with the watermark itself goes before the state, as rows late by it were dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..config import ENTITY, Params, Rules

#: What the state needs of a session; run_available() takes it.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SECOND = 1_000_000

WINDOWS = "run_id string, participant_id string, start bigint, n bigint, total double, min double, max double"


class EntityWindows(StatefulProcessor):
    """Sums of one entity's open windows, by start. Times are microseconds."""

    def __init__(self, width: int, delay: int, patience: int | None):
        self.width, self.delay, self.patience = width, delay, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "newest bigint, out bigint")
        self.open = handle.getMapState("open", "start bigint", "n bigint, total double, min double, max double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest, out = self.clock.get() if self.clock.exists() else (None, None)
        for frame in rows:
            at = frame["micros"].to_numpy()
            newest = max(int(at.max()), newest) if newest is not None else int(at.max())
            start = at // self.width * self.width
            some = frame.assign(start=start)[(start + self.width > out) if out is not None else slice(None)]
            for s, x in some.groupby("start")["v"]:
                n, total, low, high = self.open.getValue((int(s),)) or (0, 0.0, None, None)
                v = x.dropna()
                if len(v):
                    low, high = (float(v.min()), float(v.max())) if low is None else (min(low, float(v.min())), max(high, float(v.max())))
                self.open.updateValue((int(s),), (n + len(v), total + float(v.sum()), low, high))
        yield from self.closed(key, newest, newest - self.delay if out is None else max(out, newest - self.delay))
        if self.patience is not None:
            self.handle.registerTimer((newest + self.patience) // 1000 + 1)

    def closed(self, key: tuple, newest: int, out: int) -> Iterator[pd.DataFrame]:
        done = sorted((s, *v) for (s,), v in self.open.iterator() if s + self.width <= out)
        for s, *_ in done:
            self.open.removeKey((s,))
        self.clock.update((newest, out))
        if done:
            frame = pd.DataFrame(done, columns=["start", "n", "total", "min", "max"])
            yield frame.assign(run_id=key[0], participant_id=key[1])[["run_id", "participant_id", "start", "n", "total", "min", "max"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, out = self.clock.get()
        if expiredTimerInfo.getExpiryTimeInMs() > (newest + self.patience) // 1000:  # nothing came since
            yield from self.closed(key, newest, max(out, newest // self.width * self.width + self.width))

    def close(self) -> None:
        pass


def entity_windows(events: DataFrame, p: Params, delay_s: int = 120, patience_s: int | None = None) -> DataFrame:
    """Scalar window features of a stream of events (ENTITY, event_time, v). A window comes out once, when its entity's newest
    event is the delay past its end; events of that entity for windows that are out are dropped. With patience, an entity
    that is silent while the stream's watermark passes its newest event by so much has its last windows out as well."""
    rows = events.withWatermark("event_time", f"{delay_s} seconds").select(*ENTITY, F.unix_micros("event_time").alias("micros"), "v")
    processor = EntityWindows(p.width_s * SECOND, delay_s * SECOND, None if patience_s is None else patience_s * SECOND)
    out = rows.groupBy(*ENTITY).transformWithStateInPandas(processor, WINDOWS, "append", "eventTime")
    return out.select(*ENTITY, F.timestamp_micros("start").alias("window_start"), F.timestamp_micros(F.col("start") + p.width_s * SECOND).alias("window_end"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("mean"), "min", "max", "n")


DECIDED = "run_id string, participant_id string, at bigint, load double, armed boolean, cooling boolean"
LOAD, CONSUMED = 1, 2


class Decisions(StatefulProcessor):
    """One entity's hysteresis and cooldown. Marks wait until the entity's clock has passed them, so that their order in
    time counts and not their order of arrival; loads come before consumptions of the same time."""

    def __init__(self, reset: float, cooldown: int, delay: int, patience: int | None):
        self.reset, self.cooldown, self.delay, self.patience = reset, cooldown, delay, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mode = handle.getValueState("mode", "armed boolean, used bigint, newest bigint, out bigint")
        self.waiting = handle.getListState("waiting", "at bigint, kind int, load double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        armed, used, newest, out = self.mode.get() if self.mode.exists() else (True, None, None, None)
        new = [(int(a), int(k), None if pd.isna(v) else float(v)) for f in rows for a, k, v in zip(f["micros"], f["kind"], f["load"], strict=True)]
        newest = max(a for a, _, _ in [*new, (newest if newest is not None else new[0][0], 0, None)])
        marks = [*self.waiting.get(), *(m for m in new if out is None or m[0] >= out)]
        limit = newest - self.delay if out is None else max(out, newest - self.delay)
        yield from self.decided(key, (armed, used, newest, limit), marks)
        if self.patience is not None:
            self.handle.registerTimer((newest + self.patience) // 1000 + 1)

    def decided(self, key: tuple, mode: tuple, marks: list[tuple]) -> Iterator[pd.DataFrame]:
        """Takes marks before the limit into the mode; the others wait."""
        armed, used, newest, out = mode
        told, ripe = [], sorted((m for m in marks if m[0] < out), key=lambda m: m[:2])
        uses = {a for a, kind, _ in ripe if kind == CONSUMED}
        for at, kind, load in ripe:
            if kind == CONSUMED:
                armed, used = False, at
                self.handle.registerTimer((at + self.cooldown + self.delay) // 1000 + 1)
                continue
            armed = armed or (load is not None and load < self.reset)
            last = at if at in uses else used
            told.append((*key, at, load, armed, last is not None and at // SECOND - last // SECOND < self.cooldown // SECOND))
        self.mode.update((armed, used, newest, out))
        self.waiting.put([m for m in marks if m[0] >= out])
        if told:
            yield pd.DataFrame(told, columns=["run_id", "participant_id", "at", "load", "armed", "cooling"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        armed, used, newest, out = self.mode.get()
        if self.patience is not None and expiredTimerInfo.getExpiryTimeInMs() > (newest + self.patience) // 1000:
            out = max(out, newest + 1)  # nothing came since: what waits is taken
            yield from self.decided(key, (armed, used, newest, out), list(self.waiting.get()))
            armed, used, newest, out = self.mode.get()
        if used is not None and out >= used + self.cooldown:  # by the entity's own clock
            self.mode.update((armed, None, newest, out))

    def close(self) -> None:
        pass


def decisions(marks: DataFrame, rules: Rules, delay_s: int = 0, patience_s: int | None = None) -> DataFrame:
    """Of each load: whether its entity is armed (until a recommendation is consumed, and again from the first load under the
    reset level) and cooling (less than the cooldown after the last consumption, one of its own time included). marks has
    ENTITY, at, kind (1 load, 2 consumed) and load. A load comes out when its entity's newest mark is more than the delay
    past it; marks that come later than that are dropped. Results don't depend on how the marks are cut into batches."""
    rows = marks.withWatermark("at", f"{delay_s} seconds").select(*ENTITY, F.unix_micros("at").alias("micros"), "kind", "load")
    processor = Decisions(rules.reset, rules.cooldown_minutes * 60 * SECOND, delay_s * SECOND, None if patience_s is None else patience_s * SECOND)
    out = rows.groupBy(*ENTITY).transformWithStateInPandas(processor, DECIDED, "append", "eventTime")
    return out.select(*ENTITY, F.timestamp_micros("at").alias("window_end"), "load", "armed", "cooling")
