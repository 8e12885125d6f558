"""Streams with state: the health of edge sources, which changes by silence too, and requests matched with their outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logfacts.operators.edge import BAD_AGE, LOSS_WINDOW, MOST_BACKLOG, MOST_LAG, WARN_AGE

#: What a batch tells of its source, and what is kept of it. Times are seconds; a null backlog is unknown.
TELEMETRY = "at long, last_event_ts long, backlog_bytes long, last_cursor_discontinuity_at long, last_discarded_at long"
CHANGE = "node string, at long, state string, reasons string"
FIELDS = ("at", "last_event_ts", "backlog_bytes", "last_cursor_discontinuity_at", "last_discarded_at")


def health_at(told: dict, now: int) -> tuple[str, list[str]]:
    """The state of a source and its reasons at a moment, by what it told last."""
    age, backlog = now - told["at"], told["backlog_bytes"] or 0
    recent = lambda c: (told[c] or 0) > 0 and now - told[c] <= LOSS_WINDOW
    found = {
        "heartbeat_stale": age > WARN_AGE, "backlog_large": backlog >= MOST_BACKLOG, "event_lag_with_backlog": backlog > 0 and (told["last_event_ts"] or 0) > 0 and now - told["last_event_ts"] > MOST_LAG,
        "recent_cursor_discontinuity": recent("last_cursor_discontinuity_at"), "recent_discarded_lines": recent("last_discarded_at"),
    }
    reasons = [name for name, is_so in found.items() if is_so]
    return ("bad" if age > BAD_AGE else "warn" if reasons else "ok"), reasons


def moments(told: dict, after: int) -> list[int]:
    """When after a moment the state may change if nothing more is heard."""
    out = [told["at"] + WARN_AGE + 1, told["at"] + BAD_AGE + 1]
    if told["backlog_bytes"]:
        out.append((told["last_event_ts"] or 0) + MOST_LAG + 1)
    out += [told[c] + LOSS_WINDOW + 1 for c in ("last_cursor_discontinuity_at", "last_discarded_at") if told[c]]
    return sorted({m for m in out if m > after})


def merged(told: dict | None, row: dict) -> dict:
    """What is known after a further batch: latest times, and the backlog of the later batch."""
    if told is None:
        return row
    later = row if row["at"] >= told["at"] else told
    most = lambda c: max(told[c] or 0, row[c] or 0)
    return {"at": later["at"], "backlog_bytes": later["backlog_bytes"], **{c: most(c) for c in FIELDS if c not in ("at", "backlog_bytes")}}


class SourceHealth(StatefulProcessor):
    """Keeps one row and one timer a node, and gives out each change of its state at the moment that it happens."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", TELEMETRY)
        self.shown = handle.getValueState("shown", "at long, text string")

    def _load(self) -> tuple[dict | None, tuple[int, str]]:
        value = self.told.get() if self.told.exists() else None
        told = {c: None if v is None or pd.isna(v) else int(v) for c, v in zip(FIELDS, value, strict=True)} if value is not None else None
        shown = self.shown.get() if self.shown.exists() else (0, "")
        return told, (int(shown[0]), shown[1])

    def _save(self, told: dict, shown: tuple[int, str]) -> None:
        self.told.update(tuple(told[c] for c in FIELDS))
        self.shown.update(shown)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        ahead = moments(told, shown[0])
        if ahead:
            self.handle.registerTimer(1000 * ahead[0])

    @staticmethod
    def _step(told: dict, now: int, shown: tuple[int, str], out: list) -> tuple[int, str]:
        state, reasons = health_at(told, now)
        text = f"{state}/{','.join(reasons)}"
        if text != shown[1]:
            out.append((now, state, ",".join(reasons)))
        return now, text

    @staticmethod
    def _frame(node: str, out: list) -> pd.DataFrame:
        at, state, reasons = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"node": [node] * len(out), "at": pd.array(at, "int64"), "state": list(state), "reasons": list(reasons)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        told, shown = self._load()
        out: list = []
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        for values in frame[list(FIELDS)].itertuples(index=False):
            row = {c: None if pd.isna(v) else int(v) for c, v in zip(FIELDS, values, strict=True)}
            if told is not None:
                for moment in moments(told, shown[0]):  # what silence changed before this row
                    if moment < row["at"]:
                        shown = self._step(told, moment, shown, out)
            told = merged(told, row)
            shown = self._step(told, max(told["at"], shown[0]), shown, out)
        self._save(told, shown)
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        told, shown = self._load()
        out: list = []
        fired, passed = expiredTimerInfo.getExpiryTimeInMs() // 1000, timerValues.getCurrentWatermarkInMs() // 1000
        if told is not None and fired > shown[0]:
            for now in moments(told, shown[0]):  # this one, and later ones that the watermark has passed too
                if now <= max(fired, passed):
                    shown = self._step(told, now, shown, out)
            self._save(told, shown)
        yield self._frame(key[0], out)


def source_changes(batches: DataFrame, delay: str = "1 minute") -> DataFrame:
    """(node, at, state, reasons) whenever a node's state changes, by a batch or by the lack of one.

    ``batches`` is a stream with ``node`` and the columns of TELEMETRY. Time is that of the batches: a timer fires when
    the newest batch of all nodes is ``delay`` past it. Needs the RocksDB state store, which ``start_changes`` sets.
    """
    rows = batches.withColumn("seen", F.timestamp_seconds("at")).withWatermark("seen", delay)
    return rows.groupBy("node").transformWithStateInPandas(statefulProcessor=SourceHealth(), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime")


def start_changes(batches: DataFrame, path: str, checkpoint: str, delay: str = "1 minute") -> StreamingQuery:
    """Writes the changes to a table; the session's state store is set for as long as the query starts."""
    conf, key = batches.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer = source_changes(batches, delay).writeStream.outputMode("append").format("parquet")
        return writer.option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def matched(starts: DataFrame, outcomes: DataFrame, horizon: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(trace, logical, started, outcome, ended): each start with its outcomes within ``horizon``, as two streams meet.

    A start without an outcome and an outcome without a start (an orphan) come with nulls once the watermark has passed the
    time at which their other half could still come. ``starts`` have trace, logical, at; ``outcomes`` trace, outcome, at.
    """
    a = starts.select(F.col("trace").alias("s_trace"), "logical", F.col("at").alias("started")).withWatermark("started", delay)
    b = outcomes.select(F.col("trace").alias("o_trace"), "outcome", F.col("at").alias("ended")).withWatermark("ended", delay)
    meets = F.expr(f"s_trace = o_trace AND ended >= started AND ended <= started + INTERVAL {horizon}")
    return a.join(b, meets, "full_outer").select(F.coalesce("s_trace", "o_trace").alias("trace"), "logical", "started", "outcome", "ended")
