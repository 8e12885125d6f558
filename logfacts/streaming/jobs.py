"""Ingest as streams: minute facts with late rows replaced, finalised hours, batches once, alerts with cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logfacts.functions import classify as C
from logfacts.operators.rollup import measures


def minute_stream(logs: DataFrame, rules: C.Rules = C.Rules(), delay: str = "4 minutes") -> DataFrame:
    """Minute facts of a stream of log rows with an event time ``at``; a minute is put out again when late rows change it."""
    return _minutes(C.classified(logs.withWatermark("at", delay), rules))


def final_minutes(logs: DataFrame, rules: C.Rules = C.Rules(), delay: str = "10 minutes") -> DataFrame:
    """The same for append mode: a minute is put out once, when the newest user traffic is ``delay`` past its end; rows of it
    that come after that are dropped (``rollup.repaired`` takes them in)."""
    return _minutes(C.classified(logs, rules).withWatermark("at", delay))


def _minutes(rows: DataFrame) -> DataFrame:
    m = measures()
    names = ("success", "anomaly", "failed", "tokens", "quota", "max_use_time")
    out = rows.groupBy(F.window("at", "1 minute"), "model_name").agg(*(m[n].alias(n) for n in names))
    return out.select(F.unix_timestamp("window.start").alias("bucket_ts"), "model_name", *names)


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is final to a table; Spark's file sink lists what each micro-batch wrote, so none counts twice."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keyed_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch to a folder of its own, so a replayed batch replaces itself; read with latest_of."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of(table: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that several batches wrote, those of the last one."""
    values = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def once(batches: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Each batch of a stream once, however often it is pushed."""
    return batches.withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def fired_stream(events: DataFrame, cooldown: dict[str, int], default: int = 1800) -> DataFrame:
    """(kind, target, ts) of a stream to those that are sent; state is the time of each target's last one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        sent = []
        for ts in sorted(t for f in frames for t in f["ts"]):
            if last is None or ts - last >= cooldown.get(key[0], default):
                sent.append(ts)
                last = ts
        if last is not None:
            state.update((int(last),))
        yield pd.DataFrame({"kind": [key[0]] * len(sent), "target": [key[1]] * len(sent), "ts": sent})

    return events.groupBy("kind", "target").applyInPandasWithState(run, "kind string, target string, ts long", "last long", "append", GroupStateTimeout.NoTimeout)
