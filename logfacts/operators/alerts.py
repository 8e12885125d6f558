"""Alert rules, their categories, and the cooldown between alerts of one target."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(cost_usd: float = 5.0, least: int = 5, rate: float = 8.0) -> Column:
    """One rule per row: money first, then rate, then bursts; nothing for too few anomalies."""
    few = F.col("anomaly") < least
    return F.when(F.col("anomaly_cost_usd") >= cost_usd, "anomaly_billed").when(few, "").when(F.col("anomaly_rate") >= rate, "anomaly_rate").when(F.coalesce("burst", F.lit(False)), "anomaly_burst").otherwise("")


def error_rule(least: int = 5, rate: float = 20.0, burst: int = 10) -> Column:
    """A burst of errors first; a rate counts from ``least`` failed requests on."""
    return F.when(F.col("failed") >= burst, "error_burst").when((F.col("failed") >= least) & (F.col("error_rate") >= rate), "error_rate").otherwise("")


def category(kind: Column) -> Column:
    return F.when(kind.startswith("infra_"), "infra").when(kind.startswith("anomaly_"), "anomaly").when(kind.startswith("upstream_balance"), "balance").otherwise("model")


def fired(events: DataFrame, cooldown: dict[str, int], default: int = 1800) -> DataFrame:
    """(kind, target, ts) to those that are sent: the first, and each next one after the cooldown since the last that was sent.

    A scan in order of time with one number of state per target, whatever the number of events.
    """
    import pyarrow as pa

    parts = events.select("kind", "target", "ts").repartition("kind", "target").sortWithinPartitions("kind", "target", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keep = []
            for kind, target, ts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (kind, target) != key:
                    key, last = (kind, target), None
                send = last is None or ts - last >= cooldown.get(kind, default)
                last = ts if send else last
                keep.append(send)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return parts.mapInArrow(run, "kind string, target string, ts long")
