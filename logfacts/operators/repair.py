"""Stored hour facts, by business day: taken in, repaired and re-classified from raw rows, a range of days at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators import rollup
from logfacts.sources import ranges

def measures() -> dict:
    requests = F.col("success") + F.col("anomaly") + F.col("failed")
    return {"requests": F.sum(requests), "tokens": F.sum("tokens"), "quota": F.sum("quota")}


def day_rows(logs: DataFrame, rules: C.Rules = C.Rules()) -> DataFrame:
    """Hour facts with the business day that they are stored under."""
    return rollup.direct_hours(logs, rules)[0].withColumn("date_ts", S.day("hour_ts"))


def day_controls(logs: DataFrame, rules: C.Rules = C.Rules()) -> DataFrame:
    """(date_ts, requests, tokens, quota) of user traffic, by the controls' own path."""
    rows = rollup.hour_controls(logs, rules).groupBy(S.day("hour_ts").alias("date_ts"))
    return rows.agg(*(F.sum(f"user_{m}").alias(m) for m in ("requests", "tokens", "quota")))


def repair_days(logs: DataFrame, path: str, since: int, until: int, rules: C.Rules = C.Rules(), version: int = C.VERSION) -> DataFrame:
    """Takes the days in [since, until) anew from raw rows, late ones included, and replaces their partitions alone.

    Only raw rows of these days are read. Other days keep their files. With another ``version`` this is the
    re-classification of a range; days that were not redone keep the version in the ledger that they were made under.
    """
    inside = logs.where((F.col("created_at") >= since) & (F.col("created_at") < until))
    return ranges.replace_range(day_rows(inside, rules), day_controls(inside, rules), path, "date_ts", since, until, S.DAY, measures(), version)
