"""Writing and merging tables: replace by key or range, additive merge, retention, idempotent batches, CSV export."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A fresh place in spark.checkpoint.dir; where that is unset, in a temporary folder, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """The same rows read back from a table of the shared folder, for what several jobs or parts of a plan read."""
    path = shared_folder(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Writes rows in place of the partitions that they belong to; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_all(rows: DataFrame, path: str) -> None:
    """A small derived table in place of what was there, in one go."""
    rows.write.mode("overwrite").parquet(path)


def replace_by_key(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows win over existing ones of the same key."""
    return existing.join(fresh.select(keys).distinct(), keys, "left_anti").unionByName(fresh)


def merge_additive(existing: DataFrame, delta: DataFrame, keys: list[str], added: list[str], largest: list[str] = (), least: list[str] = (), flags: list[str] = ()) -> DataFrame:  # type: ignore[assignment]
    """Counts add up, extremes and flags combine."""
    aggs = [F.sum(c).alias(c) for c in added] + [F.max(c).alias(c) for c in largest] + [F.min(c).alias(c) for c in least] + [F.bool_or(c).alias(c) for c in flags]
    return existing.unionByName(delta).groupBy(*keys).agg(*aggs)


def retained(rows: DataFrame, time: str, cutoff: int) -> DataFrame:
    return rows.where(F.col(time) >= cutoff)


def clean_rejections(rows: DataFrame) -> DataFrame:
    """Complete rows only, to the minute, texts cut to their longest."""
    text = lambda c, n: F.substring(F.trim(c), 1, n).alias(c)
    rows = rows.where("bucket_ts > 0 and count > 0 and reason <> '' and model <> ''")
    return rows.select((F.col("bucket_ts") - F.col("bucket_ts") % 60).alias("bucket_ts"), "node", text("reason", 64), text("model", 128), text("grp", 64), "count")


def batches(envelopes: DataFrame, keys: list[str], payload: Column) -> DataFrame:
    """(keys, copies, conflict): how often a batch came, and whether with different payloads."""
    h = F.xxhash64(payload)
    return envelopes.groupBy(*keys).agg(F.count("*").alias("copies"), (F.min(h) != F.max(h)).alias("conflict"))


def export_csv(rows: DataFrame, path: str, max_id: int, most: int = 50000) -> None:
    """Newest first within a snapshot, one file with a header."""
    rows.where(F.col("id") <= max_id).orderBy(F.desc("id")).limit(most).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")
