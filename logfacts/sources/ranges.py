"""Replacing a range of a partitioned fact table as a whole: stage, check, swap, mark complete.

The fresh rows are written beside the table, read back and held against control totals that were taken by another path.
Only if every partition of the range agrees are they swapped in, and only after that does the ledger say complete. Before
the swap the ledger says running, so a job that dies in between leaves a range that no reader takes for complete, and
running it again mends it. A mismatch leaves the old rows and the old ledger as they were.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logfacts.operators.rollup import differences


class ControlMismatch(ValueError):
    """The staged rows do not have the totals that they should have."""

    def __init__(self, found: list) -> None:
        super().__init__(f"totals differ in {len(found)} partitions or more: {found}")
        self.found = found


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def totals(rows: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *(c.alias(n) for n, c in measures.items()))


def ledger(spark: SparkSession, path: str, by: str) -> DataFrame:
    """(by, status, rows, totals, version) of every partition that was ever marked."""
    return spark.read.parquet(f"{path}/ledger").withColumn(by, F.col(by).cast("long"))


def facts(spark: SparkSession, path: str, by: str, complete_only: bool = True) -> DataFrame:
    """The table's rows, of complete partitions unless all are asked for."""
    rows = spark.read.parquet(f"{path}/facts").withColumn(by, F.col(by).cast("long"))
    return rows.join(ledger(spark, path, by).where("status = 'complete'").select(by), by, "left_semi") if complete_only else rows


def _mark(marks: DataFrame, path: str, by: str) -> None:
    marks.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/ledger")  # a row a partition


def replace_range(rows: DataFrame, controls: DataFrame, path: str, by: str, since: int, until: int, step: int, measures: dict[str, Column], version: int) -> DataFrame:
    """Puts ``rows`` in place of the partitions ``by`` in [since, until); the ledger's rows of the range.

    ``controls`` has ``by`` and a total for each of ``measures``, from a path of its own; a partition without a control must
    have no rows (a control of zero). Partitions of the range without rows become empty and complete. Rows outside the
    range raise, as do totals that differ: ControlMismatch, and nothing has changed.
    """
    spark, staged, names = rows.sparkSession, f"{path}/staged-{uuid.uuid4().hex}", list(measures)
    try:
        # dealt by partition, so that each is a file or a few; a large one is split at runtime
        rows.hint("rebalance", by).write.partitionBy(by).parquet(staged)
        schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        fresh = spark.read.schema(schema).parquet(staged)
        found = totals(fresh, by, measures)
        inside = (F.col(by) >= since) & (F.col(by) < until) & (F.pmod(F.col(by) - since, F.lit(step)) == 0)
        wrong = differences(found, controls.where(inside), [by], names).take(20)
        if wrong or found.where(~inside).limit(1).count():
            raise ControlMismatch(wrong)
        steps = spark.range(since, until, step).withColumnRenamed("id", by)
        marks = steps.join(found, by, "left").fillna(0, ["rows", *names]).withColumns({"version": F.lit(version), "status": F.lit("running")})
        marks = spark.createDataFrame(marks.collect(), marks.schema)  # one row a partition of the range, as the staged rows go
        _mark(marks, path, by)
        for empty in (r[by] for r in marks.where("rows = 0").select(by).collect()):
            _delete(spark, f"{path}/facts/{by}={empty}")
        fresh.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/facts")
        done = marks.withColumn("status", F.lit("complete"))
        _mark(done, path, by)
        return done
    finally:
        _delete(spark, staged)
