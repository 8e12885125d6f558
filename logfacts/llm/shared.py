"""Where operators keep tables between jobs, the folder that all machines of the cluster share, and joins on hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a job whose rows are in a table are of no further use.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, on one machine only, a fresh temporary one that is then set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: ends the lineage, survives lost executors."""
    return cut_by(df, None, [None])[0]


def cut_by(df: DataFrame, column: str | None, values: list) -> list[DataFrame]:
    """The rows of each value of a column, which itself is left out, as tables of their own that one job has written."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(column) if column else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    reader = spark.read.schema(df.drop(column).schema if column else df.schema)
    paths = [f"{path}/{column}={v}" if column else path for v in values]
    for x in paths:  # a value without rows has no folder
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return [reader.parquet(x) for x in paths]


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written, once all that was made from them is in tables of its own."""
    for df in tables:
        spark = df.sparkSession
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_counted(rows: DataFrame, unique: DataFrame, key: str, count: str, tell: list[str], most: int = 100_000) -> DataFrame:
    """rows joined on ``key`` with the one row a key of ``unique``, whose ``count`` is the number of rows with that key.

    A key of more than ``most`` rows (or a hundred-thousandth of them all) is dealt into several by the columns in
    ``tell``, and its row of ``unique`` is given out once for each. So there are at most 100,000 such keys to broadcast.
    """
    most = max(most, rows.count() // 100_000)
    ways = F.ceil(F.col(count) / most).cast("int")
    hot = unique.where(F.col(count) > most).select(key, ways.alias("ways_"))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("way_", F.coalesce(F.pmod(F.xxhash64(*tell), F.col("ways_")).cast("int"), F.lit(0))).drop("ways_")
    right = unique.withColumn("way_", F.explode(F.sequence(F.lit(0), ways - 1))).drop(count)
    return left.join(right, [key, "way_"]).drop("way_")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
