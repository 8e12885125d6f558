"""Pushed batches as a stream, each counted once: an inbox with a ledger, replays without effect, conflicts in quarantine.

Every micro-batch becomes one folder ``epoch=N`` of the inbox, written by one job: its envelopes, each with what was
decided about it (``status``). Spark's commit of that job is the mark that the epoch is complete, and readers see
complete epochs only. A micro-batch that is run again after a failure overwrites its own folder with the same rows,
as it looks at earlier epochs alone. So nothing is counted twice and nothing is lost, whatever fails when.

Each micro-batch reads the keys and hashes of those accepted before, two columns of all epochs that are kept; deleting the
folders of epochs that are older than any replay bounds that, and the facts are to be merged out of them before.

An envelope is told by its keys (a node and its batch id). The first payload of a key counts; the same payload again is a
duplicate, another payload under the same key is a conflict and is kept aside whole. Payloads are compared by
a hash that does not depend on the order of their samples.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logfacts.functions import scalars as S

ACCEPTED, DUPLICATE, CONFLICT = "accepted", "duplicate", "conflict"


@dataclass(frozen=True)
class Inbox:
    """Where batches of one kind are kept, and how they are told apart."""

    path: str
    fields: tuple[str, ...]  # of a sample
    keys: tuple[str, ...] = ("node", "batch_id")
    samples: str = "samples"
    order: str = "received_at"


def complete_epochs(spark: SparkSession, inbox: Inbox, before: int | None = None) -> list[int]:
    """Numbers of the epochs whose job has been committed: one number a micro-batch, no rows."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{inbox.path}/epoch=*/_SUCCESS")
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(root) or []
    numbers = sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)
    return [n for n in numbers if before is None or n < before]


def envelopes(spark: SparkSession, inbox: Inbox, schema: str, before: int | None = None) -> DataFrame:
    """All envelopes of complete epochs with ``payload_hash``, ``status`` and ``epoch``."""
    paths = [f"{inbox.path}/epoch={n}" for n in complete_epochs(spark, inbox, before)]
    whole = f"{schema}, payload_hash string, status string, epoch int"
    if not paths:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", inbox.path).parquet(*paths)


def decided(batch: DataFrame, known: DataFrame, inbox: Inbox) -> DataFrame:
    """The envelopes with their hash and status; ``known`` has the keys and payload_hash of those accepted before.

    Within a micro-batch the payload received first counts, and of equal times the smaller hash, so a replay decides alike.
    """
    keys = list(inbox.keys)
    rows = batch.withColumn("payload_hash", S.multiset_hash(F.col(inbox.samples), list(inbox.fields)))
    w = Window.partitionBy(*keys).orderBy(inbox.order, "payload_hash")  # rows that are equal in both are copies
    before = known.groupBy(*keys).agg(F.any_value("payload_hash").alias("known_hash"))
    rows = rows.withColumns({"nth": F.row_number().over(w), "first_hash": F.first("payload_hash").over(w)}).join(before, keys, "left")
    right = F.col("payload_hash") == F.coalesce("known_hash", "first_hash")
    status = F.when(~right, CONFLICT).when(F.col("known_hash").isNull() & (F.col("nth") == 1), ACCEPTED).otherwise(DUPLICATE)
    return rows.withColumn("status", status).select(*batch.columns, "payload_hash", "status")


def receive(batch: DataFrame, number: int, inbox: Inbox) -> None:
    """One micro-batch into its epoch's folder."""
    spark, schema = batch.sparkSession, ", ".join(f"{c} {t}" for c, t in batch.dtypes)
    known = envelopes(spark, inbox, schema, before=number).where(F.col("status") == ACCEPTED).select(*inbox.keys, "payload_hash")
    decided(batch, known, inbox).write.mode("overwrite").parquet(f"{inbox.path}/epoch={number}")


def start(stream: DataFrame, inbox: Inbox, checkpoint: str) -> StreamingQuery:
    """Takes in all that the stream has and ends."""
    write = lambda batch, number: receive(batch, number, inbox)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accepted_samples(spark: SparkSession, inbox: Inbox, schema: str) -> DataFrame:
    """Samples of all accepted envelopes, with their keys; to be merged additively."""
    rows = envelopes(spark, inbox, schema).where(F.col("status") == ACCEPTED)
    return rows.select(*inbox.keys, F.explode(inbox.samples).alias("s")).select(*inbox.keys, "s.*")


def told(spark: SparkSession, inbox: Inbox, schema: str) -> DataFrame:
    """(keys, accepted, duplicates, conflicts) of every key that was ever pushed."""
    n = lambda status: F.count_if(F.col("status") == status)
    return envelopes(spark, inbox, schema).groupBy(*inbox.keys).agg(n(ACCEPTED).alias("accepted"), n(DUPLICATE).alias("duplicates"), n(CONFLICT).alias("conflicts"))
