"""Error signatures: redacted texts, their counts per minute, and the report over a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.sources.tables import kept


def signatures(errors: DataFrame, source: str = "log") -> DataFrame:
    """Error rows (created_at, channel_id, model_name, grp, content) to counts per minute and signature."""
    text = S.redacted(F.coalesce("content", F.lit("")))
    rows = errors.withColumns({"full": text, "bucket_ts": S.bucket("created_at", 60), "source": F.lit(source)})
    rows = rows.withColumns({"message": F.substring("full", 1, S.MOST_CHARACTERS), "truncated": F.length("full") > S.MOST_CHARACTERS})
    rows = rows.withColumns({"signature_hash": S.signature(F.col("source"), F.col("message")), "code": F.regexp_extract("message", S.STATUS_CODE, 1)})
    # the hash stands for source and message, so texts are no keys; a text cut off and one of just that length may share it
    return rows.groupBy("bucket_ts", "source", "signature_hash", "truncated", "channel_id", "model_name", "grp").agg(
        *_texts(), F.count("*").alias("count"), F.min("created_at").alias("first_ts"), F.max("created_at").alias("last_ts"))


def _texts() -> list[Column]:
    return [F.any_value(c).alias(c) for c in ("code", "message")]


def of_rejections(rejections: DataFrame) -> DataFrame:
    """Rejection reasons as signatures."""
    rows = rejections.withColumns({"source": F.lit("reject"), "message": F.col("reason"), "code": F.lit(""), "truncated": F.lit(False), "channel_id": F.lit(None).cast("long")})
    rows = rows.withColumn("signature_hash", S.signature(F.col("source"), F.col("message")))
    return rows.groupBy("bucket_ts", "source", "signature_hash", "truncated", "channel_id", F.col("model").alias("model_name"), "grp").agg(
        *_texts(), F.sum("count").alias("count"), F.min("bucket_ts").alias("first_ts"), F.max("bucket_ts").alias("last_ts"))


def report(minutes: DataFrame, since: int, until: int) -> DataFrame:
    """Signatures of a range with where they occur, and their share of all that was captured."""
    rows = minutes.where((F.col("bucket_ts") >= since) & (F.col("bucket_ts") < until))
    text = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",")
    by = rows.groupBy("source", "signature_hash").agg(*_texts(), F.sum("count").alias("count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), text("grp").alias("groups"), text("channel_id").alias("channels"), text("model_name").alias("models"))
    by = kept(by)  # a row a signature; read twice
    return by.crossJoin(F.broadcast(by.agg(F.sum("count").alias("total")))).withColumn("share", S.rate(F.col("count"), F.col("total"))).drop("total")


def error_rows(logs: DataFrame) -> DataFrame:
    """Error rows as ``signatures`` reads them."""
    return logs.where(F.col("type") == C.ERROR).select("id", "created_at", "channel_id", "model_name", "grp", "content")


def minute_coverage(minutes: DataFrame) -> DataFrame:
    """(minutes, rows, newest) of the signatures taken in; one row."""
    return minutes.agg(F.countDistinct("bucket_ts").alias("minutes"), F.sum("count").alias("rows"), F.max("last_ts").alias("newest"))
