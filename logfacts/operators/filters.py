"""Which facts count: enabled channels, selectable pairs, versions, visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enabled(facts: DataFrame, channels: DataFrame) -> DataFrame:
    """Without facts of a channel that is off, or of a time before it was switched on; unknown channels stay."""
    c = channels.select(F.col("id").alias("channel_id"), "status", "enabled_since")
    off = (facts["channel_id"] == c["channel_id"]) & ((c["status"] != 1) | (facts["bucket_ts"] < c["enabled_since"]))
    return facts.join(c, off, "left_anti")


def selectable(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts of the selectable (grp, model) pairs; all of them if there are no pairs."""
    listed = pairs.select("grp", F.col("model").alias("model_name")).distinct().withColumn("listed", F.lit(True))
    any_pair = pairs.agg((F.count("*") > 0).alias("some"))
    return facts.join(listed, ["grp", "model_name"], "left").crossJoin(F.broadcast(any_pair)).where("listed or not some").drop("listed", "some")


def effective(facts: DataFrame, proven_hours: DataFrame, version: int = 5) -> DataFrame:
    """Of each hour one version only: the current one if the hour is signed for it or has no other, else the older rows."""
    signed = proven_hours.where((F.col("status") == "complete") & (F.col("traffic_class_version") == version)).select("hour_ts").distinct().withColumn("signed", F.lit(True))
    older = facts.where(F.col("traffic_class_version") != version).select("hour_ts").distinct().withColumn("older", F.lit(True))
    current = F.col("signed").isNotNull() | F.col("older").isNull()
    rows = facts.join(signed, "hour_ts", "left").join(older, "hour_ts", "left")
    return rows.where(F.when(current, F.col("traffic_class_version") == version).otherwise(F.col("traffic_class_version") != version)).drop("signed", "older")


def of_vendor(rows: DataFrame, channels: DataFrame, vendor: str | None) -> DataFrame:
    """Rows of the channels of one vendor; all rows if none is asked for."""
    if not vendor:
        return rows
    return rows.join(channels.where(F.col("vendor") == vendor).select(F.col("id").alias("channel_id")), "channel_id", "left_semi")


def in_scope(rows: DataFrame, since: int, until: int, time: str = "hour_ts", **equal: object) -> DataFrame:
    """Half-open range of time and equality on the given columns; None asks for nothing."""
    rows = rows.where((F.col(time) >= since) & (F.col(time) < until))
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def visible(facts: DataFrame, published: DataFrame, time: str = "hour_ts") -> DataFrame:
    """Facts of published members from their floor on; everything if no member is published."""
    p = published.groupBy("user_id").agg(F.min("source_floor_hour").alias("floor"))
    some = published.agg((F.count("*") > 0).alias("some"))
    return facts.join(p, "user_id", "left").crossJoin(F.broadcast(some)).where(~F.col("some") | (F.col(time) >= F.col("floor"))).drop("floor", "some")


def fact_view(day_facts: DataFrame, hour_facts: DataFrame, day_proofs: DataFrame, until: int | None = None) -> DataFrame:
    """Day facts, and hour facts of the member-days that no day proof or day fact stands for.

    With ``until`` only what is before it counts, and a day stands for its hours only if it ends by then: of the day that
    ``until`` lies in the hours before it are shown, as a whole day's row would tell of hours to come.
    """
    from logfacts.functions.scalars import DAY, ZONE, day

    if until is not None:
        full = (until + ZONE) // DAY * DAY - ZONE
        day_facts, day_proofs, hour_facts = day_facts.where(F.col("date_ts") < full), day_proofs.where(F.col("date_ts") < full), hour_facts.where(F.col("hour_ts") < until)
    done = day_proofs.select("user_id", "date_ts").union(day_facts.select("user_id", "date_ts")).distinct()
    open_hours = hour_facts.withColumn("date_ts", day("hour_ts")).join(done, ["user_id", "date_ts"], "left_anti")
    columns = [c for c in day_facts.columns]
    return day_facts.unionByName(open_hours.select(columns))
