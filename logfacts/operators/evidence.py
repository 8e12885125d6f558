"""Delivery evidence of clients: starts and outcomes of requests, retries, conflicts, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfacts.functions import scalars as S

#: The outcomes that clients report.
OUTCOMES = ("succeeded", "client_timeout", "transport_failure", "protocol_failure", "semantic_failure", "user_cancelled")


#: The version of events, the time around now that is accepted, and the longest texts in bytes.
EVENT_VERSION, DAYS_BACK_MS, AHEAD_MS = 1, 370 * 86_400_000, 600_000
MOST_BYTES = {"event_id": 128, "client_version": 64, "error_signature": 96, "request_id": 256, "logical_key": 256, "protocol": 48, "model": 128}
MOST_RETRIES = 100


def _token(name: str) -> Column:
    return F.col(name).rlike(r"\A[A-Za-z0-9._:-]{1,%d}\z" % MOST_BYTES[name])


def _plain(name: str, text: Column | None = None) -> Column:
    """Not too long, and on one line."""
    text = F.coalesce(F.col(name) if text is None else text, F.lit(""))
    return (F.octet_length(text) <= MOST_BYTES[name]) & ~text.rlike("[\r\n\\x00]")


def _trimmed(name: str) -> Column:
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"\A\s+|\s+\z", "")


def faults(now_ms: int) -> Column:
    """The rules that an event breaks, in their order: envelope, time, request, start, outcome, metadata, logical.

    Columns: version, event_id, event_type, occurred_at_ms, request_id, logical_key, client_version, outcome,
    error_signature, retry, protocol, model. A null text is a blank; a null number is wrong.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    kind, outcome = F.col("event_type"), text("outcome")
    right = {
        "envelope": (F.col("version") == EVENT_VERSION) & _token("event_id") & kind.isin("request_started", "request_outcome") & _token("client_version") & F.col("retry").between(0, MOST_RETRIES),
        "time": F.col("occurred_at_ms").between(now_ms - DAYS_BACK_MS, now_ms + AHEAD_MS),
        "request": (_trimmed("request_id") != "") & _plain("request_id", _trimmed("request_id")),
        "start": (kind != "request_started") | (outcome == "") & (text("error_signature") == ""),
        "outcome": (kind != "request_outcome") | outcome.isin(*OUTCOMES),
        "metadata": ((text("error_signature") == "") | _token("error_signature")) & _plain("protocol") & _plain("model"),
        "logical": _plain("logical_key", _trimmed("logical_key")),
    }
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in right.items())))


def valid(now_ms: int) -> Column:
    """Whether a stored event, which has pseudonyms in place of its ids, is of a known type and outcome and of a plausible time."""
    kind, outcome = F.col("event_type"), F.col("outcome")
    right = (kind == "request_started") & outcome.isNull() | (kind == "request_outcome") & outcome.isin(*OUTCOMES)
    return F.coalesce(right & F.col("occurred_at_ms").between(now_ms - DAYS_BACK_MS, now_ms + AHEAD_MS) & F.col("trace").rlike(r"\A[A-Za-z0-9._:-]{1,128}\z"), F.lit(False))


def split(events: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Pushed events that are accepted, and those that are not with their first fault as ``reason``."""
    told = events.withColumn("faults_", faults(now_ms))
    return told.where("size(faults_) = 0").drop("faults_"), told.where("size(faults_) > 0").withColumn("reason", F.col("faults_")[0]).drop("faults_")


def starts(events: DataFrame) -> DataFrame:
    rows = events.where("event_type = 'request_started'")
    return rows.groupBy("trace").agg(F.max("logical").alias("logical"), F.max("retry").alias("retry"), F.min("occurred_at_ms").alias("started_ms"))


def outcomes(events: DataFrame) -> DataFrame:
    """Per started request the kinds of its outcomes; several kinds are a conflict."""
    done = events.where("event_type = 'request_outcome'").groupBy("trace").agg(
        F.countDistinct("outcome").alias("kinds"), F.max((F.col("outcome") == "succeeded").cast("int")).alias("ok"), F.max((F.col("outcome") == "user_cancelled").cast("int")).alias("cancelled"))
    return starts(events).join(done, "trace", "left")


def cohort(events: DataFrame, least: int = 20) -> DataFrame:
    """Coverage and success of the started requests; sufficient with enough of them started and clear, 95 % covered, no conflict and no orphan."""
    rows = outcomes(events)
    clear = (F.col("kinds") == 1) & (F.col("cancelled") == 0)
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    sums = rows.agg(F.count("*").alias("started"), n(F.col("kinds").isNotNull()).alias("reported"), n(F.col("kinds") > 1).alias("conflicts"), n(F.col("cancelled") == 1).alias("cancelled"), n(clear).alias("judged"), n(clear & (F.col("ok") == 1)).alias("succeeded"))
    return sums.withColumns({"coverage": S.rate_or_null(F.col("reported"), F.col("started")), "success_rate": S.rate_or_null(F.col("succeeded"), F.col("judged"))}).crossJoin(orphans(events).select(F.col("events").alias("orphans"))).withColumn(
        "sufficient", (F.col("started") >= least) & (F.col("judged") >= least) & F.coalesce(F.col("coverage") >= 95, F.lit(False)) & (F.col("conflicts") == 0) & (F.col("orphans") == 0))  # one row each


def orphans(events: DataFrame) -> DataFrame:
    """Outcomes without any start."""
    known = events.where("event_type = 'request_started'").select("trace").distinct()
    return events.where("event_type = 'request_outcome'").join(known, "trace", "left_anti").agg(F.count("*").alias("events"), F.countDistinct("trace").alias("traces"))


def retries(events: DataFrame) -> DataFrame:
    """Per logical request its attempts, whether it was tried again, and whether any attempt succeeded."""
    return outcomes(events).groupBy("logical").agg(F.count("*").alias("attempts"), (F.count("*") > 1).alias("retried"), F.coalesce(F.max("ok") == 1, F.lit(False)).alias("eventually"))


def first_outcomes(events: DataFrame) -> DataFrame:
    """The first outcome of each logical request that is no cancellation."""
    w = Window.partitionBy("logical").orderBy("retry", "occurred_at_ms", "event_id")
    rows = events.where("event_type = 'request_outcome' and outcome <> 'user_cancelled'")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("logical", "trace", "outcome")


def latest_failures(events: DataFrame, most: int = 100) -> DataFrame:
    """The latest outcomes that are neither a success nor a cancellation."""
    rows = events.where("event_type = 'request_outcome' and outcome not in ('succeeded', 'user_cancelled')")
    return rows.orderBy(F.desc("occurred_at_ms"), F.desc("event_id")).limit(most)


def timeline(events: DataFrame, logical: str) -> DataFrame:
    """All events of one request, in their order."""
    return events.where(F.col("logical") == logical).orderBy("occurred_at_ms", "event_id")
