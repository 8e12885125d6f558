"""Edge access logs: parsing, minute aggregates, reports, health of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.functions import scalars as S

SCHEMA = ", ".join(f"{c} string" for c in ("ts", "msec", "method", "request_method", "uri", "path", "status", "request_time", "upstream_status", "upstream_response_time", "bytes_sent", "request_id"))
MOST_LINE_BYTES = 64 << 10
MOST_SENT = 16 << 30
DAY_MS = 86_400_000


def parse(lines: DataFrame, node: str = "node") -> DataFrame:
    """(node, line) to one row per valid line; the last attempt counts for upstream figures.

    A line is left out if it is too long or no JSON, has no time or an odd status, time or size, or a chain of attempts
    in which one is no number. Without attempts the upstream status is 0 and its time null.
    """
    number = lambda c: S.first_number(F.col(f"j.{c}"))
    named = lambda a, b: F.coalesce(F.when(F.col(f"j.{a}") != "", F.col(f"j.{a}")), F.col(f"j.{b}"))
    attempts = lambda c, none: F.when(S.has_attempts(F.col(f"j.{c}")), S.last_number(F.col(f"j.{c}"))).otherwise(none)
    values = [
        F.when(number("ts") > 0, number("ts")).otherwise(number("msec")).alias("at"), S.method(named("method", "request_method")).alias("method"), S.route(named("path", "uri")).alias("route"), number("status").alias("status"),
        number("request_time").alias("seconds"), attempts("upstream_status", F.lit(0.0)).alias("upstream_status"), S.has_attempts(F.col("j.upstream_response_time")).alias("timed"), attempts("upstream_response_time", F.lit(0.0)).alias("upstream_seconds"),
        number("bytes_sent").alias("bytes_sent"), (~F.trim(F.coalesce("j.request_id", F.lit(""))).isin("", "-")).alias("has_id")]
    # a line that is too long is parsed as none, which has no time: a filter here would be pushed to where lines are made, and make each twice
    short = F.when(F.octet_length("line") <= MOST_LINE_BYTES, F.col("line"))
    parsed = lines.select(node, F.from_json(short, SCHEMA, {"mode": "PERMISSIVE"}).alias("j"))
    # exploding one struct keeps the rules below from being pushed into the scan, where each would make its values, and parse the line, anew
    rows = parsed.select(node, F.explode(F.array(F.struct(*values))).alias("v")).select(node, "v.*")
    status = lambda c: (F.col(c) == F.floor(c)) & F.col(c).between(100, 599)
    sound = (F.col("at") > 0) & status("status") & ((F.col("upstream_status") == 0) | status("upstream_status")) & F.col("seconds").between(0, 86400) & F.col("upstream_seconds").between(0, 86400) & F.col("bytes_sent").between(0, MOST_SENT)
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return rows.where(sound).select(
        node, "at", "method", "route", F.col("status").cast("int").alias("status"), ms("seconds").alias("ms"), F.col("upstream_status").cast("int").alias("upstream_status"),
        F.when(F.col("timed"), ms("upstream_seconds")).alias("upstream_ms"), F.col("bytes_sent").cast("long").alias("bytes_sent"), "has_id")


def minutes(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("bucket_ts", F.floor(F.col("at") / 60) * 60)
    return rows.groupBy("bucket_ts", "node", "route", "method", "status", "upstream_status").agg(
        F.count("*").alias("count"), F.coalesce(F.sum("ms"), F.lit(0)).alias("time_sum_ms"), F.coalesce(F.max("ms"), F.lit(0)).alias("time_max_ms"), F.coalesce(F.sum("upstream_ms"), F.lit(0)).alias("upstream_sum_ms"),
        F.count("upstream_ms").alias("upstream_count"), F.sum("bytes_sent").alias("bytes_sent"), F.count_if("has_id").alias("with_id"))


def report(facts: DataFrame, *keys: str) -> DataFrame:
    """Status classes, times, bytes and id coverage by the given keys."""
    n = F.sum("count")
    classes = [F.coalesce(F.sum(F.when(F.floor(F.col("status") / 100) == c, F.col("count"))), F.lit(0)).alias(f"n_{c}xx") for c in (2, 3, 4, 5)]
    return facts.groupBy(*keys).agg(n.alias("requests"), *classes, (F.sum("time_sum_ms") / n).alias("avg_ms"), F.max("time_max_ms").alias("max_ms"), F.sum("bytes_sent").alias("bytes"), S.rate(F.sum("with_id"), n).alias("id_coverage"))


MOST_ROWS = 50


def by_day(facts: DataFrame) -> DataFrame:
    """The report by business day."""
    return report(facts.withColumn("date_ts", S.day("bucket_ts")), "date_ts")


def breakdown(facts: DataFrame, key: str, most: int = MOST_ROWS) -> DataFrame:
    """(name, requests, n_4xx, n_5xx, avg_ms) of the routes or nodes with the most requests; equal ones by name."""
    return report(facts, key).orderBy(F.desc("requests"), key).limit(most).select(F.col(key).alias("name"), "requests", "n_4xx", "n_5xx", "avg_ms")


def valid_sample(now: int, retention_days: int = 7) -> Column:
    """Minutes inside the time that is kept, with counts, times and sizes that are possible and fit each other."""
    c = {k: F.col(k) for k in ("count", "status", "upstream_status", "time_sum_ms", "time_max_ms", "upstream_sum_ms", "upstream_count", "bytes_sent", "with_id")}
    minute = F.floor(F.col("bucket_ts") / 60) * 60
    in_time = (minute > 0) & minute.between(now - (max(retention_days, 1) + 1) * 86400, now + 300)
    codes = c["status"].between(100, 599) & ((c["upstream_status"] == 0) | c["upstream_status"].between(100, 599)) & c["count"].between(1, 10_000_000)
    times = c["time_max_ms"].between(0, DAY_MS) & c["time_sum_ms"].between(c["time_max_ms"], c["count"] * DAY_MS)
    upstream = c["upstream_count"].between(0, c["count"]) & c["upstream_sum_ms"].between(0, c["upstream_count"] * DAY_MS)
    rest = c["bytes_sent"].between(0, c["count"] * MOST_SENT) & c["with_id"].between(0, c["count"])
    return F.coalesce(in_time & codes & times & upstream & rest, F.lit(False))


#: Seconds without ingest until a warning and until a source is bad, of lag behind a backlog, of memory for lost lines; bytes of backlog.
WARN_AGE, BAD_AGE, MOST_LAG, LOSS_WINDOW, MOST_BACKLOG = 180, 900, 180, 900, 16 << 20


def source_health(states: DataFrame, now: int) -> DataFrame:
    """ok, warn or bad of each node with all reasons; an unknown backlog (null) is none."""
    since = lambda c: F.greatest(F.lit(now) - F.col(c), F.lit(0))
    age, backlog = since("last_ingest_ts"), F.coalesce("backlog_bytes", F.lit(0))
    recent = lambda c: F.coalesce((F.col(c) > 0) & (F.lit(now) - F.col(c) <= LOSS_WINDOW), F.lit(False))
    found = {
        "heartbeat_stale": age > WARN_AGE, "backlog_large": backlog >= MOST_BACKLOG, "event_lag_with_backlog": (backlog > 0) & (F.col("last_event_ts") > 0) & (since("last_event_ts") > MOST_LAG),
        "recent_cursor_discontinuity": recent("last_cursor_discontinuity_at"), "recent_discarded_lines": recent("last_discarded_at"),
    }
    reasons = F.array_compact(F.array(*(F.when(c, name) for name, c in found.items())))
    state = F.when(age > BAD_AGE, "bad").when(F.size(reasons) > 0, "warn").otherwise("ok")
    return states.select("node", age.alias("age"), state.alias("state"), F.array_join(reasons, ",").alias("reasons"))
