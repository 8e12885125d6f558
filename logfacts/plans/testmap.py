"""The star-schema tables in the shape of the log tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfacts.functions.classify import Rules

RULES = Rules(marker="probe")
#: A fixed moment inside the data, the end of windows that look back.
NOW = 1706313600


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Request log rows from the events table; a range of whole seconds is told to the scan, which skips row groups by it."""
    events = read(spark, sf_dir, "events")
    moment = lambda s: F.timestamp_seconds(F.lit(s)).cast(events.schema["ts"].dataType)
    events = events.where(F.col("ts") >= moment(since)) if since is not None else events
    return as_logs(events.where(F.col("ts") < moment(until)) if until is not None else events)


def as_logs(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    k, failed = F.col("k"), F.col("event_type") == "error"
    probe = k % 19 == 0
    text = F.concat(F.lit("status_code="), (400 + 100 * (k % 2) + k).cast("string"), F.when(k % 13 == 0, " Timeout").otherwise(""))
    other = F.concat(F.lit('{"frt":'), (k * 150).cast("string"), F.lit(',"stream_status":{"end_reason":"'), F.when(k % 23 == 0, "timeout").otherwise(""), F.lit('","error_count":0}}'))
    kind = F.when(failed, 5).when(F.col("event_type") == "signup", 6).otherwise(2)
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("created_at"), kind.cast("int").alias("type"),
        F.floor(F.col("value") * 1000).cast("long").alias("quota"), (k % 10).alias("channel_id"), F.when(k % 7 == 6, "text-Embed-6").otherwise(F.concat(F.lit("model-"), (k % 7).cast("string"))).alias("model_name"),
        F.concat(F.lit("grp-"), (F.col("user_id") % 5).cast("string")).alias("grp"), (F.col("user_id") * 10 + k % 3).alias("token_id"), (k * 10).alias("prompt_tokens"),
        F.when(k % 11 == 0, 0).otherwise(k * 3).cast("long").alias("completion_tokens"), (k % 90).alias("use_time"), F.when(failed, text).when(probe, "probe").otherwise("").alias("content"),
        F.when(probe, "probe").otherwise(F.concat(F.lit("tok-"), (k % 3).cast("string"))).alias("token_name"), F.concat(F.lit("req-"), F.col("event_id").cast("string")).alias("request_id"),
        F.when(k % 29 == 0, F.lit(None).cast("string")).otherwise(other).alias("other"), "k")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channel dimension from the suppliers."""
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(key.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("vendor-"), (key % 3).cast("string")).alias("vendor"), F.when(key % 4 == 3, 2).otherwise(1).alias("status"),
                    F.when(key % 5 == 0, 1704844800).otherwise(0).cast("long").alias("enabled_since"), F.concat(F.lit("domain-"), (key % 4).cast("string"), F.lit(".test")).alias("base_domain"))


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected requests per minute, from signups."""
    rows = logs(spark, sf_dir).where("type = 6")
    return rows.select((F.col("created_at") - F.col("created_at") % 60).alias("bucket_ts"), F.concat(F.lit("node-"), (F.col("k") % 2).cast("string")).alias("node"),
                       F.concat(F.lit("reason-"), (F.col("k") % 4).cast("string")).alias("reason"), F.col("model_name").alias("model"), "grp", F.lit(1).cast("long").alias("count"))


#: The same views for DuckDB; queries begin with one of them and go on after a comma or with SELECT.
LOGS = r"""WITH ev AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
logs AS (SELECT event_id AS id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, CASE event_type WHEN 'error' THEN 5 WHEN 'signup' THEN 6 ELSE 2 END AS type,
  CAST(floor(value * 1000) AS BIGINT) AS quota, k % 10 AS channel_id, CASE WHEN k % 7 = 6 THEN 'text-Embed-6' ELSE 'model-' || (k % 7) END AS model_name, 'grp-' || (user_id % 5) AS grp,
  user_id * 10 + k % 3 AS token_id, k * 10 AS prompt_tokens, CASE WHEN k % 11 = 0 THEN 0 ELSE k * 3 END AS completion_tokens, k % 90 AS use_time,
  CASE WHEN k % 29 = 0 THEN 0 ELSE k * 150 END AS frt, k % 23 = 0 AND k % 29 <> 0 AS stream_bad,
  CASE WHEN event_type = 'error' THEN 'status_code=' || (400 + 100 * (k % 2) + k) || CASE WHEN k % 13 = 0 THEN ' Timeout' ELSE '' END WHEN k % 19 = 0 THEN 'probe' ELSE '' END AS content,
  CASE WHEN k % 19 = 0 THEN 'probe' ELSE 'tok-' || (k % 3) END AS token_name, 'req-' || event_id AS request_id, k FROM ev)"""
TRAFFIC = LOGS + r""",
traffic AS (SELECT * REPLACE (stream_bad AND NOT zero AS stream_bad), CASE WHEN type = 5 THEN 'failed' WHEN zero OR stream_bad THEN 'anomaly' ELSE 'success' END AS outcome,
  CASE WHEN type = 5 THEN CASE WHEN lower(content) LIKE '%timeout%' THEN 'timeout' WHEN content LIKE '%status_code=4%' THEN '4xx' WHEN content LIKE '%status_code=5%' THEN '5xx' ELSE 'other' END END AS error_kind
  FROM (SELECT *, completion_tokens = 0 AND NOT regexp_matches(lower(model_name), 'embed|rerank|bge-|m3e|image|seedream|seedance') AS zero FROM logs
    WHERE type IN (2, 5) AND NOT (type = 2 AND token_name = 'probe' AND content = 'probe')))"""


def _n(cond: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {cond}) AS BIGINT)"


def _s(value: str, cond: str) -> str:
    return f"CAST(coalesce(sum({value}) FILTER (WHERE {cond}), 0) AS BIGINT)"


def _m(value: str, cond: str) -> str:
    return f"CAST(coalesce(max({value}) FILTER (WHERE {cond}), 0) AS BIGINT)"


MEASURES = {
    "success": _n("outcome = 'success'"), "anomaly": _n("outcome = 'anomaly'"), "failed": _n("type = 5"), "anomaly_billed": _n("type = 2 AND zero AND prompt_tokens > 0"),
    "anomaly_free": _n("type = 2 AND zero AND prompt_tokens = 0"), "anomaly_stream": _n("type = 2 AND stream_bad"), "anomaly_quota": _s("quota", "type = 2 AND zero AND prompt_tokens > 0"),
    "anomaly_sum_time": _s("use_time", "outcome = 'anomaly'"), "sum_use_time": _s("use_time", "type = 2"), "max_use_time": _m("use_time", "type = 2"),
    "tokens": _s("prompt_tokens + completion_tokens", "type = 2"), "quota": _s("quota", "type = 2"), **{f"err_{k}": _n(f"error_kind = '{k}'") for k in ("4xx", "5xx", "timeout", "other")},
    "lat_1": _n("type = 2 AND use_time <= 1"), "lat_2": _n("type = 2 AND use_time > 1 AND use_time <= 2"), "lat_5": _n("type = 2 AND use_time > 2 AND use_time <= 5"), "lat_10": _n("type = 2 AND use_time > 5 AND use_time <= 10"),
    "lat_30": _n("type = 2 AND use_time > 10 AND use_time <= 30"), "lat_60": _n("type = 2 AND use_time > 30 AND use_time <= 60"), "lat_inf": _n("type = 2 AND use_time > 60"), "completion_tokens": _s("completion_tokens", "type = 2"),
    "ttft_500": _n("type = 2 AND frt > 0 AND frt <= 500"), "ttft_1k": _n("type = 2 AND frt > 500 AND frt <= 1000"), "ttft_2k": _n("type = 2 AND frt > 1000 AND frt <= 2000"), "ttft_5k": _n("type = 2 AND frt > 2000 AND frt <= 5000"),
    "ttft_10k": _n("type = 2 AND frt > 5000 AND frt <= 10000"), "ttft_inf": _n("type = 2 AND frt > 10000"), "ttft_max_ms": _m("frt", "type = 2 AND frt > 0"),
}


def measures_sql(*names: str) -> str:
    return ", ".join(f"{MEASURES[n]} AS {n}" for n in names or MEASURES)


MINUTES = TRAFFIC + f""",
minutes AS (SELECT created_at // 60 * 60 AS bucket_ts, channel_id, model_name, grp, {measures_sql()} FROM traffic GROUP BY ALL)"""
USAGE = LOGS + """,
usage AS (SELECT created_at // 3600 * 3600 AS hour_ts, user_id, channel_id, grp, model_name, token_id, max(token_name) AS token_name, CAST(count(*) FILTER (WHERE type = 2) AS BIGINT) AS requests,
  CAST(count(*) FILTER (WHERE type = 6) AS BIGINT) AS refund_records, CAST(coalesce(sum(prompt_tokens) FILTER (WHERE type = 2), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens) FILTER (WHERE type = 2), 0) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(quota) FILTER (WHERE type = 2), 0) AS BIGINT) AS consume_quota,
  CAST(coalesce(sum(quota) FILTER (WHERE type = 6), 0) AS BIGINT) AS refund_quota FROM logs WHERE type IN (2, 6) AND NOT (type = 2 AND token_name = 'probe' AND content = 'probe') GROUP BY ALL)"""
CHANNELS = """channels AS (SELECT s_suppkey AS id, s_name AS name, 'vendor-' || (s_suppkey % 3) AS vendor, CASE WHEN s_suppkey % 4 = 3 THEN 2 ELSE 1 END AS status,
  CASE WHEN s_suppkey % 5 = 0 THEN 1704844800 ELSE 0 END AS enabled_since, 'domain-' || (s_suppkey % 4) || '.test' AS base_domain FROM supplier)"""
REJECTIONS = """rejections AS (SELECT created_at // 60 * 60 AS bucket_ts, 'node-' || (k % 2) AS node, 'reason-' || (k % 4) AS reason, model_name AS model, grp, 1 AS count FROM logs WHERE type = 6)"""


def percentile_sql(bins: list[str], edges: tuple[int, ...], largest: str, p: float) -> str:
    """The interpolated percentile of a histogram, as nested CASE over running sums."""
    whole = " + ".join(bins)
    target, out, before, lower = f"({p / 100!r} * ({whole}))", "", "0", "0.0"
    for i, b in enumerate(bins):
        upper = f"{float(edges[i])!r}" if i < len(edges) else f"greatest(CAST({largest} AS DOUBLE), {lower})"
        inside = f"{lower} + ({target} - ({before})) / nullif(CAST({b} AS DOUBLE), 0) * ({upper} - {lower})"
        out += f" WHEN ({before}) + {b} >= {target} THEN CASE WHEN {b} = 0 THEN {upper} ELSE {inside} END"
        before, lower = f"{before} + {b}", upper
    return f"CASE WHEN ({whole}) = 0 THEN 0.0{out} ELSE {lower} END"
