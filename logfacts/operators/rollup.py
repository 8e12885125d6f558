"""Raw rows to minute, hour and day facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def sum_if(cond: Column, value: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(value) if isinstance(value, str) else value)), F.lit(0)).cast("long")


def max_if(cond: Column, value: Column | str) -> Column:
    return F.coalesce(F.max(F.when(cond, F.col(value) if isinstance(value, str) else value)), F.lit(0)).cast("long")


def _bins(value: str, edges: tuple[int, ...], names: tuple[str, ...], cond: Column) -> dict[str, Column]:
    out, low = {}, None
    for name, high in zip(names, (*edges, None), strict=True):
        inside = cond if low is None else cond & (F.col(value) > low)
        out[name] = count_if(inside if high is None else inside & (F.col(value) <= high))
        low = high
    return out


def measures() -> dict[str, Column]:
    """The measures of a group of classified rows."""
    paid, failed = F.col("type") == C.CONSUME, F.col("type") == C.ERROR
    anomaly, zero = F.col("outcome") == "anomaly", F.col("zero") & paid
    m = {"success": count_if(F.col("outcome") == "success"), "anomaly": count_if(anomaly), "failed": count_if(failed)}
    m |= {"anomaly_billed": count_if(zero & (F.col("prompt_tokens") > 0)), "anomaly_free": count_if(zero & (F.col("prompt_tokens") == 0)), "anomaly_stream": count_if(paid & F.col("stream_bad"))}
    m |= {"anomaly_quota": sum_if(zero & (F.col("prompt_tokens") > 0), "quota"), "anomaly_sum_time": sum_if(anomaly, "use_time")}
    m |= {"sum_use_time": sum_if(paid, "use_time"), "max_use_time": max_if(paid, "use_time"), "tokens": sum_if(paid, F.col("prompt_tokens") + F.col("completion_tokens")), "quota": sum_if(paid, "quota")}
    m |= {f"err_{k}": count_if(F.col("error_kind") == k) for k in ("4xx", "5xx", "timeout", "other")}
    m |= _bins("use_time", S.LATENCY_EDGES, S.LATENCY, paid)
    m |= {"completion_tokens": sum_if(paid, "completion_tokens")}
    m |= _bins("frt", S.TTFT_EDGES, S.TTFT, paid & (F.col("frt") > 0))
    return m | {"ttft_max_ms": max_if(paid & (F.col("frt") > 0), "frt")}


ADDED = ("success", "anomaly", "failed", "anomaly_billed", "anomaly_free", "anomaly_stream", "anomaly_quota", "anomaly_sum_time", "sum_use_time", "tokens", "quota",
         "err_4xx", "err_5xx", "err_timeout", "err_other", *S.LATENCY, "completion_tokens", *S.TTFT)
LARGEST = ("max_use_time", "ttft_max_ms")


def again(columns: tuple[str, ...] | list[str]) -> list[Column]:
    """The same measures from partial ones: sums of sums, largest of largest."""
    return [(F.max(c) if c in LARGEST else F.sum(c)).alias(c) for c in columns]


def minutes(logs: DataFrame, rules: C.Rules = C.Rules()) -> DataFrame:
    """A row for each minute, channel, model and group."""
    rows = C.classified(logs, rules).withColumn("bucket_ts", S.bucket("created_at", 60))
    return rows.groupBy("bucket_ts", "channel_id", "model_name", "grp").agg(*(c.alias(n) for n, c in measures().items())).withColumn("traffic_class_version", F.lit(C.VERSION))


def token_minutes(logs: DataFrame, rules: C.Rules = C.Rules()) -> DataFrame:
    rows = C.classified(logs, rules).withColumns({"bucket_ts": S.bucket("created_at", 60), "token_name": F.coalesce("token_name", F.lit(""))})
    m = measures()
    return rows.groupBy("bucket_ts", "token_name").agg(*(m[n].alias(n) for n in ("success", "anomaly", "failed", "tokens", "quota")))


def site_hours(minute_facts: DataFrame) -> DataFrame:
    return minute_facts.groupBy(S.bucket("bucket_ts", 3600).alias("hour_ts")).agg(*again(("success", "anomaly", "failed", "tokens", "quota", "sum_use_time")))


HOUR_MEASURES = (*ADDED[:11], "max_use_time", *ADDED[11:15])


def stability_hours(minute_facts: DataFrame, proven_hours: DataFrame | None = None) -> DataFrame:
    """Hour facts of the minutes; hours that are proven already are left alone."""
    rows = minute_facts.withColumn("hour_ts", S.bucket("bucket_ts", 3600))
    if proven_hours is not None:
        rows = rows.join(proven_hours.select("hour_ts").distinct(), "hour_ts", "left_anti")
    return rows.groupBy("hour_ts", "channel_id", "model_name", "grp").agg(*again(HOUR_MEASURES))


def direct_hours(logs: DataFrame, rules: C.Rules = C.Rules()) -> tuple[DataFrame, DataFrame]:
    """User facts and internal-test facts per hour, straight from raw rows."""
    m = measures()
    user = C.classified(logs, rules).withColumn("hour_ts", S.bucket("created_at", 3600)).groupBy("hour_ts", "channel_id", "model_name", "grp").agg(*(m[n].alias(n) for n in HOUR_MEASURES))
    tests = C.with_details(logs.where(F.col("type").isin(C.CONSUME, C.ERROR) & C.is_test(rules))).withColumns({**C.test_labels(rules), "hour_ts": S.bucket("created_at", 3600)})
    paid = F.col("type") == C.CONSUME
    tests = tests.groupBy("hour_ts", "channel_id", "model_name", "grp", "origin", "scope", "cost_basis").agg(
        F.count("*").alias("requests"), *(count_if(F.col("result") == r).alias(r) for r in ("success", "anomaly", "failed")),
        sum_if(paid, F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), sum_if(paid, "quota").alias("quota"),
        sum_if(paid, "use_time").alias("sum_use_time"), max_if(paid, "use_time").alias("max_use_time"))
    return user, tests


def repaired(stored: DataFrame, logs: DataFrame, hours: DataFrame, rules: C.Rules = C.Rules()) -> DataFrame:
    """Hour facts with the given hours taken anew from the raw rows, as when rows came late; other hours stay."""
    hours = hours.select("hour_ts").distinct()
    fresh = direct_hours(logs.join(hours, S.bucket("created_at", 3600) == F.col("hour_ts"), "left_semi"), rules)[0]
    return stored.join(hours, "hour_ts", "left_anti").unionByName(fresh.select(stored.columns))


def reclassified(stored: DataFrame, logs: DataFrame, hours: DataFrame, version: int, rules: C.Rules = C.Rules()) -> DataFrame:
    """Versioned hour facts with rows of a new version for the given hours, beside those of older versions.

    ``filters.effective`` shows the new rows of an hour once it is signed for them, and the older ones until then.
    """
    same = F.col("traffic_class_version") == version
    fresh = repaired(stored.where(same).drop("traffic_class_version"), logs, hours, rules).withColumn("traffic_class_version", F.lit(version))
    return stored.where(~same).unionByName(fresh.select(stored.columns))


def hour_controls(logs: DataFrame, rules: C.Rules = C.Rules()) -> DataFrame:
    """Totals per hour by a path of their own, to hold the detail against."""
    rows = logs.where(F.col("type").isin(C.CONSUME, C.ERROR)).withColumns({"test": C.is_test(rules), "hour_ts": S.bucket("created_at", 3600)}).where("test is not null")
    paid, amount = F.col("type") == C.CONSUME, F.col("prompt_tokens") + F.col("completion_tokens")
    out = []
    for name, of in (("user", ~F.col("test")), ("test", F.col("test"))):
        out += [count_if(of).alias(f"{name}_requests"), sum_if(of & paid, amount).alias(f"{name}_tokens"), sum_if(of & paid, "quota").alias(f"{name}_quota")]
    return rows.groupBy("hour_ts").agg(*out)


USAGE_KEYS = ("user_id", "channel_id", "grp", "model_name", "token_id")
USAGE_MEASURES = ("requests", "refund_records", "prompt_tokens", "completion_tokens", "consume_quota", "refund_quota")


def usage_facts(logs: DataFrame, grain: str = "hour", rules: C.Rules = C.Rules()) -> DataFrame:
    """Consumption and refunds per hour or business day and user, channel, group, model and token."""
    rows = logs.where(F.col("type").isin(C.CONSUME, C.REFUND) & ~C.is_test(rules))
    key = S.bucket("created_at", 3600).alias("hour_ts") if grain == "hour" else S.day("created_at").alias("date_ts")
    paid, back = F.col("type") == C.CONSUME, F.col("type") == C.REFUND
    return rows.groupBy(key, *USAGE_KEYS).agg(
        F.max("token_name").alias("token_name"), count_if(paid).alias("requests"), count_if(back).alias("refund_records"), sum_if(paid, "prompt_tokens").alias("prompt_tokens"),
        sum_if(paid, "completion_tokens").alias("completion_tokens"), sum_if(paid, "quota").alias("consume_quota"), sum_if(back, "quota").alias("refund_quota"))


def daily_from_hours(hour_facts: DataFrame) -> DataFrame:
    return hour_facts.groupBy(S.day("hour_ts").alias("date_ts"), *USAGE_KEYS).agg(F.max("token_name").alias("token_name"), *again(USAGE_MEASURES))


def differences(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of a full outer join whose values differ; a side that has no row counts as zero."""
    l, r = left.select(*keys, *(F.col(v).alias(f"{v}_a") for v in values)), right.select(*keys, *(F.col(v).alias(f"{v}_b") for v in values))
    rows = l.join(r, keys, "full").select(*keys, *(F.coalesce(f"{v}_{s}", F.lit(0)).cast("long").alias(f"{v}_{s}") for v in values for s in "ab"))
    unequal = F.lit(False)
    for v in values:
        unequal = unequal | (F.col(f"{v}_a") != F.col(f"{v}_b"))
    return rows.where(unequal)


def rejection_hours(rejections: DataFrame) -> DataFrame:
    """Rejected requests per hour, node, reason, model and group, from those per minute."""
    return rejections.groupBy(S.bucket("bucket_ts", 3600).alias("hour_ts"), "node", "reason", "model", "grp").agg(F.sum("count").alias("count"))
