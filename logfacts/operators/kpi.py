"""Key figures of a window: summaries, top tables, series, comparison of periods, service levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfacts.functions import scalars as S
from logfacts.operators import filters
from logfacts.operators.rollup import ADDED, LARGEST, again


def total() -> Column:
    return F.col("success") + F.col("anomaly") + F.col("failed")


def with_rates(sums: DataFrame, window_seconds: float) -> DataFrame:
    """Derived figures of summed measures."""
    paid, n = F.col("success") + F.col("anomaly"), total()
    share = S.rate(paid, n)
    return sums.withColumns({
        "total": n, "success_rate": S.rate(F.col("success"), n), "anomaly_rate": S.rate(F.col("anomaly"), n), "error_rate": S.rate(F.col("failed"), n),
        "anomaly_cost_usd": S.usd(F.col("anomaly_quota")), "anomaly_avg_wait": F.when(F.col("anomaly") > 0, F.col("anomaly_sum_time") / F.col("anomaly")).otherwise(0.0),
        "qps": n / F.lit(float(window_seconds)), "avg_latency": F.when(paid > 0, F.col("sum_use_time") / paid).otherwise(0.0), "cost_usd": S.usd(F.col("quota")),
        **{f"p{p}": S.percentile(list(S.LATENCY), S.LATENCY_EDGES, "max_use_time", p) for p in (50, 95, 99)},
        **{f"ttft_p{p}": S.percentile(list(S.TTFT), S.TTFT_EDGES, "ttft_max_ms", p) / 1000 for p in (50, 95)},
        "tok_per_sec": F.when(F.col("sum_use_time") > 0, F.col("completion_tokens") / F.col("sum_use_time")).otherwise(0.0), "health": S.health(n, share),
    })


def shown(minute_facts: DataFrame, channels: DataFrame, pairs: DataFrame, dimension: str | None = None) -> DataFrame:
    """Facts that key figures count: of enabled channels and selectable pairs; a table of channels shows all of them."""
    return minute_facts if dimension == "channel_id" else filters.selectable(filters.enabled(minute_facts, channels), pairs)


def summary(minute_facts: DataFrame, since: int, window_seconds: float) -> DataFrame:
    sums = minute_facts.where(F.col("bucket_ts") >= since).agg(*(F.coalesce(c, F.lit(0)).alias(n) for n, c in zip((*ADDED, *LARGEST), again((*ADDED, *LARGEST)), strict=True)))
    return with_rates(sums, window_seconds)


def top(minute_facts: DataFrame, dimension: str, since: int, window_seconds: float, most: int = 200) -> DataFrame:
    """The keys of a dimension by quota, requests and name."""
    sums = minute_facts.where(F.col("bucket_ts") >= since).groupBy(F.when(F.col(dimension).cast("string") == "", "(blank)").otherwise(F.col(dimension).cast("string")).alias("key")).agg(*again((*ADDED, *LARGEST)))
    return with_rates(sums, window_seconds).orderBy(F.desc("quota"), F.desc("total"), "key").limit(most)


def series(minute_facts: DataFrame, dimension: str, since: int, window_seconds: int) -> DataFrame:
    """Points of each key, a minute each or so wide that there are about 60."""
    step = 60 if window_seconds <= 3600 else window_seconds // 60 // 60 * 60
    rows = minute_facts.where(F.col("bucket_ts") >= since).groupBy(F.col(dimension).cast("string").alias("key"), S.bucket("bucket_ts", step).alias("ts"))
    return rows.agg(F.sum("success").alias("success"), F.sum("anomaly").alias("anomaly"), F.sum("failed").alias("failed"))


def bursts(points: DataFrame, least: int = 3) -> DataFrame:
    """(key, longest, burst): the longest run of points with anomalies; points that are missing do not end a run."""
    order = Window.partitionBy("key").orderBy("ts")
    bad = (F.col("anomaly") > 0).cast("int")
    rows = points.withColumn("island", F.row_number().over(order) - F.sum(bad).over(order)).withColumn("bad", bad)
    runs = rows.groupBy("key", "island").agg(F.sum("bad").alias("run"))
    return runs.groupBy("key").agg(F.max("run").cast("long").alias("longest")).withColumn("burst", F.col("longest") >= least)


def compare(minute_facts: DataFrame, now: int) -> DataFrame:
    """The last day, the day before and the same day a week ago, in one pass."""
    periods = {"now": (now - S.DAY, now), "prior": (now - 2 * S.DAY, now - S.DAY), "week": (now - 8 * S.DAY, now - 7 * S.DAY)}
    sums = []
    for name, (a, b) in periods.items():
        inside = (F.col("bucket_ts") >= a) & (F.col("bucket_ts") < b)
        sums += [F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("long").alias(f"{name}_{c}") for c in ("success", "anomaly", "failed", "quota")]
    rows = minute_facts.agg(*sums)
    rates = {f"{p}_rate": S.rate(F.col(f"{p}_success"), F.col(f"{p}_success") + F.col(f"{p}_anomaly") + F.col(f"{p}_failed")) for p in periods}
    return rows.withColumns(rates)


def service_level(minute_facts: DataFrame, now: int, target: float = 99.0, days: int = 7, fast_minutes: int = 60, slow_minutes: int = 360) -> DataFrame:
    """Compliance with the target, the error budget, and how fast it burns over two windows."""
    allowed = (100 - target) / 100
    in_last = lambda seconds: F.col("bucket_ts") >= now - seconds
    sums = []
    for name, seconds in (("all", days * S.DAY), ("fast", fast_minutes * 60), ("slow", slow_minutes * 60)):
        sums += [F.coalesce(F.sum(F.when(in_last(seconds), v)), F.lit(0)).cast("long").alias(f"{name}_{c}") for c, v in (("total", total()), ("failed", F.col("failed")))]
    rows = minute_facts.agg(*sums)
    n, bad = F.col("all_total"), F.col("all_failed")
    used = F.when(n > 0, bad / (F.lit(allowed) * n) * 100).otherwise(0.0)
    current = F.when(n > 0, (n - bad) / n * 100).otherwise(100.0)
    burn = lambda w: F.when(F.col(f"{w}_total") > 0, F.col(f"{w}_failed") / F.col(f"{w}_total") / F.lit(allowed)).otherwise(0.0)
    return rows.withColumns({"current_pct": current, "budget_used_pct": used, "budget_left_pct": 100 - used, "compliant": current >= target, "burn_fast": burn("fast"), "burn_slow": burn("slow")})


def freshness(minute_facts: DataFrame, now: int) -> DataFrame:
    return minute_facts.agg(F.max("bucket_ts").alias("newest"), F.min("bucket_ts").alias("oldest")).withColumn("age", F.lit(now) - F.col("newest"))


def top_tokens(token_facts: DataFrame, most: int = 100) -> DataFrame:
    """Tokens by what they cost; equal ones by name."""
    sums = token_facts.groupBy("token_name").agg(*again(("success", "anomaly", "failed", "tokens", "quota")))
    return sums.orderBy(F.desc("quota"), "token_name").limit(most)


def top_rejections(rejections: DataFrame, most: int = 100) -> DataFrame:
    """(reason, model, grp, n) with the most rejected requests."""
    return rejections.groupBy("reason", "model", "grp").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "reason", "model", "grp").limit(most)
