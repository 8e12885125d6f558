"""Stability reports: levels, shares, days, timelines, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.functions import scalars as S
from logfacts.operators.rollup import again
from logfacts.sources.tables import kept

COUNTS = ("success", "anomaly", "failed", "tokens", "quota", "sum_use_time")


def with_metrics(sums: DataFrame) -> DataFrame:
    """Requests, problems and rates of summed outcomes; rates are null where there is nothing."""
    n = F.col("success") + F.col("anomaly") + F.col("failed") + F.col("rejected")
    bad, delivered = F.col("anomaly") + F.col("failed") + F.col("rejected"), F.col("success") + F.col("anomaly")
    stability = S.rate_or_null(F.col("success"), n)
    return sums.withColumns({
        "requests": n, "problems": bad, "stability": stability, "problem_rate": S.rate_or_null(bad, n), "cost_usd": S.usd(F.col("quota")),
        "avg_latency": F.when(delivered > 0, F.col("sum_use_time") / delivered), "health": F.when(n > 0, S.health(n, stability)).otherwise("nosample"),
    })


def with_rejections(hours: DataFrame, rejections: DataFrame | None = None, channel: int | None = None, vendor: str | None = None) -> DataFrame:
    """Outcome rows with a rejected count; rejections are rows of their own, of no channel.

    A rejected request has met no channel, so under a filter by channel or vendor none is counted (``hours`` are filtered already).
    """
    rows = hours.select("hour_ts", "channel_id", "model_name", "grp", *COUNTS).withColumn("rejected", F.lit(0).cast("long"))
    if rejections is None or channel is not None or vendor:
        return rows
    more = rejections.select(S.bucket("bucket_ts", 3600).alias("hour_ts"), F.lit(None).cast("long").alias("channel_id"), F.col("model").alias("model_name"), "grp", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.col("count").alias("rejected"))
    return rows.unionByName(more)


KEYS = ("grp", "channel_id", "model")
SETS = {(): "all", ("grp",): "group", ("grp", "channel_id"): "group-channel", KEYS: "group-channel-model", ("grp", "model"): "group-model", ("channel_id",): "channel", ("model",): "model"}


def _level() -> Column:
    """The name of a grouping set, from the column gid."""
    level: Column = F.lit(None)
    for keys, name in SETS.items():
        level = F.when(F.col("gid") == sum(0 if c in keys else 1 << (2 - i) for i, c in enumerate(KEYS)), name).otherwise(level)
    return level


def levels(rows: DataFrame) -> DataFrame:
    """All levels of the report in one pass. ``level`` tells them apart, as blank and null keys are legal."""
    rows = rows.withColumnRenamed("model_name", "model")
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in SETS], "grp", "channel_id", "model").agg(F.grouping_id().alias("gid"), *again([*COUNTS, "rejected"]))
    return with_metrics(grouped.withColumn("level", _level()).drop("gid"))


def with_shares(report: DataFrame) -> DataFrame:
    """Each row's share of its level's requests and problems."""
    report = kept(report)  # else the levels' totals would make all levels anew
    whole = report.groupBy("level").agg(F.sum("requests").alias("n"), F.sum("problems").alias("bad"))  # seven rows
    shares = {"request_share": S.rate_or_null(F.col("requests"), F.col("n")), "problem_share": S.rate_or_null(F.col("problems"), F.col("bad"))}
    return report.join(F.broadcast(whole), "level").withColumns(shares).drop("n", "bad")


def deltas(rows: DataFrame, since: int, until: int, before: int) -> DataFrame:
    """Change of stability in percentage points of [since, until) against [before, since), for all levels in one pass.

    Levels without a row in the later range are left out; the change is null if either range has no requests.
    """
    now, parts = F.col("hour_ts") >= since, ("success", "anomaly", "failed", "rejected")
    rows = rows.where((F.col("hour_ts") >= before) & (F.col("hour_ts") < until)).withColumnRenamed("model_name", "model")
    sums = [F.sum(F.when(inside, F.col(c))).alias(f"{p}_{c}") for p, inside in (("now", now), ("old", ~now)) for c in parts]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in SETS], "grp", "channel_id", "model").agg(F.grouping_id().alias("gid"), F.count_if(now).alias("held"), *sums)
    rate = lambda p: S.rate_or_null(F.col(f"{p}_success"), F.col(f"{p}_success") + F.col(f"{p}_anomaly") + F.col(f"{p}_failed") + F.col(f"{p}_rejected"))
    return grouped.where("held > 0").select(_level().alias("level"), "grp", "channel_id", "model", (rate("now") - rate("old")).alias("delta_pp"))


def with_deltas(report: DataFrame, before: DataFrame) -> DataFrame:
    """The change of stability against the period before, in percentage points."""
    keys = ["level", "grp", "channel_id", "model"]
    old = before.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("stability").alias("before"))
    same = [report[k].eqNullSafe(old[f"b_{k}"]) for k in keys]
    return report.join(old, same[0] & same[1] & same[2] & same[3], "left").withColumn("delta_pp", F.col("stability") - F.col("before")).drop(*(f"b_{k}" for k in keys))


def step_seconds(since: int, until: int) -> int:
    hours = max(1, -(-(until - since) // 3600))
    return max(1, -(-hours // 90)) * 3600


def timeline(rows: DataFrame, since: int, until: int) -> DataFrame:
    """About 90 points, empty ones included, aligned with business days."""
    step = step_seconds(since, until)
    start = (since + S.ZONE) // step * step - S.ZONE
    keys = rows.sparkSession.range(start, until, step).withColumnRenamed("id", "ts")
    inside = rows.where((F.col("hour_ts") >= since) & (F.col("hour_ts") < until))
    sums = inside.groupBy(S.zoned_bucket("hour_ts", step).alias("ts")).agg(*again([*COUNTS, "rejected"]))
    return with_metrics(keys.join(sums, "ts", "left").fillna(0, [*COUNTS, "rejected"]))


def by_day(rows: DataFrame, *keys: str) -> DataFrame:
    return with_metrics(rows.groupBy(S.day("hour_ts").alias("date_ts"), *keys).agg(*again([*COUNTS, "rejected"])))


#: Seconds after its end until an hour can be complete.
FINALIZE_DELAY = 600


def coverage(ledger: DataFrame, since: int, until: int, now: int, version: int = 5) -> DataFrame:
    """How much of a range of hours is complete, under the current version (strict) or any (effective); one row.

    The range ends with the last hour that is final at ``now``; an empty one is complete. If the only hour that lacks the current
    version is that last one, and it is not in the ledger yet, queued or running, it is pending and no gap. The ledger has one row an hour.
    """
    final = max(now - FINALIZE_DELAY, 0) // 3600 * 3600
    since, until = since // 3600 * 3600, min(until, final) // 3600 * 3600
    n, last = max(0, until - since) // 3600, until - 3600
    rows = ledger.where((F.col("hour_ts") >= since) & (F.col("hour_ts") < until))
    done, current = F.col("status") == "complete", F.coalesce(F.col("traffic_class_version") == version, F.lit(False))
    hours = lambda c: F.countDistinct(F.when(c, F.col("hour_ts")))
    counts = rows.agg(hours(done & current).alias("completed"), hours(done).alias("effective"), F.max(F.when(F.col("hour_ts") == last, F.col("status"))).alias("last_status"))
    whole = F.lit(n).cast("long")
    share = lambda c: F.when(whole == 0, 100.0).otherwise(F.col(c) * 100.0 / whole)
    missing, gone = whole - F.col("completed"), whole - F.col("effective")
    pending = (missing == 1) & F.lit(n > 0 and until == final) & F.coalesce(F.col("last_status").isin("queued", "running"), F.lit(True))
    return counts.select(
        F.lit(since).alias("from_ts"), F.lit(until).alias("to_ts"), whole.alias("expected"), "completed", missing.alias("missing"), share("completed").alias("percent"), (missing == 0).alias("complete"),
        "effective", gone.alias("effective_missing"), share("effective").alias("effective_percent"), (gone == 0).alias("effective_complete"), (F.col("effective") - F.col("completed")).alias("legacy"),
        pending.alias("pending"), F.when(pending, F.lit(last)).alias("pending_ts"))


def covered_rejections(rejections: DataFrame, ledger: DataFrame, samples: DataFrame, version: int = 5) -> DataFrame:
    """Rejections of the hours that count: those with a complete ledger row of the version, or with an effective sample."""
    done = ledger.where((F.col("status") == "complete") & (F.col("traffic_class_version") == version)).select("hour_ts")
    hours = done.union(samples.select("hour_ts")).distinct()
    return rejections.withColumn("hour_ts", S.bucket("bucket_ts", 3600)).join(hours, "hour_ts", "left_semi")


def by_dimension(facts: DataFrame, channels: DataFrame, vendor: str | None = None) -> DataFrame:
    """Outcomes by group, channel and model with the channel's name, vendor and whether it is still there; of one vendor only, if asked."""
    dims = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"), "vendor", *(["status"] if "status" in channels.columns else []), F.lit(True).alias("known"))
    sums = facts.groupBy("grp", "channel_id", "model_name").agg(*again(COUNTS))
    rows = sums.join(dims, "channel_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return rows.where(F.col("vendor") == vendor) if vendor else rows


def ranking(report: DataFrame, level: str, key: str) -> DataFrame:
    """The rows of one level of the report, most requests first, then by key."""
    return report.where(F.col("level") == level).orderBy(F.desc("requests"), F.asc(key))


def vendor_label(facts: DataFrame, channels: DataFrame, several: str = "several") -> DataFrame:
    """(grp, vendor): the vendor of a group's channels, blank if there is none, ``several`` if more than one."""
    rows = facts.join(channels.select(F.col("id").alias("channel_id"), "vendor"), "channel_id", "left")
    seen = rows.groupBy("grp").agg(F.countDistinct("vendor").alias("n"), F.min("vendor").alias("vendor"))
    return seen.select("grp", F.when(F.col("n") == 0, "").when(F.col("n") == 1, F.col("vendor")).otherwise(several).alias("vendor"))


def filter_lists(facts: DataFrame, channels: DataFrame) -> DataFrame:
    """The distinct groups, models, vendors and channels to choose from, sorted; one row."""
    joined = facts.join(channels.select(F.col("id").alias("channel_id"), "vendor"), "channel_id", "left")
    text = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return joined.agg(text("grp").alias("groups"), text("model_name").alias("models"), text("vendor").alias("vendors"))
