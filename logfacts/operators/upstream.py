"""Upstream bills: hour buckets, daily documents, publishing of staged keys, matching with accounts; site catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.functions import scalars as S

BILL = "struct<total:double,daily:array<struct<date:string,cost:double,requests:bigint>>>"


def hours(items: DataFrame, since: int, until: int, quota_per_usd: float) -> DataFrame:
    """Billed items per hour; hours without any are there with zeros."""
    dense = F.broadcast(items.sparkSession.range(since, until, 3600).withColumnRenamed("id", "hour_ts"))
    sums = items.where((F.col("at") >= since) & (F.col("at") < until)).groupBy((F.col("at") - F.col("at") % 3600).alias("hour_ts")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("quota").alias("quota"))
    rows = dense.join(sums, "hour_ts", "left").fillna(0, ["requests", "tokens", "quota"])
    return rows.withColumn("cost_usd", F.col("quota") / quota_per_usd)


def daily_documents(documents: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(key, body) with a nested bill to one row per key and day, and whether the days add up to the document's total."""
    rows = documents.select("key", F.from_json("body", BILL).alias("b")).where("b is not null")
    total = F.aggregate(F.coalesce("b.daily", F.array().cast("array<struct<date:string,cost:double,requests:bigint>>")), F.lit(0.0), lambda s, x: s + F.coalesce(x["cost"], F.lit(0.0)))
    rows = rows.withColumn("balanced", F.abs(total - F.coalesce("b.total", F.lit(0.0))) <= tolerance)
    return rows.select("key", "balanced", F.explode("b.daily").alias("d")).select("key", "balanced", "d.date", "d.cost", "d.requests")


def publish(staged: DataFrame, keys: DataFrame) -> DataFrame:
    """Sums of all keys' parts per hour, only where every key is there and all buckets are equally wide."""
    n = keys.agg(F.countDistinct("key").alias("expected"))
    rows = staged.groupBy("hour_ts").agg(F.countDistinct("key").alias("present"), F.countDistinct("bucket_seconds").alias("widths"), F.sum("cost_usd").alias("cost_usd"))
    return rows.crossJoin(F.broadcast(n)).where("present = expected and widths = 1").select("hour_ts", "cost_usd")


def by_domain(usage: DataFrame, accounts: DataFrame) -> DataFrame:
    """Usage of configured accounts of the same provider per domain, with the seconds that it covers."""
    rows = usage.join(accounts.select("domain", "provider").distinct(), ["domain", "provider"])
    return rows.groupBy("domain", "provider").agg(F.sum("cost_usd").alias("cost_usd"), F.sum("bucket_seconds").alias("seconds"), F.max(F.col("hour_ts") + F.col("bucket_seconds")).alias("until"))


def group_names(sources: list[DataFrame], ratios: DataFrame) -> DataFrame:
    """Group names of any source with a positive finite ratio."""
    names = sources[0].select(F.trim("grp").alias("grp"))
    for other in sources[1:]:
        names = names.union(other.select(F.trim("grp").alias("grp")))
    good = ratios.where((F.col("ratio") > 0) & (F.col("ratio") < float("inf")) & ~F.isnan("ratio"))
    return names.where("grp <> ''").distinct().join(good, "grp")


def group_sources(usable: DataFrame, special: DataFrame, configured: DataFrame, ratios: DataFrame) -> DataFrame:
    """(grp, ratio, priced): names of usable (grp), special (key, description) and configured (grp) groups.

    Special keys are ``+:name``, ``-:name`` (takes a name away from a member, so gives none), or in an older form
    ``append_N`` with the name as description, if that has a ratio. Names without a positive finite ratio are not priced.
    """
    known = ratios.select(F.col("grp").alias("description"), F.lit(True).alias("known")).distinct()
    rows = special.select(F.trim("key").alias("key"), F.trim(F.coalesce("description", F.lit(""))).alias("description")).join(known, "description", "left")
    gone = F.col("key").startswith("-:") | (F.lower("description") == "remove")
    name = F.when(gone, "").when(F.col("key").startswith("+:"), F.trim(F.substring("key", 3, 1 << 30))).when(F.col("key").startswith("append_") & (F.col("description") != "") & F.col("known"), F.col("description")).otherwise(F.col("key"))
    names = usable.select(F.trim("grp").alias("grp")).union(rows.select(name)).union(configured.select(F.trim("grp"))).where("grp <> ''").distinct()
    good = (F.col("ratio") > 0) & (F.col("ratio") < float("inf")) & ~F.isnan("ratio")
    return names.join(ratios, "grp", "left").select("grp", F.when(good, F.col("ratio")).alias("ratio"), F.coalesce(good, F.lit(False)).alias("priced"))


def read_range(coverage: DataFrame, asked_from: int, asked_to: int) -> DataFrame:
    """The part of a range that is published, and whether that is less than was asked for."""
    a, b = F.greatest(F.lit(asked_from), F.col("first_full_day")), F.least(F.lit(asked_to), F.col("ready_through"))
    return coverage.select(a.alias("from_ts"), F.greatest(a, b).alias("to_ts"), ((a > asked_from) | (b < asked_to)).alias("partial"))


def publishable(members: DataFrame, version: int, semantics: int, epoch: str, through: int) -> DataFrame:
    """Which members may be published: proven without a gap to the moment, under current versions and epoch."""
    ok = (F.col("through") >= through) & (F.col("classification_version") == version) & (F.col("query_semantics_version") == semantics) & (F.col("source_epoch") == epoch)
    return members.select("user_id", F.coalesce(ok, F.lit(False)).alias("publishable"))


#: The fields of a request's details and their types.
DETAILS = (
    "frt double, model_price double, model_ratio double, group_ratio double, user_group_ratio double, cache_tokens double, cache_ratio double, "
    "cache_creation_tokens double, cache_creation_ratio double, cache_creation_tokens_5m double, cache_creation_ratio_5m double, "
    "cache_creation_tokens_1h double, cache_creation_ratio_1h double, image boolean, image_ratio double, violation_fee_code string, billing_mode string, "
    "completion_ratio double, request_path string, task_id string, reason string, is_model_mapped boolean, upstream_model_name string, reasoning_effort string, "
    "is_task boolean, claude boolean, billing_source string, subscription_id bigint, subscription_plan_id bigint, subscription_plan_title string, "
    "subscription_pre_consumed bigint, subscription_post_delta bigint, subscription_consumed bigint, subscription_remain bigint, subscription_total bigint, "
    "po array<string>"
)


def details(other: str = "other") -> Column:
    """The details of a request as one struct, from one parse; a field of another type is null, the others stay."""
    return F.from_json(other, DETAILS)


def log_costs(logs: DataFrame) -> DataFrame:
    """What a request cost by the ratios in its details: input, cached, cache-writing and output tokens, times the group's ratio.

    A ratio unit is 2 USD per million tokens. In Claude's form the prompt leaves cached tokens out, and writes count, by
    their five-minute and one-hour parts if there are any, else as a whole; in the other form cached tokens are part of
    the prompt and count if they have a ratio. All amounts are null where tokens do not tell the price: rows that are no
    consumption, tiered billing, tasks not settled yet, prices per request, details without a model ratio. The member's
    own group ratio goes before the group's; without any the cost is 0.
    """
    d = lambda c, default=None: F.col(f"d.{c}") if default is None else F.coalesce(f"d.{c}", F.lit(default))
    rows = logs.withColumn("d", details())
    task = (d("is_task", False) | (d("task_id", "") != "")) & (d("model_price", 0.0) == -1)
    by_tokens = (F.col("type") == 2) & (d("billing_mode", "") != "tiered_expr") & ~task & d("model_ratio").isNotNull() & (d("model_price", 0.0) <= 0)
    price, claude = d("model_ratio") * 2 / 1000000, d("claude", False)
    prompt, cache = F.coalesce("prompt_tokens", F.lit(0)), F.floor(d("cache_tokens", 0.0))
    split = (d("cache_creation_tokens_5m", 0.0) > 0) | (d("cache_creation_tokens_1h", 0.0) > 0)
    parts = F.floor(d("cache_creation_tokens_5m", 0.0)) * d("cache_creation_ratio_5m", 1.0) + F.floor(d("cache_creation_tokens_1h", 0.0)) * d("cache_creation_ratio_1h", 1.0)
    written = F.when(split, parts).otherwise(F.floor(d("cache_creation_tokens", 0.0)) * d("cache_creation_ratio", 1.0))
    fresh = F.when(claude, prompt).otherwise(F.greatest(prompt - cache, F.lit(0)))
    cached = F.when(claude, cache * d("cache_ratio", 1.0)).otherwise(F.greatest(cache, F.lit(0)) * d("cache_ratio", 0.0))
    amounts = {"input_usd": fresh * price, "cached_usd": cached * price, "creation_usd": F.when(claude, written * price).otherwise(0.0), "output_usd": F.coalesce("completion_tokens", F.lit(0)) * price * d("completion_ratio", 0.0)}
    ratio = F.when(d("user_group_ratio") > 0, d("user_group_ratio")).otherwise(d("group_ratio", 0.0))
    rows = rows.select("id", *(F.when(by_tokens, c).alias(n) for n, c in amounts.items()), ratio.alias("ratio"))
    return rows.select("id", *amounts, ((F.col("input_usd") + F.col("cached_usd") + F.col("creation_usd") + F.col("output_usd")) * F.col("ratio")).alias("cost_usd"))


def cache_split() -> Column:
    """Cache-creation tokens: the five-minute and one-hour parts if any is given, else the unsplit number."""
    split = F.coalesce("cache_5m", F.lit(0)) + F.coalesce("cache_1h", F.lit(0))
    return F.when(split > 0, split).otherwise(F.coalesce("cache_total", F.lit(0)))


def settled() -> Column:
    """Subscription amount: what was consumed if that is stated, else the advance and its correction."""
    return F.coalesce("consumed", F.coalesce("pre", F.lit(0)) + F.coalesce("delta", F.lit(0)))


def exposed(logs: DataFrame) -> DataFrame:
    """(id, first_byte_ms, cache_read_tokens, cache_write_tokens, cost_usd): what a member sees of a request beside its columns.

    The first byte's time is told of streams, the cost of consumption alone; without details the rest is 0.
    """
    d = lambda c: F.floor(F.coalesce(f"d.{c}", F.lit(0.0))).cast("long")
    rows = logs.withColumn("d", details())
    streamed = F.coalesce(F.col("is_stream"), F.lit(False)) & (F.col("d.frt") > 0)
    split = (d("cache_creation_tokens_5m") > 0) | (d("cache_creation_tokens_1h") > 0)
    written = F.when(split, d("cache_creation_tokens_5m") + d("cache_creation_tokens_1h")).otherwise(d("cache_creation_tokens"))
    return rows.select("id", F.when(streamed, d("frt")).alias("first_byte_ms"), d("cache_tokens").alias("cache_read_tokens"), written.alias("cache_write_tokens"), F.when(F.col("type") == 2, S.usd(F.col("quota"))).alias("cost_usd"))
