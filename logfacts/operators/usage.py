"""Usage and billing of members: totals, days, matrices, models with the rest folded, searches and extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators.audit import hour_words
from logfacts.operators.rollup import USAGE_MEASURES, again


#: A word of the notice on violation fees, and the detail that stands for it.
FEE_WORD, FEE_FIELD = "违规费", "violation_fee_code"


def billing(sums: DataFrame) -> DataFrame:
    net = F.col("consume_quota") - F.col("refund_quota")
    return sums.withColumns({"net_quota": net, "gross_usd": S.usd(F.col("consume_quota")), "refund_usd": S.usd(F.col("refund_quota")), "net_usd": S.usd(net)})


def totals(facts: DataFrame, *keys: str) -> DataFrame:
    return billing(facts.groupBy(*keys).agg(*again(USAGE_MEASURES)))


def days(facts: DataFrame, since: int, until: int, *keys: str) -> DataFrame:
    rows = facts.where((F.col("hour_ts") >= since) & (F.col("hour_ts") < until)).withColumn("date_ts", S.day("hour_ts"))
    return totals(rows, "date_ts", *keys)


def models_by_day(facts: DataFrame, most: int = 6) -> DataFrame:
    """Per day the models with the largest consumption over the whole range, all others as one."""
    ranked = facts.groupBy("model_name").agg(F.sum("consume_quota").alias("q")).orderBy(F.desc("q"), "model_name").limit(most)
    rows = facts.withColumn("date_ts", S.day("hour_ts")).join(F.broadcast(ranked.select("model_name", F.lit(True).alias("top"))), "model_name", "left")
    return rows.groupBy("date_ts", F.when(F.col("top"), F.col("model_name")).otherwise("other").alias("model")).agg(F.sum("requests").alias("requests"), F.sum("consume_quota").alias("consume_quota"))


def matrix(facts: DataFrame, members: DataFrame, since: int, until: int) -> DataFrame:
    """Every member and business day of the range, with zeros where there was nothing."""
    start = (since + S.ZONE) // S.DAY * S.DAY - S.ZONE
    dates = F.broadcast(facts.sparkSession.range(start, until, S.DAY).withColumnRenamed("id", "date_ts"))
    sums = facts.where((F.col("hour_ts") >= since) & (F.col("hour_ts") < until)).groupBy("user_id", S.day("hour_ts").alias("date_ts")).agg(F.sum("requests").alias("requests"), F.sum("consume_quota").alias("consume_quota"))
    return members.select("user_id").distinct().crossJoin(dates).join(sums, ["user_id", "date_ts"], "left").fillna(0, ["requests", "consume_quota"])


def tokens(facts: DataFrame, dimension: DataFrame) -> DataFrame:
    """Tokens with their use: existing ones without any, and used ones that no longer exist."""
    used = facts.groupBy("token_id").agg(F.max("token_name").alias("used_name"), F.sum("requests").alias("requests"), F.sum("consume_quota").alias("consume_quota"))
    rows = used.join(dimension.select("token_id", "name"), "token_id", "full")
    return rows.select("token_id", F.coalesce("name", "used_name").alias("name"), F.col("name").isNull().alias("deleted"), F.coalesce("requests", F.lit(0)).alias("requests"), F.coalesce("consume_quota", F.lit(0)).alias("consume_quota"))


def search(logs: DataFrame, since: int, until: int, users: list[int] | None = None, kind: int | None = None, model: str | None = None, content: str | None = None, token: str | None = None, group: str | None = None, request: str | None = None, rules: C.Rules | None = None) -> DataFrame:
    """Log rows by range and conditions; texts are searched literally; with ``rules`` without internal tests.

    A word of the fee notice also finds rows whose details carry the fee, as the notice is made of them and stored nowhere.
    """
    rows = logs.where((F.col("created_at") >= since) & (F.col("created_at") < until))
    for given, cond in ((users, F.col("user_id").isin(users or [])), (kind, F.col("type") == kind), (model, F.col("model_name") == model), (content, F.col("content").contains(content or "") | (F.col("other").contains(FEE_FIELD) if FEE_WORD in (content or "") else F.lit(False))), (group, F.col("grp") == group), (request, F.col("request_id") == request), (rules, ~C.is_test(rules or C.Rules())), (token, F.col("token_name").contains(token or ""))):
        rows = rows.where(cond) if given is not None else rows
    return rows


def capped(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first rows of an order, and whether there are more; only one row beyond the cap is read to know."""
    w = Window.orderBy(*order)
    held = rows.orderBy(*order).limit(most + 1).withColumn("rn", F.row_number().over(w))  # so many rows at most
    return held.withColumn("truncated", F.max("rn").over(Window.partitionBy()) > most).where(F.col("rn") <= most).drop("rn")


def cell_budget(members: DataFrame, since: int, until: int, most: int = 20_000) -> DataFrame:
    """(members, days, cells, over): whether a matrix of members and business days is larger than allowed."""
    days = (until - 1 + S.ZONE) // S.DAY - (since + S.ZONE) // S.DAY + 1 if until > since else 0
    n = members.agg(F.countDistinct("user_id").alias("members"))
    return n.select("members", F.lit(days).cast("long").alias("days"), (F.col("members") * days).alias("cells"), (F.col("members") * days > most).alias("over"))


def extract(rows: DataFrame, most: int, before_id: int | None = None, max_id: int | None = None) -> DataFrame:
    """Newest first, from a cursor on, within a snapshot."""
    rows = rows.where(F.col("id") < before_id) if before_id is not None else rows
    rows = rows.where(F.col("id") <= max_id) if max_id is not None else rows
    return rows.orderBy(F.desc("id")).limit(most)


def bounded_count(rows: DataFrame, most: int) -> DataFrame:
    """The count up to a cap, whether there are more, and the largest id counted."""
    held = rows.select("id").orderBy("id").limit(most + 1).agg(F.count("*").alias("n"), F.max("id").alias("max_id"))
    return held.select(F.least("n", F.lit(most)).alias("n"), (F.col("n") > most).alias("more"), "max_id")


def follow_ups(facts: DataFrame, until: int, balances: DataFrame, dormant_days: int = 14, drop_per_cent: int = 30, low_balance_usd: float = 1.0, window: int = 30) -> DataFrame:
    """Members to look after: dormant, dropping or low on balance, with reasons and urgency.

    ``balances`` may have eligible_from, the number of the first day of the window that counts for a member: days before
    it are no days without consumption, and the rules on 14 days and on dormancy wait for as many days. Amounts are added
    up and compared as whole quotas, so neither whole dollars nor a drop to just the bar hang on the order of rows.
    """
    if "eligible_from" not in balances.columns:
        balances = balances.withColumn("eligible_from", F.lit(0))
    balances = balances.withColumn("eligible_from", F.greatest(F.lit(0), F.least(F.lit(window), F.coalesce("eligible_from", F.lit(0)))))
    since = until - window * S.DAY
    ix = F.floor((F.col("hour_ts") - since) / S.DAY)
    spent = F.col("consume_quota") - F.col("refund_quota")
    inside = facts.where((F.col("hour_ts") >= since) & (F.col("hour_ts") < until)).groupBy("user_id", ix.alias("ix")).agg(F.sum(spent).alias("net"))
    part = lambda a, b: F.coalesce(F.sum(F.when((F.col("ix") >= a) & (F.col("ix") < b), F.col("net"))), F.lit(0))
    sums = inside.join(balances.select("user_id", "eligible_from"), "user_id").where("ix >= eligible_from").groupBy("user_id").agg(part(0, window).alias("spend"), part(window - 7, window).alias("last7"), part(window - 14, window - 7).alias("prev7"), F.max(F.when(F.col("net") > 0, F.col("ix"))).alias("active"))
    rows = balances.select("user_id", "balance_usd", (F.lit(window) - F.col("eligible_from")).alias("days")).join(sums, "user_id", "left").fillna(0, ["spend", "last7", "prev7"])
    idle = F.when(F.col("active").isNotNull(), F.lit(window - 1) - F.col("active")).otherwise(F.col("days")).cast("long")
    rows = rows.withColumn("days_idle", idle)
    dormant = (F.col("days") >= dormant_days) & (F.col("days_idle") >= dormant_days)
    drop = ~dormant & (F.col("days") >= 14) & (F.col("prev7") > 0) & (F.col("last7") * 100 < F.col("prev7") * (100 - drop_per_cent))
    low = F.coalesce(F.col("balance_usd") < low_balance_usd, F.lit(False))
    reasons = F.array_join(F.array_compact(F.array(F.when(dormant, "dormant"), F.when(drop, "drop"), F.when(low, "low balance"))), ",")
    urgency = F.when(dormant, 50).when(drop, 35).otherwise(0) + F.when(low, 45).otherwise(0) + S.div("spend", S.QUOTA_PER_USD)
    rows = rows.withColumns({"reasons": reasons, "urgency": urgency.cast("long"), "level": F.when(F.col("spend") > 0, "urgent").otherwise("info")})
    return rows.where("reasons <> ''").select("user_id", "days_idle", "reasons", "urgency", "level", S.usd(F.col("spend")).alias("spend_usd"))


def by_company(found: DataFrame, members: DataFrame, companies: DataFrame) -> DataFrame:
    """Follow-ups per company (id 0: none): members found, spend and urgency; a company without any member is one too.

    Dollars are added up with the six digits that a quota takes, so whole ones stay whole in any order of rows.
    """
    rows = members.select("user_id", F.coalesce("group_id", F.lit(0)).alias("group_id")).join(found.select("user_id", "urgency", "spend_usd"), "user_id", "left")
    sums = rows.groupBy("group_id").agg(F.count("urgency").alias("found"), F.coalesce(F.sum(F.col("spend_usd").cast("decimal(28,6)")), F.lit(0)).alias("spend_usd"), F.coalesce(F.sum("urgency"), F.lit(0)).alias("of_members"))
    all_ = companies.select("group_id").join(sums, "group_id", "full").withColumn("spend_usd", F.coalesce("spend_usd", F.lit(0)))
    empty = F.col("found").isNull()
    urgency = F.when(empty, 20).otherwise(F.floor("spend_usd") + F.col("of_members")).cast("long")
    return all_.where(empty | (F.col("found") > 0)).select("group_id", F.coalesce("found", F.lit(0)).alias("members"), F.col("spend_usd").cast("double").alias("spend_usd"), empty.alias("without_members"), urgency.alias("urgency"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def ordered_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with a place (``rank``) per user: living ones first, then by spending, by all that was ever spent, and by name."""
    order = [F.col("deleted"), F.desc("consume_quota"), F.desc(F.coalesce("total_quota", F.lit(0))), F.asc("name"), F.asc("token_id")]
    return tokens.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))


def ordered_members(members: DataFrame, most: int) -> DataFrame:
    """The members who used most, then by name."""
    return members.orderBy(F.desc("used_quota"), "name", "user_id").limit(most)


def page_totals(states: DataFrame, now: int, recent: int = 900) -> DataFrame:
    """(hours, complete, pages, source_rows, recent_hours, recent_seconds) of page-wise imports; one row."""
    done = F.col("status") == "complete"
    new = done & (F.col("updated_at") >= now - recent)
    rows = states.agg(F.count("*").alias("hours"), F.count_if(done).alias("complete"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_rows"), F.count_if(new).alias("recent_hours"), F.min(F.when(new, F.col("updated_at"))).alias("first"))
    return rows.withColumn("recent_seconds", F.coalesce(F.greatest(F.lit(now) - F.col("first"), F.lit(0)), F.lit(0)).cast("long")).drop("first")


def proof_progress(proofs: DataFrame, hours: int) -> DataFrame:
    """(user_id, hours, progress): how many of so many hours are proven."""
    proven = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    return hour_words(proofs).groupBy("user_id").agg(proven.alias("hours")).withColumn("progress", F.col("hours") * 100.0 / hours)


def boundaries(logs: DataFrame) -> DataFrame:
    """(user_id, first, last): when each member's log begins and ends."""
    return logs.groupBy("user_id").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"))


def events(logs: DataFrame) -> DataFrame:
    """Consumption and refunds in the order of a member's log: time, type, id; in order within each partition."""
    rows = logs.where(F.col("type").isin(C.CONSUME, C.REFUND)).select("user_id", "created_at", "type", "id", "quota")
    return rows.sortWithinPartitions("created_at", "type", "id")


def member_rows(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members (user_id and what is to be shown of them) with their net quota, 0 without any facts."""
    net = facts.groupBy("user_id").agg(F.sum(F.col("consume_quota") - F.col("refund_quota")).alias("net_quota"))
    return members.join(net, "user_id", "left").fillna(0, ["net_quota"])
