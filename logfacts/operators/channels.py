"""Channels: snapshots, prices, cost and margin, balance and runway, site catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfacts.functions import scalars as S


def snapshot(before: DataFrame, now_rows: DataFrame, now: int) -> DataFrame:
    """Current rows in place of earlier ones; ids that are gone are marked deleted; enabled_since follows the status."""
    b = before.select("id", *(F.col(c).alias(f"b_{c}") for c in ("name", "status", "enabled_since", "deleted_at")))
    rows = now_rows.select("id", "name", "status").join(b, "id", "full")
    gone = F.col("status").isNull()
    since = F.when(F.col("status") != 1, 0).when((F.col("b_status") == 1) & (F.col("b_deleted_at") == 0), F.col("b_enabled_since")).when(F.col("b_status").isNull(), 0).otherwise(now)
    return rows.select("id", F.coalesce("name", "b_name").alias("name"), F.coalesce("status", "b_status").alias("status"), F.when(gone, F.col("b_enabled_since")).otherwise(since).cast("long").alias("enabled_since"), F.when(gone, F.when(F.col("b_deleted_at") > 0, F.col("b_deleted_at")).otherwise(now)).otherwise(0).cast("long").alias("deleted_at"))


#: The gateway's channel types by number; numbers that are left out and unknown ones have no label.
UNLABELLED = "未标记"
TYPES = {
    1: "OpenAI", 2: "Midjourney", 3: "Azure", 4: "Ollama", 5: "MidjourneyPlus", 6: "OpenAIMax", 7: "OhMyGPT", 8: "Custom", 9: "AILS", 10: "AIProxy", 11: "PaLM", 12: "API2GPT", 13: "AIGC2D", 14: "Anthropic", 15: "Baidu",
    16: "Zhipu", 17: "Ali", 18: "Xunfei", 19: "360", 20: "OpenRouter", 21: "AIProxyLibrary", 22: "FastGPT", 23: "Tencent", 24: "Gemini", 25: "Moonshot", 26: "ZhipuV4", 27: "Perplexity", 31: "LingYiWanWu", 33: "AWS",
    34: "Cohere", 35: "MiniMax", 36: "SunoAPI", 37: "Dify", 38: "Jina", 39: "Cloudflare", 40: "SiliconFlow", 41: "VertexAI", 42: "Mistral", 43: "DeepSeek", 44: "MokaAI", 45: "VolcEngine", 46: "BaiduV2", 47: "Xinference",
    48: "xAI", 49: "Coze", 50: "Kling", 51: "Jimeng", 52: "Vidu", 53: "Submodel", 54: "DoubaoVideo", 55: "Sora", 56: "Replicate", 57: "Codex",
}


def vendor_of(kind: Column) -> Column:
    """The vendor's name of a channel type."""
    names = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(names[kind.cast("int")], F.lit(UNLABELLED))


def cleaned(source: DataFrame) -> DataFrame:
    """Channels as the source has them (id, name, type, status, groups, models, base_url) to the dimension: blanks for nulls, the
    vendor by type, the URL's host in place of the URL, and the lists of groups and models without blanks and repeats."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    tidy = lambda c: F.array_join(S.clean_list(text(c)), ",")
    return source.select("id", text("name").alias("name"), "type", vendor_of(F.col("type")).alias("vendor"), "status", S.host(text("base_url")).alias("base_host"), tidy("groups").alias("groups"), tidy("models").alias("models"))


def groups_of_domains(facts: DataFrame, channels: DataFrame, version: int = 5) -> DataFrame:
    """(domain, grp, configured): the groups that may be priced for each domain, those its channels have and those seen in its facts.

    A domain that no channel has now gets none; blank groups are left out, as are facts of other class versions.
    """
    now = channels.where("base_domain <> ''").select(F.col("id").alias("channel_id"), F.col("base_domain").alias("domain"), "groups")
    listed = now.select("domain", F.explode(S.clean_list(F.col("groups"))).alias("grp")).distinct().withColumn("configured", F.lit(True))
    facts = facts.where(F.col("traffic_class_version") == version) if "traffic_class_version" in facts.columns else facts
    seen = facts.join(now.select("channel_id", "domain"), "channel_id").select("domain", F.trim("grp").alias("grp")).where("grp <> ''").distinct()
    return listed.join(seen, ["domain", "grp"], "full").select("domain", "grp", F.coalesce("configured", F.lit(False)).alias("configured"))


def version_counts(versions: DataFrame, domains: DataFrame) -> DataFrame:
    """(domain, versions, latest) of every configured domain, 0 where there are none."""
    sums = versions.groupBy(F.trim("domain").alias("domain")).agg(F.count("*").alias("versions"), F.max("version").alias("latest"))
    return domains.select(F.trim("domain").alias("domain")).where("domain <> ''").distinct().join(sums, "domain", "left").fillna(0, ["versions", "latest"])


def pairs(channels: DataFrame, visible_groups: DataFrame) -> DataFrame:
    """The distinct (grp, model) of enabled channels whose group is visible."""
    on = channels.where("status = 1").select(F.explode(S.clean_list(F.col("groups"))).alias("grp"), "models")
    rows = on.select("grp", F.explode(S.clean_list(F.col("models"))).alias("model"))
    return rows.join(visible_groups.select("grp").distinct(), "grp", "left_semi").distinct()


def channel_counts(channels: DataFrame) -> DataFrame:
    on = channels.where("status = 1").select("id", F.explode(S.clean_list(F.col("groups"))).alias("grp"), "models")
    return on.select("id", "grp", F.explode(S.clean_list(F.col("models"))).alias("model")).groupBy("grp", "model").agg(F.countDistinct("id").alias("channels"))


def usage_by_channel(facts: DataFrame, channels: DataFrame) -> DataFrame:
    """Quota and requests by domain, vendor and channel with subtotals; unmatched channels are a bucket of their own."""
    c = channels.select(F.col("id").alias("channel_id"), "vendor", "base_domain")
    unknown = F.lit("historical unknown")
    rows = facts.join(c, "channel_id", "left").select(F.coalesce("base_domain", unknown).alias("domain"), F.coalesce("vendor", unknown).alias("vendor"), "channel_id", "requests", "consume_quota")
    return rows.rollup("domain", "vendor", "channel_id").agg(F.grouping_id().cast("int").alias("level"), F.sum("requests").alias("requests"), F.sum("consume_quota").alias("consume_quota"))


def canonical_rates(costs: DataFrame) -> DataFrame:
    """Of each channel the rate that all its rows agree on, or a conflict."""
    s = F.struct("upstream_group", "multiplier", F.when(F.col("discount") == 0, 1.0).otherwise(F.col("discount")).alias("discount"))
    rows = costs.groupBy("channel_id").agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    conflict = F.col("lo") != F.col("hi")
    return rows.select("channel_id", conflict.alias("conflict"), F.when(~conflict, F.col("lo.upstream_group")).alias("upstream_group"), F.when(~conflict, F.col("lo.multiplier")).alias("multiplier"), F.when(~conflict, F.col("lo.discount")).alias("discount"))


def prices(keys: DataFrame, exact: DataFrame, canonical: DataFrame, by_domain: DataFrame) -> DataFrame:
    """(channel_id, grp, domain) with the price found first: of the pair, of the channel, of the domain and group."""
    a = exact.select("channel_id", "grp", F.struct("multiplier", "discount").alias("p1"))
    b = canonical.select("channel_id", F.when(~F.col("conflict"), F.struct("multiplier", "discount")).alias("p2"))
    c = by_domain.select("domain", "grp", F.struct("multiplier", "discount").alias("p3"))
    rows = keys.join(a, ["channel_id", "grp"], "left").join(b, "channel_id", "left").join(c, ["domain", "grp"], "left")
    from_ = F.when(F.col("p1").isNotNull(), "pair").when(F.col("p2").isNotNull(), "channel").when(F.col("p3").isNotNull(), "domain").otherwise("none")
    best = F.coalesce("p1", "p2", "p3")
    return rows.select(*keys.columns, from_.alias("price_from"), best["multiplier"].alias("multiplier"), best["discount"].alias("discount"))


#: The range of numbers that a price may be made of.
LEAST_NUMBER, MOST_NUMBER = 1e-9, 1e9


def valid_number(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & x.between(LEAST_NUMBER, MOST_NUMBER), F.lit(False))


def as_of(rows: DataFrame, keys: list[str], at: int, time: str = "effective_at") -> DataFrame:
    """Of each key the row in force at a moment: the latest that took effect by then; of equal times the larger row."""
    values = [c for c in rows.columns if c not in keys]
    best = F.max(F.struct(time, *(c for c in values if c != time))).alias("v")
    inside = rows.where(F.col(time) <= at)
    return (inside.groupBy(*keys).agg(best) if keys else inside.agg(best).where("v is not null")).select(*keys, "v.*")


def price_views(pairs: DataFrame, site_groups: DataFrame, domain_groups: DataFrame, channel_costs: DataFrame, domains: DataFrame, settings: DataFrame, at: int) -> DataFrame:
    """The whole price of each (channel_id, grp, domain) at a moment: what was configured, where it came from, and what it makes.

    ``site_groups`` (grp, multiplier), ``domain_groups`` (domain, grp, multiplier, discount), ``channel_costs`` (channel_id,
    grp, upstream_group, multiplier, discount), ``domains`` (domain, paid, credit) and ``settings`` (fx, paid, credit) are
    histories with ``effective_at``. The upstream rate is that of the pair, else the one that all rows of the channel agree
    on (in conflict there is none, which is told), else that of domain and group. A discount of 0 is 1.
    """
    one = F.when(F.col("discount") == 0, 1.0).otherwise(F.col("discount"))
    rate = lambda df: F.struct("multiplier", one.alias("discount"), (F.trim("upstream_group") if "upstream_group" in df.columns else F.lit("")).alias("upstream_group"))
    costs, groups = as_of(channel_costs, ["channel_id", "grp"], at), as_of(domain_groups, ["domain", "grp"], at)
    agreed = costs.groupBy("channel_id").agg(F.min(rate(costs)).alias("lo"), F.max(rate(costs)).alias("hi"))
    agreed = agreed.select("channel_id", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("p2"), (F.col("lo") != F.col("hi")).alias("conflict"))
    rows = pairs.join(costs.select("channel_id", "grp", rate(costs).alias("p1")), ["channel_id", "grp"], "left").join(agreed, "channel_id", "left")
    rows = rows.join(groups.select("domain", "grp", rate(groups).alias("p3")), ["domain", "grp"], "left")
    rows = rows.join(as_of(site_groups, ["grp"], at).select("grp", F.col("multiplier").alias("site")), "grp", "left")
    rows = rows.join(as_of(domains, ["domain"], at).select("domain", F.struct("paid", "credit").alias("d")), "domain", "left")
    rows = rows.join(F.broadcast(as_of(settings, [], at).select(F.struct("fx", "paid", "credit").alias("c"))), how="left")  # one row
    best = F.coalesce("p1", "p2", "p3")
    come = F.when(F.col("p1").isNotNull(), "pair").when(F.col("p2").isNotNull(), "channel").when(F.col("p3").isNotNull(), "domain").otherwise("none")
    m, discount, site = best["multiplier"], best["discount"], F.col("site")
    bought = valid_number(m) & valid_number(discount) & valid_number(F.col("d.paid")) & valid_number(F.col("d.credit"))
    effective = F.when(bought, m * discount * F.col("d.paid") / F.col("d.credit"))
    mine, theirs = site * (F.col("c.paid") / F.col("c.credit")) / F.col("c.fx"), effective / F.col("c.fx")
    complete = valid_number(site) & valid_number(effective) & valid_number(F.col("c.fx")) & valid_number(F.col("c.paid")) & valid_number(F.col("c.credit")) & (mine > 0)
    when = lambda c: F.when(complete, c)
    return rows.select(
        *pairs.columns, come.alias("price_from"), F.coalesce("conflict", F.lit(False)).alias("conflict"), site.isNotNull().alias("site_configured"), best.isNotNull().alias("upstream_configured"), site.alias("site_multiplier"),
        m.alias("multiplier"), discount.alias("discount"), best["upstream_group"].alias("upstream_group"), effective.alias("effective"), (site - effective).alias("gap"), when(mine).alias("site_discount"),
        when(theirs).alias("upstream_discount"), when((mine - theirs) / mine).alias("margin"), F.coalesce(complete, F.lit(False)).alias("complete"))


def rate_config(channels: DataFrame, channel_costs: DataFrame) -> DataFrame:
    """(domain, enabled, configured, complete): whether each enabled channel of a domain has an agreed rate with a group's name.

    ``channels`` has domain, channel_id, status and current; the domain's recharge is no part of this.
    """
    agreed = canonical_rates(channel_costs.withColumn("upstream_group", F.trim("upstream_group"))).where(~F.col("conflict") & (F.col("upstream_group") != "") & valid_number(F.col("multiplier")) & valid_number(F.col("discount")))
    rows = channels.where("current and status = 1").join(agreed.select("channel_id", F.lit(True).alias("set")), "channel_id", "left")
    sums = rows.groupBy("domain").agg(F.count("*").alias("enabled"), F.count("set").alias("configured"))
    return channels.select("domain").distinct().join(sums, "domain", "left").fillna(0, ["enabled", "configured"]).withColumn("complete", (F.col("enabled") > 0) & (F.col("enabled") == F.col("configured")))


def finance(multiplier: Column, discount: Column, paid: Column, credit: Column, site: Column, site_paid: Column, site_credit: Column, fx: Column) -> dict[str, Column]:
    """Effective multiplier, gap, discounts and margin; null where an input is missing or not positive."""
    ok = lambda *c: [x > 0 for x in c]
    every = lambda conds: F.coalesce(conds[0] if len(conds) == 1 else conds[0] & every(conds[1:]), F.lit(False))
    factor = F.when(discount == 0, 1.0).otherwise(discount)
    effective = F.when(every(ok(multiplier, factor, paid, credit)), multiplier * factor * paid / credit)
    complete = every([*ok(multiplier, factor, paid, credit, site, site_paid, site_credit, fx)])
    mine, theirs = site * (site_paid / site_credit) / fx, effective / fx
    return {"effective": effective, "gap": site - effective, "site_discount": F.when(complete, mine), "upstream_discount": F.when(complete, theirs), "margin": F.when(complete, (mine - theirs) / mine), "complete": complete}


#: What is told of a group without a name, of internal tests without a price, and of those without a cost basis.
UNNAMED_GROUP, UNPRICED_TEST, UNMARKED_TEST = "未标记服务分组", "内部测试渠道 #%d", "内部测试渠道 #%d 成本口径未标记"


def burn(facts: DataFrame, rates: DataFrame, proven_hours: DataFrame, days: float, tests: DataFrame | None = None, version: int = 5) -> DataFrame:
    """Daily upstream cost per domain over the proven hours, and what lacks a price.

    User traffic costs its quota times the upstream rate over the site's. Internal tests (``tests``, with a cost_basis)
    bring no revenue but use up the upstream balance: their quota is the base price, or contains the site's rate already
    ('legacy_after_group'), which is then taken out. A test without a known basis or rate is listed by its channel.
    Facts, tests and hours count if they are of one class version (``traffic_class_version``; a table without that
    column is of it). Domains and groups are trimmed, those of the rates too.
    """
    of_version = lambda df: df.where(F.col("traffic_class_version") == version) if "traffic_class_version" in df.columns else df
    tidy = lambda df: df.withColumn("grp", F.trim(F.coalesce("grp", F.lit(""))))
    proven = of_version(proven_hours).where("status = 'complete'").select("hour_ts").distinct()
    columns = ["hour_ts", "domain", "channel_id", "grp", "quota", "basis"]
    rows = of_version(facts).withColumn("basis", F.lit("user")).select(columns)
    if tests is not None:
        rows = rows.unionByName(of_version(tests).withColumn("basis", F.coalesce("cost_basis", F.lit(""))).select(columns))
    rows = tidy(rows).withColumn("domain", F.trim("domain")).where("domain <> '' and quota > 0").join(proven, "hour_ts", "left_semi")
    rows = rows.groupBy("domain", "channel_id", "grp", "basis").agg(F.sum("quota").alias("quota"))  # a few rows a channel from here on
    rows = rows.join(tidy(rates.select("channel_id", "grp", "upstream", "site")), ["channel_id", "grp"], "left")
    user, based = F.col("basis") == "user", F.col("basis") == "legacy_assumed_base"
    bought, sold = F.coalesce(F.col("upstream") > 0, F.lit(False)), F.coalesce(F.col("site") > 0, F.lit(False))
    known = user | based | (F.col("basis") == "legacy_after_group")
    priced = known & bought & (based | sold)
    cost = S.usd(F.col("quota")) * F.col("upstream") / F.when(based, 1.0).otherwise(F.col("site"))
    name = F.when(F.col("grp") == "", UNNAMED_GROUP).otherwise(F.col("grp"))
    lacks = F.when(user, name).when(known, F.format_string(UNPRICED_TEST, "channel_id")).otherwise(F.format_string(UNMARKED_TEST, "channel_id"))
    hours = proven.agg(F.count("*").alias("hours"))
    sums = rows.groupBy("domain").agg(F.coalesce(F.sum(F.when(priced, cost)), F.lit(0.0)).alias("cost"), F.array_join(F.sort_array(F.collect_set(F.when(~priced, lacks))), ",").alias("missing_groups"))
    return sums.crossJoin(F.broadcast(hours)).select("domain", F.when(F.col("hours") > 0, F.col("cost") / F.col("hours") * 24).otherwise(0.0).alias("daily_cost_usd"), "missing_groups")


def runway(rows: DataFrame, now: int, days: float = 1.0, least_coverage: float = 95.0, sync_minutes: int = 10, least_cost: float = 0.01) -> DataFrame:
    """What the balance is good for: unavailable, idle, critical, warning or healthy, with the first reason that applies."""
    age = max(30 * 60, sync_minutes * 180)
    left = F.greatest(F.lit(0.0), F.col("balance_usd") / F.nullif(F.col("daily_cost_usd"), F.lit(0.0)))
    reason = (F.when(~F.col("configured"), "not configured").when(~F.col("enabled"), "disabled").when(F.col("status") != "ok", "sync status").when(F.lit(now) - F.coalesce("last_success_at", F.lit(0)) > age, "stale")
              .when(F.col("balance_usd").isNull(), "no balance").when(F.col("coverage_pct") + 1e-9 < least_coverage, "coverage").when(F.col("missing_groups") != "", "unpriced groups"))
    status = F.when(reason.isNotNull(), "unavailable").when(F.col("daily_cost_usd") < least_cost, "idle").when(F.col("balance_usd") <= 0, "critical").when(left <= days, "warning").otherwise("healthy")
    return rows.select("domain", status.alias("runway_status"), reason.alias("reason"), F.when(status.isin("critical", "warning", "healthy"), left).alias("runway_days"))


def latest_version(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("domain").orderBy(F.desc("version"))
    return versions.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def catalog_changes(before: DataFrame, after: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Groups added, removed or with another ratio."""
    rows = before.select("grp", F.col("ratio").alias("was")).join(after.select("grp", F.col("ratio").alias("is")), "grp", "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.abs(F.col("is") - F.col("was")) > tolerance, "changed")
    return rows.select("grp", kind.alias("change")).where("change is not null")


def website_rates(catalog: DataFrame, site_rates: DataFrame) -> DataFrame:
    """Active groups of the catalogue, each with the site's own rate if one is configured, else with 0."""
    rates = site_rates.select("grp", F.col("multiplier").alias("site_multiplier"))
    rows = catalog.where("active").select("grp", "source_multiplier", "synced_at").join(rates, "grp", "left")
    return rows.select(F.col("grp").alias("name"), "source_multiplier", "synced_at", F.col("site_multiplier").isNotNull().alias("site_configured"), F.coalesce("site_multiplier", F.lit(0.0)).alias("site_multiplier"))


def registrable(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host) with its registrable domain: one label more than the longest public suffix; addresses stay whole."""
    parts = F.split("host", r"\.")
    tails = hosts.select("host").distinct().select("host", F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts)))).alias("from"))
    tails = tails.withColumn("suffix", F.array_join(F.slice(F.split("host", r"\."), F.col("from"), F.lit(64)), "."))
    best = tails.join(suffixes.select("suffix").distinct(), "suffix").groupBy("host").agg(F.min("from").alias("from"))
    address = F.col("host").rlike(r"^[0-9.]+$|^\[")
    return hosts.join(best, "host", "left").withColumn("domain", F.when(address | F.col("from").isNull(), F.col("host")).otherwise(F.array_join(F.slice(F.split("host", r"\."), F.col("from") - 1, F.lit(64)), "."))).drop("from")


def missing_from(ids: DataFrame, snapshot: DataFrame, key: str = "channel_id") -> DataFrame:
    """Ids that a snapshot does not have."""
    return ids.select(key).distinct().join(snapshot.select(key).distinct(), key, "left_anti")
