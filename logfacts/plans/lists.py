"""Registered queries of dimensions, scopes, lists and reports that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators import audit, board, channels, edge, filters, rollup, stability, upstream, usage
from logfacts.plans import testmap as T
from logfacts.plans.queries import DAY_SQL, EDGE, HOURS, NOW, SINCE, _hours, _lines, _usage, query, rounded
from logfacts.sources import tables

# --- channels -----------------------------------------------------------------------------------------------------

_KINDS = (1, 14, 24, 43, 58, 28)
_NAMES = ("OpenAI", "Anthropic", "Gemini", "DeepSeek", channels.UNLABELLED, channels.UNLABELLED)


def _source_channels(spark, d):
    """Channels with blanks, repeats, nulls and whole URLs."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 6 + 1).cast("int"))
    return T.read(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 7 == 0, F.lit(None)).otherwise(F.col("s_name")).alias("name"), kind.alias("type"), F.when(k % 4 == 3, 2).otherwise(1).alias("status"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit(" grp-1,,grp-"), (k % 3).cast("string"), F.lit(" , grp-1"))).alias("groups"), F.lit("m-b, m-a ,").alias("models"),
        F.concat(F.lit("HTTPS://Api.D"), (k % 4).cast("string"), F.lit(".Example.com:8443/v1?key=x")).alias("base_url"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE s_name END AS name, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END AS vendor, 'api.d' || (s_suppkey % 4) || '.example.com' AS base_host, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'grp-1' WHEN s_suppkey % 3 = 0 THEN 'grp-0,grp-1' ELSE 'grp-1,grp-2' END AS groups, 'm-a,m-b' AS models FROM supplier")
def s4_cleaned_channels(spark, d):
    return channels.cleaned(_source_channels(spark, d)).select("id", "name", "vendor", "base_host", "groups", "models")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END AS vendor FROM supplier")
def f17_vendor_of_type(spark, d):
    return _source_channels(spark, d).select("id", channels.vendor_of(F.col("type")).alias("vendor"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'legacy_tiered' ELSE 'legacy_base' END AS origin, CASE l_linenumber % 4 WHEN 1 THEN 'single' WHEN 2 THEN 'all' ELSE 'legacy' END AS scope,
  CASE l_orderkey % 4 WHEN 0 THEN 'legacy_assumed_base' WHEN 1 THEN 'legacy_after_group' WHEN 2 THEN 'unsupported' ELSE 'legacy_assumed_base' END AS cost_basis FROM lineitem""")
def p3_normal_labels(spark, d):
    """Stored labels of all kinds, among them unknown, blank and null ones."""
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = T.read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(n % 3 == 0, "legacy_tiered").when(n % 3 == 1, "manual").otherwise(F.lit(None)).alias("origin"), F.when(n % 4 == 1, "single").when(n % 4 == 2, "all").when(n % 4 == 3, "").otherwise("one").alias("scope"),
        F.when(o % 4 == 0, "").when(o % 4 == 1, "legacy_after_group").when(o % 4 == 2, "v9").otherwise(F.lit(None)).alias("cost_basis"))
    return rows.withColumns(C.normal_labels())


@query(T.LOGS + ", " + T.CHANNELS + """, c AS (SELECT id, base_domain, 'grp-' || (id % 3) || ',extra' AS groups FROM channels WHERE id % 4 <> 2), seen AS (SELECT DISTINCT base_domain AS domain, grp FROM logs JOIN c ON c.id = channel_id WHERE type = 2 AND grp <> 'grp-4'),
l AS (SELECT DISTINCT base_domain AS domain, unnest(['grp-' || (id % 3), 'extra']) AS grp FROM c) SELECT coalesce(l.domain, seen.domain) AS domain, coalesce(l.grp, seen.grp) AS grp, l.grp IS NOT NULL AS configured FROM l FULL JOIN seen ON l.domain = seen.domain AND l.grp = seen.grp""")
def u11_groups_of_domains(spark, d):
    c = T.channels(spark, d).where("id % 4 <> 2").withColumn("groups", F.concat(F.lit(" grp-"), (F.col("id") % 3).cast("string"), F.lit(",extra,")))
    facts = T.logs(spark, d).where("type = 2").select("channel_id", F.concat("grp", F.lit(" ")).alias("grp"), F.when(F.col("grp") == "grp-4", 4).otherwise(5).alias("traffic_class_version"))
    return channels.groups_of_domains(facts, c)


@query("WITH " + T.CHANNELS + ", v AS (SELECT base_domain AS domain, count(*) AS versions, max(id) AS latest FROM channels WHERE base_domain <> 'domain-1.test' GROUP BY 1) SELECT DISTINCT base_domain AS domain, coalesce(versions, 0) AS versions, coalesce(latest, 0) AS latest FROM channels LEFT JOIN v ON v.domain = base_domain")
def u11_versions(spark, d):
    c = T.channels(spark, d)
    versions = c.where("base_domain <> 'domain-1.test'").select(F.concat(F.lit(" "), "base_domain").alias("domain"), F.col("id").alias("version"))
    return channels.version_counts(versions, c.select(F.col("base_domain").alias("domain")))


# --- scopes and reports -------------------------------------------------------------------------------------------


@query(HOURS + ", " + T.CHANNELS + f" SELECT h.hour_ts, CAST(sum(success) AS BIGINT) AS success FROM hours h JOIN channels ON id = channel_id WHERE vendor = 'vendor-1' AND hour_ts >= {SINCE} AND hour_ts < {NOW} GROUP BY 1")
def p5_vendor_scope(spark, d):
    rows = filters.of_vendor(filters.in_scope(_hours(spark, d), SINCE, NOW), T.channels(spark, d), "vendor-1")
    return rows.groupBy("hour_ts").agg(F.sum("success").alias("success"))


@query(HOURS + ", " + T.REJECTIONS + """, ledger AS (SELECT DISTINCT hour_ts, CASE WHEN hour_ts // 3600 % 4 = 0 THEN 4 ELSE 5 END AS v, CASE WHEN hour_ts // 3600 % 5 = 0 THEN 'running' ELSE 'complete' END AS status FROM hours),
cover AS (SELECT hour_ts FROM ledger WHERE v = 5 AND status = 'complete' UNION SELECT hour_ts FROM hours WHERE hour_ts // 3600 % 20 = 0)
SELECT bucket_ts // 3600 * 3600 AS hour_ts, CAST(sum(count) AS BIGINT) AS n FROM rejections WHERE bucket_ts // 3600 * 3600 IN (SELECT hour_ts FROM cover) GROUP BY 1""")
def p10_covered_hours(spark, d):
    """Hours that are neither complete under the version nor have a sample do not count."""
    hours, n = _hours(spark, d).select("hour_ts").distinct(), F.expr("hour_ts div 3600")
    ledger = hours.withColumns({"traffic_class_version": F.when(n % 4 == 0, 4).otherwise(5), "status": F.when(n % 5 == 0, "running").otherwise("complete")})
    rows = stability.covered_rejections(T.rejections(spark, d), ledger, hours.where(n % 20 == 0))
    return rows.groupBy("hour_ts").agg(F.sum("count").alias("n"))


@query(HOURS + ", " + T.REJECTIONS + f" SELECT 'all' AS scope, (SELECT CAST(sum(success) AS BIGINT) FROM hours) AS success, (SELECT CAST(sum(count) AS BIGINT) FROM rejections) AS rejected UNION ALL SELECT 'channel', CAST(sum(success) AS BIGINT), 0 FROM hours WHERE channel_id = 3")
def a23_rejections_in_scope(spark, d):
    """Without a filter, and under one by channel, where rejections are no part of the report."""
    hours, rejections = _hours(spark, d), T.rejections(spark, d)
    rows = stability.with_rejections(hours, rejections).withColumn("scope", F.lit("all")).unionByName(stability.with_rejections(filters.in_scope(hours, 0, 1 << 40, channel_id=3), rejections, channel=3).withColumn("scope", F.lit("channel")))
    return rows.groupBy("scope").agg(F.sum("success").alias("success"), F.sum("rejected").alias("rejected"))


@query(HOURS + ", " + T.CHANNELS + " SELECT grp, channel_id, model_name, CAST(sum(success) AS BIGINT) AS success, CAST(sum(failed) AS BIGINT) AS failed, name AS channel_name, vendor, status, true AS known FROM hours JOIN channels ON id = channel_id WHERE vendor = 'vendor-2' GROUP BY ALL")
def a19_dimensions_of_vendor(spark, d):
    rows = stability.by_dimension(_hours(spark, d), T.channels(spark, d), "vendor-2")
    return rows.select("grp", "channel_id", "model_name", "success", "failed", "channel_name", "vendor", "status", "known")


_EDGE = """CAST(sum(count) AS BIGINT) AS requests, """ + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE status // 100 = {c}), 0) AS BIGINT) AS n_{c}xx" for c in (2, 3, 4, 5)) + ", round(sum(time_sum_ms) / CAST(sum(count) AS DOUBLE), 6) AS avg_ms, max(time_max_ms) AS max_ms, CAST(sum(bytes_sent) AS BIGINT) AS bytes, round(sum(with_id) * 100.0 / sum(count), 6) AS id_coverage"


@query(EDGE + f" SELECT {DAY_SQL.format('bucket_ts')} AS date_ts, {_EDGE} FROM edge GROUP BY 1")
def a36_edge_days(spark, d):
    return rounded(edge.by_day(edge.minutes(edge.parse(_lines(spark, d)))))


@query(EDGE + f" SELECT {_EDGE} FROM edge")
def a36_edge_total(spark, d):
    return rounded(edge.report(edge.minutes(edge.parse(_lines(spark, d)))))


_PATHS = ", routes AS (SELECT '/v1/' || (user_id % 90) AS route, k FROM logs)"


@query(T.LOGS + _PATHS + """ SELECT route AS name, count(*) AS requests, count(*) FILTER (WHERE k % 4 = 2) AS n_4xx, count(*) FILTER (WHERE k % 4 = 3) AS n_5xx, round(sum(k * 3) / CAST(count(*) AS DOUBLE), 6) AS avg_ms FROM routes GROUP BY 1 ORDER BY requests DESC, route LIMIT 50""")
def a36_edge_routes(spark, d):
    """The 50 of up to 90 routes with the most requests."""
    k = F.col("k")
    facts = T.logs(spark, d).select(F.concat(F.lit("/v1/"), (F.col("user_id") % 90).cast("string")).alias("route"), (200 + k % 4 * 100).alias("status"), F.lit(1).alias("count"), (k * 3).alias("time_sum_ms"), (k * 3).alias("time_max_ms"), k.alias("bytes_sent"), F.lit(1).alias("with_id"))
    return rounded(edge.breakdown(facts, "route"))


_OPEN = SINCE + 5 * 3600
_FULL = (_OPEN + S.ZONE) // S.DAY * S.DAY - S.ZONE


@query(T.USAGE + f" SELECT user_id, {DAY_SQL.format('hour_ts')} AS date_ts, CAST(sum(requests) AS BIGINT) AS requests FROM usage WHERE hour_ts < {_OPEN} GROUP BY ALL")
def j6_open_day(spark, d):
    """Day facts and proofs of all days are there, that of the open day too, of which only the hours before the end may show."""
    hours = _usage(spark, d)
    days = rollup.daily_from_hours(hours)
    view = filters.fact_view(days.where("user_id % 2 = 0"), hours, days.where("user_id % 3 = 0").where(F.col("date_ts") == _FULL).select("user_id", "date_ts"), _OPEN)
    return view.groupBy("user_id", "date_ts").agg(F.sum("requests").alias("requests"))


# --- lists --------------------------------------------------------------------------------------------------------


@query(T.USAGE + """, t AS (SELECT user_id, token_id, max(token_name) AS name, CAST(sum(consume_quota) AS BIGINT) AS consume_quota, token_id % 3 = 0 AS deleted, CASE WHEN token_id % 2 = 0 THEN token_id END AS total_quota FROM usage GROUP BY ALL)
SELECT user_id, token_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY deleted, consume_quota DESC, coalesce(total_quota, 0) DESC, name, token_id) AS INTEGER) AS rank FROM t""")
def t5_token_order(spark, d):
    rows = _usage(spark, d).groupBy("user_id", "token_id").agg(F.max("token_name").alias("name"), F.sum("consume_quota").alias("consume_quota"))
    rows = rows.withColumns({"deleted": F.col("token_id") % 3 == 0, "total_quota": F.when(F.col("token_id") % 2 == 0, F.col("token_id"))})
    return usage.ordered_tokens(rows).select("user_id", "token_id", "rank")


@query(T.LOGS + """, a AS (SELECT id, created_at AS ts, CASE k % 4 WHEN 0 THEN 'infra_cpu' WHEN 1 THEN 'infra_disk_FAILED' WHEN 2 THEN 'infraX' ELSE 'error_rate' END AS kind, 'host-' || (user_id % 5) AS target, content AS detail FROM logs WHERE type = 5),
n AS (SELECT * FROM a WHERE starts_with(kind, 'infra_') ORDER BY ts DESC, id DESC LIMIT 20) SELECT ts, regexp_replace(kind, '_FAILED$', '') AS kind, target, detail, CASE WHEN kind LIKE '%FAILED' THEN 'warn' ELSE 'bad' END AS status FROM n WHERE target <> 'host-2'""")
def t7_infra_alerts(spark, d):
    k = F.col("k")
    kind = F.when(k % 4 == 0, "infra_cpu").when(k % 4 == 1, "infra_disk_FAILED").when(k % 4 == 2, "infraX").otherwise("error_rate")
    rows = T.logs(spark, d).where("type = 5").select("id", F.col("created_at").alias("ts"), kind.alias("kind"), F.concat(F.lit("host-"), (F.col("user_id") % 5).cast("string")).alias("target"), F.col("content").alias("detail"))
    return board.recent_alerts(rows, ["host-2"])


@query(T.LOGS + f""", s AS (SELECT user_id, created_at // 3600 * 3600 AS hour_ts, count(*) AS source_rows, count(*) // 3 + 1 AS pages, max(created_at) + 60 AS updated_at, CASE WHEN user_id % 4 = 0 THEN 'running' ELSE 'complete' END AS status FROM logs GROUP BY 1, 2),
m AS (SELECT max(updated_at) + 30 AS now FROM s) SELECT count(*) AS hours, count(*) FILTER (WHERE status = 'complete') AS complete, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(source_rows) AS BIGINT) AS source_rows,
  count(*) FILTER (WHERE status = 'complete' AND updated_at >= now - 900) AS recent_hours, coalesce(max(now) - min(updated_at) FILTER (WHERE status = 'complete' AND updated_at >= now - 900), 0) AS recent_seconds FROM s, m""")
def a44_page_totals(spark, d):
    rows = T.logs(spark, d).groupBy("user_id", S.bucket("created_at", 3600).alias("hour_ts")).agg(F.count("*").alias("source_rows"), (F.max("created_at") + 60).alias("updated_at"))
    rows = rows.withColumns({"pages": F.floor(F.col("source_rows") / 3) + 1, "status": F.when(F.col("user_id") % 4 == 0, "running").otherwise("complete")})
    newest = T.logs(spark, d).agg(F.max("created_at")).first()[0] or 0
    return usage.page_totals(rows, newest + 90)


@query(T.LOGS + """, x AS (SELECT id, type, quota, k, k % 2 = 0 AS is_stream, k % 29 = 0 AS bare FROM logs) SELECT id, CASE WHEN is_stream AND NOT bare AND k > 0 THEN k * 150 END AS first_byte_ms, CASE WHEN bare THEN 0 ELSE k END AS cache_read_tokens,
  CASE WHEN bare THEN 0 WHEN k % 3 = 0 THEN 7 WHEN k % 3 = 1 THEN 12 ELSE 9 END AS cache_write_tokens, CASE WHEN type = 2 THEN round(quota / 500000.0, 9) END AS cost_usd FROM x""")
def f11_exposed(spark, d):
    """Streams and others, writes in parts, in one part, and whole, and rows without details."""
    k = F.col("k")
    other = F.to_json(F.struct((k * 150).cast("double").alias("frt"), k.alias("cache_tokens"), F.lit(9).alias("cache_creation_tokens"), F.when(k % 3 == 0, 7).when(k % 3 == 1, 2).alias("cache_creation_tokens_5m"), F.when(k % 3 == 1, 10).alias("cache_creation_tokens_1h")))
    rows = T.logs(spark, d).withColumns({"other": F.when(k % 29 == 0, "{no json").otherwise(other), "is_stream": k % 2 == 0})
    return rounded(upstream.exposed(rows), 9)


_COLS = ("user_id", "channel_id", "grp", "model_name", "token_id", "requests", "consume_quota")
_ROW = " || '|' || ".join(f"strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in _COLS)


@query(T.USAGE + f", h AS (SELECT hour_ts, CAST('0x' || substr(sha256({_ROW}), 1, 15) AS BIGINT) AS h FROM usage) SELECT hour_ts, count(*) AS rows, sha256(concat_ws(':', count(*), bit_xor(h), CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR))) AS digest FROM h GROUP BY 1")
def f23_fact_digests(spark, d):
    return audit.fact_digests(_usage(spark, d), ["hour_ts"], list(_COLS))


@query(T.USAGE + f" SELECT user_id, min(hour_ts) AS first, count(*) AS rows FROM usage WHERE user_id % 5 = 0 AND hour_ts >= {SINCE - 2 * 86400} AND hour_ts < {SINCE} GROUP BY 1")
def q5_facts_in_empty_ranges(spark, d):
    facts = _usage(spark, d)
    empty = facts.select("user_id").distinct().where("user_id % 5 = 0").select("user_id", F.lit(SINCE - 2 * S.DAY).alias("from_ts"), F.lit(SINCE).alias("to_ts"))
    return audit.facts_in_empty_ranges(facts, empty)


# --- merging ------------------------------------------------------------------------------------------------------

_KEYS = ("signature_hash", "channel_id")


@query(T.LOGS + """, e AS (SELECT channel_id, model_name AS signature_hash, created_at, use_time, k % 50 = 0 AS truncated FROM logs WHERE type = 5)
SELECT signature_hash, channel_id, count(*) AS count, min(created_at) AS first_ts, max(created_at) AS last_ts, max(use_time) AS largest, bool_or(truncated) AS truncated FROM e GROUP BY 1, 2""")
def s11_merge_rules(spark, d):
    """Five batches merged one after another: counts add up, first and last and flags combine."""
    rows = T.logs(spark, d).where("type = 5").select("id", "channel_id", F.col("model_name").alias("signature_hash"), "created_at", "use_time", (F.col("k") % 50 == 0).alias("truncated"))
    sums = lambda df: df.groupBy(*_KEYS).agg(F.count("*").alias("count"), F.min("created_at").alias("first_ts"), F.max("created_at").alias("last_ts"), F.max("use_time").alias("largest"), F.bool_or("truncated").alias("truncated"))
    merged = sums(rows.where("id % 5 = 0"))
    for i in range(1, 5):
        merged = tables.merge_additive(merged, sums(rows.where(f"id % 5 = {i}")), list(_KEYS), ["count"], ["last_ts", "largest"], ["first_ts"], ["truncated"])
    return merged


@query(T.LOGS + """, u AS (SELECT user_id, CAST(sum(quota) FILTER (WHERE type = 2) AS BIGINT) AS used_quota FROM logs GROUP BY 1) SELECT user_id, coalesce(used_quota, 0) AS used_quota, 'user-' || (user_id % 7) AS name FROM u ORDER BY coalesce(used_quota, 0) DESC, name, user_id LIMIT 30""")
def t5_members_by_use(spark, d):
    rows = T.logs(spark, d).groupBy("user_id").agg(F.coalesce(F.sum(F.when(F.col("type") == 2, F.col("quota"))), F.lit(0)).cast("long").alias("used_quota"))
    return usage.ordered_members(rows.withColumn("name", F.concat(F.lit("user-"), (F.col("user_id") % 7).cast("string"))), 30)
