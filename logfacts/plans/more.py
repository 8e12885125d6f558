"""Further registered queries: dimensions, upstream bills, coverage, orderings, scalar functions, integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators import audit, board, channels, edge, evidence, filters, kpi, problems, rollup, stability, upstream, usage
from logfacts.plans import testmap as T
from logfacts.plans.queries import DAY_SQL, EDGE, EV, HOURS, NOW, SINCE, SIGNS, _evidence, _hours, _lines, _kpi, _minutes, _proofs, _PROOF, _usage, KPI_SQL, query, rounded, sums, ORACLES, QUERIES  # noqa: F401
from logfacts.sources import tables


@query("WITH " + T.CHANNELS + " SELECT id, name, vendor, status, enabled_since, base_domain FROM channels")
def s4_channels(spark, d):
    return T.channels(spark, d)


@query("SELECT c_custkey AS id, c_name AS username, CASE c_custkey % 4 WHEN 0 THEN '***' WHEN 2 THEN 'sk-12****78' ELSE 'sk-' || left(c_name, 4) || '**********' || right(c_name, 4) END AS masked FROM customer")
def s5_profiles(spark, d):
    c = T.read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), S.masked_key(F.when(F.col("c_custkey") % 4 == 0, "123").when(F.col("c_custkey") % 4 == 2, "12345678").otherwise(F.col("c_name"))).alias("masked"))


@query(T.LOGS + f""", t AS (SELECT unnest(range({NOW - 40 * 86400}, {NOW + 10 * 86400}, 3600)) AS hour_ts), s AS (SELECT created_at // 3600 * 3600 AS hour_ts, count(*) AS n, sum(k) AS tk, sum(quota) AS q FROM logs WHERE created_at >= {NOW - 40 * 86400} AND created_at < {NOW + 10 * 86400} GROUP BY 1)
SELECT t.hour_ts, coalesce(n, 0) AS requests, CAST(coalesce(tk, 0) AS BIGINT) AS tokens, CAST(coalesce(q, 0) AS BIGINT) AS quota, round(coalesce(q, 0) / 500000.0, 6) AS cost_usd FROM t LEFT JOIN s ON s.hour_ts = t.hour_ts""")
def a13_upstream_hours(spark, d):
    items = T.logs(spark, d).select(F.col("created_at").alias("at"), F.col("k").alias("tokens"), "quota")
    return rounded(upstream.hours(items, NOW - 40 * S.DAY, NOW + 10 * S.DAY, 500000.0))


@query("SELECT o_custkey AS key, o_custkey % 2 = 0 AS balanced, CAST(o_orderkey AS VARCHAR) AS date, CAST(o_orderkey % 50 AS DOUBLE) AS cost, CAST(1 AS BIGINT) AS requests FROM orders WHERE o_custkey % 5 <> 0")
def s8_daily_documents(spark, d):
    o = T.read(spark, d, "orders")
    day = F.struct(F.col("o_orderkey").cast("string").alias("date"), (F.col("o_orderkey") % 50).cast("double").alias("cost"), F.lit(1).cast("long").alias("requests"))
    docs = o.groupBy(F.col("o_custkey").alias("key")).agg(F.collect_list(day).alias("daily"), F.sum((F.col("o_orderkey") % 50).cast("double")).alias("t"))
    body = F.to_json(F.struct((F.col("t") + F.col("key") % 2).alias("total"), "daily"))
    return upstream.daily_documents(docs.select("key", F.when(F.col("key") % 5 == 0, "junk").otherwise(body).alias("body"))).where("date is not null")


@query("SELECT o_orderkey // 100 AS hour_ts, round(sum(o_totalprice), 2) AS cost_usd FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) = 3 AND count(DISTINCT CASE WHEN o_orderkey // 100 % 4 = 0 THEN o_orderkey % 2 ELSE 0 END) = 1")
def a35_publish(spark, d):
    o = T.read(spark, d, "orders")
    hour = F.floor(F.col("o_orderkey") / 100).cast("long")
    staged = o.select(hour.alias("hour_ts"), (F.col("o_orderkey") % 3).alias("key"), F.when(hour % 4 == 0, F.col("o_orderkey") % 2).otherwise(0).alias("bucket_seconds"), F.col("o_totalprice").cast("double").alias("cost_usd"))
    return rounded(upstream.publish(staged, staged.select("key")), 2)


@query("SELECT s_nationkey AS domain, s_suppkey % 3 AS provider, round(sum(s_acctbal), 2) AS cost_usd, CAST(sum(3600) AS BIGINT) AS seconds, CAST(max(s_suppkey * 3600 + 3600) AS BIGINT) AS until FROM supplier WHERE s_suppkey % 3 <> 2 GROUP BY ALL")
def a33_by_domain(spark, d):
    s = T.read(spark, d, "supplier")
    rows = s.select(F.col("s_nationkey").alias("domain"), (F.col("s_suppkey") % 3).alias("provider"), F.col("s_acctbal").cast("double").alias("cost_usd"), F.lit(3600).cast("long").alias("bucket_seconds"), (F.col("s_suppkey") * 3600).cast("long").alias("hour_ts"))
    return rounded(upstream.by_domain(rows, rows.where("provider <> 2").select("domain", "provider")), 2)


@query("SELECT DISTINCT n_name AS grp, CAST(n_regionkey AS DOUBLE) AS ratio FROM nation WHERE n_regionkey > 0")
def u6_group_names(spark, d):
    n = T.read(spark, d, "nation").select(F.concat(F.lit(" "), "n_name").alias("grp"), F.trim("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("ratio"))
    return upstream.group_names([n.where("ratio < 3"), n, n.select(F.lit(" ").alias("grp"))], n.select(F.col("name").alias("grp"), "ratio"))


@query(HOURS + f" SELECT greatest({SINCE}, min(hour_ts) + 86400) AS from_ts, greatest(greatest({SINCE}, min(hour_ts) + 86400), least({NOW + 86400 * 30}, max(hour_ts) + 3600)) AS to_ts, min(hour_ts) + 86400 > {SINCE} OR max(hour_ts) + 3600 < {NOW + 86400 * 30} AS partial FROM hours")
def p14_read_range(spark, d):
    cover = _hours(spark, d).agg((F.min("hour_ts") + S.DAY).alias("first_full_day"), (F.max("hour_ts") + 3600).alias("ready_through"))
    return upstream.read_range(cover, SINCE, NOW + S.DAY * 30)


@query("SELECT c_custkey AS user_id, c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 <> 0 AS publishable FROM customer")
def q7_publishable(spark, d):
    k = F.col("c_custkey")
    rows = T.read(spark, d, "customer").select(k.alias("user_id"), F.when(k % 4 != 0, 100).alias("through"), F.when(k % 3 == 0, 4).otherwise(5).alias("classification_version"), F.lit(1).alias("query_semantics_version"), F.when(k % 7 == 0, "old").otherwise("e").alias("source_epoch"))
    return upstream.publishable(rows, 5, 1, "e", 100)


@query(EDGE + f""", v AS (SELECT bucket_ts, node, route, method, status, upstream_status, bucket_ts BETWEEN {NOW - 8 * 86400} AND {NOW + 300} AND bucket_ts % 420 <> 0 AND bucket_ts % 660 <> 0 AND NOT (bucket_ts % 780 = 0 AND upstream_sum_ms > 0) AND bucket_ts % 1020 <> 0 AS valid FROM edge)
SELECT * FROM v""")
def p16_valid_samples(spark, d):
    rows = edge.minutes(edge.parse(_lines(spark, d)))
    t = F.col("bucket_ts")
    faults = {"time_max_ms": F.when(t % 420 == 0, F.col("time_sum_ms") + 1).otherwise(F.col("time_max_ms")), "with_id": F.when(t % 660 == 0, F.col("count") + 1).otherwise(F.col("with_id")), "upstream_count": F.when(t % 780 == 0, 0).otherwise(F.col("upstream_count")), "bytes_sent": F.when(t % 1020 == 0, -1).otherwise(F.col("bytes_sent"))}
    return rows.withColumns(faults).select("bucket_ts", "node", "route", "method", "status", "upstream_status", edge.valid_sample(NOW).alias("valid"))


@query(EV + " SELECT event_id, outcome FROM e WHERE event_type = 'request_outcome' AND outcome NOT IN ('succeeded', 'user_cancelled') ORDER BY occurred_at_ms DESC, event_id DESC LIMIT 100")
def t7_latest_failures(spark, d):
    return evidence.latest_failures(_evidence(spark, d)).select("event_id", "outcome")


@query(EV + " SELECT event_id, event_type, outcome FROM e WHERE logical = 'l77'")
def t8_timeline(spark, d):
    return evidence.timeline(_evidence(spark, d), "l77").select("event_id", "event_type", "outcome")


@query(T.MINUTES + ", g AS (SELECT grp, sum(success + anomaly + failed) AS n FROM minutes GROUP BY 1) SELECT grp, CAST(n AS BIGINT) AS requests, row_number() OVER (ORDER BY n DESC, grp) AS rank FROM g")
def t4_ranking(spark, d):
    rows = _minutes(spark, d).groupBy("grp").agg(F.sum(kpi.total()).alias("requests"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("requests"), "grp")).cast("long"))  # one row per group


@query(T.MINUTES + f", s AS (SELECT CAST(channel_id AS VARCHAR) AS key, sum(quota) AS q FROM minutes GROUP BY 1) SELECT count(*) > 7 AS truncated, least(count(*), 7) AS n FROM (SELECT * FROM s ORDER BY q DESC LIMIT 8)")
def t2_truncation(spark, d):
    held = _minutes(spark, d).groupBy("channel_id").agg(F.sum("quota").alias("q")).orderBy(F.desc("q")).limit(8)
    return held.agg((F.count("*") > 7).alias("truncated"), F.least(F.count("*"), F.lit(7)).alias("n"))


@query(T.MINUTES + f" SELECT bucket_ts // 3600 * 3600 AS hour_ts, CAST(sum(success) AS BIGINT) AS success FROM minutes WHERE bucket_ts >= {SINCE} GROUP BY 1")
def t9_hour_series(spark, d):
    return rollup.site_hours(_minutes(spark, d)).where(F.col("hour_ts") >= SINCE).orderBy("hour_ts").select("hour_ts", "success")


@query(T.USAGE + """, t AS (SELECT user_id, sum(consume_quota - refund_quota) AS q FROM usage GROUP BY 1) SELECT c_custkey AS user_id, c_name AS username, n_name AS company, CAST(coalesce(q, 0) AS BIGINT) AS net_quota, CAST(c_acctbal AS DOUBLE) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN t ON user_id = c_custkey""")
def j13_member_matrix(spark, d):
    c, n = T.read(spark, d, "customer"), F.broadcast(T.read(spark, d, "nation"))  # nations are a fixed list
    rows = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), F.col("n_name").alias("company"), F.col("c_acctbal").cast("double").alias("balance"))
    return usage.member_rows(rows, _usage(spark, d))


@query(f"WITH {_PROOF} SELECT user_id, count(*) AS hours, round(count(*) * 100.0 / 40, 6) AS progress FROM p GROUP BY 1")
def a44_proof_progress(spark, d):
    return rounded(usage.proof_progress(_proofs(spark, d), 40))


@query(SIGNS + " SELECT count(DISTINCT bucket_ts) AS minutes, CAST(sum(count) AS BIGINT) AS rows, max(last_ts) AS newest FROM sg")
def a27_problem_coverage(spark, d):
    return problems.minute_coverage(problems.signatures(problems.error_rows(T.logs(spark, d))))


@query(HOURS + ", " + T.REJECTIONS + """, cover AS (SELECT DISTINCT hour_ts FROM hours WHERE hour_ts // 3600 % 3 = 0) SELECT bucket_ts // 3600 * 3600 AS hour_ts, CAST(sum(count) AS BIGINT) AS n FROM rejections WHERE bucket_ts // 3600 * 3600 IN (SELECT hour_ts FROM cover) GROUP BY 1""")
def p10_rejection_coverage(spark, d):
    cover = _hours(spark, d).select("hour_ts").where("hour_ts div 3600 % 3 = 0").distinct()
    rows = T.rejections(spark, d).withColumn("hour_ts", S.bucket("bucket_ts", 3600)).join(cover, "hour_ts", "left_semi")
    return rows.groupBy("hour_ts").agg(F.sum("count").alias("n"))


@query(T.LOGS + """ SELECT id, round((prompt_tokens - least(k, prompt_tokens)) * 1.5 * 2 / 1000000, 9) AS input_usd, round(least(k, prompt_tokens) * 1.5 * 2 / 1000000 * 0.1, 9) AS cached_usd, round(completion_tokens * 1.5 * 2 / 1000000 * 4, 9) AS output_usd,
  round(((prompt_tokens - least(k, prompt_tokens)) * 1.5 * 2 / 1000000 + least(k, prompt_tokens) * 1.5 * 2 / 1000000 * 0.1 + completion_tokens * 1.5 * 2 / 1000000 * 4) * 0.8, 9) AS cost_usd FROM logs WHERE type = 2""")
def f10_log_costs(spark, d):
    other = F.concat(F.lit('{"model_ratio":1.5,"completion_ratio":4,"cache_ratio":0.1,"group_ratio":0.8,"cache_tokens":'), F.col("k").cast("string"), F.lit("}"))
    return rounded(upstream.log_costs(T.logs(spark, d).where("type = 2").withColumn("other", other)).drop("creation_usd"), 9)


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_partkey % 5 + 1 END AS cache, CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 10 + p_partkey % 7 END AS settled FROM part")
def f11_cache_and_settlement(spark, d):
    k = F.col("p_partkey")
    rows = T.read(spark, d, "part").select(k.alias("id"), F.when(k % 3 != 0, k % 5 + 1).alias("cache_5m"), F.lit(0).alias("cache_1h"), F.col("p_size").alias("cache_total"), F.when(k % 4 == 0, F.col("p_size")).alias("consumed"), F.lit(10).alias("pre"), (k % 7).alias("delta"))
    return rows.select("id", upstream.cache_split().alias("cache"), upstream.settled().alias("settled"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google' WHEN 3 THEN 'openai' WHEN 4 THEN 'deepseek' ELSE 'other' END AS provider, CASE p_partkey % 6 WHEN 0 THEN 'Claude-x' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'gemini-1' WHEN 3 THEN 'my-codex' WHEN 4 THEN 'DeepSeek-v3' ELSE 'qwen' END AS base FROM part""")
def f17_providers(spark, d):
    names = F.array(*map(F.lit, ("Claude-x", "gpt-4", "gemini-1", "my-codex", "DeepSeek-v3", "qwen")))
    rows = T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")), F.when(F.col("p_partkey") % 2 == 0, "-20250101").otherwise("")).alias("m"))
    return rows.select("id", S.provider(F.col("m")).alias("provider"), F.regexp_replace("m", r"-\d{8}$", "").alias("base"))


@query(HOURS + ", " + T.CHANNELS + """, v AS (SELECT grp, list_sort(list(DISTINCT vendor)) AS vs FROM hours LEFT JOIN channels ON id = channel_id AND channel_id % 2 = 0 GROUP BY 1) SELECT grp, CASE len(list_filter(vs, lambda x: x IS NOT NULL)) WHEN 0 THEN '' WHEN 1 THEN list_filter(vs, lambda x: x IS NOT NULL)[1] ELSE 'several' END AS vendor FROM v""")
def f19_vendor_label(spark, d):
    c = T.channels(spark, d).where("id % 2 = 0").select(F.col("id").alias("channel_id"), "vendor")
    rows = _hours(spark, d).join(c, "channel_id", "left").groupBy("grp").agg(F.sort_array(F.collect_set("vendor")).alias("vs"))
    return rows.select("grp", F.when(F.size("vs") == 0, "").when(F.size("vs") == 1, F.get("vs", 0)).otherwise("several").alias("vendor"))


@query(T.USAGE + f", a AS (SELECT DISTINCT user_id, {DAY_SQL.format('hour_ts')} AS date_ts FROM usage) SELECT user_id, count(*) AS days FROM a WHERE date_ts < {SINCE} AND user_id % 5 = 0 GROUP BY 1")
def q5_known_empty(spark, d):
    """Members proven to have nothing before a day, with the days that contradict it."""
    days = rollup.daily_from_hours(_usage(spark, d)).where(F.col("date_ts") < SINCE).select("user_id", "date_ts").distinct()
    empty = days.select("user_id").distinct().where("user_id % 5 = 0")
    return days.join(empty, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("days"))


@query(T.USAGE + f" SELECT {DAY_SQL.format('hour_ts')} AS date_ts, user_id, CAST(sum(requests) AS BIGINT) AS requests_a, CAST(sum(requests) + 1 AS BIGINT) AS requests_b FROM usage WHERE user_id % 7 = 3 GROUP BY 1, user_id, channel_id, grp, model_name, token_id")
def q3_day_is_sum_of_hours(spark, d):
    """Days agree with their hours but for the members in whose hours a fault is planted."""
    fault = F.when(F.col("user_id") % 7 == 3, 1).otherwise(0)
    keys, values = ["date_ts", *rollup.USAGE_KEYS], list(rollup.USAGE_MEASURES)
    return rollup.differences(_usage(spark, d, "day"), rollup.daily_from_hours(_usage(spark, d)).withColumn("requests", F.col("requests") + fault), keys, values).select("date_ts", "user_id", "requests_a", "requests_b")


@query(T.USAGE + " SELECT count(*) AS differing FROM usage WHERE user_id % 10 = 3")
def q4_proofs_match_facts(spark, d):
    """Hours whose digest differs from the one proven: here those whose facts were changed."""
    facts = _usage(spark, d)
    columns = ["user_id", "hour_ts", "channel_id", "grp", "model_name", "token_id", "requests", "consume_quota"]
    keys = ["user_id", "hour_ts", "channel_id", "grp", "model_name", "token_id"]
    proven = audit.digests(facts.withColumn("requests", F.col("requests") + F.when(F.col("user_id") % 10 == 3, 1).otherwise(0)), keys, columns).withColumnRenamed("digest", "proven")
    return audit.digests(facts, keys, columns).join(proven, keys).where("digest <> proven").agg(F.count("*").alias("differing"))


@query(HOURS + f" SELECT max(hour_ts) + 3600 AS ready_through, {NOW + 86400 * 30} - max(hour_ts) - 3600 AS behind, {NOW + 86400 * 30} > max(hour_ts) + 3600 AS stale FROM hours")
def q8_staleness(spark, d):
    until = NOW + S.DAY * 30
    rows = _hours(spark, d).agg((F.max("hour_ts") + 3600).alias("ready_through"))
    return audit.staleness(rows, until)


@query(T.LOGS + ", " + T.CHANNELS + " SELECT DISTINCT base_domain AS domain, grp FROM logs JOIN channels ON id2 = channel_id UNION SELECT 'domain-0.test', 'extra'".replace("id2", "channels.id"))
def u11_domain_groups(spark, d):
    c = T.channels(spark, d).select(F.col("id").alias("channel_id"), F.col("base_domain").alias("domain"))
    seen = T.logs(spark, d).join(c, "channel_id").select("domain", "grp")
    return seen.union(spark.createDataFrame([("domain-0.test", "extra")], seen.schema)).distinct()


@query(HOURS + ", b AS (SELECT DISTINCT channel_id FROM hours), n AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) SELECT channel_id FROM b WHERE channel_id NOT IN (SELECT s_suppkey FROM n)")
def u5_missing_set(spark, d):
    now = T.read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("channel_id"))
    return channels.missing_from(_hours(spark, d), now)


@query(T.LOGS + ", " + T.REJECTIONS + " SELECT bucket_ts, node, substr(reason, 1, 64) AS reason, model, grp, count FROM rejections WHERE reason <> 'reason-3' AND bucket_ts % 7 <> 0")
def p18_clean_rejections(spark, d):
    from logfacts.sources.tables import clean_rejections

    rows = T.rejections(spark, d).withColumn("count", F.col("count").cast("int"))
    rows = rows.withColumns({"model": F.when(F.col("bucket_ts") % 7 == 0, "").otherwise(F.col("model")), "reason": F.when(F.col("reason") != "reason-3", F.col("reason"))})
    return clean_rejections(rows)


@query(HOURS + f" SELECT hour_ts, grp, channel_id, {sums('success')} FROM hours WHERE hour_ts >= {SINCE} AND hour_ts < {NOW} AND grp = 'grp-1' AND channel_id = 3 GROUP BY ALL")
def p5_scope(spark, d):
    rows = filters.in_scope(_hours(spark, d), SINCE, NOW, grp="grp-1", channel_id=3, model_name=None)
    return rows.groupBy("hour_ts", "grp", "channel_id").agg(F.sum("success").alias("success"))


@query(HOURS + f", s AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, grp, channel_id, {sums('success', 'anomaly', 'failed')} FROM hours GROUP BY ALL) SELECT date_ts, grp, channel_id, CAST(success + anomaly + failed AS BIGINT) AS requests FROM s")
def a21_days_by_channel(spark, d):
    return stability.by_day(stability.with_rejections(_hours(spark, d)), "grp", "channel_id").select("date_ts", "grp", "channel_id", "requests")


@query(T.USAGE + f" SELECT user_id, CAST(sum(requests) AS BIGINT) AS requests FROM usage WHERE hour_ts >= {SINCE} AND hour_ts < {NOW} GROUP BY 1 ORDER BY sum(consume_quota) DESC, user_id LIMIT 20")
def t5_members(spark, d):
    rows = usage.totals(filters.in_scope(_usage(spark, d), SINCE, NOW), "user_id")
    return rows.orderBy(F.desc("consume_quota"), "user_id").limit(20).select("user_id", "requests")


# --- costs, repair, readings -------------------------------------------------------------------------------------


@query(T.LOGS + """, p AS (SELECT *, k % 7 AS form, k % 3 AS own, k * 2 AS cache, k // 2 AS w, 2.0 * 1.5 / 1000000 AS price FROM logs WHERE type = 2), x AS (SELECT id, own, form IN (0, 1, 2, 3) AS ok,
  CASE WHEN form IN (1, 2) THEN prompt_tokens ELSE greatest(prompt_tokens - cache, 0) END * price AS input_usd, CASE WHEN form = 3 THEN 0 ELSE cache * 0.1 END * price AS cached_usd,
  CASE form WHEN 1 THEN w * 1.25 WHEN 2 THEN w * 1.25 + w * 2.0 ELSE 0 END * price AS creation_usd, completion_tokens * price * CASE WHEN form = 3 THEN 0 ELSE 4 END AS output_usd FROM p)
SELECT id, """ + ", ".join(f"CASE WHEN ok THEN round({c}, 9) END AS {c}" for c in ("input_usd", "cached_usd", "creation_usd", "output_usd")) + ", CASE WHEN ok THEN round((input_usd + cached_usd + creation_usd + output_usd) * CASE own WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 ELSE 0 END, 9) END AS cost_usd FROM x")
def f10_cost_forms(spark, d):
    """Plain, Claude with whole and with split writes, without ratios, tiered, task not settled, price per request."""
    form, own, cache, w = F.col("k") % 7, F.col("k") % 3, F.col("k") * 2, F.floor(F.col("k") / 2)
    known = form != 3
    other = F.to_json(F.struct(
        F.lit(1.5).alias("model_ratio"), cache.alias("cache_tokens"), F.when(known, 0.1).alias("cache_ratio"), F.when(known, 4.0).alias("completion_ratio"), form.isin(1, 2).alias("claude"),
        w.alias("cache_creation_tokens"), F.lit(1.25).alias("cache_creation_ratio"), F.when(form == 2, w).alias("cache_creation_tokens_5m"), F.lit(1.25).alias("cache_creation_ratio_5m"), F.when(form == 2, w).alias("cache_creation_tokens_1h"), F.lit(2.0).alias("cache_creation_ratio_1h"),
        F.when(form == 4, "tiered_expr").alias("billing_mode"), F.when(form == 5, "t1").alias("task_id"), F.when(form == 5, -1.0).when(form == 6, 0.02).alias("model_price"), F.when(own == 0, 0.5).alias("user_group_ratio"), F.when(own < 2, 0.8).alias("group_ratio")))
    return rounded(upstream.log_costs(T.logs(spark, d).where("type = 2").withColumn("other", other)), 9)


@query(T.TRAFFIC + ", " + T.CHANNELS + f""", hours AS (SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, grp, {T.measures_sql('quota')} FROM traffic GROUP BY ALL), p AS (SELECT DISTINCT hour_ts FROM hours WHERE hour_ts // 3600 % 3 <> 0),
t AS (SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, grp, sum(quota) AS quota FROM logs WHERE type = 2 AND token_name = 'probe' AND content = 'probe' GROUP BY ALL),
u AS (SELECT base_domain AS domain, CASE WHEN grp <> 'grp-4' THEN quota / 500000.0 * 0.5 / 2.0 END AS cost, CASE WHEN grp = 'grp-4' AND quota > 0 THEN grp END AS lacks FROM hours JOIN p USING (hour_ts) JOIN channels ON id = channel_id
  UNION ALL SELECT base_domain, CASE WHEN grp <> 'grp-4' THEN CASE channel_id % 3 WHEN 0 THEN quota / 500000.0 / 2.0 * 0.5 WHEN 1 THEN quota / 500000.0 * 0.5 END END,
    CASE WHEN quota > 0 THEN CASE WHEN channel_id % 3 = 2 THEN '内部测试渠道 #' || channel_id || ' 成本口径未标记' WHEN grp = 'grp-4' THEN '内部测试渠道 #' || channel_id END END FROM t JOIN p USING (hour_ts) JOIN channels ON id = channel_id)
SELECT domain, round(coalesce(sum(cost), 0) / (SELECT count(*) FROM p) * 24, 6) AS daily_cost_usd, coalesce(string_agg(DISTINCT lacks, ',' ORDER BY lacks), '') AS missing_groups FROM u GROUP BY 1""")
def a34_burn_with_tests(spark, d):
    c = T.channels(spark, d).select(F.col("id").alias("channel_id"), F.col("base_domain").alias("domain"))
    user, tests = (x.join(c, "channel_id") for x in rollup.direct_hours(T.logs(spark, d), T.RULES))
    tests = tests.withColumn("cost_basis", F.when(F.col("channel_id") % 3 == 0, "legacy_after_group").when(F.col("channel_id") % 3 == 2, "").otherwise(F.col("cost_basis")))
    ledger = _hours(spark, d).select("hour_ts").distinct().where("hour_ts div 3600 % 3 <> 0").withColumn("status", F.lit("complete"))
    rates = user.select("channel_id", "grp").union(tests.select("channel_id", "grp")).distinct().where("grp <> 'grp-4'").withColumns({"upstream": F.lit(0.5), "site": F.lit(2.0)})
    return rounded(channels.burn(user, rates, ledger, 10, tests))


LATE = f"created_at < {SINCE}"


@query(T.TRAFFIC + f""", late AS (SELECT DISTINCT created_at // 3600 * 3600 AS h FROM logs WHERE k % 17 = 0 AND {LATE}), r AS (SELECT *, created_at // 3600 * 3600 AS hour_ts FROM traffic)
SELECT hour_ts, channel_id, model_name, grp, {T.measures_sql(*rollup.HOUR_MEASURES)} FROM r WHERE hour_ts IN (SELECT h FROM late) OR k % 17 <> 0 GROUP BY ALL""")
def r3_late_repair(spark, d):
    """Facts made before every 17th row came, with the hours of some late rows made again."""
    logs = T.logs(spark, d)
    stored = rollup.direct_hours(logs.where("k % 17 <> 0"), T.RULES)[0]
    hours = logs.where("k % 17 = 0").where(LATE).select(S.bucket("created_at", 3600).alias("hour_ts"))
    return rollup.repaired(stored, logs, hours, T.RULES)


@query(T.TRAFFIC + f""", old AS (SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, model_name, grp, {T.measures_sql('success', 'failed')} FROM traffic WHERE k % 17 <> 0 GROUP BY ALL),
fresh AS (SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, model_name, grp, {T.measures_sql('success', 'failed')} FROM traffic GROUP BY ALL)
SELECT *, 4 AS traffic_class_version FROM old WHERE hour_ts // 3600 % 4 <> 0 UNION ALL SELECT *, 5 FROM fresh WHERE hour_ts // 3600 % 4 = 0 OR (hour_ts // 3600 % 2 = 0 AND hour_ts NOT IN (SELECT hour_ts FROM old))""")
def q9_reclassification(spark, d):
    """A new version for every second hour, signed for every fourth: the older rows show until an hour is signed."""
    logs = T.logs(spark, d)
    stored = rollup.direct_hours(logs.where("k % 17 <> 0"), T.RULES)[0].withColumn("traffic_class_version", F.lit(4))
    hours = logs.select(S.bucket("created_at", 3600).alias("hour_ts")).where("hour_ts div 3600 % 2 = 0").distinct()
    ledger = hours.where("hour_ts div 3600 % 4 = 0").withColumns({"status": F.lit("complete"), "traffic_class_version": F.lit(5)})
    rows = filters.effective(rollup.reclassified(stored, logs, hours, 5, T.RULES), ledger)
    return rows.select("hour_ts", "channel_id", "model_name", "grp", "success", "failed", "traffic_class_version")


@query("SELECT 'g' || p_partkey AS name, CAST(p_size AS DOUBLE) AS source_multiplier, CAST(p_partkey * 60 AS BIGINT) AS synced_at, p_partkey % 3 = 0 AS site_configured, CASE WHEN p_partkey % 3 = 0 THEN 1.5 * p_size ELSE 0 END AS site_multiplier FROM part WHERE p_partkey % 4 <> 3")
def j20_website_rates(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("grp"), F.col("p_size").cast("double").alias("source_multiplier"), (F.col("p_partkey") * 60).cast("long").alias("synced_at"), (F.col("p_partkey") % 4 != 3).alias("active"))
    return channels.website_rates(p, p.where("p_partkey % 3 = 0").select("grp", (F.col("source_multiplier") * 1.5).alias("multiplier")))


@query("SELECT DISTINCT 'g' || (p_partkey % 6) AS grp, p_brand AS model FROM part WHERE p_partkey % 2 = 0")
def s13_full_replace(spark, d):
    path = tables.shared_folder(spark)
    p = T.read(spark, d, "part")
    pairs = lambda rows: rows.select(F.concat(F.lit("g"), (F.col("p_partkey") % 6).cast("string")).alias("grp"), F.col("p_brand").alias("model")).distinct()
    tables.replace_all(pairs(p), path)
    tables.replace_all(pairs(p.where("p_partkey % 2 = 0")), path)
    return spark.read.parquet(path)


_EVENT = ["id", "created_at", "user_id", "channel_id", "token_id", "type", "prompt_tokens", "completion_tokens", "quota", "grp", "model_name", "token_name"]
_EVENT_SQL = " || '|' || ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in _EVENT)


@query(T.LOGS + f""", h AS (SELECT user_id, CAST('0x' || substr(sha256({_EVENT_SQL}), 1, 15) AS BIGINT) AS h, user_id % 9 = 4 AND quota > 0 AS fault FROM logs WHERE type IN (2, 6))
SELECT user_id, count(*) AS events, bit_xor(h) AS mixed, CAST(sum(h) AS VARCHAR) AS added, NOT bool_or(fault) AS agreed FROM h GROUP BY 1""")
def f24_two_readings(spark, d):
    """Raw events of each member read by hours and by days; the second reading meets other amounts for some members."""
    events = T.logs(spark, d).where("type in (2, 6)")
    first = audit.fold_pages(audit.event_pages(events.withColumn("page", S.bucket("created_at", 3600)), ["user_id", "page"], _EVENT), ["user_id"])
    changed = events.withColumn("quota", F.col("quota") + F.when((F.col("user_id") % 9 == 4) & (F.col("quota") > 0), 1).otherwise(0))
    second = audit.fold_pages(audit.event_pages(changed.withColumn("page", S.day("created_at")), ["user_id", "page"], _EVENT), ["user_id"])
    return first.join(audit.agreed(first, second, ["user_id"]), "user_id").withColumn("added", F.col("added").cast("string"))


_ELIGIBLE = f"""e AS (SELECT c_custkey AS user_id, c_custkey % 33 AS ef0, least(30, c_custkey % 33) AS ef, c_acctbal AS balance, c_nationkey AS group_id FROM customer),
f AS (SELECT e.user_id, (hour_ts - {NOW - 30 * 86400}) // 86400 AS ix, sum((consume_quota - refund_quota) / 500000.0) AS usd FROM usage JOIN e ON e.user_id = usage.user_id WHERE hour_ts >= {NOW - 30 * 86400} AND hour_ts < {NOW} AND (hour_ts - {NOW - 30 * 86400}) // 86400 >= ef GROUP BY ALL),
g AS (SELECT user_id, sum(usd) AS spend, coalesce(sum(usd) FILTER (WHERE ix >= 23), 0) AS last7, coalesce(sum(usd) FILTER (WHERE ix >= 16 AND ix < 23), 0) AS prev7, max(ix) FILTER (WHERE usd > 0) AS active FROM f GROUP BY 1),
i AS (SELECT e.*, 30 - ef AS days, coalesce(spend, 0) AS spend, coalesce(last7, 0) AS last7, coalesce(prev7, 0) AS prev7, coalesce(29 - active, 30 - ef) AS idle FROM e LEFT JOIN g ON g.user_id = e.user_id),
j AS (SELECT *, days >= 14 AND idle >= 14 AS dormant, coalesce(balance < 1, false) AS low FROM i), k AS (SELECT *, NOT dormant AND days >= 14 AND prev7 > 0 AND last7 < prev7 * 0.7 AS fell FROM j),
m AS (SELECT *, CASE WHEN dormant OR fell OR low THEN CASE WHEN dormant THEN 50 WHEN fell THEN 35 ELSE 0 END + CASE WHEN low THEN 45 ELSE 0 END + floor(spend) END AS urgency FROM k)"""


@query(T.USAGE + ", " + _ELIGIBLE + """, c AS (SELECT group_id, count(urgency) AS members, round(coalesce(sum(spend) FILTER (WHERE urgency IS NOT NULL), 0), 6) AS spend_usd, false AS without_members, CAST(floor(coalesce(sum(spend) FILTER (WHERE urgency IS NOT NULL), 0)) + sum(urgency) AS BIGINT) AS urgency FROM m GROUP BY 1)
SELECT * FROM c WHERE members > 0 UNION ALL SELECT n_nationkey, 0, 0, true, 20 FROM nation WHERE n_nationkey NOT IN (SELECT group_id FROM m) UNION ALL SELECT 1000, 0, 0, true, 20""")
def a46_companies(spark, d):
    c = T.read(spark, d, "customer")
    balances = c.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("balance_usd"), (F.col("c_custkey") % 33).alias("eligible_from"))
    members = c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("group_id"))
    companies = T.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"))
    companies = companies.union(spark.createDataFrame([(1000,)], companies.schema))  # one without members
    return rounded(usage.by_company(usage.follow_ups(_usage(spark, d), NOW, balances), members, companies))


_BOARD = ORACLES["a41_board"]


@query(_BOARD.replace("\nSELECT grp, model_name", ", b AS (SELECT grp, model_name", 1) + """), e AS (SELECT DISTINCT 'grp-' || (s_suppkey % 4) AS grp, 'model-' || (s_suppkey % 9) AS model_name FROM supplier WHERE s_suppkey % 4 <> 3)
SELECT coalesce(b.grp, e.grp) AS grp, coalesce(b.model_name, e.model_name) AS model_name, CASE WHEN e.grp IS NOT NULL THEN uptime END AS uptime, CASE WHEN e.grp IS NOT NULL THEN p50 END AS p50, CASE WHEN e.grp IS NULL THEN 'down' ELSE coalesce(state, 'up') END AS state FROM b FULL JOIN e ON b.grp = e.grp AND b.model_name = e.model_name""")
def a41_board_with_channels(spark, d):
    """Pairs without enabled channels are down, whatever their traffic was."""
    k = F.col("s_suppkey")
    snaps = T.read(spark, d, "supplier").select(k.alias("id"), F.when(k % 4 == 3, 2).otherwise(1).alias("status"), F.concat(F.lit("grp-"), (k % 4).cast("string")).alias("groups"), F.concat(F.lit("model-"), (k % 9).cast("string")).alias("models"))
    return rounded(board.totals(_minutes(spark, d), NOW, channels.channel_counts(snaps)))


@query(T.LOGS + " SELECT id, CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL ELSE content END AS content, CASE k % 7 WHEN 0 THEN 'bad' WHEN 1 THEN 'warn' WHEN 2 THEN CASE k % 3 WHEN 0 THEN 'bad' WHEN 1 THEN 'warn' ELSE 'ok' END ELSE 'warn' END AS status FROM logs")
def f13_scrub_f22_containers(spark, d):
    k = F.col("k")
    text = F.when(k % 5 == 0, F.concat("content", F.lit("渠道ID: 7"))).when(k % 5 == 1, F.lit(None)).otherwise(F.col("content"))
    state = F.when(k % 7 == 0, "Exited ").when(k % 7 == 1, "paused").when(k % 7 == 2, "running").when(k % 7 == 3, "odd")
    health = F.when(k % 3 == 0, "unhealthy").when(k % 3 == 1, "??").otherwise("none")
    return T.logs(spark, d).select("id", S.scrubbed(text).alias("content"), board.container_status(state, health).alias("status"))


# --- key figures of what is shown, searches, caps ------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT DISTINCT grp, model_name AS model FROM logs WHERE k % 33 = 0 AND user_id % 7 = 0)"
_SHOWN = T.MINUTES + ", " + T.CHANNELS + ", " + _PAIRS + f""", shown AS (SELECT * FROM minutes m WHERE bucket_ts >= {SINCE} AND NOT EXISTS (SELECT 1 FROM channels c WHERE c.id = m.channel_id AND (c.status <> 1 OR m.bucket_ts < c.enabled_since))
  AND (NOT EXISTS (SELECT 1 FROM pairs) OR EXISTS (SELECT 1 FROM pairs p WHERE p.grp = m.grp AND p.model = m.model_name)))"""


def _shown(spark, d):
    pairs = T.logs(spark, d).where("k % 33 = 0 and user_id % 7 = 0").select("grp", F.col("model_name").alias("model")).distinct()
    return kpi.shown(_minutes(spark, d, SINCE), T.channels(spark, d), pairs)


@query(_SHOWN + f", s AS (SELECT {sums(*T.MEASURES)} FROM shown) SELECT {KPI_SQL.lstrip(' ,')} FROM s")
def a8_summary_shown(spark, d):
    return _kpi(kpi.summary(_shown(spark, d), SINCE, 864000))


@query(_SHOWN + f", s AS (SELECT grp AS key, {sums(*T.MEASURES)} FROM shown GROUP BY 1) SELECT key {KPI_SQL} FROM s ORDER BY quota_sum DESC, total DESC, key LIMIT 200")
def a9_top_group_shown(spark, d):
    return _kpi(kpi.top(_shown(spark, d), "grp", SINCE, 864000), "key")


@query(_SHOWN + f" SELECT model_name AS key, bucket_ts // 14400 * 14400 AS ts, {sums('success', 'anomaly', 'failed')} FROM shown GROUP BY ALL")
def f28_sparklines_shown(spark, d):
    return kpi.series(_shown(spark, d), "model_name", SINCE, 864000)


@query(T.LOGS + f" SELECT id FROM logs WHERE created_at >= {SINCE} AND created_at < {NOW} AND grp = 'grp-1' AND NOT (type = 2 AND token_name = 'probe' AND content = 'probe' AND k % 37 <> 0) AND (k % 37 = 0 OR k % 31 = 0)")
def p11_search_details(spark, d):
    """A search for the fee notice: in contents, and in the details of rows that say nothing of it."""
    k = F.col("k")
    rows = T.logs(spark, d, SINCE, NOW).withColumn("other", F.when(k % 31 == 0, F.lit('{"violation_fee_code":"x"}')).otherwise(F.col("other")))
    rows = rows.withColumn("content", F.when(k % 37 == 0, F.concat("content", F.lit(usage.FEE_WORD))).otherwise(F.col("content")))
    return usage.search(rows, SINCE, NOW, content=usage.FEE_WORD, group="grp-1", rules=T.RULES).select("id")


@query(T.USAGE + ", s AS (SELECT model_name, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(consume_quota) AS BIGINT) AS consume_quota FROM usage GROUP BY 1) SELECT *, (SELECT count(*) > 5 FROM s) AS truncated FROM s ORDER BY consume_quota DESC, model_name LIMIT 5")
def a16_models_capped(spark, d):
    by = _usage(spark, d).groupBy("model_name").agg(F.sum("requests").alias("requests"), F.sum("consume_quota").alias("consume_quota"))
    return usage.capped(by, 5, F.desc("consume_quota"), F.col("model_name"))


_DAYS = (NOW - 1 + 28800) // 86400 - (SINCE + 28800) // 86400 + 1


@query(f"SELECT count(DISTINCT c_custkey) AS members, CAST({_DAYS} AS BIGINT) AS days, count(DISTINCT c_custkey) * {_DAYS} AS cells, count(DISTINCT c_custkey) * {_DAYS} > 20000 AS over FROM customer")
def t2_cell_budget(spark, d):
    return usage.cell_budget(T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), SINCE, NOW)


# --- sources of group names, infrastructure ------------------------------------------------------------------------


@query("""WITH n AS (SELECT n_name, n_nationkey AS i, n_regionkey AS r FROM nation), names AS (SELECT n_name AS grp FROM n WHERE r < 3 UNION SELECT CASE i % 5 WHEN 0 THEN n_name || '_s' WHEN 2 THEN n_name WHEN 4 THEN 'append_x' END FROM n UNION SELECT n_name || '_c' FROM n WHERE i % 6 = 0)
SELECT grp, CASE WHEN r > 0 THEN CAST(r AS DOUBLE) END AS ratio, coalesce(r > 0, false) AS priced, (SELECT count(*) FROM names LEFT JOIN n ON n_name = grp WHERE grp IS NOT NULL AND NOT coalesce(r > 0, false)) AS skipped FROM names LEFT JOIN n ON n_name = grp WHERE grp IS NOT NULL""")
def u6_group_sources(spark, d):
    n, i, name = T.read(spark, d, "nation"), F.col("n_nationkey"), F.col("n_name")
    key = F.when(i % 5 == 0, F.concat(F.lit(" +: "), name, F.lit("_s"))).when(i % 5 == 1, F.concat(F.lit("-:"), name)).when(i % 5 == 2, F.concat(F.lit("append_"), i.cast("string"))).when(i % 5 == 3, F.concat(name, F.lit("_k"))).otherwise("append_x")
    special = n.select(key.alias("key"), F.when(i % 5 == 2, name).when(i % 5 == 3, " Remove").when(i % 5 == 4, "nowhere").alias("description"))
    ratios = n.select(name.alias("grp"), F.col("n_regionkey").cast("double").alias("ratio"))
    usable, configured = n.where("n_regionkey < 3").select(F.concat(F.lit(" "), name).alias("grp")), n.where("n_nationkey % 6 = 0").select(F.concat(name, F.lit("_c ")).alias("grp"))
    found = upstream.group_sources(usable, special, configured, ratios)
    return found.crossJoin(F.broadcast(found.agg(F.count_if(~F.col("priced")).alias("skipped"))))


_METRICS = ("cpu", "mem_total_mb", "mem_avail_mb", "reachable", "status_code", "latency_ms", "cert_days", "locked", "via_cdn")
_SNAP = T.LOGS + f""", i AS (SELECT created_at * 100000 + id AS ts, 'r' || (user_id % 40) AS resource, CASE user_id % 40 % 5 WHEN 0 THEN 'database' WHEN 1 THEN 'lb' WHEN 2 THEN CASE WHEN id % 2 = 0 THEN 'host' ELSE 'instance' END WHEN 3 THEN 'probe' ELSE 'lock' END AS rtype, id % 9 AS m,
  CAST(CASE id % 9 WHEN 1 THEN 100 WHEN 3 THEN CASE WHEN k % 10 = 0 THEN 0 ELSE 1 END WHEN 4 THEN CASE WHEN k > 95 THEN 502 ELSE 200 END WHEN 5 THEN k * 8 WHEN 7 THEN k % 2 WHEN 8 THEN CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END ELSE k END AS DOUBLE) AS v FROM logs WHERE user_id % 40 <> 3),
w AS (SELECT resource, coalesce(max(rtype) FILTER (WHERE rtype <> 'host'), 'instance') AS rtype, max(ts) AS newest, {", ".join(f"max_by(v, ts) FILTER (WHERE m = {i}) AS {n}" for i, n in enumerate(_METRICS))} FROM i GROUP BY 1),
c AS (SELECT 'r' || (s_suppkey % 40) AS resource, bool_or(s_suppkey % 40 % 15 = 2) AS bad, bool_or(s_suppkey % 40 % 15 = 7) AS warn FROM supplier GROUP BY 1),
s AS (SELECT w.resource, rtype, newest, greatest(0, {NOW * 100000} - (newest + 60)) AS age, CASE rtype WHEN 'database' THEN CASE WHEN cpu > 85 THEN 'bad' WHEN cpu > 70 THEN 'warn' ELSE 'ok' END WHEN 'lb' THEN 'ok' WHEN 'lock' THEN CASE WHEN locked >= 1 THEN 'ok' ELSE 'bad' END
  WHEN 'probe' THEN CASE WHEN coalesce(reachable, 0) < 1 OR coalesce(status_code, 0) <> 200 OR latency_ms >= 1500 OR cert_days <= 7 THEN 'bad' WHEN latency_ms >= 500 OR cert_days <= 30 OR coalesce(via_cdn, 0) < 1 THEN 'warn' ELSE 'ok' END
  ELSE CASE WHEN bad OR cpu > 85 OR mem_total_mb - mem_avail_mb > 85 THEN 'bad' WHEN warn OR cpu > 70 OR mem_total_mb - mem_avail_mb > 75 THEN 'warn' ELSE 'ok' END END AS state FROM w LEFT JOIN c ON c.resource = w.resource)"""


def _snapshot(spark, d):
    k, i, r = F.col("k"), F.col("id"), F.col("user_id") % 40
    kind = F.when(r % 5 == 0, "database").when(r % 5 == 1, "lb").when(r % 5 == 2, F.when(i % 2 == 0, "host").otherwise("instance")).when(r % 5 == 3, "probe").otherwise("lock")
    m = i % 9
    value = F.when(m == 1, 100).when(m == 3, (k % 10 != 0).cast("int")).when(m == 4, F.when(k > 95, 502).otherwise(200)).when(m == 5, k * 8).when(m == 7, k % 2).when(m == 8, (k % 4 != 0).cast("int")).otherwise(k).cast("double")
    samples = T.logs(spark, d).select((F.col("created_at") * 100000 + i).alias("bucket_ts"), F.concat(F.lit("r"), r.cast("string")).alias("resource"), kind.alias("rtype"), F.element_at(F.array(*map(F.lit, _METRICS)), (m + 1).cast("int")).alias("metric"), value.alias("value"))
    key = F.col("s_suppkey") % 40
    held = T.read(spark, d, "supplier").select(F.concat(F.lit("r"), key.cast("string")).alias("resource"), F.when(key % 15 == 2, "bad").when(key % 15 == 7, "warn").otherwise("ok").alias("status"))
    found = board.snapshot(samples, NOW * 100000, ["r3"])
    states = board.resource_states(found, containers=held, **board.LIMITS)
    return found.select("resource", "age").join(states, "resource")


@query(_SNAP + " SELECT resource, rtype, newest, age, state FROM s")
def a43_snapshot(spark, d):
    """One row per resource, host rows within the instance of their name; probes, locks and containers judged too."""
    return _snapshot(spark, d).select("resource", "rtype", "newest", "age", "state")


@query(_SNAP + """ SELECT CASE WHEN bool_or(state = 'bad') THEN 'bad' WHEN bool_or(state = 'warn') THEN 'warn' ELSE 'ok' END AS state, count(*) FILTER (WHERE rtype NOT IN ('database', 'lb', 'probe', 'lock')) AS instances_total,
  count(*) FILTER (WHERE rtype NOT IN ('database', 'lb', 'probe', 'lock') AND state = 'ok') AS instances_ok, count(*) FILTER (WHERE rtype = 'probe') AS probes_total, count(*) FILTER (WHERE rtype = 'probe' AND state = 'ok') AS probes_ok,
  count(*) FILTER (WHERE rtype = 'lock') AS locks_total, count(*) FILTER (WHERE rtype = 'lock' AND state = 'ok') AS locks_ok, coalesce(max_by(state, resource) FILTER (WHERE rtype = 'database'), 'absent') AS database, coalesce(max_by(state, resource) FILTER (WHERE rtype = 'lb'), 'absent') AS lb FROM s""")
def a43_overall(spark, d):
    return board.overall(_snapshot(spark, d))
