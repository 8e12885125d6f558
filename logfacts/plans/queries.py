"""Registered queries: each operator over the star-schema tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators import alerts, audit, board, channels, edge, evidence, filters, kpi, problems, projection, rollup, stability, usage
from logfacts.plans import testmap as T
from logfacts.sources import tables
from logfacts.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = T.NOW
SINCE = NOW - 10 * S.DAY


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _minutes(spark: SparkSession, d: str, since: int | None = None) -> DataFrame:
    return rollup.minutes(T.logs(spark, d, since), T.RULES)


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return rollup.direct_hours(T.logs(spark, d), T.RULES)[0]


def _usage(spark: SparkSession, d: str, grain: str = "hour") -> DataFrame:
    return rollup.usage_facts(T.logs(spark, d), grain, T.RULES)


HOURS = T.TRAFFIC + f""",
hours AS (SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, model_name, grp, {T.measures_sql(*rollup.HOUR_MEASURES)} FROM traffic GROUP BY ALL)"""
DAY_SQL = "({} + 28800) // 86400 * 86400 - 28800"


def sums(*names: str) -> str:
    return ", ".join(f"CAST(coalesce({'max' if n in rollup.LARGEST else 'sum'}({n}), 0) AS BIGINT) AS {n}" for n in names)


# --- rollups -----------------------------------------------------------------------------------------------------


@query(T.LOGS + " SELECT id, created_at, type, user_id FROM logs WHERE created_at >= %d AND created_at < %d AND type IN (2, 5) AND NOT (type = 2 AND token_name = 'probe' AND content = 'probe')" % (SINCE, NOW))
def s1_range_scan(spark, d):
    rows = usage.search(T.logs(spark, d, SINCE, NOW), SINCE, NOW).where(F.col("type").isin(C.CONSUME, C.ERROR) & ~C.is_test(T.RULES))
    return rows.select("id", "created_at", "type", "user_id")


@query(T.LOGS + " SELECT user_id, created_at, CAST(type AS INTEGER) AS type, id, quota FROM logs WHERE type IN (2, 6)")
def s2_usage_events(spark, d):
    return usage.events(T.logs(spark, d))


@query(T.LOGS + " SELECT id, created_at, channel_id, model_name, grp, content FROM logs WHERE type = 5")
def s3_error_scan(spark, d):
    return problems.error_rows(T.logs(spark, d))


@query(T.MINUTES + " SELECT *, 5 AS traffic_class_version FROM minutes")
def a1_minutes(spark, d):
    return _minutes(spark, d)


@query(T.TRAFFIC + f" SELECT created_at // 60 * 60 AS bucket_ts, token_name, {T.measures_sql('success', 'anomaly', 'failed', 'tokens', 'quota')} FROM traffic GROUP BY ALL")
def a2_token_minutes(spark, d):
    return rollup.token_minutes(T.logs(spark, d), T.RULES)


@query(T.TRAFFIC + f" SELECT created_at // 3600 * 3600 AS hour_ts, {T.measures_sql('success', 'anomaly', 'failed', 'tokens', 'quota', 'sum_use_time')} FROM traffic GROUP BY ALL")
def a3_site_hours(spark, d):
    return rollup.site_hours(_minutes(spark, d))


@query(HOURS + " SELECT * FROM hours WHERE hour_ts // 3600 % 5 <> 0")
def a4_stability_hours(spark, d):
    minutes = _minutes(spark, d)
    proven = minutes.select(S.bucket("bucket_ts", 3600).alias("hour_ts")).where("hour_ts div 3600 % 5 = 0")
    return rollup.stability_hours(minutes, proven)


@query(T.LOGS + ", " + T.REJECTIONS + " SELECT bucket_ts // 3600 * 3600 AS hour_ts, node, reason, model, grp, CAST(sum(count) AS BIGINT) AS count FROM rejections GROUP BY ALL")
def a5_rejection_hours(spark, d):
    return rollup.rejection_hours(T.rejections(spark, d))


@query(HOURS + " SELECT * FROM hours")
def a6_direct_hours(spark, d):
    return _hours(spark, d)


@query(T.LOGS + """ SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, model_name, grp, 'legacy_base' AS origin, 'legacy' AS scope, 'legacy_assumed_base' AS cost_basis, count(*) AS requests,
  count(*) FILTER (WHERE NOT bad) AS success, count(*) FILTER (WHERE bad) AS anomaly, CAST(0 AS BIGINT) AS failed, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, CAST(sum(quota) AS BIGINT) AS quota,
  CAST(sum(use_time) AS BIGINT) AS sum_use_time, max(use_time) AS max_use_time
  FROM (SELECT *, stream_bad OR (completion_tokens = 0 AND model_name <> 'text-Embed-6') AS bad FROM logs WHERE type = 2 AND token_name = 'probe') GROUP BY ALL""")
def a6_test_hours(spark, d):
    return rollup.direct_hours(T.logs(spark, d), T.RULES)[1]


@query(T.LOGS + """ SELECT created_at // 3600 * 3600 AS hour_ts, """ + ", ".join(
    f"CAST(coalesce(sum({v}) FILTER (WHERE {c} AND type {t}), 0) AS BIGINT) AS {n}_{m}" for n, c in (("user", "NOT test"), ("test", "test")) for m, v, t in (("requests", "1", "IN (2, 5)"), ("tokens", "prompt_tokens + completion_tokens", "= 2"), ("quota", "quota", "= 2"))
) + " FROM (SELECT *, type = 2 AND token_name = 'probe' AS test FROM logs WHERE type IN (2, 5)) GROUP BY ALL")
def a7_hour_controls(spark, d):
    return rollup.hour_controls(T.logs(spark, d), T.RULES)


@query(T.USAGE + " SELECT * FROM usage")
def a12_usage_hours(spark, d):
    return _usage(spark, d)


@query(T.USAGE + f" SELECT {DAY_SQL.format('hour_ts')} AS date_ts, user_id, channel_id, grp, model_name, token_id, max(token_name) AS token_name, {sums(*rollup.USAGE_MEASURES)} FROM usage GROUP BY ALL")
def a14_usage_days(spark, d):
    return rollup.daily_from_hours(_usage(spark, d))


@query(T.USAGE + f" SELECT {DAY_SQL.format('hour_ts')} AS date_ts, user_id, channel_id, grp, model_name, token_id, max(token_name) AS token_name, {sums(*rollup.USAGE_MEASURES)} FROM usage GROUP BY ALL")
def a15_raw_days(spark, d):
    return _usage(spark, d, "day")


@query("""SELECT o.o_orderkey, CAST(round(coalesce(sum(l_extendedprice), 0) * 100) AS BIGINT) AS value_a, CAST(round(max(o_totalprice) * 100) AS BIGINT) AS value_b FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
  GROUP BY o.o_orderkey HAVING value_a <> value_b""")
def j17_reconcile(spark, d):
    detail = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum("l_extendedprice") * 100).cast("long").alias("value"))
    control = T.read(spark, d, "orders").groupBy("o_orderkey").agg(F.round(F.max("o_totalprice") * 100).cast("long").alias("value"))
    return rollup.differences(detail, control, ["o_orderkey"], ["value"])


# --- key figures -------------------------------------------------------------------------------------------------

KPI_SQL = f""" , CAST(s.success + s.anomaly + s.failed AS BIGINT) AS total, round(CASE WHEN s.success + s.anomaly + s.failed > 0 THEN s.success * 100.0 / (s.success + s.anomaly + s.failed) ELSE 0 END, 6) AS success_rate,
  round(CASE WHEN s.success + s.anomaly + s.failed > 0 THEN s.anomaly * 100.0 / (s.success + s.anomaly + s.failed) ELSE 0 END, 6) AS anomaly_rate, round(s.anomaly_quota / 500000.0, 6) AS anomaly_cost_usd,
  round((s.success + s.anomaly + s.failed) / 864000.0, 6) AS qps, round(CASE WHEN s.success + s.anomaly > 0 THEN s.sum_use_time / CAST(s.success + s.anomaly AS DOUBLE) ELSE 0 END, 6) AS avg_latency, s.max_use_time AS max_latency, s.quota AS quota_sum,
  round({T.percentile_sql(list(S.LATENCY), S.LATENCY_EDGES, 'max_use_time', 50)}, 6) AS p50, round({T.percentile_sql(list(S.LATENCY), S.LATENCY_EDGES, 'max_use_time', 95)}, 6) AS p95, round({T.percentile_sql(list(S.LATENCY), S.LATENCY_EDGES, 'max_use_time', 99)}, 6) AS p99,
  round(({T.percentile_sql(list(S.TTFT), S.TTFT_EDGES, 'ttft_max_ms', 50)}) / 1000, 6) AS ttft_p50, round(CASE WHEN s.sum_use_time > 0 THEN s.completion_tokens / CAST(s.sum_use_time AS DOUBLE) ELSE 0 END, 6) AS tok_per_sec,
  CASE WHEN s.success + s.anomaly + s.failed < 20 THEN 'nosample' WHEN (s.success + s.anomaly) * 100.0 / (s.success + s.anomaly + s.failed) >= 99 THEN 'good' WHEN (s.success + s.anomaly) * 100.0 / (s.success + s.anomaly + s.failed) >= 95 THEN 'warn' ELSE 'bad' END AS health"""
KPI = ("total", "success_rate", "anomaly_rate", "anomaly_cost_usd", "qps", "avg_latency", "max_latency", "quota_sum", "p50", "p95", "p99", "ttft_p50", "tok_per_sec", "health")


def _kpi(df: DataFrame, *keys: str) -> DataFrame:
    return rounded(df.withColumns({"max_latency": F.col("max_use_time"), "quota_sum": F.col("quota")}).select(*keys, *KPI))


@query(T.MINUTES + f", s AS (SELECT {sums(*T.MEASURES)} FROM minutes WHERE bucket_ts >= {SINCE}) SELECT {KPI_SQL.lstrip(' ,')} FROM s")
def a8_summary(spark, d):
    return _kpi(kpi.summary(_minutes(spark, d, SINCE), SINCE, 864000))


for _name, _dim, _most in (("model", "model_name", 200), ("group", "grp", 200), ("channel", "channel_id", 5)):

    def _top(spark, d, dim=_dim, most=_most):
        return _kpi(kpi.top(_minutes(spark, d, SINCE), dim, SINCE, 864000, most), "key")

    _top.__name__ = f"a9_top_{_name}"
    query(T.MINUTES + f", s AS (SELECT CAST({_dim} AS VARCHAR) AS key, {sums(*T.MEASURES)} FROM minutes WHERE bucket_ts >= {SINCE} GROUP BY ALL) SELECT key {KPI_SQL} FROM s ORDER BY quota_sum DESC, total DESC, key LIMIT {_most}")(_top)


@query(T.TRAFFIC + f" SELECT token_name, {T.measures_sql('success', 'anomaly', 'failed', 'tokens', 'quota')} FROM traffic GROUP BY token_name ORDER BY quota DESC, token_name LIMIT 100")
def a10_top_tokens(spark, d):
    return kpi.top_tokens(rollup.token_minutes(T.logs(spark, d), T.RULES))


@query(T.LOGS + ", " + T.REJECTIONS + " SELECT reason, model, grp, CAST(sum(count) AS BIGINT) AS n FROM rejections GROUP BY ALL ORDER BY n DESC, reason, model, grp LIMIT 100")
def a11_top_rejections(spark, d):
    return kpi.top_rejections(T.rejections(spark, d))


@query(T.MINUTES + f" SELECT model_name AS key, bucket_ts // 14400 * 14400 AS ts, {sums('success', 'anomaly', 'failed')} FROM minutes WHERE bucket_ts >= {SINCE} GROUP BY ALL")
def f28_sparklines(spark, d):
    return kpi.series(_minutes(spark, d, SINCE), "model_name", SINCE, 864000)


@query(T.MINUTES + f""", p AS (SELECT CAST(channel_id AS VARCHAR) AS key, bucket_ts // 14400 * 14400 AS ts, sum(anomaly) AS anomaly FROM minutes WHERE bucket_ts >= {SINCE} GROUP BY ALL),
i AS (SELECT *, row_number() OVER w - sum(CASE WHEN anomaly > 0 THEN 1 ELSE 0 END) OVER w AS island FROM p WINDOW w AS (PARTITION BY key ORDER BY ts)),
r AS (SELECT key, island, count(*) FILTER (WHERE anomaly > 0) AS run FROM i GROUP BY ALL) SELECT key, CAST(max(run) AS BIGINT) AS longest, max(run) >= 3 AS burst FROM r GROUP BY key""")
def w2_bursts(spark, d):
    return kpi.bursts(kpi.series(_minutes(spark, d, SINCE), "channel_id", SINCE, 864000))


@query(T.MINUTES + ", c AS (SELECT " + ", ".join(f"CAST(coalesce(sum({c}) FILTER (WHERE bucket_ts >= {NOW - a * 86400} AND bucket_ts < {NOW - b * 86400}), 0) AS BIGINT) AS {p}_{c}" for p, a, b in (("now", 1, 0), ("prior", 2, 1), ("week", 8, 7)) for c in ("success", "anomaly", "failed", "quota"))
       + " FROM minutes) SELECT *, " + ", ".join(f"round(CASE WHEN {p}_success + {p}_anomaly + {p}_failed > 0 THEN {p}_success * 100.0 / ({p}_success + {p}_anomaly + {p}_failed) ELSE 0 END, 6) AS {p}_rate" for p in ("now", "prior", "week")) + " FROM c")
def a28_compare(spark, d):
    return rounded(kpi.compare(_minutes(spark, d), NOW))


@query(T.MINUTES + ", c AS (SELECT " + ", ".join(f"CAST(coalesce(sum({v}) FILTER (WHERE bucket_ts >= {NOW - s}), 0) AS BIGINT) AS {p}_{n}" for p, s in (("all", 604800), ("fast", 3600), ("slow", 21600)) for n, v in (("total", "success + anomaly + failed"), ("failed", "failed")))
       + """ FROM minutes) SELECT *, round((all_total - all_failed) / CAST(all_total AS DOUBLE) * 100, 6) AS current_pct, round(all_failed / (0.01 * all_total) * 100, 6) AS budget_used_pct, round(100 - all_failed / (0.01 * all_total) * 100, 6) AS budget_left_pct,
  (all_total - all_failed) / CAST(all_total AS DOUBLE) * 100 >= 99 AS compliant, round(CASE WHEN fast_total > 0 THEN fast_failed / CAST(fast_total AS DOUBLE) / 0.01 ELSE 0 END, 6) AS burn_fast, round(CASE WHEN slow_total > 0 THEN slow_failed / CAST(slow_total AS DOUBLE) / 0.01 ELSE 0 END, 6) AS burn_slow FROM c""")
def a29_service_level(spark, d):
    return rounded(kpi.service_level(_minutes(spark, d), NOW))


@query(T.MINUTES + f" SELECT max(bucket_ts) AS newest, min(bucket_ts) AS oldest, {NOW} - max(bucket_ts) AS age FROM minutes")
def a31_freshness(spark, d):
    return kpi.freshness(_minutes(spark, d), NOW)


@query(T.MINUTES + f""", s AS (SELECT CAST(channel_id AS VARCHAR) AS key, {sums(*T.MEASURES)} FROM minutes WHERE bucket_ts >= {SINCE} GROUP BY ALL)
SELECT key, CASE WHEN anomaly_quota / 500000.0 >= 1 THEN 'anomaly_billed' WHEN anomaly < 5 THEN '' WHEN anomaly * 100.0 / (success + anomaly + failed) >= 8 THEN 'anomaly_rate' ELSE '' END AS rule,
  CASE WHEN failed >= 10 THEN 'error_burst' WHEN failed >= 5 AND failed * 100.0 / (success + anomaly + failed) >= 20 THEN 'error_rate' ELSE '' END AS error_rule FROM s""")
def r6_alert_rules(spark, d):
    rows = kpi.top(_minutes(spark, d), "channel_id", SINCE, 864000).withColumn("burst", F.lit(False))
    return rows.select("key", alerts.rule(cost_usd=1.0).alias("rule"), alerts.error_rule().alias("error_rule"))


# --- filters -----------------------------------------------------------------------------------------------------


@query(T.MINUTES + ", " + T.CHANNELS + " SELECT m.bucket_ts, m.channel_id, m.model_name, m.grp, m.success FROM minutes m WHERE NOT EXISTS (SELECT 1 FROM channels c WHERE c.id = m.channel_id AND (c.status <> 1 OR m.bucket_ts < c.enabled_since))")
def p6_enabled(spark, d):
    return filters.enabled(_minutes(spark, d), T.channels(spark, d)).select("bucket_ts", "channel_id", "model_name", "grp", "success")


def _pairs(spark, d):
    return T.logs(spark, d).where("k % 3 = 0").select("grp", F.col("model_name").alias("model")).distinct()


@query(T.MINUTES + ", pairs AS (SELECT DISTINCT grp, model_name AS model FROM logs WHERE k % 33 = 0 AND user_id % 7 = 0) SELECT m.bucket_ts, m.channel_id, m.model_name, m.grp FROM minutes m WHERE NOT EXISTS (SELECT 1 FROM pairs) OR EXISTS (SELECT 1 FROM pairs p WHERE p.grp = m.grp AND p.model = m.model_name)")
def p7_selectable(spark, d):
    pairs = T.logs(spark, d).where("k % 33 = 0 and user_id % 7 = 0").select("grp", F.col("model_name").alias("model")).distinct()
    return filters.selectable(_minutes(spark, d), pairs).select("bucket_ts", "channel_id", "model_name", "grp")


@query(T.MINUTES + " SELECT bucket_ts, channel_id, model_name, grp FROM minutes")
def p7_selectable_open(spark, d):
    return filters.selectable(_minutes(spark, d), _pairs(spark, d).where("false")).select("bucket_ts", "channel_id", "model_name", "grp")


@query(HOURS + """, v AS (SELECT *, CASE WHEN hour_ts // 3600 % 4 = 0 AND channel_id % 2 = 0 THEN 4 ELSE 5 END AS v FROM hours), h AS (SELECT hour_ts, bool_or(v <> 5) AS older FROM v GROUP BY ALL)
SELECT v.hour_ts, channel_id, model_name, grp, success, v AS traffic_class_version FROM v JOIN h ON v.hour_ts = h.hour_ts WHERE CASE WHEN v.hour_ts // 3600 % 8 = 0 OR NOT older THEN v = 5 ELSE v <> 5 END""")
def p9_effective_version(spark, d):
    facts = _hours(spark, d).withColumn("traffic_class_version", F.when((F.expr("hour_ts div 3600 % 4") == 0) & (F.col("channel_id") % 2 == 0), 4).otherwise(5))
    ledger = facts.select("hour_ts").distinct().where("hour_ts div 3600 % 8 = 0").select("hour_ts", F.lit("complete").alias("status"), F.lit(5).alias("traffic_class_version"))
    return filters.effective(facts, ledger).select("hour_ts", "channel_id", "model_name", "grp", "success", "traffic_class_version")


@query(T.USAGE + f" SELECT hour_ts, user_id, requests FROM usage WHERE user_id % 3 = 0 AND hour_ts >= {SINCE}")
def p13_visible(spark, d):
    facts = _usage(spark, d)
    published = facts.select("user_id").distinct().where("user_id % 3 = 0").withColumn("source_floor_hour", F.lit(SINCE))
    return filters.visible(facts, published).select("hour_ts", "user_id", "requests")


@query(T.LOGS + f" SELECT id FROM logs WHERE created_at >= {SINCE} AND created_at < {NOW} AND type = 5 AND contains(content, '_code=5') AND model_name = 'model-1'")
def p11_search(spark, d):
    return usage.search(T.logs(spark, d, SINCE, NOW), SINCE, NOW, kind=5, model="model-1", content="_code=5").select("id")


@query(T.LOGS + " SELECT id, created_at, quota FROM logs WHERE id < (SELECT max(id) - 200 FROM logs) ORDER BY id DESC LIMIT 500")
def t3_extract(spark, d):
    rows = T.logs(spark, d)
    newest = rows.agg(F.max("id")).first()[0] or 0
    return usage.extract(rows, 500, before_id=newest - 200, max_id=newest).select("id", "created_at", "quota")


@query(T.LOGS + " SELECT least(count(*), 300) AS n, count(*) > 300 AS more, max(id) AS max_id FROM (SELECT id FROM logs WHERE type = 5 ORDER BY id LIMIT 301)")
def a48_bounded_count(spark, d):
    return usage.bounded_count(T.logs(spark, d).where("type = 5"), 300)


# --- stability ---------------------------------------------------------------------------------------------------

ROWS = HOURS + ", " + T.REJECTIONS + """, rows AS (SELECT hour_ts, channel_id, model_name AS model, grp, success, anomaly, failed, tokens, quota, sum_use_time, 0 AS rejected FROM hours
  UNION ALL SELECT bucket_ts // 3600 * 3600, NULL, model, grp, 0, 0, 0, 0, 0, 0, count FROM rejections)"""
SUMS = sums("success", "anomaly", "failed", "tokens", "quota", "sum_use_time", "rejected")
METRICS = """CAST(success + anomaly + failed + rejected AS BIGINT) AS requests, CAST(anomaly + failed + rejected AS BIGINT) AS problems, round(success * 100.0 / nullif(success + anomaly + failed + rejected, 0), 6) AS stability,
  round((anomaly + failed + rejected) * 100.0 / nullif(success + anomaly + failed + rejected, 0), 6) AS problem_rate, round(quota / 500000.0, 6) AS cost_usd, round(sum_use_time / CAST(nullif(success + anomaly, 0) AS DOUBLE), 6) AS avg_latency,
  CASE WHEN success + anomaly + failed + rejected < 20 THEN 'nosample' WHEN success * 100.0 / (success + anomaly + failed + rejected) >= 99 THEN 'good' WHEN success * 100.0 / (success + anomaly + failed + rejected) >= 95 THEN 'warn' ELSE 'bad' END AS health"""
LEVEL = "CASE WHEN gid = 7 THEN 'all' WHEN gid = 3 THEN 'group' WHEN gid = 1 THEN 'group-channel' WHEN gid = 0 THEN 'group-channel-model' WHEN gid = 2 THEN 'group-model' WHEN gid = 5 THEN 'channel' ELSE 'model' END"
LEVELS = f"""levels AS (SELECT *, {LEVEL} AS level FROM (SELECT grp, channel_id, model, grouping(grp, channel_id, model) AS gid, {SUMS} FROM rows GROUP BY GROUPING SETS ((), (grp), (grp, channel_id), (grp, channel_id, model), (grp, model), (channel_id), (model))))"""


def _rows(spark, d):
    return stability.with_rejections(_hours(spark, d), T.rejections(spark, d))


@query(HOURS + ", " + T.CHANNELS + f" SELECT grp, channel_id, model_name, name, vendor, {sums('success', 'anomaly', 'failed', 'quota', 'max_use_time')} FROM hours LEFT JOIN channels ON id = channel_id GROUP BY ALL")
def a19_dimensions(spark, d):
    c = T.channels(spark, d).select(F.col("id").alias("channel_id"), "name", "vendor")
    return _hours(spark, d).join(c, "channel_id", "left").groupBy("grp", "channel_id", "model_name", "name", "vendor").agg(*rollup.again(("success", "anomaly", "failed", "quota", "max_use_time")))


@query(ROWS + ", " + LEVELS + f" SELECT level, grp, channel_id, model, success, anomaly, failed, tokens, quota, sum_use_time, rejected, {METRICS} FROM levels")
def a20_levels(spark, d):
    return rounded(stability.levels(_rows(spark, d)))


@query(ROWS + ", " + LEVELS + ", m AS (SELECT level, grp, channel_id, model, success + anomaly + failed + rejected AS requests, anomaly + failed + rejected AS problems FROM levels) SELECT level, grp, channel_id, model, round(requests * 100.0 / sum(requests) OVER (PARTITION BY level), 6) AS request_share, round(problems * 100.0 / sum(problems) OVER (PARTITION BY level), 6) AS problem_share FROM m")
def w9_shares(spark, d):
    return rounded(stability.with_shares(stability.levels(_rows(spark, d))).select("level", "grp", "channel_id", "model", "request_share", "problem_share"))


def _levels_of(n: str, a: int, b: int) -> str:
    return LEVELS.replace("levels AS", f"{n} AS", 1).replace("FROM rows GROUP", f"FROM rows WHERE hour_ts >= {a} AND hour_ts < {b} GROUP")


@query(ROWS + ", " + _levels_of("cur", NOW - 5 * 86400, NOW) + ", " + _levels_of("old", NOW - 10 * 86400, NOW - 5 * 86400) + """ SELECT c.level, c.grp, c.channel_id, c.model, round(c.success * 100.0 / nullif(c.success + c.anomaly + c.failed + c.rejected, 0) - o.success * 100.0 / nullif(o.success + o.anomaly + o.failed + o.rejected, 0), 6) AS delta_pp
  FROM cur c LEFT JOIN old o ON c.level = o.level AND c.grp IS NOT DISTINCT FROM o.grp AND c.channel_id IS NOT DISTINCT FROM o.channel_id AND c.model IS NOT DISTINCT FROM o.model""")
def a20_deltas(spark, d):
    rows = _rows(spark, d)
    return rounded(stability.deltas(rows, NOW - 5 * S.DAY, NOW, NOW - 10 * S.DAY))


@query(ROWS + f", s AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, grp, {SUMS} FROM rows GROUP BY ALL) SELECT date_ts, grp, success, anomaly, failed, tokens, quota, sum_use_time, rejected, {METRICS} FROM s")
def a21_days(spark, d):
    return rounded(stability.by_day(_rows(spark, d), "grp"))


_A, _B = NOW - 12 * 86400, NOW
_STEP = stability.step_seconds(_A, _B)


@query(ROWS + f""", t AS (SELECT unnest(range({(_A + 28800) // _STEP * _STEP - 28800}, {_B}, {_STEP})) AS ts), g AS (SELECT (hour_ts + 28800) // {_STEP} * {_STEP} - 28800 AS ts, {SUMS} FROM rows WHERE hour_ts >= {_A} AND hour_ts < {_B} GROUP BY ALL),
s AS (SELECT t.ts, coalesce(success, 0) AS success, coalesce(anomaly, 0) AS anomaly, coalesce(failed, 0) AS failed, coalesce(tokens, 0) AS tokens, coalesce(quota, 0) AS quota, coalesce(sum_use_time, 0) AS sum_use_time, coalesce(rejected, 0) AS rejected FROM t LEFT JOIN g ON t.ts = g.ts)
SELECT *, {METRICS} FROM s""")
def a22_timeline(spark, d):
    return rounded(stability.timeline(_rows(spark, d), _A, _B))


@query(HOURS + ", " + T.CHANNELS + " SELECT string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups, string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models, string_agg(DISTINCT vendor, ',' ORDER BY vendor) AS vendors FROM hours LEFT JOIN channels ON id = channel_id")
def u9_filter_lists(spark, d):
    return stability.filter_lists(_hours(spark, d), T.channels(spark, d))


# --- problems ----------------------------------------------------------------------------------------------------

SIGNS = T.LOGS + r""", sg AS (SELECT created_at // 60 * 60 AS bucket_ts, 'log' AS source, sha256(encode('log') || '\x00'::BLOB || encode(content)) AS signature_hash, channel_id, model_name, grp, regexp_extract(content, 'status_code=([0-9]{3})', 1) AS code, content AS message, false AS truncated,
  count(*) AS count, min(created_at) AS first_ts, max(created_at) AS last_ts FROM logs WHERE type = 5 GROUP BY ALL)"""


@query(SIGNS + " SELECT * FROM sg")
def a24_signatures(spark, d):
    return problems.signatures(T.logs(spark, d).where("type = 5"))


@query(SIGNS + ", " + T.REJECTIONS + r""", u AS (SELECT source, signature_hash, message, code, count, first_ts, last_ts, grp, channel_id, model_name FROM sg UNION ALL
  SELECT 'reject', sha256(encode('reject') || '\x00'::BLOB || encode(reason)), reason, '', sum(count), min(bucket_ts), max(bucket_ts), grp, NULL, model FROM rejections GROUP BY reason, grp, model)
SELECT source, signature_hash, message, code, CAST(sum(count) AS BIGINT) AS count, min(first_ts) AS first_ts, max(last_ts) AS last_ts, string_agg(DISTINCT grp, ',' ORDER BY grp) AS groups, coalesce(string_agg(DISTINCT CAST(channel_id AS VARCHAR), ',' ORDER BY CAST(channel_id AS VARCHAR)), '') AS channels,
  string_agg(DISTINCT model_name, ',' ORDER BY model_name) AS models, round(sum(count) * 100.0 / (SELECT sum(count) FROM u), 6) AS share FROM u GROUP BY source, signature_hash, message, code""")
def a25_problem_report(spark, d):
    minutes = problems.signatures(T.logs(spark, d).where("type = 5")).unionByName(problems.of_rejections(T.rejections(spark, d)))
    return rounded(problems.report(minutes, 0, 1 << 40))


PLANTED = "api_key: abc123, Bearer abcdefghijkl sk-abcdefgh12 ?token=zz&x=1 a.b@example.com 10.0.0.1:80 123e4567-e89b-42d3-a456-426614174000 "
_WS = r"[ \t\n\r\f\v]"
RULES_SQL = (
    (rf"(?i)\b(authorization|api[-_ ]?key|access[-_ ]?token|refresh[-_ ]?token|secret){_WS}*[:=]{_WS}*(?:bearer{_WS}+)?[^ \t\n\r\f\v,;]+", r"\1=<redacted>"), (rf"(?i)\bbearer{_WS}+[a-z0-9._~+/=-]{{8,}}", "Bearer <redacted>"),
    (r"(?i)\b(?:sk|rk|pk|sess|token)-[a-z0-9_-]{8,}", "<credential>"), (r"(?i)([?&](?:token|key|api_key|access_token|signature)=)[^& \t\n\r\f\v]+", r"\1<redacted>"),
    (r"\b[a-zA-Z0-9.!#$%&''*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)+\b", "<email>"), (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?\b", "<ip>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<uuid>"), (r"\b[a-zA-Z0-9_-]{32,}\b", "<opaque-id>"), (_WS + "+", " "))


def _redacted_sql(text: str) -> str:
    for pattern, substitute in RULES_SQL:
        text = f"regexp_replace({text}, '{pattern}', '{substitute}', 'g')"
    return text


@query(f"SELECT doc_id, md5({_redacted_sql(f"trim('{PLANTED}' || text)")}) AS digest FROM documents")
def f4_redaction(spark, d):
    """All rules over whole texts, each of which begins with one case of every rule."""
    return T.read(spark, d, "documents").select("doc_id", F.md5(S.redacted(F.concat(F.lit(PLANTED), "text"))).alias("digest"))


# --- usage -------------------------------------------------------------------------------------------------------

BILL = "CAST(consume_quota - refund_quota AS BIGINT) AS net_quota, round(consume_quota / 500000.0, 6) AS gross_usd, round(refund_quota / 500000.0, 6) AS refund_usd, round((consume_quota - refund_quota) / 500000.0, 6) AS net_usd"
for _name, _key in (("user", "user_id"), ("group", "grp"), ("model", "model_name"), ("token", "token_id")):

    def _totals(spark, d, key=_key):
        return rounded(usage.totals(_usage(spark, d), key))

    _totals.__name__ = f"a16_usage_by_{_name}"
    query(T.USAGE + f", s AS (SELECT {_key}, {sums(*rollup.USAGE_MEASURES)} FROM usage GROUP BY ALL) SELECT *, {BILL} FROM s")(_totals)


@query(T.USAGE + f", s AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, {sums(*rollup.USAGE_MEASURES)} FROM usage WHERE hour_ts >= {SINCE} AND hour_ts < {NOW} GROUP BY ALL) SELECT *, {BILL} FROM s")
def a16_usage_days(spark, d):
    return rounded(usage.days(_usage(spark, d), SINCE, NOW))


@query(T.USAGE + f", t AS (SELECT model_name FROM usage GROUP BY 1 ORDER BY sum(consume_quota) DESC, model_name LIMIT 3) SELECT {DAY_SQL.format('hour_ts')} AS date_ts, CASE WHEN model_name IN (SELECT model_name FROM t) THEN model_name ELSE 'other' END AS model, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(consume_quota) AS BIGINT) AS consume_quota FROM usage GROUP BY ALL")
def w10_top_models(spark, d):
    return usage.models_by_day(_usage(spark, d), 3)


@query(T.USAGE + f""", u AS (SELECT DISTINCT user_id FROM usage), t AS (SELECT unnest(range({(SINCE + 28800) // 86400 * 86400 - 28800}, {NOW}, 86400)) AS date_ts),
s AS (SELECT user_id, {DAY_SQL.format('hour_ts')} AS date_ts, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(consume_quota) AS BIGINT) AS consume_quota FROM usage WHERE hour_ts >= {SINCE} AND hour_ts < {NOW} GROUP BY ALL)
SELECT u.user_id, t.date_ts, coalesce(requests, 0) AS requests, coalesce(consume_quota, 0) AS consume_quota FROM u CROSS JOIN t LEFT JOIN s ON s.user_id = u.user_id AND s.date_ts = t.date_ts""")
def a17_matrix(spark, d):
    facts = _usage(spark, d)
    return usage.matrix(facts, facts.select("user_id"), SINCE, NOW)


@query(T.USAGE + """, dim AS (SELECT c_custkey * 10 AS token_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0), s AS (SELECT token_id, max(token_name) AS n, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(consume_quota) AS BIGINT) AS consume_quota FROM usage GROUP BY 1)
SELECT coalesce(s.token_id, dim.token_id) AS token_id, coalesce(name, n) AS name, name IS NULL AS deleted, coalesce(requests, 0) AS requests, coalesce(consume_quota, 0) AS consume_quota FROM s FULL JOIN dim ON s.token_id = dim.token_id""")
def j12_tokens(spark, d):
    dim = T.read(spark, d, "customer").where("c_custkey % 2 = 0").select((F.col("c_custkey") * 10).alias("token_id"), F.col("c_name").alias("name"))
    return usage.tokens(_usage(spark, d), dim)


@query(T.USAGE + f""", dd AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, * FROM usage), proof AS (SELECT DISTINCT user_id, date_ts FROM dd WHERE user_id % 2 = 0 AND date_ts < {SINCE})
SELECT date_ts, user_id, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(consume_quota) AS BIGINT) AS consume_quota FROM dd GROUP BY ALL""")
def u1_fact_view(spark, d):
    hours = _usage(spark, d)
    days = rollup.daily_from_hours(hours)
    proofs = days.where((F.col("user_id") % 2 == 0) & (F.col("date_ts") < SINCE)).select("user_id", "date_ts").distinct()
    done = days.join(proofs, ["user_id", "date_ts"], "left_semi").select("date_ts", "user_id", "requests", "consume_quota")
    view = filters.fact_view(done, hours, proofs)
    return view.groupBy("date_ts", "user_id").agg(F.sum("requests").alias("requests"), F.sum("consume_quota").alias("consume_quota"))


_U = NOW
_F = f"""f AS (SELECT user_id, (hour_ts - {_U - 30 * 86400}) // 86400 AS ix, sum((consume_quota - refund_quota) / 500000.0) AS usd FROM usage WHERE hour_ts >= {_U - 30 * 86400} AND hour_ts < {_U} GROUP BY ALL),
g AS (SELECT user_id, sum(usd) AS spend, coalesce(sum(usd) FILTER (WHERE ix >= 23), 0) AS last7, coalesce(sum(usd) FILTER (WHERE ix >= 16 AND ix < 23), 0) AS prev7, max(ix) FILTER (WHERE usd > 0) AS active FROM f GROUP BY 1),
h AS (SELECT c_custkey AS user_id, c_acctbal AS balance, coalesce(spend, 0) AS spend, coalesce(last7, 0) AS last7, coalesce(prev7, 0) AS prev7, coalesce(29 - active, 30) AS days_idle FROM customer LEFT JOIN g ON user_id = c_custkey),
i AS (SELECT *, days_idle >= 14 AS dormant, days_idle < 14 AND prev7 > 0 AND last7 < prev7 * 0.7 AS fell, coalesce(balance < 1, false) AS low FROM h)"""


@query(T.USAGE + ", " + _F + """ SELECT user_id, CAST(days_idle AS BIGINT) AS days_idle, concat_ws(',', CASE WHEN dormant THEN 'dormant' END, CASE WHEN fell THEN 'drop' END, CASE WHEN low THEN 'low balance' END) AS reasons,
  CAST(CASE WHEN dormant THEN 50 WHEN fell THEN 35 ELSE 0 END + CASE WHEN low THEN 45 ELSE 0 END + floor(spend) AS BIGINT) AS urgency, CASE WHEN spend > 0 THEN 'urgent' ELSE 'info' END AS level FROM i WHERE dormant OR fell OR low""")
def a46_follow_ups(spark, d):
    balances = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("balance_usd"))
    return usage.follow_ups(_usage(spark, d), NOW, balances).drop("spend_usd")


@query(T.LOGS + " SELECT user_id, min(created_at) AS first_log, max(created_at) AS last_log, CAST(sum(quota) FILTER (WHERE type = 2) AS BIGINT) AS used FROM logs GROUP BY 1")
def a45_boundaries(spark, d):
    return T.logs(spark, d).groupBy("user_id").agg(F.min("created_at").alias("first_log"), F.max("created_at").alias("last_log"), F.sum(F.when(F.col("type") == 2, F.col("quota"))).alias("used"))


# --- audits ------------------------------------------------------------------------------------------------------


@query(HOURS + f", p AS (SELECT DISTINCT hour_ts FROM hours WHERE hour_ts // 3600 % 7 <> 0), t AS (SELECT unnest(range({SINCE}, {NOW}, 3600)) AS hour_ts) SELECT hour_ts FROM t WHERE hour_ts NOT IN (SELECT hour_ts FROM p)")
def w4_missing_hours(spark, d):
    return audit.missing_hours(_hours(spark, d).select("hour_ts").where("hour_ts div 3600 % 7 <> 0"), SINCE, NOW)


@query(HOURS + f""", p AS (SELECT DISTINCT hour_ts FROM hours WHERE hour_ts // 3600 % 40 < 5), t AS (SELECT unnest(range({SINCE}, {NOW}, 3600)) AS h), m AS (SELECT h FROM t WHERE h NOT IN (SELECT hour_ts FROM p)),
i AS (SELECT h, h - 3600 * row_number() OVER (ORDER BY h) AS island FROM m), c AS (SELECT h, island, (row_number() OVER (PARTITION BY island ORDER BY h) - 1) // 12 AS chunk FROM i) SELECT min(h) AS from_ts, max(h) + 3600 AS to_ts FROM c GROUP BY island, chunk""")
def w6_missing_ranges(spark, d):
    return audit.missing_ranges(_hours(spark, d).select("hour_ts").where("hour_ts div 3600 % 40 < 5"), SINCE, NOW)


_PROOF = f"p AS (SELECT DISTINCT c_custkey AS user_id, h AS hour_ts FROM customer, (SELECT unnest(range({SINCE}, {SINCE + 40 * 3600}, 3600)) AS h) WHERE (h - {SINCE}) // 3600 <> c_custkey % 50)"


def _proofs(spark, d):
    users = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    users = users.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id")  # by number, as AQE does not see that rows become forty times as many
    hours = spark.range(SINCE, SINCE + 40 * 3600, 3600).withColumnRenamed("id", "hour_ts")
    return users.crossJoin(F.broadcast(hours)).where((F.col("hour_ts") - SINCE) / 3600 != F.col("user_id") % 50)


@query(f"WITH {_PROOF} SELECT user_id, max(hour_ts) + 3600 AS through FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hour_ts) AS rn FROM p) WHERE hour_ts = {SINCE} + (rn - 1) * 3600 GROUP BY 1")
def w5_contiguous(spark, d):
    return audit.contiguous(_proofs(spark, d), SINCE)


@query(f"WITH {_PROOF} SELECT user_id, CASE WHEN user_id % 50 < 40 THEN {SINCE} + user_id % 50 * 3600 END AS gap FROM (SELECT DISTINCT user_id FROM p)")
def w4_first_gap(spark, d):
    return audit.first_gap(_proofs(spark, d), SINCE, SINCE + 40 * 3600)


@query(f"WITH {_PROOF} SELECT c_custkey AS user_id, count(hour_ts) AS hours, count(hour_ts) = 24 AS ready FROM customer LEFT JOIN p ON user_id = c_custkey AND hour_ts >= {SINCE} AND hour_ts < {SINCE + 86400} GROUP BY 1")
def j19_day_ready(spark, d):
    return audit.day_ready(_proofs(spark, d), T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), SINCE)


@query(HOURS + ", c AS (SELECT created_at // 3600 * 3600 AS hour_ts, count(*) AS n FROM traffic GROUP BY 1) SELECT c.hour_ts, n + 1 AS requests_a, n AS requests_b FROM c WHERE hour_ts // 3600 % 7 = 0")
def q1_detail_is_control(spark, d):
    """Detail and control agree but for the hours in whose detail a fault is planted."""
    logs, fault = T.logs(spark, d), F.when(F.expr("hour_ts div 3600 % 7") == 0, 1).otherwise(0)
    detail = _hours(spark, d).groupBy("hour_ts").agg(F.sum(F.col("success") + F.col("anomaly") + F.col("failed")).alias("requests")).withColumn("requests", F.col("requests") + fault)
    control = rollup.hour_controls(logs, T.RULES).select("hour_ts", F.col("user_requests").alias("requests"))
    return rollup.differences(detail, control, ["hour_ts"], ["requests"])


@query(T.USAGE + f""", a AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, user_id, sum(requests) AS n FROM usage GROUP BY ALL), b AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, user_id, sum(requests) AS n FROM usage WHERE hour_ts // 3600 % 24 <> 5 GROUP BY ALL)
SELECT a.date_ts, a.user_id, CAST(a.n AS BIGINT) AS requests_a, CAST(coalesce(b.n, 0) AS BIGINT) AS requests_b FROM a LEFT JOIN b ON a.date_ts = b.date_ts AND a.user_id = b.user_id WHERE a.n <> coalesce(b.n, 0)""")
def q11_source_audit(spark, d):
    total = lambda df: df.groupBy("date_ts", "user_id").agg(F.sum("requests").alias("requests"))
    stored = rollup.daily_from_hours(_usage(spark, d).where("hour_ts div 3600 % 24 <> 5"))
    return rollup.differences(total(_usage(spark, d, "day")), total(stored), ["date_ts", "user_id"], ["requests"])


@query(T.USAGE + f" SELECT c_custkey AS user_id, ({'least(1704100000 + c_custkey * 100, coalesce(first, 1704100000 + c_custkey * 100))'} + 28800) // 86400 * 86400 - 28800 AS floor FROM customer LEFT JOIN (SELECT user_id, min(created_at) AS first FROM logs GROUP BY 1) ON user_id = c_custkey")
def q6_source_floor(spark, d):
    users = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.lit(1704100000) + F.col("c_custkey") * 100).alias("registered"))
    return audit.source_floor(users, T.logs(spark, d).groupBy("user_id").agg(F.min("created_at").alias("first_log")))


@query(T.USAGE + f", dd AS (SELECT DISTINCT user_id FROM usage WHERE {DAY_SQL.format('hour_ts')} = {(SINCE + 28800) // 86400 * 86400 - 28800}) SELECT DISTINCT user_id FROM usage WHERE user_id NOT IN (SELECT user_id FROM dd) AND user_id % 9 <> 0")
def q10_uncovered(spark, d):
    hours, date = _usage(spark, d), (SINCE + 28800) // 86400 * 86400 - 28800
    proofs = hours.select("user_id").distinct().where("user_id % 9 = 0").withColumn("date_ts", F.lit(date))
    return audit.uncovered_members(hours, rollup.daily_from_hours(hours), proofs, date)


@query(T.USAGE + f" SELECT hour_ts, user_id, requests FROM usage WHERE user_id % 2 = 0 AND NOT (hour_ts >= {SINCE} AND hour_ts < {SINCE + 86400} AND user_id % 4 = 0)")
def s15_prunable(spark, d):
    hours = _usage(spark, d)
    proofs = hours.where("user_id % 2 = 0").select("user_id", S.day("hour_ts").alias("date_ts")).distinct()
    active = hours.where("user_id % 4 = 0").select(F.col("user_id").alias("user")).distinct().withColumns({"from_ts": F.lit(SINCE), "to_ts": F.lit(SINCE + S.DAY)})
    return audit.prunable(hours, proofs, active).select("hour_ts", "user_id", "requests")


@query()
def f23_digests(spark, d):
    return audit.digests(_usage(spark, d), ["hour_ts"], ["user_id", "channel_id", "grp", "model_name", "token_id", "requests", "consume_quota"])


# --- channels ----------------------------------------------------------------------------------------------------


@query(T.USAGE + ", " + T.CHANNELS + """, r AS (SELECT coalesce(base_domain, 'historical unknown') AS domain, coalesce(vendor, 'historical unknown') AS vendor, u.channel_id, requests, consume_quota FROM usage u LEFT JOIN channels ON id = u.channel_id AND id % 6 <> 5)
SELECT domain, vendor, channel_id, CAST(grouping(domain, vendor, channel_id) AS INTEGER) AS level, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(consume_quota) AS BIGINT) AS consume_quota FROM r GROUP BY ROLLUP (domain, vendor, channel_id)""")
def a32_channel_usage(spark, d):
    return channels.usage_by_channel(_usage(spark, d), T.channels(spark, d).where("id % 6 <> 5"))


def _costs(spark, d):
    p = T.read(spark, d, "part")
    return p.select((F.col("p_partkey") % 40).alias("channel_id"), F.concat(F.lit("grp-"), (F.col("p_partkey") % 5).cast("string")).alias("grp"), F.lit("up").alias("upstream_group"), (F.when(F.col("p_partkey") % 40 < 20, 1.5).otherwise(1.0 + F.col("p_partkey") % 3)).alias("multiplier"), (F.col("p_partkey") % 2 * 0.0).alias("discount"))


COSTS = "WITH costs AS (SELECT p_partkey % 40 AS channel_id, 'grp-' || (p_partkey % 5) AS grp, CASE WHEN p_partkey % 40 < 20 THEN 1.5 ELSE CAST(1 + p_partkey % 3 AS DOUBLE) END AS multiplier FROM part)"


@query(COSTS + " SELECT channel_id, min(multiplier) <> max(multiplier) AS conflict, CASE WHEN min(multiplier) = max(multiplier) THEN 'up' END AS upstream_group, CASE WHEN min(multiplier) = max(multiplier) THEN CAST(min(multiplier) AS DOUBLE) END AS multiplier, CASE WHEN min(multiplier) = max(multiplier) THEN CAST(1 AS DOUBLE) END AS discount FROM costs GROUP BY 1")
def a49_canonical_rates(spark, d):
    return channels.canonical_rates(_costs(spark, d))


@query(COSTS + """, c AS (SELECT channel_id, min(multiplier) AS m FROM costs GROUP BY 1 HAVING min(multiplier) = max(multiplier)), k AS (SELECT s_suppkey AS channel_id, 'grp-' || (s_suppkey % 5) AS grp, 'domain-' || (s_suppkey % 4) AS domain FROM supplier)
SELECT k.channel_id, k.grp, k.domain, CASE WHEN k.channel_id % 9 = 0 THEN 'pair' WHEN c.m IS NOT NULL THEN 'channel' WHEN k.domain <> 'domain-3' THEN 'domain' ELSE 'none' END AS price_from, CASE WHEN k.channel_id % 9 = 0 THEN CAST(7 AS DOUBLE) WHEN c.m IS NOT NULL THEN CAST(c.m AS DOUBLE) WHEN k.domain <> 'domain-3' THEN CAST(9 AS DOUBLE) END AS multiplier FROM k LEFT JOIN c ON c.channel_id = k.channel_id""")
def j14_prices(spark, d):
    s = T.read(spark, d, "supplier")
    grp = F.concat(F.lit("grp-"), (F.col("s_suppkey") % 5).cast("string"))
    keys = s.select(F.col("s_suppkey").alias("channel_id"), grp.alias("grp"), F.concat(F.lit("domain-"), (F.col("s_suppkey") % 4).cast("string")).alias("domain"))
    exact = keys.where("channel_id % 9 = 0").select("channel_id", "grp", F.lit(7.0).alias("multiplier"), F.lit(1.0).alias("discount"))
    by_domain = keys.where("domain <> 'domain-3'").select("domain", "grp").distinct().withColumns({"multiplier": F.lit(9.0), "discount": F.lit(1.0)})
    return channels.prices(keys, exact, channels.canonical_rates(_costs(spark, d)), by_domain).drop("discount")


@query("""SELECT s_suppkey AS channel_id, round(m * f * 2 / 3, 6) AS effective, round(1.2 - m * f * 2 / 3, 6) AS gap, CASE WHEN m > 0 THEN round(1.2 * (5.0 / 4) / 7, 6) END AS site_discount, CASE WHEN m > 0 THEN round(m * f * 2 / 3 / 7, 6) END AS upstream_discount,
  CASE WHEN m > 0 THEN round((1.2 * 1.25 / 7 - m * f * 2 / 3 / 7) / (1.2 * 1.25 / 7), 6) END AS margin, m IS NOT NULL AS complete FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN (s_suppkey % 3) * 0.5 END AS m, CASE WHEN s_suppkey % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS f FROM supplier)""")
def f20_finance(spark, d):
    s = T.read(spark, d, "supplier").select(F.col("s_suppkey").alias("channel_id"), (F.col("s_suppkey") % 3 * 0.5).cast("double").alias("m"), F.when(F.col("s_suppkey") % 2 == 0, 0.0).otherwise(0.8).alias("f"))
    lit = [F.lit(x) for x in (2.0, 3.0, 1.2, 5.0, 4.0, 7.0)]
    return rounded(s.withColumns(channels.finance(F.col("m"), F.col("f"), *lit)).drop("m", "f"))


@query(HOURS + ", " + T.CHANNELS + """, p AS (SELECT DISTINCT hour_ts FROM hours WHERE hour_ts // 3600 % 3 <> 0), r AS (SELECT h.*, base_domain AS domain, h.grp <> 'grp-4' AS priced FROM hours h JOIN p ON h.hour_ts = p.hour_ts JOIN channels ON id = channel_id)
SELECT domain, round(coalesce(sum(quota / 500000.0 * 0.5 / 2.0) FILTER (WHERE priced), 0) / (SELECT count(*) FROM p) * 24, 6) AS daily_cost_usd, CASE WHEN coalesce(sum(quota) FILTER (WHERE NOT priced), 0) > 0 THEN 'grp-4' ELSE '' END AS missing_groups FROM r GROUP BY 1""")
def a34_burn(spark, d):
    c = T.channels(spark, d).select(F.col("id").alias("channel_id"), F.col("base_domain").alias("domain"))
    facts = _hours(spark, d).join(c, "channel_id")
    ledger = facts.select("hour_ts").distinct().where("hour_ts div 3600 % 3 <> 0").withColumn("status", F.lit("complete"))
    rates = facts.select("channel_id", "grp").distinct().where("grp <> 'grp-4'").withColumns({"upstream": F.lit(0.5), "site": F.lit(2.0)})
    return rounded(channels.burn(facts, rates, ledger, 10))


@query(f"""SELECT 'd' || s_suppkey AS domain, CASE WHEN reason IS NOT NULL THEN 'unavailable' WHEN cost < 0.01 THEN 'idle' WHEN s_acctbal <= 0 THEN 'critical' WHEN s_acctbal / cost <= 1 THEN 'warning' ELSE 'healthy' END AS runway_status, reason, CASE WHEN reason IS NULL AND cost >= 0.01 THEN round(greatest(0, s_acctbal / cost), 6) END AS runway_days
FROM (SELECT *, CASE WHEN s_suppkey % 11 = 0 THEN 'not configured' WHEN s_suppkey % 13 = 0 THEN 'disabled' WHEN s_suppkey % 7 = 0 THEN 'stale' END AS reason, CAST((s_suppkey % 5) * 1000 AS DOUBLE) AS cost FROM supplier)""")
def f21_runway(spark, d):
    k = F.col("s_suppkey")
    rows = T.read(spark, d, "supplier").select(F.concat(F.lit("d"), k.cast("string")).alias("domain"), (k % 11 != 0).alias("configured"), (k % 13 != 0).alias("enabled"), F.lit("ok").alias("status"), F.when(k % 7 == 0, NOW - 90000).otherwise(NOW - 60).alias("last_success_at"), F.col("s_acctbal").cast("double").alias("balance_usd"), F.lit(100.0).alias("coverage_pct"), (k % 5 * 1000).cast("double").alias("daily_cost_usd"), F.lit("").alias("missing_groups"))
    return rounded(channels.runway(rows, NOW))


@query("SELECT o_custkey AS domain, max(o_orderkey) AS version, max_by(o_orderstatus, o_orderkey) AS snapshot FROM orders GROUP BY 1")
def w7_latest_version(spark, d):
    return channels.latest_version(T.read(spark, d, "orders").select(F.col("o_custkey").alias("domain"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("snapshot")))


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'old' ELSE s_name END AS name, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1 WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END AS INTEGER) AS status,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN 7 WHEN s_suppkey % 2 = 1 THEN 0 WHEN s_suppkey % 3 = 0 THEN 7 ELSE 1000 END AS BIGINT) AS enabled_since, CAST(CASE WHEN s_suppkey % 5 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS deleted_at FROM supplier""")
def s12_snapshot(spark, d):
    s = T.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    before = s.select(k.alias("id"), F.lit("old").alias("name"), F.when((k % 3 == 0) | (k % 5 == 0), 1).otherwise(2).alias("status"), F.lit(7).cast("long").alias("enabled_since"), F.lit(0).alias("deleted_at"))
    now = s.where("s_suppkey % 5 <> 0").select(k.alias("id"), F.col("s_name").alias("name"), F.when(k % 2 == 0, 1).otherwise(2).alias("status"))
    return channels.snapshot(before, now, 1000)


def _listed(spark, d):
    k = F.col("p_partkey")
    return T.read(spark, d, "part").select(k.alias("id"), F.when(k % 4 == 3, 2).otherwise(1).alias("status"), F.concat_ws(", ", F.concat(F.lit(" g"), (k % 6).cast("string")), F.concat(F.lit("g"), (k % 3).cast("string"))).alias("groups"), F.concat_ws(",", F.concat(F.lit("m"), (k % 10).cast("string")), F.lit(""), F.lit("m1")).alias("models"))


LISTED = "WITH l AS (SELECT p_partkey AS id, unnest(list_distinct(['g' || (p_partkey % 6), 'g' || (p_partkey % 3)])) AS grp, list_distinct(['m' || (p_partkey % 10), 'm1']) AS ms FROM part WHERE p_partkey % 4 <> 3), x AS (SELECT id, grp, unnest(ms) AS model FROM l)"


@query(LISTED + " SELECT DISTINCT grp, model FROM x WHERE grp IN ('g1', 'g2', 'g4')")
def u3_selectable_pairs(spark, d):
    return channels.pairs(_listed(spark, d), spark.createDataFrame([("g1",), ("g2",), ("g4",)], "grp string"))


@query(LISTED + " SELECT grp, model, count(DISTINCT id) AS channels FROM x GROUP BY ALL")
def a42_channel_counts(spark, d):
    return channels.channel_counts(_listed(spark, d))


@query("""SELECT coalesce(a.grp, b.grp) AS grp, CASE WHEN a.grp IS NULL THEN 'added' WHEN b.grp IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT 'g' || p_partkey AS grp, p_size AS r FROM part WHERE p_partkey % 3 <> 0) a
  FULL JOIN (SELECT 'g' || p_partkey AS grp, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS r FROM part WHERE p_partkey % 4 <> 0) b ON a.grp = b.grp WHERE a.grp IS NULL OR b.grp IS NULL OR a.r <> b.r""")
def u7_catalog_changes(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("grp"), F.col("p_size").cast("double").alias("ratio"))
    return channels.catalog_changes(p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 4 <> 0").withColumn("ratio", F.col("ratio") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)))


@query(r"""SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, lower(regexp_extract(url, '^[a-z]+://(?:[^/:?#]*\.)?([^./:?#]+\.(?:com|net|org))(?:[/:?#]|$)', 1)) AS domain FROM pages""")
def f14_domains(spark, d):
    hosts = T.read(spark, d, "pages").select("page_id", S.host(F.col("url")).alias("host"))
    return channels.registrable(hosts, spark.createDataFrame([("com",), ("net",), ("org",)], "suffix string"))


# --- board, edge, evidence, infrastructure -----------------------------------------------------------------------


@query(T.MINUTES + f""", s AS (SELECT grp, model_name, sum(success + anomaly + failed) AS n, sum(success + anomaly) AS up, sum(failed - err_4xx) AS bad, coalesce(sum(success + anomaly) FILTER (WHERE bucket_ts >= {NOW - 86400}), 0) AS ud, coalesce(sum(failed - err_4xx) FILTER (WHERE bucket_ts >= {NOW - 86400}), 0) AS bd, max(bucket_ts) AS newest, {sums(*S.LATENCY, 'max_use_time')} FROM minutes GROUP BY ALL)
SELECT grp, model_name, CASE WHEN newest >= {NOW - 172800} AND n >= 20 THEN round(up * 100.0 / nullif(up + bad, 0), 6) END AS uptime, CASE WHEN newest >= {NOW - 172800} THEN nullif(round({T.percentile_sql(list(S.LATENCY), S.LATENCY_EDGES, 'max_use_time', 50)}, 6), 0) END AS p50,
  CASE WHEN ud + bd >= 20 THEN CASE WHEN ud / CAST(ud + bd AS DOUBLE) >= 0.99 THEN 'up' WHEN ud / CAST(ud + bd AS DOUBLE) >= 0.5 THEN 'warn' ELSE 'down' END ELSE 'up' END AS state FROM s""")
def a41_board(spark, d):
    return rounded(board.totals(_minutes(spark, d), NOW))


@query(T.MINUTES + f""", p AS (SELECT grp AS key, least(49, greatest(0, CAST(floor((bucket_ts // 14400 * 14400 - {SINCE}) / {864000 / 50!r}) AS INTEGER))) AS ix, sum(success + anomaly) AS up, sum(failed) AS fail FROM minutes WHERE bucket_ts >= {SINCE} GROUP BY ALL),
x AS (SELECT key, ix FROM (SELECT DISTINCT key FROM p), (SELECT unnest(range(50)) AS ix)) SELECT x.key, string_agg(CASE WHEN coalesce(up + fail, 0) < 5 THEN 'u' WHEN up / CAST(up + fail AS DOUBLE) >= 0.99 THEN 'u' WHEN up / CAST(up + fail AS DOUBLE) >= 0.5 THEN 'w' ELSE 'd' END, '' ORDER BY x.ix) AS beats FROM x LEFT JOIN p ON p.key = x.key AND p.ix = x.ix GROUP BY 1""")
def f27_beats(spark, d):
    return board.beats(kpi.series(_minutes(spark, d), "grp", SINCE, 864000), SINCE, NOW)


def _lines(spark, d):
    e = T.logs(spark, d)
    k = F.col("k")
    code = (200 + k % 4 * 100).cast("string")
    path = F.when(k % 4 == 0, "/v1/chat/completions?x=1").when(k % 4 == 1, "/v1/embeddings").when(k % 4 == 2, "/api/user/self").otherwise("/index.html")
    line = F.to_json(F.struct(
        F.col("created_at").cast("double").alias("ts"), (F.col("created_at") + 5000).alias("msec"), F.when(k % 5 == 0, "brew").otherwise("get").alias("method"), path.alias("path"), F.lit("/v1/models").alias("uri"), F.when(k % 17 == 0, "bad").otherwise(code).alias("status"),
        (k / 1600).cast("string").alias("request_time"), F.when(k % 13 == 0, "502, -").when(k % 11 == 0, "-").otherwise(F.concat(F.lit("502, "), code)).alias("upstream_status"), F.when(k % 3 == 0, "-").otherwise(F.concat(F.lit("0.5 : "), (k / 200).cast("string"))).alias("upstream_response_time"),
        F.when(k % 2 == 0, "-").otherwise("r").alias("request_id"), F.when(k % 19 == 0, "17179869185").otherwise((k * 10).cast("string")).alias("bytes_sent")))
    return e.select(F.concat(F.lit("node-"), (F.col("user_id") % 3).cast("string")).alias("node"), line.alias("line")).unionByName(spark.createDataFrame([("node-0", "no json"), ("node-0", None)], "node string, line string"))


EDGE = T.LOGS + """, edge AS (SELECT created_at // 60 * 60 AS bucket_ts, 'node-' || (user_id % 3) AS node, CASE k % 4 WHEN 0 THEN '/v1/chat/completions' WHEN 1 THEN '/v1/*' WHEN 2 THEN '/api/*' ELSE '/other' END AS route, CASE WHEN k % 5 = 0 THEN 'OTHER' ELSE 'GET' END AS method,
  CAST(200 + k % 4 * 100 AS INTEGER) AS status, CASE WHEN k % 11 = 0 THEN 0 ELSE CAST(200 + k % 4 * 100 AS INTEGER) END AS upstream_status, count(*) AS count,
  CAST(sum(round(k / 1600 * 1000)) AS BIGINT) AS time_sum_ms, CAST(max(round(k / 1600 * 1000)) AS BIGINT) AS time_max_ms, CAST(coalesce(sum(round(k / 200 * 1000)) FILTER (WHERE k % 3 <> 0), 0) AS BIGINT) AS upstream_sum_ms,
  count(*) FILTER (WHERE k % 3 <> 0) AS upstream_count, CAST(sum(k * 10) AS BIGINT) AS bytes_sent, count(*) FILTER (WHERE k % 2 = 1) AS with_id FROM logs WHERE k % 17 <> 0 AND k % 13 <> 0 AND k % 19 <> 0 GROUP BY ALL)"""


@query(EDGE + " SELECT * FROM edge")
def a37_edge_minutes(spark, d):
    return edge.minutes(edge.parse(_lines(spark, d)))


@query(EDGE + """ SELECT node, CAST(sum(count) AS BIGINT) AS requests, """ + ", ".join(f"CAST(coalesce(sum(count) FILTER (WHERE status // 100 = {c}), 0) AS BIGINT) AS n_{c}xx" for c in (2, 3, 4, 5)) + """, round(sum(time_sum_ms) / CAST(sum(count) AS DOUBLE), 6) AS avg_ms, max(time_max_ms) AS max_ms, CAST(sum(bytes_sent) AS BIGINT) AS bytes, round(sum(with_id) * 100.0 / sum(count), 6) AS id_coverage FROM edge GROUP BY 1""")
def a36_edge_report(spark, d):
    return rounded(edge.report(edge.minutes(edge.parse(_lines(spark, d))), "node"))


@query(T.LOGS + """, t AS (SELECT 'node-' || (user_id % 7) AS node, max(created_at) - 300 * (user_id % 7) AS last FROM logs GROUP BY user_id % 7), s AS (SELECT node, {0} - last AS age, node IN ('node-1', 'node-2') AS held, node = 'node-1' AS large, node = 'node-2' AS broken, node = 'node-0' AS lost FROM t)
SELECT node, age, CASE WHEN age > 900 THEN 'bad' WHEN age > 180 OR large OR broken OR lost THEN 'warn' ELSE 'ok' END AS state,
  concat_ws(',', CASE WHEN age > 180 THEN 'heartbeat_stale' END, CASE WHEN large THEN 'backlog_large' END, CASE WHEN held AND age + 60 > 180 THEN 'event_lag_with_backlog' END, CASE WHEN broken THEN 'recent_cursor_discontinuity' END, CASE WHEN lost THEN 'recent_discarded_lines' END) AS reasons FROM s""".replace("{0}", "1706659200"))
def r5_source_health(spark, d):
    n = F.col("user_id") % 7
    states = T.logs(spark, d).groupBy(n.alias("n")).agg((F.max("created_at") - 300 * F.first(n)).alias("last_ingest_ts"))
    states = states.select(
        F.concat(F.lit("node-"), F.col("n").cast("string")).alias("node"), "last_ingest_ts", (F.col("last_ingest_ts") - 60).alias("last_event_ts"), F.when(F.col("n") == 1, 1 << 30).when(F.col("n") == 2, 1).when(F.col("n") == 3, 0).alias("backlog_bytes"),
        F.when(F.col("n") == 2, 1706659200 - 900).when(F.col("n") == 3, 1706659200 - 901).otherwise(0).alias("last_cursor_discontinuity_at"), F.when(F.col("n") == 0, 1706659200).alias("last_discarded_at"))
    return edge.source_health(states, 1706659200)


def _evidence(spark, d):
    e = T.logs(spark, d)
    k = F.col("k")
    base = e.select(F.col("id").alias("event_id"), (F.col("created_at") * 1000).alias("occurred_at_ms"), F.concat(F.lit("t"), (F.col("id") % 4000).cast("string")).alias("trace"), F.concat(F.lit("l"), (F.col("id") % 1500).cast("string")).alias("logical"), (F.col("id") % 3).alias("retry"), "k", "type")
    outcome = F.when(k % 10 < 7, "succeeded").when(k % 10 == 7, "user_cancelled").otherwise("client_timeout")
    start = F.col("type") == 2
    return base.select("event_id", "occurred_at_ms", "trace", "logical", "retry", F.when(start & (k % 2 == 0), "request_started").otherwise("request_outcome").alias("event_type"), F.when(start & (k % 2 == 0), F.lit(None)).otherwise(outcome).alias("outcome"))


EV = T.LOGS + """, e AS (SELECT id AS event_id, created_at * 1000 AS occurred_at_ms, 't' || (id % 4000) AS trace, 'l' || (id % 1500) AS logical, id % 3 AS retry, CASE WHEN type = 2 AND k % 2 = 0 THEN 'request_started' ELSE 'request_outcome' END AS event_type,
  CASE WHEN type = 2 AND k % 2 = 0 THEN NULL WHEN k % 10 < 7 THEN 'succeeded' WHEN k % 10 = 7 THEN 'user_cancelled' ELSE 'client_timeout' END AS outcome FROM logs),
st AS (SELECT trace, max(logical) AS logical FROM e WHERE event_type = 'request_started' GROUP BY 1), oc AS (SELECT trace, count(DISTINCT outcome) AS kinds, bool_or(outcome = 'succeeded') AS ok, bool_or(outcome = 'user_cancelled') AS cancelled FROM e WHERE event_type = 'request_outcome' GROUP BY 1),
j AS (SELECT st.trace, st.logical, kinds, ok, cancelled FROM st LEFT JOIN oc ON st.trace = oc.trace)"""


@query(EV + """ SELECT count(*) AS started, count(kinds) AS reported, count(*) FILTER (WHERE kinds > 1) AS conflicts, count(*) FILTER (WHERE cancelled) AS cancelled, count(*) FILTER (WHERE kinds = 1 AND NOT cancelled) AS judged, count(*) FILTER (WHERE kinds = 1 AND NOT cancelled AND ok) AS succeeded,
  round(count(kinds) * 100.0 / count(*), 6) AS coverage, round(count(*) FILTER (WHERE kinds = 1 AND NOT cancelled AND ok) * 100.0 / nullif(count(*) FILTER (WHERE kinds = 1 AND NOT cancelled), 0), 6) AS success_rate, (SELECT count(*) FROM e WHERE event_type = 'request_outcome' AND trace NOT IN (SELECT trace FROM st)) AS orphans,
  count(*) >= 20 AND count(*) FILTER (WHERE kinds = 1 AND NOT cancelled) >= 20 AND count(kinds) * 100.0 / count(*) >= 95 AND count(*) FILTER (WHERE kinds > 1) = 0 AND (SELECT count(*) FROM e WHERE event_type = 'request_outcome' AND trace NOT IN (SELECT trace FROM st)) = 0 AS sufficient FROM j""")
def a39_cohort(spark, d):
    return rounded(evidence.cohort(_evidence(spark, d)))


@query(T.LOGS + """ SELECT count(*) AS started, count(*) FILTER (WHERE id % 50 <> 0) AS reported, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS cancelled, count(*) FILTER (WHERE id % 50 <> 0) AS judged, count(*) FILTER (WHERE id % 50 <> 0 AND k % 4 <> 0) AS succeeded,
  round(count(*) FILTER (WHERE id % 50 <> 0) * 100.0 / count(*), 6) AS coverage, round(count(*) FILTER (WHERE id % 50 <> 0 AND k % 4 <> 0) * 100.0 / count(*) FILTER (WHERE id % 50 <> 0), 6) AS success_rate, CAST(0 AS BIGINT) AS orphans, count(*) FILTER (WHERE id % 50 <> 0) * 100.0 / count(*) >= 95 AS sufficient FROM logs WHERE type = 2""")
def a39_sound_cohort(spark, d):
    rows = T.logs(spark, d).where("type = 2").select(F.col("id").cast("string").alias("trace"), F.col("id").cast("string").alias("logical"), F.lit(0).alias("retry"), F.col("created_at").alias("occurred_at_ms"), "id", "k")
    begun = rows.withColumns({"event_type": F.lit("request_started"), "outcome": F.lit(None).cast("string")})
    done = rows.where("id % 50 <> 0").withColumns({"event_type": F.lit("request_outcome"), "outcome": F.when(F.col("k") % 4 == 0, "client_timeout").otherwise("succeeded")})
    return rounded(evidence.cohort(begun.unionByName(done)))


@query(EV + " SELECT count(*) AS events, count(DISTINCT trace) AS traces FROM e WHERE event_type = 'request_outcome' AND trace NOT IN (SELECT trace FROM st)")
def j10_orphans(spark, d):
    return evidence.orphans(_evidence(spark, d))


@query(EV + " SELECT logical, count(*) AS attempts, count(*) > 1 AS retried, coalesce(bool_or(ok), false) AS eventually FROM j GROUP BY 1")
def a40_retries(spark, d):
    return evidence.retries(_evidence(spark, d))


@query(EV + " SELECT logical, trace, outcome FROM (SELECT *, row_number() OVER (PARTITION BY logical ORDER BY retry, occurred_at_ms, event_id) AS rn FROM e WHERE event_type = 'request_outcome' AND outcome <> 'user_cancelled') WHERE rn = 1")
def w1_first_outcomes(spark, d):
    return evidence.first_outcomes(_evidence(spark, d))


def _samples(spark, d):
    e = T.logs(spark, d)
    kind = F.when(F.col("user_id") % 3 == 0, "database").when(F.col("user_id") % 3 == 1, "lb").otherwise("instance")
    metric = F.element_at(F.array(*map(F.lit, ("cpu", "mem_total_mb", "free_mem_mb", "mem_avail_mb", "resp_ms", "unhealthy"))), (F.col("id") % 6 + 1).cast("int"))
    value = F.when(F.col("id") % 6 == 1, 100.0).when(F.col("id") % 6 == 5, (F.col("k") > 90).cast("double")).otherwise(F.col("k").cast("double"))
    return e.select((F.col("created_at") * 100000 + F.col("id")).alias("bucket_ts"), F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("resource"), kind.alias("rtype"), metric.alias("metric"), value.alias("value"))


INFRA = T.LOGS + """, i AS (SELECT created_at * 100000 + id AS ts, 'r' || user_id AS resource, CASE user_id % 3 WHEN 0 THEN 'database' WHEN 1 THEN 'lb' ELSE 'instance' END AS rtype, id % 6 AS m, CAST(CASE WHEN id % 6 = 1 THEN 100 WHEN id % 6 = 5 THEN CASE WHEN k > 90 THEN 1 ELSE 0 END ELSE k END AS DOUBLE) AS v FROM logs),
w AS (SELECT resource, rtype, max(ts) AS newest, """ + ", ".join(f"max_by(v, ts) FILTER (WHERE m = {i}) AS {n}" for i, n in enumerate(("cpu", "total", "free", "avail", "resp", "unhealthy"))) + """ FROM i GROUP BY ALL),
s AS (SELECT resource, rtype, newest, CASE rtype WHEN 'database' THEN CASE WHEN coalesce(free / nullif(total, 0) * 100 < 5, false) OR coalesce(cpu > 95, false) THEN 'bad' WHEN coalesce(free / nullif(total, 0) * 100 < 15, false) OR coalesce(cpu > 80, false) THEN 'warn' ELSE 'ok' END
  WHEN 'lb' THEN CASE WHEN coalesce(unhealthy >= 1, false) THEN 'bad' WHEN coalesce(resp > 1000, false) THEN 'warn' ELSE 'ok' END
  ELSE CASE WHEN coalesce(cpu > 95, false) OR coalesce((total - avail) / nullif(total, 0) * 100 > 95, false) THEN 'bad' WHEN coalesce(cpu > 80, false) OR coalesce((total - avail) / nullif(total, 0) * 100 > 85, false) THEN 'warn' ELSE 'ok' END END AS state FROM w)"""


@query(INFRA + " SELECT * FROM s")
def a43_resource_states(spark, d):
    return board.resource_states(board.wide(_samples(spark, d)))


@query(INFRA + " SELECT rtype, count(*) AS resources, CASE WHEN bool_or(state = 'bad') THEN 'bad' WHEN bool_or(state = 'warn') THEN 'warn' ELSE 'ok' END AS state FROM s GROUP BY 1")
def t6_overview(spark, d):
    return board.overview(board.resource_states(board.wide(_samples(spark, d))))


# --- alerts and projection ---------------------------------------------------------------------------------------


@query(T.LOGS.replace("WITH ev", "WITH RECURSIVE ev", 1) + """, e AS (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'anomaly_rate' ELSE 'error_rate' END AS kind, CAST(channel_id AS VARCHAR) AS target, created_at AS ts, CASE WHEN k % 2 = 0 THEN 7200 ELSE 1800 END AS wait FROM logs WHERE type = 5),
f AS (SELECT kind, target, min(ts) AS ts FROM e GROUP BY 1, 2 UNION ALL SELECT f.kind, f.target, min(e.ts) FROM f JOIN e ON e.kind = f.kind AND e.target = f.target AND e.ts >= f.ts + e.wait GROUP BY f.kind, f.target) SELECT * FROM f""")
def r7_cooldown(spark, d):
    events = T.logs(spark, d).where("type = 5").select(F.when(F.col("k") % 2 == 0, "anomaly_rate").otherwise("error_rate").alias("kind"), F.col("channel_id").cast("string").alias("target"), F.col("created_at").alias("ts"))
    return alerts.fired(events, {"anomaly_rate": 7200})


@query(T.LOGS + " SELECT id, CASE WHEN type = 5 THEN CASE WHEN lower(content) LIKE '%timeout%' THEN 'timeout' WHEN content LIKE '%status_code=4%' THEN '4xx' WHEN content LIKE '%status_code=5%' THEN '5xx' ELSE 'other' END END AS kind, type = 2 AND token_name = 'probe' AND content = 'probe' AS test, frt FROM logs")
def p4_classification(spark, d):
    return T.logs(spark, d).select("id", F.when(F.col("type") == 5, C.error_kind()).alias("kind"), C.is_test(T.RULES).alias("test"), C.json_long("$.frt").alias("frt"))


@query(T.LOGS + " SELECT id, sha256(unhex('" + (b"key".ljust(64, b"\0").translate(bytes(x ^ 0x5C for x in range(256)))).hex() + "') || unhex(sha256(unhex('" + (b"key".ljust(64, b"\0").translate(bytes(x ^ 0x36 for x in range(256)))).hex() + "') || encode(request_id)))) AS pseudonym FROM logs")
def f26_pseudonyms(spark, d):
    return T.logs(spark, d).select("id", S.hmac_sha256(b"key", F.col("request_id")).alias("pseudonym"))


@query("SELECT conv_id, turn, role, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1")
def w3_latest_per_key(spark, d):
    rows = T.read(spark, d, "conversations")
    return usage.latest(rows, ["conv_id"], ["turn"]).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


# --- sources and streams -----------------------------------------------------------------------------------------


@query(T.LOGS + " SELECT 'node-' || (k % 2) AS node, k AS batch_id, count(*) AS copies, min(quota) <> max(quota) AS conflict FROM logs GROUP BY 1, 2")
def u8_batch_conflicts(spark, d):
    rows = T.logs(spark, d).select(F.concat(F.lit("node-"), (F.col("k") % 2).cast("string")).alias("node"), F.col("k").alias("batch_id"), "quota")
    return tables.batches(rows, ["node", "batch_id"], F.col("quota"))


@query(T.LOGS + ", " + T.REJECTIONS + " SELECT bucket_ts, node, reason, model, grp, CAST(2 * sum(count) AS BIGINT) AS count FROM rejections GROUP BY ALL")
def s11_additive_merge(spark, d):
    rows = T.rejections(spark, d)
    keys = ["bucket_ts", "node", "reason", "model", "grp"]
    return tables.merge_additive(rows.groupBy(*keys).agg(F.sum("count").alias("count")), rows, keys, ["count"])


@query(T.LOGS + f" SELECT id, CASE WHEN created_at >= {NOW - 86400} THEN -quota ELSE quota END AS quota FROM logs")
def s9_replace_by_key(spark, d):
    rows = T.logs(spark, d).select("id", "quota", "created_at")
    fresh = rows.where(F.col("created_at") >= NOW - S.DAY).select("id", (-F.col("quota")).alias("quota"))
    return tables.replace_by_key(rows.select("id", "quota"), fresh, ["id"])


@query(HOURS + f" SELECT hour_ts, channel_id, model_name, grp, success FROM hours WHERE hour_ts >= {NOW - 3 * 86400}")
def s14_retention(spark, d):
    return tables.retained(_hours(spark, d), "hour_ts", NOW - 3 * S.DAY).select("hour_ts", "channel_id", "model_name", "grp", "success")


@query(HOURS + f", dd AS (SELECT {DAY_SQL.format('hour_ts')} AS date_ts, channel_id, success FROM hours) SELECT date_ts, channel_id, CAST(sum(CASE WHEN date_ts >= {SINCE} THEN 2 * success ELSE success END) AS BIGINT) AS success FROM dd GROUP BY 1, 2")
def s10_replace_range(spark, d):
    path = tables.shared_folder(spark)
    days = _hours(spark, d).groupBy(S.day("hour_ts").alias("date_ts"), "channel_id").agg(F.sum("success").alias("success"))
    tables.replace_partitions(days, path, "date_ts")
    tables.replace_partitions(days.where(F.col("date_ts") >= SINCE).withColumn("success", F.col("success") * 2), path, "date_ts")
    return spark.read.parquet(path).select(F.col("date_ts").cast("long").alias("date_ts"), "channel_id", "success")


@query(T.LOGS + " SELECT id, created_at, model_name, quota FROM logs ORDER BY id DESC LIMIT 50000")
def s16_csv_export(spark, d):
    path = tables.shared_folder(spark)
    rows = T.logs(spark, d).select("id", "created_at", "model_name", "quota")
    tables.export_csv(rows, path, rows.agg(F.max("id")).first()[0] or 0)
    return spark.read.schema("id long, created_at long, model_name string, quota long").option("header", True).csv(path)


@query(T.TRAFFIC + f" SELECT created_at // 60 * 60 AS bucket_ts, model_name, {T.measures_sql('success', 'anomaly', 'failed', 'tokens', 'quota', 'max_use_time')} FROM traffic GROUP BY ALL")
def r1_minute_stream(spark, d):
    schema = T.read(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = T.as_logs(source).withColumn("at", F.timestamp_seconds("created_at"))
    path = tables.shared_folder(spark)
    jobs.keyed_sink(jobs.minute_stream(rows, T.RULES, "400 days"), path, tables.shared_folder(spark)).awaitTermination()
    return jobs.latest_of(spark.read.parquet(path), ["bucket_ts", "model_name"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM (SELECT l_orderkey // 2 AS l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL HAVING count(*) > 1")
def u10_duplicate_keys(spark, d):
    rows = T.read(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 2).cast("long").alias("l_orderkey"), "l_linenumber")
    return tables.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])
