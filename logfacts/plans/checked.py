"""Registered queries with faults planted in their data: live projection, coverage, evidence, prices, burn, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfacts.functions import scalars as S
from logfacts.operators import audit, channels, evidence, projection, rollup, stability
from logfacts.plans import testmap as T
from logfacts.plans.queries import DAY_SQL, HOURS, NOW, ORACLES, QUERIES, SINCE, _hours, _usage, query, rounded

# --- live projection ----------------------------------------------------------------------------------------------

_DAY = (SINCE + S.ZONE) // S.DAY * S.DAY - S.ZONE
_FIN = _DAY + 12 * 3600
_AT = _FIN + 3000
_NEED = projection.Standing(epoch="e1")
#: By the number of a group of users (user_id % 20) what is wrong with those of its members whose user_id / 20 is even; 0, 7 and 20 are fine.
FAULTS = {1: "unpublished", 2: "inactive", 3: "epoch", 4: "classification", 5: "semantics", 6: "revision", 8: "floor", 9: "history", 10: "coverage", 11: "verification", 12: "through", 13: "gone", 14: "stale", 15: "ahead", 16: "anchor", 17: "falls", 18: "used", 19: "before"}


def _readings(spark, d):
    """Members, publications, states, snapshots, watermarks and hour facts of all users, each fault in its group."""
    facts = _usage(spark, d)
    users = facts.select("user_id").distinct()
    fault = F.lit("")
    for number, name in FAULTS.items():
        fault = F.when((F.col("user_id") % 20 == number) & (F.floor(F.col("user_id") / 20) % 2 == 0), name).otherwise(fault)
    users = users.where("user_id > 0").withColumn("fault", fault)
    bad = lambda name, wrong, right: F.when(F.col("fault") == name, wrong).otherwise(right)
    u = F.col("user_id")
    members = users.select((u % 20).alias("group_id"), "user_id")
    published = users.where("fault <> 'unpublished'").select(
        "user_id", F.when(u % 20 == 7, 0).when(F.col("fault") == "revision", 3).otherwise(1).alias("tracked_revision"), F.lit("e1").alias("source_epoch"), bad("classification", 4, 5).alias("classification_version"),
        bad("semantics", 0, 1).alias("query_semantics_version"), F.lit(_DAY - S.DAY).alias("source_floor_hour"), F.lit(_DAY).alias("published_at"))
    states = users.select(
        "user_id", bad("inactive", False, True).alias("active"), F.lit(1).alias("tracked_revision"), bad("epoch", "e0", "e1").alias("source_epoch"), bad("classification", 4, 5).alias("classification_version"),
        bad("semantics", 0, 1).alias("query_semantics_version"), bad("floor", _DAY, _DAY - S.DAY).alias("source_floor_hour"), F.when(F.col("fault").isin("used"), "no_history").when(F.col("fault") == "history", "partial").otherwise("complete_hot").alias("source_history_status"),
        bad("coverage", "building", "ready").alias("coverage_status"), bad("verification", "failed", "complete").alias("verification_status"), bad("through", _DAY - 1, _DAY).alias("coverage_through_hour"))
    read = F.when(F.col("fault") == "stale", _AT - 1801).when(F.col("fault") == "ahead", _AT + 61).when(F.col("fault") == "before", _FIN + 300).otherwise(_AT - u % 30)
    snapshots = users.select("user_id", bad("gone", False, True).alias("exists"), read.alias("captured_at"), (u * 1000 + bad("falls", -1, 200)).alias("used_quota"))
    late = bad("anchor", 901, F.when(F.col("fault") == "before", 400).otherwise(100))
    marks = users.select("user_id", late.alias("late"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n"))
    marks = marks.select("user_id", (F.lit(_FIN) + F.col("late") + F.col("n") * 500).alias("captured_at"), (F.col("user_id") * 1000 + F.col("n") * 50).alias("used_quota"), F.lit(True).alias("exists"))
    early = users.select("user_id", F.lit(_FIN - 10).cast("long").alias("captured_at"), F.lit(0).cast("long").alias("used_quota"), F.lit(True).alias("exists"))
    return members, published, states, snapshots, marks.unionByName(early), facts


def _told(spark, d):
    members, published, states, snapshots, marks, facts = _readings(spark, d)
    return projection.live(members, published, states, snapshots, marks, facts, _DAY, _FIN, _AT, _NEED), facts


#: What is left in SQL: the groups whose members are all sound (0 and 7 by plan, others whose members are all odd).
_LIVE = T.USAGE + f""", u AS (SELECT DISTINCT user_id, user_id % 20 AS group_id, user_id // 20 % 2 = 0 AND user_id % 20 NOT IN (0, 7) AS bad FROM usage WHERE user_id > 0),
g AS (SELECT group_id, least(min({_AT} - user_id % 30), {_AT}) AS through FROM u GROUP BY 1 HAVING NOT bool_or(bad)),
h AS (SELECT user_id, sum(consume_quota - refund_quota) AS q FROM usage WHERE hour_ts >= {_DAY} AND hour_ts < {_FIN} GROUP BY 1),
told AS (SELECT u.group_id, u.user_id, CAST(coalesce(q, 0) + 200 AS BIGINT) AS today_net, through FROM u JOIN g ON g.group_id = u.group_id LEFT JOIN h ON h.user_id = u.user_id)"""


@query(_LIVE + " SELECT group_id, user_id, today_net, through FROM told")
def r9_projection(spark, d):
    """By group of users, each with another fault: all of a group or nothing."""
    return _told(spark, d)[0]


_CELLS = f", cells AS (SELECT user_id % 20 AS group_id, user_id, {DAY_SQL.format('hour_ts')} AS date_ts, CAST(sum(consume_quota) + max(CASE WHEN user_id = 20 THEN 100000000 ELSE 0 END) AS BIGINT) AS consume_quota, CAST(sum(refund_quota) AS BIGINT) AS refund_quota FROM usage WHERE user_id > 0 AND hour_ts < {_FIN} GROUP BY ALL)"


def _cells(facts):
    """Users by day up to the finalised hour; one of group 0 has more than its counter says, so that group must stay."""
    rows = facts.where((F.col("user_id") > 0) & (F.col("hour_ts") < _FIN)).groupBy((F.col("user_id") % 20).alias("group_id"), "user_id", S.day("hour_ts").alias("date_ts"))
    return rows.agg((F.sum("consume_quota") + F.max(F.when(F.col("user_id") == 20, 100000000).otherwise(0))).alias("consume_quota"), F.sum("refund_quota").alias("refund_quota"))


@query(_LIVE + _CELLS + f""", k AS (SELECT told.*, consume_quota - refund_quota AS net FROM told LEFT JOIN cells ON cells.user_id = told.user_id AND date_ts = {_DAY}), ok AS (SELECT group_id FROM k GROUP BY 1 HAVING bool_and(net IS NULL OR today_net >= net)),
r AS (SELECT k.group_id, user_id, {_DAY} AS date_ts, today_net - coalesce(net, 0) AS delta, through FROM k JOIN ok ON ok.group_id = k.group_id WHERE net IS NOT NULL OR today_net <> 0)
SELECT coalesce(cells.group_id, r.group_id) AS group_id, coalesce(cells.user_id, r.user_id) AS user_id, coalesce(cells.date_ts, r.date_ts) AS date_ts, CAST(coalesce(consume_quota, 0) + coalesce(delta, 0) AS BIGINT) AS consume_quota, coalesce(refund_quota, 0) AS refund_quota, through
FROM cells FULL JOIN r ON cells.user_id = r.user_id AND cells.date_ts = r.date_ts""")
def r9_live_matrix(spark, d):
    told, facts = _told(spark, d)
    return projection.on_matrix(_cells(facts), told, _DAY)


@query(_LIVE + _CELLS + f""", dd AS (SELECT group_id, date_ts, sum(consume_quota) AS c, sum(refund_quota) AS r FROM cells GROUP BY ALL), w AS (SELECT group_id, sum(today_net) AS target FROM told GROUP BY 1),
x AS (SELECT w.group_id, target - coalesce(c - r, 0) AS delta FROM w LEFT JOIN dd ON dd.group_id = w.group_id AND date_ts = {_DAY})
SELECT group_id, '{projection.UNASSIGNED}' AS key, CAST(delta AS BIGINT) AS consume_quota FROM x WHERE delta > 0""")
def r9_live_days(spark, d):
    """What the lists by group and by model get beside their facts."""
    told, facts = _told(spark, d)
    days = _cells(facts).groupBy("group_id", "date_ts").agg(F.sum("consume_quota").alias("consume_quota"), F.sum("refund_quota").alias("refund_quota"))
    return projection.on_days(days, told, _DAY)[1]


# --- coverage, evidence -------------------------------------------------------------------------------------------

_LED = f", l AS (SELECT DISTINCT hour_ts, CASE WHEN hour_ts // 3600 % 6 = 0 THEN 4 WHEN hour_ts // 3600 % 13 = 0 THEN NULL ELSE 5 END AS v, CASE WHEN hour_ts // 3600 % 11 = 0 THEN 'running' ELSE 'complete' END AS status FROM hours WHERE hour_ts >= {SINCE} AND hour_ts < {NOW})"
_UNTIL = (NOW + 1800 - 600) // 3600 * 3600


@query(HOURS + _LED + f""", c AS (SELECT count(*) FILTER (WHERE status = 'complete' AND v = 5) AS completed, count(*) FILTER (WHERE status = 'complete') AS effective FROM l)
SELECT {SINCE} AS from_ts, {_UNTIL} AS to_ts, CAST(240 AS BIGINT) AS expected, completed, 240 - completed AS missing, round(completed * 100.0 / 240, 6) AS percent, completed = 240 AS complete, effective, 240 - effective AS effective_missing,
  round(effective * 100.0 / 240, 6) AS effective_percent, effective = 240 AS effective_complete, effective - completed AS legacy, false AS pending, CAST(NULL AS INTEGER) AS pending_ts FROM c""")
def a26_coverage(spark, d):
    """Asked for two hours more than can be final."""
    hour = F.expr("hour_ts div 3600")
    ledger = _hours(spark, d).select("hour_ts").distinct().withColumns({"traffic_class_version": F.when(hour % 6 == 0, 4).when(hour % 13 == 0, F.lit(None)).otherwise(5), "status": F.when(hour % 11 == 0, "running").otherwise("complete")})
    return rounded(stability.coverage(ledger, SINCE, NOW + 7200, NOW + 1800))


_PLANTED = {
    "envelope": ("version", "CASE WHEN id % 40 = 1 THEN 2 ELSE 1 END"), "token": ("event_id", "CASE WHEN id % 40 = 2 THEN 'e ' || id WHEN id % 40 = 3 THEN repeat('x', 129) ELSE 'e-' || id END"),
    "client": ("client_version", "CASE WHEN id % 40 = 4 THEN '' WHEN id % 40 = 5 THEN repeat('1', 65) ELSE '1.2' END"), "retry": ("retry", "CASE WHEN id % 40 = 6 THEN 101 WHEN id % 40 = 7 THEN -1 ELSE id % 3 END"),
    "time": ("occurred_at_ms", f"CASE WHEN id % 40 = 8 THEN {NOW * 1000 + 600001} WHEN id % 40 = 9 THEN {NOW * 1000 + 600000} WHEN id % 40 = 10 THEN {NOW * 1000 - 370 * 86400000 - 1} WHEN id % 40 = 11 THEN {NOW * 1000 - 370 * 86400000} ELSE {NOW * 1000} END"),
    "request": ("request_id", "CASE WHEN id % 40 = 12 THEN '   ' WHEN id % 40 = 13 THEN repeat('r', 257) WHEN id % 40 = 14 THEN repeat(' ', 9) || repeat('r', 256) ELSE 'req-' || id END"),
    "kind": ("event_type", "CASE WHEN id % 40 = 15 THEN 'request_paused' WHEN id % 2 = 0 THEN 'request_started' ELSE 'request_outcome' END"),
    "outcome": ("outcome", "CASE WHEN id % 40 = 16 THEN 'succeeded' WHEN id % 40 = 17 THEN 'lost' WHEN id % 40 = 19 THEN NULL WHEN id % 2 = 0 THEN NULL ELSE 'client_timeout' END"),
    "signature": ("error_signature", "CASE WHEN id % 40 = 18 THEN 'E1' WHEN id % 40 = 21 THEN repeat('s', 97) WHEN id % 40 = 23 THEN 'a b' WHEN id % 40 = 25 THEN 'conn.reset' ELSE '' END"),
    "metadata": ("protocol", "CASE WHEN id % 40 = 20 THEN repeat('p', 49) ELSE 'https' END"), "model": ("model", "CASE WHEN id % 40 = 22 THEN repeat('模', 43) WHEN id % 40 = 24 THEN repeat('模', 42) ELSE 'm' END"),
    "logical": ("logical_key", "CASE WHEN id % 40 = 26 THEN repeat('k', 257) ELSE 'k' END"),
}
_REASONS = {"envelope": (1, 2, 3, 4, 5, 6, 7, 15), "time": (8, 10), "request": (12, 13), "start": (16, 18), "outcome": (17, 19), "metadata": (20, 21, 22, 23), "logical": (26,)}
_WHY = "CASE " + " ".join(f"WHEN id % 40 IN ({', '.join(map(str, n))}) THEN '{reason}'" for reason, n in _REASONS.items()) + " END"


@query(T.LOGS + f" SELECT id, {_WHY} AS reason FROM logs")
def p17_valid_evidence(spark, d):
    """Every rule broken by some events, with others at its very bounds."""
    events = T.logs(spark, d).select("id", *(F.expr(e).alias(c) for c, e in _PLANTED.values()))
    good, bad = evidence.split(events, NOW * 1000)
    return good.select("id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", "reason"))


# --- prices and burn ----------------------------------------------------------------------------------------------

_HIST = f"""WITH k AS (SELECT s_suppkey AS channel_id, 'grp-' || (s_suppkey % 5) AS grp, 'domain-' || (s_suppkey % 4) AS domain FROM supplier),
pair AS (SELECT channel_id, grp, 7.0 AS m, 0.8 AS f, 'up' AS name FROM k WHERE channel_id % 9 = 0), chan AS (SELECT channel_id, CASE WHEN channel_id % 9 = 0 THEN 7.0 ELSE 3.0 END AS m, CASE WHEN channel_id % 9 = 0 THEN 0.8 ELSE 1.0 END AS f, channel_id % 10 = 4 AS conflict FROM k WHERE channel_id % 9 = 0 OR channel_id % 5 = 4),
v AS (SELECT k.*, CASE WHEN k.channel_id % 9 = 0 THEN 'pair' WHEN chan.m IS NOT NULL AND NOT conflict THEN 'channel' WHEN domain <> 'domain-3' THEN 'domain' ELSE 'none' END AS price_from,
  coalesce(conflict AND k.channel_id % 9 <> 0, false) OR (k.channel_id % 9 = 0 AND k.channel_id % 5 = 4) AS conflict, CASE WHEN grp <> 'grp-3' THEN 1.2 END AS site FROM k LEFT JOIN chan ON chan.channel_id = k.channel_id)"""


def _finance(spark, d):
    """Pairs of channels and groups, and the histories of their prices; rows that take effect later than NOW must not show."""
    s = T.read(spark, d, "supplier")
    key = F.col("s_suppkey")
    pairs = s.select(key.alias("channel_id"), F.concat(F.lit("grp-"), (key % 5).cast("string")).alias("grp"), F.concat(F.lit("domain-"), (key % 4).cast("string")).alias("domain"))
    lit = lambda **c: {n: F.lit(v) for n, v in c.items()}
    # pairs: a rate of 7 with a discount, an older one that it replaces, a later one that is not in force
    exact = pairs.where("channel_id % 9 = 0").select("channel_id", "grp", F.explode(F.array(*(F.struct(F.lit(m).alias("multiplier"), F.lit(at).alias("effective_at")) for m, at in ((5.0, NOW - 99), (7.0, NOW - 1), (9.0, NOW + 1))))).alias("v")).select("channel_id", "grp", "v.*").withColumns(lit(discount=0.8, upstream_group=" up "))
    # of a fifth of the channels rows of two other groups, which agree or, of every second, do not
    other = pairs.where("channel_id % 5 = 4").select("channel_id", F.explode(F.array(*(F.struct(F.lit(f"other-{i}").alias("grp"), F.when(F.col("channel_id") % 10 == 4, 3.0 + i).otherwise(3.0).alias("multiplier")) for i in range(2)))).alias("v")).select("channel_id", "v.*").withColumns(lit(discount=0.0, upstream_group="up", effective_at=NOW - 5))
    groups = pairs.where("domain <> 'domain-3'").select("domain", "grp").distinct().withColumns(lit(multiplier=9.0, discount=1.0, effective_at=NOW - 5))
    site = pairs.where("grp <> 'grp-3'").select("grp").distinct().withColumns(lit(multiplier=1.2, effective_at=NOW))
    domains = pairs.where("domain <> 'domain-2'").select("domain").distinct().withColumns(lit(paid=2.0, credit=3.0, effective_at=NOW - 5))
    settings = spark.range(1).select(F.lit(7.0).alias("fx"), F.lit(5.0).alias("paid"), F.lit(4.0).alias("credit"), F.lit(NOW - 5).alias("effective_at"))
    return pairs, site, groups, exact.unionByName(other), domains, settings


@query(_HIST + """, x AS (SELECT *, CASE price_from WHEN 'pair' THEN 7.0 WHEN 'channel' THEN 3.0 WHEN 'domain' THEN 9.0 END AS m, CASE price_from WHEN 'pair' THEN 0.8 WHEN 'channel' THEN 1.0 WHEN 'domain' THEN 1.0 END AS f FROM v),
y AS (SELECT *, CASE WHEN domain <> 'domain-2' THEN m * f * 2.0 / 3.0 END AS effective FROM x), z AS (SELECT *, effective IS NOT NULL AND site IS NOT NULL AS complete FROM y)
SELECT channel_id, grp, domain, price_from, conflict, site IS NOT NULL AS site_configured, m IS NOT NULL AS upstream_configured, CAST(site AS DOUBLE) AS site_multiplier, CAST(m AS DOUBLE) AS multiplier, CAST(f AS DOUBLE) AS discount,
  CASE price_from WHEN 'pair' THEN 'up' WHEN 'channel' THEN 'up' WHEN 'domain' THEN '' END AS upstream_group, round(CAST(effective AS DOUBLE), 6) AS effective, round(CAST(site - effective AS DOUBLE), 6) AS gap,
  CASE WHEN complete THEN round(1.2 * 1.25 / 7, 6)::DOUBLE END AS site_discount, CASE WHEN complete THEN round(effective / 7, 6)::DOUBLE END AS upstream_discount, CASE WHEN complete THEN round((1.2 * 1.25 / 7 - effective / 7) / (1.2 * 1.25 / 7), 6)::DOUBLE END AS margin, complete FROM z""")
def j14_price_views(spark, d):
    return rounded(channels.price_views(*_finance(spark, d), NOW))


@query("""WITH c AS (SELECT 'domain-' || (s_suppkey % 4) AS domain, s_suppkey % 7 <> 0 AND s_suppkey % 3 <> 0 AS on_, (s_suppkey % 9 = 0 AND s_suppkey % 5 <> 4) OR (s_suppkey % 9 <> 0 AND s_suppkey % 10 = 9) AS set FROM supplier)
SELECT domain, count(*) FILTER (WHERE on_) AS enabled, count(*) FILTER (WHERE on_ AND set) AS configured, count(*) FILTER (WHERE on_) > 0 AND count(*) FILTER (WHERE on_) = count(*) FILTER (WHERE on_ AND set) AS complete FROM c GROUP BY 1""")
def j14_rate_config(spark, d):
    pairs, _, _, costs, _, _ = _finance(spark, d)
    rows = pairs.select("domain", "channel_id", F.when(F.col("channel_id") % 3 == 0, 2).otherwise(1).alias("status"), (F.col("channel_id") % 7 != 0).alias("current"))
    return channels.rate_config(rows, channels.as_of(costs, ["channel_id", "grp"], NOW))


@query(HOURS + ", " + T.CHANNELS + """, p AS (SELECT DISTINCT hour_ts FROM hours WHERE hour_ts // 3600 % 3 <> 0 AND hour_ts // 3600 % 5 <> 0), r AS (SELECT h.*, base_domain AS domain, h.grp <> 'grp-4' AS priced FROM hours h JOIN p ON h.hour_ts = p.hour_ts JOIN channels ON id = channel_id WHERE h.hour_ts // 3600 % 7 <> 0)
SELECT domain, round(coalesce(sum(quota / 500000.0 * 0.5 / 2.0) FILTER (WHERE priced), 0) / (SELECT count(*) FROM p) * 24, 4) AS daily_cost_usd, CASE WHEN coalesce(sum(quota) FILTER (WHERE NOT priced), 0) > 0 THEN 'grp-4' ELSE '' END AS missing_groups FROM r GROUP BY 1""")
def a34_burn_of_one_version(spark, d):
    """Hours complete under an older version, facts of one, and names with blanks around them."""
    c = T.channels(spark, d).select(F.col("id").alias("channel_id"), F.concat(F.when(F.col("id") % 2 == 0, " ").otherwise(""), "base_domain").alias("domain"))
    hour, old = F.expr("hour_ts div 3600"), lambda n: F.when(F.expr("hour_ts div 3600") % n == 0, 4).otherwise(5)
    facts = _hours(spark, d).join(c, "channel_id").withColumns({"traffic_class_version": old(7), "grp": F.concat("grp", F.when(F.col("channel_id") % 3 == 0, " ").otherwise(""))})
    ledger = facts.select("hour_ts").distinct().where(hour % 3 != 0).withColumns({"status": F.lit("complete"), "traffic_class_version": old(5)})
    rates = T.channels(spark, d).select(F.col("id").alias("channel_id"), F.explode(F.array(*(F.lit(f"grp-{i}") for i in range(4)))).alias("grp")).withColumns({"upstream": F.lit(0.5), "site": F.lit(2.0)})
    return rounded(channels.burn(facts, rates, ledger, 10), 4)
