import hashlib
import hmac
import random
import re

import pytest
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators import alerts, audit, board, channels, edge, evidence, filters, kpi, problems, projection, rollup, stability, upstream, usage
from logfacts.plans import queries
from logfacts.sources import tables
from logfacts.streaming import jobs

LOG = ("id long, user_id long, created_at long, type int, quota long, channel_id long, model_name string, grp string, token_id long, prompt_tokens long, completion_tokens long, use_time long, content string, token_name string, request_id string, other string")


def log(spark, *rows):
    base = {"id": 1, "user_id": 7, "created_at": 1000, "type": 2, "quota": 10, "channel_id": 3, "model_name": "m", "grp": "g", "token_id": 5, "prompt_tokens": 4, "completion_tokens": 6, "use_time": 2, "content": "", "token_name": "t", "request_id": "r", "other": None}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], LOG)


def test_classification_with_nulls_and_broken_json(spark):
    rows = log(
        spark,
        {"id": 1}, {"id": 2, "completion_tokens": 0}, {"id": 3, "completion_tokens": 0, "model_name": "BGE-large"}, {"id": 4, "other": '{"stream_status":{"end_reason":"timeout"}}'},
        {"id": 5, "other": "{broken"}, {"id": 6, "other": '{"stream_status":{"error_count":2},"frt":700}'}, {"id": 7, "type": 5, "content": None}, {"id": 8, "type": 5, "content": "status_code=503 Deadline"},
        {"id": 9, "type": 5, "content": "status_code=404"}, {"id": 10, "type": 5, "content": "STATUS_CODE=500"}, {"id": 11, "token_name": C.TEST_MARKER, "content": C.TEST_MARKER}, {"id": 12, "token_name": C.TEST_MARKER, "content": None},
        {"id": 13, "type": 5, "user_id": 1, "token_id": None, "token_name": None, "request_id": None}, {"id": 14, "type": 5, "user_id": None, "token_id": None, "token_name": None, "request_id": None}, {"id": 15, "type": 1},
    )
    got = {r.id: (r.outcome, r.error_kind) for r in C.classified(rows).collect()}
    want = {1: "success", 2: "anomaly", 3: "success", 4: "anomaly", 5: "success", 6: "anomaly", 7: "failed", 8: "failed", 9: "failed", 10: "failed", 12: "success"}
    assert {k: v[0] for k, v in got.items()} == want  # 11 and 13 are tests, 14 is null and so dropped
    assert [got[i][1] for i in (7, 8, 9, 10)] == ["other", "timeout", "4xx", "5xx"]


def test_minutes_add_up_to_direct_hours(spark):
    rng = random.Random(1)
    rows = log(spark, *({"id": i, "created_at": rng.randint(0, 20000), "type": rng.choice([2, 2, 5]), "use_time": rng.randint(0, 90), "completion_tokens": rng.choice([0, 5]), "prompt_tokens": rng.choice([0, 3]), "channel_id": rng.randint(1, 3), "other": rng.choice([None, '{"frt":900}'])} for i in range(400)))
    keys = ["hour_ts", "channel_id", "model_name", "grp"]
    user, _ = rollup.direct_hours(rows)
    assert rollup.differences(rollup.stability_hours(rollup.minutes(rows)), user, keys, list(rollup.HOUR_MEASURES)).count() == 0
    sums = rollup.minutes(rows).agg(*(F.sum(c).alias(c) for c in ("anomaly", "anomaly_billed", "anomaly_free", "anomaly_stream"))).first()
    assert sums.anomaly == sums.anomaly_billed + sums.anomaly_free + sums.anomaly_stream > 0


def percentile(hist, edges, largest, p):
    total = sum(hist)
    if not total:
        return 0.0
    target, cum, lower = p / 100 * total, 0.0, 0.0
    for i, c in enumerate(hist):
        upper = max(float(edges[i] if i < len(edges) else largest), lower)
        if cum + c >= target:
            return upper if c == 0 else lower + (target - cum) / c * (upper - lower)
        cum, lower = cum + c, upper
    return lower


def test_percentile_against_python(spark):
    rng = random.Random(2)
    rows = [([rng.choice([0, 0, rng.randint(0, 30)]) for _ in range(7)], rng.choice([0, 40, 300])) for _ in range(200)] + [([0] * 7, 5), ([0, 0, 9, 0, 0, 0, 0], 3), ([0] * 6 + [4], 10)]
    df = spark.createDataFrame([(i, *h, m) for i, (h, m) in enumerate(rows)], "i int, " + ", ".join(f"{c} long" for c in S.LATENCY) + ", top long")
    for p in (50, 95, 99):
        got = dict(df.select("i", S.percentile(list(S.LATENCY), S.LATENCY_EDGES, "top", p)).collect())
        for i, (h, m) in enumerate(rows):
            assert got[i] == pytest.approx(percentile(h, S.LATENCY_EDGES, m, p))


def test_business_day_and_half_open_range(spark):
    df = spark.createDataFrame([(57599,), (57600,), (-28800,)], "hour_ts long")
    assert [r[0] for r in df.select(S.day("hour_ts")).collect()] == [-28800, 57600, -28800]
    assert filters.in_scope(df, -28800, 57600).count() == 2


def test_redaction_and_hmac(spark):
    text = "POST failed: api_key=abc123, Bearer abcdefghijkl user a.b@example.com from 10.0.0.1:80 id 123e4567-e89b-42d3-a456-426614174000 sk-abcdefgh12 ?token=zz&x=1 " + "A" * 40 + "  end"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(S.redacted(F.col("t"))).first()[0]
    assert got == "POST failed: api_key=<redacted>, Bearer <redacted> user <email> from <ip> id <uuid> <credential> ?token=<redacted>&x=1 <opaque-id> end"
    for key in (b"k", b"x" * 64):
        assert df.select(S.hmac_sha256(key, F.col("t"))).first()[0] == hmac.new(key, text.encode(), hashlib.sha256).hexdigest()
    want = hashlib.sha256(b"log\0" + b"a").hexdigest()
    assert df.select(S.signature(F.lit("log"), F.lit("a"))).first()[0] == want


def test_burst_ignores_missing_points(spark):
    points = [("a", t, n) for t, n in ((0, 1), (60, 1), (600, 1), (660, 0))] + [("b", t, n) for t, n in ((0, 1), (60, 0), (120, 1), (180, 1))]
    got = {r.key: (r.longest, r.burst) for r in kpi.bursts(spark.createDataFrame(points, "key string, ts long, anomaly long")).collect()}
    assert got == {"a": (3, True), "b": (2, False)}


def test_selectable_is_open_without_pairs(spark):
    facts = spark.createDataFrame([("g", "m"), ("h", "m")], "grp string, model_name string")
    pairs = spark.createDataFrame([("g", "m")], "grp string, model string")
    assert filters.selectable(facts, pairs).count() == 1 and filters.selectable(facts, pairs.where("false")).count() == 2


def test_enabled_keeps_unknown_channels(spark):
    facts = spark.createDataFrame([(1, 10), (1, 30), (2, 30), (9, 30)], "channel_id long, bucket_ts long")
    dim = spark.createDataFrame([(1, 1, 20), (2, 2, 0)], "id long, status int, enabled_since long")
    assert sorted(tuple(r) for r in filters.enabled(facts, dim).collect()) == [(1, 30), (9, 30)]


def test_effective_version_per_hour(spark):
    facts = spark.createDataFrame([(0, 5), (0, 4), (1, 5), (1, 4), (2, 5), (3, 4)], "hour_ts long, traffic_class_version int")
    ledger = spark.createDataFrame([(0, "complete", 5), (3, "complete", 5), (1, "running", 5)], "hour_ts long, status string, traffic_class_version int")
    assert sorted(tuple(r) for r in filters.effective(facts, ledger).collect()) == [(0, 5), (1, 4), (2, 5)]


def test_stability_levels_with_blank_groups_and_rejections(spark):
    hours = spark.createDataFrame([(0, 33, "m", "", 90, 5, 5, 0, 0, 10), (0, 44, "m", "g", 50, 0, 0, 0, 0, 5)], "hour_ts long, channel_id long, model_name string, grp string, success long, anomaly long, failed long, tokens long, quota long, sum_use_time long")
    rejected = spark.createDataFrame([(60, "m", "g", 2)], "bucket_ts long, model string, grp string, count long")
    report = stability.levels(stability.with_rejections(hours, rejected))
    rows = {(r.level, r.grp, r.channel_id, r.model): r for r in report.collect()}
    assert rows["all", None, None, None].requests == 152 and rows["group", "", None, None].requests == 100 and rows["group-channel", "g", None, None].rejected == 2
    empty = stability.levels(stability.with_rejections(hours.where("false"))).where("level = 'all'").first()
    assert empty is None or empty.stability is None


def test_usage_example_and_follow_ups(spark):
    logs = log(spark, {"quota": 500000}, {"id": 2, "type": 6, "quota": 100000})
    r = usage.totals(rollup.usage_facts(logs), "user_id").first()
    assert (r.requests, r.refund_records, r.net_quota, r.net_usd) == (1, 1, 400000, 0.8)
    facts = spark.createDataFrame([(1, d * 86400, q, 0) for d, q in ((16, 9000000), (20, 9000000), (29, 1000000))] + [(2, 0, 500000, 0)], "user_id long, hour_ts long, consume_quota long, refund_quota long")
    balances = spark.createDataFrame([(1, 5.0), (2, 0.5), (3, None)], "user_id long, balance_usd double")
    got = {r.user_id: (r.days_idle, r.reasons, r.urgency, r.level) for r in usage.follow_ups(facts, 30 * 86400, balances).collect()}
    assert got == {1: (0, "drop", 35 + 38, "urgent"), 2: (29, "dormant,low balance", 96, "urgent"), 3: (30, "dormant", 50, "info")}


def test_follow_ups_wait_for_eligible_days_and_group_by_company(spark):
    facts = spark.createDataFrame([(1, d * 86400, 9000000, 0) for d in (5, 20)] + [(2, 29 * 86400, 500000, 0)], "user_id long, hour_ts long, consume_quota long, refund_quota long")
    balances = spark.createDataFrame([(1, 5.0, 20), (2, 0.5, 99), (3, 5.0, 17), (4, 5.0, None)], "user_id long, balance_usd double, eligible_from int")
    found = usage.follow_ups(facts, 30 * 86400, balances)
    got = {r.user_id: (r.days_idle, r.reasons, r.urgency, r.spend_usd) for r in found.collect()}
    assert got == {2: (0, "low balance", 45, 0.0), 4: (30, "dormant", 50, 0.0)}  # 1 and 3 have fewer than 14 days that count
    members = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "user_id long, group_id long")
    companies = spark.createDataFrame([(7,), (8,), (9,)], "group_id long")
    rows = {r.group_id: (r.members, r.without_members, r.urgency) for r in usage.by_company(found, members, companies).collect()}
    assert rows == {7: (1, False, 45), 9: (0, True, 20), 0: (1, False, 50)}


def test_follow_ups_add_up_exactly(spark):
    facts = [(1, d * 86400, 50000, 0) for d in range(10)] + [(2, d * 86400, 100000, 0) for d in (16, 17, 18)] + [(2, 23 * 86400, 210000, 0)]  # ten times 0.1; 0.42 after 0.6, a drop of just 30 %
    facts += [(3, 29 * 86400, 50000, 0), (3, 29 * 86400 + 3600, 100000, 0), (3, 29 * 86400 + 7200, 0, 150000)]  # 0.1 and 0.2 paid back
    rows = spark.createDataFrame(facts, "user_id long, hour_ts long, consume_quota long, refund_quota long")
    found = usage.follow_ups(rows, 30 * 86400, spark.createDataFrame([(1, 5.0), (2, 0.5), (3, 0.5)], "user_id long, balance_usd double"))
    assert {r.user_id: (r.days_idle, r.reasons, r.urgency, r.level, r.spend_usd) for r in found.collect()} == {1: (20, "dormant", 51, "urgent", 1.0), 2: (6, "low balance", 46, "urgent", 1.02), 3: (30, "dormant,low balance", 95, "info", 0.0)}
    tenths = spark.createDataFrame([(u, 0, 0.1) for u in range(10)], "user_id long, urgency long, spend_usd double")
    one = usage.by_company(tenths, spark.range(10).select(F.col("id").alias("user_id"), F.lit(7).alias("group_id")), spark.createDataFrame([(7,)], "group_id int")).first()
    assert (one.spend_usd, one.urgency) == (1.0, 1)


def test_costs_by_form(spark):
    plain = '"model_ratio":1,"group_ratio":0.5,"completion_ratio":3,"cache_tokens":400'
    others = [
        "{" + plain + ',"cache_ratio":0.25}', "{" + plain + "}", "{" + plain + ',"claude":true,"cache_ratio":0.25,"cache_creation_tokens":100,"cache_creation_ratio":1.25}',
        "{" + plain + ',"claude":true,"cache_creation_tokens":100,"cache_creation_tokens_5m":10,"cache_creation_ratio_5m":2,"cache_creation_tokens_1h":20}', "{" + plain + ',"user_group_ratio":2,"frt":"x"}',
        "{" + plain + ',"billing_mode":"tiered_expr"}', "{" + plain + ',"is_task":true,"model_price":-1}', "{" + plain + ',"model_price":0.1}', "{broken", None, '{"model_ratio":1,"cache_tokens":9000,"cache_ratio":1}',
    ]
    rows = log(spark, *({"id": i, "prompt_tokens": 1000, "completion_tokens": 100, "other": o} for i, o in enumerate(others)), {"id": 99, "type": 5, "other": others[0]})
    got = {r.id: None if r.cost_usd is None else (round(r.cached_usd * 5e5), round(r.creation_usd * 5e5), round(r.cost_usd * 1e6, 6)) for r in upstream.log_costs(rows).collect()}
    want = {0: (100, 0, 1000.0), 1: (0, 0, 900.0), 2: (100, 125, 1525.0), 3: (400, 40, 1740.0), 4: (0, 0, 3600.0), 10: (9000, 0, 0.0), **dict.fromkeys((5, 6, 7, 8, 9, 99))}
    assert got == want


def test_burn_counts_tests_at_their_basis(spark):
    facts = spark.createDataFrame([(0, "d", 1, "g", 2000000), (0, "d", 2, "", 500000), (3600, "d", 1, "g", 9000000)], "hour_ts long, domain string, channel_id long, grp string, quota long")
    tests = spark.createDataFrame([(0, "d", 1, "g", 500000, "legacy_assumed_base"), (0, "d", 1, "g", 500000, "legacy_after_group"), (0, "d", 1, "g", 500000, None), (0, "d", 3, "g", 1, "legacy_after_group"), (0, "d", 5, "h", 0, "x")], "hour_ts long, domain string, channel_id long, grp string, quota long, cost_basis string")
    rates = spark.createDataFrame([(1, "g", 0.5, 2.0), (3, "g", 0.5, None)], "channel_id long, grp string, upstream double, site double")
    ledger = spark.createDataFrame([(0, "complete"), (3600, "running")], "hour_ts long, status string")
    r = channels.burn(facts, rates, ledger, 10, tests).first()
    assert r.daily_cost_usd == pytest.approx(24 * (1.0 + 0.5 + 0.25))
    assert r.missing_groups == "内部测试渠道 #1 成本口径未标记,内部测试渠道 #3,未标记服务分组"


def test_readings_agree_however_they_are_paged(spark):
    rows = spark.createDataFrame([(1, i, i % 3, None if i % 2 else "x") for i in range(20)] + [(2, 1, 1, "x")], "user long, id long, page long, text string")
    read = lambda r, page: audit.fold_pages(audit.event_pages(r.withColumn("page", page), ["user", "page"], ["id", "text"]), ["user"])
    a, b = read(rows, F.col("page")), read(rows, F.col("id") % 7)
    assert {r.user: r.agreed for r in audit.agreed(a, b, ["user"]).collect()} == {1: True, 2: True}
    changed = read(rows.fillna("", ["text"]).where("user = 1"), F.lit(0))
    assert {r.user: r.agreed for r in audit.agreed(a, changed, ["user"]).collect()} == {1: False, 2: False}


def test_repair_and_new_version(spark):
    late = log(spark, *({"id": i, "created_at": 3600 * (i % 3)} for i in range(9)))
    stored = rollup.direct_hours(late.where("id < 6"))[0]
    hours = spark.createDataFrame([(0,), (0,)], "hour_ts long")
    assert {r.hour_ts: r.success for r in rollup.repaired(stored, late, hours).collect()} == {0: 3, 3600: 2, 7200: 2}
    versions = rollup.reclassified(stored.withColumn("traffic_class_version", F.lit(4)), late, hours, 5)
    ledger = "hour_ts long, status string, traffic_class_version int"
    see = lambda signed: {r.hour_ts: r.success for r in filters.effective(versions, spark.createDataFrame(signed, ledger)).collect()}
    assert see([]) == {0: 2, 3600: 2, 7200: 2} and see([(0, "complete", 5)]) == {0: 3, 3600: 2, 7200: 2}


def test_gaps_and_proofs(spark):
    present = spark.createDataFrame([(h * 3600,) for h in (0, 1, 4, 20)], "hour_ts long")
    got = [(r.from_ts // 3600, r.to_ts // 3600) for r in audit.missing_ranges(present, 0, 22 * 3600).collect()]
    assert got == [(21, 22), (17, 20), (5, 17), (2, 4)]
    assert [(r.from_ts, r.to_ts) for r in audit.missing_ranges(present.where("false"), 0, 3600).collect()] == [(0, 3600)]
    proofs = spark.createDataFrame([(1, 0), (1, 3600), (1, 3 * 3600), (2, 3600)], "user_id long, hour_ts long")
    assert {r.user_id: r.gap for r in audit.first_gap(proofs, 0, 4 * 3600).collect()} == {1: 7200, 2: 0}


def test_proofs_over_many_words(spark):
    """Runs that end before, at and after the edges of words, with copies, gaps, earlier hours and times that are no hours, against a plain loop."""
    hours = {u: set(range(u)) for u in (0, 1, 61, 62, 63, 123, 124, 125, 200)} | {300: set(range(200)) - {62}, 301: set(range(200)) - {61}, 302: set(range(124, 200)), 303: set(range(62)) | set(range(124, 130))}
    rows = [(u, 7200 + h * 3600) for u, hs in hours.items() for h in hs] * 2 + [(1, 7200 + 1800), (62, 0), (0, 3600)]
    proofs = spark.createDataFrame(rows, "user_id long, hour_ts long")
    run = {u: next(h for h in range(400) if h not in hs) for u, hs in hours.items()}
    assert {r.user_id: r.through for r in audit.contiguous(proofs, 7200).collect()} == {u: 7200 + n * 3600 for u, n in run.items() if n}
    day = {r.user_id: (r.hours, r.ready) for r in audit.day_ready(proofs, spark.createDataFrame([(u,) for u in (0, 1, 62, 303, 999)], "user_id long"), 7200).collect()}
    assert day == {0: (0, False), 1: (1, False), 62: (24, True), 303: (24, True), 999: (0, False)}
    whole = proofs.where("hour_ts % 3600 = 0")
    assert {r.user_id: r.hours for r in usage.proof_progress(whole, 40).collect()} == {u: len(hs) + (u in (0, 62)) for u, hs in hours.items()}


def test_proofs_are_kept_as_one_row_a_member(spark):
    """No task keeps a row per member and hour."""
    proofs = queries._proofs(spark, "/root/testdata/sf0.001")
    members = proofs.select("user_id")
    for found in (usage.proof_progress(proofs, 40), audit.contiguous(proofs, queries.SINCE), audit.first_gap(proofs, queries.SINCE, queries.SINCE + 144000), audit.day_ready(proofs, members, queries.SINCE)):
        assert not re.search(r"keys=\[[^\]]*hour_ts#\d+L?[,\]]", found._jdf.queryExecution().executedPlan().toString())


def test_digests_do_not_depend_on_order_and_see_repeats(spark):
    rows = [(1, "a"), (1, "b"), (1, "b")]
    d = lambda r: audit.digests(spark.createDataFrame(r, "k int, v string"), ["k"], ["v"]).first().digest
    assert d(rows) == d(rows[::-1]) != d(rows[:2])


def test_evidence_conflicts_orphans_retries(spark):
    E = "event_id long, event_type string, occurred_at_ms long, trace string, logical string, retry int, outcome string"
    rows = [(1, "request_started", 1, "a", "L", 0, None), (2, "request_outcome", 2, "a", "L", 0, "transport_failure"), (3, "request_started", 3, "b", "L", 1, None), (4, "request_outcome", 4, "b", "L", 1, "succeeded"),
            (5, "request_started", 5, "c", "M", 0, None), (6, "request_outcome", 6, "c", "M", 0, "succeeded"), (7, "request_outcome", 7, "c", "M", 0, "client_timeout"), (8, "request_outcome", 8, "zz", "Z", 0, "succeeded"), (9, "request_outcome", 1, "a", "L", 0, "user_cancelled")]
    df = spark.createDataFrame(rows, E)
    c = evidence.cohort(df).first()
    assert (c.started, c.reported, c.conflicts, c.judged, c.succeeded, c.sufficient) == (3, 3, 2, 1, 1, False)
    assert tuple(evidence.orphans(df).first()) == (1, 1)
    assert {r.logical: (r.attempts, r.retried, r.eventually) for r in evidence.retries(df).collect()} == {"L": (2, True, True), "M": (1, False, True)}
    assert {r.logical: r.outcome for r in evidence.first_outcomes(df).collect()} == {"L": "transport_failure", "M": "succeeded", "Z": "succeeded"}
    assert df.where(evidence.valid(100)).count() == 9


def test_edge_lines(spark):
    lines = [("n", '{"msec":61.5,"request_method":"get","path":"/v1/chat/completions?x=1","status":200,"request_time":"0.25","upstream_status":"502, 200","upstream_response_time":"0.1, 0.2 : 0.3","bytes_sent":10,"request_id":"r"}'), ("n", '{"ts":70,"method":"GET","uri":"/x/y","status":"abc"}'), ("n", '{"ts":70,"status":200,"upstream_status":"502, -"}'), ("n", '{"ts":"70","status":200,"upstream_status":"99"}'), ("n", '{"ts":70,"status":200,"request_time":86401}'), ("n", '{"ts":200,"msec":70,"status":"204","request_time":0.0006,"method":"brew","uri":"/a","upstream_status":"-","upstream_response_time":"0.000","request_id":"-"}'), ("n", "junk"), ("n", None)]
    got = edge.minutes(edge.parse(spark.createDataFrame(lines, "node string, line string"))).collect()
    assert [(r.bucket_ts, r.route, r.status, r.upstream_status, r.time_sum_ms, r.upstream_sum_ms, r.with_id) for r in sorted(got, key=lambda r: r.bucket_ts)] == [(60, "/v1/chat/completions", 200, 200, 250, 300, 1), (180, "/other", 204, 0, 1, 0, 0)]
    assert {(r.method, r.upstream_count) for r in got} == {("GET", 1), ("OTHER", 1)}


def test_edge_lines_are_made_once(spark):
    """No condition makes lines anew, and lines that are too long are still left out."""
    plan = edge.parse(queries._lines(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Filter .*octet_length", plan)
    long = '{"ts":70,"status":200,"uri":"/%s"}'
    lines = spark.createDataFrame([("n", long % ("a" * n)) for n in (1, edge.MOST_LINE_BYTES - 33, edge.MOST_LINE_BYTES)], "node string, line string")
    assert edge.parse(lines).count() == lines.where(F.octet_length("line") <= edge.MOST_LINE_BYTES).count() == 2


def test_snapshot_and_finance_and_domains(spark):
    before = spark.createDataFrame([(1, "a", 1, 5, 0), (2, "b", 2, 0, 0), (3, "c", 1, 5, 0)], "id long, name string, status int, enabled_since long, deleted_at long")
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (4, "d", 1)], "id long, name string, status int")
    got = {r.id: (r.enabled_since, r.deleted_at) for r in channels.snapshot(before, now, 100).collect()}
    assert got == {1: (5, 0), 2: (100, 0), 3: (5, 100), 4: (0, 0)}
    one = spark.range(1).withColumns(channels.finance(*(F.lit(x) for x in (2.0, 0.0, 1.0, 2.0, 1.5, 7.0, 1.0, 7.0)))).first()
    assert one.effective == 1.0 and one.gap == 0.5 and one.site_discount == pytest.approx(1.5) and one.margin == pytest.approx((1.5 - 1 / 7) / 1.5)
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.com",), ("10.0.0.1",), ("localhost",)], "host string")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",)], "suffix string")
    assert {r.host: r.domain for r in channels.registrable(hosts, suffixes).collect()} == {"a.b.co.uk": "b.co.uk", "x.com": "x.com", "10.0.0.1": "10.0.0.1", "localhost": "localhost"}


def test_alert_cooldown(spark):
    rows = [("k", "t", x) for x in (0, 10, 1799, 1800, 1900, 3600)] + [("q", "t", 5), ("q", "t", 6)]
    got = sorted(tuple(r) for r in alerts.fired(spark.createDataFrame(rows, "kind string, target string, ts long"), {"q": 1}).collect())
    assert got == [("k", "t", 0), ("k", "t", 1800), ("k", "t", 3600), ("q", "t", 5), ("q", "t", 6)]


def test_projection_is_all_or_nothing(spark):
    facts = spark.createDataFrame([(1, 0, 100, 0)], "user_id long, hour_ts long, consume_quota long, refund_quota long")
    members = spark.createDataFrame([(1,), (2,)], "user_id long")
    marks = [(1, 3600, 50), (1, 4000, 70), (2, 3700, 10)]
    M = "user_id long, captured_at long, used_quota long"
    got = {r.user_id: r.quota for r in projection.project(facts, spark.createDataFrame(marks, M), members, 0, 3600).collect()}
    assert got == {1: 120, 2: 0}
    assert projection.project(facts, spark.createDataFrame(marks[:2], M), members, 0, 3600).count() == 0
    assert projection.project(facts, spark.createDataFrame([*marks, (2, 4500, 5)], M), members, 0, 3600).count() == 0


def test_problem_shares_and_board(spark):
    errors = log(spark, {"type": 5, "content": "status_code=500 at 10.0.0.1"}, {"id": 2, "type": 5, "content": "status_code=500 at 10.0.0.2"}, {"id": 3, "type": 5, "content": None})
    rows = problems.report(problems.signatures(errors), 0, 5000).orderBy(F.desc("count")).collect()
    assert [(r["count"], r.code) for r in rows] == [(2, "500"), (1, "")] and rows[0].share == pytest.approx(200 / 3)
    states = spark.createDataFrame([("g", "up"), ("g", "down"), ("h", "down"), ("i", "up")], "grp string, state string")
    assert {r.grp: r.state for r in board.group_states(states).collect()} == {"g": "warn", "h": "down", "i": "up"}


def test_batches_and_merge(spark):
    env = spark.createDataFrame([("n", 1, "x"), ("n", 1, "x"), ("n", 2, "x"), ("n", 2, "y")], "node string, batch_id int, body string")
    assert {r.batch_id: (r.copies, r.conflict) for r in tables.batches(env, ["node", "batch_id"], F.col("body")).collect()} == {1: (2, False), 2: (2, True)}
    a = spark.createDataFrame([(1, 5, 9)], "k int, n long, m long")
    assert tuple(tables.merge_additive(a, spark.createDataFrame([(1, 2, 7)], a.schema), ["k"], ["n"], ["m"]).first()) == (1, 7, 9)


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "kind string, target string, ts long"
    events = spark.createDataFrame([("k", "t", x) for x in (0, 10, 1900)], schema)
    events.write.parquet(src)
    q = jobs.fired_stream(spark.readStream.schema(schema).parquet(src), {}).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.ts for r in spark.table("fired").collect()) == [0, 1900]
    rows = log(spark, *({"id": i, "created_at": 60 * (i % 3) + i} for i in range(12))).withColumn("at", F.timestamp_seconds("created_at"))
    rows.write.parquet(str(tmp_path / "logs"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "logs"))
    jobs.keyed_sink(jobs.minute_stream(stream), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    got = jobs.latest_of(spark.read.parquet(str(tmp_path / "out")), ["bucket_ts", "model_name"])
    assert got.agg(F.sum("success")).first()[0] == 12


def test_follow_queries_are_registered_with_equal_columns(spark):
    from logfacts.plans.queries import ORACLES, QUERIES

    assert len(QUERIES) > 90 and set(ORACLES) <= set(QUERIES)
