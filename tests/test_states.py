"""Live projection, coverage, evidence rules, prices, burn, gaps, member-days, health and streams with state."""

import pytest
from pyspark.sql import functions as F

from logfacts.functions import classify as C
from logfacts.functions import scalars as S
from logfacts.operators import audit, board, channels, edge, evidence, filters, health, projection, stability, usage
from logfacts.plans import queries
from logfacts.plans import states as plans
from logfacts.streaming import states

DAY, FIN = 0, 43200
NOW = FIN + 2000
NEED = projection.Standing(epoch="e")
PUBLISHED = "user_id long, tracked_revision int, source_epoch string, classification_version int, query_semantics_version int, source_floor_hour long, published_at long"
STATE = "user_id long, active boolean, tracked_revision int, source_epoch string, classification_version int, query_semantics_version int, source_floor_hour long, source_history_status string, coverage_status string, verification_status string, coverage_through_hour long"
SNAP, MARK = "user_id long, exists boolean, captured_at long, used_quota long", "user_id long, captured_at long, used_quota long, exists boolean"
FACT, CELL = "user_id long, hour_ts long, consume_quota long, refund_quota long", "group_id int, user_id long, date_ts long, consume_quota long, refund_quota long"


def live(spark, facts=(), snap=None, marks=None, published=None, state=None, members=((1, 1), (1, 2)), now=NOW, finalized=FIN):
    ids = sorted({u for _, u in members})
    over = lambda base, changes: [tuple((changes or {}).get(u, {}).get(k, v) for k, v in base(u).items()) for u in ids if (changes or {}).get(u, {}) is not None]
    p = over(lambda u: {"u": u, "rev": 1, "epoch": "e", "class": 5, "sem": 1, "floor": 10, "at": 5}, published)
    s = over(lambda u: {"u": u, "active": True, "rev": 1, "epoch": "e", "class": 5, "sem": 1, "floor": 10, "history": "complete_hot", "cov": "ready", "ver": "complete", "through": DAY}, state)
    n = over(lambda u: {"u": u, "exists": True, "at": NOW - 100, "used": 1000 * u + 50}, snap)
    m = [(u, FIN - 1, 0, True) for u in ids] + [(u, FIN + 60, 1000 * u, True) for u in ids] + [(u, FIN + 90, 1000 * u + 40, True) for u in ids] if marks is None else list(marks)
    out = projection.live(
        spark.createDataFrame(list(members), "group_id int, user_id long"), spark.createDataFrame(p, PUBLISHED), spark.createDataFrame(s, STATE), spark.createDataFrame(n, SNAP),
        spark.createDataFrame(m, MARK), spark.createDataFrame(list(facts), FACT), DAY, finalized, now, NEED)
    return out


def told(df):
    return {r.user_id: (r.today_net, r.through) for r in df.collect()}


def test_projection_adds_the_counter_to_finalised_hours(spark):
    facts = [(1, DAY, 100, 10), (1, FIN - 3600, 5, 0), (1, FIN, 999, 0), (1, DAY - 3600, 999, 0)]
    assert told(live(spark, facts)) == {1: (145, NOW - 100), 2: (50, NOW - 100)}
    assert told(live(spark, facts, snap={2: {"at": NOW - 1800}})) == {1: (145, NOW - 1800), 2: (50, NOW - 1800)}


@pytest.mark.parametrize(("part", "change"), [
    ("published", {"at": 0}), ("published", {"floor": 0}), ("published", {"epoch": "old"}), ("published", {"class": 4}), ("published", {"sem": 0}), ("published", {"rev": 2}), ("published", None),
    ("state", {"active": False}), ("state", {"history": "partial"}), ("state", {"cov": "building"}), ("state", {"ver": "failed"}), ("state", {"through": DAY - 1}), ("state", {"floor": None}), ("state", {"history": "no_history"}), ("state", None),
    ("snap", {"exists": False}), ("snap", {"at": NOW - 1801}), ("snap", {"at": NOW + 61}), ("snap", {"at": FIN + 10}), ("snap", {"used": 1999}), ("snap", None),
])
def test_projection_tells_nothing_of_a_group_with_one_unsound_member(spark, part, change):
    members = ((1, 1), (1, 2), (2, 3))
    assert set(told(live(spark, members=members, **{part: {2: change}}))) == {3}


def test_projection_bounds(spark):
    assert told(live(spark, published={2: {"rev": 0}})) != {}  # an old publication without a revision stands for the first
    assert told(live(spark, marks=[(1, FIN + 60, 1000, True), (2, FIN + 901, 2000, True)])) == {}
    assert told(live(spark, marks=[(1, FIN + 60, 1000, True), (2, FIN, 2000, False), (2, FIN + 900, 2000, True)])) != {}
    assert told(live(spark, state={1: {"history": "no_history"}}, snap={1: {"used": 0}}, marks=[(1, FIN, 0, True), (2, FIN, 2000, True)])) == {1: (0, NOW - 100), 2: (50, NOW - 100)}
    assert told(live(spark, finalized=DAY - 3600)) == {} and told(live(spark, now=FIN - 3601)) == {}


def test_a_matrix_never_falls(spark):
    t = spark.createDataFrame([(1, 1, 145, 7), (1, 2, 50, 7), (2, 3, 10, 7), (2, 4, 0, 7), (3, 5, 0, 7)], "group_id int, user_id long, today_net long, through long")
    cells = spark.createDataFrame([(1, 1, DAY, 100, 10), (1, 1, -S.DAY, 3, 0), (2, 3, DAY, 11, 0), (9, 9, DAY, 1, 1)], CELL)
    got = {(r.user_id, r.date_ts): (r.consume_quota, r.refund_quota, r.through) for r in projection.on_matrix(cells, t, DAY).collect()}
    assert got == {(1, DAY): (155, 10, 7), (1, -S.DAY): (3, 0, None), (2, DAY): (50, 0, 7), (3, DAY): (11, 0, None), (9, DAY): (1, 1, None)}
    days = cells.groupBy("group_id", "date_ts").agg(F.sum("consume_quota").alias("consume_quota"), F.sum("refund_quota").alias("refund_quota"))
    raised, rows = projection.on_days(days, t, DAY)
    assert {(r.group_id, r.date_ts): r.consume_quota for r in raised.collect()} == {(1, DAY): 205, (1, -S.DAY): 3, (2, DAY): 11, (9, DAY): 1}
    assert [tuple(r) for r in rows.collect()] == [(1, projection.UNASSIGNED, 105)]


LEDGER = "hour_ts long, status string, traffic_class_version int"


def cover(spark, rows, since=0, until=4 * 3600, now=4 * 3600 + 600):
    return stability.coverage(spark.createDataFrame(rows, LEDGER), since, until, now).first()


def test_coverage_tells_a_pending_tail_from_a_gap(spark):
    whole = [(h * 3600, "complete", 5) for h in range(4)]
    assert (cover(spark, whole).complete, cover(spark, whole).percent) == (True, 100.0)
    for last in ([], [(3 * 3600, "queued", 5)], [(3 * 3600, "running", None)]):
        r = cover(spark, whole[:3] + last)
        assert (r.missing, r.pending, r.pending_ts, r.percent) == (1, True, 3 * 3600, 75.0)
    assert not cover(spark, whole[:3] + [(3 * 3600, "failed", 5)]).pending
    assert not cover(spark, whole[1:]).pending  # a gap before the tail
    assert not cover(spark, whole[:3], now=9 * 3600).pending  # the range does not reach the last final hour
    assert cover(spark, whole[:3], now=4 * 3600 + 599).expected == 3  # that hour is not final yet
    r = cover(spark, whole[:2] + [(7200, "complete", 4), (10800, "complete", None)])
    assert (r.completed, r.missing, r.effective, r.effective_missing, r.legacy, r.complete, r.effective_complete, r.pending) == (2, 2, 4, 0, 2, False, True, False)
    r = cover(spark, [], until=0)
    assert (r.expected, r.complete, r.percent, r.effective_complete, r.effective_percent, r.pending) == (0, True, 100.0, True, 100.0, False)


EVENT = {"version": 1, "event_id": "e", "event_type": "request_outcome", "occurred_at_ms": 10**13, "request_id": "r", "logical_key": "", "client_version": "1", "outcome": "succeeded", "error_signature": "", "retry": 0, "protocol": "", "model": ""}


@pytest.mark.parametrize(("change", "fault"), [
    ({}, None), ({"event_id": "a.b_c:d-9"}, None), ({"event_id": "a b"}, "envelope"), ({"event_id": "a\n"}, "envelope"), ({"event_id": None}, "envelope"), ({"version": None}, "envelope"), ({"retry": 100}, None), ({"retry": None}, "envelope"),
    ({"event_type": "request_started"}, "start"), ({"event_type": "request_started", "outcome": "", "error_signature": "x"}, "start"), ({"event_type": "request_started", "outcome": None}, None), ({"event_type": None}, "envelope"),
    ({"outcome": None}, "outcome"), ({"request_id": " \t"}, "request"), ({"request_id": "a\nb"}, "request"), ({"request_id": "\n a \r"}, None), ({"request_id": "é" * 129}, "request"), ({"protocol": "h\x00"}, "metadata"),
    ({"logical_key": "a\rb"}, "logical"), ({"model": None, "protocol": None, "logical_key": None, "error_signature": None}, None), ({"occurred_at_ms": None}, "time"),
])
def test_evidence_rules(spark, change, fault):
    kinds = ", ".join(f"{c} {'long' if isinstance(v, int) else 'string'}" for c, v in EVENT.items())
    row = spark.createDataFrame([tuple((EVENT | change).values())], kinds).select(evidence.faults(10**13).alias("f")).first().f
    assert row[:1] == ([fault] if fault else [])


def test_burn_is_of_one_version_and_trims(spark):
    kinds = "hour_ts long, domain string, channel_id long, grp string, quota long, traffic_class_version int"
    facts = spark.createDataFrame([(0, " d", 1, "g ", 500000, 5), (0, "d ", 1, " g", 500000, 5), (0, "d", 1, "g", 500000, 4), (3600, "d", 1, "g", 500000, 5), (0, " ", 1, "g", 500000, 5)], kinds)
    ledger = spark.createDataFrame([(0, "complete", 5), (3600, "complete", 4), (7200, "complete", 5)], "hour_ts long, status string, traffic_class_version int")
    rates = spark.createDataFrame([(1, "g", 1.0, 2.0)], "channel_id long, grp string, upstream double, site double")
    r = channels.burn(facts, rates, ledger, 10).collect()
    assert [(x.domain, x.daily_cost_usd, x.missing_groups) for x in r] == [("d", pytest.approx(1.0 / 2 * 24), "")]


def test_price_views(spark):
    df = spark.createDataFrame
    pairs = df([(1, "a", "d"), (1, "b", "d"), (2, "a", "d"), (3, "a", "x"), (4, "a", "d")], "channel_id long, grp string, domain string")
    site = df([("a", 2.0, 1), ("a", 3.0, 9)], "grp string, multiplier double, effective_at long")
    groups = df([("d", "a", 5.0, 0.0, 1)], "domain string, grp string, multiplier double, discount double, effective_at long")
    costs = df([(1, "a", "u", 4.0, 0.5, 1), (1, "a", "u", 9.0, 0.5, 9), (2, "q", "u", 1.0, 0.0, 1), (2, "r", " u ", 1.0, 1.0, 1), (4, "q", "u", 1.0, 1.0, 1), (4, "r", "v", 1.0, 1.0, 1)], "channel_id long, grp string, upstream_group string, multiplier double, discount double, effective_at long")
    domains = df([("d", 1.0, 2.0, 1)], "domain string, paid double, credit double, effective_at long")
    settings = df([(7.0, 1.0, 1.0, 1), (8.0, 1.0, 1.0, 9)], "fx double, paid double, credit double, effective_at long")
    view = {(r.channel_id, r.grp): r for r in channels.price_views(pairs, site, groups, costs, domains, settings, 5).collect()}
    assert {k: (v.price_from, v.conflict, v.effective, v.complete) for k, v in view.items()} == {(1, "a"): ("pair", False, 1.0, True), (1, "b"): ("channel", False, 1.0, False), (2, "a"): ("channel", False, 0.5, True), (3, "a"): ("none", False, None, False), (4, "a"): ("domain", True, 2.5, True)}
    assert view[1, "a"].margin == pytest.approx((2.0 - 1.0) / 2.0) and view[1, "a"].gap == 1.0
    none = channels.price_views(pairs, site, groups, costs, domains, settings, 0)
    assert none.count() == 5 and none.where("complete or upstream_configured or site_configured").count() == 0
    table = pairs.select("domain", "channel_id").distinct().withColumns({"status": F.lit(1), "current": F.lit(True)})
    assert {r.domain: (r.enabled, r.configured, r.complete) for r in channels.rate_config(table, channels.as_of(costs, ["channel_id", "grp"], 5)).collect()} == {"d": (3, 2, False), "x": (1, 0, False)}


def gaps(present, since, until):
    out, at = [], since
    while at < until:
        if at in present:
            at += 60
            continue
        end = at
        while end < until and end not in present:
            end += 60
        out.append((at, end))
        at = end
    return out


@pytest.mark.parametrize("present", [[], [0], [60, 120], range(0, 400 * S.DAY, 60 * 977), [3 * S.DAY, 399 * S.DAY + 60], [-60, 400 * S.DAY, 7], range(0, 2 * S.DAY, 60)])
def test_uncovered_ranges(spark, present):
    since, until = 0, 400 * S.DAY
    rows = spark.createDataFrame([(t,) for t in present], "bucket_ts long")
    assert [tuple(r) for r in audit.uncovered_ranges(rows, since, until).collect()] == gaps(set(present), since, until)
    assert [tuple(r) for r in audit.next_uncovered(rows, since, until).collect()] == gaps(set(present), since, until)[:1]


@pytest.mark.parametrize(("present", "found"), [([], (0, None)), ([0, 60], (120, None)), ([0, 60, 240], (120, 240)), ([300, 7, -60], (0, 300))])
def test_next_uncovered_without_an_end(spark, present, found):
    rows = spark.createDataFrame([(t,) for t in present], "bucket_ts long")
    assert [tuple(r) for r in audit.next_uncovered(rows, 0).collect()] == [found]


def test_the_next_gap_may_lie_after_the_present(spark, tmp_path):
    """Logs without a gap until after the end of the windows that look back."""
    minutes = spark.range(queries.SINCE, queries.NOW + 600, 60).select(F.timestamp_seconds("id").alias("ts"))
    minutes.withColumns({"event_id": F.lit(1), "user_id": F.lit(1), "event_type": F.lit("view"), "value": F.lit(1.0), "props": F.lit('{"k": 1}')}).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert [tuple(r) for r in plans.w6_next_uncovered(spark, str(tmp_path)).collect()] == [(queries.NOW + 600, None)]


def test_nothing_is_uncovered(spark):
    rows = spark.range(0, S.DAY, 60).withColumnRenamed("id", "bucket_ts")
    assert audit.uncovered_ranges(rows, 0, S.DAY).count() == 0


M = ["requests", "refund_records", "consume_quota"]


def test_member_days(spark):
    kinds = "user_id long, date_ts long, requests long, refund_records long, consume_quota long"
    d = 16 * 3600  # the start of a business day
    facts = spark.createDataFrame([(1, d, 1, 1, 10), (1, d, 1, 0, 5), (2, d, 1, 0, 7), (3, d, 1, 0, 7), (9, d, 1, 0, 1), (2, d - S.DAY, 1, 0, 1)], kinds)
    controls = spark.createDataFrame([(1, d, 2, 1, 15, 3), (3, d, 1, 0, 7, 2), (4, d, 1, 0, 0, 1), (8, d, 0, 0, 0, 0)], kinds + ", source_rows long")
    members = spark.createDataFrame([(u,) for u in (1, 2, 3, 4, 5)], "user_id long")
    got = {(r.user_id, r.date_ts): r.reason for r in audit.unreconciled_days(facts, controls, members, d, d + 2 * S.DAY, M).collect()}
    assert got == {(2, d): "totals", (3, d): "source rows", (4, d): "totals", (8, d): "unknown member", (9, d): "unknown member"}
    hours = [(u, d + h * 3600, "complete", "e", "h", 0, 0, 0, 0) for u in (1, 5) for h in range(24) if (u, h) != (5, 3)]
    hours[0] = (1, d, "complete", "e", "h", 2, 1, 15, 3)
    states_ = spark.createDataFrame(hours, "user_id long, hour_ts long, status string, source_epoch string, content_hash string, requests long, refund_records long, consume_quota long, source_rows long")
    found = audit.unreconciled_days(facts, audit.controls_from_hours(states_, "e", [*M, "source_rows"]), members, d, d + S.DAY, M, from_hours=True)
    assert {r.user_id: r.reason for r in found.collect()} == {2: "no control", 3: "no control", 4: "no control", 5: "no control", 9: "unknown member"}
    twice = states_.union(states_.where("user_id = 1").limit(1))
    found = audit.unreconciled_days(facts, audit.controls_from_hours(twice, "e", [*M, "source_rows"]), members, d, d + S.DAY, M, from_hours=True)
    assert {r.user_id: r.reason for r in found.where("user_id = 1").collect()} == {1: "no control"}


def test_health_conditions(spark):
    fine = {"main_last_success": 990, "problem_last_success": 990, "problem_last_failure": 0, "coverage_to": 900, "target_to": 900, "pending": 0, "migration": "complete", "sources": 2, "expected": 2, "unhealthy": 0}
    kinds = ", ".join(f"{c} {'string' if c == 'migration' else 'long'}" for c in fine)
    rows = [{}, {"main_last_success": 0}, {"main_last_success": 819}, {"pending": 1}, {"problem_last_failure": 991}, {"coverage_to": None}, {"problem_last_success": None}, {"migration": None}, {"sources": 1}, {"unhealthy": 1}, {"target_to": 1921}]
    df = spark.createDataFrame([tuple((fine | r).values()) for r in rows], kinds)
    assert [r.reasons for r in health.judged(df, 1000).collect()] == ["", "main_never", "main_stale", "minutes_pending", "problem_failed", "problem_never", "problem_never", "migration_open", "sources_missing", "sources_unhealthy", "problem_lag"]
    assert [r.status for r in health.judged(df, 1000, stability=False, edges=False).collect()] == ["ok", *["degraded"] * 4, "ok", "ok", "degraded", "ok", "ok", "ok"]
    minutes = spark.createDataFrame([(0, False, 5), (60, True, 5), (120, False, 4), (60 * 60, False, 5)], "bucket_ts long, complete boolean, traffic_class_version int")
    assert health.pending_minutes(minutes, 60 * 12).first().pending == 1


BEAT = "node string, " + states.TELEMETRY


def test_silence_changes_a_source(spark, tmp_path):
    """Node a goes silent and comes back; b reports on, with a backlog and then a loss; nothing is said twice."""
    source = str(tmp_path / "source")
    first = [("a", 0, 0, None, 0, 0), ("b", 0, 0, 0, 0, 0), ("b", 100, 90, 16 << 20, 0, 0), ("b", 250, 250, 0, 0, 0), ("b", 400, 400, 0, 390, 0)]
    second = [("b", 500, 500, 0, 390, 0), ("b", 700, 700, 0, 390, 0), ("b", 880, 880, 0, 390, 0), ("b", 1000, 1000, 0, 390, 0), ("b", 1150, 1150, 0, 390, 0)]
    third = [("a", 1300, 1300, None, 0, 0), ("b", 1320, 1320, 0, 390, 0)]
    base = 10_000  # a row of the time 0 is as late as the first watermark
    for rows in (first, second, third):
        rows = [(n, base + at, base + event, held, base + lost if lost else 0, 0) for n, at, event, held, lost, _ in rows]
        spark.createDataFrame(rows, BEAT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(BEAT).option("maxFilesPerTrigger", 1).parquet(source)
    states.start_changes(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted((r.node, r.at - base, r.state, r.reasons) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", 0, "ok", ""), ("a", 181, "warn", "heartbeat_stale"), ("a", 901, "bad", "heartbeat_stale"), ("a", 1300, "ok", ""),
        ("b", 0, "ok", ""), ("b", 100, "warn", "backlog_large"), ("b", 250, "ok", ""), ("b", 400, "warn", "recent_cursor_discontinuity"),
        ("b", 681, "warn", "heartbeat_stale,recent_cursor_discontinuity"), ("b", 700, "warn", "recent_cursor_discontinuity"), ("b", 1291, "ok", "")]


def test_states_agree_with_the_batch_form(spark):
    rows = [(i, i % 3 * 200, i % 5 * 250, [None, 0, 1, 16 << 20][i % 4], i % 7 * 300, i % 2 * 1500) for i in range(60)]
    df = spark.createDataFrame(rows, "node int, last_ingest_ts long, last_event_ts long, backlog_bytes long, last_cursor_discontinuity_at long, last_discarded_at long")
    batch = {r.node: (r.state, r.reasons) for r in edge.source_health(df, 2000).collect()}
    for node, *values in rows:
        state, reasons = states.health_at(dict(zip(states.FIELDS, values, strict=True)), 2000)
        assert batch[node] == (state, ",".join(reasons))


def test_two_streams_meet(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(s + 10_000)
    for name, rows in (("s", [("a", 0), ("b", 10), ("c", 20), ("z", 20000)]), ("o", [("a", 5), ("a", 3600), ("b", 3611), ("q", 30), ("z", 20001)])):
        spark.createDataFrame(rows, "trace string, ts long").coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema("trace string, ts long").parquet(str(tmp_path / n))
    joined = states.matched(read("s").select("trace", F.lit("l").alias("logical"), at(F.col("ts")).alias("at")), read("o").select("trace", F.lit("succeeded").alias("outcome"), at(F.col("ts")).alias("at")))
    joined.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.trace, r.started is not None, r.ended is not None) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", True, True), ("a", True, True), ("b", False, True), ("b", True, False), ("c", True, False), ("q", False, True), ("z", True, True)]


def test_small_lists(spark):
    logs = spark.createDataFrame([(i, i, k, "h%d" % (i % 3), "x") for i, k in enumerate(["infra_a", "infra_b_FAILED", "infrab", "INFRA_x"] * 20)], "id long, ts long, kind string, target string, detail string")
    rows = board.recent_alerts(logs, ["h0"]).collect()
    assert [r.ts for r in rows] == sorted((r.ts for r in rows), reverse=True) and {(r.kind, r.status) for r in rows} == {("infra_a", "bad"), ("infra_b", "warn")} and len(rows) < 20
    tokens = spark.createDataFrame([(1, 1, "b", 5, False, None), (1, 2, "a", 5, False, 0), (1, 3, "z", 9, True, 99), (1, 4, "c", 5, False, 7)], "user_id long, token_id long, name string, consume_quota long, deleted boolean, total_quota long")
    assert [r.token_id for r in usage.ordered_tokens(tokens).orderBy("rank").collect()] == [4, 2, 1, 3]
    labels = spark.createDataFrame([("x", "one", "")], "origin string, scope string, cost_basis string").withColumns(C.normal_labels()).first()
    assert tuple(labels) == ("legacy_base", "legacy", "legacy_assumed_base")
    hours = spark.createDataFrame([(3600, 1), (7200, 2)], "hour_ts long, channel_id long")
    chans = spark.createDataFrame([(1, "v"), (2, "w")], "id long, vendor string")
    assert filters.of_vendor(hours, chans, "v").count() == 1 and filters.of_vendor(hours, chans, None).count() == 2
