from pyspark.sql import functions as F

from logfacts.functions.classify import Rules
from logfacts.operators import board, kpi, stability, upstream, usage


def test_snapshot_merges_hosts_and_judges_each_type(spark):
    samples = [
        ("i1", "instance", "cpu", 10.0, 100), ("i1", "host", "mem_total_mb", 100.0, 110), ("i1", "host", "mem_avail_mb", 5.0, 120), ("i1", "host", "cpu", 20.0, 90),
        ("h1", "host", "cpu", 10.0, 100), ("b1", "instance", "burst", 19.0, 100), ("p1", "probe", "reachable", 1.0, 100), ("p1", "probe", "status_code", 200.0, 100), ("p1", "probe", "via_cdn", 1.0, 100),
        ("p2", "probe", "reachable", 1.0, 100), ("p2", "probe", "status_code", 200.0, 100), ("p3", "probe", "status_code", 200.0, 100), ("l1", "lock", "locked", 1.0, 100), ("l2", "lock", "status_code", 200.0, 100),
        ("d1", "database", "connections", 71.0, 100), ("out", "instance", "cpu", 99.0, 100),
    ]
    df = spark.createDataFrame(samples, "resource string, rtype string, metric string, value double, bucket_ts long")
    found = board.snapshot(df, 200, ["out"])
    rows = {r.resource: r for r in found.collect()}
    assert set(rows) == {"i1", "h1", "b1", "p1", "p2", "p3", "l1", "l2", "d1"}
    assert rows["i1"].rtype == "instance" and rows["i1"].metrics == {"cpu": 10.0, "mem_total_mb": 100.0, "mem_avail_mb": 5.0} and rows["i1"].age == 20 and rows["h1"].rtype == "instance"
    state = {r.resource: r.state for r in board.resource_states(found, **board.LIMITS).collect()}
    assert state == {"i1": "bad", "h1": "ok", "b1": "warn", "p1": "ok", "p2": "warn", "p3": "bad", "l1": "ok", "l2": "bad", "d1": "warn"}
    held = spark.createDataFrame([("h1", "warn"), ("b1", "bad"), ("b1", "ok"), ("d1", "bad")], "resource string, status string")
    empty = found.limit(1).select(F.lit("e1").alias("resource"), F.lit("instance").alias("rtype"), F.lit(1).cast("long").alias("newest"), F.lit(1).cast("long").alias("age"), F.create_map().cast("map<string,double>").alias("metrics"))
    both = found.unionByName(empty).unionByName(empty.withColumn("resource", F.lit("h0")))
    state = {r.resource: r.state for r in board.resource_states(both, containers=held.union(spark.createDataFrame([("e1", "ok")], held.schema)), **board.LIMITS).collect()}
    assert (state["h1"], state["b1"], state["d1"], state["e1"], state["h0"]) == ("warn", "bad", "warn", "ok", "nosample")
    whole = board.overall(board.resource_states(found, **board.LIMITS)).first()
    assert tuple(whole) == ("bad", 3, 1, 3, 1, 2, 1, "warn", "absent")
    none = board.overall(board.resource_states(found.where("false"))).first()
    lone = board.overall(board.resource_states(empty)).first()
    assert lone.state == "nosample" and lone.instances_total == 1 and lone.instances_ok == 0
    assert none.state == "nosample" and none.database == "absent" and none.instances_total == 0


def test_shown_facts(spark):
    facts = spark.createDataFrame([(100, 1, "m", "g"), (100, 2, "m", "g"), (100, 3, "m", "g"), (300, 3, "m", "g"), (100, 9, "m", "x")], "bucket_ts long, channel_id long, model_name string, grp string")
    channels = spark.createDataFrame([(1, 1, 0), (2, 2, 0), (3, 1, 200)], "id long, status int, enabled_since long")
    pairs = spark.createDataFrame([("g", "m")], "grp string, model string")
    keys = lambda df: sorted((r.bucket_ts, r.channel_id) for r in df.collect())
    assert keys(kpi.shown(facts, channels, pairs)) == [(100, 1), (300, 3)]
    assert keys(kpi.shown(facts, channels, pairs.where("false"))) == [(100, 1), (100, 9), (300, 3)]
    assert len(keys(kpi.shown(facts, channels, pairs, "channel_id"))) == 5


def test_search_by_group_request_and_fee_notice(spark):
    kinds = "id long, created_at long, type int, user_id long, model_name string, grp string, content string, token_name string, token_id long, request_id string, other string"
    rows = [(1, 10, 2, 5, "m", "g", "100%_x", "t", 1, "r1", None), (2, 10, 2, 5, "m", "h", "", "t", 1, "r2", '{"violation_fee_code":"c"}'), (3, 10, 2, 5, "m", "g", "probe", "probe", 1, "r3", None), (4, 10, 2, 5, "m", "g", None, "t", 1, "r4", "{}")]
    logs = spark.createDataFrame(rows, kinds)
    ids = lambda **o: sorted(r.id for r in usage.search(logs, 0, 20, **o).collect())
    assert ids() == [1, 2, 3, 4] and ids(rules=Rules("probe")) == [1, 2, 4] and ids(group="g") == [1, 3, 4] and ids(request="r2") == [2]
    assert ids(content="%_") == [1] and ids(content=usage.FEE_WORD) == [2] and ids(content="violation") == []


def test_caps_and_budgets(spark):
    rows = spark.createDataFrame([(f"k{i}", i % 3) for i in range(6)], "key string, n long")
    got = usage.capped(rows, 4, F.desc("n"), F.col("key")).collect()
    assert [(r.key, r.truncated) for r in got] == [("k2", True), ("k5", True), ("k1", True), ("k4", True)]
    assert {r.truncated for r in usage.capped(rows, 6, F.col("key")).collect()} == {False} and usage.capped(rows.where("false"), 3, F.col("key")).count() == 0
    members = spark.createDataFrame([(1,), (2,), (2,)], "user_id long")
    day = 86400
    assert tuple(usage.cell_budget(members, 0, day, 4).first()) == (2, 2, 4, False)  # a UTC day touches two business days
    assert tuple(usage.cell_budget(members, 0, day, 3).first()) == (2, 2, 4, True) and usage.cell_budget(members, 5, 5).first().cells == 0


def test_group_sources(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "grp string")
    special = spark.createDataFrame([("+: vip ", "x"), ("-:gone", "x"), ("append_1", "old"), ("append_2", "unknown"), ("plain", " REMOVE"), (" kept ", None), ("", "x"), (None, "x")], "key string, description string")
    ratios = spark.createDataFrame([("vip", 2.0), ("old", 0.5), ("a", 0.0), ("b", float("nan")), ("c", float("inf")), ("kept", 1.0), ("unused", 1.0)], "grp string, ratio double")
    got = {r.grp: (r.ratio, r.priced) for r in upstream.group_sources(names(" a ", "b", "", None), special, names("c", "d", "vip"), ratios).collect()}
    no = (None, False)
    assert got == {"vip": (2.0, True), "old": (0.5, True), "append_2": no, "kept": (1.0, True), "a": no, "b": no, "c": no, "d": no}


def test_deltas_in_one_pass_are_those_of_two(spark):
    rows = [(h * 3600, h % 3 if h % 5 else None, f"m{h % 2}", None if h % 7 == 0 else "g", h % 4, h % 3, 1, 0, 0, 0, h % 2) for h in range(40)]
    df = spark.createDataFrame(rows, "hour_ts long, channel_id long, model_name string, grp string, success long, anomaly long, failed long, tokens long, quota long, sum_use_time long, rejected long")
    now, old = (stability.levels(df.where((F.col("hour_ts") >= a * 3600) & (F.col("hour_ts") < b * 3600))) for a, b in ((25, 38), (5, 25)))
    key = lambda r: (r.level, r.grp, r.channel_id, r.model, None if r.delta_pp is None else round(r.delta_pp, 9))
    two = sorted(map(key, stability.with_deltas(now, old).collect()), key=str)
    assert sorted(map(key, stability.deltas(df, 25 * 3600, 38 * 3600, 5 * 3600).collect()), key=str) == two and len(two) > 10
