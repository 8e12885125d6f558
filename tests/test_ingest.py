"""Batches once, finalised minutes, replaced ranges."""

import pytest
from pyspark.sql import functions as F

from logfacts.functions import scalars as S
from logfacts.operators import repair
from logfacts.plans import ingest as plans
from logfacts.plans import testmap as T
from logfacts.sources import ranges
from logfacts.streaming import ingest, jobs

SCHEMA = "node string, batch_id string, received_at int, samples array<struct<bucket_ts: bigint, reason: string, count: bigint>>"
FIELDS = ("bucket_ts", "reason", "count")


def envelopes(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_multiset_hash(spark):
    a, b, c = (60, "x", 1), (60, None, 1), (120, "", 2)
    rows = [[a, b, c], [c, a, b], [a, b], [a, a, b, c], [(60, "x", 2), b, c], [a, (60, "", 1), c], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, samples array<struct<bucket_ts: bigint, reason: string, count: bigint>>")
    h = [r.h for r in df.select("i", S.multiset_hash(F.col("samples"), list(FIELDS)).alias("h")).orderBy("i").collect()]
    assert h[0] == h[1] and h[6] == h[7]
    assert len(set(h)) == 6  # another number, a null unlike a blank, one copy more or less


def test_payload_hash_of_large_batches(spark, tmp_path):
    """Some thousands of samples in a batch, of which many differ by their model alone."""
    n = F.col("id")
    rows = spark.range(40000).select(n.alias("event_id"), F.timestamp_seconds(F.lit(1706313600) + F.pmod(F.xxhash64(n), F.lit(3600))).alias("ts"), F.pmod(F.xxhash64(n, F.lit(1)), F.lit(5)).alias("user_id"), F.lit("signup").alias("event_type"), F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.pmod(F.xxhash64(n, F.lit(2)), F.lit(100)).cast("string"), F.lit("}")).alias("props"))
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = plans.f25_payload_hash(spark, str(tmp_path)).collect()
    assert {r.node for r in found} == {"node-0", "node-1"} and all(r.same_when_shuffled and r.other_when_changed for r in found)


def test_a_replay_counts_once_and_a_conflict_is_kept_aside(spark, tmp_path):
    inbox = ingest.Inbox(str(tmp_path / "inbox"), FIELDS)
    one, two = [(60, "x", 1), (120, "y", 2)], [(120, "y", 2), (60, "x", 1)]
    ingest.receive(envelopes(spark, ("n", "b1", 1, one), ("n", "b2", 1, one), ("n", "b2", 2, two), ("n", "b2", 3, one[:1])), 0, inbox)
    ingest.receive(envelopes(spark, ("n", "b1", 9, two), ("n", "b1", 9, one[:1]), ("m", "b1", 9, one), ("n", "b3", 9, [])), 1, inbox)
    told = {(r.node, r.batch_id): (r.accepted, r.duplicates, r.conflicts) for r in ingest.told(spark, inbox, SCHEMA).collect()}
    assert told == {("n", "b1"): (1, 1, 1), ("n", "b2"): (1, 1, 1), ("m", "b1"): (1, 0, 0), ("n", "b3"): (1, 0, 0)}
    assert ingest.accepted_samples(spark, inbox, SCHEMA).agg(F.sum("count")).first()[0] == 9


def test_an_epoch_that_is_run_again_replaces_itself(spark, tmp_path):
    inbox = ingest.Inbox(str(tmp_path / "inbox"), FIELDS)
    batch = envelopes(spark, ("n", "b1", 1, [(60, "x", 1)]))
    for _ in range(2):
        ingest.receive(batch, 0, inbox)
    assert ingest.accepted_samples(spark, inbox, SCHEMA).count() == 1
    ingest.receive(batch, 1, inbox)
    (tmp_path / "inbox" / "epoch=0" / "_SUCCESS").unlink()  # as if that job had not been committed
    assert ingest.complete_epochs(spark, inbox) == [1]
    assert ingest.accepted_samples(spark, inbox, SCHEMA).count() == 0  # epoch 1 took it for a copy of epoch 0's
    ingest.receive(batch, 0, inbox)
    assert ingest.accepted_samples(spark, inbox, SCHEMA).count() == 1


def test_the_stream_takes_several_micro_batches(spark, tmp_path):
    source = str(tmp_path / "source")
    for i in range(4):
        envelopes(spark, ("n", f"b{i % 2}", i, [(60 * (i % 2), "x", 1)])).coalesce(1).write.mode("append").parquet(source)
    inbox = ingest.Inbox(str(tmp_path / "inbox"), FIELDS)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # started again, it finds nothing new
        ingest.start(stream, inbox, str(tmp_path / "checkpoint")).awaitTermination()
    rows = ingest.envelopes(spark, inbox, SCHEMA)
    assert {(r.status, r.n) for r in rows.groupBy("status").agg(F.count("*").alias("n")).collect()} == {("accepted", 2), ("duplicate", 2)}
    assert len(ingest.complete_epochs(spark, inbox)) == 4


def test_final_minutes_drop_what_comes_too_late(spark, tmp_path):
    base = T.logs(spark, "/root/testdata/sf0.001").where("type = 2 and token_name <> 'probe'").limit(1)
    source = str(tmp_path / "source")
    for ts in ([1000, 1010, 5000], [5010], [1005, 1030, 9000]):  # 1005 and 1030 are later than 5000 - 600 allows; 9000 makes 5000's minute final
        rows = base.crossJoin(spark.createDataFrame([(t,) for t in ts], "t long")).withColumn("created_at", F.col("t")).drop("t")
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    rows = jobs.final_minutes(stream.withColumn("at", F.timestamp_seconds("created_at")), T.RULES)
    jobs.append_sink(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    found = {r.bucket_ts: r.success + r.anomaly for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {960: 2, 4980: 2}


@pytest.fixture(scope="module")
def days(spark):
    logs = T.logs(spark, "/root/testdata/sf0.001").where("created_at >= 1704038400").cache()
    first = logs.agg(F.min("created_at")).first()[0]
    return logs, (first + S.ZONE) // S.DAY * S.DAY - S.ZONE + S.DAY


def test_a_range_is_replaced_only_if_its_totals_agree(spark, days, tmp_path):
    logs, start = days
    path, until = str(tmp_path / "t"), start + 3 * S.DAY
    repair.repair_days(logs.where("id % 3 <> 0"), path, start, until, T.RULES, 4)
    before = {tuple(r) for r in ranges.facts(spark, path, "date_ts").collect()}
    rows, controls = repair.day_rows(logs.where((F.col("created_at") >= start) & (F.col("created_at") < until)), T.RULES), repair.day_controls(logs, T.RULES)
    with pytest.raises(ranges.ControlMismatch):
        ranges.replace_range(rows.where(F.col("date_ts") > start), controls, path, "date_ts", start, until, S.DAY, repair.measures(), 5)
    with pytest.raises(ranges.ControlMismatch):  # rows of another day
        ranges.replace_range(rows, controls, path, "date_ts", start + S.DAY, until, S.DAY, repair.measures(), 5)
    assert {tuple(r) for r in ranges.facts(spark, path, "date_ts").collect()} == before
    assert {r.version for r in ranges.ledger(spark, path, "date_ts").collect()} == {4}
    assert not list((tmp_path / "t").glob("staged-*"))
    repair.repair_days(logs, path, start + S.DAY, start + 2 * S.DAY, T.RULES, 5)
    kept = {tuple(r) for r in ranges.facts(spark, path, "date_ts").where(F.col("date_ts") != start + S.DAY).collect()}
    assert kept == {r for r in before if r[0] != start + S.DAY}
    assert {(r.date_ts - start) // S.DAY: r.version for r in ranges.ledger(spark, path, "date_ts").collect()} == {0: 4, 1: 5, 2: 4}


def test_a_day_without_rows_is_complete_and_empty(spark, days, tmp_path):
    logs, start = days
    path = str(tmp_path / "t")
    repair.repair_days(logs, path, start, start + 2 * S.DAY, T.RULES)
    repair.repair_days(logs.where(F.col("created_at") >= start + S.DAY), path, start, start + 2 * S.DAY, T.RULES)
    ledger = {r.date_ts: (r.status, r.rows) for r in ranges.ledger(spark, path, "date_ts").collect()}
    assert ledger[start] == ("complete", 0) and ledger[start + S.DAY][1] > 0
    assert ranges.facts(spark, path, "date_ts").where(F.col("date_ts") == start).count() == 0


def test_a_range_that_was_broken_off_is_not_shown(spark, days, tmp_path):
    logs, start = days
    path = str(tmp_path / "t")
    done = repair.repair_days(logs, path, start, start + 2 * S.DAY, T.RULES)
    ranges._mark(done.where(F.col("date_ts") == start).withColumn("status", F.lit("running")), path, "date_ts")
    assert {r.date_ts for r in ranges.facts(spark, path, "date_ts").select("date_ts").distinct().collect()} == {start + S.DAY}
    assert ranges.facts(spark, path, "date_ts", complete_only=False).select("date_ts").distinct().count() == 2
