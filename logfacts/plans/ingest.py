"""Registered queries of ingest: batches once, finalised minutes, replaced ranges, payload hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from logfacts.functions import scalars as S
from logfacts.operators import repair
from logfacts.plans import testmap as T
from logfacts.plans.queries import DAY_SQL, NOW, SINCE, query
from logfacts.sources import ranges, tables
from logfacts.streaming import ingest, jobs

FIELDS = ("bucket_ts", "reason", "model", "grp", "count")
ENVELOPE = "node string, batch_id long, received_at int, samples array<struct<bucket_ts: bigint, reason: string, model: string, grp: string, count: bigint>>"
#: The batches of SQL: the rejections of a node and hour.
BATCHES = T.LOGS + ", " + T.REJECTIONS + """, m AS (SELECT node, bucket_ts // 3600 AS batch_id, bucket_ts, reason, model, grp, CAST(sum(count) AS BIGINT) AS count FROM rejections GROUP BY ALL)"""


def _batches(spark, d):
    """Envelopes with the rejections of a node and hour."""
    keys = ("bucket_ts", "node", "reason", "model", "grp")
    rows = T.rejections(spark, d).groupBy(*keys).agg(F.sum("count").alias("count")).withColumn("batch_id", F.expr("bucket_ts div 3600"))
    return rows.groupBy("node", "batch_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("samples"))


def _pushed(spark, d):
    """An inbox that took in every batch twice, the second time in another order, and other payloads under a fifth of the ids."""
    batches, source = _batches(spark, d), tables.shared_folder(spark)
    more = F.transform("samples", lambda s: s.withField("count", s["count"] + 1))
    pushes = (batches, batches.withColumn("samples", F.reverse("samples")), batches.where("batch_id % 5 = 0").withColumn("samples", more))
    for number, rows in enumerate(pushes, 1):
        rows.select("node", "batch_id", F.lit(number).alias("received_at"), "samples").write.mode("append").parquet(source)
    inbox = ingest.Inbox(tables.shared_folder(spark), FIELDS)
    stream = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", 8).parquet(source)
    ingest.start(stream, inbox, tables.shared_folder(spark)).awaitTermination()
    return inbox


@query(T.LOGS + ", " + T.REJECTIONS + " SELECT bucket_ts, node, reason, model, grp, CAST(sum(count) AS BIGINT) AS count FROM rejections GROUP BY ALL")
def r4_exactly_once(spark, d):
    samples = ingest.accepted_samples(spark, _pushed(spark, d), ENVELOPE)
    return samples.groupBy("bucket_ts", "node", "reason", "model", "grp").agg(F.sum("count").alias("count"))


@query(BATCHES + " SELECT node, batch_id, 1 AS accepted, 1 AS duplicates, CASE WHEN batch_id % 5 = 0 THEN 1 ELSE 0 END AS conflicts FROM m GROUP BY ALL")
def r4_ledger(spark, d):
    return ingest.told(spark, _pushed(spark, d), ENVELOPE)


_TEXT = " || '|' || ".join(f"strlen(CAST({c} AS VARCHAR)) || ':' || {c}" for c in FIELDS)
_LANES = [f"CAST(sum(CAST('0x' || substr(h, {1 + S.LANE_DIGITS * i}, {S.LANE_DIGITS}) AS HUGEINT)) AS VARCHAR)" for i in range(S.LANES)]


@query(BATCHES + f", h AS (SELECT node, batch_id, sha256({_TEXT}) AS h FROM m) SELECT node, batch_id, sha256(concat_ws(':', count(*), {', '.join(_LANES)})) AS payload_hash, true AS same_when_shuffled, true AS other_when_changed FROM h GROUP BY node, batch_id")
def f25_payload_hash(spark, d):
    rows = _batches(spark, d)
    of = lambda c: S.multiset_hash(c, list(FIELDS))
    keyed = F.transform("samples", lambda s: F.struct(F.xxhash64(*(s[f] for f in FIELDS)).alias("key"), s.alias("sample")))  # equal samples may have equal keys, so no comparison of its own
    shuffled = F.transform(F.sort_array(keyed), lambda x: x["sample"])
    changed = F.transform("samples", lambda s, i: s.withField("count", s["count"] + F.when(i == 0, 1).otherwise(0)))
    mine = of(F.col("samples"))
    return rows.select("node", "batch_id", mine.alias("payload_hash"), (of(shuffled) == mine).alias("same_when_shuffled"), (of(changed) != mine).alias("other_when_changed"))


@query(BATCHES + " SELECT node, batch_id % 40 AS batch_id, count(DISTINCT batch_id) + 1 AS copies, count(DISTINCT batch_id) > 1 AS conflict FROM m GROUP BY node, batch_id % 40")
def u8_payload_conflicts(spark, d):
    """Ids that come round again with other payloads, and each first one pushed twice in another order."""
    rows = _batches(spark, d).withColumn("short", F.col("batch_id") % 40)
    first = rows.groupBy("node", "short").agg(F.min_by("samples", "batch_id").alias("samples"))
    both = rows.select("node", F.col("short").alias("batch_id"), "samples").unionByName(first.select("node", F.col("short").alias("batch_id"), F.reverse("samples").alias("samples")))
    return tables.batches(both, ["node", "batch_id"], S.multiset_hash(F.col("samples"), list(FIELDS)))


_FINAL = T.TRAFFIC + f" SELECT created_at // 60 * 60 AS bucket_ts, model_name, {T.measures_sql('success', 'failed')} FROM traffic WHERE created_at // 60 * 60 + 60 <= (SELECT max(created_at) FROM traffic) - 600 GROUP BY ALL"


@query(_FINAL)
def r2_final_minutes(spark, d):
    """The stream itself, in append mode: minutes that nothing can change any more."""
    source = spark.readStream.schema(T.read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = T.as_logs(source).withColumn("at", F.timestamp_seconds("created_at"))
    path = tables.shared_folder(spark)
    jobs.append_sink(jobs.final_minutes(rows, T.RULES), path, tables.shared_folder(spark)).awaitTermination()
    return spark.read.parquet(path).select("bucket_ts", "model_name", "success", "failed")


_D0 = (SINCE + S.ZONE) // S.DAY * S.DAY - S.ZONE
_LEDGER = T.TRAFFIC + f", x AS (SELECT {DAY_SQL.format('created_at')} AS date_ts, * FROM traffic WHERE created_at >= {_D0} AND created_at < {_D0 + 4 * S.DAY})"


def _days(spark, d, keep):
    """Four days stored without some of their rows, the middle two then taken anew with all of them."""
    path = tables.shared_folder(spark)
    logs = T.logs(spark, d, _D0, _D0 + 4 * S.DAY)
    repair.repair_days(logs.where(keep), path, _D0, _D0 + 4 * S.DAY, T.RULES, version=4)
    repair.repair_days(logs, path, _D0 + S.DAY, _D0 + 3 * S.DAY, T.RULES, version=5)
    return path, logs


_SHOWN = f"date_ts >= {_D0 + S.DAY} AND date_ts < {_D0 + 3 * S.DAY}"


@query(_LEDGER + f""" SELECT date_ts, 'complete' AS status, CASE WHEN {_SHOWN} THEN 5 ELSE 4 END AS version, CAST(count(*) AS BIGINT) AS requests, CAST(coalesce(sum(quota) FILTER (WHERE type = 2), 0) AS BIGINT) AS quota,
  CAST(count(*) AS BIGINT) AS stored, true AS refused FROM x WHERE id % 7 <> 0 OR {_SHOWN} GROUP BY date_ts""")
def s10_verified_range(spark, d):
    """After a replacement whose rows do not agree with their controls, which leaves rows and ledger as they were."""
    path, logs = _days(spark, d, "id % 7 <> 0")
    rows, until = repair.day_rows(logs, T.RULES).where(F.col("date_ts") >= _D0 + 2 * S.DAY), _D0 + 4 * S.DAY
    try:
        ranges.replace_range(rows.withColumn("quota", F.col("quota") + 1), repair.day_controls(logs, T.RULES), path, "date_ts", _D0 + 2 * S.DAY, until, S.DAY, repair.measures(), 6)
        refused = False
    except ranges.ControlMismatch:
        refused = True
    stored = ranges.facts(spark, path, "date_ts").groupBy("date_ts").agg(F.sum(F.col("success") + F.col("anomaly") + F.col("failed")).alias("stored"))
    return ranges.ledger(spark, path, "date_ts").join(stored, "date_ts").select("date_ts", "status", "version", "requests", "quota", "stored", F.lit(refused).alias("refused"))


@query(_LEDGER + f" SELECT created_at // 3600 * 3600 AS hour_ts, channel_id, model_name, grp, {T.measures_sql('success', 'failed', 'quota')} FROM x WHERE id % 5 <> 0 OR {_SHOWN} GROUP BY ALL")
def r3_partition_repair(spark, d):
    """Late rows taken in by writing two of four days anew."""
    path, _ = _days(spark, d, "id % 5 <> 0")
    return ranges.facts(spark, path, "date_ts").select("hour_ts", "channel_id", "model_name", "grp", "success", "failed", "quota")
