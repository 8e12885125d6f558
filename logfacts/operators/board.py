"""Status board and infrastructure: totals per group and model, beats, wide snapshots, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.functions import scalars as S
from logfacts.operators.rollup import again


def totals(minute_facts: DataFrame, now: int, channel_counts: DataFrame | None = None) -> DataFrame:
    """Uptime without client errors and the median latency per group and model; a state from the last day if there is enough.

    With ``channel_counts`` (grp, model, channels: the enabled ones) a pair without any is down and shows no figures, and
    pairs that have channels but no traffic are up. Uptime needs 20 requests; a latency of 0 is not shown.
    """
    last_day = F.col("bucket_ts") >= now - S.DAY
    up, bad = F.col("success") + F.col("anomaly"), F.col("failed") - F.col("err_4xx")
    rows = minute_facts.groupBy("grp", "model_name").agg(F.sum(up).alias("up"), F.sum(bad).alias("bad"), F.coalesce(F.sum(F.when(last_day, up)), F.lit(0)).alias("up_day"), F.coalesce(F.sum(F.when(last_day, bad)), F.lit(0)).alias("bad_day"), F.max("bucket_ts").alias("newest"), F.sum(up + F.col("failed")).alias("all"), *again([*S.LATENCY, "max_use_time"]))
    if channel_counts is not None:
        on = channel_counts.select("grp", F.col("model").alias("model_name"), "channels")
        rows = rows.join(on, ["grp", "model_name"], "full")
    off = F.coalesce("channels", F.lit(0)) == 0 if channel_counts is not None else F.lit(False)
    n, day = F.col("up") + F.col("bad"), F.col("up_day") + F.col("bad_day")
    fresh = ~off & (F.col("newest") >= now - 2 * S.DAY)
    p50 = S.percentile(list(S.LATENCY), S.LATENCY_EDGES, "max_use_time", 50)
    return rows.select("grp", "model_name", F.when(fresh & (F.col("all") >= 20) & (n > 0), F.col("up") / n * 100).alias("uptime"), F.when(fresh & (p50 > 0), p50).alias("p50"), F.when(off, "down").when(day >= 20, S.band(F.col("up_day") / day)).otherwise("up").alias("state"))


def group_states(models: DataFrame) -> DataFrame:
    """A group is up without problems, down without any model that is up, else warn."""
    up, problem = F.count_if(F.col("state") == "up"), F.count_if(F.col("state").isin("warn", "down"))
    return models.groupBy("grp").agg(F.when(problem == 0, "up").when(up == 0, "down").otherwise("warn").alias("state"))


def beats(points: DataFrame, since: int, now: int, slices: int = 50, least: int = 5) -> DataFrame:
    """(key, beats): the range in equal slices as a string of states; slices with few requests count as up."""
    ix = F.least(F.lit(slices - 1), F.greatest(F.lit(0), F.floor((F.col("ts") - since) / F.lit((now - since) / slices)))).cast("int")
    sums = points.groupBy("key", ix.alias("ix")).agg(F.sum(F.col("success") + F.col("anomaly")).alias("up"), F.sum("failed").alias("fail"))
    dense = points.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("ix"))
    n = F.col("up") + F.col("fail")
    mark = F.when(F.coalesce(n, F.lit(0)) < least, "up").otherwise(S.band(F.col("up") / n))
    rows = dense.join(sums, ["key", "ix"], "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ix", F.substring(mark, 1, 1).alias("m")))).alias("all"))
    return rows.select("key", F.array_join("all.m", "").alias("beats"))


def wide(samples: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """(resource, rtype, newest, metrics): the latest value of each metric."""
    rows = samples.where(~F.col("resource").isin(excluded)) if excluded else samples
    latest = rows.groupBy("resource", "rtype", "metric").agg(F.max_by("value", "bucket_ts").alias("value"), F.max("bucket_ts").alias("ts"))
    return latest.groupBy("resource", "rtype").agg(F.max("ts").alias("newest"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))


def snapshot(samples: DataFrame, now: int, excluded: list[str] | None = None) -> DataFrame:
    """(resource, rtype, newest, age, metrics): host rows count as those of the resource of their name, whose type they leave alone."""
    rows = samples.where(~F.col("resource").isin(excluded)) if excluded else samples
    kind = F.when(~F.col("rtype").isin("host", ""), F.col("rtype"))
    latest = rows.groupBy("resource", "metric").agg(F.max_by("value", "bucket_ts").alias("value"), F.max("bucket_ts").alias("ts"), F.max(kind).alias("kind"))
    whole = latest.groupBy("resource").agg(F.coalesce(F.max("kind"), F.lit("instance")).alias("rtype"), F.max("ts").alias("newest"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return whole.select("resource", "rtype", "newest", F.greatest(F.lit(0), F.lit(now) - (F.col("newest") + 60)).cast("long").alias("age"), "metrics")


def probe_status(m, warn_ms: float = 500, bad_ms: float = 1500, warn_days: float = 30, bad_days: float = 7, expect_cdn: bool = True) -> Column:  # noqa: ANN001
    """ok, warn or bad of an end-to-end probe; ``m`` gives a metric by name."""
    zero = lambda k: F.coalesce(m(k), F.lit(0.0))
    lost = (zero("reachable") < 1) | (F.floor(zero("status_code")) != 200) | (zero("latency_ms") >= bad_ms) | (m("cert_days") <= bad_days)
    slow = (zero("latency_ms") >= warn_ms) | (m("cert_days") <= warn_days) | (F.lit(expect_cdn) & (zero("via_cdn") < 1))
    return F.when(lost, "bad").when(slow, "warn").otherwise("ok")


def resource_states(resources: DataFrame, cpu_warn: float = 80, cpu_bad: float = 95, avail_warn: float = 15, avail_bad: float = 5, response_ms: float = 1000, connections: float = 70, disk_queue: float = 5, burst: float = 20, containers: DataFrame | None = None) -> DataFrame:
    """nosample, ok, warn or bad by type: database, lb, probe, lock, else a machine.

    ``containers`` (resource, status): a machine is no better than its worst container, which is all that counts without metrics.
    """
    if containers is not None:
        worst = containers.groupBy("resource").agg(F.bool_or(F.col("status") == "bad").alias("c_bad"), F.bool_or(F.col("status") == "warn").alias("c_warn"))
        resources = resources.join(worst, "resource", "left")
        held, c_bad, c_warn = F.col("c_bad").isNotNull(), F.coalesce("c_bad", F.lit(False)), F.coalesce("c_warn", F.lit(False))
    else:
        held = c_bad = c_warn = F.lit(False)
    m = lambda k: F.try_element_at("metrics", F.lit(k))
    share = lambda a, b: F.when(m(b) > 0, m(a) / m(b) * 100)
    memory, storage = share("free_mem_mb", "mem_total_mb"), share("free_storage_gb", "disk_total_gb")
    used = F.when(m("mem_total_mb") > 0, (m("mem_total_mb") - m("mem_avail_mb")) / m("mem_total_mb") * 100)
    database = F.when((memory < avail_bad) | (storage < avail_bad) | (m("cpu") > cpu_bad), "bad").when((memory < avail_warn) | (storage < avail_warn) | (m("cpu") > cpu_warn) | (m("connections") > connections) | (m("disk_queue") > disk_queue), "warn").otherwise("ok")
    balancer = F.when((m("unhealthy") >= 1) | (m("healthy") < 1), "bad").when(m("resp_ms") > response_ms, "warn").otherwise("ok")
    machine = F.when(c_bad | (m("status_failed") >= 1) | (m("cpu") > cpu_bad) | (used > 100 - avail_bad), "bad").when((m("cpu") > cpu_warn) | (used > 100 - avail_warn) | (m("disk_used_pct") > 100 - avail_warn) | (m("burst") < burst) | c_warn, "warn").otherwise("ok")
    lock = F.when(m("locked") >= 1, "ok").otherwise("bad")
    without = F.when(~held, "nosample").when(c_bad, "bad").when(c_warn, "warn").otherwise("ok")
    state = F.when(F.size("metrics") == 0, without).when(F.col("rtype") == "probe", probe_status(m)).when(F.col("rtype") == "lock", lock).when(F.col("rtype") == "database", database).when(F.col("rtype") == "lb", balancer).otherwise(machine)
    return resources.select("resource", "rtype", "newest", state.alias("state"))


#: The usual thresholds.
LIMITS = {"cpu_warn": 70, "cpu_bad": 85, "avail_warn": 25, "avail_bad": 15, "response_ms": 2000}
RANK = ("ok", "nosample", "warn", "bad")


def overview(states: DataFrame) -> DataFrame:
    """The worst state of each type."""
    rank = F.array_position(F.array(*map(F.lit, RANK)), F.col("state"))
    return states.groupBy("rtype").agg(F.count("*").alias("resources"), F.element_at(F.array(*map(F.lit, RANK)), F.max(rank).cast("int")).alias("state"))


def overall(states: DataFrame) -> DataFrame:
    """One row: the worst state of all, how many instances, probes and locks are there and well, the database's and balancer's state."""
    some = lambda state: F.bool_or(F.col("state") == state)
    worst = F.when(some("bad"), "bad").when(some("warn"), "warn").when(some("ok"), "ok").otherwise("nosample")
    special = F.col("rtype").isin("database", "lb", "probe", "lock")
    counts = [F.count_if(c & ok).alias(f"{n}_{k}") for n, c in (("instances", ~special), ("probes", F.col("rtype") == "probe"), ("locks", F.col("rtype") == "lock")) for k, ok in (("total", F.lit(True)), ("ok", F.col("state") == "ok"))]
    of = lambda kind: F.coalesce(F.max_by(F.when(F.col("rtype") == kind, F.col("state")), F.when(F.col("rtype") == kind, F.col("resource"))), F.lit("absent"))
    return states.agg(worst.alias("state"), *counts, of("database").alias("database"), of("lb").alias("lb"))


#: States of a container and what they mean; a running one is judged by its health.
CONTAINER_BAD, CONTAINER_HEALTH_WARN = ("missing", "dead", "exited", "removing"), ("starting", "unknown")


def container_status(state: Column, health: Column) -> Column:
    """ok, warn or bad of a container; unknown or missing words are a warning."""
    state, health = F.lower(F.trim(F.coalesce(state, F.lit("")))), F.lower(F.trim(F.coalesce(health, F.lit(""))))
    known = F.when(health.isin("none", "starting", "healthy", "unhealthy"), health).otherwise("unknown")
    running = F.when(known == "unhealthy", "bad").when(known.isin(*CONTAINER_HEALTH_WARN), "warn").otherwise("ok")
    return F.when(state.isin(*CONTAINER_BAD), "bad").when(state == "running", running).otherwise("warn")


def recent_alerts(alerts: DataFrame, excluded: list[str] = (), prefix: str = "infra_", most: int = 20) -> DataFrame:  # type: ignore[assignment]
    """The latest alerts of a kind's prefix, newest first: of the ``most`` latest those whose target is not excluded.

    One whose kind ends with _FAILED is a warning and loses that ending, others are bad.
    """
    rows = alerts.where(F.col("kind").startswith(prefix)).orderBy(F.desc("ts"), F.desc("id")).limit(most)
    rows = rows.where(~F.col("target").isin(*excluded)) if excluded else rows
    failed = F.col("kind").endswith("_FAILED")
    return rows.select("ts", F.regexp_replace("kind", "_FAILED$", "").alias("kind"), "target", "detail", F.when(failed, "warn").otherwise("bad").alias("status"))
