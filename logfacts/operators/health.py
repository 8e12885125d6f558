"""Whether the pipeline itself is well: ages and lags of its samplers, pending minutes, migration, edge sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.operators import edge

#: Seconds until a problem minute is final, and the bounds of the seconds between two problem samples.
PROBLEM_DELAY, LEAST_EVERY, USUAL_EVERY, MOST_EVERY = 600, 60, 300, 3600
#: States of the migration that are no reason to worry.
SETTLED = ("complete", "not_required", "disabled")


def problem_every(seconds: int) -> int:
    return USUAL_EVERY if seconds < LEAST_EVERY else min(seconds, MOST_EVERY)


def pending_minutes(states: DataFrame, now: int, every: int = USUAL_EVERY, version: int = 5) -> DataFrame:
    """(pending): minutes of the live window that were begun and are not complete."""
    until = (now - PROBLEM_DELAY) // 60 * 60
    inside = (F.col("bucket_ts") >= until - 2 * problem_every(every) - 120) & (F.col("bucket_ts") < until) & (F.col("traffic_class_version") == version)
    return states.where(inside & ~F.col("complete")).agg(F.count("*").alias("pending"))


def sources(states: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Health of every allowed node; one that never reported is bad, others are left out."""
    known = edge.source_health(states, now)
    rows = nodes.select("node").distinct().join(known, "node", "left")
    return rows.select("node", F.coalesce("age", F.lit(-1)).alias("age"), F.coalesce("state", F.lit("bad")).alias("state"), F.coalesce("reasons", F.lit("source_missing")).alias("reasons"))


def source_summary(health: DataFrame) -> DataFrame:
    """(sources, unhealthy, lagging, large_backlog, lossy): how many nodes have which trouble; one row."""
    has = lambda *names: F.arrays_overlap(F.split("reasons", ","), F.array(*map(F.lit, names)))
    return health.agg(
        F.count("*").alias("sources"), F.count_if(F.col("state") != "ok").alias("unhealthy"), F.count_if(has("event_lag_with_backlog")).alias("lagging"),
        F.count_if(has("backlog_large")).alias("large_backlog"), F.count_if(has("recent_cursor_discontinuity", "recent_discarded_lines")).alias("lossy"))


def judged(gauges: DataFrame, now: int, sample_seconds: int = 60, problem_seconds: int = USUAL_EVERY, stability: bool = True, edges: bool = True) -> DataFrame:
    """Gauges with ages, lag, ``status`` (ok or degraded) and all ``reasons`` for it.

    Columns: main_last_success, problem_last_success, problem_last_failure, coverage_to, target_to (times, 0 or null is
    never), pending, migration, and of the edge: sources, expected, unhealthy. Gauges of several sites may be rows.
    """
    t = lambda c: F.coalesce(c, F.lit(0))
    age = lambda c: F.when(t(c) > 0, F.greatest(F.lit(now) - F.col(c), F.lit(0))).otherwise(0).cast("long")
    main_age, problem_age, lag = age("main_last_success"), age("problem_last_success"), F.greatest(t("target_to") - t("coverage_to"), F.lit(0)).cast("long")
    most_main, most_problem = max(3 * sample_seconds, 180), 3 * problem_every(problem_seconds) + 120
    found = {
        "main_never": t("main_last_success") == 0, "main_stale": main_age > most_main, "minutes_pending": t("pending") > 0, "problem_failed": t("problem_last_failure") > t("problem_last_success"),
        "problem_never": (t("problem_last_success") == 0) | (t("coverage_to") == 0) if stability else F.lit(False), "problem_stale": (problem_age > most_problem) & F.lit(stability), "problem_lag": (lag > most_problem) & F.lit(stability),
        "migration_open": ~F.coalesce(F.col("migration").isin(*SETTLED), F.lit(False)), "sources_missing": (t("sources") != t("expected")) & F.lit(edges), "sources_unhealthy": (t("unhealthy") > 0) & F.lit(edges),
    }
    reasons = F.array_compact(F.array(*(F.when(c, name) for name, c in found.items())))
    return gauges.withColumns({"main_age": main_age, "problem_age": problem_age, "problem_lag": lag, "reasons": F.array_join(reasons, ","), "status": F.when(F.size(reasons) > 0, "degraded").otherwise("ok")})
