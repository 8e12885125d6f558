"""Today's usage so far: finalised hours and what the cumulative counters say beyond them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def anchors(watermarks: DataFrame, finalized: int, window: int = 900) -> DataFrame:
    """(user_id, anchor_quota): the first counter reading from the finalised moment to the window's last second; where there is a column ``exists``, of users that still do."""
    inside = watermarks.where(F.col("captured_at").between(finalized, finalized + window))
    inside = inside.where("exists") if "exists" in watermarks.columns else inside
    return inside.groupBy("user_id").agg(F.min_by("used_quota", "captured_at").alias("anchor_quota"))


def project(hour_facts: DataFrame, watermarks: DataFrame, members: DataFrame, day_start: int, finalized: int) -> DataFrame:
    """(user_id, quota) by the counters alone: nothing at all if any member lacks an anchor or its counter went back.

    ``live`` also asks for the members' states and the readings' ages.
    """
    today = hour_facts.where((F.col("hour_ts") >= day_start) & (F.col("hour_ts") < finalized)).groupBy("user_id").agg(F.sum(F.col("consume_quota") - F.col("refund_quota")).alias("finalised"))
    now = watermarks.groupBy("user_id").agg(F.max_by("used_quota", "captured_at").alias("now_quota"))
    rows = members.select("user_id").distinct().join(anchors(watermarks, finalized), "user_id", "left").join(now, "user_id", "left").join(today, "user_id", "left")
    delta = F.col("now_quota") - F.col("anchor_quota")
    rows = rows.select("user_id", (F.coalesce("finalised", F.lit(0)) + delta).alias("quota"), F.coalesce(delta >= 0, F.lit(False)).alias("valid"))
    gate = rows.agg(F.bool_and("valid").alias("all_valid"))
    return rows.crossJoin(F.broadcast(gate)).where("all_valid").select("user_id", "quota")


@dataclass(frozen=True)
class Standing:
    """What published facts of a member must be of, and how old readings may be."""

    epoch: str
    classification: int = 5
    semantics: int = 1
    most_age: int = 1800
    anchor_window: int = 900
    ahead: int = 60


#: Fixed value: the name under which usage is shown that no hour fact can be told of yet.
UNASSIGNED = "实时待归类"


def _sound_member(need: Standing, day_start: int) -> Column:
    """Facts published and proven up to today, by the versions and epoch that are asked for; p is the publication, s the state."""
    p, s = (lambda c: F.col(f"p.{c}")), (lambda c: F.col(f"s.{c}"))
    same = (p("source_epoch") == need.epoch) & (p("classification_version") == need.classification) & (p("query_semantics_version") == need.semantics)
    for c in ("source_epoch", "classification_version", "query_semantics_version", "source_floor_hour"):
        same &= s(c) == p(c)
    revision = (p("tracked_revision") == s("tracked_revision")) | (p("tracked_revision") == 0) & (s("tracked_revision") == 1)
    shown = (p("published_at") > 0) & (p("source_floor_hour") > 0) & s("active")
    proven = s("source_history_status").isin("complete_hot", "no_history") & (s("coverage_status") == "ready") & (s("verification_status") == "complete") & (s("coverage_through_hour") >= day_start)
    return same & revision & shown & proven


def live(members: DataFrame, published: DataFrame, states: DataFrame, snapshots: DataFrame, watermarks: DataFrame, hour_facts: DataFrame, day_start: int, finalized: int, now: int, need: Standing) -> DataFrame:
    """(group_id, user_id, today_net, through): today's usage of all members of each group, or nothing of the group.

    Finalised hours of today, and what the cumulative counter says beyond the reading next after them. A group is told only if
    every member's facts are published and proven, its counter was read lately and after its anchor, and has not gone back; a
    member without history must have an unused counter. ``through`` is the oldest reading of the group. Tables have one
    row a user, ``members`` one a group and user.
    """
    members = members.where("user_id > 0").select("group_id", "user_id").distinct()
    rows = members
    tables = {"p": published, "s": states, "n": snapshots}
    for name, table in tables.items():
        rows = rows.join(table.select("user_id", F.struct(*(c for c in table.columns if c != "user_id")).alias(name)), "user_id", "left")
    inside = watermarks.where(F.col("captured_at").between(finalized, finalized + need.anchor_window) & F.col("exists"))
    rows = rows.join(inside.groupBy("user_id").agg(F.min_by(F.struct("captured_at", "used_quota"), "captured_at").alias("a")), "user_id", "left")
    today = hour_facts.where((F.col("hour_ts") >= day_start) & (F.col("hour_ts") < finalized))
    rows = rows.join(today.groupBy("user_id").agg(F.sum(F.col("consume_quota") - F.col("refund_quota")).alias("finalised")), "user_id", "left")
    read, delta = F.col("n.captured_at"), F.col("n.used_quota") - F.col("a.used_quota")
    fresh = F.col("n.exists") & read.between(now - need.most_age, now + need.ahead) & (read >= F.col("a.captured_at"))
    unused = (F.col("s.source_history_status") != "no_history") | (F.col("n.used_quota") == 0)
    in_time = F.lit(day_start <= finalized <= now + 3600)
    sound = F.coalesce(in_time & _sound_member(need, day_start) & fresh & unused & (delta >= 0), F.lit(False))
    rows = rows.select("group_id", "user_id", sound.alias("sound"), read.alias("read"), (F.coalesce("finalised", F.lit(0)) + delta).alias("today_net"))
    gate = rows.groupBy("group_id").agg(F.bool_and("sound").alias("all_sound"), F.least(F.min("read"), F.lit(now)).alias("through"))
    return rows.join(gate.where(F.col("all_sound") & (F.col("through") > finalized)).select("group_id", "through"), "group_id").select("group_id", "user_id", "today_net", "through")


def on_matrix(cells: DataFrame, told: DataFrame, day_start: int) -> DataFrame:
    """(group_id, user_id, date_ts, consume_quota, refund_quota, through) of a matrix with today raised to what ``live`` told.

    What is beyond the facts counts as consumption. A group where any member's facts are ahead of its counter stays as it is
    (``through`` null), so no cell ever falls. A member without a cell today gets one unless nothing was used.
    """
    today = cells.where(F.col("date_ts") == day_start).select("group_id", "user_id", (F.col("consume_quota") - F.col("refund_quota")).alias("net"))
    rows = told.join(today, ["group_id", "user_id"], "left").withColumn("delta", F.col("today_net") - F.coalesce("net", F.lit(0)))
    ok = rows.groupBy("group_id").agg(F.bool_and(F.col("net").isNull() | (F.col("delta") >= 0)).alias("ok")).where("ok").select("group_id")
    rows = rows.join(ok, "group_id").where("net is not null or today_net <> 0").select("group_id", "user_id", F.lit(day_start).cast("long").alias("date_ts"), "delta", "through")
    out = cells.select("group_id", "user_id", "date_ts", "consume_quota", "refund_quota").join(rows, ["group_id", "user_id", "date_ts"], "full")
    return out.select("group_id", "user_id", "date_ts", (F.coalesce("consume_quota", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("consume_quota"), F.coalesce("refund_quota", F.lit(0)).alias("refund_quota"), "through")


def on_days(days: DataFrame, told: DataFrame, day_start: int) -> tuple[DataFrame, DataFrame]:
    """A group's days (group_id, date_ts, consume_quota, refund_quota) with today raised to the sum of its members, and the rows
    (group_id, key, consume_quota) that its lists by group and by model get for what has been added.

    A group whose facts of today are ahead of the sum stays as it is; it gets no row, nor does one without a difference.
    """
    whole = told.groupBy("group_id").agg(F.sum("today_net").alias("target"), F.min("through").alias("through"))
    today = days.where(F.col("date_ts") == day_start).select("group_id", (F.col("consume_quota") - F.col("refund_quota")).alias("net"))
    rows = whole.join(today, "group_id", "left").withColumn("delta", F.col("target") - F.coalesce("net", F.lit(0))).where("delta >= 0")
    added = rows.where("net is not null or delta > 0").select("group_id", F.lit(day_start).cast("long").alias("date_ts"), "delta", "through")
    out = days.select("group_id", "date_ts", "consume_quota", "refund_quota").join(added, ["group_id", "date_ts"], "full")
    out = out.select("group_id", "date_ts", (F.coalesce("consume_quota", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("consume_quota"), F.coalesce("refund_quota", F.lit(0)).alias("refund_quota"), "through")
    return out, added.where("delta > 0").select("group_id", F.lit(UNASSIGNED).alias("key"), F.col("delta").alias("consume_quota"))
