"""Coverage and integrity: gaps, proofs, controls, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfacts.functions import scalars as S


def missing_hours(present: DataFrame, since: int, until: int) -> DataFrame:
    hours = present.sparkSession.range(since, until, 3600).withColumnRenamed("id", "hour_ts")
    return hours.join(present.select("hour_ts").distinct(), "hour_ts", "left_anti")


def missing_ranges(present: DataFrame, since: int, until: int, most_hours: int = 12) -> DataFrame:
    """Gaps as half-open ranges of at most so many hours, newest first."""
    edges = present.sparkSession.range(since - 3600, until + 1, until - since + 3600).withColumnRenamed("id", "hour_ts")
    hours = present.where((F.col("hour_ts") >= since) & (F.col("hour_ts") < until)).select("hour_ts").union(edges).distinct()
    start = F.lag("hour_ts").over(Window.orderBy("hour_ts")) + 3600  # one row per hour of the range
    gaps = hours.withColumn("start", start).where("start < hour_ts")
    rows = gaps.select(F.explode(F.sequence(F.col("start"), F.col("hour_ts") - 3600, F.lit(3600 * most_hours).cast("long"))).alias("from_ts"), "hour_ts")
    return rows.select("from_ts", F.least(F.col("from_ts") + 3600 * most_hours, "hour_ts").alias("to_ts")).orderBy(F.desc("from_ts"))


#: Hours that one word of bits takes.
_HOURS_A_WORD = 62


def hour_words(proofs: DataFrame, since: int = 0) -> DataFrame:
    """(user_id, word, bits): the hours from ``since`` on as bits of words, so a task keeps one row for many proofs and copies of one add nothing."""
    n = S.div(F.col("hour_ts") - since, 3600)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(_HOURS_A_WORD)).cast("int"))
    return proofs.groupBy("user_id", S.div(n, _HOURS_A_WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _inside(proofs: DataFrame, since: int, until: int | None = None) -> DataFrame:
    rows = proofs.where((F.col("hour_ts") >= since) & (F.pmod(F.col("hour_ts") - since, F.lit(3600)) == 0))
    return rows if until is None else rows.where(F.col("hour_ts") < until)


def contiguous(proofs: DataFrame, since: int) -> DataFrame:
    """(user_id, through): how far each member's hours are proven without a gap from the start on."""
    bits = F.col("bits")
    lowest = F.bit_count(F.bitwise_not(bits).bitwiseAND(bits + 1) - 1)  # the ones below the lowest zero
    full = F.when(F.col("lowest") == _HOURS_A_WORD, 1).otherwise(0)
    before = F.coalesce(F.sum(full).over(Window.partitionBy("user_id").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = hour_words(_inside(proofs, since), since).withColumn("lowest", lowest).withColumn("before", before)
    reached = rows.where((F.col("before") == F.col("word")) & (F.col("lowest") > 0))  # all words before are there and full
    return reached.groupBy("user_id").agg((F.max(F.col("word") * _HOURS_A_WORD + F.col("lowest")) * 3600 + since).alias("through"))


def first_gap(proofs: DataFrame, since: int, until: int) -> DataFrame:
    """(user_id, gap): the first hour of the range that a member lacks; null if none."""
    members = proofs.select("user_id").distinct()
    through = contiguous(proofs.where(F.col("hour_ts") < until), since)
    return members.join(through, "user_id", "left").select("user_id", F.coalesce("through", F.lit(since)).alias("gap")).withColumn("gap", F.when(F.col("gap") < until, F.col("gap")))


def day_ready(proofs: DataFrame, members: DataFrame, date_ts: int) -> DataFrame:
    """(user_id, hours, ready): whether all 24 hours of a business day are proven."""
    seen = hour_words(_inside(proofs, date_ts, date_ts + S.DAY), date_ts).select("user_id", F.bit_count("bits").alias("seen"))
    hours = F.coalesce("seen", F.lit(0)).cast("long")
    return members.select("user_id").distinct().join(seen, "user_id", "left").select("user_id", hours.alias("hours"), (hours == 24).alias("ready"))


def digests(facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Digests of groups that do not depend on the order of rows."""
    return facts.groupBy(*keys).agg(S.digest(*columns).alias("digest"))


def event_pages(events: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Digest of raw events per key (of a member and page, say): count, xor and sum of their hashes, nulls unlike blanks."""
    text = F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")  # 60 bits
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.bit_xor(h).alias("mixed"), F.sum(h.cast("decimal(38,0)")).alias("added"))


def fold_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Pages to wholes. Any page may be read again in place of its former digest, so a broken-off reading goes on where it was."""
    return pages.groupBy(*keys).agg(F.sum("events").alias("events"), F.bit_xor("mixed").alias("mixed"), F.sum("added").cast("decimal(38,0)").alias("added"))


def agreed(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agreed): whether two independent readings gave the same digest; a key that one of them lacks is not agreed."""
    d = F.struct("events", "mixed", "added")
    rows = first.select(*keys, d.alias("a")).join(second.select(*keys, d.alias("b")), keys, "full")
    return rows.select(*keys, F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("agreed"))


def uncovered_members(published: DataFrame, day_facts: DataFrame, day_proofs: DataFrame, date_ts: int) -> DataFrame:
    """Published members that have neither a fact nor a proof of a day."""
    rows = published.select("user_id").distinct()
    for other in (day_facts, day_proofs):
        rows = rows.join(other.where(F.col("date_ts") == date_ts).select("user_id").distinct(), "user_id", "left_anti")
    return rows


def source_floor(users: DataFrame, first_logs: DataFrame) -> DataFrame:
    """The start of the business day of registration or first log, whichever is earlier."""
    rows = users.select("user_id", "registered").join(first_logs.select("user_id", "first_log"), "user_id", "left")
    return rows.withColumn("first", F.least("registered", "first_log")).select("user_id", S.day("first").alias("floor"))


def prunable(hour_facts: DataFrame, day_proofs: DataFrame, active_ranges: DataFrame) -> DataFrame:
    """Hour facts that a day proof stands for and no active job covers."""
    rows = hour_facts.withColumn("date_ts", S.day("hour_ts")).join(day_proofs.select("user_id", "date_ts"), ["user_id", "date_ts"], "left_semi")
    held = (active_ranges["user"] == rows["user_id"]) & (rows["hour_ts"] >= active_ranges["from_ts"]) & (rows["hour_ts"] < active_ranges["to_ts"])
    return rows.join(active_ranges, held, "left_anti")


#: Days in the blocks by which gaps that go on over several days are closed.
_DAYS_A_YEAR = 366


def uncovered_ranges(complete: DataFrame, since: int, until: int, time: str = "bucket_ts", step: int = 60) -> DataFrame:
    """(from_ts, to_ts): what of [since, until) no complete bucket covers, as whole ranges, oldest first.

    A gap opens after a bucket whose next one is missing and closes at one whose former one is missing, both found by anti
    joins. Opening and closing are brought together within a day; a gap that goes on closes at the first closing of a
    later day, of which each day and each year keeps its first. So windows are over the buckets of a day, the days
    of a year, and the years, never over all buckets.
    """
    at = complete.where((F.col(time) >= since) & (F.col(time) < until) & (F.pmod(F.col(time) - since, F.lit(step)) == 0)).select(F.col(time).cast("long").alias("at")).distinct()
    edges = at.sparkSession.createDataFrame([(since - step,), (until,)], "at long")
    at = at.union(edges)
    opens = at.where(F.col("at") < until).withColumn("at", F.col("at") + step).join(at, "at", "left_anti").withColumn("open", F.lit(True))
    closes = at.where(F.col("at") >= since).withColumn("before", F.col("at") - step).join(at.withColumnRenamed("at", "before"), "before", "left_anti").select("at").withColumn("open", F.lit(False))
    day = F.floor((F.col("at") - since) / S.DAY)
    marks = opens.union(closes).withColumns({"day": day, "year": F.floor(day / _DAYS_A_YEAR)})
    w = Window.partitionBy("year", "day").orderBy("at")
    paired = marks.withColumn("next", F.lead("at").over(w)).where("open")
    days = marks.groupBy("year", "day").agg(F.min(F.when(~F.col("open"), F.col("at"))).alias("first"))
    later_day = F.min("first").over(Window.partitionBy("year").orderBy("day").rowsBetween(1, Window.unboundedFollowing))
    years = days.groupBy("year").agg(F.min("first").alias("first_of_year"))
    later_year = F.min("first_of_year").over(Window.partitionBy(F.floor(F.col("year") / 1000)).orderBy("year").rowsBetween(1, Window.unboundedFollowing))
    days = days.withColumn("later_day", later_day).drop("first")
    rows = paired.join(days, ["year", "day"]).join(years.withColumn("later_year", later_year).drop("first_of_year"), "year")
    return rows.select(F.col("at").alias("from_ts"), F.coalesce("next", "later_day", "later_year").alias("to_ts")).orderBy("from_ts")


def next_uncovered(complete: DataFrame, since: int, until: int | None = None, time: str = "bucket_ts", step: int = 60) -> DataFrame:
    """(from_ts, to_ts): the oldest of the uncovered ranges, what a backfill does next; no row if all is covered.

    Without ``until`` the range has no end: then there always is one, and its ``to_ts`` is null if no bucket follows.
    """
    at = complete.where((F.col(time) >= since) & (F.pmod(F.col(time) - since, F.lit(step)) == 0)).select(F.col(time).cast("long").alias("at"))
    at = (at if until is None else at.where(F.col("at") < until)).distinct()
    at = at.union(at.sparkSession.createDataFrame([(since - step,)], "at long"))
    opens = at.withColumn("at", F.col("at") + step).join(at, "at", "left_anti").agg(F.min("at").alias("from_ts"))
    end = F.lit(until).cast("long")
    rows = at.crossJoin(F.broadcast(opens)).groupBy("from_ts").agg(F.coalesce(F.min(F.when(F.col("at") > F.col("from_ts"), F.col("at"))), end).alias("to_ts"))  # opens is one row
    return rows if until is None else rows.where(F.col("from_ts") < until)


def controls_from_hours(states: DataFrame, epoch: str, measures: list[str]) -> DataFrame:
    """Control totals of member-days from the proven hours of one source epoch; ``hours`` is how many of the 24 there are."""
    proven = states.where((F.col("status") == "complete") & (F.col("source_epoch") == epoch) & (F.col("content_hash") != ""))
    sums = [F.sum(m).alias(m) for m in measures]
    return proven.groupBy("user_id", S.day("hour_ts").alias("date_ts")).agg(F.countDistinct("hour_ts").alias("hours"), F.count("*").alias("states"), *sums)


def unreconciled_days(facts: DataFrame, controls: DataFrame, members: DataFrame, since: int, until: int, measures: list[str], from_hours: bool = False) -> DataFrame:
    """(user_id, date_ts, reason) of every member-day of the range whose facts and control do not agree.

    All days of all members are looked at. A day without a control has one of zero, unless controls come from hours
    (``controls_from_hours``): then it is 'no control', as is one that lacks hours or has some twice. Other reasons, in
    this order: 'unknown member' (facts or a control of no member), 'source rows' (not requests and refunds together),
    'totals'. Facts and controls have ``measures``; controls have ``source_rows`` too.
    """
    inside = lambda df: df.where((F.col("date_ts") >= since) & (F.col("date_ts") < until))
    days = F.broadcast(facts.sparkSession.range(since, until, S.DAY).withColumnRenamed("id", "date_ts"))  # one row a day
    known = members.select("user_id").distinct()
    calendar = known.crossJoin(days).withColumn("known", F.lit(True))
    mine = inside(facts).groupBy("user_id", "date_ts").agg(*(F.sum(m).alias(f"f_{m}") for m in measures))
    held = [c for c in ("hours", "states") if c in controls.columns]
    theirs = inside(controls).select("user_id", "date_ts", "source_rows", *held, *(F.col(m).alias(f"c_{m}") for m in measures), F.lit(True).alias("told"))
    rows = calendar.join(mine, ["user_id", "date_ts"], "full").join(theirs, ["user_id", "date_ts"], "full").fillna(0, ["source_rows", *(f"{s}_{m}" for s in "fc" for m in measures)])
    unequal = F.lit(False)
    for m in measures:
        unequal |= F.col(f"f_{m}") != F.col(f"c_{m}")
    incomplete = F.col("told").isNull() | (F.col("hours") != 24) | (F.col("states") != 24) if held else F.col("told").isNull()
    reason = F.when(F.col("known").isNull(), "unknown member")
    reason = reason.when(incomplete, "no control") if from_hours else reason
    reason = reason.when(F.col("source_rows") != F.col("c_requests") + F.col("c_refund_records"), "source rows").when(unequal, "totals")
    return rows.select("user_id", "date_ts", reason.alias("reason")).where("reason is not null")


def fact_digests(facts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, rows, digest): SHA-256 digests of sets of facts that any engine can make again.

    A row's SHA-256 counts by its first 60 bits; a group's digest is over the number, the xor and the sum of these, so
    neither the order of rows nor an even number of copies goes unseen, and no list of rows is made.
    """
    pages = event_pages(facts, keys, columns)
    return pages.select(*keys, F.col("events").alias("rows"), F.sha2(F.concat_ws(":", F.col("events").cast("string"), F.col("mixed").cast("string"), F.col("added").cast("decimal(38,0)").cast("string")), 256).alias("digest"))


def facts_in_empty_ranges(facts: DataFrame, empty: DataFrame, time: str = "hour_ts") -> DataFrame:
    """(user_id, first, rows): facts inside ranges (user_id, from_ts, to_ts) that were proven to have none; there must be no row."""
    f = facts.select(F.col("user_id").alias("u"), F.col(time).alias("at"))
    inside = (F.col("u") == F.col("user_id")) & (F.col("at") >= F.col("from_ts")) & (F.col("at") < F.col("to_ts"))
    return f.join(empty.select("user_id", "from_ts", "to_ts"), inside).groupBy("user_id").agg(F.min("at").alias("first"), F.count("*").alias("rows"))


def staleness(coverage: DataFrame, until: int) -> DataFrame:
    """(ready_through, behind, stale) of a range that ends at ``until``."""
    behind = F.greatest(F.lit(until) - F.col("ready_through"), F.lit(0)).cast("long")
    return coverage.select("ready_through", behind.alias("behind"), (behind > 0).alias("stale"))
