"""Near-duplicate documents: a signature-coordinate inverted join, confirmed on full shingle sets.

Each document's set of distinct word shingles gives a MinHash signature. Documents are posted under each
(coordinate, value) of it. A pair that agrees in at least ``matches`` coordinates also agrees in one of the
first m - matches + 1 of either side's m shared postings, in order of rarity, so only that prefix is joined; postings
that one document alone holds are skipped before that. Pairs are kept if their postings collide often enough, and then
if the full sets are similar enough.

Documents with equal sets are one class, and a class takes part once. In a few rounds every class is first tried
against one other of each of its posting lists: the one whose postings are the most common (in a group of near copies
that is the one that the others derive from), then the smallest, then one by chance. Lists that are a single cluster
after that produce no further pairs. Of the others, classes that were tried against the same one are compared with
each other in blocks, each pair of blocks a task of bounded size that gives out links only; pairs beyond that come from
the posting lists, across clusters alone. So a group of copies never turns into all of its pairs, while a link between
any two clusters is found as before.

Rows: a null id is left out; a null or blank text has an empty set and no links; repeated rows are linked with each
other; other columns are ignored. With matches = 70 of 128 coordinates a pair of similarity 0.75 is missed with a
chance of about 1e-7, and no pair below the threshold is ever linked, as links are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfacts.llm import kernels as K
from logfacts.llm.shared import cut

_ODD = K.mix(np.arange(1, 65, dtype=np.uint64)) | K.U64(1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; a shorter text has one, a blank one none."""
    hashes, _, text = K.words(data, starts)
    counts = np.bincount(text, minlength=len(starts) - 1)
    ends = np.cumsum(counts)
    full = max(0, len(hashes) - size + 1)
    rolled = np.full(full, size, dtype=np.uint64)
    for i in range(size):
        rolled += hashes[i : full + i] * _ODD[i]
    rolled = K.mix(rolled)
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= size:
            yield np.unique(rolled[end - n : end - size + 1])
        else:
            few = hashes[end - n : end]
            yield K.mix((few * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + K.U64(n)) if n else few


def _coordinates(values: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(multipliers), 0xFFFFFFFF, dtype=np.uint64)
    for i in range(0, len(values), 4096):
        least = np.minimum(least, ((values[i : i + 4096, None] * multipliers + offsets) >> K.U64(32)).min(axis=0))
    return least.astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """(id, text) to (id, n, key, sig): set size, 128-bit hash of the whole set, MinHash coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = K.mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | K.U64(1)
        offsets = K.mix(np.arange(101, coordinates + 101, dtype=np.uint64))
        for batch in batches:
            data, starts = K.text_bytes(batch.column("text"))
            n, key, sig = [], [], []
            for a, b in K.slices(starts):
                for values in shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], size):
                    n.append(len(values))
                    key.append(np.array([K.mix(values).sum(dtype=np.uint64), K.mix(~values).sum(dtype=np.uint64)]).tobytes())
                    sig.append(_coordinates(values, multipliers, offsets) if len(values) else np.zeros(coordinates, np.int32))
            flat = np.concatenate(sig) if sig else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * coordinates), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), lists], ["id", "n", "key", "sig"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, key binary, sig array<int>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, text) to (id, items): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = K.text_bytes(batch.column("text"))
            for a, b in K.slices(starts):
                sets = list(shingle_sets(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a], size))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), lists], ["id", "items"])

    return docs.select("id", "text").mapInArrow(run, "id long, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable, for every id that has a link.

    Each round a vertex takes the smallest label among its neighbours and then that label's own label, until nothing changes.
    """
    edges = edges.where("a <> b")
    edges = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("component").alias("before"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("next"))
        stepped = cut(hooked.join(jump, "to").select("id", F.least("to", "next").alias("component"), (F.least("to", "next") != F.col("before")).alias("moved")))
        labels = stepped.select("id", "component")
        if stepped.where("moved").limit(1).count() == 0:
            return labels


def _may_reach(n: Column, m: Column, percent: int) -> Column:
    """No two sets of these sizes are more similar than the smaller one's size over the larger one's."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (a, b) those whose full sets are similar enough."""
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b")


def _common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with all of the other, a slice of the shared items at a time."""
    flat = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(v) for v in s])) for s in (x, y)]
    shared = np.intersect1d(*(items for items, _ in flat))
    total = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(shared), 4096):
        part = shared[a : a + 4096]
        grids = []
        for (items, owner), size in zip(flat, (len(x), len(y)), strict=True):
            at = np.minimum(np.searchsorted(part, items), len(part) - 1)
            hit = part[at] == items
            grid = np.zeros((size, len(part)), np.float32)
            grid[owner[hit], at[hit]] = 1
            grids.append(grid)
        total += grids[0] @ grids[1].T
    return total.astype(np.int64)


def _within_groups(rows: DataFrame, sets: DataFrame, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) between rows of one group with different labels: (group, id, label), compared in pairs of blocks."""
    sizes = rows.groupBy("group").agg(F.count("*").alias("held"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    rows = rows.join(sizes.select("group", F.ceil(F.col("held") / block).alias("blocks")), "group")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.join(sets, "id").select("group", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "label", "items")

    def run(table: pa.Table) -> pa.Table:
        ids, labels, mine = (table.column(c).to_numpy() for c in ("id", "label", "mine"))
        items = [np.asarray(v.values) for v in table.column("items")]
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if len(left) and len(right):
            i = _common([items[k] for k in left], [items[k] for k in right])
            n = np.array([len(v) for v in items])
            linked = (100 * i >= percent * (n[left][:, None] + n[right] - i)) & (labels[left][:, None] != labels[right])
            x, y = np.nonzero(linked)
            a, b = ids[left[x]], ids[right[y]]
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("group", "lo", "hi").applyInArrow(run, "a long, b long")


def _across(rows: DataFrame, groups: list[str], matches: int, percent: int, block: int = 2048) -> DataFrame:
    """Pairs (a, b) of one posting list with different labels and groups whose coordinates collide often enough.

    A list's largest cluster is not compared with itself. Lists are compared in pairs of blocks, and a task gives out
    the pairs that pass, each pair in the list of the first coordinate that is in both prefixes. ``sig`` are all
    coordinates of a row, ``coords`` the numbers of those in its prefix.
    """
    clusters = rows.groupBy("post", "label").agg(F.count("*").alias("held"))
    mixed = clusters.groupBy("post").agg(F.max_by("label", F.struct("held", "label")).alias("main"), F.count("*").alias("labels"), F.sum("held").alias("held")).where("labels > 1")
    rows = rows.join(mixed.select("post", "main", F.ceil(F.col("held") / block).alias("blocks")), "post")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("post", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "id", "n", "label", (F.col("label") != F.col("main")).alias("odd"), *groups, "sig", "coords")

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_numpy() for c in ("mine", "id", "n", "label", "odd", *groups)}
        sig = np.stack([np.asarray(v.values) for v in table.column("sig")])
        prefix = np.zeros(sig.shape, bool)
        for i, v in enumerate(table.column("coords")):
            prefix[i, np.asarray(v.values)] = True
        here = table.column("post")[0].as_py() >> 32
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        n, label, mine = columns["n"], columns["label"], columns["mine"]
        a, b = [], []
        for i in np.flatnonzero(columns["odd"]).tolist():
            open_ = (label != label[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])) & (~columns["odd"] | (columns["id"] < columns["id"][i]))
            open_ &= (mine != mine[i]) | (lo == hi)
            for g in groups:
                open_ &= columns[g] != columns[g][i]
            at = np.flatnonzero(open_)
            if len(at):
                same = sig[at] == sig[i]
                hit = at[(same.sum(axis=1) >= matches) & ((same & prefix[at] & prefix[i]).argmax(axis=1) == here)]
                b += columns["id"][hit].tolist()
                a += [int(columns["id"][i])] * len(hit)
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return rows.groupBy("post", "lo", "hi").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, coordinates: int = 128, matches: int = 70, rounds: int = 3) -> DataFrame:
    """(id, n, component): for each document its set's size and the smallest id reachable over links."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    marks = cut(signatures(source, size, coordinates))
    classes = cut(marks.where("n > 0").groupBy("key").agg(F.min_by(F.struct("id", "n", "sig"), "id").alias("r")).select("key", "r.*"))

    posted = classes.select("id", "n", F.posexplode("sig").alias("c", "v"))
    posted = posted.select("id", "n", F.expr("shiftleft(cast(c as bigint), 32) | (v & 4294967295L)").alias("post"))
    shared = posted.groupBy("post").agg(F.count("*").alias("held")).where("held > 1")
    lists = posted.join(shared, "post").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "post"))).alias("posts"), F.sum("held").alias("weight"))
    lists = cut(lists.where(F.size("posts") >= matches).select("id", "n", "weight", F.col("posts.post").alias("posts")))
    prefix = cut(lists.select("id", "n", "weight", F.explode(F.slice("posts", F.lit(1), F.size("posts") - matches + 1)).alias("post")))
    sets = cut(full_sets(source.join(lists.select("id"), "id", "left_semi"), size))

    def merged(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after joining the clusters of linked (a, b)."""
        of = [labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
        joined = components(pairs.join(of[0], "a").join(of[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        return cut(labels.join(joined.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("component", "label").alias("label")))

    labels, links = lists.select("id", F.col("id").alias("label")), []
    for turn in range(rounds):
        members = cut(prefix.join(labels, "id"))
        choice = [F.struct("weight", -F.col("id")), F.struct(-F.col("id")), F.struct(F.xxhash64("id", F.lit(turn)))][min(turn, 2)]
        heads = members.groupBy("post").agg(F.max_by(F.struct("id", "n", "label"), choice).alias("head"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("post", "head")
        star = members.join(heads, "post").where(F.col("id") != F.col("head.id"))
        star = star.groupBy(F.col("head.id").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("hits"), F.any_value((F.col("label") != F.col("head.label")) & _may_reach(F.col("n"), F.col("head.n"), percent)).alias("open"))
        best = cut(star.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("hub"), F.max_by(F.struct("a", "open"), F.struct("open", "hits", -F.col("a"))).alias("try")))
        tried = best.where("try.open").select("try.a", "b")
        links.append(cut(_confirmed(tried, sets, percent)))
        labels = merged(labels, links[-1])
        group = f"group{turn}"
        hubs = best.select(F.col("hub").alias("id")).distinct()
        of_hub = hubs.withColumn(group, F.col("id")).union(best.join(hubs.withColumnRenamed("id", "b"), "b", "left_anti").select("b", "hub"))
        prefix = prefix.join(of_hub, "id", "left").withColumn(group, F.coalesce(group, "id"))
        links.append(cut(_within_groups(labels.join(of_hub, "id").withColumnRenamed(group, "group"), sets, percent)))
        labels = merged(labels, links[-1])
    members = cut(prefix.join(labels, "id"))
    groups = [f"group{turn}" for turn in range(rounds)]
    coords = lists.select("id", F.transform(F.slice("posts", F.lit(1), F.size("posts") - matches + 1), lambda p: F.shiftright(p, 32).cast("int")).alias("coords"))
    across = cut(_across(members.join(coords.join(classes.select("id", "sig"), "id"), "id"), groups, matches, percent))
    links = reduce(DataFrame.union, [*links, _confirmed(across, sets, percent)])

    reached = classes.select("key", F.col("id").alias("rep")).join(components(links).withColumnRenamed("id", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component"))
    whole = marks.where("n > 0").select("id", "n", "key").join(reached, "key").select("id", "n", "component")
    return whole.union(marks.where("n = 0").select("id", "n", F.col("id").alias("component")))


def op4(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
