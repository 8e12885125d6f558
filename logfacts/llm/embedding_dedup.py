"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within them, one vector of each group kept.

Equal vectors are one class that takes part once, with its number of rows. Centres are fitted on a bounded sample of the
classes; then every class goes to the cell of its nearest centre. A link can also cross cells, so a class visits each
earlier cell that may hold a vector at the threshold's angle from it. Two bounds tell which: the distance to the plane
halfway between both centres, and the angle to the other centre less the widest angle in that cell. Both are
necessary for a link, so no link is lost, whatever the centres are; good centres only save visits.

In a cell the vectors within half the threshold's angle of the centre, its core, are all linked with each other: they are
counted, not compared, so a group of near copies, however large, costs one row each. What a core's widest angle does not
settle for another vector, and all others, are compared in pairs of blocks of at most ``block`` rows, each a task.
A task gives out a row's number of links and one spanning link, never its pairs.

What the driver holds: the sample (``sample`` vectors, 64 MB at most), at most ``most_cells`` centres and a few numbers a
cell. On vectors without any clusters the bounds spare little and the work is that of all pairs, in blocks.

Rows: a null id is left out. Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing.
A shorter vector counts as filled up with zeros. Repeated rows are linked with each other. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.llm.near_dedup import components
from logfacts.llm.shared import cut, drop, join_counted

SAMPLE_BYTES = 64 << 20
#: Angles and distances closer than this to a bound are left to the product.
SLACK = 1e-6


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit vectors, one a row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths, flat = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == size * len(lengths):
        out = flat.reshape(-1, size).copy()
    else:
        out = np.zeros((len(lengths), size))
        out[np.arange(size) < lengths[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def centres(sample: np.ndarray, cells: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means: unit means of the nearest vectors; an empty cell starts again at the vector worst served."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    out = sample[np.random.default_rng(0).permutation(len(sample))[:cells]]
    for _ in range(steps):
        near = sample @ out.T
        home = near.argmax(axis=1)
        mean = np.zeros_like(out)
        np.add.at(mean, home, sample)
        length = np.linalg.norm(mean, axis=1)
        empty = np.flatnonzero(length < 1e-12)
        mean[empty] = sample[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        length[empty] = 1
        out = mean / length[:, None]
    return out


class Cells:
    """What every task knows of the cells: centres and, once counted, each cell's core, rest and visitors."""

    def __init__(self, points: np.ndarray, cosine: float, block: int):
        self.points, self.cosine, self.block, k = points, cosine, block, len(points)
        self.angle, self.reach = math.acos(cosine), math.sqrt(2 - 2 * cosine)
        self.between = np.sqrt(np.maximum(2 - 2 * points @ points.T, 0))
        self.rows, self.weight = np.zeros((2, k), np.int64), np.zeros(k, np.int64)
        self.least, self.widest, self.first = np.full((2, k), np.inf), np.full((2, k), -np.inf), np.zeros(k, np.int64)
        self.visitors, self.extra = np.zeros(k, np.int64), np.zeros(k, np.int64)

    def core(self, angle: np.ndarray) -> np.ndarray:
        return 2 * angle < self.angle - SLACK

    def count(self, found: list) -> None:
        """Takes over (cell, core, held, weight, least, widest, first) of each part of a cell."""
        for r in found:
            part = 0 if r.core else 1
            self.rows[part, r.cell], self.least[part, r.cell], self.widest[part, r.cell] = r.held, r.least, r.widest
            if r.core:
                self.weight[r.cell], self.first[r.cell] = r.weight, r.first

    def related(self, unit: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all rows and cells: whether a row is at home there or visits, is linked with the whole core, may be linked with
        some of the core, may be linked with some of the rest."""
        near = np.clip(unit @ self.points.T, -1, 1)
        angle, rows = np.arccos(near), np.arange(len(unit))
        at_home = np.zeros(near.shape, bool)
        at_home[rows, home] = True
        margin = near[rows, home][:, None] - near
        here = at_home | (np.arange(near.shape[1]) < home[:, None]) & (margin <= self.between[home] * self.reach + SLACK)
        core, rest = ((angle - self.widest[p] <= self.angle + SLACK) & (self.least[p] - angle <= self.angle + SLACK) & (self.rows[p] > 0) & here for p in (0, 1))
        linked = here & (self.rows[0] > 0) & (angle + self.widest[0] <= self.angle - SLACK)
        linked[rows, home] |= self.core(angle[rows, home])
        core &= ~linked
        return at_home, linked, core, rest

    def blocks(self, cell: int) -> tuple[int, int, int]:
        core, rest, visitors = (-(-int(n) // self.block) for n in (self.rows[0, cell], self.rows[1, cell], self.visitors[cell]))
        return core, rest, visitors


def placed(classes: DataFrame, cells: Cells) -> DataFrame:
    """(id, weight, vec, cell, core, angle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.clip(matrix(batch.column("vec"), cells.points.shape[1]) @ cells.points.T, -1, 1)
            home = near.argmax(axis=1)
            angle = np.arccos(near[np.arange(len(home)), home])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("weight"), batch.column("vec"), pa.array(home, pa.int32()), pa.array(cells.core(angle)), pa.array(angle)], ["id", "weight", "vec", "cell", "core", "angle"])

    return classes.select("id", "weight", "vec").mapInArrow(run, "id long, weight long, vec array<double>, cell int, core boolean, angle double")


def _outside(rows: DataFrame, cells: Cells) -> DataFrame:
    """(cell, held, extra): how many classes that are at home elsewhere may have links there that only a product tells, and
    the weight of those outside the core that are linked with all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, extra = (np.zeros(len(cells.points), np.int64) for _ in range(2))
        for batch in batches:
            at_home, linked, core, rest = cells.related(matrix(batch.column("vec"), cells.points.shape[1]), batch.column("cell").to_numpy())
            held += ((core | rest) & ~at_home).sum(axis=0)
            other = linked & ~(at_home & batch.column("core").to_numpy(zero_copy_only=False)[:, None])
            extra += batch.column("weight").to_numpy() @ other
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held), pa.array(extra)], ["cell", "held", "extra"])

    found = rows.select("weight", "vec", "cell", "core").mapInArrow(run, "cell int, held long, extra long")
    return found.groupBy("cell").agg(F.sum("held").alias("held"), F.sum("extra").alias("extra"))


def _settled(rows: DataFrame, cells: Cells) -> DataFrame:
    """(id, links, to): the links with whole cores, from both sides, and the core's first class as the spanning link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_home, linked, _, _ = cells.related(matrix(batch.column("vec"), cells.points.shape[1]), batch.column("cell").to_numpy())
            row, cell = np.nonzero(linked)
            own = at_home[row, cell] & batch.column("core").to_numpy(zero_copy_only=False)[row]
            links = cells.weight[cell] + np.where(own, cells.extra[cell] - batch.column("weight").to_numpy()[row], 0)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("id").to_numpy()[row]), pa.array(links), pa.array(cells.first[cell])], ["id", "links", "to"])

    return rows.select("id", "weight", "vec", "cell", "core").mapInArrow(run, "id long, links long, to long")


def _dealt(rows: DataFrame, cells: Cells) -> DataFrame:
    """Each class once for every task (cell, lo, hi) that compares its block with another of the cell: core blocks first, then the
    rest's, then the visitors'. Cores are not compared with cores, nor visitors with visitors."""
    names = ["cell", "lo", "hi", "mine", "id", "weight", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # as a row may be given out many times
                batch = whole.slice(start, 256)
                ids, home_core = batch.column("id").to_numpy(), batch.column("core").to_numpy(zero_copy_only=False)
                at_home, _, core, rest = cells.related(matrix(batch.column("vec"), cells.points.shape[1]), batch.column("cell").to_numpy())
                out: list[tuple[int, int, int, int, int]] = []
                for row, cell in zip(*(x.tolist() for x in np.nonzero(core | rest | at_home)), strict=True):
                    cores, rests, visits = cells.blocks(cell)
                    number = int(ids[row]) * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF
                    of_core, of_rest, of_visits = range(cores), range(cores, cores + rests), range(cores + rests, cores + rests + visits)
                    others: list[range] = [of_core] if core[row, cell] else []
                    others += [of_rest] if rest[row, cell] else []
                    if not at_home[row, cell]:
                        mine = of_visits[number % visits]
                    else:
                        mine = of_core[number % cores] if home_core[row] else of_rest[number % rests]
                        others.append(of_visits)
                    out += [(row, cell, min(mine, other), max(mine, other), mine) for block in others for other in block]
                if out:
                    row, cell, lo, hi, mine = (np.array(c) for c in zip(*out, strict=True))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in (cell, lo, hi, mine)), *(batch.column(c).take(take) for c in ("id", "weight", "vec"))], names)

    return rows.select("id", "weight", "vec", "cell", "core").mapInArrow(run, "cell int, lo int, hi int, mine int, id long, weight long, vec array<double>")


def compared(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray] | None, cosine: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, spanning links) of two blocks of (ids, weights, unit vectors), or of one with itself.

    A row's spanning link is the smallest id that it reaches by links between the blocks, so these few links join
    what all of them join.
    """
    sides = [left, right or left]
    hit = np.empty((len(left[0]), len(sides[1][0])), bool)
    for a in range(0, len(hit), 512):
        hit[a : a + 512] = sides[0][2][a : a + 512] @ sides[1][2].T >= cosine
    if right is None:
        hit[np.arange(len(hit)), np.arange(len(hit))] = False
    labels = [sides[0][0].copy(), sides[1][0].copy()]
    far = np.iinfo(np.int64).max
    linked = [np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))]
    small = hit[np.ix_(*linked)]
    while small.size:
        before = [x.copy() for x in labels]
        labels[0][linked[0]] = np.minimum(labels[0][linked[0]], np.where(small, labels[1][linked[1]], far).min(axis=1))
        labels[1][linked[1]] = np.minimum(labels[1][linked[1]], np.where(small, labels[0][linked[0]][:, None], far).min(axis=0))
        if all(np.array_equal(x, y) for x, y in zip(before, labels, strict=True)):
            break
    out = [(sides[0][0], hit @ sides[1][1], labels[0])]
    return out if right is None else [*out, (right[0], left[1] @ hit, labels[1])]


def _compared(dealt: DataFrame, size: int, cosine: float) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        mine, lo, hi = table.column("mine").to_numpy(), table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        columns = table.column("id").to_numpy(), table.column("weight").to_numpy(), matrix(table.column("vec"), size)
        sides = [tuple(c[mine == b] for c in columns) for b in dict.fromkeys((lo, hi))]
        found = compared(sides[0], sides[1] if len(sides) > 1 else None, cosine)
        ids, links, to = (np.concatenate(c) for c in zip(*found, strict=True))
        at = np.flatnonzero(links)
        return pa.table({"id": ids[at], "links": links[at].astype(np.int64), "to": to[at]})

    return dealt.groupBy("cell", "lo", "hi").applyInArrow(run, "id long, links long, to long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, per_cell: int = 4096, most_cells: int = 1024, block: int = 2048, sample: int = 20_000) -> DataFrame:
    """(id, n_links, component) of every row: how many other rows it is linked with, and the smallest id that it reaches."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    sound = F.expr("coalesce(forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0), false)")
    key = F.concat_ws("/", F.xxhash64("vec"), F.xxhash64(F.lit(1), "vec"))  # 128 bits
    marks = cut(rows.select("id", F.when(sound, key).alias("key"), F.when(sound, F.col("vec")).alias("vec")))
    classes = cut(marks.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("weight"), F.any_value("vec").alias("vec")))
    whole = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("size")).first()
    n, size = whole.n, whole["size"] or 1
    bound = max(1, min(sample, SAMPLE_BYTES // (8 * size)))
    some = classes.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // bound)))) == 0).select("vec").limit(bound).toArrow()
    cells = Cells(centres(matrix(some.column("vec"), size), max(1, min(most_cells, n // per_cell, bound // 8))), cosine, block)

    at = cut(placed(classes, cells))
    cells.count(at.groupBy("cell", "core").agg(F.count("*").alias("held"), F.sum("weight").alias("weight"), F.min("angle").alias("least"), F.max("angle").alias("widest"), F.min("id").alias("first")).collect())
    for r in _outside(at, cells).collect():
        cells.visitors[r.cell], cells.extra[r.cell] = r.held, r.extra
    found = cut(_settled(at, cells).union(_compared(_dealt(at, cells), size, cosine)))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    told = classes.select("id", "weight", "key").join(links, "id", "left").join(reached, "id", "left")
    told = cut(told.select("key", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component")))
    linked = join_counted(marks.where("key is not null").select("id", "key"), told, "key", "weight", ["id"]).select("id", "n_links", "component")
    alone = marks.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = cut(linked.union(alone))
    drop(marks, classes, at, found, told)
    return out


def representatives(vectors: DataFrame, id_col: str = "vec_id", **settings: object) -> DataFrame:
    """The rows of the vectors that are kept, whole and with all their columns: the smallest id of each group."""
    kept = near_duplicates(vectors, id_col, **settings).where("id = component").select(F.col("id").alias(id_col)).distinct()
    return vectors.join(kept, id_col, "left_semi")


def op11(embeddings: DataFrame) -> DataFrame:
    found = near_duplicates(embeddings)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
