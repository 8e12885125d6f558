"""Exact top-k by inner product: elimination with a pivot table.

A table written once holds each vector with its distances to the same pivots. For a query and a candidate the largest difference of their distances to a pivot is a lower bound of their own distance, and with the
norms an upper bound of their inner product. Candidates stay where they lie: queries go to them in rounds of about
``ROUND`` (so much is broadcast at a time, whatever the input), and a task streams its candidate blocks past the round's
queries. It evaluates candidates in order of the bound and stops when no bound reaches the k-th best score that it has
found. The last step of a round takes the best k of each query from what the tasks give, which is all that is shuffled.

Components are floor(scale * x) as integers; scores are exact. A query's own id is no candidate. Vectors that are null or
hold null or non-finite components take no part; shorter vectors count as padded with zeros. Numbers that the result's
type cannot hold raise: components from 2**62 on, and found scores beyond a long. Candidates that share an id are
candidates each; of query rows that share an id the smallest vector counts. Rows without an id are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfacts.llm.shared import checkpoint_root, cut, cut_by

BLOCK, QUERY_BLOCK, ROUND, CHUNK = 2048, 512, 8192, 256
#: Components of this size do not fit a long with room for rounding.
LARGEST = float(1 << 62)


def usable(vector: Column) -> Column:
    limit = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < limit) & (x > -limit))


def _matrix(column: pa.ListArray, kind: type = np.int64) -> np.ndarray:
    """Rows of one width, zeros at the end of shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0), dtype=kind)
    at = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((len(column), int(size.max(initial=0))), dtype=kind)
    out[np.arange(out.shape[1]) < size[:, None]] = flat[at[0] : at[-1]]
    return out


def _widen(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, p = _widen(x, width).astype(float), _widen(pivots, width).astype(float)
    return np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (p * p).sum(1) - 2 * (x @ p.T)))


def with_pivots(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v array<long>) with each vector's distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, BLOCK) for a in range(0, batch.num_rows, BLOCK)):
                far = _distances(_matrix(part.column("v")), pivots)
                at = np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]
                columns = [part.column("id"), part.column("v"), pa.ListArray.from_arrays(at, far.ravel())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "far"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<long>, far array<double>")


def _dot(c: np.ndarray, q: np.ndarray, exact: bool) -> np.ndarray:
    return (c @ q).astype(np.int64) if exact else np.array([int(v) for v in c.astype(object) @ q.astype(object)], dtype=object)


class Asked:
    """A block of queries with the k best candidates so far of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray, k: int) -> None:
        self.ids, self.x, self.table, self.k = ids, x, table, k
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id)
        self.floor = np.full(len(ids), -np.inf)  # no more than the k-th best score
        self.scored = 0

    def offer(self, cid: np.ndarray, c: np.ndarray, c_table: np.ndarray) -> None:
        """Take the better ones of a block of candidates; equal scores go to the smaller id."""
        width = max(self.x.shape[1], c.shape[1], 1)
        a, b = _widen(self.x, width), _widen(c, width)
        exact = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2**52
        fa, fb = (a.astype(float), b.astype(float)) if exact else (a, b)
        qn, cn = (a.astype(float) ** 2).sum(1), (b.astype(float) ** 2).sum(1)
        apart = np.zeros((len(self.ids), len(cid)))
        for p in range(self.table.shape[1]):
            np.maximum(apart, np.abs(self.table[:, p, None] - c_table[:, p]), out=apart)
        room = qn[:, None] + cn  # squares of distances are known to about this times the float's precision
        bound = (room - np.maximum(0.0, apart * apart - 1e-9 * room)) / 2 + 1e-9 * room + 1
        for i, mine in enumerate(self.ids):
            near = np.flatnonzero((bound[i] >= self.floor[i]) & (cid != mine))
            near = near[np.argsort(-bound[i, near], kind="stable")]
            for at in range(0, len(near), CHUNK):
                if bound[i, near[at]] < self.floor[i]:
                    break
                part = near[at : at + CHUNK]
                scores = _dot(fb[part], fa[i], exact)
                self.scored += len(part)
                good = np.flatnonzero(scores >= self.floor[i])
                self.best[i] = sorted([*self.best[i], *((-int(scores[j]), int(cid[part[j]])) for j in good)])[: self.k]
                if len(self.best[i]) == self.k:
                    least = -self.best[i][-1][0]
                    self.floor[i] = least if exact else np.nextafter(float(least), -np.inf)

    def found(self) -> list[tuple[int, int, int]]:
        """(query id, candidate id, score)."""
        return [(int(q), v, -s) for q, hits in zip(self.ids, self.best, strict=True) for s, v in hits]


def search(queries: list[Asked], candidates: Iterable[tuple]) -> list[tuple[int, int, int]]:
    """What the queries find among the blocks of candidates, one of which is held at a time."""
    for block in candidates:
        for asked in queries:
            asked.offer(*block)
    return [hit for asked in queries for hit in asked.found()]


def _round(candidates: DataFrame, queries: pa.Table, table: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of one round's queries: the k best of each task's candidates."""
    spark = candidates.sparkSession
    ids, x = queries.column("id").to_numpy(), _matrix(queries.column("v"))
    sent = spark.sparkContext.broadcast([(ids[a : a + QUERY_BLOCK], x[a : a + QUERY_BLOCK], _distances(x[a : a + QUERY_BLOCK], table)) for a in range(0, len(ids), QUERY_BLOCK)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(a, BLOCK) for batch in batches for a in range(0, batch.num_rows, BLOCK))
        offered = ((p.column("id").to_numpy(), _matrix(p.column("v")), _matrix(p.column("far"), float)) for p in parts)
        hits = search([Asked(*block, k) for block in sent.value], offered)
        if any(not -(1 << 63) <= s < 1 << 63 for _, _, s in hits):
            raise ValueError("a score does not fit a long")
        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int = 32, round_size: int = ROUND) -> DataFrame:
    """(id, vector) to (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("vector")))
    scaled = F.transform("vector", lambda x: F.lit(scale) * x.cast("double"))
    counts = rows.agg(F.count_if(is_query).alias("q"), F.max(F.array_max(F.transform(scaled, F.abs))).alias("largest")).first()
    if (counts["largest"] or 0.0) >= LARGEST:
        raise ValueError("a component is too large for exact scores")
    rows = rows.select("id", is_query.alias("asks"), F.transform(scaled, lambda x: F.floor(x).cast("long")).alias("v"))
    chosen = rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivots).select("v").collect()  # so many vectors, whatever the input
    table = np.zeros((len(chosen), max([len(r["v"]) for r in chosen], default=0)), np.int64)
    for i, r in enumerate(chosen):
        table[i, : len(r["v"])] = r["v"]
    rounds = -(-max(counts["q"], 1) // round_size)
    queries = rows.where("asks").groupBy("id").agg(F.min("v").alias("v")).withColumn("turn", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    offered = cut(with_pivots(rows, table))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    path, kinds = f"{checkpoint_root(spark)}/hits-{uuid.uuid4().hex}", "query_id long, rank int, vec_id long, score long"
    for asked in cut_by(queries.repartition(rounds, "turn"), "turn", list(range(rounds))):
        hits = _round(offered, asked.toArrow(), table, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        hits.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path)


def op8(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows, F.col("id") % 50 == 0)
