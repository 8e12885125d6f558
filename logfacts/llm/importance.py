"""Importance resampling: draw the documents whose words look like those of a target collection.

Texts are read as UTF-8 bytes. One table of 256 bytes lower-cases A-Z and blanks all that is no letter or digit of
ASCII nor part of a longer character, so ``bytes.split`` yields the words. A feature is a run of 1 to ``longest``
words joined by one space; its number is the crc32 of those bytes, extended word by word with the shorter run's crc32
as the seed, and its bucket that number modulo ``buckets``. Both collections are counted into the buckets, each bucket
gains by how much more often the target has it, and a document weighs the mean gain of its features. A Gumbel number
from the hash of its id makes the highest scores a draw without replacement in proportion to the weights.

What the driver holds has a fixed size: one count a bucket, and one count a score. A score is an integer between about
-45,000 and 65,000 whatever the data (a gain is a thousand times the log of a ratio of counts, the Gumbel number lies
between -3,100 and 23,000), so ranks come from the number of documents at each score, and only documents with the
same score are put in order next to each other.

Rows: a null text is empty and has no features, weight 0; the text of a row with a null id counts, but the row is left
out of the result; repeated rows count and are drawn each (ties by id, then by features and weight, which leaves only
equal rows to be swapped); an empty table gives no rows and an empty target is a target without counts; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfacts.llm.shared import cut

#: What becomes of each byte: digits, a-z and all bytes of longer characters stay, A-Z go to lower case, others are blank.
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def features(found: list[bytes], longest: int) -> Counter[int]:
    """How often each run's crc32 occurs; a run's number grows from that of the run without its last word."""
    seeds = list(map(zlib.crc32, found))
    total = Counter(seeds)
    for more in range(1, longest):
        seeds = [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, found[more:], strict=False)]
        total.update(seeds)
    return total


def n_features(n_words: int, longest: int) -> int:
    return sum(max(0, n_words - more) for more in range(longest))


def bucket_counts(texts: DataFrame, column: str, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket: every task gives one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                counts = features(words(value.as_py()), longest)
                numbers, times = np.fromiter(counts.keys(), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
                np.add.at(total, numbers % buckets, times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "held"])

    parts = texts.select(F.col(column).cast("string").cast("binary")).mapInArrow(run, "bucket long, held long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("held").alias("held")).collect():
        out[row.bucket] = row.held
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """A thousand times the log of how much more often the target has each bucket, one added to each count."""
    size, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1.0) * (all_source + size) / ((s + 1.0) * (all_target + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)]


def gumbel(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, id_col: str, text_col: str, gain: list[int], longest: int, seed: int) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                n = n_features(len(found), longest)
                weight = sum(gain[number % len(gain)] * times for number, times in features(found, longest).items()) // n if n else 0
                out.append((doc_id, len(found), n, weight, weight + gumbel(doc_id, seed)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")
    return rows.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rank`` for the drawn ones: the floor of that percentage of all documents with enough words, highest scores first."""
    spark = scored.sparkSession
    at = scored.where(F.col("n_words") >= least_words).groupBy("score").count().collect()
    at, draw, before, above = sorted(((r.score, r["count"]) for r in at), reverse=True), 0, 0, []
    draw = sum(held for _, held in at) * percent // 100
    for score, held in at:
        if before >= draw:
            break
        above.append((score, before))
        before += held
    open_ = (F.col("n_words") >= least_words) & (F.col("score") >= (above[-1][0] if above else 2**62))
    offsets = F.broadcast(spark.createDataFrame(above, "score long, before long"))  # one row a score
    place = F.row_number().over(Window.partitionBy("score").orderBy("id", "n_features", "weight")) + F.col("before")
    best = scored.where(open_).join(offsets, "score").select(*scored.columns, F.when(place <= draw, place).cast("long").alias("rank"))
    return best.union(scored.where(~open_).withColumn("rank", F.lit(None).cast("long")))


def weighed(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn."""
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    return ranked(cut(scores(docs, id_col, text_col, gain, longest, seed)), percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **settings: object) -> DataFrame:
    """The rows of the drawn documents, whole and with all their columns; rows of one id come or go together."""
    drawn = weighed(docs, target, id_col, **settings).where("rank is not null").select(F.col("id").alias(id_col)).distinct()
    return docs.join(drawn, id_col, "left_semi")


def op12(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return weighed(docs, benchmark).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
