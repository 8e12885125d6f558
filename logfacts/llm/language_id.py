"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1-, 2- and 3-grams of the lower-cased characters of a whole text, hashed into a fixed number of
buckets. A bucket's value is its share of the text's n-grams times its inverse document frequency. Weights are learned
with follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties, so most weights are exactly zero), and a
temperature fitted on documents kept aside makes the winning probability an honest score.

The model is fitted on the whole texts of a sample of labelled rows, drawn by the hash of their ids: ``max_rows`` by the
labels' shares, but ``least_rows`` of each label at least, so a rare language is learned too. The executors count the
sample's n-grams; the driver gets these counts, whose size does not depend on that of the texts, and none of the texts.

Rows: a null text, or one without a letter, gets ``und`` and score 0; rows with a null label are not learned from; if
nothing can be learned from, every text gets ``und``. Other columns are ignored. Ties go to the label first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logfacts.llm import kernels as K
from logfacts.llm.shared import cut, drop

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # bucket x label, the inverse document frequency multiplied in
    bias: np.ndarray
    temperature: float


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every character n-gram, text after text, and each text's first place in it."""
    lead = (data & 0xC0) != 0x80
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum(lead)])[starts]
    parts, owner = [], np.repeat(np.arange(len(starts) - 1), np.diff(at))
    hashed = K.mix(code.astype(np.uint64) + K.U64(1))
    rolling = np.zeros(len(code), dtype=np.uint64)
    for order in range(1, max(ORDERS) + 1):
        n = len(code) - order + 1
        if n <= 0:
            break
        rolling = rolling[:n] * K.U64(0x9E3779B97F4A7C15) + hashed[order - 1 :]
        if order in ORDERS:
            inside = owner[:n] == owner[order - 1 :]
            parts.append(((K.mix(rolling) & K.U64(BUCKETS - 1)).astype(np.int32)[inside], owner[:n][inside]))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.concatenate([p for p, _ in parts]), np.concatenate([o for _, o in parts])


def _pieces(lowered: pa.Array, most: int = K.SLICE_BYTES // 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, starts = K.text_bytes(lowered)
    for a, b in K.slices(starts, most):
        buckets, owner = grams(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        yield a, b, buckets, owner


def scores(model: Model, column: pa.Array) -> np.ndarray:
    """For each text the probability of each label."""
    logits = np.zeros((len(column), len(model.labels)))
    for a, b, buckets, owner in _pieces(pc.utf8_lower(column)):
        n = np.bincount(owner, minlength=b - a)
        for j in range(len(model.labels)):
            logits[a:b, j] = np.bincount(owner, weights=model.weights[buckets, j], minlength=b - a) / np.maximum(n, 1)
    logits = (logits + model.bias) / model.temperature
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    return logits / logits.sum(axis=1, keepdims=True)


@dataclass
class Vectors:
    """The texts' n-grams and their counts in flat arrays: the driver holds them for a fit."""

    ids: np.ndarray  # uint16, as there are 2**16 buckets
    counts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text and their shares."""
        inside = slice(self.ends[i], self.ends[i + 1])
        counts = self.counts[inside]
        return self.ids[inside].astype(np.int32), counts / max(counts.sum(), 1)


def _grouped(lowered: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct buckets of some texts one after another, their counts, and how many each text has."""
    for a, b, buckets, owner in _pieces(lowered, 1 << 16):
        found, n = np.unique(owner * BUCKETS + buckets, return_counts=True)
        yield (found % BUCKETS).astype(np.uint16), n.astype(np.int32), np.bincount(found // BUCKETS, minlength=b - a)


def _flat(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Vectors:
    ids, counts, sizes = zip((np.empty(0, np.uint16), np.empty(0, np.int32), np.zeros(1, np.int64)), *parts, strict=True)
    return Vectors(np.concatenate(ids), np.concatenate(counts), np.concatenate(sizes).cumsum())


def _vectors(texts: list[str]) -> Vectors:
    return _flat(list(_grouped(pc.utf8_lower(pa.array(texts, pa.string())))))


def _counted(rows: DataFrame) -> DataFrame:
    """(h, lang, text) to (h, lang, ids, counts): the executors count a text's n-grams, so no text goes to the driver.

    A text has 2**16 buckets at most, so a row is of 400 KB at most however long its text is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = _flat(list(_grouped(pc.utf8_lower(batch.column("text").slice(i, 1)))))
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(i, 1), batch.column("lang").slice(i, 1), pa.array([found.ids.tobytes()]), pa.array([found.counts.tobytes()])], ["h", "lang", "ids", "counts"])

    return rows.select("h", "lang", "text").mapInArrow(run, "h long, lang string, ids binary, counts binary")


def fit(texts: list[str], labels: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model | None:
    """A model from texts and their labels."""
    return fit_vectors(_vectors(texts), labels, epochs, alpha, beta, l1, l2)


def fit_vectors(vectors: Vectors, labels: list[str], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> Model | None:
    """FTRL-proximal over the rows in the given order; every eighth row is kept aside for the temperature."""
    names = sorted(set(labels))
    if not names:
        return None
    target = np.array([names.index(x) for x in labels])
    frequency = np.zeros(BUCKETS)
    for i in range(len(vectors)):
        frequency[vectors[i][0]] += 1
    idf = np.log((1 + len(vectors)) / (1 + frequency)) + 1
    size = len(names)
    z, n, w = (np.zeros((BUCKETS + 1, size)) for _ in range(3))
    aside = [i for i in range(len(vectors)) if i % 8 == 7] or list(range(len(vectors)))
    learned = [i for i in range(len(vectors)) if i % 8 != 7]
    scale = 100.0  # shares of single n-grams are small; this brings the steps to a usable size
    for _ in range(epochs):
        for i in learned:
            ids, share = vectors[i]
            ids, value = np.append(ids, BUCKETS), np.append(share * idf[ids] * scale, 1.0)
            sign, root = np.sign(z[ids]), np.sqrt(n[ids])
            w[ids] = np.where(np.abs(z[ids]) <= l1, 0.0, -(z[ids] - sign * l1) / ((beta + root) / alpha + l2))
            logit = value @ w[ids]
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[target[i]] -= 1.0
            g = value[:, None] * p
            sigma = (np.sqrt(n[ids] + g * g) - root) / alpha
            z[ids] += g - sigma * w[ids]
            n[ids] += g * g
    sign = np.sign(z)
    w = np.where(np.abs(z) <= l1, 0.0, -(z - sign * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.array([(share * idf[ids] * scale) @ w[ids] + w[BUCKETS] for ids, share in map(vectors.__getitem__, aside)])
    temperature = min(np.geomspace(0.25, 16, 49), key=lambda t: _loss(kept / t, target[aside]))
    return Model(names, w[:BUCKETS] * idf[:, None] * scale, w[BUCKETS], float(temperature))


def _loss(logits: np.ndarray, target: np.ndarray) -> float:
    top = logits.max(axis=1, keepdims=True)
    return float(np.mean(np.log(np.exp(logits - top).sum(axis=1)) + top[:, 0] - logits[np.arange(len(target)), target]))


def sampled(labelled: DataFrame, max_rows: int, least_rows: int) -> DataFrame:
    """(h, lang, text): ``max_rows`` rows drawn by the hash of their ids, each label by its share but ``least_rows`` at least
    (all that it has, if fewer), so a rare label is learned too. At most max_rows + labels x (least_rows + 1) rows."""
    rows = labelled.where("text is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = rows.select(F.xxhash64("id", F.lit(5)).alias("h"), "lang", "text")
    sizes = cut(rows.groupBy("lang").agg(F.count("*").alias("n")))
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    quota = sizes.select("lang", "n", F.greatest(F.lit(least_rows), F.ceil(F.col("n") * (max_rows / max(whole, 1)))).alias("quota"))
    # hashes spread evenly: half as many again and 200 more lie under this bound, and only these are put in order
    place = (F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n")
    near = rows.join(quota, "lang").where(place <= 1.5 * F.col("quota") + 200)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return near.withColumn("nth", nth).where(F.col("nth") <= F.col("quota")).select("h", "lang", "text")


def train(labelled: DataFrame, max_rows: int = 2500, least_rows: int = 50) -> Model | None:
    """(id, text, lang) to a model fitted on the whole texts of a bounded sample; rows without a text or label are left out."""
    sample = cut(_counted(sampled(labelled, max_rows, least_rows)).orderBy("h", "lang", "ids"))
    parts, labels = [], []
    for row in sample.orderBy("h", "lang", "ids").toLocalIterator():  # one partition's rows at a time
        ids, counts = np.frombuffer(row["ids"], np.uint16), np.frombuffer(row["counts"], np.int32)
        parts.append((ids, counts, np.array([len(ids)])))
        labels.append(row["lang"])
    drop(sample)
    return fit_vectors(_flat(parts), labels)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    bound = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bound.value
        for batch in batches:
            texts = batch.column("text").fill_null("")
            letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False), dtype=bool)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if model is not None and len(texts):
                p = scores(model, texts)
                best, score = p.argmax(axis=1), p.max(axis=1)
            known = letters & (model is not None)
            names = np.array([*(model.labels if model else []), UNKNOWN], dtype=object)
            lang = names[np.where(known, best, len(names) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, lang_pred string, score double")


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: every fold but 0 of five, by the checksum of the id."""
    return docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").select(F.col("doc_id").alias("id"), "text", "lang")


def op5(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(learnable(docs)))
    held = F.expr("crc32(cast(cast(id as string) as binary)) % 5 = 0")
    return found.select(F.col("id").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
