"""Toxicity: a counterfactual-regularised classifier.

A logistic regression over the hashed words and word beginnings that a whole text holds (present or not). Besides the
usual loss it pays for every change of score between a labelled sentence and its counterfactuals, the same sentence
with another identity term put in the place of each one that it mentions; sentences that mention none get one term put
in front, so the penalty also covers terms that the labelled rows happen to lack. A neutral mention of a group can
then not carry weight by itself.

Features are chosen and weights fitted on at most ``max_rows`` labelled texts, all toxic ones first as far as half of
it, by the smallest hash of their id. Each row of the sample weighs as many rows as its class has labelled rows for it,
so scores mean the same whatever the input's size. Fitting and scoring read every text whole; the fit holds a slice of texts at a time.

Rows: a null or empty text holds no feature and gets the score of the intercept; rows with a null label or text are not
learned from; if nothing can be learned from, scores are 0. Several label rows of one id count as toxic if any does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfacts.llm import kernels as K
from logfacts.llm.shared import cut

BITS = 20
#: Texts that the fit holds at a time.
SLICE_ROWS = 200
#: How many first bytes of a word are features besides the word.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Identity terms of the training languages (fixed values).
IDENTITY_TERMS = (
    "women men girls boys muslims christians jews hindus buddhists atheists gay lesbian bisexual transgender straight black white asian latino african european "
    "american mexican chinese indian arab immigrants refugees disabled blind deaf old young elderly frauen männer muslime christen juden schwule lesben schwarze weiße "
    "ausländer flüchtlinge femmes hommes musulmans chrétiens juifs noirs blancs immigrés réfugiés mujeres hombres musulmanes cristianos judíos negros blancos inmigrantes refugiados"
).split()


@dataclass
class Model:
    weights: np.ndarray  # by bucket
    bias: float


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word and word beginning, and the text that holds it. Bytes that are no letters of any script end a word."""
    if not len(data):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    solid = _LETTER[data]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    inner = starts[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= solid[inner]
    closes[inner - 1] |= solid[inner - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    total = K.prefix_hash(data + np.uint16(1))
    owner = np.searchsorted(starts, first, side="right") - 1
    hashes, owners = [K.range_hash(total, first, last)], [owner]
    for n in BEGINNINGS:
        long = last - first > n
        hashes.append(K.mix(K.range_hash(total, first[long], first[long] + n) ^ K.U64(n)))
        owners.append(owner[long])
    return (np.concatenate(hashes) >> K.U64(64 - BITS)).astype(np.int32), np.concatenate(owners)


_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(65, 91), *range(48, 58), *range(128, 256)]] = True


def held(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of the texts with the distinct (text, bucket) pairs of each."""
    data, starts = K.text_bytes(pc.utf8_lower(column))
    for a, b in K.slices(starts):
        buckets, owner = features(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        pairs = np.unique((owner.astype(np.int64) << BITS) | buckets)
        yield a, b, pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int64)


def predict(model: Model, column: pa.Array) -> np.ndarray:
    out = np.full(len(column), model.bias)
    for a, b, text, bucket in held(column):
        out[a:b] += np.bincount(text, weights=model.weights[bucket], minlength=b - a)
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def counterfactuals(texts: list[str], terms: tuple[str, ...] | list[str], each: int = 2) -> tuple[list[str], list[int]]:
    """For each text ``each`` variants with other identity terms, and which text each one belongs to."""
    known = {t.lower(): i for i, t in enumerate(terms)}
    mention = re.compile(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, known), key=len, reverse=True)) + r")(?![^\W\d_])", re.IGNORECASE)
    out, of = [], []
    for i, text in enumerate(texts):
        for k in range(1, each + 1):
            shift = 1 + (k * (i + 1) - 1) % max(1, len(terms) - 1)  # never back to the same term
            swapped, times = mention.subn(lambda m: terms[(known[m[0].lower()] + shift) % len(terms)], text)  # noqa: B023
            out.append(swapped if times else f"{terms[(i * each + k) % len(terms)]} {text}")
            of.append(i)
    return out, of


def _matrix(texts: list[str], column_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the chosen features that each text holds; a slice of the texts is spread out at a time."""
    rows, cols = [], []
    for at in range(0, len(texts), 200):
        for a, _, text, bucket in held(pa.array(texts[at : at + 200], pa.large_string())):
            kept = column_of[bucket] >= 0
            rows.append((text[kept] + a + at).astype(np.int32))
            cols.append(column_of[bucket[kept]].astype(np.int32))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, np.int32), np.empty(0, np.int32))


def _frequencies(slices: Iterator[list[str]], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By bucket, how many toxic and how many other texts hold it."""
    df, at = np.zeros((2, 1 << BITS)), 0
    for texts in slices:
        for a, b, text, bucket in held(pa.array(texts, pa.large_string())):
            mark = y[at + a : at + b][text]
            df[1] += np.bincount(bucket, weights=mark, minlength=1 << BITS)
            df[0] += np.bincount(bucket, weights=1 - mark, minlength=1 << BITS)
        at += len(texts)
    return df[1], df[0]


def fit(texts: list[str], toxic: list[int], penalty: float = 1.0, l2: float = 0.2, steps: int = 400) -> Model | None:
    """A model from a list of texts that weigh the same."""
    return fit_slices(lambda: (texts[i : i + SLICE_ROWS] for i in range(0, len(texts), SLICE_ROWS)), toxic, np.ones(len(texts)), penalty, l2, steps)


def fit_slices(opened: Callable[[], Iterator[list[str]]], toxic: list[int], weight: np.ndarray, penalty: float = 1.0, l2: float = 0.2, steps: int = 400) -> Model | None:
    """Adam on the full bounded sample; ``penalty`` weighs squared logit changes between texts and their counterfactuals.

    ``opened`` gives the texts in the order of ``toxic`` and ``weight``, a slice at a time, and is called twice.
    """
    if not toxic:
        return None
    y = np.array(toxic, dtype=float)
    df1, df0 = _frequencies(opened(), y)
    n1, n0 = max(y.sum(), 1.0), max(len(y) - y.sum(), 1.0)
    rate = (df1 + df0) / len(y)
    strength = np.abs(df1 / n1 - df0 / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    chosen = np.flatnonzero((df1 + df0 >= 3) & (strength > 5))
    # every identity term is a feature, so that the penalty has weights to act on
    terms = np.unique(np.concatenate([bucket for *_, bucket in held(pa.array(IDENTITY_TERMS, pa.large_string()))]))
    chosen = np.union1d(chosen, terms)
    column_of = np.full(1 << BITS, -1, dtype=np.int64)
    column_of[chosen] = np.arange(len(chosen))
    parts, others, of, at = [], [], [], 0
    for texts in opened():
        row, col = _matrix(texts, column_of)
        parts.append((row + at, col))
        other, mine = counterfactuals(texts, IDENTITY_TERMS)
        row, col = _matrix(other, column_of)
        others.append((row + len(of), col))
        of += [at + i for i in mine]
        at += len(texts)
    r, c, r2, c2 = (np.concatenate([x[i] for x in p]) for p in (parts, others) for i in (0, 1))
    of, weight = np.array(of), weight / weight.mean()
    share = weight[of] / weight[of].sum()
    w, b = np.zeros(len(chosen)), float(np.log(max(weight @ y, 1.0) / max(weight @ (1 - y), 1.0)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        logit = b + np.bincount(r, weights=w[c], minlength=len(y))
        change = np.bincount(r2, weights=w[c2], minlength=len(of)) - (logit - b)[of]
        error = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
        pull = 2 * penalty * change * share
        base = error / len(y) - np.bincount(of, weights=pull, minlength=len(y))
        g = np.bincount(c, weights=base[r], minlength=len(w)) + np.bincount(c2, weights=pull[r2], minlength=len(w)) + l2 * w / len(y)
        g = np.append(g, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    weights = np.zeros(1 << BITS)
    weights[chosen] = w
    return Model(weights, b)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000) -> Model | None:
    """(id, text) and (id, toxic) to a model."""
    marked = labels.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    marked = marked.select("id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("id", F.lit(2)).alias("h"))
    part = [marked.where(F.col("toxic") == t).orderBy("h").limit(max_rows // 2) for t in (0, 1)]
    picked = part[0].union(part[1])
    docs = docs.where("text is not null")
    rows = docs.join(F.broadcast(picked), "id").select("h", "id", "toxic", "text")
    rows = cut(rows.distinct().orderBy("h", "id", "toxic", "text").limit(2 * max_rows)).orderBy("h", "id", "toxic", "text")
    toxic = [r["toxic"] for r in rows.select("toxic").collect()]
    all_rows = {r["toxic"]: r["n"] for r in docs.select("id").join(marked, "id").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = {t: all_rows[t] / toxic.count(t) for t in set(toxic)}
    weight = np.array([each[t] for t in toxic])

    def opened() -> Iterator[list[str]]:
        texts = (r["text"] for r in rows.select("text").toLocalIterator())
        while some := list(islice(texts, SLICE_ROWS)):
            yield some

    return fit_slices(opened, toxic, weight)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    bound = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").fill_null("")
            p = predict(bound.value, texts) if bound.value is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p)], ["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


FOLD = "crc32(cast(cast({} as string) as binary)) % 4"


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    mine = docs.where(FOLD.format("doc_id") + " <> 2").select(F.col("doc_id").alias("id"), "text")
    marks = labels.where(FOLD.format("doc_id") + " <> 2").select(F.col("doc_id").alias("id"), "toxic")
    found = score(docs, train(mine, marks))
    held_out = F.coalesce(F.expr(FOLD.format("id") + " = 2"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
