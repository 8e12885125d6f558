"""The fitted models against plain loops: FTRL steps, language scores, word evidence and posteriors."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logfacts.llm import language_id, mixing


def bucket_counts(text):
    """How often a text has each n-gram's bucket, n-gram by n-gram."""
    out = Counter()
    low = text.lower()
    for order in language_id.ORDERS:
        for i in range(len(low) - order + 1):
            found, _ = language_id.grams(np.frombuffer(low[i : i + order].encode(), np.uint8), np.array([0, len(low[i : i + order].encode())]))
            out[int(found[-1])] += 1
    return out


def plain_ftrl(texts, labels, epochs=3, alpha=0.5, beta=1.0, l1=1e-4, l2=1e-4, scale=100.0):
    """Weights by bucket and label, and biases, a number at a time."""
    names = sorted(set(labels))
    counts = [bucket_counts(t) for t in texts]
    df = Counter(b for c in counts for b in c)
    idf = defaultdict(lambda: math.log(1 + len(texts)) + 1) | {b: math.log((1 + len(texts)) / (1 + n)) + 1 for b, n in df.items()}
    z, n = defaultdict(float), defaultdict(float)

    def weight(b, k):
        zz = z[b, k]
        return 0.0 if abs(zz) <= l1 else -(zz - math.copysign(l1, zz)) / ((beta + math.sqrt(n[b, k])) / alpha + l2)

    def values(c):
        whole = max(sum(c.values()), 1)
        return {**{b: x / whole * idf[b] * scale for b, x in c.items()}, "bias": 1.0}

    for _ in range(epochs):
        for i, c in enumerate(counts):
            if i % 8 == 7:
                continue
            x = values(c)
            w = {(b, k): weight(b, k) for b in x for k in range(len(names))}
            logit = [sum(v * w[b, k] for b, v in x.items()) for k in range(len(names))]
            top = max(logit)
            p = [math.exp(v - top) for v in logit]
            p = [v / sum(p) for v in p]
            for b, v in x.items():
                for k in range(len(names)):
                    g = v * (p[k] - (labels[i] == names[k]))
                    sigma = (math.sqrt(n[b, k] + g * g) - math.sqrt(n[b, k])) / alpha
                    z[b, k] += g - sigma * w[b, k]
                    n[b, k] += g * g
    return names, {(b, k): weight(b, k) * idf[b] * scale for b in df for k in range(len(names))}, [weight("bias", k) for k in range(len(names))]


TEXTS = ["la maison est belle", "le chat dort ici", "the house is nice", "the cat sleeps here", "das Haus ist schön", "die Katze schläft", "où est le chat", "where is the cat", "wo ist die Katze", "a", "été ou hiver", "ice and fire"]
LABELS = ["fr", "fr", "en", "en", "de", "de", "fr", "en", "de", "en", "fr", "en"]


def test_ftrl_matches_a_plain_loop():
    model = language_id.fit(TEXTS, LABELS)
    names, weights, bias = plain_ftrl(TEXTS, LABELS)
    assert model.labels == names
    np.testing.assert_allclose(model.bias, bias, rtol=1e-9, atol=1e-12)
    for (b, k), w in weights.items():
        assert model.weights[b, k] == pytest.approx(w, rel=1e-9, abs=1e-10)
    assert np.count_nonzero(model.weights) == sum(w != 0 for w in weights.values())


def test_language_scores_match_a_plain_loop(spark):
    model = language_id.fit(TEXTS, LABELS)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", "123 -", None, "ÉTÉ", "the the the"])], "doc_id long, text string")
    for row in language_id.identify(docs, model).collect():
        text = docs.where(F.col("doc_id") == row.id).first().text or ""
        if not any(c.isalpha() for c in text):
            assert (row.lang_pred, row.score) == ("und", 0.0)
            continue
        c = bucket_counts(text)
        logit = [(sum(x * model.weights[b, k] for b, x in c.items()) / sum(c.values()) + model.bias[k]) / model.temperature for k in range(3)]
        p = [math.exp(v - max(logit)) for v in logit]
        assert row.lang_pred == model.labels[int(np.argmax(p))] and row.score == pytest.approx(max(p) / sum(p))


def test_a_rare_language_is_sampled_whole_and_large_ones_by_share(spark):
    rows = [(i, "text é", "en" if i % 3 else "fr") for i in range(6000)] + [(10_000 + i, "word", "xx") for i in range(7)] + [(20_000, None, "en"), (20_001, "1", "en"), (20_002, "x", None)]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    sample = language_id.sampled(df, 300, 20)
    n = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert n["xx"] == 7 and abs(n["en"] - 200) <= 1 and abs(n["fr"] - 100) <= 1
    smallest = df.where("lang = 'fr'").select(F.xxhash64("id", F.lit(5)).alias("h")).orderBy("h").limit(n["fr"]).agg(F.max("h")).first()[0]
    assert sample.where("lang = 'fr'").agg(F.max("h")).first()[0] == smallest
    assert language_id.train(df, 300, 20).labels == ["en", "fr", "xx"]
    assert language_id.train(df.where("false")) is None


def test_the_executors_count_what_the_driver_would(spark):
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(TEXTS, LABELS, strict=True))], "h long, text string, lang string")
    for row in language_id._counted(df).collect():
        mine = language_id._vectors([TEXTS[row.h]])
        assert (row["ids"], row["counts"]) == (mine.ids.tobytes(), mine.counts.tobytes())


D = "id long, text string"


def plain_posteriors(docs, words, shares):
    """Tokens and posteriors of documents: every distinct word of a row counts its weight once, rows of one id together."""
    tokens, logit = Counter(), defaultdict(lambda: list(shares))
    for i, text in docs:
        if i is None:
            continue
        w = [x for x in (text or "").lower().split() if x]
        tokens[i] += len(w)
        logit[i] = [s + sum(words.get(x, [0] * len(shares))[k] for x in set(w)) for k, s in enumerate(logit[i])]
    out = {}
    for i in logit:
        p = [math.exp(v - max(logit[i])) for v in logit[i]]
        out[i] = (tokens[i], [v / sum(p) for v in p])
    return out


def test_posteriors_match_a_plain_loop(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice(["good", "Bad", "the", "", "x\ty"]) for _ in range(rnd.randrange(15)))) for i in range(80)] + [(5, "good good"), (5, "good good"), (90, None), (91, ""), (None, "bad")]
    words = {"good": [1.5, -0.5], "bad": [-2.0, 0.7], "x": [0.1, 0.2]}
    table = spark.createDataFrame([(w, *v) for w, v in words.items()], "word string, w_0 double, w_1 double")
    shares = [math.log(0.6), math.log(0.4)]
    got = {r.id: (r.tokens, [r.p_0, r.p_1]) for r in mixing.posteriors(spark.createDataFrame(docs, D), table, shares).collect()}
    want = plain_posteriors(docs, words, shares)
    assert got.keys() == want.keys()
    for i, (n, p) in want.items():
        assert got[i][0] == n and got[i][1] == pytest.approx(p, abs=2e-6)


def test_targets_hold_for_repeated_ids(spark):
    """Thirty further rows of one id: what is given out, row by row, still meets the targets in expectation."""
    good, bad = "fine " * 20, "awful " * 20
    docs = [(i, good if i % 2 else bad) for i in range(100)] + [(1, good)] * 30
    labelled = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(100)], "id long, domain string")
    df = spark.createDataFrame(docs, D)
    rows = mixing.mix(df, labelled, {"good": 0.5, "bad": 0.5})
    assert max(abs(v) for v in rows.select("residual_good", "residual_bad").first()) <= 1e-4
    rates = {r.id: r.rate for r in rows.select("id", "rate").collect()}
    out = Counter()
    for i, text in docs:
        out["good" if text == good else "bad"] += 20 * rates[i]
    assert out["good"] / sum(out.values()) == pytest.approx(0.5, abs=2e-3)
