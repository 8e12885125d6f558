"""The pipeline's stages against plain loops, and on odd rows."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from logfacts.llm import language_id, mixing
from tests.llm import test_near_dedup, test_suffix_array

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=5):
    """Copies, near copies, shared passages, short and blank texts."""
    rnd = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "dol", "mag", "été", "語") for b in ("em", "or", "na", "us")]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, out = text(70), []
    for i in range(25):
        out.append(text(rnd.randrange(1, 90)) + (" " + passage + " " + text(9) if i % 5 == 0 else ""))
    out += [out[3], out[3].upper(), out[4] + " end", "", None, " \n", "x"]
    return [(7 * i % 101, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(out)]


def rows_of(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_near_copies_by_a_plain_loop(spark):
    rows = documents()
    component = test_near_dedup.brute([(r[0], r[1]) for r in rows])
    want = sorted((r for r in rows if component[r[0]][1] == r[0]), key=str)
    assert rows_of(corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, SCHEMA), SF)) == want
    assert 0 < len(want) < len(rows)


def test_repeats_by_a_plain_loop(spark):
    rows = documents()
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    seen = {}
    for doc, t in raw.items():
        for i in range(len(t) - 199):
            seen.setdefault(t[i : i + 200], []).append((doc, i))
    want = []
    for doc, text, *rest in rows:
        gone = np.zeros(len(raw[doc]), bool)
        for places in seen.values():
            if len(places) > 1:
                for d, i in places:
                    if d == doc:
                        gone[i : i + 200] = True
        if gone.any():
            text = bytes(b for b, g in zip(raw[doc], gone.tolist(), strict=True) if not g).decode("utf-8", "ignore")
            rest[-1] = len(text)
        want.append((doc, text, *rest))
    assert rows_of(corpus_pipeline.without_repeats(spark, spark.createDataFrame(rows, SCHEMA), SF)) == sorted(want, key=str)
    assert any(len(a[1] or "") < len(b[1] or "") for a, b in zip(sorted(want, key=str), sorted(rows, key=str), strict=True))
    assert test_suffix_array.brute([(d, t) for d, t in raw.items()], 200)


def test_language_stage_keeps_what_its_scores_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = {r.id: r for r in language_id.identify(docs, language_id.train(language_id.learnable(docs))).collect()}
    want = {i for i, r in told.items() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in corpus_pipeline.by_language(spark, docs, SF).select("doc_id").collect()} == want


def test_mixing_stage_copies_rows_by_their_plan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plan = {r.id: r.copies for r in mixing.mix(docs.select(F.col("doc_id").alias("id"), "text"), mixing.domains_of(labels), mixing.TARGETS).collect()}
    got = {r.doc_id: r["count"] for r in corpus_pipeline.mixed(spark, docs, SF).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in plan.items() if n > 0}


def test_stages_on_odd_rows(spark):
    rows = [(1, "one two three four five six", "en", "s", 27), (1, "one two three four five six", "en", "s", 27), (None, "no id but words", "en", "s", 15), (2, None, None, None, None), (3, "", "fr", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.withColumns({"id": F.lit("x"), "component": F.lit(1), "copies": F.lit("c"), "runs": F.lit(2), "score": F.lit("s"), "tokens": F.lit("t")})
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name
        out, other = stage(spark, docs, SF), stage(spark, clash, SF)
        assert out.columns == other.columns and sorted(map(str, out.collect())) == sorted(map(str, other.collect())), name
        if name != "SentencePiece encoding":
            assert out.columns == corpus_pipeline.COLUMNS, name
    kept = [r[0] for r in rows_of(corpus_pipeline.without_near_copies(spark, docs, SF))]
    assert sorted(kept) == [1, 1, 2, 3]  # a null id goes, repeated rows stay
