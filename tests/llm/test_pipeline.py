import importlib.util

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_pipeline_runs_whole(spark):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["by_language", "without_near_copies", "without_repeats", "mixed", "encoded"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "round_trip", "ids"]
    got = rows.cache()
    assert got.where("not round_trip").count() == 0 and 0 < got.select("doc_id").distinct().count() <= docs.count()


def test_stages_take_effect(spark):
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [(1, "unique first text " + passage + " alpha beta", "en", "s", 0), (2, "another second text " + passage + " gamma delta epsilon", "en", "s", 0), (3, "12345", "en", "s", 0), (4, None, "en", "s", 0)]
    rows += [(10 + i, " ".join(f"near{j}" for j in range(100)) + f" end{i}", "en", "s", 0) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.by_language(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in kept.collect()} == {1, 2, 10, 11, 12}
    one = corpus_pipeline.without_near_copies(spark, docs, SF)
    assert one.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in one.where("doc_id >= 10").collect()} == {10}
    cut = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs.where("doc_id < 10"), SF).collect()}
    assert "shared30" not in cut[1].text and cut[1].text.startswith("unique first") and cut[1].n_chars == len(cut[1].text) and cut[3].text == "12345"
    mixed = corpus_pipeline.mixed(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.select("doc_id").distinct().count() >= 1


def test_entry_has_the_queries():
    spec = importlib.util.find_spec("__spark_entry__")
    assert spec is not None
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= names and sum(n.startswith("op") for n in names) == 13
    assert set(__spark_entry__.oracle_sql()) <= names
