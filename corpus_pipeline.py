"""A corpus from raw documents to piece ids: language, near copies, repeated passages, mixture, encoding.

Each stage takes (spark, docs, sf_dir) with the rows that the stage before it kept. The stages work on whole tables.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfacts.llm import language_id, mixing, near_dedup, sentence_pieces, suffix_array
from logfacts.llm.shared import checkpoint_root, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is rejected if its language is unknown or its best label is less likely than this.
LEAST_SCORE = 0.3


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and likely enough.

    Null, empty and letterless texts are unknown and go, as do null ids; a document stays with all its rows if one row of
    its id stays. Without a single learnable document (an empty table) nothing is known and nothing stays.
    """
    model = language_id.train(language_id.learnable(docs))
    found = language_id.identify(docs, model).where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return docs.select(COLUMNS).join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; repeated rows of it stay.

    Null and wordless texts are copies of nothing and stay; null ids go; an empty table stays empty.
    """
    kept = near_dedup.near_duplicates(docs).where("id = component").select(F.col("id").alias("doc_id")).distinct()
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings; a character of which a byte is gone is gone as a whole.

    A null or short text stays as it is; repeated rows match each other and lose their texts; an empty table stays empty.
    """
    found = suffix_array.with_runs(docs.select(COLUMNS), "doc_id", "text", 200)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            texts, sizes = [], []
            for value, size, runs in zip(batch.column("text"), batch.column("n_chars").to_pylist(), batch.column("runs"), strict=True):
                text = value.as_py()
                if runs.is_valid:
                    data = np.frombuffer(text.encode(), np.uint8)
                    text = data[~suffix_array.removed(len(data), runs.values.to_numpy(), 200)].tobytes().decode("utf-8", "ignore")
                    size = len(text)
                texts.append(text)
                sizes.append(size)
            columns = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in COLUMNS], COLUMNS)

    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    kept = found.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.when(F.col("runs").isNull(), F.col("row.text")).otherwise(F.col("text")).alias("text"), "row.lang", "row.source", F.col("row.n_chars").cast("long").alias("n_chars"), "runs")
    return kept.mapInArrow(run, kinds)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate asks for; target shares that ask for fewer toxic and poor texts.

    Null and empty texts have no tokens and go by the rate of their posteriors like all others; an empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").alias("id"), "text")
    plan = mixing.mix(rows, mixing.domains_of(table(spark, sf_dir, "labels")), mixing.TARGETS).select(F.col("id").alias("doc_id"), "copies")
    rows = docs.select(COLUMNS).join(plan, "doc_id").where("copies > 0")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document; a null or empty text has an empty list; repeated rows are encoded each; an empty table stays empty."""
    return sentence_pieces.op9(docs)


STAGES = [("language ID", by_language), ("MinHash near-dedup", without_near_copies), ("suffix-array dedup", without_repeats), ("mixing to target weights", mixed), ("SentencePiece encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's rows lie in a table of the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        path = f"{checkpoint_root(spark)}/stage-{i}-{uuid.uuid4().hex}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Trained models and the fit of the rates are beyond SQL; tests hold the stages against plain loops on small tables.
ORACLE_SQL = None
