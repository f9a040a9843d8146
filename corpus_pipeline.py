"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one reads back from Parquet.

All stages but the last return the columns of documents. Language ID drops
documents without a predicted language or with a score under `LEAST_SCORE`;
line dedup drops boilerplate lines of a source, near copies counted as one page; MinHash near-dedup keeps the
document with the smallest id of each class; personal data is replaced by its
kind in brackets; packing returns the pieces in their sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm import langid, lines, minhash, packing, pii
from latticework.llm.queries import PIECES, WORDS
from latticework.llm.runtime import Store, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior below which a text counts as of no single language.
LEAST_SCORE = 0.5


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return df.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    known = langid.learn(docs.where(langid.fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang"), path)
    told = langid.predict(docs.select(*COLUMNS), known, path, COLUMNS)
    return _documents(told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(lines.line_dedup(docs, near=True))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id")
    return _documents(docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id is null")).select(*docs.columns))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(pii.redact(docs, pii.learn(docs)))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(WORDS))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("pii", pii_stage),
    ("best_fit_packing", pack_stage),
]

#: Language scoring, boosted trees and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.put(f"{i}_{name}", docs)
    return docs
