"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Stages decide by row, not by doc_id: a row whose id is null or occurs again is judged by its own text, and of a
group of near duplicates exactly one row stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm import decontaminate, langid, minhash, packing, quality
from skysift.llm.common import fresh, with_row, written
from skysift.llm.queries import table, vocabulary


#: Up to so many row numbers (some ten MB) are broadcast; more are joined by shuffling the documents.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """Documents whose row number isn't in the written table ``gone``."""
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, row, "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    results = tuple(fresh(docs, x) for x in ("evidence", "prior", "posterior", "kept"))
    judged = quality.classify(docs, table(spark, sf_dir, "labels"), host="source", path="lang", results=results)
    return judged.filter(F.col(results[-1])).select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    learned = langid.sample(docs.filter(~langid.held_out(F.col("doc_id"))))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return langid.predict(docs, learned, lang_pred=lang, score=score).filter(F.col(lang) != langid.UNKNOWN).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least doc_id."""
    rows, row = with_row(docs)
    groups = minhash.row_groups(rows, words=5, percent=80, row=row)
    gone = written(groups.filter(~F.col("first")).select(F.col("rid").alias(row)))
    return without(rows, gone, row).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows, row = with_row(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), window=10, row=row)
    gone = written(found.filter(F.size("hits") > 0).select(F.col("rid").alias(row)))
    return without(rows, gone, row).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Tokenizers and trained models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
