"""From raw documents to training pieces: quality, line dedup, near-duplicates, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the
next one. All but the last return the columns of documents. Stages need the columns doc_id, text and source; other columns
pass through, except for the names that the stages' operators add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import id_remainder, read_table, stored
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.mixing import mix
from lodestone.llm.near_duplicates import without_copies
from lodestone.llm.pieces import BATCH, round_trip
from lodestone.llm.quality import fit_quality, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of the folds 1 to 4. Written in small Arrow batches,
    since Python workers and the JVM keep the memory of large ones through the next stage."""
    labels = read_table(spark, sf_dir, "labels").where(id_remainder(F.col("doc_id"), 5) != 0)
    return stored(score_quality(docs, fit_quality(docs, labels)).where("predicted = 1").select(*docs.columns), "pipeline-scored", rows_a_batch=BATCH)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is a copy or near copy of; n_chars follows the text."""
    out = dedup_lines(docs)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words a shingle, similarity 0.8."""
    return without_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: a row for each copy of a document that is taken, in training order; n_chars follows the text."""
    out = mix(docs)
    return out.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else c for c in docs.columns))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document of the mix: their ids, number and hash, and whether they decode to the text."""
    return stored(round_trip(docs.select("doc_id", "source", "text"), texts=False).drop("text"), "pipeline-pieces", rows_a_batch=BATCH, rows_a_group=BATCH)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("mixing", mixture), ("sentencepiece", pieces)]

#: The classifier and the near-duplicate search are no SQL; tests hold the operators of the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
