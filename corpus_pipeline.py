"""The corpus pipeline: documents that the quality classifier accepts, without exact and near copies, mixed and encoded.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``docs``. :func:`run` writes each stage's result to the shared folder and reads it again, so that a lost
executor costs a re-read. An empty table passes through every stage, and texts are never cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, mixing, near_copies, pieces, quality
from quern.llm.tables import documents, staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more; labels are read from ``sf_dir`` and fitted on the documents at hand. Null and
    empty texts share one score and so stay or go together; repeated rows too. Without labels of both kinds the base rate
    decides for all."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, a null id being the smallest; null equals the empty text, and of rows
    repeated with their id one stays."""
    return exact_dedup.keep_one_of_each(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more on five-word shingles the document with the smallest
    doc_id, a null id being the largest; texts without words are one group, and of rows that share the id one stays."""
    return near_copies.keep_one_of_each_group(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the weights of the sources ask; copies are equal rows. A null source is a source of its own;
    a source without words has rate 0, and its documents go."""
    return mixing.emit_copies(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, decoded_sha256, round_trip and ids of every row; null counts as empty, which has no ids."""
    return pieces.encode(docs, ids=True)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix), ("pieces", encode)]
#: Training, fingerprints and encoding are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
