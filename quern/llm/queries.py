"""The driver's queries for the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.llm import exact_dedup, langid, lm, matroska, mixing, pieces, quality, repeats, simhash, token_counts
from quern.llm.tables import documents

QUERIES = {
    "op1_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(documents(spark, d)),
    "op2_mixing": lambda spark, d: mixing.mix(documents(spark, d)).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken"),
    "op3_quality": lambda spark, d: quality.quality(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op4_lm": lambda spark, d: lm.score(documents(spark, d)),
    "op5_langid": lambda spark, d: langid.languages(documents(spark, d)),
    "op6_pieces": lambda spark, d: pieces.encode(documents(spark, d)),
    "op7_repeats": lambda spark, d: repeats.remove_repeats(documents(spark, d)),
    "op8_token_counts": lambda spark, d: token_counts.edited_counts(documents(spark, d)),
    "op9_simhash": lambda spark, d: simhash.near_duplicates(documents(spark, d)),
    "op10_matroska": lambda spark, d: matroska.media_digests(documents(spark, d)),
}

ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_mixing": mixing.ORACLE}
