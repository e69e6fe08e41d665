"""Exact deduplication with the frequent digests split off.

One scan turns every text into its SHA-256 digest and writes the narrow table (row tag, id, digest). A Misra-Gries pass
over that table finds the digests that may be frequent: each task keeps at most ``counters`` of them, and as the sums of
the tasks' counters fall short of the true counts by at most n / (counters + 1), every digest with more than
2 n / (counters + 1) rows has a sum above n / (counters + 1) -- and no more than ``counters`` digests can have that. Those
candidates are counted exactly; the verified winners, those with more than n / (counters + 1) rows and with two at least, are
fewer than ``counters`` + 1, are broadcast and settle their rows where these are read. Only the rows of the other digests
are shuffled, and no such group exceeds 2 n / (counters + 1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tables import fresh, staged, text_or_empty

#: Most digests that the Misra-Gries pass follows in a task, and most rows that are broadcast (about 100 bytes each).
COUNTERS = 4096


def misra_gries(batches: Iterator[np.ndarray], counters: int) -> dict:
    """Merge batches of values into at most ``counters`` counters, by the mergeable form of Misra-Gries."""
    kept: dict = {}
    for values in batches:
        found, counts = np.unique(values, return_counts=True)
        for v, c in zip(found.tolist(), counts.tolist()):
            kept[v] = kept.get(v, 0) + c
        if len(kept) > counters:
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = {v: c - cut for v, c in kept.items() if c > cut}
    return kept


def frequent_candidates(rows: DataFrame, column: str, counters: int, n: int) -> DataFrame:
    """Values of the binary ``column`` that may have more than 2 n / (counters + 1) of the ``n`` rows; at most ``counters`` values."""

    def summarise(batches):
        got = misra_gries((np.array(b.column(0).to_pylist(), dtype=object) for b in batches), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], ["value", "n"])

    sums = rows.select(column).mapInArrow(summarise, "value binary, n long").groupBy("value").agg(F.sum("n").alias("n"))
    return sums.filter(F.col("n") > n / (counters + 1))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as the empty text. Of equal texts the row with the largest id stays; a
    null id is smaller than any other, and of rows that share the largest id exactly one stays. An empty table gives an
    empty result. Only the two named columns are read, so other columns cannot clash.
    """
    rows = staged(
        docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("tag")),
        "digests",
    )
    winner = F.max(F.struct("doc_id", "tag"))
    n = rows.count()
    candidates = staged(frequent_candidates(rows, "digest", counters, n).select(F.col("value").alias("digest")), "candidates")
    counted = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(winner.alias("best"), F.count("*").alias("group_size"))
    winners = staged(counted.filter(F.col("group_size") > max(1, n / (counters + 1))), "winners")  # verified; at most `counters` rows
    hot = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"best": winner.over(group), "group_size": F.count("*").over(group)})
    return hot.select(*(c := ["doc_id", "digest", "tag", "best", "group_size"])).union(rest.select(*c)).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("tag") == F.col("best.tag")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns; of rows that share the largest id of a
    text one stays. Texts are shuffled once, after rows repeated with their id have met where they are read."""
    key, mark = fresh(docs, "_key", "_mark")
    name = lambda i, sha: F.concat(F.coalesce(i.cast("string"), F.lit("-")), F.lit(":"), sha)
    kept = exact_dedup(docs, doc_id, text).filter("kept").select(name(F.col("doc_id"), F.col("text_sha256")).alias(key))
    once = docs.withColumn(mark, name(F.col(doc_id), F.sha2(text_or_empty(text), 256))).dropDuplicates([mark])
    return once.join(staged(kept, "kept"), F.col(mark) == F.col(key), "left_semi").select(*docs.columns)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
