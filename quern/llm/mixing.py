"""Mixing sources to target weights: floor(rate) copies of each document and one hash-seeded Bernoulli copy more.

Word counts are taken in one scan and written as a narrow table; the sources are summed from it. Targets come from
water-filling: with weights w and ceilings c = limit * size there is one level L with sum(min(c, L * w)) = share * total,
found with running sums over the sources in the order of c / w. The document's draw is a hash of its id and the seed, so
that reruns, other partitionings and lost executors give the same mix, and no row has to meet another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tables import WORD, fresh, staged, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the MD5 of the id and the seed: 13 hexadecimal digits, which a double holds exactly."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """From (source, size): source, source_size, target. One row per source, so the unpartitioned windows stay small."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("ceiling", F.lit(limit) * F.col("source_size"))
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the sources before the first whose own level stays within its ceiling are full; that level holds for all others
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("ceiling"), F.struct((F.col("ceiling") / F.col("weight")).alias("at"), "level"))).over(Window.partitionBy())["level"]
    return s.select("source", "source_size", F.least("ceiling", F.coalesce(level * F.col("weight"), F.col("ceiling"))).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, seed: str = "0", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    Size is the number of words (null text: 0). ``copies`` is floor(rate) plus one with probability rate - floor(rate);
    ``taken`` is size * copies and so at most ``limit`` times the size. A null source is a source of its own and comes
    last; a source without words has target and rate 0. Repeated rows with the same id get the same draw. An empty table
    gives an empty result. Only the named columns are read.
    """
    sizes = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size")), "sizes")
    targets = staged(source_targets(sizes, weights, share, limit), "targets").withColumnRenamed("source", "of_source")
    # as a written table its size is known: broadcast below Spark's threshold, else a sort-merge join that AQE splits where a source is hot
    rated = sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    extra = (draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("long")
    return rated.withColumn("copies", F.floor("rate") + extra).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit_copies(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` says, with all their columns."""
    m = mix(docs, doc_id=doc_id, **options)
    of, rate, copy = fresh(docs, "_source", "_rate", "_copy")
    rates = staged(m.select(F.col("source").alias(of), F.col("rate").alias(rate)).distinct(), "rates")
    source = options.get("source", "source")
    rated = docs.join(rates, F.col(source).eqNullSafe(F.col(of)))
    copies = (F.floor(rate) + (draw(F.col(doc_id), options.get("seed", "0")) < F.col(rate) - F.floor(rate)).cast("long")).cast("int")
    return rated.withColumn(copy, F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS ceiling,
             [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
pairs AS (SELECT a.source, a.ceiling / a.weight AS ratio,
                 (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(b.ceiling) FILTER (b.ceiling / b.weight < a.ceiling / a.weight), 0))
                 / sum(b.weight) FILTER (b.ceiling / b.weight >= a.ceiling / a.weight) AS level FROM s a, s b GROUP BY a.source, a.ceiling, a.weight),
lev AS (SELECT arg_min(level, ratio) AS level FROM pairs WHERE level <= ratio),
t AS (SELECT source, source_size, least(ceiling, coalesce((SELECT level FROM lev) * weight, ceiling)) AS target FROM s),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
       (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
