"""Exact vector search as expressions: every row's distance is computed where it is read; only the best k meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _literal(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def l2(c: Column, v: list[float]) -> Column:
    parts = F.zip_with(c, _literal(v), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def cosine(c: Column, v: list[float]) -> Column:
    """1 - cosine; null where a vector has norm zero."""
    dot = F.aggregate(F.zip_with(c, _literal(v), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate(F.transform(c, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    other = sum(x * x for x in v) ** 0.5
    return F.when((own > 0) & F.lit(other > 0), 1 - dot / (own * F.lit(other)))


METRICS = {"l2": l2, "cosine": cosine}


def ranked(df: DataFrame, field: str, v: list[float], metric: str = "l2") -> DataFrame:
    """``df`` with ``_distance`` and ``_score``; rows without a vector of the query's length are left out, and distances
    that are undefined (norm zero under cosine) are infinite and so come last."""
    some = df.filter(F.col(field).isNotNull() & (F.size(field) == len(v)))
    d = F.coalesce(METRICS[metric](F.col(field), v), F.lit(float("inf")))
    return some.withColumn("_distance", d).withColumn("_score", 1 / (1 + F.col("_distance")))


def nearest(df: DataFrame, field: str, v: list[float], k: int = 10, metric: str = "l2", strict: bool = False) -> DataFrame:
    """The k nearest rows, ties by uid. ``strict`` raises where a stored vector has another length."""
    if strict:
        df = df.withColumn(field, F.when(F.col(field).isNull() | (F.size(field) == len(v)), F.col(field)).otherwise(F.raise_error(F.lit(f"a vector is not of length {len(v)}"))))
    return ranked(df, field, v, metric).orderBy("_distance", "uid").limit(k)


def through_satellites(owner: DataFrame, satellite: DataFrame, link: str, field: str, v: list[float], k: int = 10) -> DataFrame:
    """Owners by the nearest of their satellite vectors: ``link`` is the satellite's column with the owner's uid."""
    best = ranked(satellite, field, v).groupBy(F.col(link).alias("uid")).agg(F.min("_distance").alias("_distance"))
    return owner.join(best.orderBy("_distance", "uid").limit(k), "uid").orderBy("_distance", "uid")
