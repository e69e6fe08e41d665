"""Reads: list, get, count, facets and aggregates as one lazy frame each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.expressions import Compiler, ExpressionError
from quern.operators import vector
from quern.plans.filters import Filters
from quern.sources.schema import SchemaError
from quern.sources.staging import handed_over
from quern.sources.store import Store

Sort = Sequence[tuple[str, str]]


def sort_keys(df: DataFrame, sort: Sort | dict | None, reverse_uid: bool = False) -> list[tuple[Column, bool]]:
    """(key, descending) in the given order and then uid; keys may be columns or expressions. Nulls come first in ascending order and last in descending.
    ``reverse_uid`` gives the tie-break the direction of the first key, as computed sort keys have it."""
    pairs = list(sort.items() if isinstance(sort, dict) else sort or [])
    keys = []
    for name, direction in pairs:
        if direction.upper() not in ("ASC", "DESC"):
            raise SchemaError(f"unknown direction {direction}")
        c = F.col(name) if name in df.columns else Compiler(df.schema, strict=False).column(name)
        keys.append((c, direction.upper() == "DESC"))
    if not any(name == "uid" for name, _ in pairs):
        keys.append((F.col("uid"), bool(reverse_uid and keys and keys[0][1])))
    return keys


def order(keys: list[tuple[Column, bool]]) -> list[Column]:
    return [c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys]


def after_cursor(df: DataFrame, keys: list[tuple[Column, bool]], cursor: int, keep_all: bool) -> DataFrame:
    """Rows strictly behind the cursor's row in the order of ``keys``. The cursor's row is a broadcast frame of at most one row;
    without it all rows stay (``keep_all``) or none."""
    named = df.withColumns({f"_k{n}": c for n, (c, _) in enumerate(keys)})
    at = named.filter(F.col("uid") == cursor).limit(1).select(*(F.col(f"_k{n}").alias(f"_c{n}") for n in range(len(keys))), F.lit(True).alias("_found"), F.lit(1).alias("_one"))
    both = named.withColumn("_one", F.lit(1)).join(F.broadcast(at), "_one", "left" if keep_all else "inner")
    behind, equal = F.lit(False), F.lit(True)
    for n, (_, down) in enumerate(keys):
        a, b = F.col(f"_k{n}"), F.col(f"_c{n}")
        more = (a < b) | (a.isNull() & b.isNotNull()) if down else (a > b) | (a.isNotNull() & b.isNull())
        behind = behind | (equal & F.coalesce(more, F.lit(False)))
        equal = equal & a.eqNullSafe(b)
    return both.filter(F.col("_found").isNull() | behind if keep_all else behind).select(*df.columns)


class Reader:
    def __init__(self, store: Store, vacuous: bool = False, numeric_strings: bool = False):
        self.store = store
        self.filters = Filters(store, vacuous, numeric_strings)

    def rows(self, type_name: str, filter: dict | None = None, where: str | None = None) -> DataFrame:
        df = self.filters.apply(self.store.frame(type_name), type_name, filter)
        return df.filter(F.coalesce(Compiler(df.schema, strict=False).column(where), F.lit(False))) if where else df

    def list(self, type_name: str, filter: dict | None = None, sort: Sort | dict | None = None, first: int | None = None, offset: int | None = None, after: int | None = None, where: str | None = None, near_vector: list[float] | None = None, metric: str = "l2", cursor_mode: str = "auto", compute: dict[str, str] | None = None) -> DataFrame:
        """Source, filter, sort, cursor, offset, limit, in this order. ``compute`` adds expression columns; an error there aborts.

        ``near_vector`` ranks by the distance of the type's vector field (``_score`` is 1 / (1 + distance)); an explicit
        sort then re-orders all that the search lets through. ``cursor_mode``: "seek" gives nothing for an absent cursor,
        "keep" everything, "auto" seeks when there is neither filter nor sort.
        """
        if where and after is not None:
            raise SchemaError("where cannot be combined with after")
        df = self.rows(type_name, filter, where)
        for name, expression in (compute or {}).items():
            df = df.withColumn(name, Compiler(df.schema, strict=True).column(expression))
        if near_vector is not None:
            fields = self.store.catalog[type_name].with_directive("vector") or ["embedding"]
            df = vector.ranked(df, fields[0], near_vector, metric)
            sort = sort or [("_distance", "ASC")]
        computed = {f.name for f in self.store.catalog[type_name].fields.values() if f.compute} | set(compute or {})
        pairs = list(sort.items() if isinstance(sort, dict) else sort or [])
        keys = sort_keys(df, pairs, reverse_uid=bool(pairs) and pairs[0][0] in computed)
        if after is not None:
            keep = cursor_mode == "keep" or cursor_mode == "auto" and bool(filter or pairs)
            df = after_cursor(df, keys, after, keep)
        df = df.orderBy(*order(keys))
        if offset:
            df = df.offset(offset)
        return df.limit(first) if first is not None else df

    def get(self, type_name: str, uid: int | str | None = None, **unique) -> DataFrame:
        """At most one row, by uid (decimal or 0x hexadecimal) or by a @unique field."""
        df = self.store.frame(type_name)
        if uid is not None:
            return df.filter(F.col("uid") == (int(uid, 0) if isinstance(uid, str) else uid)).limit(1)
        (field, value), = unique.items()
        if "unique" not in self.store.catalog[type_name].fields[field].directives:
            raise SchemaError(f"{type_name}.{field} is not unique")
        return df.filter(F.col(field) == F.lit(value)).limit(1)

    def count(self, type_name: str, filter: dict | None = None) -> DataFrame:
        return self.rows(type_name, filter).agg(F.count(F.lit(1)).alias("count"))

    def facet(self, type_name: str, group_by: str, filter: dict | None = None, limit: int | None = None) -> DataFrame:
        """(value as text, null as "", count), most frequent first, then by value."""
        df = self.rows(type_name, filter).groupBy(F.coalesce(F.col(group_by).cast("string"), F.lit("")).alias("value"))
        df = df.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value")
        return df.limit(limit) if limit is not None else df

    def aggregate(self, type_name: str, specs: list[tuple[str, str, str | None]], keys: list[tuple[str, str]] = (), filter: dict | None = None, where: str | None = None) -> DataFrame:
        """``specs``: (alias, function, expression or None); ``keys``: (alias, expression). Without keys always one row; with
        keys sorted by them, nulls as a group of their own."""
        df = self.rows(type_name, filter, where)
        compile_ = Compiler(df.schema, strict=True).column
        aggs = [AGGREGATES[_known(fn)](compile_(e) if e else F.lit(1)).alias(alias) for alias, fn, e in specs]
        if not keys:
            return df.agg(*aggs)
        named = [compile_(e).alias(alias) for alias, e in keys]
        return df.groupBy(*named).agg(*aggs).orderBy(*(F.col(alias).asc_nulls_first() for alias, _ in keys))


AGGREGATES = {"count": F.count, "math::sum": F.sum, "math::mean": F.avg, "math::min": F.min, "math::max": F.max}


def register_aggregate(name: str, make) -> None:
    AGGREGATES[name] = make


def _known(name: str) -> str:
    if name not in AGGREGATES:
        raise ExpressionError(f"unknown aggregate {name}")
    return name


def union_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, one per uid, in the order of uid."""
    return reduce(lambda a, b: a.unionByName(b), frames).dropDuplicates(["uid"]).orderBy("uid")


def intersection_of(frames: list[DataFrame]) -> DataFrame:
    """Rows of the first frame whose uid every other frame has, one per uid, in the order of uid."""
    return reduce(lambda a, b: a.join(b.select("uid"), "uid", "left_semi"), frames).dropDuplicates(["uid"]).orderBy("uid")


def except_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("uid"), "uid", "left_anti").dropDuplicates(["uid"]).orderBy("uid")


def from_ids(store: Store, type_name: str, ids: list[int], keep_order: bool = True) -> DataFrame:
    """Rows of a given id list, in its order or in that of uid."""
    listed = store.spark.createDataFrame([(int(k), n) for n, k in enumerate(dict.fromkeys(ids))], "uid bigint, _at int")
    df = store.frame(type_name).join(F.broadcast(listed), "uid")
    return df.orderBy("_at" if keep_order else "uid").drop("_at")


def numbered(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its place in an order. For frames that a limit has made small: all rows go to one task."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*keys)))


def histogram_quantiles(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p50, p90) by index into the sorted values: n / 2 and 9 n / 10, rounded down; not interpolated.

    Equal values are counted first; the counts are dealt by ranges of (key, value), so that a frequent key has many tasks.
    Sums per key and range, few rows, tell which range holds an index, and only those ranges are numbered.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = handed_over(counted.repartitionByRange("_k", "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    part = Window.partitionBy("_k")
    sums = dealt.groupBy("_k", "_p").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumns({"_all": F.sum("_s").over(part), "_end": F.sum("_s").over(part.orderBy("_p"))})
    at = {"p50": F.floor(F.col("_all") * F.lit(0.5)), "p90": F.floor(F.col("_all") * F.lit(0.9))}
    sums = sums.withColumns(at).filter(" OR ".join(f"(_end - _s <= {q} AND {q} < _end)" for q in at))
    held = dealt.join(sums.withColumnsRenamed({"_k": "_key", "_p": "_range"}), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_p") == F.col("_range")))
    upto = F.col("_end") - F.col("_s") + F.sum("_n").over(Window.partitionBy("_k", "_p").orderBy("_v"))
    ranked = held.withColumn("_upto", upto)
    pick = lambda q: F.max(F.when((F.col("_upto") - F.col("_n") <= F.col(q)) & (F.col(q) < F.col("_upto")), F.col("_v"))).alias(q)
    return ranked.groupBy(F.col("_k").alias(key)).agg(*map(pick, at))


def metrics_range(df: DataFrame, name: str, ts: str, value: str, start, end) -> DataFrame:
    """(name, t, v): the points from ``start`` to ``end``, as rows, so that a series may be of any length."""
    return df.filter(F.col(ts).between(F.lit(start), F.lit(end))).select(F.col(name), F.col(ts).alias("t"), F.col(value).alias("v"))


def first_columns(df: DataFrame, keys: list[str], columns: dict[str, str], by: list[str], *more: Column) -> DataFrame:
    """Per group the named columns of its first row in the order of ``by``, and further aggregates, in one partial aggregation."""
    first = F.min(F.struct(*by, *(F.col(c).alias(f"_{n}") for n, c in columns.items()))).alias("_first")
    return df.groupBy(*keys).agg(first, *more).select(*keys, *(F.col(f"_first._{n}").alias(n) for n in columns), *(c for c in df.groupBy(*keys).agg(*more).columns if c not in keys))


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts with ``prefix``, in the order of the text and uid; the condition reaches the scan."""
    return df.filter(F.col(column).startswith(prefix)).orderBy(column, "uid")


def ranged(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows from ``start`` up to but without ``end``, in the order of the column and uid; either may be open."""
    for bound, keep in ((start, F.col(column) >= F.lit(start)), (end, F.col(column) < F.lit(end))):
        df = df.filter(keep) if bound is not None else df
    return df.orderBy(column, "uid")
