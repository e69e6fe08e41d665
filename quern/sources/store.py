"""A store binds a catalog to frames: one frame per type with a ``uid`` and one column per field.

A single relation is a column that holds the target's uid. A list relation is the inverse of such a column or an edge
frame (src, dst). Frames are lazy; the store never caches or collects.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expressions import Compiler, parse, roots
from quern.sources.schema import Catalog, SchemaError


class Frames(dict):
    """Frames by name; a value may be a function that makes its frame when it is first asked for."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if not isinstance(value, DataFrame):
            value = self[key] = value()
        return value

    def get(self, key, default=None):
        return self[key] if key in self else default


class Store:
    def __init__(self, spark: SparkSession, schema: str | Catalog):
        self.spark = spark
        self.catalog = schema if isinstance(schema, Catalog) else Catalog.parse(schema)
        self.frames: dict[str, DataFrame] = Frames()
        self.edges: dict[tuple[str, str], DataFrame] = Frames()

    def bind(self, name: str, df: DataFrame | Callable[[], DataFrame], uid: str, columns: dict[str, str] | None = None, json: dict[str, str] | None = None) -> Store:
        """``columns`` maps fields to columns or SQL where names differ; ``json`` gives JSON fields a schema to be read with.
        A function in place of ``df`` is called when the type is first read."""
        columns, json = columns or {}, json or {}
        if isinstance(df, DataFrame):
            self.frames[name] = self._bound(name, df, uid, columns, json)
        else:
            self.frames[name] = lambda: self._bound(name, df(), uid, columns, json)
        return self

    def _bound(self, name: str, df: DataFrame, uid: str, columns: dict[str, str], json: dict[str, str]) -> DataFrame:
        cols = [F.expr(uid).cast("bigint").alias("uid")]
        for f in self.catalog[name].fields.values():
            source = columns.get(f.name, f.name)
            if f.compute or source not in df.columns and f.name not in columns:
                continue
            c = F.expr(source) if f.name in columns else F.col(source)
            if self.catalog.is_relation(f):
                c = c.cast("bigint")
            cols.append((F.from_json(c, json[f.name]) if f.name in json else c).alias(f.name))
        return df.select(*cols)

    def bind_edges(self, name: str, field: str, pairs: DataFrame | Callable[[], DataFrame]) -> Store:
        """Pairs (src, dst) of a list relation; repeated pairs count once."""
        own = lambda df: df.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).dropna().distinct()
        self.edges[name, field] = own(pairs) if isinstance(pairs, DataFrame) else lambda: own(pairs())
        return self

    def frame(self, name: str, computed: bool = True) -> DataFrame:
        """All rows of a type, or of all types behind an interface or union, with ``__typename``."""
        t = self.catalog[name]
        if t.kind in ("interface", "union"):
            parts = [self.frame(c, computed).withColumn("__typename", F.lit(c)) for c in self.catalog.concrete(name)]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if name not in self.frames:
            raise SchemaError(f"type {name} has no frame")
        df = self.frames[name]
        if computed:
            for f in t.fields.values():
                if f.compute:
                    df = df.withColumn(f.name, self.computed(df, f.compute))
        return df

    def computed(self, df: DataFrame, expression: str):
        """A virtual field: null if a field it starts from is null or absent, or if it cannot be evaluated."""
        node = parse(expression)
        value = Compiler(df.schema, strict=False).column(node)
        missing = [r for r in roots(node) if r not in df.columns]
        if missing:
            return F.lit(None)
        present = reduce(lambda a, b: a & b, (F.col(r).isNotNull() for r in sorted(roots(node))), F.lit(True))
        return F.when(present, value)

    def pairs(self, name: str, field: str) -> DataFrame:
        """(src, dst) of a relation field, from its edge frame, its own column, or its inverse."""
        f = self.catalog[name].fields[field]
        if (name, field) in self.edges:
            return self.edges[name, field]
        inverse = self.catalog.inverse(name, field)
        if inverse and (inverse.type, inverse.field) in self.edges:
            return self.edges[inverse.type, inverse.field].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if name in self.frames and field in self.frames[name].columns:
            own = self.frames[name].select(F.col("uid").alias("src"), F.col(field).alias("dst"))
            return own.filter("dst is not null")
        if inverse and not inverse.many and inverse.type in self.frames and inverse.field in self.frames[inverse.type].columns:
            back = self.frames[inverse.type].select(F.col(inverse.field).alias("src"), F.col("uid").alias("dst"))
            return back.filter("src is not null")
        raise SchemaError(f"{name}.{f.name}: no column, edges or inverse to follow")
