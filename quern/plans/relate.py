"""Nested selections: one join per relation for all parents at once, paging per parent by rank."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import vector
from quern.plans.read import Reader, order, sort_keys
from quern.sources.schema import SchemaError

MOST_DEPTH = 64
#: A parent's children are nested into one row; more of them are an error that asks for a page.
MOST_CHILDREN = 100_000


@dataclass
class Selection:
    """What to read of a field: arguments, and the fields below by output name."""

    field: str = ""
    args: dict = dataclasses.field(default_factory=dict)
    fields: dict[str, Selection] = dataclasses.field(default_factory=dict)

    @classmethod
    def of(cls, spec: dict) -> Selection:
        """From {"name": True, "alias": {"field": .., "args": {..}, "fields": {..}}}."""
        out = cls()
        for name, v in spec.items():
            v = v if isinstance(v, dict) else {}
            out.fields[name] = cls(v.get("field", name), v.get("args", {}), cls.of(v.get("fields", {})).fields)
        return out


class Relations:
    def __init__(self, reader: Reader):
        self.reader, self.store = reader, reader.store

    def pairs_with_children(self, type_name: str, field: str) -> DataFrame:
        """(src, and the child's columns) for every link of a relation."""
        target = self.store.catalog[type_name].fields[field].base
        child = self.store.frame(target)
        return self.store.pairs(type_name, field).join(child, F.col("dst") == child["uid"]).drop("dst")

    def children(self, type_name: str, field: str, filter: dict | None = None, sort=None, first: int | None = None, offset: int | None = None, after: int | None = None, near_vector: list[float] | None = None, metric: str = "cosine") -> DataFrame:
        """(src, position, child columns): every parent's children, filtered, ordered and paged on their own.

        ``near_vector`` re-ranks by the child's vector; children without a vector of that length are left out.
        """
        target = self.store.catalog[type_name].fields[field].base
        child = self.reader.rows(target, filter)
        if near_vector is not None:
            named = self.store.catalog[target].with_directive("vector") or ["embedding"]
            child = vector.ranked(child, named[0], near_vector, metric)
            sort = sort or [("_distance", "ASC")]
        keys = sort_keys(child, sort)
        df = self.store.pairs(type_name, field).join(child, F.col("dst") == child["uid"]).drop("dst")
        df = df.withColumn("position", F.row_number().over(Window.partitionBy("src").orderBy(*order(keys))))
        if after is not None:
            at = df.filter(F.col("uid") == after).select(F.col("src").alias("_src"), F.col("position").alias("_from"))
            df = df.join(at, F.col("src") == F.col("_src"), "left").filter(F.col("position") > F.coalesce("_from", F.lit(0)))
            df = df.withColumn("position", (F.col("position") - F.coalesce("_from", F.lit(0))).cast("int")).drop("_src", "_from")
        if offset:
            df = df.filter(F.col("position") > offset)
        if first is not None:
            df = df.filter(F.col("position") <= first + (offset or 0))
        return df

    def nest(self, df: DataFrame, type_name: str, selection: Selection, depth: int = 0) -> DataFrame:
        """``df`` (frame rows of the type, with uid) with the selected fields; relations become structs or arrays of structs."""
        if depth > MOST_DEPTH:
            raise SchemaError("selections are nested too deep")
        t = self.store.catalog[type_name]
        out: dict[str, Column] = {}
        for n, (name, s) in enumerate(selection.fields.items()):
            if s.field in ("uid", "id"):
                out[name] = F.col("uid")
            elif s.field == "__typename":
                out[name] = F.col("__typename") if "__typename" in df.columns else F.lit(type_name)
            elif s.field in ("_score", "_distance"):
                out[name] = F.col(s.field) if s.field in df.columns else F.lit(None).cast("double")
            elif s.field not in t.fields:
                raise SchemaError(f"{type_name} has no field {s.field}")
            elif self.store.catalog.is_relation(t.fields[s.field]):
                f, column = t.fields[s.field], f"_n{depth}_{n}"
                got = self.children(type_name, s.field, **s.args)
                flat = self._child_rows(got, f.base, s, depth)
                if f.many:
                    rows = flat.filter(F.col("_pos") <= MOST_CHILDREN + 1 + (s.args.get("offset") or 0)).groupBy("_src").agg(F.array_sort(F.collect_list(F.struct("_pos", "_row"))).alias("_all"))
                    many = F.raise_error(F.lit(f"{type_name}.{s.field}: over {MOST_CHILDREN} children of one parent; ask for a page with first"))
                    rows = rows.select("_src", F.when(F.size("_all") <= MOST_CHILDREN, F.transform("_all", lambda x: x["_row"])).otherwise(many).alias(column))
                    df = df.join(rows, F.col("uid") == F.col("_src"), "left").drop("_src")
                    out[name] = F.coalesce(F.col(column), F.array().cast(rows.schema[column].dataType))
                else:
                    rows = flat.filter("_pos = 1").select("_src", F.col("_row").alias(column))
                    df = df.join(rows, F.col("uid") == F.col("_src"), "left").drop("_src")
                    out[name] = F.col(column)
            else:
                out[name] = F.col(s.field)
        kept = [c for c in ("_keep_src", "_keep_pos") if c in df.columns]
        return df.select(*kept, *(c.alias(k) for k, c in out.items()))

    def _child_rows(self, got: DataFrame, target: str, s: Selection, depth: int) -> DataFrame:
        """(_src, _pos, _row) of one relation's children."""
        marked = got.withColumnsRenamed({"src": "_keep_src", "position": "_keep_pos"})
        below = self.nest(marked, target, s if s.fields else Selection(fields={"uid": Selection("uid")}), depth + 1)
        names = [c for c in below.columns if not c.startswith("_keep_")]
        pos = F.row_number().over(Window.partitionBy("_keep_src").orderBy("_keep_pos")) if "offset" in s.args else F.col("_keep_pos")
        return below.select(F.col("_keep_src").alias("_src"), pos.alias("_pos"), F.struct(*names).alias("_row"))

    def select(self, type_name: str, spec: dict | Selection, **query) -> DataFrame:
        """A list read with a nested selection; the order of the list is kept by a last sort on the same keys."""
        selection = spec if isinstance(spec, Selection) else Selection.of(spec)
        return self.nest(self.reader.list(type_name, **query), type_name, selection)

