"""Executable query documents: the generated root fields of a catalog, lowered to lazy frames.

Root fields of a type T: queryT, getT, countT, aggregateT, and the mutations createT, updateT, deleteT; for all types:
search, hybridSearch, bulkCheckPermission, and the subscription field event.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import search, vector
from quern.plans.filters import TEXT
from quern.plans.read import Reader
from quern.plans.relate import Relations, Selection
from quern.sources import writes
from quern.sources.schema import Cursor, SchemaError
from quern.sources.store import Store
from quern.streaming.events import subscribe


@dataclass
class Operation:
    kind: str
    name: str | None
    fields: dict[str, Selection] = field(default_factory=dict)


def parse(text: str, variables: dict | None = None) -> list[Operation]:
    """Operations with aliases, arguments, variables with defaults, fragments and inline fragments."""
    ops: list[tuple] = []
    fragments: dict[str, int] = {}
    c = Cursor(text)

    def skip_braces():
        c.expect("{")
        depth = 1
        while depth:
            kind, v = c.next()
            if kind == "end":
                raise SchemaError("missing }")
            depth += (kind, v) == ("mark", "{")
            depth -= (kind, v) == ("mark", "}")

    while c.peek()[0] != "end":
        if c.peek() == ("mark", "{"):
            ops.append(("query", None, {}, c.at))
            skip_braces()
            continue
        kind = c.name()
        if kind == "fragment":
            name = c.name()
            c.name()
            c.name()
            fragments[name] = c.at
        elif kind in ("query", "mutation", "subscription"):
            name = c.name() if c.peek()[0] == "name" else None
            given = dict(variables or {})
            if c.take("("):
                while not c.take(")"):
                    c.expect("$")
                    v = c.name()
                    c.expect(":")
                    _skip_type(c)
                    if c.take("="):
                        given.setdefault(v, c.value())
                    given.setdefault(v, None)
            ops.append((kind, name, given, c.at))
        else:
            raise SchemaError(f"unexpected {kind!r}")
        skip_braces()

    def selection(at: int, given: dict, open_: tuple) -> tuple[dict[str, Selection], int]:
        c.at = at
        out: dict[str, Selection] = {}
        c.expect("{")
        while not c.take("}"):
            if c.take("..."):
                if c.peek() == ("name", "on"):
                    c.next()
                    c.name()
                    got, after = selection(c.at, given, open_)
                elif c.peek() == ("mark", "{"):
                    got, after = selection(c.at, given, open_)
                else:
                    name = c.name()
                    if name not in fragments or name in open_:
                        raise SchemaError(f"unknown or circular fragment {name}")
                    back = c.at
                    got, _ = selection(fragments[name], given, (*open_, name))
                    after = back
                c.at = after
                _merge(out, got)
                continue
            name = c.name()
            alias = name
            if c.take(":"):
                name = c.name()
            s = Selection(name, c.arguments(given))
            if c.peek() == ("mark", "{"):
                s.fields, c.at = selection(c.at, given, open_)
            _merge(out, {alias: s})
        return out, c.at

    return [Operation(kind, name, selection(at, given, ())[0]) for kind, name, given, at in ops]


def _merge(out: dict[str, Selection], more: dict[str, Selection]) -> None:
    for k, s in more.items():
        if k in out:
            _merge(out[k].fields, s.fields)
        else:
            out[k] = s


def _skip_type(c: Cursor) -> None:
    if c.take("["):
        _skip_type(c)
        c.expect("]")
    else:
        c.name()
    c.take("!")


class Executor:
    def __init__(self, store: Store, access=None, events: DataFrame | None = None):
        self.store, self.reader = store, Reader(store)
        self.relations = Relations(self.reader)
        self.access, self.events = access, events
        self.log: list[tuple[str, str, DataFrame]] = []  # (type, mutation, rows)

    def run(self, text: str, variables: dict | None = None, operation: str | None = None) -> dict[str, DataFrame]:
        """A lazy frame per root field. Mutations replace the store's frames and append to ``log``."""
        ops = parse(text, variables)
        chosen = [o for o in ops if operation in (None, o.name)]
        if len(chosen) != 1:
            raise SchemaError("name one operation")
        return {alias: self._root(s) for alias, s in chosen[0].fields.items()}

    def _root(self, s: Selection) -> DataFrame:
        a = dict(s.args)
        if s.field == "search":
            return self._knn(a["vector"], a.get("k", 10))
        if s.field == "hybridSearch":
            return self._hybrid(a["vector"], a["text"], a["field"], a.get("k", 10))
        if s.field == "bulkCheckPermission":
            checks = [(c["entityType"], int(c["entityId"]), c["permission"]) for c in a["checks"]]
            subjects = {int(c["subjectId"]) for c in a["checks"]}
            if len(subjects) != 1:
                raise SchemaError("bulkCheckPermission takes the checks of one subject")
            return self.access.check(checks, *subjects)
        if s.field == "event":
            return subscribe(self.events, a.get("types"))
        for verb in ("query", "get", "count", "aggregate", "create", "update", "delete"):
            name = s.field.removeprefix(verb)
            if s.field.startswith(verb) and name in self.store.catalog.types:
                return getattr(self, "_" + verb)(name, a, s)
        raise SchemaError(f"unknown root field {s.field}")

    def _query(self, name: str, a: dict, s: Selection) -> DataFrame:
        rename = {"nearVector": "near_vector"}
        flt, specs = self._text(a.get("filter"))
        args = {rename.get(k, k): v for k, v in a.items() if k != "filter"}
        if isinstance(args.get("after"), str):
            args["after"] = int(args["after"], 0)
        selection = Selection(fields=s.fields or {"uid": Selection("uid")})
        if not specs:
            return self.relations.select(name, selection, filter=flt, **args)
        rows = self.reader.rows(name, flt, args.get("where"))
        page = None if args.get("first") is None or a.get("sort") else args["first"] + (args.get("offset") or 0)
        if args.get("near_vector") is not None:
            # the heaviest text condition is fused with the vector, the others must hold too
            specs = sorted(specs, key=lambda s: (-s.boost, s.field, s.op))
            first, *others = search.scores(rows, specs)
            near = self._near(name, rows, args["near_vector"], args.get("metric", "l2"))
            for other in others:
                first, near = (x.join(other.select("uid"), "uid", "left_semi") for x in (first, near))
            found = rows.join(search.fuse(first, near, page, depth=None), "uid")
        elif len(specs) == 1:
            found = search.search(rows, specs[0])
        else:
            found = rows.join(search.multi_rrf(rows, specs, page, depth=None), "uid")
        keys = [F.col(k).desc_nulls_last() if d.upper() == "DESC" else F.col(k).asc_nulls_first() for k, d in (a.get("sort") or {}).items()]
        found = found.orderBy(*(keys or [F.desc("_score")]), "uid")
        if args.get("offset"):
            found = found.offset(args["offset"])
        if args.get("first") is not None:
            found = found.limit(args["first"])
        return self.relations.nest(found, name, selection)

    @staticmethod
    def _text(flt: dict | None) -> tuple[dict | None, list[search.Spec]]:
        """Top-level text conditions rank the result; others stay predicates."""
        specs, rest = [], {}
        for name, value in (flt or {}).items():
            ops = {k: v for k, v in value.items() if k in TEXT or k == "trigram"} if isinstance(value, dict) else {}
            specs += [search.Spec(name, "trigram" if value.get("strategy") == "trigram" else op, q, value.get("boost", 1.0)) for op, q in ops.items()]
            left = {k: v for k, v in value.items() if k not in ops and k not in ("boost", "strategy")} if ops else value
            if left or not ops:
                rest[name] = left
        return rest or None, specs

    def _get(self, name: str, a: dict, s: Selection) -> DataFrame:
        uid = a.pop("uid", None) or a.pop("id", None)
        row = self.reader.get(name, uid) if uid is not None else self.reader.get(name, **a)
        return self.relations.nest(row, name, Selection(fields=s.fields or {"uid": Selection("uid")}))

    def _count(self, name: str, a: dict, s: Selection) -> DataFrame:
        return self.reader.count(name, a.get("filter"))

    def _aggregate(self, name: str, a: dict, s: Selection) -> DataFrame:
        return self.reader.facet(name, a["groupBy"], a.get("filter"), a.get("limit"))

    def _vectors(self) -> list[tuple[str, str]]:
        return [(t.name, f) for t in self.store.catalog.types.values() if t.name in self.store.frames for f in t.with_directive("vector")]

    def _near(self, name: str, rows: DataFrame, v: list[float], metric: str) -> DataFrame:
        """(uid, _distance) of the rows by their own vector, or by the nearest one that a relation of the type leads to."""
        own = self.store.catalog[name].with_directive("vector")
        if own:
            return vector.ranked(rows, own[0], v, metric).select("uid", "_distance")
        for f in self.store.catalog[name].fields.values():
            if self.store.catalog.is_relation(f) and (fields := self.store.catalog[f.base].with_directive("vector")):
                far = vector.ranked(self.store.frame(f.base), fields[0], v, metric).select(F.col("uid").alias("dst"), "_distance")
                pairs = self.store.pairs(name, f.name).join(rows.select(F.col("uid").alias("src")), "src", "left_semi")
                return pairs.join(far, "dst").groupBy(F.col("src").alias("uid")).agg(F.min("_distance").alias("_distance"))
        raise SchemaError(f"{name} has no vector, nor has a type that it leads to")

    def _knn(self, v: list[float], k: int) -> DataFrame:
        """Over every type that has a vector field."""
        parts = [vector.nearest(self.store.frame(t), f, v, k).select("uid", F.col("_distance").alias("distance")) for t, f in self._vectors()]
        return reduce(lambda a, b: a.union(b), parts).orderBy("distance", "uid").limit(k)

    def _hybrid(self, v: list[float], text: str, name: str, k: int) -> DataFrame:
        owners = [t for t in self.store.catalog.types.values() if t.name in self.store.frames and name in t.fields and "search" in t.fields[name].directives]
        if not owners or not self._vectors():
            raise SchemaError(f"no type has a searchable field {name}, or none a vector")
        both = lambda a, b: a.union(b)
        found = reduce(both, (search.bm25(self.store.frame(t.name), name, text) for t in owners))
        near = reduce(both, (vector.ranked(self.store.frame(t), f, v).select("uid", "_distance") for t, f in self._vectors()))
        best = near.groupBy("uid").agg(F.min("_distance").alias("_distance"))
        return search.fuse(found.groupBy("uid").agg(F.max("_score").alias("_score")), best, k).select("uid", F.col("_score").alias("distance"))

    def _create(self, name: str, a: dict, s: Selection) -> DataFrame:
        frame = self.store.frames[name]
        given = a["input"] if isinstance(a["input"], list) else [a["input"]]
        rows = [tuple(r.get(c) for c in frame.columns) for r in given]
        good, bad = writes.insert(self.store, name, self.store.spark.createDataFrame(rows, frame.schema))
        refused = bad.select("reasons").take(1)
        if refused:
            raise SchemaError(f"refused: {refused[0][0]}")
        self.store.frames[name] = frame.unionByName(good)
        self.log.append((name, "create", good))
        return self.relations.nest(good, name, Selection(fields=s.fields or {"uid": Selection("uid")}))

    def _update(self, name: str, a: dict, s: Selection) -> DataFrame:
        frame, uid = self.store.frames[name], int(str(a["uid"]), 0)
        schema = frame.select("uid", *a["input"]).schema
        gone = [f for f, x in a["input"].items() if x is None]
        change = self.store.spark.createDataFrame([(uid, *a["input"].values())], schema)
        known = frame.filter(F.col("uid") == uid)
        clear = F.array(*map(F.lit, gone)) if gone else F.array().cast("array<string>")
        self.store.frames[name] = writes.update(frame, change.withColumn("_clear", clear), clear="_clear")
        self.log.append((name, "update", change))
        return known.agg((F.count(F.lit(1)) > 0).alias("ok"))

    def _delete(self, name: str, a: dict, s: Selection) -> DataFrame:
        uid = int(str(a["uid"]), 0)
        ids = self.store.frames[name].filter(F.col("uid") == uid).select("uid")
        ok = ids.agg((F.count(F.lit(1)) > 0).alias("ok"))
        for t, gone in writes.cascade(self.store, name, ids).items():
            if t in self.store.frames:
                self.store.frames[t] = writes.delete(self.store.frames[t], gone)
                self.log.append((t, "delete", gone))
        return ok


def explain(df: DataFrame, request: object = None) -> str:
    """The request as lowered and the physical plan that Spark made of it."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return (f"== Request ==\n{request}\n" if request is not None else "") + plan
