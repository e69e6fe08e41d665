"""Writes as frames: validated inserts, updates, deletes with cascades, nested input, and their events.

Nothing is changed in place: each function takes frames and gives the rows to append to the log or the frame after the
write, and what was refused with the reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalars import CHECKS, directive_check, valid
from quern.sources.schema import Catalog, SchemaError
from quern.sources.staging import handed_over
from quern.sources.store import Store


def validated(catalog: Catalog, type_name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that satisfy required fields, scalars, enums and directives; the others with ``reasons``)."""
    reasons = []
    for f in catalog[type_name].fields.values():
        if f.compute:
            continue
        if f.name not in rows.columns:
            if f.required:
                reasons.append(F.lit(f"{f.name} is required"))
            continue
        c = F.col(f.name)
        checks = [(F.lit(not f.required) | c.isNotNull(), "is required")]
        if f.base in CHECKS and isinstance(rows.schema[f.name].dataType, (T.StringType, T.NumericType)) and not f.many:
            checks.append((valid(f.base, c), f"is no {f.base}"))
        if f.base in catalog.types and catalog[f.base].kind == "enum":
            checks.append((c.isNull() | c.isin(catalog[f.base].members), f"is no {f.base}"))
        checks += [(directive_check(n, a, c), f"fails @{n}") for n, a in f.directives.items() if n in ("regex", "length", "range")]
        reasons += [F.when(~ok, F.lit(f"{f.name} {why}")) for ok, why in checks]
    checked = rows.withColumn("reasons", F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def insert(store: Store, type_name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, refused rows with ``reasons``). A @unique value that exists already, or that a row with a smaller uid
    of the same batch has, refuses the row."""
    good, bad = validated(store.catalog, type_name, rows)
    have = store.frames.get(type_name)
    for name in store.catalog[type_name].with_directive("unique"):
        if name not in good.columns:
            continue
        first = good.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("_v")).agg(F.min("uid").alias("_first"))
        if have is not None and name in have.columns:
            first = first.join(have.select(F.col(name).alias("_v")), "_v", "left_anti")
        flagged = good.join(first, F.col(name) == F.col("_v"), "left").withColumn("_ok", F.col(name).isNull() | F.coalesce(F.col("_first") == F.col("uid"), F.lit(False))).drop("_v", "_first")
        bad = bad.unionByName(flagged.filter(~F.col("_ok")).drop("_ok").withColumn("reasons", F.array(F.lit(f"{name} is not unique"))))
        good = flagged.filter("_ok").drop("_ok")
    return good, bad


def update(frame: DataFrame, changes: DataFrame, clear: str | None = None) -> DataFrame:
    """``frame`` after partial updates: ``changes`` has uid and any fields; null means unchanged. ``clear`` names an array
    column of ``changes`` with the names of fields that become null. One change per uid."""
    new = changes.select(F.col("uid").alias("_uid"), *(F.col(c).alias(f"_new_{c}") for c in changes.columns if c != "uid"))
    joined = frame.join(new, F.col("uid") == F.col("_uid"), "left")
    out = []
    for c in frame.columns:
        value = F.coalesce(F.col(f"_new_{c}"), F.col(c)) if f"_new_{c}" in joined.columns else F.col(c)
        if clear and c != "uid":
            value = F.when(~F.coalesce(F.array_contains(f"_new_{clear}", c), F.lit(False)), value)
        out.append(value.alias(c))
    return joined.select(*out)


def link(store: Store, type_name: str, field: str, pairs: DataFrame) -> None:
    """Bind the pairs (src, dst) of a relation: list relations gain edges; a single relation is overwritten on its own side or
    on its inverse's, and of several targets of one source the greatest stays."""
    pairs = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    home, swap = _home(store, type_name, field)
    if swap:
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if home in store.edges:
        store.edges[home] = store.edges[home].union(pairs).distinct()
    else:
        store.frames[home[0]] = update(store.frames[home[0]], pairs.groupBy(F.col("src").alias("uid")).agg(F.max("dst").alias(home[1])))


def unlink(store: Store, type_name: str, field: str, pairs: DataFrame) -> None:
    """Take the pairs (src, dst) of a relation away; pairs that are not bound change nothing."""
    pairs = pairs.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))
    home, swap = _home(store, type_name, field)
    if swap:
        pairs = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if home in store.edges:
        store.edges[home] = store.edges[home].join(pairs, ["src", "dst"], "left_anti")
    else:
        frame, name = store.frames[home[0]], home[1]
        held = frame.select(F.col("uid").alias("src"), F.col(name).alias("dst")).join(pairs, ["src", "dst"], "left_semi")
        store.frames[home[0]] = update(frame, held.select(F.col("src").alias("uid"), F.array(F.lit(name)).alias("_gone")).distinct(), clear="_gone")


def _home(store: Store, type_name: str, field: str) -> tuple[tuple[str, str], bool]:
    """Where a relation's pairs are kept, (type, field), and whether they are kept there the other way round."""
    inverse = store.catalog.inverse(type_name, field)
    for at, swap in [((type_name, field), False), *([((inverse.type, inverse.field), True)] if inverse else [])]:
        if at in store.edges or at[0] in store.frames and at[1] in store.frames[at[0]].columns:
            return at, swap
    raise SchemaError(f"{type_name}.{field}: no column, edges or inverse to write to")


def delete(frame: DataFrame, uids: DataFrame) -> DataFrame:
    return frame.join(uids.select("uid"), "uid", "left_anti")


def cascade(store: Store, type_name: str, uids: DataFrame, most: int = 64) -> dict[str, DataFrame]:
    """Per type the uids that go when ``uids`` of ``type_name`` go, along @cascade fields; each once, cycles included. A chain of
    more than ``most`` levels is an error."""
    found = {type_name: handed_over(uids.select("uid").distinct(), "cascade")}
    frontier = dict(found)
    for _ in range(most):
        new: dict[str, list[DataFrame]] = {}
        for t, ids in frontier.items():
            for name in store.catalog[t].with_directive("cascade"):
                target = store.catalog[t].fields[name].base
                step = store.pairs(t, name).join(ids.withColumnRenamed("uid", "src"), "src", "left_semi").select(F.col("dst").alias("uid"))
                new.setdefault(target, []).append(step)
        frontier = {}
        for t, parts in new.items():
            ids = reduce(lambda a, b: a.union(b), parts).distinct()
            ids = handed_over(ids.join(found[t], "uid", "left_anti") if t in found else ids, "cascade")
            if not ids.isEmpty():
                frontier[t] = ids
                found[t] = found[t].union(ids) if t in found else ids
        if not frontier:
            return found
    raise SchemaError(f"the cascade from {type_name} does not end in {most} levels")


def flatten_nested(rows: DataFrame, field: str, parent_key: str = "uid", child_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Deep input: (parents without ``field``, the elements of its array or struct with the parent's uid as ``src``).
    Elements that carry only a uid link an existing node; others get one from the parent's uid and their place."""
    kind = rows.schema[field].dataType
    items = F.col(field) if isinstance(kind, T.ArrayType) else F.when(F.col(field).isNotNull(), F.array(field))
    children = rows.select(F.col(parent_key).alias("src"), F.posexplode(items).alias("_at", "_item")).select("src", "_at", "_item.*")
    key = child_key or "uid"
    own = F.xxhash64("src", F.lit(field), "_at").bitwiseAND(F.lit((1 << 63) - 1))
    children = children.withColumn(key, F.coalesce(F.col(key), own) if key in children.columns else own).drop("_at")
    return rows.drop(field), children


def cells(type_name: str, rows: DataFrame, ts: tuple[int, int, int]) -> DataFrame:
    """The rows as log entries, with the marker field ``_type``."""
    names = [c for c in rows.columns if c != "uid"]
    stamp = F.struct(F.lit(ts[0]).cast("bigint").alias("millis"), F.lit(ts[1]).cast("int").alias("counter"), F.lit(ts[2]).cast("bigint").alias("node"))
    entries = F.array(F.struct(F.lit("_type").alias("field"), F.lit(type_name).alias("value")), *(F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in names))
    return rows.select("uid", F.explode(entries).alias("c")).filter("c.value is not null").select("uid", "c.field", "c.value", stamp.alias("ts"), F.lit(False).alias("deleted"))


def events(type_name: str, kind: str, rows: DataFrame, source: str = "local") -> DataFrame:
    """Change events: creations and updates carry their fields, deletions nothing."""
    names = [c for c in rows.columns if c != "uid"]
    payload = F.lit(None).cast("string") if kind == "delete" else F.to_json(F.struct(*(names or ["uid"])))
    return rows.select(F.lit(type_name).alias("type"), "uid", F.lit(kind).alias("mutation"), F.lit(source).alias("source"), payload.alias("payload"))


def append_log(log: DataFrame, path: str, day: str = "ts.millis div 86400000") -> None:
    """Append log entries as JSON lines, in one folder for each value of ``day``, so that a time range reads only its days."""
    log.withColumn("day", F.expr(day)).write.mode("append").partitionBy("day").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries that :func:`append_log` wrote, with ``day``."""
    return spark.read.schema(schema + ", day bigint").json(path)


def file_rows(files: DataFrame, content: str = "content", path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Content-addressed files: (one row for each different content: sha256, length, content; a reference row for each file:
    uid, path, sha256, length)."""
    c = F.col(content)
    named = files.select(F.col(path).alias("path"), F.sha2(c, 256).alias("sha256"), F.octet_length(c).alias("length"), c.alias("content"))
    uid = F.xxhash64("path", "sha256").bitwiseAND(F.lit((1 << 63) - 1))
    return named.select("sha256", "length", "content").dropDuplicates(["sha256"]), named.select(uid.alias("uid"), "path", "sha256", "length")


def checksums(files: DataFrame, column: str = "content") -> DataFrame:
    """Content addresses of a binary column."""
    c = F.col(column)
    return files.withColumns({"md5": F.md5(c), "sha1": F.sha1(c), "sha256": F.sha2(c, 256), "sha512": F.sha2(c, 512), "length": F.octet_length(c)})
