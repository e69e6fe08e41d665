"""Change logs: last write wins per cell, tombstones, order-independent fingerprints, differences of two logs.

A log has the columns uid, field, value, ts (struct of millis, counter, node) and deleted. Structs compare field by
field, which is the clock's order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TS = "struct<millis:bigint,counter:int,node:bigint>"
LOG = f"uid bigint, field string, value string, ts {TS}, deleted boolean"


@dataclass
class Clock:
    """A hybrid logical clock: wall milliseconds, a counter for equal ones, the node."""

    node: int
    millis: int = 0
    counter: int = 0

    def send(self, now: int | None = None) -> tuple[int, int, int]:
        now = int(time.time() * 1000) if now is None else now
        self.millis, self.counter = (now, 0) if now > self.millis else (self.millis, self.counter + 1)
        return self.millis, self.counter, self.node

    def receive(self, ts: tuple[int, int, int], now: int | None = None) -> tuple[int, int, int]:
        now = int(time.time() * 1000) if now is None else now
        latest = max(now, self.millis, ts[0])
        if latest == self.millis == ts[0]:
            self.counter = max(self.counter, ts[1]) + 1
        elif latest == self.millis:
            self.counter += 1
        elif latest == ts[0]:
            self.counter = ts[1] + 1
        else:
            self.counter = 0
        self.millis = latest
        return self.millis, self.counter, self.node


def merge_cells(log: DataFrame, keys: tuple[str, ...] = ("uid", "field"), ts: str = "ts", keep_deleted: bool = False) -> DataFrame:
    """The newest row per cell. Partial maxima are taken before the shuffle; repeated and reordered rows change nothing.
    Of rows with equal time the greater in the order of the other columns stays."""
    rest = [c for c in log.columns if c not in keys and c != ts]
    best = log.groupBy(*keys).agg(F.max(F.struct(ts, *rest)).alias("_best"))
    out = best.select(*keys, *(F.col("_best")[c].alias(c) for c in (ts, *rest))).select(*log.columns)
    return out.filter(~F.col("deleted")) if "deleted" in log.columns and not keep_deleted else out


def upsert(state: DataFrame, changes: DataFrame, **options) -> DataFrame:
    return merge_cells(state.unionByName(changes), **options)


def drop_deleted_nodes(log: DataFrame, marker: str = "_type") -> DataFrame:
    """Cells of the nodes whose marker field is not deleted; field tombstones of deleted nodes go with them."""
    cells = merge_cells(log, keep_deleted=True)
    gone = cells.filter((F.col("field") == marker) & F.col("deleted")).select("uid")
    return cells.join(gone, "uid", "left_anti").filter(~F.col("deleted"))


def to_frame(cells: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per uid with the named fields, cast to their types."""
    return cells.groupBy("uid").agg(*(F.max(F.when(F.col("field") == n, F.col("value"))).cast(t).alias(n) for n, t in fields.items()))


def history(log: DataFrame, start: tuple[int, int, int], end: tuple[int, int, int], ts: str = "ts") -> DataFrame:
    """Entries from ``start`` to ``end``, both included, in the clock's order (millis, counter, node)."""
    stamp = lambda t: F.struct(F.lit(t[0]).cast("bigint").alias("millis"), F.lit(t[1]).cast("int").alias("counter"), F.lit(t[2]).cast("bigint").alias("node"))
    near = F.col(f"{ts}.millis").between(start[0], end[0])  # reaches the scan
    return log.filter(near & (F.col(ts) >= stamp(start)) & (F.col(ts) <= stamp(end)))


def apply_batch(state: DataFrame, batch: DataFrame, marker: str = "_type") -> tuple[DataFrame, DataFrame]:
    """A remote batch on a state: (state after it, events). Entries older than the state's change nothing; a deleted node's
    other tombstones are dropped; each node has one event, for the entries that took effect, with their latest time."""
    cells = merge_cells(state.unionByName(batch), keep_deleted=True)
    gone = cells.filter((F.col("field") == marker) & F.col("deleted")).select("uid")
    mine = cells.filter(~(F.col("deleted") & (F.col("field") != marker))).unionByName(cells.filter(F.col("deleted") & (F.col("field") != marker)).join(gone, "uid", "left_anti"))
    won = batch.dropDuplicates().join(cells.select("uid", "field", "ts"), ["uid", "field", "ts"], "left_semi").select(*batch.columns)
    old = state.select("uid", "field", "ts")
    return mine, coalesced_events(won.join(old, ["uid", "field", "ts"], "left_anti").select(*batch.columns))


def with_rejects(parked: DataFrame, batch: DataFrame, valid: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to apply, entries to park): parked ones are tried again with every batch. ``valid`` is an SQL condition of an
    entry's columns and ``known``: whether its uid is among ``known`` or gets its type row in these entries."""
    every = parked.unionByName(batch)
    typed = every.filter("field = '_type' AND NOT deleted").select("uid").union(known.select("uid")).distinct().withColumn("known", F.lit(True))
    told = every.join(typed, "uid", "left").withColumn("known", F.coalesce("known", F.lit(False))).withColumn("_ok", F.coalesce(F.expr(valid), F.lit(False)))
    return told.filter("_ok").select(*every.columns), told.filter("NOT _ok").select(*every.columns)


def fingerprints(log: DataFrame, bucket: Column, *columns: str, item: Column | None = None) -> DataFrame:
    """(bucket, n, fingerprint): count and XOR of the rows' hashes, or of ``item``, whatever their order."""
    return log.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns) if item is None else item).alias("fingerprint"))


def differences(a: DataFrame, b: DataFrame, bucket: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``a`` that ``b`` lacks and the other way, compared only in buckets whose fingerprints differ.
    ``bucket`` is an SQL expression of both logs."""
    fa = fingerprints(a, F.expr(bucket), *columns).withColumnsRenamed({"n": "na", "fingerprint": "fa"})
    fb = fingerprints(b, F.expr(bucket), *columns).withColumnsRenamed({"n": "nb", "fingerprint": "fb"})
    differ = fa.join(fb, "bucket", "full").filter(~(F.col("na").eqNullSafe(F.col("nb")) & F.col("fa").eqNullSafe(F.col("fb")))).select("bucket")
    part = lambda x: x.withColumn("bucket", F.expr(bucket)).join(differ, "bucket", "left_semi").drop("bucket")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns]
    only = lambda x, y: x.alias("x").join(y.alias("y"), same, "left_anti")
    return only(part(a), part(b)), only(part(b), part(a))


def repair(a: DataFrame, b: DataFrame, bucket: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Both logs after each got the entries that it lacked; only buckets whose fingerprints differ are compared."""
    only_a, only_b = differences(a, b, bucket, *columns)
    return a.unionByName(only_b.select(*a.columns)), b.unionByName(only_a.select(*b.columns))


def coalesced_events(log: DataFrame) -> DataFrame:
    """One event per uid of a batch: its latest time, its changed fields, and whether the node went."""
    newest = merge_cells(log, keep_deleted=True)
    return newest.groupBy("uid").agg(
        F.max("ts").alias("ts"),
        F.max(((F.col("field") == "_type") & F.col("deleted")).cast("int")).cast("boolean").alias("removed"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("deleted"), F.struct("field", "value"))))).alias("payload"),
    )
