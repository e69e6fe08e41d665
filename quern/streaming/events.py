"""Structured Streaming: subscriptions to change events, last-write-wins merging, and (as an extension) event-time windows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.changes import merge_cells

EVENT = "type string, uid bigint, mutation string, source string, payload string, ts timestamp"


def change_stream(spark: SparkSession, path: str, schema: str = EVENT, format: str = "json", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def subscribe(events: DataFrame, types: list[str] | None = None, column: str = "type") -> DataFrame:
    """Events of the named types; no names: all. Works on streams and on tables."""
    return events.filter(F.col(column).isin(types)) if types else events


def merge_into(target: str, keys: tuple[str, ...] = ("uid", "field"), ts: str = "ts", buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the newest row per cell in the Parquet table under ``target``.

    Rows are kept by a hash of the first key in ``buckets``. A batch reads and rewrites only the buckets that it touches,
    beside the old ones, and then writes a manifest that says which folder each bucket is in; a failed batch leaves the
    manifest before it, and a batch that is run again changes nothing, as merging is idempotent.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fs, path = _files(spark, target)
        found = versions(spark, target)
        at = _manifest(spark, target, found[-1]) if found else {}
        new = found[-1] + 1 if found else 0
        dealt = batch.withColumn("bucket", F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).cast("int"))
        touched = [str(r[0]) for r in dealt.select("bucket").distinct().collect()]  # at most `buckets` numbers
        old = [f"{target}/{at[b]}/bucket={b}" for b in touched if b in at]
        state = spark.read.schema(batch.schema).option("basePath", target).parquet(*old).select(*batch.columns).unionByName(batch) if old else batch
        folder = f"rows-{new:08d}"
        merged_ = merge_cells(state.select(*batch.columns), keys, ts, keep_deleted=True).withColumn("bucket", F.pmod(F.xxhash64(keys[0]), F.lit(buckets)).cast("int"))
        merged_.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/{folder}")
        out = fs.create(path(f"{target}/manifests/.{new:08d}"), True)
        out.write(bytearray(json.dumps({**at, **dict.fromkeys(touched, folder)}).encode()))
        out.close()
        fs.rename(path(f"{target}/manifests/.{new:08d}"), path(f"{target}/manifests/{new:08d}"))
        for v in found[:-1]:
            fs.delete(path(f"{target}/manifests/{v:08d}"), True)
        used = {f for v in versions(spark, target) for f in _manifest(spark, target, v).values()}
        for s in fs.listStatus(path(target)):
            name = s.getPath().getName()
            if name.startswith("rows-") and name not in used:
                fs.delete(s.getPath(), True)

    return run


def _files(spark: SparkSession, target: str):
    """(file system, path constructor)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, target: str) -> list[int]:
    """Complete versions of a merged table, oldest first."""
    fs, path = _files(spark, target)
    if not fs.exists(path(f"{target}/manifests")):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{target}/manifests"))]
    return sorted(int(n) for n in names if n.isdigit())


def _manifest(spark: SparkSession, target: str, version: int) -> dict[str, str]:
    """Bucket to folder."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{target}/manifests/{version:08d}").collect()))


def merged(spark: SparkSession, target: str) -> DataFrame:
    at = _manifest(spark, target, versions(spark, target)[-1])
    return spark.read.option("basePath", target).parquet(*(f"{target}/{folder}/bucket={b}" for b, folder in at.items())).drop("bucket")


def windowed_counts(events: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Extension: counts per tumbling window with a watermark; state for windows older than it is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"))
