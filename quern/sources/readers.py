"""Sources and sinks for typed rows: Parquet, ORC, CSV, JSON (also framed bulk input), JDBC and binary files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"parquet", "orc", "csv", "json", "text", "binaryFile", "jdbc"}


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """CSV and JSON need a schema: inferring one would read the data twice."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    if format in ("csv", "json") and schema is None:
        raise ValueError(f"{format} needs a schema")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "append", partition_by: list[str] | None = None, **options) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def frames_of(data: bytes, most: int = 50 << 20) -> Iterator[list[dict]]:
    """Bulk frames: a little-endian length of four bytes and a JSON array of {type_name, uid?, fields}."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("a frame's length is cut")
        (n,) = struct.unpack_from("<I", data, at)
        if n > most or at + 4 + n > len(data):
            raise ValueError("a frame is too long or cut")
        yield json.loads(data[at + 4 : at + 4 + n])
        at += 4 + n


def bulk(spark: SparkSession, path: str) -> DataFrame:
    """(type_name, uid, fields) of newline-delimited bulk records; fields as a map of texts."""
    return spark.read.schema("type_name string, uid bigint, fields map<string,string>").json(path)


def bulk_frame(records: DataFrame, type_name: str, fields: dict[str, str]) -> DataFrame:
    """The records of one type as typed rows; a missing uid is derived from the record."""
    own = records.filter(F.col("type_name") == type_name)
    uid = F.coalesce("uid", F.xxhash64(F.to_json("fields")).bitwiseAND(F.lit((1 << 63) - 1)))
    return own.select(uid.alias("uid"), *(F.col("fields")[n].cast(t).alias(n) for n, t in fields.items()))
