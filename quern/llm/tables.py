"""Inputs, hand-over tables and small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the space and the five ASCII controls 9 to 13; ``bytes.split()`` cuts there too.
WORD = r"[^\x20\x09-\x0D]+"
#: Lowers A-Z and no other byte; UTF-8 sequences are left alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that names none (tests on one machine) gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, so a lost executor costs a re-read and not a recomputation, and gives the optimiser the
    table's true size. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Keys with more than this share of the rows are broadcast by :func:`split_join`; there are fewer than HOT of them.
HOT = 4096


def split_join(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found`` on ``keys``: one row for each key, with ``count``, at most the number of rows that have it.

    Keys with over 1 / HOT of the rows -- fewer than HOT, as the counts sum up to no more than the rows -- are broadcast and
    joined where the rows are read; only rows of the other keys are shuffled. ``how`` is inner or left; rows with a null key
    match nothing and are not shuffled either. Both sides should be written tables, as they are read twice.
    """
    limit = rows.count() / HOT
    hot, rest = F.broadcast(found.filter(F.col("count") > limit)), found.filter(F.col("count") <= limit)
    some = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    out = rows.join(hot, keys).unionByName(rows.filter(some).join(hot.select(*keys), keys, "left_anti").join(rest, keys, how))
    return out if how == "inner" else out.unionByName(rows.filter(~some), allowMissingColumns=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold_of(name: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % folds
