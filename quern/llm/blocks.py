"""Blocks: bundles of whole documents that a task handles at once, and packed columns of numbers that blocks exchange."""

from __future__ import annotations

import ctypes
import gc
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block; a longer text is a block of its own.
SIZE = 16 << 20


def pack_numbers(x: np.ndarray) -> bytes:
    """uint64 values as compressed byte planes; small values cost little."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_numbers(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_numbers(data), dtype=np.uint64)


def released(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, giving the memory it has freed back to the system at the end of a task: workers stay for
    later tasks, and count to their executor's memory meanwhile."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
            trim(0)

    return task


def acyclic(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, which makes many lists and no cycles: Python need not search them again and again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()

    return task


def blocks_of(batches: Iterator[pa.RecordBatch], size: int, hold: Callable = lambda t: t) -> Iterator[tuple[int, int, list, list]]:
    """(block, part, ids, texts) from rows (doc_id, text, part) of a task, as :func:`bundle` numbers them; ``hold`` makes of
    each text what is held of it until its block is full."""
    task, made = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}
    full: dict[int, int] = {}

    def out(p):
        nonlocal made
        made += 1
        full.pop(p)
        ids, texts = zip(*held.pop(p))
        return task * (1 << 24) + made - 1, p, ids, texts

    for b in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
        for k, t, p in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist()):
            held.setdefault(p, []).append((k, hold(t or b"")))
            full[p] = full.get(p, 0) + len(t or b"") + 64
            if full[p] >= size:
                yield out(p)
    for p in sorted(held):
        yield out(p)


def bundle(docs: DataFrame, size: int = SIZE, part: str = "0", level: int = 3) -> DataFrame:
    """(block, part, blob) from docs (doc_id, text): every task bundles its rows up to ``size`` bytes, apart for each value
    of ``part``, an SQL expression of few values. Ids follow the task's number, so write the table before reading it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p, ids, texts in blocks_of(batches, size):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([p], pa.int32()), pa.array([pack_texts(ids, texts, level)], pa.binary())], ["block", "part", "blob"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.expr(part).cast("int").alias("part")).mapInArrow(released(run), "block long, part int, blob binary")


def pack_texts(ids, texts: list[bytes], level: int = 3) -> bytes:
    """Ids (None allowed) and texts."""
    n = len(ids)
    head = struct.pack("<q", n) + np.array([k is None for k in ids], np.uint8).tobytes() + np.array([k or 0 for k in ids], "<i8").tobytes() + np.array([len(t) for t in texts], "<i8").tobytes()
    out = zstandard.ZstdCompressor(level=level).compressobj(size=len(head) + sum(map(len, texts)))  # no second copy of the texts
    return b"".join([out.compress(head), *(out.compress(b"".join(texts[k : k + 256])) for k in range(0, n, 256)), out.flush()])


def unpack_texts(blob: bytes) -> tuple[list, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", data)
    none = np.frombuffer(data, np.uint8, n, 8)
    ids = np.frombuffer(data, "<i8", n, 8 + n).tolist()
    sizes = np.frombuffer(data, "<i8", n, 8 + 9 * n)
    at = np.r_[0, np.cumsum(sizes)] + 8 + 17 * n
    return [None if x else k for k, x in zip(ids, none)], [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def each_text(blob) -> Iterator[tuple[int | None, bytes]]:
    """(id, text) of what :func:`pack_texts` made, one after the other and decompressed as they are taken."""
    with zstandard.ZstdDecompressor().stream_reader(blob) as data:
        (n,) = struct.unpack("<q", data.read(8))
        none, ids, sizes = (np.frombuffer(data.read(n * np.dtype(kind).itemsize), kind).tolist() for kind in ("u1", "<i8", "<i8"))
        for x, k, size in zip(none, ids, sizes):
            yield None if x else k, data.read(size)
