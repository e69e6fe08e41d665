"""SimHash near-duplicates: fingerprints linked within a Hamming radius by BK-trees over shards.

Two fingerprints that differ in at most ``RADIUS`` = 2 of 64 bits agree in at least two of four 16-bit quarters, so
every link lies inside one of six shards whose key is a pair of quarters with their values. Each shard's distinct
fingerprints form a BK-tree: a node's children are keyed by their integer Hamming distance to it, and a search follows
only the edges within the radius of its own distance. Trees are dealt to the tasks by shard key and not broadcast: all
trees together grow with the corpus, and a broadcast must not. A shard gives the edges of a spanning forest, fewer than
it has members, never all pairs; equal fingerprints are one node whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import components
from quern.llm.tables import LOWER, staged

WIDTH = 3
RADIUS = 2
#: A larger shard is cut again by the bits outside its key, in RADIUS + 1 bands of which a linked pair shares one: before
#: the shuffle if it has more than a LARGE-th of all entries, else in its task.
SPLIT, LARGE = 4096, 4096
QUARTERS = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def shingle_hashes(data: bytes, width: int = WIDTH) -> np.ndarray:
    words = data.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(s), 42) for s in zip(*(words[i:] for i in range(width)))), np.uint64, len(words) - width + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; without any: 0."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    return majority(shingle_hashes(data, width))


class BKTree:
    """Distinct 64-bit values; children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Indexes of the values within ``radius``."""
        found, stack = [], [0] if self.values else []
        while stack:
            k = stack.pop()
            d = (self.values[k] ^ value).bit_count()
            if d <= radius:
                found.append(k)
            below = self.children[k]
            if below:
                stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        k = 0
        while k != new:
            k = self.children[k].setdefault((self.values[k] ^ value).bit_count(), new)
        return new


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links ``values`` (distinct) within ``radius``."""
    tree, up, edges = BKTree(), list(range(len(values))), []

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for v in values:
        near = tree.near(v, radius)
        new = tree.add(v)
        for k in near:
            if (r := root(k)) != (s := root(new)):
                up[max(r, s)] = min(r, s)
                edges.append((values[k], v))
    return edges


def shard_edges(values: np.ndarray, outside: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links within one shard; ``outside`` are the bits that its key does not fix."""
    if len(values) <= SPLIT or len(outside) <= radius:
        return forest(values.tolist(), radius)
    edges = []
    for band in np.array_split(np.array(outside), radius + 1):
        mask = np.uint64(sum(1 << int(b) for b in band))
        left = [b for b in outside if b not in set(band.tolist())]
        order = np.argsort(values & mask, kind="stable")
        cuts = np.flatnonzero(np.diff((values & mask)[order])) + 1
        for part in np.split(values[order], cuts):
            if len(part) > 1:
                edges += shard_edges(part, left, radius)
    return edges


def band_bits(pair: int) -> list[list[int]]:
    """The bits that a shard's key does not fix, in RADIUS + 1 bands of which a linked pair shares one."""
    outside = [bit for q in range(4) if q not in QUARTERS[pair] for bit in range(16 * q, 16 * q + 16)]
    return [x.tolist() for x in np.array_split(np.array(outside), RADIUS + 1)]


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, band, value, fp) in the order of shard, band and value to links; a shard may span batches. Band -1 stands for a whole shard."""

    def out(edges):
        a = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    def links(key: tuple, parts: list[np.ndarray]) -> list[tuple[int, int]]:
        values, bands = np.concatenate(parts), band_bits(key[0] >> 32)
        return shard_edges(values, [bit for k, bits in enumerate(bands) if k != key[1] for bit in bits]) if len(values) > 1 else []

    now, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        v = batch.column(3).to_numpy().view(np.uint64)
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(v)] if len(v) else [0]
        edges = []
        for x, y in zip(cuts[:-1], cuts[1:]):
            if (key := tuple(keys[x].tolist())) != now:
                edges += links(now, held) if held else []
                now, held = key, []
            held.append(v[x:y])
        yield out(edges)
    if held:
        yield out(links(now, held))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fp = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def linked(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fp`` within ``RADIUS``, as a union of spanning forests.

    A shard with more than SPLIT fingerprints, and more than a LARGE-th of all entries, is dealt by the values of its bands
    before it is shuffled, so that no task gets it whole; there are fewer than LARGE such shards, whose keys are broadcast.
    """
    quarter = [F.shiftrightunsigned(F.col("fp"), 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    keys = [F.lit(k << 32).bitwiseOR(F.shiftleft(quarter[a], 16)).bitwiseOR(quarter[b]) for k, (a, b) in enumerate(QUARTERS)]
    shards = fps.select(F.explode(F.array(*keys)).alias("shard"), "fp")
    most = max(SPLIT, len(QUARTERS) * fps.count() // LARGE)
    large = F.broadcast(staged(shards.groupBy("shard").count().filter(F.col("count") > most).select("shard"), "large-shards"))
    whole = shards.join(large, "shard", "left_anti").select("shard", F.lit(-1).cast("long").alias("band"), F.lit(0).cast("long").alias("value"), "fp")
    masks = [[sum(1 << b for b in bits) for bits in band_bits(k)] for k in range(len(QUARTERS))]
    signed = F.array(*(F.array(*(F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in row)) for row in masks))
    of = shards.join(large, "shard", "left_semi").withColumn("_m", F.get(signed, F.shiftright("shard", 32).cast("int")))
    cut = of.select("shard", F.posexplode("_m").alias("band", "_mask"), "fp").select("shard", F.col("band").cast("long").alias("band"), F.col("fp").bitwiseAND(F.col("_mask")).alias("value"), "fp")
    dealt = whole.union(cut).repartition("shard", "band", "value").sortWithinPartitions("shard", "band", "value")
    return dealt.mapInArrow(_link_shards, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest reachable id).

    A-Z is lowered, words are runs outside space and bytes 9 to 13, shingles are ``width`` words (a shorter text: all its
    words), repeats included. Null and wordless texts have fingerprint zero and link like any other. Null ids are skipped
    by the minimum; a component of nulls only has a null id. Repeated rows are linked as copies. An empty table gives an
    empty result. Only the two named columns are read.
    """
    rows = staged(fingerprints(docs, doc_id, text, width), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    member = staged(components(linked(nodes.select("fp"))), "members")
    least = member.join(nodes, member.node == nodes.fp).groupBy("root").agg(F.min("least").alias("component_id"))
    least = staged(least, "component-ids").withColumnRenamed("root", "_root")
    of_node = member.join(least, F.col("root") == F.col("_root")).select("node", "component_id")
    class_of = staged(nodes.join(of_node, nodes.fp == of_node.node, "left").select(F.col("fp").alias("_fp"), F.coalesce("component_id", "least").alias("component_id")), "classes")
    return rows.join(class_of, rows.fp == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
