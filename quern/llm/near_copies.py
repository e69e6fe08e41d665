"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose pairs, exact sets decide them.

Texts whose sets of ``WIDTH``-word shingles have a similarity of ``SIMILARITY`` or more are linked. Every distinct set is
a node with a SimHash fingerprint. First the BK-trees of :mod:`quern.llm.simhash` link the fingerprints within its radius,
and the links whose sets are similar are kept. That radius is reached by few of the pairs at the threshold, and a forest
names only some of the pairs within it, so bands propose the others: every node falls into ``BANDS`` buckets, each keyed by ``DEPTH`` minima of hashes; a pair at the threshold misses all of
them with probability (1 - 0.8 ** 5) ** 32, three in a million, and a closer pair less often. No proposed pair is taken
for linked or left out unseen: each is either compared exactly, or lies in one component already, or cannot be similar.
So that a large group of copies does not cost all its pairs, a bucket's nodes are compared with one pivot first,
``PIVOTS`` times: at first the node whose buckets hold most nodes, as the text that the copies of a group were made from
has, then another. The nodes of buckets that are left with more than one component are joined on the rarest of their
shingles, see :func:`across`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.components import components
from quern.llm.simhash import shingle_hashes
from quern.llm.tables import fresh, split_join, staged, text_or_empty

WIDTH = 5
#: Numerator and denominator, so that the comparison is one of integers.
SIMILARITY = (4, 5)
BANDS, DEPTH = 32, 5
PIVOTS = 2
MIX = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * DEPTH), np.uint64)
MIX[0] |= np.uint64(1)


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes in order; a text with fewer than ``width`` words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(data, width))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILARITY[1] >= (len(a) + len(b) - both) * SIMILARITY[0]


def bands(s: np.ndarray) -> list[int]:
    """Bucket keys of a set; an empty set has none."""
    if not len(s):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):  # bounded memory for very long texts
        least = np.minimum(least, ((s[at : at + 4096, None] ^ MIX[1]) * MIX[0]).min(axis=0))
    return [xxhash.xxh64_intdigest(part.tobytes(), k) for k, part in enumerate(least.reshape(BANDS, DEPTH))]


def row_key(doc_id: str, text: str) -> Column:
    """Rows with the same id and text share it; null text counts as empty."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), text_or_empty(text)), 256))


def _sketch(batches):
    for b in batches:
        sets = [shingle_set(t or b"") for t in b.column(2).cast(pa.binary()).to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
        keys = [bands(s) for s in sets]
        flat = np.array([k for ks in keys for k in ks], np.uint64).view(np.int64)
        cuts = np.r_[0, np.cumsum([len(ks) for ks in keys], dtype=np.int64)].astype(np.int32)
        fp = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(fp), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], ["row", "doc_id", "node", "fp", "bands"])


def _sets(batches):
    for b in batches:
        sets = [shingle_set(t or b"").tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])


def _verify(batches):
    for b in batches:
        x, y = (b.column(k).to_pylist() for k in (2, 3))
        yes = np.array([similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) for s, t in zip(x, y)], bool)
        yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(yes)) for k in (0, 1)], ["a", "b"])


def _spread(batches):
    """(node, root, shingles) to a row per shingle: node, root, n, h."""
    for b in batches:
        for node, root, data in zip(*(b.column(k).to_pylist() for k in range(3))):
            h = np.frombuffer(data, np.uint64).view(np.int64)
            n = len(h)
            yield pa.RecordBatch.from_arrays([pa.array([node] * n, pa.int64()), pa.array([root] * n, pa.int64()), pa.array([n] * n, pa.int32()), pa.array(h)], ["node", "root", "n", "h"])


def across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different roots among ``members`` (node, root) that can be similar, without a miss.

    The shingles of a set are put in the order of their frequency. Sets of n shingles that are similar share one of their
    first n - ceil(0.8 n) + 1, and where the first common one stands bounds what they can share. So texts with a frequent
    passage and words of their own meet nowhere, and of texts that meet only pairs within the bound come out of the join.
    """
    num, den = SIMILARITY
    shingled = staged(sets.join(members.select("node", "root").distinct(), "node").select("node", "root", "shingles").mapInArrow(_spread, "node long, root long, n int, h long"), "shingled")
    counts = staged(shingled.groupBy("h").agg(F.count("*").alias("count")), "frequencies")
    ordered = split_join(shingled, counts, ["h"]).groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("count", "h"))).alias("all"))
    first = F.slice("all", 1, F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int") + 1)
    keys = ordered.select("node", "root", "n", F.posexplode(first).alias("at", "x")).filter("x.count > 1").select("node", "root", "n", "at", F.col("x.h").alias("h"))
    x = staged(keys, "prefixes")
    y = x.select(*(F.col(c).alias(f"_{c}") for c in x.columns))
    shared = F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))
    close = shared * (num + den) >= (F.col("n") + F.col("_n")) * num
    pairs = x.join(y, (F.col("h") == F.col("_h")) & (F.col("node") < F.col("_node")) & (F.col("root") != F.col("_root")) & close)
    return pairs.select(F.col("node").alias("a"), F.col("_node").alias("b"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(f"_{n}"), F.col("shingles").alias(f"of_{n}")) for n in "ab")
    with_a = staged(pairs.distinct(), "pairs").join(left, F.col("a") == F.col("_a")).select("a", "b", "of_a")
    return with_a.join(right, F.col("b") == F.col("_b")).select("a", "b", "of_a", "of_b").mapInArrow(_verify, "a long, b long")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of ``rows`` (node, fp, bands) that connect all whose fingerprints are linked by BK-trees: the
    edges of their forests, from the least node of each fingerprint, which the others of that fingerprint are paired with.
    A set without shingles has no pair."""
    nodes = staged(rows.filter(F.size("bands") > 0).select("node", "fp").distinct(), "node-fingerprints")
    least = staged(nodes.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    of = [least.select(F.col("fp").alias(f"_{n}"), F.col("least").alias(f"of_{n}")) for n in "ab"]
    links = staged(simhash.linked(least.select("fp")).distinct(), "fingerprint-links")
    trees = links.join(of[0], F.col("a") == F.col("_a")).join(of[1], F.col("b") == F.col("_b")).select(*_ordered("of_a", "of_b"))
    equal = nodes.join(least.withColumnRenamed("fp", "_fp"), F.col("fp") == F.col("_fp")).filter("node <> least").select(*_ordered("node", "least"))
    return trees.union(equal)


def groups(docs: DataFrame, rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, root) for every node of ``rows`` that has a link."""
    near = staged(by_fingerprint(rows), "near-fingerprints")
    buckets = rows.select(F.explode("bands").alias("bucket"), "node")
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("_least"), F.max("node").alias("_most")).filter("_least <> _most").select("bucket")
    members = staged(buckets.join(shared, "bucket", "left_semi").distinct(), "buckets")
    sizes = staged(members.groupBy("bucket").agg(F.count("*").alias("_n")), "bucket-sizes")
    weights = staged(members.join(sizes, "bucket").groupBy("node").agg(F.sum("_n").alias("weight")), "weights")
    members = staged(members.join(weights, "node"), "members")
    asked = members.select("node").union(near.select("a")).union(near.select("b")).distinct()
    of_node = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    texts = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text")).join(staged(of_node, "of-node"), "row")
    sets = staged(texts.select("node", "text").mapInArrow(_sets, "node long, shingles binary").dropDuplicates(["node"]), "sets")
    edges = staged(linked(near, sets), "links")
    roots = staged(components(edges), "roots")
    for k in range(PIVOTS + 1):
        named = members.join(roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"), "left").select("bucket", "node", "weight", F.coalesce("root", "node").alias("root"))
        named = staged(named, "named")
        order = F.struct(-F.col("weight") if k == 0 else F.xxhash64("node", F.lit(k)), "node")
        pivot = F.min_by(F.struct("node", "root"), order).alias("pivot")
        open_ = named.groupBy("bucket").agg(F.min("root").alias("_least"), F.max("root").alias("_most"), pivot).filter("_least <> _most")
        open_ = staged(open_.select("bucket", F.col("pivot.node").alias("_pivot"), F.col("pivot.root").alias("_root")), "open")
        if open_.isEmpty():
            break
        if k < PIVOTS:
            pairs = named.join(open_, "bucket").filter("root <> _root").select(*_ordered("node", "_pivot"))
        else:
            pairs = across(named.join(open_, "bucket", "left_semi").drop("weight"), sets)
        edges = staged(edges.union(linked(pairs, sets)), "links")
        roots = staged(components(edges), "roots")
    return roots


def keep_one_of_each_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component of linked texts one row, that with the smallest id, with all its columns.

    A-Z is lowered, words are runs outside space and bytes 9 to 13. A null id comes after all others; null and wordless
    texts are copies of one another. Of rows that share the smallest id, one stays. An empty table gives an empty result;
    texts of any length are compared whole.
    """
    rows = docs.select(row_key(doc_id, text).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(rows.mapInArrow(_sketch, "row binary, doc_id long, node long, fp long, bands array<long>"), "sketches")
    roots = groups(docs, rows, doc_id, text).select(F.col("node").alias("_node"), "root")
    of_row = rows.join(roots, F.col("node") == F.col("_node"), "left").select("row", "doc_id", F.coalesce("root", "node").alias("root"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    key, mark = fresh(docs, "_row", "_mark")
    kept = staged(of_row.groupBy("root").agg(first).select(F.col("first.row").alias(key)), "kept")
    once = docs.withColumn(mark, row_key(doc_id, text)).dropDuplicates([mark])  # rows repeated with their id
    return once.join(kept, F.col(mark) == F.col(key), "left_semi").select(*docs.columns)
