"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014) over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import staged


def _stars(edges: DataFrame, hub: str, leaf: str) -> DataFrame:
    """Edges with ``least``: the smallest neighbour of the hub, itself included. Staged, so a hot hub's join can be split."""
    least = staged(edges.groupBy(F.col(hub).alias("_hub")).agg(F.min(leaf).alias("_m")), "least")
    return edges.join(least, edges[hub] == F.col("_hub")).select(hub, leaf, F.least(F.col(hub), F.col("_m")).alias("least"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges``, isolated ones left out; the root is the component's smallest node.

    Loops, repeated edges and nulls are dropped first. The number of rounds is logarithmic in the components' size.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").distinct()
    e = staged(e, "edges")
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(staged(both, "both"), "a", "b").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        e = staged(large.filter("a <> b").distinct(), "large")
        s = _stars(e, "a", "b")  # every edge points from the larger node to the smaller
        small = s.filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).union(s.select("a", F.col("least").alias("b")))
        e = staged(small.distinct(), "small")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
