"""Bounded breadth-first traversal: one join per level for all nodes of the frontier, each level written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.staging import handed_over

MOST_DEPTH = 128


def levels(edges: DataFrame, roots: DataFrame, most: int = MOST_DEPTH, target: int | None = None) -> DataFrame:
    """(uid, depth, parent) of every node reached from ``roots`` (uid) over ``edges`` (src, dst): each once, at its least depth;
    the parent is the smallest node of the level before that leads to it. Stops early at ``target``."""
    if not 0 <= most <= MOST_DEPTH:
        raise ValueError(f"the depth must be within 0 and {MOST_DEPTH}")
    frontier = handed_over(roots.select("uid", F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("parent")).dropDuplicates(["uid"]), "level")
    found = [frontier]
    for depth in range(1, most + 1):
        seen = reduce(lambda a, b: a.union(b), found)
        if target is not None and not found[-1].filter(F.col("uid") == target).isEmpty():
            break
        new = edges.join(frontier.select(F.col("uid").alias("src")), "src").groupBy(F.col("dst").alias("uid")).agg(F.min("src").alias("parent"))
        new = new.join(seen.select("uid"), "uid", "left_anti").select("uid", F.lit(depth).alias("depth"), "parent")
        frontier = handed_over(new, "level")
        if frontier.isEmpty():
            break
        found.append(frontier)
        if len(found) % 8 == 0:  # one table for the levels so far keeps the plan short
            found = [handed_over(reduce(lambda a, b: a.union(b), found), "levels")]
    return reduce(lambda a, b: a.union(b), found)


def collect_all(edges: DataFrame, roots: DataFrame, least: int = 1, most: int = MOST_DEPTH) -> DataFrame:
    """All nodes at depth ``least`` or more, by uid."""
    return levels(edges, roots, most).filter(F.col("depth") >= least).select("uid").orderBy("uid")


def terminal(edges: DataFrame, roots: DataFrame, least: int = 1, most: int = MOST_DEPTH) -> DataFrame:
    """The deepest level that was reached, if that is ``least`` or deeper."""
    found = levels(edges, roots, most)
    deepest = found.agg(F.max("depth").alias("d")).scalar()
    return found.filter((F.col("depth") == deepest) & (F.col("depth") >= least)).select("uid").orderBy("uid")


def shortest_path(edges: DataFrame, roots: DataFrame, target: int, most: int = MOST_DEPTH) -> DataFrame:
    """(step, uid) from a root to the target along first-discovery parents; empty if it is not reached."""
    found = levels(edges, roots, most, target)
    at = found.filter(F.col("uid") == target).select("uid", "depth", "parent")
    path = [at]
    reached = at.first()
    for _ in range(reached["depth"] if reached else 0):
        at = found.join(F.broadcast(at.select(F.col("parent").alias("uid"))), "uid", "left_semi")
        path.append(at)
    return reduce(lambda a, b: a.union(b), path).select(F.col("depth").alias("step"), "uid").orderBy("step")
