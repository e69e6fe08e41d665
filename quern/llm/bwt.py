"""Repeated strings from merged Burrows-Wheeler transforms, in memory.

Each shard (a list of texts, every one closed by a terminator of its own) is suffix-sorted once. Two transforms are
merged by interleave refinement (Holt and McMillan, 2014): starting from all of the first before all of the second, each
round stably re-distributes the interleave by the preceding symbols, so that after round k it is right for the first k
symbols; the round at which a boundary between neighbours first shows is their common prefix plus one. No suffix is
sorted again. Neighbours with a common prefix of at least ``length`` are repeated strings.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling."""
    rank, n, step = symbols.astype(np.int64), len(symbols), 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank = new
        if rank.max(initial=0) == n - 1 or step >= n:
            return order
        step *= 2


def transform(texts: list[bytes], first_terminator: int) -> tuple[np.ndarray, np.ndarray]:
    """(transform, positions): symbols are terminators 0.. and bytes above them; the places count through the joined texts."""
    parts = [np.r_[np.frombuffer(t, np.uint8).astype(np.int64) + (1 << 32), first_terminator + k] for k, t in enumerate(texts)]
    s = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = suffix_array(np.unique(s, return_inverse=True)[1])
    return s[order - 1], order


def merge(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave (true: from ``b``) of two transforms and the common prefixes of neighbours, both right up to ``most``."""
    n = len(a) + len(b)
    from_b = np.zeros(n, bool)
    from_b[len(a) :] = True
    common = np.full(n, -1, np.int64)
    common[:1] = 0
    block = np.zeros(n, np.int64)  # the prefix class of each place; equal within a class
    for k in range(1, most + 2):
        symbols = np.empty(n, np.int64)
        symbols[~from_b], symbols[from_b] = a, b
        order = np.argsort(symbols, kind="stable")
        moved, sym, was = from_b[order], symbols[order], block[order]
        edge = np.zeros(n, bool)
        edge[1:] = (sym[1:] != sym[:-1]) | (was[1:] != was[:-1])
        fresh = edge & (common < 0)
        common[fresh] = k - 1
        same = np.array_equal(moved, from_b) and not fresh.any()
        from_b, block = moved, np.cumsum(edge)
        if same and k > 1:
            break
    common[common < 0] = most
    return from_b, np.minimum(common, most)


def covered(shards: list[list[bytes]], length: int) -> list[list[np.ndarray]]:
    """For every text of every shard the mask of the bytes that a string of ``length`` that also starts elsewhere covers."""
    bwt, places, base, terminators = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
    common = np.zeros(0, np.int64)
    for shard in shards:
        t, p = transform(shard, terminators)
        terminators += len(shard)
        from_b, common = merge(bwt, t, length)
        joined, where = np.empty(len(from_b), np.int64), np.empty(len(from_b), np.int64)
        joined[~from_b], joined[from_b] = bwt, t
        where[~from_b], where[from_b] = places, p + base
        bwt, places, base = joined, where, base + len(p)
    repeated = common >= length
    hit = repeated.copy()
    hit[:-1] |= repeated[1:]
    edge = np.zeros(base + 1, np.int64)
    np.add.at(edge, places[hit], 1)
    np.add.at(edge, np.minimum(places[hit] + length, base), -1)
    mask, at, out = np.cumsum(edge[:-1]) > 0, 0, []
    for shard in shards:
        out.append([])
        for t in shard:
            out[-1].append(mask[at : at + len(t)])
            at += len(t) + 1
    return out
