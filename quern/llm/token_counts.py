"""Token counts that follow edits: a segment tree of pre-token counts is kept for every document.

The splitting pattern has no look-behind and looks at most one character past a pre-token, so an edit changes only the
pre-tokens that reach to within ``LOOK`` characters of it, and once a new boundary behind the edit falls on an old one
all later boundaries agree. An edit therefore splits and encodes anew only from the last safe boundary before it to that
meeting point, replaces those leaves and updates the sums on the paths above them.

:func:`build` makes the table of trees, :func:`edit` takes trees and a table of edits and gives the trees after them.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import staged

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past its end that a pre-token can depend on.
LOOK = 2
#: Pre-tokens of a leaf and children of an inner node; either splits when it has twice as many.
LEAF, FAN = 64, 16
CACHE = 1 << 18


class Counter:
    """Tokens of a pre-token, remembered for the most recent ones."""

    def __init__(self, ranks: bytes):
        self.ranks, self.pattern = ranks, regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.encode: Callable | None = None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "known": {}, "encode": None}

    def counts(self, pieces: list[str]) -> list[int]:
        if self.encode is None:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        known = self.known
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(p) <= 32:
                    if len(known) >= CACHE:
                        known.clear()
                    known[p] = n
            out.append(n)
        return out


class Node:
    """A leaf has the lengths and token counts of its pre-tokens, an inner node its children; both the sums below them."""

    __slots__ = ("up", "kids", "lens", "toks", "chars", "tokens", "pieces")

    def __init__(self, kids: list[Node] | None = None, lens=(), toks=()):
        self.up: Node | None = None
        self.kids, self.lens, self.toks = kids, lens, toks
        for k in kids or ():
            k.up = self
        self.sum()

    def sum(self) -> None:
        if self.kids is None:
            self.chars, self.tokens, self.pieces = int(sum(self.lens)), int(sum(self.toks)), len(self.lens)
        else:
            self.chars, self.tokens, self.pieces = sum(k.chars for k in self.kids), sum(k.tokens for k in self.kids), sum(k.pieces for k in self.kids)

    def next_leaf(self) -> Node | None:
        n = self
        while n.up is not None:
            at = n.up.kids.index(n) + 1
            if at < len(n.up.kids):
                n = n.up.kids[at]
                while n.kids is not None:
                    n = n.kids[0]
                return n
            n = n.up
        return None


def _chunks(x: list, size: int) -> list[list]:
    return [x[k : k + size] for k in range(0, len(x), size)]


class CountTree:
    """A balanced tree over the pre-tokens of a text in order."""

    def __init__(self, text: str, counter: Counter, root: Node | None = None):
        self.text, self.counter = text, counter
        if root is None:
            pieces = counter.pattern.findall(text)
            root = self._over(self._leaves(list(map(len, pieces)), counter.counts(pieces)) or [Node()])
        self.root = root

    @property
    def total(self) -> int:
        return self.root.tokens

    @property
    def pieces(self) -> int:
        return self.root.pieces

    @staticmethod
    def _leaves(lens: list[int], toks: list[int]) -> list[Node]:
        return [Node(None, a, b) for a, b in zip(_chunks(lens, LEAF), _chunks(toks, LEAF))]

    @staticmethod
    def _over(nodes: list[Node]) -> Node:
        while len(nodes) > 1:
            nodes = [Node(k) for k in _chunks(nodes, FAN)]
        return nodes[0]

    def dump(self) -> bytes:
        """The nodes in preorder (children, or 0 for a leaf; pre-tokens, characters and tokens below), then the leaves' lengths and counts."""
        nodes, leaves, stack = [], [], [self.root]
        while stack:
            n = stack.pop()
            nodes.append((len(n.kids) if n.kids else 0, n.pieces, n.chars, n.tokens))
            if n.kids:
                stack += n.kids[::-1]
            else:
                leaves.append(n)
        flat = [np.concatenate([np.zeros(0, "<u4"), *(np.asarray(x, "<u4") for x in part)]) for part in ([n.lens for n in leaves], [n.toks for n in leaves])]
        return struct.pack("<q", len(nodes)) + np.array(nodes, "<i8").tobytes() + b"".join(x.astype("<u4").tobytes() for x in flat)

    @classmethod
    def load(cls, data: bytes, text: str, counter: Counter) -> CountTree:
        """Nothing is counted or summed; a leaf's numbers stay as they are until it is edited."""
        (n,) = struct.unpack_from("<q", data)
        nodes = np.frombuffer(data, "<i8", 4 * n, 8).reshape(-1, 4).tolist()
        pieces = nodes[0][1]
        lens, toks = np.frombuffer(data, "<u4", 2 * pieces, 8 + 32 * n).reshape(2, -1)
        at = k = 0

        def read() -> Node:
            nonlocal at, k
            kids, own, chars, tokens = nodes[k]
            k += 1
            node = Node.__new__(Node)
            node.up, node.kids, node.lens, node.toks, node.pieces, node.chars, node.tokens = None, None, (), (), own, chars, tokens
            if kids:
                node.kids = [read() for _ in range(kids)]
                for kid in node.kids:
                    kid.up = node
            else:
                node.lens, node.toks, at = lens[at : at + own], toks[at : at + own], at + own
            return node

        return cls(text, counter, read())

    @staticmethod
    def _lists(leaf: Node) -> tuple[list[int], list[int]]:
        if isinstance(leaf.lens, np.ndarray):
            leaf.lens, leaf.toks = leaf.lens.tolist(), leaf.toks.tolist()
        return list(leaf.lens), list(leaf.toks)

    def _leaf_at(self, char: int) -> tuple[Node, int]:
        """The leaf that holds the character, or the last, and the leaf's first character."""
        n, first = self.root, 0
        while n.kids is not None:
            for kid in n.kids[:-1]:
                if char < first + kid.chars:
                    break
                first += kid.chars
            else:
                kid = n.kids[-1]
            n = kid
        return n, first

    def _refresh(self, n: Node | None) -> None:
        while n is not None:
            n.sum()
            n = n.up

    def _remove(self, n: Node) -> None:
        up = n.up
        up.kids.remove(n)
        if not up.kids and up.up is not None:
            self._remove(up)
        else:
            self._refresh(up)

    def _insert_after(self, n: Node, new: list[Node]) -> None:
        up = n.up
        if up is None:
            self.root = self._over([n, *new])
            return
        at = up.kids.index(n) + 1
        up.kids[at:at] = new
        for k in new:
            k.up = up
        if len(up.kids) <= 2 * FAN:
            self._refresh(up)
            return
        first, *rest = _chunks(up.kids, FAN)
        up.kids = first
        up.sum()
        self._insert_after(up, [Node(k) for k in rest])

    def _splice(self, first: Node, last: Node, new: list[Node]) -> None:
        """Put leaves in place of those from ``first`` to ``last``."""
        gone, n = [], first
        while n is not last:
            n = n.next_leaf()
            gone.append(n)
        for n in gone:
            self._remove(n)
        first.lens, first.toks = (new[0].lens, new[0].toks) if new else ([], [])
        self._refresh(first)
        if len(new) > 1:
            self._insert_after(first, new[1:])
        elif not new and self.root.pieces:
            self._remove(first)
        while self.root.kids is not None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.up = None

    def replace(self, start: int, stop: int, new: str) -> int:
        """Put ``new`` in place of text[start:stop]; the number of pre-tokens that were encoded for it."""
        start = min(max(start, 0), len(self.text))
        stop = min(max(stop, start), len(self.text))
        self.text = self.text[:start] + new + self.text[stop:]
        shift, after, safe = len(new) - (stop - start), start + len(new), max(0, start - LOOK)
        leaf, at = self._leaf_at(safe)
        # walk to the last boundary at or before `safe`
        lens, toks = self._lists(leaf)
        head = 0
        while head < len(lens) and at + lens[head] <= safe:
            at += lens[head]
            head += 1
        # old boundaries behind the edit, leaf by leaf, until a new one falls on one of them
        last, tail, old, right = leaf, head, at, lens
        fresh: list[str] = []
        met = False
        for m in self.counter.pattern.finditer(self.text, at):
            fresh.append(m.group())
            reached = m.end()
            if reached < after:
                continue
            while old + shift < reached:
                if tail < len(right):
                    old += right[tail]
                    tail += 1
                elif (following := last.next_leaf()) is not None:
                    last, tail = following, 0
                    right = self._lists(last)[0]
                else:
                    break
            if old >= stop and old + shift == reached:
                met = True
                break
        if not met:
            while (following := last.next_leaf()) is not None:
                last = following
        counts = self.counter.counts(fresh)
        lens_after, toks_after = (x[tail:] for x in self._lists(last)) if met else ([], [])
        lens, toks = lens[:head] + list(map(len, fresh)) + lens_after, toks[:head] + counts + toks_after
        self._splice(leaf, last, [Node(None, lens, toks)] if 0 < len(lens) <= 2 * LEAF else self._leaves(lens, toks))
        return len(fresh)


def sample_edits(key: str, length: int, n: int) -> list[tuple[int, int, str]]:
    """``n`` deletions, insertions and replacements at places drawn from the hash of ``key``."""
    out = []
    for k in range(n):
        h = xxhash.xxh64_intdigest(f"{key}:{k}", 0)
        start = h % (length + 1)
        stop = start + (0, 7, 23)[h >> 32 & 1 or k % 3]
        out.append((start, stop, ("", " edited", "'s 12\n\n x")[(h >> 40) % 3]))
    return out


TREES = "doc_id long, tag long, n_pretokens long, n_tokens long, n_chars long, tree binary"
NAMES = ["doc_id", "tag", "n_pretokens", "n_tokens", "n_chars", "tree"]


def pack(tree: CountTree) -> bytes:
    text = tree.text.encode("utf-8", "surrogatepass")
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(text)) + text + tree.dump())


def unpack(data: bytes, counter: Counter) -> CountTree:
    data = zstandard.ZstdDecompressor().decompress(data)
    (n,) = struct.unpack_from("<q", data)
    return CountTree.load(data[8 + n :], data[8 : 8 + n].decode("utf-8", "surrogatepass"), counter)


def load_counter(ranks: str = RANKS) -> Counter:
    """Read on the driver; the ranks travel with the task (under 1 MB)."""
    with open(ranks, "rb") as f:
        return Counter(f.read())


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if n == "tree" else pa.int64()) for k, n in enumerate(names)], names)


def _out(key, tag, tree: CountTree) -> tuple:
    return key, tag, tree.pieces, tree.total, len(tree.text), pack(tree)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag (tells rows apart that share their id), n_pretokens, n_tokens, n_chars, tree
    (the tree with its text, compressed). Write it before reading it twice, as tags follow the tasks.

    Null counts as empty, which has no tokens; a null id stays null; an empty table gives an empty one. Whole texts are
    counted, whatever their length, in one pass without a shuffle. Only the two named columns are read.
    """
    counter = load_counter(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([_out(k, tag, CountTree(t or "", counter)) for k, tag, t in zip(*(b.column(c).to_pylist() for c in range(3)))], NAMES)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tag"), F.col(text).alias("text")).mapInArrow(run, TREES)


def edit(trees: DataFrame, edits: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The trees after ``edits`` (doc_id, seq, start, stop, new), with n_encoded, the number of pre-tokens encoded for them.

    Each edit puts ``new`` (null: nothing) in place of the characters from start to stop of the text as the edits before it
    left it; they follow each other by seq, ties by their other values, and places outside the text are moved to its ends. Rows that share
    an id get its edits each; null ids and ids without a tree get none. Only edited trees are shuffled, and a task holds one tree at
    a time, past which its edits stream, so that a document may have any number of them.
    """
    counter = load_counter(ranks)
    own = edits.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("long").alias(c) for c in ("seq", "start", "stop")), F.coalesce(F.col("new"), F.lit("")).alias("new"))
    placed = staged(own.join(trees.select("doc_id", "tag"), "doc_id"), "edits")
    touched = placed.select(F.col("tag").alias("_tag")).distinct()
    same = F.col("tag") == F.col("_tag")
    kept = trees.join(touched, same, "left_anti").withColumn("n_encoded", F.lit(0).cast("long"))
    none = F.lit(None)
    mixed = trees.join(touched, same, "left_semi").select("tag", "doc_id", "tree", *(none.cast("long").alias(c) for c in ("seq", "start", "stop")), none.cast("string").alias("new"))
    mixed = mixed.union(placed.select("tag", "doc_id", none.cast("binary").alias("tree"), "seq", "start", "stop", "new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names = None, [*NAMES, "n_encoded"]
        for b in batches:
            done = []
            for tag, key, packed, _, start, stop, new in zip(*(b.column(c).to_pylist() for c in range(7))):
                if packed is not None:
                    if at:
                        done.append((*_out(*at[:3]), at[3]))
                    at = [key, tag, unpack(packed, counter), 0]
                else:
                    at[3] += at[2].replace(start, stop, new)
            yield _rows(done, names)
        if at:
            yield _rows([(*_out(*at[:3]), at[3])], names)

    # a tree's row comes before its edits, as nulls are first
    order = mixed.repartition("tag").sortWithinPartitions("tag", F.col("tree").isNull(), "seq", "start", "stop", "new")
    return order.mapInArrow(run, TREES + ", n_encoded long").union(kept)


def edited_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 3, ranks: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pretokens, n_tokens, then after ``edits`` edits drawn from the hash of the id
    n_encoded (pre-tokens encoded for them), edited_tokens and edited_chars.

    The trees are built and kept as a table, and read again for the edits, which are made where the tree is read: see
    :func:`build` for nulls, repeats and long texts, and :func:`edit` for edits that come as a table.
    """
    counter = load_counter(ranks)
    names = ["doc_id", "n_pretokens", "n_tokens", "n_encoded", "edited_tokens", "edited_chars"]
    trees = staged(build(docs, doc_id, text, ranks), "trees")

    def one(key, pieces: int, tokens: int, length: int, packed: bytes) -> tuple:
        tree = unpack(packed, counter)
        done = sum(tree.replace(*e) for e in sample_edits(str(key), length, edits))
        return key, pieces, tokens, done, tree.total, len(tree.text)

    def run(batches):
        for b in batches:
            yield _rows([one(*r) for r in zip(*(b.column(c).to_pylist() for c in range(5)))], names)

    return trees.select("doc_id", "n_pretokens", "n_tokens", "n_chars", "tree").mapInArrow(run, ", ".join(f"{n} long" for n in names))
