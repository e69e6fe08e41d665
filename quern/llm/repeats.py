"""Removal of byte strings of 400 that occur more than once anywhere in the corpus, exactly.

Every window of 400 bytes has an anchor: the place of its least-hashed 128-byte gram, the leftmost of equals. Equal
windows have equal grams at equal offsets, so only windows whose anchor grams agree need to be compared. Neighbouring
windows mostly share their anchor; such a run of windows with the bytes that it covers is a span.

1. One pass cuts all texts into spans (gram, 128-bit digest of the span's bytes, place): about one per 137 bytes.
2. Spans whose gram occurs once in the corpus are settled. Of the others, spans whose digest repeats are repeated as a
   whole: all their windows occur elsewhere.
3. Where a gram belongs to several different spans, windows can still agree, which happens at the ends of repeated
   passages. The windows of a gram's different spans are compared in one task, which gets at most GROUP spans with their
   bytes. For a more frequent gram the digests of blocks of windows are counted across tasks; blocks that this leaves open
   are cut into quarters, down to single windows.
4. The covered bytes are removed; texts travel compressed and only for steps 3 and 4.

The same steps over words instead of bytes (each a 64-bit hash) find passages: words in a string of 50 words that another
document has too. They are counted, not removed; a passage of 50 words is often shorter than 400 bytes.

Counts are combined before each shuffle and no step meets two members of a group. Keys that hold more than a HOT-th of
the rows are joined where the rows are read, against fewer than HOT broadcast keys, the others by ordinary joins between
written tables. :mod:`quern.llm.bwt` has the merge of shard Burrows-Wheeler transforms; it gives the same answer in
memory and checks this operator in the tests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.lm import hashes_of_words
from quern.llm.tables import split_join, staged, text_or_empty

#: A gram with more different spans is compared by counting window digests across tasks, others within one task.
GROUP = 256
_TABLE = np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64)
_R = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Unit:
    """What strings consist of: ``length`` symbols in a string, ``gram`` (a power of two) in an anchor, ``width`` bytes in
    a symbol, ``part`` symbols hashed at once (longer texts are cut with an overlap of length - 1), ``block`` (a power of four) windows
    that are settled together at first in frequent grams. ``across`` counts only strings that another document has too; without it the same document's other places count as well."""

    length: int
    gram: int
    width: int
    part: int
    block: int
    across: bool

    def symbols(self, text: bytes) -> bytes:
        return text if self.width == 1 else hashes_of_words(text).tobytes()

    def hashes(self, symbols: bytes) -> np.ndarray:
        return _TABLE[np.frombuffer(symbols, np.uint8)] if self.width == 1 else np.frombuffer(symbols, np.uint64)

    def digests(self, symbols: bytes, starts, ends) -> list[bytes]:
        digest, w = xxhash.xxh3_128_digest, self.width
        return [digest(symbols[w * a : w * b]) for a, b in zip(starts, ends)]

    @property
    def sizes(self) -> list[int]:
        """Windows in a block: ``block``, then always a quarter, down to one."""
        return [self.block >> k for k in range(0, self.block.bit_length(), 2)]

    @property
    def least_bytes(self) -> int:
        """A shorter text has no string."""
        return self.length if self.width == 1 else 2 * self.length - 1


BYTES = Unit(400, 128, 1, 1 << 19, 16, False)
WORDS = Unit(50, 16, 8, 1 << 17, 4, True)


def gram_hashes(h: np.ndarray, gram: int) -> np.ndarray:
    """Mixed polynomial hashes of all grams of the symbols' hashes."""
    step = 1
    while step < gram:
        h = h[:-step] * np.uint64(pow(_R, step, 1 << 64)) + h[step:]
        step *= 2
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def spans(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, gram hash) of each span in the texts h[starts[k]:ends[k]] of hashed symbols."""
    none = np.zeros(0, np.int64)
    if len(h) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(h, gram)
    low = np.uint64((1 << 24) - 1)
    at = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low
    inside = np.zeros(len(at) + 1, np.int8)
    fit = ends - starts >= length
    np.add.at(inside, starts[fit], 1)
    np.add.at(inside, ends[fit] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    new = np.zeros(len(at), bool)
    new[starts[fit]] = True
    new[1:] |= at[1:] != at[:-1]
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    stop = np.ones(len(at), bool)
    stop[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(stop & inside)
    return np.searchsorted(starts, first, "right") - 1, first, last, h[at[first].astype(np.int64)]


def _parts(texts: list[bytes], unit: Unit) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Buffers of about ``part`` symbols with (row, start in the buffer, end in the buffer, start in the text)."""
    held, inside, size, w = [], [], 0, unit.width
    for row, t in enumerate(texts):
        for base in range(0, max(1, len(t) // w - unit.length + 1), unit.part):
            piece = t[base * w : (base + unit.part + unit.length - 1) * w]
            n = len(piece) // w
            inside.append((row, size, size + n, base))
            held.append(piece)
            size += n
            if size >= unit.part:
                yield b"".join(held), inside
                held, inside, size = [], [], 0
    if inside:
        yield b"".join(held), inside


def _hash(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def _cut(unit: Unit):
    """(doc_id, text) to one row per span: doc_id, t (text's hash), pos (first window * 512 + windows - 1), gram, h1, h2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            texts = b.column(1).cast(pa.binary()).to_pylist()
            symbols = [unit.symbols(x) for x in texts]
            of_row = np.array([_hash(x) if len(s) >= unit.length * unit.width else 0 for x, s in zip(texts, symbols)], np.uint64).view(np.int64)
            for buffer, inside in _parts(symbols, unit):
                own = np.array(inside, np.int64)
                k, first, last, gram = spans(unit.hashes(buffer), own[:, 1], own[:, 2], unit.length, unit.gram)
                if not len(k):
                    continue
                h = np.frombuffer(b"".join(unit.digests(buffer, first.tolist(), (last + unit.length).tolist())), "<i8").reshape(-1, 2)
                rows = own[k, 0]
                pos = (first - own[k, 1] + own[k, 3]) * 512 + (last - first)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), *map(pa.array, (of_row[rows], pos, gram.view(np.int64), np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])))], ["doc_id", "t", "pos", "gram", "h1", "h2"])

    return run


def _pack(least: int):
    """(doc_id, text) to (doc_id, t, z): the text compressed. Texts under ``least`` bytes have no string to compare and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            long = [k for k, x in enumerate(texts) if len(x) >= least]
            t = np.array([_hash(texts[k]) for k in long], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(long, pa.int64())), pa.array(t), pa.array([c.compress(texts[k]) for k in long], pa.binary())], ["doc_id", "t", "z"])

    return run


def _contexts(units: list[Unit]):
    """(doc_id, t, z, fine: list of (unit, pos, gram, single, hot)) to one row per span with the symbols that it covers."""
    kinds = {"unit": pa.int32(), "pos": pa.int64(), "gram": pa.int64(), "single": pa.bool_(), "hot": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            for row in range(len(b)):
                text, fine = d.decompress(b.column(2)[row].as_py()), b.column(3)[row].as_py()
                data = {u: units[u].symbols(text) for u in {x["unit"] for x in fine}}
                cut = []
                for x in fine:
                    unit, first = units[x["unit"]], x["pos"] >> 9
                    cut.append(data[x["unit"]][unit.width * first : unit.width * (first + (x["pos"] & 511) + unit.length)])
                keys = [pa.array([b.column(c)[row].as_py()] * len(fine), pa.int64()) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*keys, *(pa.array([x[n] for x in fine], kind) for n, kind in kinds.items()), pa.array(cut, pa.binary())], ["doc_id", "t", *kinds, "bytes"])

    return run


def _blocks(unit: Unit, size: int):
    """Spans with their symbols and the blocks to cut (null: all windows) to one row per block of ``size`` windows: doc_id, t,
    pos, block, single, c1, c2, u1, u2.

    Blocks take ``size`` windows each by their distance to the anchor, so that equal windows of two spans are in blocks of the
    same number, and smaller blocks lie inside larger ones. ``block`` is the block's first window and size, coded as ``pos``
    is; c is the digest of the symbols that all its windows share, u of those that any covers, null for a block that the span cuts.
    """
    names = ["doc_id", "t", "pos", "block", "single", "c1", "c2", "u1", "u2"]
    length = unit.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t, pos, gram, single, data, inside in zip(*(b.column(k).to_pylist() for k in range(7))):
                n, first = (pos & 511) + 1, pos >> 9
                at = int(np.argmax(gram_hashes(unit.hashes(data), unit.gram).view(np.int64) == gram))
                for x in [pos] if inside is None else inside:
                    start = (x >> 9) - first
                    for q in range((at - start - (x & 511)) // size, (at - start) // size + 1):
                        core = at - size * q  # the last window of the whole block starts here
                        low, high = max(0, core - size + 1), min(n - 1, core)
                        (c,) = unit.digests(data, [core], [core - size + 1 + length])
                        u = (unit.digests(data, [low], [high + length])[0] if size > 1 else c) if high - low + 1 == size else None
                        out.append((doc, t, pos, (first + low) * 512 + high - low, single, c, u))
            cut = lambda k, side: [None if r[k] is None else int.from_bytes(r[k][8 * side : 8 * side + 8], "little", signed=True) for r in out]
            cols = [[r[k] for r in out] for k in range(5)] + [cut(5, 0), cut(5, 1), cut(6, 0), cut(6, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if k == 4 else pa.int64()) for k, c in enumerate(cols)], names)

    return run


def _compare(unit: Unit):
    """Spans in the order of gram, at most GROUP of each, to the runs of windows that another span of the gram has too: doc_id, t, pos."""

    def settle(held: list[tuple]) -> pa.RecordBatch:
        own = [unit.digests(r[5], range(n), range(unit.length, unit.length + n)) for r in held for n in [(r[2] & 511) + 1]]
        seen: dict[bytes, tuple] = {}  # the first place of a window, or () where there are several
        for k, (r, w) in enumerate(zip(held, own)):
            place = (r[0], r[1]) if unit.across else (k,)
            for n, x in enumerate(w):
                if seen.setdefault(x, here := place if unit.across else (*place, n)) != here:
                    seen[x] = ()
        out = []
        for r, w in zip(held, own):
            if r[4]:
                hit = np.fromiter((not seen[x] for x in w), bool, len(w))
                edge = np.diff(np.r_[0, hit.view(np.int8), 0])
                out += [(r[0], r[1], ((r[2] >> 9) + a) * 512 + e - a - 1) for a, e in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], ["doc_id", "t", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for doc, t, pos, gram, single, _, data in zip(*(b.column(k).to_pylist() for k in range(7))):
                if held and held[-1][3] != gram:
                    yield settle(held)
                    held = []
                held.append((doc, t, pos, gram, single, data))
        if held:
            yield settle(held)

    return run


def _edges(covered: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the merged runs of symbols that the windows cover."""
    pos = np.unique(np.array(covered, np.int64))
    start, end = pos >> 9, (pos >> 9) + (pos & 511) + length
    far = np.maximum.accumulate(end)
    new = np.r_[True, start[1:] > far[:-1]]
    first = np.flatnonzero(new)
    return start[first], far[np.r_[first[1:] - 1, len(far) - 1]]


def _count(unit: Unit):
    """(doc_id, t, covered: list of pos) to (doc_id, t, n): covered symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [int((e - s).sum()) for s, e in (_edges(c, unit.length) for c in b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "t", "n"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t, z, covered: list of pos) to (doc_id, t, n_removed, n_spans, kept_sha256)."""
    d = zstandard.ZstdDecompressor()
    for b in batches:
        out = []
        for z, covered in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            data = d.decompress(z)
            starts, ends = _edges(covered, BYTES.length)
            kept = hashlib.sha256()
            for x, y in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]):
                kept.update(data[x:y])
            out.append((int((ends - starts).sum()), len(starts), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "t", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, t, n_bytes, sha)."""
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        t = np.array([_hash(x) for x in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(t, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())], ["doc_id", "t", "n_bytes", "sha"])


def _same(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.t == b.t)


def _several(rows: DataFrame, keys: tuple[str, ...], across: bool) -> DataFrame:
    """The keys that occur at several places with ``count``; ``across``: in several documents, with two of those as a and b."""
    if not across:
        return rows.groupBy(*keys).count().filter("count > 1")
    d = F.xxhash64("doc_id", "t")
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.min(d).alias("a"), F.max(d).alias("b")).filter("a <> b")


def _places(whole: DataFrame, keys: tuple[str, ...], across: bool) -> DataFrame:
    """Of the rows that are equal in ``keys`` and at several places one row, or two in different documents (a and b)."""
    ends, own = (whole.filter(F.xxhash64("doc_id", "t").isin(F.col("a"), F.col("b"))), ["doc_id", "t"]) if across else (whole, [])
    rest = [c for c in whole.columns if c not in (*keys, *own, "a", "b")]
    one = ends.groupBy(*keys, *own).agg(F.first(F.struct(*rest)).alias("_x"))
    return one.select(*keys, *own, *(F.col(f"_x.{c}").alias(c) for c in rest))


def _frequent(hot: DataFrame, unit: Unit) -> DataFrame:
    """(doc_id, t, pos): windows of frequent grams' spans that another span has too. Whole blocks are settled by their
    digests: repeated if what they cover is, single if what their windows share is. Only blocks whose shared bytes also
    occur where a block is not settled are cut into smaller ones, down to single windows; of equal blocks that are repeated
    as a whole, one place (two in different documents) goes along to be compared with."""
    found, spans_ = [], hot.select("doc_id", "t", "pos", "gram", "single", "bytes")
    cut = spans_.withColumn("blocks", F.lit(None).cast("array<long>"))
    for size in unit.sizes:
        blocks = staged(cut.mapInArrow(_blocks(unit, size), "doc_id long, t long, pos long, block long, single boolean, c1 long, c2 long, u1 long, u2 long"), "span-blocks")
        covers = staged(_several(blocks.filter("u1 is not null"), ("u1", "u2"), unit.across), "block-covers")
        if size == 1:
            found.append(split_join(blocks, covers, ["u1", "u2"]).filter("single").select("doc_id", "t", F.col("block").alias("pos")))
            break
        blocks = split_join(blocks, covers.withColumn("whole", F.lit(True)), ["u1", "u2"], "left").drop("count").withColumn("whole", F.coalesce("whole", F.lit(False)))
        blocks = staged(blocks, "told-blocks")
        found.append(blocks.filter("whole and single").select("doc_id", "t", F.col("block").alias("pos")))
        names = ["doc_id", "t", "pos", "block", "c1", "c2", "whole"]
        left = blocks.filter("not whole").select(*names).union(_places(blocks.filter("whole").drop("single"), ("u1", "u2"), unit.across).select(*names))
        left = staged(left, "left-blocks")
        open_ = left.groupBy("c1", "c2").agg(F.sum((~F.col("whole")).cast("int")).alias("open")).filter("open > 0")
        cores = staged(_several(left, ("c1", "c2"), unit.across).join(open_, ["c1", "c2"], "left_semi"), "block-cores")
        listed = staged(split_join(left, cores, ["c1", "c2"]).groupBy("doc_id", "t", "pos").agg(F.collect_set("block").alias("blocks")), "open-blocks")
        cut = spans_.join(listed, _same(spans_, listed) & (spans_.pos == listed.pos)).select(*(spans_[c] for c in spans_.columns), "blocks")
    return reduce(lambda a, b: a.union(b), found)


def _open(pairs: DataFrame, unit: Unit) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, pos) of the spans that are repeated as a whole, and (doc_id, t, pos, gram, single, hot) of those whose
    windows must be compared."""
    rows = staged(pairs.mapInArrow(_cut(unit), "doc_id long, t long, pos long, gram long, h1 long, h2 long"), "spans")
    grams = staged(_several(rows, ("gram",), unit.across).select("gram", "count"), "grams")
    rows = staged(split_join(rows, grams, ["gram"]).drop("count"), "shared")
    digests = staged(_several(rows, ("h1", "h2"), unit.across), "digests").withColumn("whole", F.lit(True))
    rows = staged(split_join(rows, digests, ["h1", "h2"], "left").withColumn("whole", F.coalesce("whole", F.lit(False))).drop("count"), "told")
    whole, single = rows.filter("whole"), rows.filter("not whole")
    # one of the places of each repeated span, or two in different documents, to be compared with the spans that share its gram
    one = _places(whole, ("h1", "h2"), unit.across)
    names = ["doc_id", "t", "pos", "gram", "h1"]
    each = staged(single.select(*names, F.lit(True).alias("single")).union(one.select(*names, F.lit(False))), "each")
    differ = each.groupBy("gram").agg(F.count("*").alias("count"), F.min("h1").alias("_x"), F.max("h1").alias("_y")).filter("_x <> _y")
    mixed = staged(differ.select("gram", "count"), "mixed").withColumn("hot", F.col("count") > GROUP)
    return whole.select("doc_id", "t", "pos"), split_join(each, mixed, ["gram"]).select("doc_id", "t", "pos", "gram", "single", "hot")


def covered(pairs: DataFrame, packed: DataFrame, units: list[Unit]) -> list[DataFrame]:
    """(doc_id, t, covered) for each unit: for every text that has any the windows that also start elsewhere, as pos, from
    ``pairs`` (doc_id, text) and the same texts compressed, which are shuffled once for all units."""
    whole, open_ = zip(*(_open(pairs, u) for u in units))
    fine = reduce(lambda a, b: a.union(b), (x.select("doc_id", "t", F.struct(F.lit(k).alias("unit"), "pos", "gram", "single", "hot").alias("x")) for k, x in enumerate(open_)))
    fine = staged(fine.groupBy("doc_id", "t").agg(F.collect_set("x").alias("fine")), "fine")
    joined = packed.join(fine, _same(packed, fine)).select(packed.doc_id, packed.t, "z", "fine")
    contexts = staged(joined.mapInArrow(_contexts(units), "doc_id long, t long, unit int, pos long, gram long, single boolean, hot boolean, bytes binary"), "contexts")
    out = []
    for k, unit in enumerate(units):
        own = contexts.filter(F.col("unit") == k).drop("unit")
        near = own.filter("not hot").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(unit), "doc_id long, t long, pos long")
        found = _frequent(own.filter("hot"), unit).union(near)
        out.append(staged(whole[k].union(found).groupBy("doc_id", "t").agg(F.collect_set("pos").alias("covered")), "covered"))
    return out


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: Unit = BYTES, passage: Unit = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words.

    A byte goes if any 400-byte string that covers it starts at another place too, in any text; runs are counted after
    merging. ``passage_words`` counts the words (runs outside space and bytes 9 to 13, A-Z lowered) in strings of 50 words
    that another document has too. Null counts as empty; texts under 400 bytes keep all; rows repeated with their id are
    copies of each other and lose everything, but are one document to ``passage_words``; null ids are ids of their own. An
    empty table gives an empty result. Texts of any length are read whole, cut with overlaps.
    """
    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    packed = lambda least: pairs.filter(F.octet_length("text") >= least).mapInArrow(_pack(least), "doc_id long, t long, z binary")
    removed, passages = covered(pairs, packed(min(unit.least_bytes, passage.least_bytes)), [unit, passage])
    long = packed(unit.least_bytes)
    joined = long.join(removed, _same(long, removed)).select(long.doc_id, long.t, "z", "covered")
    cleaned = joined.mapInArrow(_remove, "doc_id long, t long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id", "t"])
    cleaned = staged(cleaned, "cleaned")
    words = staged(passages.mapInArrow(_count(passage), "doc_id long, t long, n long"), "passage-words").withColumnRenamed("n", "passage_words")
    whole = staged(pairs.mapInArrow(_texts, "doc_id long, t long, n_bytes long, sha string"), "texts")
    some = whole.join(cleaned, _same(whole, cleaned), "left").select(
        whole.doc_id, whole.t, "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )
    return some.join(words, _same(some, words), "left").select(some.doc_id, "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("passage_words", F.lit(0)).alias("passage_words"))
