"""SentencePiece encoding and decoding by a relational lattice.

Blanks become U+2581, with one put in front. Pieces never reach across the start of a run of U+2581, over a line feed or
tab that no piece contains, from a letter to a mark that follows no letter in any piece, nor between two characters, one
of them beyond ASCII, that are neighbours in no piece. So a text falls into words whose encodings do not depend on each
other, and each different word is encoded once:

1. Blocks of documents send their distinct fields (what stands between blanks: a word or a few), packed, to buckets by
   the hash of the field without closing marks; a bucket takes the distinct words of all of them.
2. A word's substrings of bounded length are exploded and equi-joined to the piece table (a broadcast of fixed size).
   The matches are the edges of the word's lattice and are grouped by word where they arose.
3. A fold with ``aggregate`` finds the word's segmentation. For a unigram model that is Viterbi: the best score of
   every end over its incoming edges. For a byte-pair model the scores are merge priorities and the best path has another
   meaning -- Viterbi over them gives other pieces than the model's own encoder -- so the fold applies merges: it goes
   through the edges from the highest score down, leftmost first, and takes those that join two neighbouring symbols.
   The symbols' bounds are the bits of a long. A merge that makes an edge possible which was passed before would have
   to be followed by that edge; the fold notices, and such a word goes through the edges anew after every merge.
4. Each bucket puts its fields together from the words and answers the blocks, in the order asked. The documents' ids are
   joined there and decoded again to prove the round trip.

Characters without a piece become byte pieces (or the unknown id). Words over ``LONG`` characters are encoded within
their task by the same rule with a heap, as the fold's cost grows with the square of a word's length. The documents are
read twice, for the requests and for the answers, and must be dealt to tasks alike both times, as a written table is; a
block whose answers do not fit its fields is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.blocks import acyclic, blocks_of, bundle, each_text, pack_numbers, released, unpack_numbers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
LONG = 48
#: Bytes of text in a block: each sends its distinct fields once.
BLOCK = 32 << 20
#: Documents of a bucket: sizes the buckets so that each holds a bounded share of the words.
PER_BUCKET = 1500
#: A run of blanks and what follows up to the next, in marked text.
FIELD = re.compile(f"(?:{BLANK})+(?:(?!{BLANK}).)*+".encode(), re.DOTALL)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of a protocol-buffer message."""

    def varint(at):
        n = shift = 0
        while True:
            b = data[at]
            n |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return n, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Pieces:
    """A piece table: normal pieces with score and id, byte pieces, and whether scores are merge priorities."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    unknown: int = 0
    bpe: bool = True
    surface: list[bytes] = field(default_factory=list)

    @classmethod
    def load(cls, data: bytes) -> Pieces:
        ids, scores, byte_ids, surface, unknown, bpe = {}, {}, [-1] * 256, [], 0, False
        for number, value in _fields(data):
            if number == 1:
                entry = dict(_fields(value))
                text, kind, k = entry[1].decode(), entry.get(3, 1), len(surface)
                if kind == 1 or kind == 4:
                    ids[text], scores[text] = k, struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0]
                    surface.append(text.encode())
                elif kind == 6:
                    byte_ids[int(text[1:-1], 16)] = k
                    surface.append(bytes([int(text[1:-1], 16)]))
                else:
                    unknown = k if kind == 2 else unknown
                    surface.append(" ⁇ ".encode() if kind == 2 else b"")
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                n = dict(_fields(value))
                if n.get(2) or n.get(3, 1) != 1 or n.get(4, 1) != 0 or n.get(5, 1) != 1:
                    raise ValueError("only models with the identity normaliser, a blank in front and all blanks kept are supported")
        return cls(ids, scores, byte_ids, unknown, bpe, surface)

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)

    def words(self) -> re.Pattern:
        inside = set().union(*self.ids) if self.ids else set()
        cuts = "".join(c for c in "\n\t" if c not in inside)
        marks = re.escape(self.marks())
        if not marks:
            return re.compile(f"{BLANK}+[^{BLANK}{cuts}]*|[^{BLANK}{cuts}]+" + (f"|[{cuts}]" if cuts else ""))
        letters, others = r"[^\W\d_]++", rf"(?:[\W\d_](?<![{BLANK}{cuts}]))++"
        run = f"(?:{others}|{letters}(?![{marks}]))"
        return re.compile(f"{BLANK}++{run}*+(?:{letters})?|{run}++(?:{letters})?|{letters}" + (f"|[{cuts}]" if cuts else ""))

    def late(self) -> set[str]:
        """Pieces that begin or end a piece of at least their score whose rest can be a symbol: only after these can an edge
        become possible that was passed before."""
        out = set()
        for p, x in self.scores.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if (k == 1 or a in self.scores) and (len(b) == 1 or b in self.scores):
                    out |= {y for y in (a, b) if len(y) > 1 and self.scores[y] <= x}
        return out

    def marks(self) -> str:
        """ASCII characters but letters that follow no letter in any piece."""
        letter = re.compile(r"[^\W\d_]").match
        after = {b for p in self.ids for a, b in zip(p, p[1:]) if letter(a)}
        return "".join(c for c in map(chr, range(33, 127)) if not letter(c) and c not in after)

    def bounds_to_ids(self, word: str, bounds: list[int]) -> list[int]:
        get = self.ids.get
        found = [get(word[a:b]) for a, b in pairwise(bounds)]
        if None not in found:
            return found
        out = []
        for a, b in zip(bounds, bounds[1:]):
            k = self.ids.get(word[a:b])
            if k is not None:
                out.append(k)
            elif self.bytes_[0] >= 0:
                out += [self.bytes_[x] for x in word[a:b].encode("utf-8", "replace")]
            else:
                out.append(self.unknown)
        return out

    def encode_word(self, word: str) -> list[int]:
        """The same segmentation as the fold, for one word and without Spark."""
        return self.bounds_to_ids(word, self._merge(word) if self.bpe else self._viterbi(word))

    def _merge(self, word: str) -> list[int]:
        n, get = len(word), self.scores.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        alive, heap = [True] * n, []

        def push(a):
            b = right[a]
            if b < n and (s := get(word[a : right[b]])) is not None:
                heapq.heappush(heap, (-s, a, b, right[b]))

        for a in range(n - 1):
            push(a)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if not alive[a] or b >= n or not alive[b] or right[a] != b or right[b] != end:
                continue
            alive[b] = False
            right[a] = end
            if end < n:
                left[end] = a
            push(a)
            if left[a] >= 0:
                push(left[a])
        return [a for a in range(n) if alive[a]] + [n]

    def _viterbi(self, word: str) -> list[int]:
        n, low = len(word), min(self.scores.values(), default=0.0) - 10
        best, back = [0.0] + [-1e30] * n, [0] * (n + 1)
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                score = self.scores.get(word[s:e], low if e - s == 1 else None)
                if score is not None and best[s] + score > best[e]:
                    best[e], back[e] = best[s] + score, s
        out = [n]
        while out[-1]:
            out.append(back[out[-1]])
        return out[::-1]

    def decode(self, ids) -> str:
        """Text of the ids; byte pieces are joined before they are read as UTF-8."""
        text = b"".join(self.surface[k] for k in ids).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


def marked(text: str) -> str:
    return BLANK + text.replace(" ", BLANK) if text else ""


def lattice(words: DataFrame, table: Pieces, keys: tuple[str, ...] = ("word",), also: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, ``also`` and ``bounds``: the places where the word is cut, 0 and its length included; null for a null word."""
    cut = lattice_bits(words, table, keys, also)
    return cut.withColumn("bounds", F.expr("filter(sequence(0, 63), k -> (shiftright(at, k) & 1) = 1)")).drop("at")


def lattice_bits(words: DataFrame, table: Pieces, keys: tuple[str, ...] = ("word",), also: tuple[str, ...] = ()) -> DataFrame:
    """From ``words`` (one row of at most 60 characters for each value of ``keys``) ``keys``, ``also`` and ``at``: a long
    with the bit of every place where the word is cut, 0 and its length included.

    Substrings are exploded and joined to the broadcast piece table; every word also matches one empty entry, so that
    words without any edge stay. Only that row carries the columns ``also``, the edges' rows are numbers. If ``words`` is
    partitioned by one of the keys, the grouping needs no further exchange.
    """
    spark = words.sparkSession
    low = min(table.scores.values(), default=0.0) - 10
    ranks = {x: k for k, x in enumerate(sorted({-x for x in table.scores.values()}))}
    late = table.late() if table.bpe else set()
    rows = [(p, float(-x), ranks[-x], int(p in late)) for p, x in table.scores.items() if len(p) > 1 or not table.bpe] + [("", 0.0, 0, 0)]
    pieces = F.broadcast(spark.createDataFrame(rows, "piece string, cost double, rank long, late int"))
    shortest = 2 if table.bpe else 1
    w = words.withColumns({"_word": F.col("word"), "_n": F.char_length("word")})
    at = w.withColumn("_s", F.explode(F.sequence(F.lit(-1), F.greatest(F.col("_n") - shortest, F.lit(-1)))))
    longest = F.when(F.col("_s") < 0, 0).otherwise(F.least(F.lit(table.longest), F.col("_n") - F.col("_s")))
    cut = at.withColumn("_l", F.explode(F.sequence(F.when(F.col("_s") < 0, 0).otherwise(shortest), longest)))
    cut = cut.withColumn("piece", F.expr("if(_s < 0, '', substring(_word, _s + 1, _l))"))
    end = F.col("_s") + F.col("_l")
    code = F.shiftleft("rank", 13) + F.shiftleft("_s", 7) + F.shiftleft(end, 1) + F.col("late")  # sorted by cost, then place
    edge = F.when(F.col("_s") >= 0, code if table.bpe else F.struct("cost", F.col("_s").alias("s"), end.alias("e")))
    rest = ["_n", *also]
    carried = [F.when(F.col("_s") < 0, F.col(c)).alias(c) for c in rest]
    matched = cut.join(pieces, "piece").select(*keys, *carried, edge.alias("edge"))
    grouped = matched.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges"), *(F.first(c, ignorenulls=True).alias(c) for c in rest))
    if table.bpe:
        return merge_fold(grouped).select(*keys, *also, "at")
    cuts = grouped.withColumn("_cuts", viterbi_fold(F.col("edges"), F.col("_n"), low))
    return cuts.select(*keys, *also, F.expr("aggregate(_cuts, 0L, (a, k) -> a | shiftleft(1L, k))").alias("at"))


def merge_fold(grouped: DataFrame) -> DataFrame:
    """``at`` from the word's length ``_n`` and ``edges``: rank, start, end and lateness of each in a long, sorted.

    Bit k of the state is a symbol's bound at k; an edge joins two symbols if its ends and one bit between are set.
    """
    masks = "transform(edges, x -> struct(shiftleft(2L, int(shiftright(x, 1) & 63)) - shiftleft(1L, int(shiftright(x, 7) & 63)) AS span, shiftleft(1L, int(shiftright(x, 7) & 63)) | shiftleft(1L, int(shiftright(x, 1) & 63)) AS ends, (x & 1) = 1 AS late))"
    joins = lambda state, x: f"bit_count({state} & {x}.span) = 3 AND ({state} & {x}.ends) = {x}.ends"
    start = "shiftleft(2L, _n) - 1"
    taken = "((z.at & ~x.span) | x.ends)"
    once = f"""aggregate(edges, struct({start} AS at, false AS again, 0 AS n), (z, x) -> if({joins("z.at", "x")},
        struct({taken} AS at, z.again OR (x.late AND exists(slice(edges, 1, z.n), y -> {joins(taken, "y")})) AS again, z.n + 1 AS n),
        struct(z.at AS at, z.again AS again, z.n + 1 AS n)))"""
    anew = f"""aggregate(sequence(1, _n), {start}, (a, k) ->
        coalesce(get(transform(slice(filter(edges, x -> {joins("a", "x")}), 1, 1), x -> (a & ~x.span) | x.ends), 0), a))"""
    found = grouped.withColumn("edges", F.expr(masks)).withColumn("once", F.expr(once))
    return found.withColumn("at", F.expr(f"if(once.again, {anew}, once.at)")).drop("once", "edges")


def viterbi_fold(edges: Column, n: Column, low: float) -> Column:
    """Best path: the state holds, for every end so far, the cost and the cuts of its best segmentation."""
    state = F.array(F.struct(F.lit(0.0).cast("double").alias("cost"), F.array(F.lit(0)).alias("cuts")))

    def step(acc, end):
        single = F.exists(edges, lambda x: (x.e == end) & (x.s == end - 1))
        into = F.concat(F.filter(edges, lambda x: x.e == end), F.when(single, F.array().cast("array<struct<cost:double,s:int,e:int>>")).otherwise(F.array(F.struct(F.lit(-low).alias("cost"), (end - 1).alias("s"), end.alias("e")))))
        paths = F.transform(into, lambda x: F.struct((F.get(acc, x.s).cost + x.cost).alias("cost"), F.concat(F.get(acc, x.s).cuts, F.array(end)).alias("cuts")))
        return F.concat(acc, F.array(F.array_min(paths)))

    done = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), state, step)
    return F.element_at(done, -1).cuts


class _Splitter:
    def __init__(self, table: Pieces, buckets: int):
        self.pattern, self.marks, self.buckets = table.words(), table.marks(), buckets
        self.pairs = {p[k : k + 2] for p in table.ids for k in range(len(p) - 1)}

    def fields(self, text: bytes) -> list[bytes]:
        """The text's runs between blanks, cheaply; each stands for one or more words, see :meth:`words`."""
        if not text:
            return []
        if b"  " in text or text[:1] == b" " or BLANK.encode() in text:
            return [x[len(BLANK.encode()) :] for x in FIELD.findall(marked(text.decode()).encode())]
        return text.split(b" ")

    def words(self, field: bytes) -> list[str]:
        w = field.decode()
        if w.isalpha() or not w:
            found = [BLANK + w]
        elif (stem := w.rstrip(self.marks)).isalpha() and stem != w:
            found = [BLANK + stem, w[len(stem) :]]
        else:
            found = self.pattern.findall(marked(w))
        return found if w.isascii() else [x for w in found for x in self.apart(w)]

    def apart(self, word: str) -> list[str]:
        """The word cut where two characters meet that are neighbours in no piece."""
        pairs = self.pairs
        cuts = [k for k in range(1, len(word)) if word[k - 1 : k + 1] not in pairs and not word[k - 1 : k + 1].isascii() and word[k - 1 : k + 1] != BLANK + BLANK]
        return [word[a:b] for a, b in pairwise([0, *cuts, len(word)])] if cuts else [word]

    def distinct(self, texts: list[bytes]) -> set[bytes]:
        seen: set[bytes] = set()
        for t in texts:
            seen.update(self.fields(t))
        return seen

    def by_bucket(self, fields: Iterable[bytes]) -> dict[int, list[bytes]]:
        """The fields in order by bucket; those that differ in closing marks only share one."""
        out: defaultdict[int, list[bytes]] = defaultdict(list)
        marks, n, digest = self.marks.encode(), self.buckets, xxhash.xxh64_intdigest
        for f in fields:
            out[digest(f.rstrip(marks) if marks else f) % n].append(f)
        for some in out.values():
            some.sort()
        return out


def _check(fields: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b"\0".join(fields)) >> 1


def pack_fields(fields: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b" ".join(fields))


def unpack_fields(data: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b" ")


def _ask(split: _Splitter, size: int):
    def run(batches):
        seen: set[bytes] = set()  # of the block that is being filled; there is one part only
        for block, *_ in blocks_of(batches, size, lambda t: seen.update(split.fields(t))):
            rows = [(k, block, pack_fields(f)) for k, f in split.by_bucket(seen).items()]
            seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "block", "fields"])

    return run


def _words(split: _Splitter, fields) -> list[str]:
    """The different words of the fields that are not too long, in order."""
    return _short(map(split.words, fields))


def _short(found) -> list[str]:
    return sorted({w for ws in found for w in ws if len(w) <= LONG})


def _merge_asked(split: _Splitter):
    """Rows in the order of bucket to (bucket, k, word, block, fields): every different word once, and the requests, which
    have numbers before the words' and travel along."""

    def run(batches):
        held: list[tuple] = []

        def settle():
            words = _words(split, set().union(*(unpack_fields(r[2]) for r in held)))
            n, m = len(held), len(words)
            cols = [held[0][0]] * (n + m), range(-n, m), [None] * n + words, [r[1] for r in held] + [None] * m, [r[2] for r in held] + [None] * m
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], ["bucket", "k", "word", "block", "fields"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(3))):
                if held and held[-1][0] != r[0]:
                    yield settle()
                    held = []
                held.append(r)
        if held:
            yield settle()

    return run


def _answer(table: Pieces, split: _Splitter):
    """Rows (bucket, k, at, block, fields) in the order of bucket and k to (block, bucket, check, sizes, ids)."""

    def run(batches):
        now, asked, cuts = None, [], []

        def settle():
            parts = {f: split.words(f) for f in {f for _, x in asked for f in x}}
            bits = np.unpackbits(np.array(cuts, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            bounds, ends = np.nonzero(bits)[1].tolist(), np.r_[0, np.cumsum(bits.sum(axis=1, dtype=np.int64))].tolist()
            ids = {w: table.bounds_to_ids(w, bounds[x:y]) for w, x, y in zip(_short(parts.values()), ends, ends[1:])}
            known = {f: [k for w in ws for k in (ids[w] if w in ids else table.encode_word(w))] for f, ws in parts.items()}
            out = []
            for block, x in asked:
                got = [known[f] for f in x]
                out.append((block, now, _check(x), pack_numbers(np.array([len(g) for g in got], np.uint64)), pack_numbers(np.fromiter(chain.from_iterable(got), np.uint64))))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "bucket", "check", "sizes", "ids"])

        for b in batches:
            bucket, k, at = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            starts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)] if len(bucket) else [0]
            for x, y in pairwise(np.asarray(starts).tolist()):
                if bucket[x] != now:
                    if asked:
                        yield settle()
                    now, asked, cuts = int(bucket[x]), [], []
                first = x + int(np.count_nonzero(k[x:y] < 0))
                asked += zip(b.column(3).slice(x, first - x).to_pylist(), map(unpack_fields, b.column(4).slice(x, first - x).to_pylist()))
                cuts += at[first:y].astype(np.int64).tolist()
        if asked:
            yield settle()

    return run


def _join(table: Pieces, split: _Splitter, want_ids: bool):
    surfaces, blank = table.surface, BLANK.encode()
    widths = np.array(list(map(len, surfaces)), np.int64)

    def run(batches):
        for b in batches:
            for row in range(len(b)):
                blob = b.column(1)[row].as_buffer()  # read twice: a block's texts are never in memory all at once
                number: defaultdict[bytes, int] = defaultdict()
                number.default_factory = number.__len__  # the next field's number
                codes = [np.fromiter(map(number.__getitem__, f), np.int32, len(f)) for f in (split.fields(t) for _, t in each_text(blob))]
                number.default_factory = None
                start, size, flats, base = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64), [np.zeros(0, "<u4")], 0
                shown = [b" " + f for f in number]  # what each field decodes to
                answers = {a["bucket"]: a for a in b.column(2)[row].as_py() or ()}
                for bucket, fields in split.by_bucket(number).items():
                    a = answers.pop(bucket, None)
                    if not a or a["check"] != _check(fields):
                        raise RuntimeError("the documents were dealt to tasks in another way when they were read again: write them first")
                    flat, n, code = unpack_numbers(a["ids"]).astype("<u4"), unpack_numbers(a["sizes"]).astype(np.int64), [number[f] for f in fields]
                    ends = np.cumsum(n)
                    size[code], start[code] = n, base + ends - n
                    base += len(flat)
                    flats.append(flat)
                    seen = list(map(surfaces.__getitem__, flat.tolist()))
                    far = np.r_[0, np.cumsum(widths[flat])]
                    marked_ = blank + blank.join(fields)
                    alike = b"".join(seen) == marked_ and np.array_equal(far[ends] - far[ends - n], np.fromiter(map(len, fields), np.int64, len(fields)) + len(blank))
                    if not alike or marked_.count(blank) > len(fields):  # some decode to something else
                        for f, c, x, y in zip(fields, code, (ends - n).tolist(), ends.tolist()):
                            if (back := b"".join(seen[x:y])) != blank + f or blank in f:
                                shown[c] = back.replace(blank, b" ")
                flat, at, docs = np.concatenate(flats), 0, each_text(blob)
                number.clear()
                while at < len(codes):  # rows of bounded size
                    first, length, some = at, 0, []
                    while at < len(codes) and length < 4 << 20:
                        some.append(next(docs))
                        length, at = length + len(some[-1][1]), at + 1
                    rows = []
                    for (doc_id, text), code in zip(some, codes[first:at]):
                        n = size.take(code)
                        places = (start.take(code) - n.cumsum() + n).repeat(n)
                        places += np.arange(len(places))
                        found = flat.take(places)
                        back = b"".join(map(shown.__getitem__, code.tolist()))[1:]
                        rows.append((doc_id, len(found), hashlib.sha256(found).hexdigest(), hashlib.sha256(back).hexdigest(), back == text, found.view(np.int32) if want_ids else None))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()] + [pa.list_(pa.int32())] * want_ids
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"] + ["ids"] * want_ids)

    return run


def load(path: str = MODEL) -> Pieces:
    """Read on the driver; the table travels with the tasks (under 1 MB)."""
    with open(path, "rb") as f:
        return Pieces.load(f.read())


def encode(docs: DataFrame, table: Pieces | None = None, ids: bool = False, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids_sha256 (of the ids as 32-bit little-endian), decoded_sha256,
    round_trip, and with ``ids`` the ids themselves.

    Null counts as empty, which has no pieces. A text that holds U+2581 itself decodes to a blank there, which
    ``round_trip`` shows. Null ids stay null; an empty table gives an empty result; only the two columns are read.
    """
    table = table or load()
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    split = _Splitter(table, max(8, pairs.count() // PER_BUCKET))
    asked = pairs.select(F.col("doc_id").cast("long"), "text", F.lit(0).alias("part")).mapInArrow(released(acyclic(_ask(split, size))), "bucket long, block long, fields binary")
    merged = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(acyclic(_merge_asked(split)), "bucket long, k long, word string, block long, fields binary")
    cut = lattice_bits(merged.repartition(split.buckets, "bucket"), table, keys=("k", "bucket"), also=("block", "fields"))
    answers = cut.select("bucket", "k", "at", "block", "fields").sortWithinPartitions("bucket", "k").mapInArrow(acyclic(_answer(table, split)), "block long, bucket long, check long, sizes binary, ids binary")
    answers = answers.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("bucket", "check", "sizes", "ids")).alias("answers"))
    joined = bundle(pairs, size, level=3).join(answers, F.col("block") == F.col("_block"), "left").select("block", "blob", "answers")
    schema = "doc_id long, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    return joined.mapInArrow(released(acyclic(_join(table, split, ids))), schema)


def decode(df: DataFrame, table: Pieces | None = None, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``df`` with the text of its array ``ids``; null stays null."""
    table = table or load()
    schema = T.StructType([f for f in df.schema if f.name != column] + [T.StructField(column, T.StringType())])
    names = [f.name for f in schema[:-1]]

    def run(batches):
        for b in batches:
            text = [None if x is None else table.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(text, pa.string())], [*names, column])

    return df.mapInArrow(run, schema)
