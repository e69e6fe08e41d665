"""Language-model scoring by deleted interpolation (Jelinek and Mercer, 1980).

The probability of a token is a mixture of maximum-likelihood estimates of rising order and a uniform one; the weights
depend on how frequent the context is, and are learned by expectation-maximisation on counts that were held out of the
estimates: one fold of the training texts ("tuning"). The estimates used for scoring then take all training folds.

Documents are bundled into blocks. A block sends its distinct n-grams, as sorted 64-bit hashes with counts, to buckets
by hash range; a bucket adds the blocks' counts and answers each block in the order it asked in. So what travels is the
distinct n-grams of a block and not its tokens, counted before the shuffle, and an n-gram that every document has comes
once from each block. As there are as many buckets as blocks, a corpus of more than ``FAN`` blocks asks in two steps: blocks
send to FAN ranges, where the requests of many blocks are merged into chunks, and the chunks ask the buckets of their
range; so every exchanged row holds many n-grams, and the rows grow with the distinct n-grams and not with blocks times
buckets. All texts are counted and scored; the tuning statistics are a histogram over fixed grids, the only
thing that reaches the driver besides the totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.blocks import bundle, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted, unpack_texts
from quern.llm.tables import LOWER, fold_of, staged

ORDER = 2
#: Bytes of text in a block.
SIZE = 8 << 20
FOLDS, HELD, TUNING = 10, 0, 1
#: Contexts are bucketed by the binary logarithm of their count, probabilities for tuning by steps of 1/GRID of it.
LEVELS, GRID, FLOOR = 24, 4, 48
END = xxhash.xxh64_intdigest(b"\x00end")
START = np.uint64(xxhash.xxh64_intdigest(b"\x00start"))
#: Ranges of hashes that a block asks at most, n-grams of a chunk.
FAN, CHUNK = 4096, 1 << 20
#: Parts of a bundle: text that is not learned from, text that is tuned on, the rest of the training text; a chunk has all.
TEST, TUNE, TRAIN, MIXED = 0, 1, 2, 3
_R = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def tagged(h: np.ndarray, order: int) -> np.ndarray:
    """The two lowest bits tell the order."""
    return (h & ~np.uint64(3)) | np.uint64(order)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


END_KEY = tagged(np.array([END], np.uint64), 1)[0]


def unique_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique`` with the inverse, by sorting the keys' high bits with the index below them: several times faster.

    Where two keys agree in the high bits and that leaves them out of order, the plain way is taken.
    """
    n, low = len(keys), max(1, int(len(keys)).bit_length())
    if n < 2:
        return np.unique(keys, return_inverse=True)
    mask = np.uint64((1 << low) - 1)
    order = (np.sort((keys & ~mask) | np.arange(n, dtype=np.uint64)) & mask).astype(np.int64)
    ordered = keys[order]
    if (ordered[1:] < ordered[:-1]).any():
        return np.unique(keys, return_inverse=True)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    places = np.empty(n, np.int64)
    places[order] = np.cumsum(new) - 1
    return ordered[new], places


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(4).integers(0, 1 << 64, 256, np.uint64)[np.frombuffer(LOWER, np.uint8)]
_BASE = 0x9FB21C651E98DF25


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text), over whole arrays of bytes: a word's hash is a polynomial over
    random letters, so no word becomes a Python object."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[buffer]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    sizes = ends - starts
    longest = int(sizes.max(initial=1))
    powers = np.cumprod(np.full(longest, _BASE, np.uint64))
    at = np.flatnonzero(inside)
    before = np.cumsum(sizes) - sizes
    term = _LETTER[buffer[at]] * powers[np.arange(len(at)) - np.repeat(before, sizes)]
    h = np.add.reduceat(term, before) if len(before) else np.zeros(0, np.uint64)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, ends_of), prepend=0)
    return mixed(h + sizes.astype(np.uint64)), counts


def hashes_of_words(text: bytes, size: int = 1 << 20) -> np.ndarray:
    """Hashes of a text's words, a piece at a time, cut between words: memory does not grow with eight times the text."""
    if len(text) <= size:
        return word_hashes([text])[0]
    out, at = [], 0
    while at < len(text):
        end = at + size
        if end < len(text):
            inside = ~_SPACE[np.frombuffer(text, np.uint8, min(size, len(text) - end), end)]
            end += int(np.argmin(inside)) if not inside.all() else len(inside)
            while end < len(text) and not _SPACE[text[end]]:  # a word longer than a piece
                end += 1
        out.append(word_hashes([text[at:end]])[0])
        at = end
    return np.concatenate(out)


def _pieces(texts: list[bytes], size: int = 1 << 20):
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


class Grams:
    """The n-grams of a block's texts, all tokens in a row; ``keys`` are its distinct ones in order."""

    def __init__(self, texts: list[bytes], order: int):
        got = [word_hashes(p) for p in _pieces(texts)]
        words = np.concatenate([x for x, _ in got]) if got else np.zeros(0, np.uint64)
        n_words = np.concatenate([x for _, x in got]).astype(np.int64) if got else np.zeros(0, np.int64)
        self.sizes = n_words + 1
        h = np.full(len(words) + len(texts), END, np.uint64)
        last = np.zeros(len(h), bool)
        last[np.cumsum(self.sizes) - 1] = True
        h[~last] = words
        sizes = self.sizes
        first = np.zeros(len(h), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        self.of = np.repeat(np.arange(len(sizes)), self.sizes)
        # rows of keys by order, and of the contexts' keys: an n-gram's context is the (n-1)-gram one token before, and at the start the end token, which is as frequent
        history = [h]
        by_order = [tagged(h, 1)]
        for n in range(2, order + 1):
            before = np.empty_like(h)
            before[1:], before[:1] = history[-1][:-1], START
            before[first] = START
            history.append(before)
            mix = np.full(len(h), n, np.uint64)
            for r, x in zip(_R, history):
                mix = mixed(mix + x * r)
            by_order.append(tagged(mix, n))
        self.keys, places = unique_places(np.concatenate(by_order))
        self.places = places.reshape(order, -1)
        self.contexts = []
        end = int(np.searchsorted(self.keys, END_KEY)) if len(self.keys) else 0
        for row in self.places[:-1]:
            c = np.empty_like(row)
            c[1:], c[:1] = row[:-1], end
            c[first] = end
            self.contexts.append(c)
        self.counts = np.bincount(places.ravel(), minlength=len(self.keys)).astype(np.uint64)


def _cuts(keys: np.ndarray, first: int, n: int, buckets: int) -> np.ndarray:
    """Where the range of hashes of each of ``n`` buckets from ``first`` begins in the sorted keys, which lie in them."""
    edges = np.array([(k << 64) // buckets for k in range(first, first + n)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


ASKED = "bucket long, block long, part int, keys binary, counts binary, tuned binary"


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "block", "part", "keys", "counts", "tuned"])


def _ask(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, part, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
                g = Grams(unpack_texts(blob)[1], order)
                cuts = _cuts(g.keys, 0, buckets, buckets)
                some = np.flatnonzero(np.diff(cuts))
                learned = np.zeros_like(g.counts) if part == TEST else g.counts
                yield _asked([(int(k), block, part, pack_sorted(g.keys[cuts[k] : cuts[k + 1]]), pack_numbers(learned[cuts[k] : cuts[k + 1]]), None) for k in some])

    return run


def _merged(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """From requests (bucket, block, part, keys, counts, tuned): the distinct keys, their counts over all and over the tuning
    texts, and the places of each request's keys."""
    keys = [unpack_sorted(r[3]) for r in rows]
    every, flat = unique_places(np.concatenate(keys))
    total, tuning = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
    places = np.split(flat, np.cumsum([len(k) for k in keys])[:-1])
    for r, p in zip(rows, places):
        c = unpack_numbers(r[4])
        total[p] += c
        if r[5] is not None:
            tuning[p] += unpack_numbers(r[5])
        elif r[2] == TUNE:
            tuning[p] += c
    return every, total, tuning, places


def _chunks(most: int):
    """Requests in the order of bucket to (chunk, range, keys, counts, tuned, members: list of (block, part, keys)): those of
    many blocks merged, ``most`` n-grams or a little more at a time."""
    member = pa.list_(pa.struct([("block", pa.int64()), ("part", pa.int32()), ("keys", pa.binary())]))
    kinds = {"chunk": pa.int64(), "range": pa.int64(), "keys": pa.binary(), "counts": pa.binary(), "tuned": pa.binary(), "members": member}

    def settle(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        every, total, tuning, _ = _merged(held)
        cols = chunk, held[0][0], pack_sorted(every), pack_numbers(total), pack_numbers(tuning), [{"block": r[1], "part": r[2], "keys": r[3]} for r in held]
        return pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cols, kinds.values())], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() * (1 << 24), [], 0
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(6))):
                if held and (held[-1][0] != r[0] or size >= most):
                    yield settle(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
                held.append(r)
                size += len(unpack_sorted(r[3]))
        if held:
            yield settle(chunk, held)

    return run


def _ask_again(ranges: int, each: int):
    """Chunks to their requests to the ``each`` buckets of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, at, *packed in zip(*(b.column(k).to_pylist() for k in range(5))):
                keys, counts, tuned = unpack_sorted(packed[0]), unpack_numbers(packed[1]), unpack_numbers(packed[2])
                cuts = _cuts(keys, at * each, each, ranges * each)
                some = np.flatnonzero(np.diff(cuts)).tolist()
                yield _asked([(at * each + k, chunk, MIXED, *(pack(x[cuts[k] : cuts[k + 1]]) for pack, x in ((pack_sorted, keys), (pack_numbers, counts), (pack_numbers, tuned)))) for k in some])

    return run


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, keys, members, answers of a chunk) to the answers of its members: (block, bucket, total, tuning)."""
    for b in batches:
        for at, packed, members, answers in zip(*(b.column(k).to_pylist() for k in range(4))):
            keys, answers = unpack_sorted(packed), sorted(answers, key=lambda a: a["bucket"])
            total, tuning = (np.concatenate([unpack_numbers(a[n]) for a in answers]) for n in ("total", "tuning"))
            rows = []
            for m in members:
                p = np.searchsorted(keys, unpack_sorted(m["keys"]))
                rows.append((m["block"], at, pack_numbers(total[p]), pack_numbers(tuning[p]) if m["part"] == TUNE else b""))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["block", "bucket", "total", "tuning"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of bucket to (block, bucket, total, tuning, n_words, n_tokens, n_tuning): counts over all training
    texts and over the tuning ones for the block's keys; the last three are the bucket's own totals, on one row of it."""
    held: list[tuple] = []

    def settle():
        every, total, tuning, places = _merged(held)
        words = (every & np.uint64(3)) == 1
        own = int(np.count_nonzero(words & (total > 0))), int(total[words].sum()), int(tuning[words].sum())
        rows = []
        for n, (r, p) in enumerate(zip(held, places)):
            rows.append((r[1], r[0], pack_numbers(total[p]), pack_numbers(tuning[p]) if r[2] in (TUNE, MIXED) else b"", *(own if n == 0 else (0, 0, 0))))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["block", "bucket", "total", "tuning", "n_words", "n_tokens", "n_tuning"])

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(6))):
            if held and held[-1][0] != r[0]:
                yield settle()
                held = []
            held.append(r)
    if held:
        yield settle()


def estimates(g: Grams, counts: np.ndarray, n_tokens: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(context level per token, estimates by order per token: uniform, unigram, ...)."""
    f = [np.full(g.places.shape[1], 1 / (n_words + 1)), counts[g.places[0]] / max(1, n_tokens)]
    level = np.zeros(g.places.shape[1], np.int64)
    for row, context in zip(g.places[1:], g.contexts):
        seen = counts[context]
        f.append(counts[row] / np.maximum(seen, 1))
        level = np.where(seen > 0, np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64) + 1, LEVELS - 1), 0 if len(f) == 3 else level)
    return level, np.array(f)


def _cells(level: np.ndarray, f: np.ndarray) -> np.ndarray:
    """One number for the level and the gridded estimates above the uniform one; 0 on the grid is the estimate 0."""
    cell = level
    for x in f[1:]:
        cell = cell * (FLOOR * GRID) + np.where(x > 0, np.clip(FLOOR * GRID - 1 + np.round(np.log2(np.maximum(x, 1e-300)) * GRID), 1, FLOOR * GRID - 1), 0).astype(np.int64)
    return cell


def learn_weights(cells: np.ndarray, counts: np.ndarray, order: int, uniform: float, rounds: int = 60) -> np.ndarray:
    """Expectation-maximisation of the mixture weights by context level, from the tuning histogram."""
    f, c = [], cells.copy()
    for _ in range(order):
        x = c % (FLOOR * GRID)
        f.append(np.where(x > 0, 2.0 ** ((x - (FLOOR * GRID - 1)) / GRID), 0))
        c //= FLOOR * GRID
    f = np.array([np.full(len(cells), uniform), *f[::-1]])
    weights = np.full((LEVELS, order + 1), 1 / (order + 1))
    prior = np.full(order + 1, 0.01)  # keeps every weight above zero, so that no text has probability zero
    for _ in range(rounds):
        share = weights[c].T * f
        share = share / np.maximum(share.sum(0), 1e-300) * counts
        new = np.array([np.bincount(c, s, LEVELS) for s in share]).T + prior
        weights = new / new.sum(1, keepdims=True)
    return weights


def _with_counts(batches: Iterator[pa.RecordBatch], order: int):
    """(block, part, blob, answers: list of (bucket, total, tuning)) to (ids, Grams, total, tuning)."""
    for b in batches:
        for row in range(len(b)):
            ids, texts = unpack_texts(b.column(2)[row].as_py())
            answers = sorted(b.column(3)[row].as_py(), key=lambda a: a["bucket"])
            total = np.concatenate([unpack_numbers(a["total"]) for a in answers]).astype(np.float64)
            tuning = np.concatenate([unpack_numbers(a["tuning"]) for a in answers]).astype(np.float64) if answers[0]["tuning"] else None
            yield ids, Grams(texts, order), total, tuning


def score(docs: DataFrame, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A-Z is lowered; tokens are the words and one end; null counts as empty, which is the end alone. Fold 0 of the ids'
    crc32 is never learned from, fold 1 also tunes the weights; a null id counts as the empty text. Unknown words share
    one place of the uniform estimate. Where there is nothing to tune on the weights are equal. An empty table gives an
    empty result, and training texts may be missing: every word is then unknown.
    """
    fold = fold_of(doc_id, FOLDS)
    part = F.when(fold == HELD, TEST).when(fold == TUNING, TUNE).otherwise(TRAIN)
    blocks = staged(bundle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), part.alias("_part")), SIZE, "_part"), "blocks")
    buckets = max(1, blocks.count())
    ranges, each = (buckets, 1) if buckets <= FAN else (FAN, -(-buckets // FAN))
    asked = blocks.mapInArrow(_ask(order, ranges), ASKED)
    if each > 1:
        merged = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_chunks(CHUNK), "chunk long, range long, keys binary, counts binary, tuned binary, members array<struct<block: long, part: int, keys: binary>>")
        chunks = staged(merged, "chunks")
        asked = chunks.select("chunk", "range", "keys", "counts", "tuned").mapInArrow(_ask_again(ranges, each), ASKED)
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "block long, bucket long, total binary, tuning binary, n_words long, n_tokens long, n_tuning long")
    answers = staged(answers, "answers")
    n_words, n_tokens, n_tuning = (int(x or 0) for x in answers.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_tuning")).first())
    if each > 1:
        of_chunk = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "total", "tuning")).alias("answers"))
        back = chunks.join(of_chunk, F.col("chunk") == F.col("block")).select("range", "keys", "members", "answers")
        answers = staged(back.mapInArrow(_scatter, "block long, bucket long, total binary, tuning binary"), "scattered")
    by_block = answers.groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("bucket", "total", "tuning")).alias("answers"))
    answered = blocks.join(by_block, F.col("block") == F.col("_block")).select("block", "part", "blob", "answers")

    def histogram(batches):
        for ids, g, total, tuning in _with_counts(batches, order):
            level, f = estimates(g, total - tuning, n_tokens - n_tuning, n_words)
            cells, n = np.unique(_cells(level, f), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n.astype(np.int64))], ["cell", "n"])

    tuned = answered.filter(F.col("part") == TUNE).mapInArrow(histogram, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learn_weights(tuned["cell"].to_numpy(np.int64), tuned["n"].to_numpy(np.float64), order, 1 / (n_words + 1))

    def run(batches):
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        for ids, g, total, _ in _with_counts(batches, order):
            level, f = estimates(g, total, n_tokens, n_words)
            c = total[g.places[0]]
            n = len(ids)
            base = np.bincount(g.of, np.log10((c + 0.1) / (n_tokens + 0.1 * (n_words + 1))), n)
            model = np.bincount(g.of, np.log10((weights[level].T * f).sum(0)), n)
            known = np.bincount(g.of, c > 0, n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(g.sizes), pa.array(known), pa.array(np.full(n, n_tokens, np.int64)), pa.array(base), pa.array(model)], names)

    scored = answered.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
