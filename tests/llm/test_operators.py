"""The training-data operators against brute-force versions on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import dataclasses
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import blocks, bwt, components, exact_dedup, langid, lm, matroska, mixing, near_copies, pieces, quality, repeats, simhash, tables, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, _id int"
WORDS = "the of river stone light water green house walk small mountain open letter garden winter".split()


def texts(n: int = 60, seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    own = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(120))
    own[3] = own[4] = own[5]
    own[7] = passage + " one end " + own[7]
    own[8] = own[8] + " another start " + passage
    own[9] = passage + passage
    return own + [None, "", "   ", "é ü\n\n\tÀ", "ONE word", "one word", "日本語のテキスト"]


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(k, x, ("en", "de", None)[k % 3], ("a", "a", "b", None)[k % 4], k, "x", 1, 2) for k, x in enumerate(t)]
    rows += [rows[10], (None, "no id", "en", "a", 0, "x", 1, 2), (500, t[5], "en", "a", 0, "x", 1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (exact_dedup.exact_dedup(empty), mixing.mix(empty), quality.quality(empty, labels), lm.score(empty), langid.languages(empty), pieces.encode(empty), repeats.remove_repeats(empty), token_counts.edited_counts(empty), simhash.near_duplicates(empty), matroska.media_digests(empty)):
        assert out.collect() == []


@pytest.mark.parametrize("counters", [1, 3, 4096])
def test_exact_dedup(docs, counters):
    got = exact_dedup.exact_dedup(docs, counters=counters).collect()
    groups = defaultdict(list)
    for k, t in pairs(docs):
        groups[hashlib.sha256(t.encode()).hexdigest()].append(k)
    want = Counter((k, max((x for x in g if x is not None), default=None), len(g), h) for h, g in groups.items() for k in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in kept)
    rows = exact_dedup.keep_one_of_each(docs)
    assert rows.columns == docs.columns and rows.count() == len(groups)


def test_misra_gries_bound():
    rng = np.random.default_rng(3)
    x = np.r_[np.full(400, 7), rng.integers(100, 1000, 600)]
    rng.shuffle(x)
    got = exact_dedup.misra_gries(np.split(x, 10), 9)
    assert len(got) <= 9 and 400 - len(x) / 10 <= got[7] <= 400


def test_mixing(docs, spark):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r.source] += len((r.text or "").encode().translate(None, b"").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = dict(zip(order, (3, 1, 2)))
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:  # water-filling, one source at a time
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            target[s] = min(2 * sizes[s], level * weight[s])
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (r.size * int(r.rate), r.size * (int(r.rate) + 1)) and r.taken <= 2 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    copies = mixing.emit_copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r.copies for r in got)


def test_quality_learns_and_is_stable(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(WORDS if k % 2 else ["click", "buy", "free", "win"]) for _ in range(40))) for k in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert len(held) > 50 and all(r.predicted == r.doc_id % 2 for r in held)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 for k, r in got.items())
    assert got[900].score == got[901].score
    assert len({r.score for r in quality.quality(docs, labels.limit(0)).collect()}) == 1


def test_quality_sample_is_whole(spark):
    """Long texts, ids that the documents lack, nulls, repeats and conflicts."""
    long = "word " * 40_000
    docs = spark.createDataFrame([(k, "short text", "x") for k in range(40)] + [(50, long, "x"), (50, long, "x"), (51, None, "x"), (None, "a", "x"), (52, "b", "x"), (52, "a", "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 1) for k in range(1000, 3000)] + [(3, None), (None, 1), (50, 1), (52, 0)], "doc_id long, quality int")
    own = lambda k: zlib.crc32(str(k).encode()) % 3 != 1
    got = {r.id: (r.text, r.label) for r in quality.sample(docs, labels).collect()}
    want = {k: ("short text", k % 2) for k in range(40)} | {50: (long, 1), 51: ("", 1), 52: ("a", 0)}
    assert got == {k: v for k, v in want.items() if own(k)}
    assert quality.sample(docs, labels, rows=10).count() == 10
    scored = quality.quality(docs.withColumn("score", F.lit(1)).withColumn("held_out", F.lit(1)), labels).collect()
    assert len(scored) == docs.count() and len({r.score for r in scored if r.doc_id == 50}) == 1


def test_quality_contexts_by_brute_force():
    rng = np.random.default_rng(3)
    own = rng.integers(-1, 2, (30, quality.WIDTH)).astype(np.int8)
    rows = [rng.integers(0, 30, n) for n in (0, 1, 2, 3, 400)]
    want = np.zeros(own.shape, np.int64)
    for ids in rows:
        for a in range(len(ids)):
            for b in range(max(0, a - quality.WINDOW), min(len(ids), a + quality.WINDOW + 1)):
                want[ids[a]] += own[ids[b]] if a != b else 0
    assert np.array_equal(quality.contexts(rows, own), want)


def test_held_out_accuracy_on_the_tables(spark):
    """Quality and language of rows that nothing was learned from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.quality(docs, labels).filter("held_out").join(labels, "doc_id").filter("quality is not null").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.97 and sum(r.predicted == r.quality for r in rows) > 0.95 * len(rows)
    told = langid.languages(docs).filter("held_out and lang_pred <> 'und'").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null").collect()
    assert len(told) > 100 and sum(r.lang_pred == r.lang for r in told) > 0.97 * len(told)


@pytest.mark.parametrize("fan", [4096, 3])
def test_lm_base_score_and_proper_model(docs, fan, monkeypatch):
    monkeypatch.setattr(lm, "FAN", fan)  # 3: through chunks
    monkeypatch.setattr(lm, "CHUNK", 200 if fan == 3 else 1 << 20)
    monkeypatch.setattr(lm, "SIZE", 2000 if fan == 3 else 8 << 20)
    got = lm.score(docs).collect()
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10
    toks = [(k, [*t.encode().lower().split(), b"\0"]) for k, t in pairs(docs)]
    c = Counter(w for k, ws in toks if fold(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((k, len(ws), sum(c[w] > 0 for w in ws), round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for k, ws in toks)
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == (fold(r.doc_id) == 0) for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held) * 1.5


def test_lm_score_by_brute_force(docs, monkeypatch):
    """The mixture of the estimates with given weights, from plain counts of tokens and pairs."""
    weights = np.random.default_rng(5).dirichlet([1, 1, 1], lm.LEVELS)
    monkeypatch.setattr(lm, "learn_weights", lambda *a: weights)
    got = lm.score(docs).collect()
    fold = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 10
    toks = [(k, [*t.encode().translate(simhash.LOWER).split(), b"\0"]) for k, t in pairs(docs)]
    one, two = Counter(), Counter()
    for k, ws in toks:
        if fold(k):
            one.update(ws)
            two.update(zip([b"\0start", *ws], ws))
    n, v = sum(one.values()), len(one)
    want = []
    for k, ws in toks:
        total = 0.0
        for before, w in zip([b"\0start", *ws], ws):
            seen = one[b"\0" if before == b"\0start" else before]
            level = min(int(np.log2(seen)) + 1, lm.LEVELS - 1) if seen else 0
            total += np.log10(weights[level] @ [1 / (v + 1), one[w] / n, two[before, w] / max(seen, 1)])
        want.append((str(k), total))
    have = sorted((str(r.doc_id), r.score) for r in got)
    assert [k for k, _ in have] == [k for k, _ in sorted(want)] and [x for _, x in have] == pytest.approx([x for _, x in sorted(want)], abs=1e-5)


def test_lm_weights_recover_a_mixture():
    rng = np.random.default_rng(0)
    level, f = np.full(20000, 5), np.array([np.full(20000, 0.001), rng.choice([2.0**-3, 2.0**-8], 20000), rng.choice([0, 2.0**-1], 20000)])
    cells, n = np.unique(lm._cells(level, f), return_counts=True)
    w = lm.learn_weights(cells, n, 2, 0.001)[5]
    assert w.sum() == pytest.approx(1) and w[1] > 0.3 and w[2] > 0.2


def test_langid_accuracy(spark):
    rng = random.Random(4)
    bags = {"en": WORDS, "de": "der die und haus grün straße fluss stein licht klein garten".split(), "fr": "le la une maison rivière pierre lumière été petit jardin".split()}
    rows = [(k, " ".join(rng.choice(bags[lang]) for _ in range(30)), lang) for k in range(300) for lang in [list(bags)[k % 3]]]
    rows += [(700, None, "en"), (701, "123 !?", "en"), (702, "", "de"), (703, "²½", "en"), (704, "① _ ٣", "en"), (None, "garden water", "en"), (705, "wort " * 30_000, "de"), (705, "wort " * 30_000, "de")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.languages(table.withColumn("score", F.lit(0)).withColumn("id", F.lit(0))).collect()}
    assert len(got) == len(rows) - 1 and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (700, 701, 702, 703, 704))
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:300]) and all(0 <= r.score <= 1 for r in got.values())


def test_langid_learns_every_language(spark):
    """200 languages; one of them has two long texts, as many slices as those of many short ones."""
    rng = random.Random(14)
    name = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    bags = {f"l{k}": [name(6) for _ in range(8)] for k in range(200)}
    rows = [(10 * k + j, " ".join(rng.choice(bag) for _ in range(40)), lang) for k, (lang, bag) in enumerate(bags.items()) for j in range(6)]
    rows += [(90_000 + j, "langer " + " ".join(name(7) for _ in range(60_000)), "long") for j in range(9)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.samples) == {*bags, "long"} and len(model.samples["long"]) > 0.9 * langid.DICTIONARY
    text = " ".join(bags["l77"] * 5)
    assert langid.Classifier({k: v for k, v in model.samples.items() if k in ("l76", "l77", "l78", "long")}).predict(text)[0] == "l77"


def test_pieces_match_the_library(docs, spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    odd = [" a", "a  b", "  ", "a ", "\n\n a", "a\n b\tc", "foo,bar!! (baz)'s l'eau 12,3 é,ü", "aé  èñ", "🙂🙂 a🙂", "ab" * 40, "é" * 70, "x▁ y", "▁"]
    table = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + k, x) for k, x in enumerate(odd)], "doc_id long, text string"))
    got = pieces.encode(table, ids=True, size=1 << 12).collect()
    want = Counter((k, tuple(model.encode(t)), "▁" not in t) for k, t in pairs(table))
    assert Counter((r.doc_id, tuple(r.ids), r.round_trip) for r in got) == want
    shown = pieces.decode(pieces.encode(table, ids=True), column="shown").collect()
    assert Counter((r.doc_id, r.shown) for r in shown) == Counter((k, t.replace("▁", " ")) for k, t in pairs(table))


def test_pieces_split_each_field_and_text_once():
    """Answering a bucket splits each different field once, and a block's texts are cut into fields once."""

    class Counting(pieces._Splitter):
        asked: list = []

        def words(self, field):
            self.asked.append(field)
            return super().words(field)

        def fields(self, text):
            self.asked.append(text)
            return super().fields(text)

    table = pieces.load()
    split, made = Counting(table, 1), [f"word{k} (other{k})! d\u00e9j\u00e0".encode() for k in range(40)]
    fields = split.by_bucket(split.distinct(made))[0]
    words = pieces._words(split, fields)
    at = [sum(1 << k for k in table._merge(w)) for w in words]
    columns = [[0] * (len(at) + 1), [-1, *range(len(at))], [None, *at], [5] + [None] * len(at), [pieces.pack_fields(fields)] + [None] * len(at)]
    batch = pieces.pa.RecordBatch.from_arrays([pieces.pa.array(c) for c in columns], ["bucket", "k", "at", "block", "fields"])
    Counting.asked = []
    (answer,) = pieces._answer(table, split)([batch])
    assert sorted(Counting.asked) == sorted(fields)
    answers = [{n: answer.column(n)[0].as_py() for n in ("bucket", "check", "sizes", "ids")}]
    block = pieces.pa.RecordBatch.from_arrays([pieces.pa.array(c) for c in ([5], [blocks.pack_texts(range(40), made)], [answers])], ["block", "blob", "answers"])
    Counting.asked = []
    (out,) = pieces._join(table, split, True)([block])
    assert Counting.asked == made and all(out.column("round_trip").to_pylist())
    assert [table.decode(x).encode() for x in out.column("ids").to_pylist()] == made


def test_pieces_hold_a_block_s_texts_once_at_most(monkeypatch):
    """Bundling, asking and joining copy a block's texts by and by: what they allocate beyond them is bounded by parts of them."""
    rng, table = random.Random(8), pieces.load()
    split, known = pieces._Splitter(table, 1), ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    made = [" ".join(rng.choices(known, k=600)).encode() for _ in range(4000)]
    total, fields = sum(map(len, made)), split.by_bucket(split.distinct(made))[0]

    def peak(run):
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1] / total
        finally:
            tracemalloc.stop()

    blob, most = peak(lambda: blocks.pack_texts(range(4000), made))
    assert list(blocks.each_text(blob)) == list(enumerate(made)) and blocks.unpack_texts(blob)[1] == made
    assert most < 1.2  # the packed form twice while its chunks are joined; the texts joined as well would be 2
    monkeypatch.setattr(blocks, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": classmethod(lambda cls: 0)}))
    rows = pieces.pa.table([pieces.pa.array(c) for c in (list(range(4000)), [t.decode() for t in made], [0] * 4000)], ["doc_id", "text", "part"]).to_batches()
    asked, most = peak(lambda: list(pieces._ask(split, 1 << 30)(iter(rows))))
    assert pieces.unpack_fields(asked[0].column("fields")[0].as_py()) == fields
    assert most < 0.3  # the distinct fields, not the texts
    got = [[k for w in split.words(f) for k in table.encode_word(w)] for f in fields]
    answer = {"bucket": 0, "check": pieces._check(fields), "sizes": pieces.pack_numbers(np.array(list(map(len, got)), np.uint64)), "ids": pieces.pack_numbers(np.array(sum(got, []), np.uint64))}
    block = pieces.pa.RecordBatch.from_arrays([pieces.pa.array(c) for c in ([5], [blob], [[answer]])], ["block", "blob", "answers"])
    counts, most = peak(lambda: [(sum(b.column("n_pieces").to_pylist()), all(b.column("round_trip").to_pylist())) for b in pieces._join(table, split, False)([block])])
    sizes = dict(zip(fields, map(len, got)))
    assert sum(n for n, _ in counts) == sum(sizes[f] for t in made for f in t.split()) and all(x for _, x in counts)
    assert most < 2  # the fields' numbers and the texts whose rows are being made


def test_unigram_lattice_is_viterbi(spark):
    rng = random.Random(5)
    scores = {"".join(p): -rng.random() * 9 for n in (1, 2, 3) for p in [rng.choices("abc", k=n) for _ in range(12)]}
    table = pieces.Pieces({p: k for k, p in enumerate(scores)}, scores, [-1] * 256, 99, False)
    words = ["".join(rng.choices("abcd", k=n)) for n in range(1, 15)]
    got = pieces.lattice(spark.createDataFrame([(w,) for w in set(words)], "word string"), table).collect()
    low = min(scores.values()) - 10

    def best(w):
        return max((scores.get(w[:k], low if k == 1 else -1e9) + best(w[k:]) for k in range(1, len(w) + 1)), default=0.0)

    for r in got:
        cost = sum(scores.get(r.word[a:b], low) for a, b in zip(r.bounds, r.bounds[1:]))
        assert cost == pytest.approx(best(r.word))


def removed(all_texts: list[bytes], length: int = 400) -> list[np.ndarray]:
    count = Counter(t[k : k + length] for t in all_texts for k in range(len(t) - length + 1))
    out = []
    for t in all_texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append(gone)
    return out


def passage_words(rows: list[tuple], length: int = 50) -> list[int]:
    words = [t.translate(simhash.LOWER).split() for _, t in rows]
    places = defaultdict(set)
    for key, w in zip(rows, words):
        for k in range(len(w) - length + 1):
            places[tuple(w[k : k + length])].add(key)
    out = []
    for w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if len(places[tuple(w[k : k + length])]) > 1:
                gone[k : k + length] = True
        out.append(int(gone.sum()))
    return out


def same_as_brute(table, got) -> list[tuple]:
    rows = [(k, t.encode()) for k, t in pairs(table)]
    masks = removed([t for _, t in rows])
    want = [(k, len(t), int(g.sum()), int(np.count_nonzero(np.diff(np.r_[0, g.view(np.int8)]) > 0)), hashlib.sha256(bytes(b for b, x in zip(t, g) if not x)).hexdigest(), n) for (k, t), g, n in zip(rows, masks, passage_words(rows))]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    return want


@pytest.mark.parametrize(("group", "hot", "part"), [(256, 4096, 1 << 20), (1, 3, 500)])
def test_repeats(docs, spark, group, hot, part, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(tables, "HOT", hot)
    rng = random.Random(9)
    inside = " ".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(70))
    extra = spark.createDataFrame([(2000, "x" * 900), (2001, "ab" * 300 + "c"), (2002, "z" * 399), (2003, f"{inside} a b c {inside}"), (2004, "w " * 60), (2005, "W\n" * 49)], "doc_id long, text string")
    table = docs.select("doc_id", "text").union(extra)
    units = {"unit": dataclasses.replace(repeats.BYTES, part=part), "passage": dataclasses.replace(repeats.WORDS, part=part)}
    want = same_as_brute(table, repeats.remove_repeats(table, **units))
    assert sum(w[2] > 0 for w in want) > 5 and sum(w[5] > 0 for w in want) > 2 and sum(w[2] > 0 and not w[5] for w in want) > 1


@pytest.mark.parametrize(("group", "hot"), [(256, 4096), (4, 8)])
def test_repeats_planted_passages(spark, group, hot, monkeypatch):
    """Passages of 300 to 700 bytes, exact and nearly so, in many documents over several partitions: those of 400 bytes and
    more go, all of 50 words and more are counted."""
    monkeypatch.setattr(repeats, "GROUP", group)
    monkeypatch.setattr(tables, "HOT", hot)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5)))
    own = lambda n: " ".join(word() for _ in range(n))
    planted = []
    for size in (300, 399, 400, 401, 700):
        p = own(200)[: size - 1] + "~"
        for k in range(12):
            planted.append((size, f"{own(rng.randint(0, 30))} |{p}| {own(rng.randint(0, 30))}".strip()))
        at = size // 2
        planted.append((0, f"{own(20)} |{p[:at]}#{p[at + 1 :]}| {own(20)}"))
    clean = [own(rng.randint(1, 150)) for _ in range(40)]
    table = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(planted)] + [(1000 + k, t) for k, t in enumerate(clean)], "doc_id long, text string").repartition(7)
    got = repeats.remove_repeats(table)
    same_as_brute(table, got)
    by_id = {r.doc_id: r for r in got.collect()}
    for k, (size, _) in enumerate(planted):
        # the marks around it are part of the passage
        assert (by_id[k].n_removed >= 400) == (size + 2 >= 400) or size == 0
        assert by_id[k].passage_words >= 50 or size == 0
    assert all(r.n_removed == r.passage_words == 0 for k, r in by_id.items() if k >= 1000)


def test_repeats_lists_few_windows_of_a_large_group(spark, monkeypatch):
    """Many near copies of a text, each with a word of its own: settled blocks are compared with by one or two places only,
    so the blocks and windows that are listed stay within a small multiple of the spans to compare."""
    monkeypatch.setattr(repeats, "GROUP", 4)
    rng = random.Random(16)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 5))) for _ in range(160)]
    rows = []
    for k in range(150):
        new = list(base)
        new[rng.randrange(160)] = f"x{k}"
        rows.append((k, " ".join(new)))
    made, write = defaultdict(list), repeats.staged

    def counted(df, name):
        out = write(df, name)
        made[name].append(out.count())
        return out

    monkeypatch.setattr(repeats, "staged", counted)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    same_as_brute(table, repeats.remove_repeats(table))
    assert sum(made["span-blocks"] + made["windows"]) < 12 * sum(made["contexts"])


def test_words_of_long_texts():
    rng = random.Random(11)
    text = "".join(rng.choice(["word ", "x", " ", "\n", "longer-", "é"]) for _ in range(5000)).encode()
    for size in (7, 64, 1000, 1 << 20):
        assert np.array_equal(lm.hashes_of_words(text, size), lm.word_hashes([text])[0])


def test_merged_transforms_find_the_same():
    t = [x.encode() for x in texts(20, 6) if x]
    got = bwt.covered([t[:7], t[7:8], t[8:]], 400)
    for a, b in zip([m for s in got for m in s], removed(t)):
        assert np.array_equal(a, b)


def random_edit(rng, text: str) -> tuple[int, int, str]:
    a = rng.randint(0, len(text))
    return a, a + rng.choice([0, 3, 30, 30, 400, 3000]), rng.choice(["", "s", " 's", "  \n", "new text here ", " more" * 300])


def consistent(node) -> bool:
    if node.kids is None:
        return (node.chars, node.tokens, node.pieces) == (sum(map(int, node.lens)), sum(map(int, node.toks)), len(node.lens)) and len(node.lens) <= 2 * token_counts.LEAF
    sums = tuple(sum(getattr(k, n) for k in node.kids) for n in ("chars", "tokens", "pieces"))
    return (node.chars, node.tokens, node.pieces) == sums and 0 < len(node.kids) <= 2 * token_counts.FAN and all(k.up is node and consistent(k) for k in node.kids)


def test_token_counts_after_edits(monkeypatch):
    counter = token_counts.load_counter()
    rng = random.Random(7)
    for n in range(40):
        monkeypatch.setattr(token_counts, "LEAF", rng.choice([2, 5, 64]))
        monkeypatch.setattr(token_counts, "FAN", rng.choice([2, 16]))
        text = "".join(rng.choice(["word ", "it's", "  ", "\n", "12", "é", "!?", "日本", " x"]) for _ in range(rng.choice([0, 50, 400, 3000])))
        tree = token_counts.CountTree(text, counter)
        for _ in range(8):
            a, b, new = random_edit(rng, tree.text)
            want = tree.text[:a] + new + tree.text[b:]
            touched = tree.replace(a, b, new)
            fresh = token_counts.CountTree(want, counter)
            assert (tree.text, tree.total, tree.pieces) == (want, fresh.total, fresh.pieces) and consistent(tree.root)
            # what the edit put in, and a few pre-tokens of context on either side
            assert touched <= len(counter.pattern.findall(new)) + 8
            tree = token_counts.unpack(token_counts.pack(tree), counter)
            assert consistent(tree.root) and tree.total == fresh.total


def count_fresh(counter, text: str) -> tuple[int, int]:
    found = counter.pattern.findall(text)
    return len(found), sum(len(counter.encode(p)) for p in found)


def test_token_counts_query(docs):
    counter = token_counts.load_counter()
    counter.counts(["a"])
    got = token_counts.edited_counts(docs).collect()
    want, most = Counter(), {}
    for k, t in pairs(docs):
        new = t
        for a, b, x in token_counts.sample_edits(str(k), len(t), 3):
            new = new[: min(a, len(new))] + x + new[max(min(b, len(new)), min(a, len(new))) :]
        want[k, *count_fresh(counter, t), count_fresh(counter, new)[1], len(new)] += 1
        most[k] = 3 * 14
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens, r.edited_tokens, r.edited_chars) for r in got) == want
    assert all(0 <= r.n_encoded <= most[r.doc_id] for r in got) and sum(r.n_encoded for r in got) > 0


def test_token_counts_take_a_table_of_edits(spark, docs):
    counter, rng = token_counts.load_counter(), random.Random(13)
    counter.counts(["a"])
    rows = [(k % 9, k, *random_edit(rng, "x" * 200)) for k in range(60)] + [(500, 1, -5, 10**9, None), (None, 1, 0, 1, "x"), (9999, 1, 0, 1, "x"), (10, 1, 0, 0, "same id twice ")]
    edits = spark.createDataFrame(rows, "doc_id long, seq long, start long, stop long, new string").repartition(5)
    trees = tables.staged(token_counts.build(docs), "trees")
    after = token_counts.edit(trees, edits).collect()
    want = Counter()
    for k, t in pairs(docs):
        for d, _, a, b, x in rows:
            if d == k and k is not None:
                a = min(max(a, 0), len(t))
                t = t[:a] + (x or "") + t[max(a, min(b, len(t))) :]
        want[k, *count_fresh(counter, t), len(t)] += 1
    assert Counter((r.doc_id, r.n_pretokens, r.n_tokens, r.n_chars) for r in after) == want
    assert all(token_counts.unpack(r.tree, counter).total == r.n_tokens for r in after)
    assert {r.doc_id for r in after if r.n_encoded} - {500} == {*range(9), 10}  # 500 is emptied, which encodes nothing


def brute_components(fps: list[int], ids: list) -> list:
    up = list(range(len(fps)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[root(k)].append(i)
    return [min((x for x in least[root(k)] if x is not None), default=None) for k in range(len(fps))]


def test_simhash(docs):
    rows = pairs(docs)
    fps = []
    for _, t in rows:
        w = t.encode().translate(simhash.LOWER).split()
        h = [simhash.xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h)))
    want = Counter((k, f"{fp:016x}", c) for (k, _), fp, c in zip(rows, fps, brute_components(fps, [k for k, _ in rows])))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want


@pytest.mark.parametrize(("split", "large"), [(4096, 4096), (4, 1), (4, 1 << 30)])
def test_simhash_links_by_bk_trees(spark, split, large, monkeypatch):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (1 << 64) - 1 for b in base for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.linked(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_components(fps, signed)
    assert [got.get(f, f) for f in signed] == want


@pytest.mark.parametrize("mode", [1, 2, 3])
def test_matroska_round_trip(mode):
    rng = np.random.default_rng(mode)
    for n in (1, 8, 9, 300):
        payload = rng.integers(0, 256, n * matroska.UNIT, np.uint8).tobytes()
        data = matroska.write(payload, mode=mode)
        back, p = matroska.read_back(data)
        assert back == payload and p.complete and len(p.packets) == n and len(p.cues) == p.clusters
        cut = matroska.parse(data[: len(data) // 2])
        assert cut.packets == p.packets[: len(cut.packets)]


def test_matroska_query(docs):
    got = matroska.media_digests(docs).collect()
    for r, (k, t) in zip(sorted(got, key=str), sorted(pairs(docs), key=lambda p: str(p[0]))):
        assert r.n_bytes >= 0 and r.payload_bytes % matroska.UNIT == 0 and r.payload_bytes > 0
    want = Counter((k, len(b := t.encode()), hashlib.sha256(p := matroska.pad(b)).hexdigest(), zlib.crc32(p[-32:])) for k, t in pairs(docs))
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    media = matroska.media_column(docs).collect()
    assert Counter((r.doc_id, len(r.media), hashlib.sha256(r.media).hexdigest()) for r in media) == Counter((r.doc_id, r.media_bytes, r.media_sha256) for r in got)
    shown = Counter()
    for k, t in pairs(docs):
        x = list(matroska.pad(t.encode()))
        packets = len(x) // 576
        sums = f"sum={sum(x)};square={sum(v * v for v in x)};crossings={sum((a >= 128) != (b >= 128) for a, b in zip(x, x[1:]))}"
        shown[k, f"codec=A_PCM/INT/LIT;rate=8000;bits=8;packets={packets};clusters={-(-packets // 256)};cues={-(-packets // 256)};last_ms={72 * (packets - 1)};{sums}"] += 1
    assert Counter((r.doc_id, r.feature) for r in got) == shown
    table = matroska.packet_table(matroska.media_column(docs.filter("doc_id = 9"))).collect()
    assert [r.timestamp_ns for r in table] == [72_000_000 * k for k in range(len(table))] and all(r.n_bytes == matroska.UNIT for r in table)


def test_rare_digests_are_not_broadcast(docs, monkeypatch):
    seen, real = {}, exact_dedup.staged
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: seen.setdefault(name, real(df, name)))
    got = exact_dedup.exact_dedup(docs).collect()
    counts = Counter(t for _, t in pairs(docs))
    assert seen["winners"].count() == sum(n > 1 for n in counts.values()) and sum(r.kept for r in got) == len(counts)


def test_one_of_each_text_stays(docs):
    kept = exact_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    best = {}
    for k, t in pairs(docs):
        best[t] = max(best.get(t, -1), -1 if k is None else k)
    assert Counter((r.doc_id, r.text or "") for r in kept.select("doc_id", "text").collect()) == Counter((None if k < 0 else k, t) for t, k in best.items())


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "mixing", "pieces"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns and after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    texts_left = [r.text for r in before.select("text").collect()]
    assert len(texts_left) == len(set(texts_left)) > 0
    out = corpus_pipeline.run(spark, sf)
    assert out.filter("not round_trip").count() == 0 and out.join(before, "doc_id", "left_anti").count() == 0


def test_pipeline_stages_on_odd_tables(spark, docs, empty, tmp_path):
    """Nulls, empty and repeated texts, clashing columns; and nothing at all."""
    import corpus_pipeline

    spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int").write.parquet(f"file://{tmp_path}/labels.parquet")
    odd = docs.select("*", *(F.lit(1).alias(n) for n in ("_key", "_mark", "_row", "_score", "_source", "_rate", "_copy", "score", "node", "bucket")))
    scores_ = quality.quality(odd, spark.read.parquet(f"file://{tmp_path}/labels.parquet")).filter("score >= 0.5")
    kept = corpus_pipeline.keep_good(spark, odd, f"file://{tmp_path}")
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(r.doc_id for r in scores_.collect())
    mixed = corpus_pipeline.mix(spark, odd, "")
    copies = Counter()
    for r in mixing.mix(odd).collect():
        copies[r.doc_id] += r.copies
    assert mixed.columns == odd.columns and Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +copies
    assert corpus_pipeline.drop_copies(spark, odd, "").columns == corpus_pipeline.drop_near_copies(spark, odd, "").columns == odd.columns
    assert corpus_pipeline.encode(spark, odd, "").count() == odd.count()
    assert all(stage(spark, empty, f"file://{tmp_path}").isEmpty() for _, stage in corpus_pipeline.STAGES)


def test_across_joins_only_what_can_be_similar(spark):
    """A passage that all texts have makes no pairs; those at the threshold are all there."""
    rng = random.Random(15)
    passage = list(range(60))
    rows = [[*passage, *(rng.randrange(1000, 10**9) for _ in range(rng.randint(16, 60)))] for _ in range(80)]
    for n in (10, 45, 90):
        base = [rng.randrange(10**9) for _ in range(n)]
        rows += [base, base[n // 10 :] + [rng.randrange(10**9) for _ in range(n // 10)], base[: n - n // 5], base[: n - n // 5 - 1], base + [1]]
    nodes = [np.unique(np.array(r, np.uint64)) for r in rows]
    sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(nodes)], "node long, shingles binary")
    got = {tuple(r) for r in near_copies.across(sets.select("node", F.col("node").alias("root")), sets).collect()}
    want = {(a, b) for b in range(len(nodes)) for a in range(b) if near_copies.similar(nodes[a], nodes[b])}
    assert want <= got and len(want) > 8 and len(got) < len(want) + 20


def near_texts() -> list[str]:
    """Texts with one to fifteen changed words, a chain of small changes, and a passage that many texts share."""
    rng = random.Random(12)
    word = lambda: f"{rng.choice(WORDS)}{int(rng.paretovariate(0.7)) % 500}"
    own, passage = [], [word() for _ in range(100)]
    for changes in (1, 2, 4, 4, 8, 15):
        for n in (100, 200):
            base = [word() for _ in range(n)]
            own.append(base)
            for _ in range(4):
                new = list(base)
                for at in rng.sample(range(n), changes):
                    new[at] = word()
                own.append(new)
    chain = [word() for _ in range(150)]
    for k in range(12):
        chain = [*chain[:10 * k], "link", *chain[10 * k + 1 :]]
        own.append(chain)
    own += [passage + [word() for _ in range(rng.randint(5, 60))] for _ in range(30)]
    return [" ".join(w) for w in own] + ["one two", "ONE  two", "", "  "]


def test_pipeline_near_copies_go_through_fingerprints(spark, monkeypatch):
    """The stage links SimHash fingerprints by BK-trees: its proposals connect just what brute force over 2 bits connects."""
    import corpus_pipeline

    texts_ = [f"{t} {tail}".strip() for t in near_texts() for tail in ("", "end")]
    rows = spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")
    seen, found = [], near_copies.by_fingerprint
    monkeypatch.setattr(near_copies, "by_fingerprint", lambda rows: seen.append((rows, found(rows))) or seen[0][1])
    kept = corpus_pipeline.drop_near_copies(spark, rows, "").count()
    (sketches, proposed), sets = seen[0], {t: near_copies.shingle_set(t.encode()) for t in texts_}
    of = {r.doc_id: r.node for r in sketches.collect()}
    prints = {of[k]: simhash.majority(sets[t]) for k, t in enumerate(texts_) if len(sets[t])}
    assert {r.node: r.fp % (1 << 64) for r in sketches.collect() if r.bands} == prints
    got = {(r.a, r.b) for r in proposed.collect()}
    assert all((prints[a] ^ prints[b]).bit_count() <= 2 for a, b in got)

    def classes(edges):
        up = {n: n for n in prints}

        def root(k):
            while up[k] != k:
                k = up[k]
            return k

        for a, b in edges:
            up[root(a)] = root(b)
        return {frozenset(m for m in prints if root(m) == r) for r in map(root, prints)}

    want = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2}
    assert classes(got) == classes(want) and len(want) > 30 and kept < len(texts_) - 60


@pytest.mark.parametrize("pivots", [2, 0])
def test_pipeline_near_copies(spark, pivots, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    texts_ = near_texts()
    rows = [(k, t) for k, t in enumerate(texts_)] + [(None, texts_[0]), (None, "an id of its own is missing here"), (3, "shares the id of another text"), (3, texts_[60]), (3, texts_[3])]
    random.Random(3).shuffle(rows)
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in rows]
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    members = defaultdict(list)
    for k, r in enumerate(rows):
        members[root(k)].append(r)
    least = {g: min(i for i, _ in m if i is not None) if any(i is not None for i, _ in m) else None for g, m in members.items()}
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    found = Counter(root(rows.index((r.doc_id, r.text))) for r in got)
    assert found == Counter(members.keys()) and len(members) < len(rows) - 40
    assert all(r.doc_id == least[root(rows.index((r.doc_id, r.text)))] for r in got)
