"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature.

Random indexing (Kanerva et al., 2000): every token owns a fixed sparse ternary index vector, drawn from its hash, and a
word's vector is the sum of the index vectors of its neighbours. A document is the mean of its tokens' vectors, with
ratios of repetition and length. The network is numpy; a temperature fitted on labelled rows that it was not trained on
scales its logit. The model is fitted on at most ``FIT_ROWS`` labelled rows, whose texts are read whole and stay in the
executors: these count the words, sum the contexts and make the features, and the driver gets the frequent words, one sum
of vectors for each of at most ``SUMS`` tasks and one row of features for each labelled text. Scoring is one pass over all
whole texts without a shuffle.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.tables import fold_of, fresh, staged

#: Bounds of the fit: labelled rows, words with a vector of their own, tasks that sum contexts.
FIT_ROWS, VOCABULARY, SUMS = 6000, 20_000, 8
WIDTH, NONZERO, WINDOW, HIDDEN, EPOCHS = 96, 8, 2, 32, 300
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
#: Words without a vector of their own are pooled by shape.
SHAPES = [b"<lower>", b"<Title>", b"<UPPER>", b"<digits>", b"<marks>"]
EXTRA = 5


def shape(token: bytes) -> int:
    if token[:1].isdigit():
        return 3
    if token.islower():
        return 0
    if token.isupper():
        return 2
    return 1 if token[0] > 64 else 4


def index_vector(token: bytes) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token, 7))
    v = np.zeros(WIDTH, np.float32)
    v[rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


@dataclass
class Model:
    vocabulary: dict[bytes, int]
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    base: float | None = None  # set where the labels give nothing to learn

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        get, n = self.vocabulary.get, len(SHAPES)
        return np.fromiter((shape(t) if (k := get(t)) is None else k + n for t in tokens), np.int64, len(tokens))

    def features(self, data: bytes) -> np.ndarray:
        tokens = TOKEN.findall(data)
        out = np.zeros(WIDTH + EXTRA, np.float32)
        if tokens:
            ids = self.ids(tokens)
            for at in range(0, len(ids), 1 << 15):
                out[:WIDTH] += self.vectors[ids[at : at + (1 << 15)]].sum(axis=0)
            n = len(tokens)
            lines = data.split(b"\n")
            out[:WIDTH] /= n
            out[WIDTH:] = np.log1p(n), len(set(tokens)) / n, sum(map(operator.eq, tokens, tokens[1:])) / n, 1 - len(set(lines)) / len(lines), n / len(lines) ** 0.5 / 100
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        # rounded, as a product's last bits depend on how many rows are scored at once
        return np.round(1 / (1 + np.exp(-np.clip(forward((x - self.mean) / self.scale, self.layers)[1] / self.temperature, -30, 30))), 9)


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    h = np.tanh(x @ w1 + b1)
    return h, (h @ w2 + b2)[:, 0]


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Full-batch Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    for step in range(1, EPOCHS + 1):
        h, z = forward(x, layers)
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)[:, None] / len(y)
        back = (d @ layers[2].T) * (1 - h * h)
        grads = [x.T @ back + 1e-4 * layers[0], back.sum(0), h.T @ d + 1e-4 * layers[2], d.sum(0)]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            layers[k] = layers[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def contexts(rows: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Sums of the index vectors ``own`` over the neighbours of every word, from texts as ids; whole numbers, so that no order matters."""
    n, codes = len(own), []
    for ids in rows:
        for gap in range(1, WINDOW + 1):
            if len(ids) > gap:
                codes += [ids[gap:] * n + ids[:-gap], ids[:-gap] * n + ids[gap:]]
    out = np.zeros((n, WIDTH), np.int32)
    pairs, counts = np.unique(np.concatenate(codes), return_counts=True) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for at in range(0, len(pairs), 1 << 14):
        word, near = np.divmod(pairs[at : at + (1 << 14)], n)
        first = np.r_[0, np.flatnonzero(np.diff(word)) + 1]
        out[word[first]] += np.add.reduceat(own[near].astype(np.int32) * counts[at : at + (1 << 14), None].astype(np.int32), first, axis=0)
    return out


def fit(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """The network and the temperature from features and labels; the same rows in the same order give the same model."""
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.mean) / model.scale
    apart = np.arange(len(y)) % 5 == 0  # for the temperature
    model.layers = train(x[~apart], y[~apart])
    z = forward(x[apart], model.layers)[1]
    loss = lambda t: np.logaddexp(0, np.where(y[apart] > 0, -z, z) / t).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, folds: int = 3, held: int = 1) -> DataFrame:
    """(id, text, label): up to ``rows`` labelled rows outside the held-out fold whose id ``docs`` has, chosen by the hash of
    the id, with their whole texts. Null ids and labels are left out; of several labels of an id the greatest counts, of
    several texts of an id the least; null text counts as empty."""
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label is not null")
    ids = ids.filter(fold_of("id", folds) != held).groupBy("id").agg(F.max("label").alias("label")).join(own.select("id"), "id", "left_semi")
    picked = staged(ids.orderBy(F.xxhash64("id"), "id").limit(rows), "picked")
    return staged(own.join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "sample")


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def learn(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """Fit on :func:`sample`, which takes the options. Labels of one kind only, or fewer than 20, give a model that answers with the base rate."""
    rows = sample(docs, labels, **options)
    y = rows.groupBy("label").count().toPandas()
    good, n = int(y["count"][y["label"] > 0].sum()), int(y["count"].sum())
    empty = Model({}, np.zeros((len(SHAPES), WIDTH), np.float32), np.zeros(0), np.ones(0), [], 1.0, (good + 1) / (n + 2))
    if n < 20 or good in (0, n):
        return empty

    def count(batches):
        counts: Counter = Counter()
        for b in batches:
            for t in _texts(b):
                counts.update(TOKEN.findall(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    counted = rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 2")
    words = [bytes(r[0]) for r in counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()]
    model = Model({w: k for k, w in enumerate(words)}, empty.vectors, np.zeros(0), np.ones(0), [], 1.0)
    own = np.array([index_vector(w) for w in [*SHAPES, *words]]).astype(np.int8)

    def gather(batches):
        total, held, size = np.zeros(own.shape, np.int32), [], 0
        for b in batches:
            for t in _texts(b):
                held.append(model.ids(TOKEN.findall(t)))
                size += len(held[-1])
                if size > 1 << 18:  # bounds the memory
                    total += contexts(held, own)
                    held, size = [], 0
        total += contexts(held, own)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = np.zeros(own.shape, np.float32)
    for r in rows.coalesce(SUMS).mapInArrow(gather, "total binary").toLocalIterator():
        total += np.frombuffer(r[0], np.int32).reshape(own.shape)
    # a word is its contexts and itself
    model.vectors = (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1) + own).astype(np.float32)

    def describe(batches):
        for b in batches:
            x = [model.features(t).tobytes() for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(x, pa.binary())], ["id", "label", "x"])

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.mapInArrow(describe, f"id {kind}, label int, x binary").orderBy(F.xxhash64("id"), "id").select("x", "label").collect()
    return fit(model, np.array([np.frombuffer(r[0], np.float32) for r in got], np.float64), np.array([r[1] > 0 for r in got], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with all its columns and the probability of label 1; null counts as empty, which has a score too."""
    schema = T.StructType([f for f in docs.schema if f.name != column] + [T.StructField(column, T.DoubleType())])
    names = [f.name for f in schema[:-1]]

    def run(batches):
        for b in batches:
            texts = b.column(text).cast(pa.binary()).to_pylist()
            x = np.array([model.features(t or b"") for t in texts], np.float64).reshape(len(texts), -1)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(model.scores(x), pa.float64())], [*names, column])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have one and the same score; repeated rows get equal ones; a null id stays null and counts as the
    empty text for its fold. How labels that are null, repeated or in conflict count says :func:`sample`; without labels of
    both kinds every score is the base rate. An empty table gives an empty result. Whole texts are scored, whatever their
    length. Only doc_id and text, and doc_id and quality of ``labels``, are read.
    """
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns and as often as they come; see :func:`quality`."""
    (column,) = fresh(docs, "_score")
    return score(docs, learn(docs, labels), column=column).filter(F.col(column) >= 0.5).select(*docs.columns)
