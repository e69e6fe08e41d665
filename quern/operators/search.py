"""Ranked text search and fusion: BM25, weighted reciprocal ranks, hybrid search.

The corpus is read once: its texts become a narrow table (uid, lengths, frequencies of the query's clauses), which is
written; statistics, scores and ranks come from that table, and the found rows are fetched by uid.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text as X
from quern.operators import vector
from quern.sources.staging import handed_over

RRF = 60
DEPTH = 100
#: Operator to (every clause must occur, words are stemmed).
OPS = {"allofterms": (True, False), "anyofterms": (False, False), "alloftext": (True, True), "anyoftext": (False, True)}


@dataclass(frozen=True)
class Spec:
    """One text condition: field, operator and query, its weight in a fusion, and whether accents are dropped."""

    field: str
    op: str
    query: str
    boost: float = 1.0
    fold: bool = True

    @property
    def terms(self) -> list[X.Term]:
        return X.parse_query(self.query, self.fold, OPS[self.op][1])


def scores(df: DataFrame, specs: list[Spec]) -> list[DataFrame]:
    """(uid, _score) of the matching rows for every spec. Each spec's corpus is all of ``df`` with text in its field; texts
    are read and tokenised once for all specs. Substring conditions ("trigram", three characters at least) score 1."""
    kinds = list(dict.fromkeys((s.field, s.fold, OPS[s.op][1]) for s in specs if s.op != "trigram"))
    toks, cols = {}, [F.col("uid")]
    for n, (field, fold, stem) in enumerate(kinds):
        t = X.tokens(F.col(field), fold)
        asked = [w for s in specs if s.op != "trigram" and (s.field, s.fold, OPS[s.op][1]) == kinds[n] for w in s.terms]
        toks[f"_t{n}"] = X.stem_all(t, asked) if stem else t
        cols.append(F.when(F.col(field).isNotNull(), F.size(f"_t{n}")).alias(f"_len{n}"))
    for k, s in enumerate(specs):
        if s.op == "trigram":
            cols.append(F.coalesce(F.contains(F.lower(F.col(s.field)), F.lit(s.query.lower())), F.lit(False)).alias(f"_in{k}") if len(s.query) >= 3 else F.lit(False).alias(f"_in{k}"))
        else:
            n = kinds.index((s.field, s.fold, OPS[s.op][1]))
            cols += [X.occurrences(F.col(f"_t{n}"), t).alias(f"_f{k}_{j}") for j, t in enumerate(s.terms)]
    narrow = handed_over(df.withColumns(toks).select(*cols), "frequencies")
    return [narrow.filter(f"_in{k}").select("uid", F.lit(1.0).alias("_score")) if s.op == "trigram" else _scored(narrow, k, s, kinds.index((s.field, s.fold, OPS[s.op][1]))) for k, s in enumerate(specs)]


def _scored(narrow: DataFrame, k: int, s: Spec, n: int) -> DataFrame:
    size, found = F.col(f"_len{n}"), [F.col(f"_f{k}_{j}") for j in range(len(s.terms))]
    if not found:
        return narrow.select("uid", F.lit(0.0).alias("_score")).limit(0)
    texts = narrow.filter(size.isNotNull())
    parts = [F.count(F.lit(1)).cast("double").alias("n"), F.avg(size).alias("mean"), *(F.sum((f > 0).cast("double")).alias(f"d{j}") for j, f in enumerate(found))]
    stats = texts.agg(F.struct(*parts).alias("s")).scalar()
    score = F.lit(0.0)
    for j, f in enumerate(found):
        total, d = stats["n"], stats[f"d{j}"]
        idf = F.greatest(F.ln((total - d + 0.5) / (d + 0.5)), F.lit(X.LEAST_IDF))
        score = score + idf * f * (X.K1 + 1) / (f + X.K1 * (1 - X.B + X.B * size / stats["mean"]))
    hit = reduce((lambda a, b: a & b) if OPS[s.op][0] else (lambda a, b: a | b), (f > 0 for f in found))
    return texts.filter(hit).select("uid", score.alias("_score"))


def bm25(df: DataFrame, field: str, query: str, every: bool = False, stem: bool = False, fold: bool = True) -> DataFrame:
    """(uid, _score) of the matching rows."""
    op = next(name for name, kind in OPS.items() if kind == (every, stem))
    return scores(df, [Spec(field, op, query, fold=fold)])[0]


def search(df: DataFrame, spec: Spec, k: int | None = None) -> DataFrame:
    """The matching rows with ``_score``, the best first, ties by uid; the first ``k`` or all."""
    (found,) = scores(df, [spec])
    found = found.orderBy(F.desc("_score"), "uid").limit(k) if k is not None else found
    return df.join(found, "uid").select(*df.columns, "_score").orderBy(F.desc("_score"), "uid")


def placed(df: DataFrame, keys: list[Column | str], k: int | None) -> DataFrame:
    """(uid, rank) of the first k, or of all; with k the window sees no more than k rows."""
    top = df if k is None else df.orderBy(*keys).limit(k)
    return top.select("uid", F.row_number().over(Window.orderBy(*keys)).alias("rank"))


def _best() -> list[Column | str]:
    return [F.desc("_score"), "uid"]


def multi_rrf(df: DataFrame, specs: list[Spec], k: int | None = 10, depth: int | None = DEPTH) -> DataFrame:
    """(uid, _score): the sum of boost / (60 + rank) over the specs' first ``depth`` rows; None for ``k`` or ``depth`` means all."""
    specs = sorted(specs, key=lambda s: (s.field, s.op))
    parts = [placed(found, _best(), depth).select("uid", (F.lit(float(s.boost)) / (RRF + F.col("rank"))).alias("part")) for s, found in zip(specs, scores(df, specs))]
    fused = reduce(lambda a, b: a.union(b), parts).groupBy("uid").agg(F.sum("part").alias("_score")).orderBy(*_best())
    return fused.limit(k) if k is not None else fused


def fuse(found: DataFrame, near: DataFrame, k: int | None = 10, depth: int | None = DEPTH) -> DataFrame:
    """(uid, _score) from texts (uid, _score) and vectors (uid, _distance): reciprocal ranks of the first ``depth`` of either side, joined in full."""
    a = placed(found, _best(), depth).withColumnRenamed("rank", "_a")
    b = placed(near, ["_distance", "uid"], depth).withColumnRenamed("rank", "_b")
    part = lambda c: F.coalesce(F.lit(1.0) / (RRF + F.col(c)), F.lit(0.0))
    fused = a.join(b, "uid", "full").select("uid", (part("_a") + part("_b")).alias("_score")).orderBy(*_best())
    return fused.limit(k) if k is not None else fused


def hybrid(text_df: DataFrame, spec: Spec, vector_df: DataFrame, field: str, v: list[float], k: int | None = 10, depth: int | None = DEPTH) -> DataFrame:
    """(uid, _score): texts of one frame and vectors of another, fused on uid."""
    return fuse(scores(text_df, [spec])[0], vector.ranked(vector_df, field, v), k, depth)
