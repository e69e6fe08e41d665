"""Language identification by compression: the language whose raw-content dictionary makes a text smallest.

Each language has a zstandard dictionary of raw sample text. A text is cut into blocks, as only a block's beginning
profits from a dictionary, and each block is compressed with every dictionary; the smallest sum wins. Where the margin
to the second is narrow the answer is marked as rejected. Texts and samples are lower-cased, and ASCII digits and
punctuation are deleted. The dictionaries are the model: at most ``DICTIONARY`` bytes for each language, in slices drawn by
hash from all learnable text of the language, whatever the size of the corpus, so that a language of few long texts fills
its dictionary as one of many short texts does. Every language that occurs is learned.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import fold_of, staged

DICTIONARY, SLICE = 1 << 18, 512
#: More different values in the language column are an error: they are no languages, and each would get a dictionary.
LANGUAGES = 4096
BLOCK, LEVEL, MARGIN = 2048, 6, 0.01
LETTER = regex.compile(r"\p{L}")
MARKS = bytes(b for b in range(33, 128) if not 65 <= b <= 90 and not 97 <= b <= 122)
NONE = "und"


def bare(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, MARKS)


class Classifier:
    def __init__(self, samples: dict[str, bytes]):
        self.samples = dict(sorted(samples.items()))
        self.by: dict | None = None

    def __getstate__(self):
        return {"samples": self.samples, "by": None}  # compressors are made anew in each worker

    def compressors(self) -> dict:
        if self.by is None:
            self.by = {}
            for lang, data in self.samples.items():
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.by[lang] = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False).compress
        return self.by

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted). The score is a softmax over the compressed sizes; ``und`` has score 0."""
        if not text or not self.samples or not LETTER.search(text):
            return NONE, 0.0, False
        data = bare(text)
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        sizes = {lang: sum(len(c(b)) for b in blocks) for lang, c in self.compressors().items()}
        order = sorted(sizes.items(), key=lambda p: (p[1], p[0]))
        best, least = order[0]
        margin = (order[1][1] - least) / max(1, order[1][1]) if len(order) > 1 else 1.0
        return best, 1 / sum(math.exp(-0.5 * min(s - least, 1000)) for _, s in order), margin >= MARGIN


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held: int = 0) -> Classifier:
    """Dictionaries from the texts of the other folds. Texts are cut into slices of SLICE characters, and each slice is drawn
    by the hash of its id, language and number at the language's own rate, which is set to give twice a dictionary; what
    reaches the driver is about 1,000 slices for each language."""
    pool = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & (fold_of("id", folds) != held) & (F.length("text") > 0))
    slices = F.ceil(F.char_length("text") / F.lit(SLICE)).cast("int")
    rates = staged(pool.groupBy("lang").agg(F.sum(slices).alias("n")), "languages")
    if rates.count() > LANGUAGES:
        raise ValueError(f"{lang} has more than {LANGUAGES} values")
    rates = rates.select(F.col("lang").alias("_lang"), (F.lit(2.0 * DICTIONARY / SLICE) / F.col("n")).alias("rate"))
    draw = lambda k: F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("lang"), k), F.lit(1 << 30)).cast("double") / (1 << 30)
    drawn = F.filter(F.sequence(F.lit(0), slices - 1), lambda k: draw(k) < F.col("rate"))
    picked = pool.join(F.broadcast(rates), F.col("lang") == F.col("_lang")).select("id", "lang", "text", F.explode(drawn).alias("k"))
    got = picked.select("lang", "id", draw(F.col("k")).alias("u"), F.substring("text", F.col("k") * SLICE + 1, F.lit(SLICE)).alias("part"))
    parts: dict[str, bytes] = {}
    for r in sorted(got.collect(), key=lambda r: (r.lang, r.u, str(r.id), r.part)):
        if len(parts.setdefault(r.lang, b"")) < DICTIONARY:
            parts[r.lang] = (parts[r.lang] + bare(r.part) + b" ")[:DICTIONARY]
    return Classifier({k: v for k, v in parts.items() if len(v) >= 8})


def languages(docs: DataFrame, classifier: Classifier | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, accepted.

    ``und``, with score 0, is for null and empty texts, texts without a letter (Unicode's class L; number signs are none),
    and every text where nothing could be learned. A narrow margin clears ``accepted`` and leaves the best guess in
    ``lang_pred``; where two languages compress a text alike the first in the order of names is named. Repeated rows get
    equal answers; a null id stays null and counts as the empty text for its fold; an empty table gives an empty result.
    Whole texts are encoded, block by block, in one pass without a shuffle. Only the three named columns are read.
    """
    c = classifier or learn(docs, doc_id, text, lang)

    def run(batches):
        for b in batches:
            rows = [c.predict(t) for t in b.column(2).to_pylist()]
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold_of(doc_id, 5) == 0).alias("held_out"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
