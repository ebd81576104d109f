"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, in each of SLOTS words, one bit a language. An n-gram's HASHES slots, and-ed, give the
mask of all languages that have it. For each language its bits are counted over all n-grams of a text and corrected for
false positives: of n look-ups with h hits, a slice filled to the share f answers falsely at the rate r = f^HASHES, so
(h - n r) / (1 - r) are expected to be true. The language with the most decides; its share is the score.

A language's n-grams are its TOP most frequent ones (characters of lower-cased words, joined by single spaces, SIZES long)
in a sample of its labelled texts of about SAMPLE texts, chosen by a hash of id and text. Both are parameters of the
classifier: SAMPLE bounds what teaches it, TOP the features of a language, without which rare n-grams that languages share
would fill the filter. Prediction reads the whole text and nothing else.

A null text, or one without a letter, is `und` with score 0. Rows with a null language do not teach. With nothing learned,
every text is `und`. Ties go to the language first in order. Repeated rows stay; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.llm.common import in_arrow, stretches

SIZES = (3, 4)
TOP = 6000
SAMPLE = 3000
SLOTS = 1 << 19
HASHES = 3
#: Code points worked on at once, so that a very long text needs little memory.
_STRETCH = 1 << 20
_FACTORS = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _codes(text: str) -> Iterator[np.ndarray]:
    """Code points of lower-cased words with one space between, before and behind, cut into stretches that join seamlessly."""
    at, last = 0, 32
    yield np.asarray([32], np.uint64)
    while at < len(text):
        end = at + _STRETCH
        while end < len(text) and text[end].isalpha():  # a word is lower-cased as a whole
            end += 1
        codes = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, 32).astype(np.uint64)
        codes = codes[(codes != 32) | (np.concatenate([[last], codes[:-1]]) != 32)]
        if len(codes):
            last = int(codes[-1])
            yield codes
        at = end
    if last != 32:
        yield np.asarray([32], np.uint64)


def grams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text; empty if it has no letter."""
    out, tails = [], {n: np.zeros(0, np.uint64) for n in SIZES}
    for codes in _codes(text):
        for n in SIZES:
            own = np.concatenate([tails[n], codes])
            tails[n] = own[-(n - 1) :]
            if len(own) >= n:
                h = own[: len(own) - n + 1] * _FACTORS[0]
                for k in range(1, n):
                    h = h + own[k : len(own) - n + 1 + k] * _FACTORS[k] * np.uint64(2 * n + 1)
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class MaskFilter:
    """The bit-sliced filter for `languages`; 64 of them share a word."""

    def __init__(self, languages: list[str], tops: list[np.ndarray]):
        self.languages = languages
        self.words = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        for k, own in enumerate(tops):
            for slot in self._slots(own):
                self.words[k // 64][slot] |= np.uint64(1 << (k % 64))
        filled = np.asarray([np.count_nonzero(self.words[k // 64] >> np.uint64(k % 64) & np.uint64(1)) for k in range(len(languages))])
        self.false = (filled / SLOTS) ** HASHES

    @staticmethod
    def _slots(h: np.ndarray) -> list[np.ndarray]:
        return [(h >> np.uint64(20 * k) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]

    def predict(self, text: str | None) -> tuple[str, float]:
        h = grams(text) if text else np.zeros(0, np.uint64)
        if not len(h) or not self.languages:
            return "und", 0.0
        slots = self._slots(h)
        hits = np.zeros(len(self.languages))
        for w, words in enumerate(self.words):
            mask = words[slots[0]]
            for s in slots[1:]:
                mask &= words[s]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                hits[k] = np.count_nonzero(mask & np.uint64(1 << (k % 64)))
        true = np.maximum(0.0, (hits - len(h) * self.false) / (1 - np.minimum(self.false, 0.999999)))
        best = int(true.argmax())
        total = float(true.sum())
        return self.languages[best], float(true[best]) / total if total > 0 else 1.0 / len(self.languages)


def train(labelled: DataFrame, sample: int = SAMPLE, top_grams: int = TOP) -> MaskFilter:
    """Learn from (doc_id, text, lang). What reaches the driver is `top_grams` hashes a language."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return MaskFilter([], [])
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.element_at(size, F.col("lang"))) < sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in stretches(batch):
                langs = part.column("lang").to_pylist()
                for lang in dict.fromkeys(langs):
                    h, n = np.unique(np.concatenate([grams(t) for t, x in zip(texts, langs) if x == lang]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "h", "n"])

    counts = in_arrow(chosen.select("lang", "text"), count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "h"))
    top = counts.withColumn("r", first).where(F.col("r") <= top_grams).select("lang", "h").toPandas()
    languages = sorted(sizes)
    return MaskFilter(languages, [top.loc[top["lang"] == x, "h"].to_numpy(np.int64).view(np.uint64) for x in languages])


def prediction(spark, learned: MaskFilter) -> Column:
    """struct(lang_pred, score) of the column `text`."""
    shared = spark.sparkContext.broadcast(learned)

    @F.arrow_udf("lang_pred string, score double")
    def run(texts: pa.Array) -> pa.Array:
        model, found = shared.value, []
        for _, own in stretches(pa.RecordBatch.from_arrays([texts], ["text"])):
            found += [model.predict(t) for t in own]
        langs, scores = zip(*found) if found else ((), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run("text")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose text has a language: those predicted `und` (null, or no letter) go. All columns stay."""
    learned = train(docs.where(~held_out()))
    if not learned.languages:  # nothing to learn from: the letter rule alone decides
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return docs.where(prediction(docs.sparkSession, learned)["lang_pred"] != "und")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    learned = train(docs.where(~held_out()))
    p = docs.select("doc_id", held_out().alias("held_out"), prediction(spark, learned).alias("p"))
    return p.select("doc_id", "held_out", "p.lang_pred", "p.score")
