"""Language identification by language-bitmask n-gram filters.

Letters are lower-cased, other characters become one word boundary, and n-grams of 3 and 4 characters that lie
within a word (with its boundaries) are hashed. A language's n-grams are those that make up at least MIN_SHARE of
its learned text, whatever other languages they are in. They go into one bit-sliced Bloom filter: a slot has a bit
for each language, and the bitwise AND of an n-gram's PROBES slots names all languages that contain it. The set bits
are counted per language over the whole text and corrected for the filter's false positives. Two counts are kept: of
all hits, and of hits that count the less the more languages share the n-gram (an n-gram of all languages says
nothing). The larger weighed count decides; the share of all hits is the score.

Learning uses at most SAMPLE documents of each language, whole texts, chosen by hash; the filter has a fixed size
(SLOTS slots for each 64 languages), so what is broadcast does not grow with the corpus.

Defined cases: null text and text without letters give ``und`` with score 0; where no n-gram is known the
languages tie and the first by name wins with score 0; documents without a language are predicted and never
learned from; repeated rows are predicted each; with nothing to learn from, every row is ``und``; further columns
are ignored, or carried by ``accepted``. Texts of any length are counted block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import blocks, letters
from .common import fold, fresh, small_batches
from .shingles import mixed

SIZES = (3, 4)
SLOTS, PROBES = 1 << 19, 3
#: N-grams of a language make up at least this share of its learned text.
MIN_SHARE = 1e-5
#: Documents of a language that are learned from, in expectation.
SAMPLE = 3_000
#: Below this share of known n-grams a document is in none of the learned languages.
MIN_SCORE = 0.2
UNKNOWN = "und"


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, owners) of the n-grams of texts, block by block."""
    table = letters()
    for codes, starts, owners in blocks([t.lower() for t in texts], max(SIZES)):
        codes = np.where(table[codes], codes, np.uint32(0)).astype(np.uint64)
        owner = np.repeat(owners, np.diff(np.append(starts, len(codes))))
        keep = codes != 0
        keep |= np.concatenate([[True], codes[:-1] != 0])
        codes, owner = np.concatenate([np.zeros(1, np.uint64), codes[keep]]), np.concatenate([owner[:1], owner[keep]])
        for n in SIZES:
            m = len(codes) - n + 1
            if m <= 0:
                continue
            inner = np.ones(m, bool)
            for j in range(1, n - 1):
                inner &= codes[j : m + j] != 0
            if n > 3:
                inner &= (codes[:m] != 0) | (codes[n - 1 : m + n - 1] != 0)
            with np.errstate(over="ignore"):
                h = codes[:m].copy()
                for j in range(1, n):
                    h = h * np.uint64(0x100000001B3) + codes[j : m + j]
            # The owner of a gram is that of its second character: the first may be the boundary before the text.
            yield mixed(h[inner] + np.uint64(n)), owner[1 : m + 1][inner]


def probes(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


class Filter:
    """The bit-sliced filter: slots[word, slot] holds a bit for each of 64 languages."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        filled = [((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        self.false_positive = np.array(filled) ** PROBES

    @classmethod
    def of(cls, languages: list[str], members: DataFrame) -> Filter:
        """members: lang, gram. Slots are put together where the n-grams are; what comes back is the filter and no larger."""
        index = F.element_at(F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k))), F.col("lang"))
        at = F.explode(F.array(*(F.shiftrightunsigned("gram", 21 * k).bitwiseAND(F.lit(SLOTS - 1).cast("long")) for k in range(PROBES))))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("k") % 64).cast("int"))
        found = members.select(index.alias("k"), at.alias("slot")).groupBy(F.floor(F.col("k") / 64).alias("word"), "slot").agg(F.bit_or(bit).alias("mask")).toArrow()
        slots = np.zeros(((len(languages) + 63) // 64, SLOTS), np.uint64)
        slots[found["word"].to_numpy(), found["slot"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
        return cls(languages, slots)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams of each text, hits and weighed hits of each text and language), corrected for false positives."""
        n, langs = len(texts), len(self.languages)
        # An n-gram that k languages share weighs log2((L + 1) / k).
        weight = np.log2((langs + 1) / np.maximum(np.arange(langs + 2), 1))
        total, fresh_weight = np.zeros(n), np.zeros(n)
        hits, weighed, lost = np.zeros((3, n, langs))
        for h, owner in grams(texts):
            at = probes(h)
            masks = []
            for word in range(len(self.slots)):
                mask = self.slots[word, at[0]]
                for more in at[1:]:
                    mask = mask & self.slots[word, more]
                masks.append(mask)
            shared = np.sum([np.bitwise_count(m) for m in masks], axis=0, dtype=np.int64) if masks else np.zeros(len(h), np.int64)
            total += np.bincount(owner, minlength=n)
            fresh_weight += np.bincount(owner, weight[shared + 1], minlength=n)
            for k in range(langs):
                on = ((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
                who, by = owner[on], shared[on]
                hits[:, k] += np.bincount(who, minlength=n)
                weighed[:, k] += np.bincount(who, weight[by], minlength=n)
                lost[:, k] += np.bincount(who, weight[by + 1], minlength=n)
        # Of the n-grams that a language lacks, the share fp is taken for its own; what is left of them shows how many.
        odds = self.false_positive / (1 - np.minimum(self.false_positive, 0.999))
        return total, hits - odds * (total[:, None] - hits), weighed - odds * (fresh_weight[:, None] - lost)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score = np.zeros(len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), score
        total, hits, weighed = self.counts([t or "" for t in texts])
        best = np.clip(weighed, 0, None).argmax(axis=1)
        some = total > 0
        score[some] = np.clip(hits[some, best[some]] / total[some], 0, 1)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            found = [h for h, _ in grams(rows["text"].fillna("").tolist())]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": values.view(np.int64), "n": n})


def train(docs: DataFrame, sample: int = SAMPLE) -> Filter:
    """Learns from the rows of docs that have a language; the caller decides which rows those are."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return Filter([], np.zeros((0, SLOTS), np.uint64))
    chances = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))))
    # Equal texts fall on the same side: copies of one document do not add to what a sample holds of it.
    chosen = known.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) < F.element_at(chances, F.col("lang")) * (1 << 20))
    counts = chosen.mapInPandas(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    return Filter.of(sorted(sizes), shares.filter(F.col("share") >= MIN_SHARE))


def predicted(docs: DataFrame, model: Filter, text: Column | str = "text") -> Column:
    """A struct column lang_pred, score."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def predict(text: pd.Series) -> pd.DataFrame:
        langs, score = held.value.predict(text.tolist())
        return pd.DataFrame({"lang_pred": langs, "score": score})

    return predict(F.col(text).cast("string") if isinstance(text, str) else text)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    held_out = fold("doc_id", 3) == 1
    model = train(docs.filter(~held_out), sample)
    return docs.select("doc_id", held_out.alias("held_out"), predicted(docs, model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")


def accepted(docs: DataFrame, min_score: float = MIN_SCORE, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that are in none of the languages learned from docs; columns as in docs."""
    model = train(docs.filter(fold("doc_id", 3) != 1), sample)
    found = fresh("rainloom_lang", docs.columns)
    marked = docs.withColumn(found, predicted(docs, model))
    return marked.filter((F.col(found)["lang_pred"] != UNKNOWN) & (F.col(found)["score"] >= min_score)).drop(found)
