"""Document quality by Bradley-Terry pairwise ranking.

A document's strength is a linear score of features of its whole text: shares of character classes and of pairs of
neighbouring classes, word lengths, repeated words and lines. Preference pairs take a document labelled 1 over one
labelled 0; the probability of the preference is the logistic function of the difference of their scores, so the
weights minimise logistic loss on feature differences. The cut is the quantile of the labelled scores that their
share of label 0 asks for; the published score is logistic around it and 0.7 exactly at the cut.

All labelled rows and all their pairs are learned from, none is drawn. What a row's pairs add depends on its own score
and on the scores of the other label alone, so a Newton step takes two passes over the rows: one spreads the scores of
each label over a grid of step STEP (cubic interpolation: by its error term off by less than 1e-7 a pair), one sums features
by what the grid says of a row's pairs. Tasks sum their rows and sums by place are a shuffle's; what reaches the driver are the grid and
a matrix of features, whatever the number of rows. The cut is exact. Features are computed once for each document and
stored as 32-bit numbers; scoring reads them alone.

Defined cases: a null text counts as empty, an empty text is scored from its (all zero) features; where labels
hold only one class or none, every document scores as the class share (1 without labels); a document with several
labels counts with each; null labels are left out; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codepoints import code_points
from .common import Scratch, fold, id_text, settled, small_batches

CUT = 0.7
#: Steps of the grids of scores: of the loss and its gradient, and of its second derivative, which only guides the steps.
STEP, COARSE = 1 / 16, 1.0
#: A standardised feature is cut here; parts of a range that a pass for the cut counts.
FAR, PARTS = 8, 4_096
_PIECE = 1 << 18
#: Character classes. Others: letters are lower (1) or upper (2) case, digits 3, the rest 11.
CLASSES = {" \t": 4, "\n\r": 5, ".,;:": 6, "!?": 7, "'\"()[]-«»„“”’‘–—": 8, "#$%&*@^~+=<>\\/_{}`": 9, "|": 10}
N = 12


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    out = np.full(0x110000, 11, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = 2 if c.isupper() else 1
        elif c.isdigit():
            out[i] = 3
    for group, k in CLASSES.items():
        for c in group:
            out[ord(c)] = k
    return out


def features(text: str) -> np.ndarray:
    """The features of a whole text, read in pieces of bounded size."""
    table, pairs = _class_of(), np.zeros(N * N)
    last = np.zeros(1, np.uint8)
    for at in range(0, len(text), _PIECE):
        kinds = np.concatenate([last, table[code_points(text[at : at + _PIECE])]])
        pairs += np.bincount(kinds[:-1].astype(np.int64) * N + kinds[1:], minlength=N * N)
        last = kinds[-1:]
    n = max(1.0, pairs.sum())
    words, lines = text.split(), text.split("\n")
    size = np.array([len(w) for w in words]) if words else np.zeros(1)
    kinds_of_words = {w.lower() for w in words}
    singles = pairs.reshape(N, N).sum(axis=0)
    own = [
        np.log1p(len(text)),
        size.mean(),
        size.std(),
        len(kinds_of_words) / max(1, len(words)),
        np.log1p(len(words)) * len(kinds_of_words) / max(1, len(words)),
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        len(lines) / max(1, len(words)),
        float(np.mean([w[-1:] in "!#$%&*|" for w in words])) if words else 0.0,
        float(np.mean([w.isupper() for w in words])) if words else 0.0,
    ]
    return np.concatenate([own, np.sqrt(singles / n), np.sqrt(pairs / n)])


class Ranker:
    """weights, mean and scale of the features, and the raw score's cut and slope."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, cut: float, slope: float):
        self.weights, self.mean, self.scale, self.cut, self.slope = weights, mean, scale, cut, slope

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -FAR, FAR)

    def raw(self, x: np.ndarray) -> np.ndarray:
        # Row by row, so that a row's score does not depend on the rows beside it.
        return (self.standard(x) * self.weights).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(x: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.to_pylist()), "<f4").reshape(len(x), -1).astype(np.float64)


def _summed(rows: DataFrame, size: int, made: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of the ``size`` numbers made of features, times labelled 1 and times labelled 0."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += made(_matrix(batch.column(0)), *(batch.column(k).to_numpy().astype(np.float64) for k in (1, 2)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "value"])

    found = rows.select("x", "n1", "n0").mapInArrow(summed, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[found.column("at").to_numpy()] = found.column("value").to_numpy()
    return out


class _Grid:
    """Places from -bound to bound; a score is spread over four of them (cubic) or two (linear) so that a function's value
    there is, nearly, the weighed sum of its values at the places."""

    def __init__(self, bound: float, step: float, cubic: bool):
        self.low, self.step, self.cubic = -bound - 3 * step, step, cubic
        self.size = int(np.ceil(2 * bound / step)) + 8

    def spread(self, s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        u = (s - self.low) / self.step
        at = np.floor(u).astype(np.int64)
        t = u - at
        if not self.cubic:
            return at, [1 - t, t]
        return at - 1, [-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6]

    def counts(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        at, weights = self.spread(s)
        return sum(np.bincount(at + k, w * n, self.size) for k, w in enumerate(weights))

    def values(self, table: np.ndarray, s: np.ndarray) -> np.ndarray:
        at, weights = self.spread(s)
        return sum(table[at + k] * w for k, w in enumerate(weights))

    def used(self, *counts: np.ndarray) -> slice:
        at = np.flatnonzero(np.any([c != 0 for c in counts], axis=0))
        return slice(at[0], at[-1] + 1)

    def around(self, counts: np.ndarray, used: slice, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """At each used place p the sum over places q of counts times f(p - q)."""
        n, out = used.stop - used.start, np.zeros(self.size)
        out[used] = np.convolve(counts[used], f(self.step * np.arange(1 - n, n)))[n - 1 : 2 * n - 1]
        return out


def _logistic(d: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(d, -500, 500)))


def _bend(d: np.ndarray) -> np.ndarray:
    return _logistic(d) * _logistic(-d)


class _Pairs:
    """All pairs of labelled rows under a model: their mean loss, and the next Newton step."""

    def __init__(self, rows: DataFrame, model: Ranker, pairs: float, ridge: float):
        self.rows, self.model, self.pairs, self.ridge = rows, model, pairs, ridge
        bound = FAR * float(np.abs(model.weights).sum())
        self.fine, self.coarse = fine, coarse = _Grid(bound, STEP, True), _Grid(bound, COARSE, False)

        def made(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
            s = model.raw(x)
            return np.concatenate([g.counts(s, n) for g in (fine, coarse) for n in (n1, n0)])

        found = _summed(rows, 2 * (fine.size + coarse.size), made)
        self.ones, self.zeros, self.rough1, self.rough0 = np.split(found, np.cumsum([fine.size, fine.size, coarse.size]))
        self.used = fine.used(self.ones, self.zeros)
        loss = self.ones @ fine.around(self.zeros, self.used, lambda d: np.logaddexp(0, -d))
        self.loss = loss / pairs + ridge / 2 * float(model.weights @ model.weights)

    def step(self) -> np.ndarray:
        model, fine, coarse, width = self.model, self.fine, self.coarse, len(self.model.weights)
        rough = coarse.used(self.rough1, self.rough0)
        # Of one row of label 1 (or 0): how far its pairs are from certain, and how much that bends.
        pull1, pull0 = fine.around(self.zeros, self.used, lambda d: _logistic(-d)), fine.around(self.ones, self.used, _logistic)
        bend1, bend0 = coarse.around(self.rough0, rough, _bend), coarse.around(self.rough1, rough, _bend)
        n = rough.stop - rough.start

        def made(x: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
            z, s = model.standard(x), model.raw(x)
            slope = (n1 * fine.values(pull1, s) - n0 * fine.values(pull0, s)) @ z
            bent = (z * (n1 * coarse.values(bend1, s) + n0 * coarse.values(bend0, s))[:, None]).T @ z
            at, weights = coarse.spread(s)
            by_place = np.zeros((2, n, width))
            for k, w in enumerate(weights):
                some = w > 0
                for label, count in enumerate((n1, n0)):
                    np.add.at(by_place[label], (at + k - rough.start)[some], z[some] * (w * count)[some, None])
            return np.concatenate([slope, bent.ravel(), by_place.ravel()])

        found = _summed(self.rows, width + width * width + 2 * n * width, made)
        slope, bent, by_place = np.split(found, np.cumsum([width, width * width]))
        ones, zeros = by_place.reshape(2, n, width)
        far = COARSE * (np.arange(n)[:, None] - np.arange(n))
        cross = ones.T @ _bend(far) @ zeros
        hessian = self.ridge * np.eye(width) + (bent.reshape(width, width) - cross - cross.T) / self.pairs
        return np.linalg.solve(hessian, slope / self.pairs - self.ridge * model.weights)


def _ranked(values: DataFrame, k: int) -> tuple[float, float]:
    """The k-th and the next smallest of values (value, n times each), k from 1: parts of ever smaller ranges are counted."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    below, beyond = 0, high
    while True:
        part = F.floor((F.col("value") - low) / (high - low) * PARTS) if high > low else F.lit(0)
        counted = values.filter(F.col("value").between(low, high)).groupBy(part.alias("part"))
        found = counted.agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("part").collect()
        at = 0
        while below + found[at].n < k:
            below += found[at].n
            at += 1
        beyond = found[at + 1].low if at + 1 < len(found) else beyond
        low, high = found[at].low, found[at].high
        if low == high:
            return low, low if below + found[at].n > k else beyond


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, key, held_out, x: the features of each document as 32-bit numbers."""

    @F.pandas_udf("binary")
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([features(t or "").astype("<f4").tobytes() for t in text], dtype=object)

    return docs.select("doc_id", id_text().alias("key"), (fold("doc_id", 4) == 2).alias("held_out"), found(F.col("text").cast("string")).alias("x"))


def train(scratch: Scratch, documents: DataFrame, labels: DataFrame, ridge: float = 1e-3) -> Ranker:
    """Newton steps on the mean logistic loss of score differences over all preference pairs of the documents (key, x) that
    labels (doc_id, quality) mark; the caller decides which labels those are."""
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy(id_text().alias("key")).agg(F.sum("quality").cast("long").alias("n1"), F.count("*").alias("n"))
    marked = documents.join(marks.hint("merge"), "key").select("x", "n1", (F.col("n") - F.col("n1")).alias("n0"))
    rows = scratch.table("marked", marked)
    width = len(features(""))
    found = _summed(rows, 2 + width, lambda x, n1, n0: np.concatenate([[n1.sum(), n0.sum()], (n1 + n0) @ x]))
    n1, n0 = (int(n) for n in found[:2])
    if not n1 or not n0:
        level = np.clip(n1 / (n1 + n0) if n1 + n0 else 1.0, 0.01, 0.99)
        return Ranker(np.zeros(1), np.zeros(1), np.ones(1), np.log(CUT / (1 - CUT)) - np.log(level / (1 - level)), 1.0)
    # Rounded, as the weights are, so that the order of sums does not show.
    mean = np.round(found[2:] / (n1 + n0), 9)
    scale = np.round(np.sqrt(_summed(rows, width, lambda x, a, b: (a + b) @ (x - mean) ** 2) / (n1 + n0)) + 1e-3, 9)
    now = _Pairs(rows, Ranker(np.zeros(width), mean, scale, 0.0, 1.0), float(n1) * n0, ridge)
    for _ in range(50):
        step = now.step()
        while np.abs(step).max() >= 1e-5:
            then = _Pairs(rows, Ranker(now.model.weights + step, mean, scale, 0.0, 1.0), now.pairs, ridge)
            if then.loss <= now.loss + 1e-9:
                break
            step = step / 2
        else:
            break
        now = then
    model = Ranker(np.round(now.model.weights, 6), mean, scale, 0.0, 1.0)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], names=["value", "n"])

    values = scratch.table("raws", rows.select("x", F.expr("n1 + n0").alias("n")).mapInArrow(raws, "value double, n bigint"))
    # The quantile 1 - share of label 1, between two neighbours where it falls between them.
    here, following = _ranked(values, n0)
    model.cut = here + (1 - n0 / (n1 + n0)) * (following - here)
    return model


def scored(documents: DataFrame, model: Ranker) -> Column:
    """The score of a column x of features."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        own = held.value
        if len(own.weights) == 1:
            return pd.Series(np.full(len(x), own.score(np.zeros((1, 1)))[0]))
        return pd.Series(own.score(np.frombuffer(b"".join(x), "<f4").reshape(len(x), -1).astype(np.float64)) if len(x) else np.zeros(0))

    return score(F.col("x"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the labels of documents that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        documents = scratch.table("features", featured(docs))
        model = train(scratch, documents.filter(~F.col("held_out")), labels.filter(fold("doc_id", 4) != 2))
        out = documents.select("doc_id", "held_out", scored(documents, model).alias("score"))
        return settled(out.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0)))
