"""Filter interaction audit: what each of five text filters removes, alone and after any others.

Texts are scanned in their Arrow buffers. Runs of documents up to BLOCK bytes become one NumPy array; byte classes
mark capitals, symbols, blanks and first bytes of characters, and prefix sums taken at the documents' borders count
them. A word (a run of bytes other than 0x20 and 0x09-0x0D) is hashed by its eight-byte lanes; hashes are sorted and
equal neighbours are verified byte by byte, so the number of distinct words is exact. A text over BLOCK is scanned in
parts that end between words and its parts' words are sorted together.

Each document becomes a row of a five-bit mask and the digest of its text. Filter E (a smaller doc_id has the same
text) needs the smallest doc_id of a digest: copies are summed before anything is shuffled, so a group of copies
of any size is a few rows. Counts per part and mask (32 masks) are all that the 120 orders need.

Defined cases: null text counts as empty, null lang as the empty part, a null doc_id has no label and is no copy of a
smaller one nor the smallest itself, rows repeated with one doc_id are no copies of each other but each counts, labels
repeated for one doc_id count once (1 if any of them is 1), an empty table gives an empty result, further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, settled, small_batches, trimmed

#: Fixed values of the filters: fewest words, least share of distinct words and largest share of capitals in percent, symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 100, 80, 10, b"#$%&*|"
LETTERS = "ABCDE"
#: Bytes that are scanned at once.
BLOCK = 1 << 18
_LANE = 8


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte whether it is a blank, a capital, a symbol, the first of a character."""
    byte = np.arange(256)
    blank = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    return blank, (byte >= 65) & (byte <= 90), np.isin(byte, np.frombuffer(SYMBOLS, np.uint8)), (byte & 0xC0) != 0x80


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _lanes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lane: int) -> np.ndarray:
    """Lane number ``lane`` of each word as a number; bytes past the word's end count as zero. raw has _LANE bytes of padding."""
    at = starts + lane * _LANE
    window = np.lib.stride_tricks.sliding_window_view(raw, _LANE)[at].view(np.uint64)[:, 0]
    left = np.minimum(sizes - lane * _LANE, _LANE).astype(np.uint64)
    return np.where(left == _LANE, window, window & ((np.uint64(1) << (left * np.uint64(8))) - np.uint64(1)))


def _hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = _mixed(_lanes(raw, starts, sizes, 0) + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        lane, more = 1, np.flatnonzero(sizes > _LANE)
        while len(more):
            out[more] = _mixed(out[more] * np.uint64(0xD6E8FEB86659FD93) + _lanes(raw, starts[more], sizes[more], lane))
            lane += 1
            more = more[sizes[more] > lane * _LANE]
    return out


def _distinct(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each of n owners. Words with one hash are verified lane by lane; where two differ, their owner's
    words are counted as bytes."""
    with np.errstate(over="ignore"):
        keys = _hashes(raw, starts, sizes) + owner.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(keys, kind="stable")
    keys, starts, sizes, owner = keys[order], starts[order], sizes[order], owner[order]
    same = np.flatnonzero(keys[1:] == keys[:-1])
    wrong = (sizes[same] != sizes[same + 1]) | (owner[same] != owner[same + 1])
    lane, check = 0, same[~wrong]
    doubtful = [owner[same[wrong]], owner[same[wrong] + 1]]
    while len(check):
        differ = _lanes(raw, starts[check], sizes[check], lane) != _lanes(raw, starts[check + 1], sizes[check], lane)
        doubtful.append(owner[check[differ]])
        lane += 1
        check = check[(sizes[check] > lane * _LANE) & ~differ]
    found = np.bincount(owner, minlength=n) - np.bincount(owner[same + 1], minlength=n)
    for k in np.unique(np.concatenate(doubtful)):
        found[k] = len({raw[a : a + s].tobytes() for a, s, o in zip(starts, sizes, owner, strict=True) if o == k})
    return found


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the words."""
    inside = np.concatenate([[False], ~_classes()[0][raw], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[::2], change[1::2] - change[::2]


def _counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """words, distinct words, code points, capitals, symbols of the texts between the offsets (columns); borders part words."""
    texts = len(offsets) - 1
    # One zero byte between texts would be part of words, so a blank stands there.
    sizes = np.diff(offsets)
    raw = np.full(int(offsets[-1] - offsets[0]) + texts + _LANE, 0x20, np.uint8)
    place = offsets[:-1] - offsets[0] + np.arange(texts)
    inner = np.ones(len(raw), bool)
    inner[place + sizes] = False
    inner[len(raw) - _LANE :] = False
    raw[inner] = data[offsets[0] : offsets[-1]]
    starts, lengths = _words(raw)
    owner = np.searchsorted(place, starts, side="right") - 1
    # Empty texts share no place with words: each has its own blank.
    _, capital, symbol, first = _classes()
    out = np.empty((texts, 5), np.int64)
    out[:, 0] = np.bincount(owner, minlength=texts)
    out[:, 1] = _distinct(raw, starts, lengths, owner, texts)
    for column, kind in ((2, first), (3, capital), (4, symbol)):
        sums = np.concatenate([[0], np.cumsum(kind[raw])])
        out[:, column] = sums[place + sizes] - sums[place]
    return out


def _counted_long(data: np.ndarray) -> np.ndarray:
    """As _counted for one text of any length: parts end between words; each part gives its distinct words' places, which are
    then compared with each other."""
    out = np.zeros(5, np.int64)
    blank = _classes()[0]
    at, starts, sizes = 0, [], []
    padded = np.concatenate([data, np.full(_LANE, 0x20, np.uint8)])
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not blank[data[end]]:
            gap = np.flatnonzero(blank[data[end : end + BLOCK]])
            end = end + int(gap[0]) if len(gap) else min(end + BLOCK, len(data))
        part = data[at:end]
        a, s = _words(part)
        out[0] += len(a)
        for column, kind in ((2, 3), (3, 1), (4, 2)):
            out[column] += int(np.count_nonzero(_classes()[kind][part]))
        # Only one of the words that a part verifies as equal goes on.
        keys = _hashes(padded, a + at, s)
        keep = np.unique(keys, return_index=True)[1] if _distinct(padded, a + at, s, np.zeros(len(a), np.int64), 1)[0] == len(np.unique(keys)) else slice(None)
        starts.append(a[keep] + at)
        sizes.append(s[keep])
        at = end
    a, s = np.concatenate(starts), np.concatenate(sizes)
    out[1] = _distinct(padded, a, s, np.zeros(len(a), np.int64), 1)[0] if len(a) else 0
    return out


def counts_of(texts: pa.StringArray) -> np.ndarray:
    """words, distinct words, code points, capitals, symbols of each text of an Arrow array without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    out = np.empty((len(texts), 5), np.int64)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1
        if end <= at:
            out[at] = _counted_long(data[offsets[at] : offsets[at + 1]])
            end = at + 1
        else:
            out[at:end] = _counted(data, offsets[at : end + 1])
        at = end
    return out


def failures(counts: np.ndarray) -> np.ndarray:
    """Bits 0 to 3: filters A to D fail."""
    words, distinct, chars, capitals, symbols = counts.T
    failed = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * chars, symbols > 0)
    return sum((f.astype(np.int32) << k for k, f in enumerate(failed)), np.zeros(len(counts), np.int32))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        view = memoryview(texts.buffers()[2] or b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in itertools.pairwise(offsets)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), pa.array(failures(counts_of(texts)), pa.int32()), pa.array(digests, pa.binary())],
            names=["doc_id", "part", "mask", "digest"],
        )
    trimmed()


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits 0 to 3 for A to D), digest (SHA-256) of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_scan, "doc_id bigint, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bits 0 to 4 for A to E), n, good, toxic: one row for each part and mask that occurs."""
    with Scratch(docs.sparkSession) as scratch:
        # Rows of one doc_id, text and part are one row from here on, however often they are repeated.
        rows = scratch.table("rows", masks(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
        marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
        )
        labelled = rows.join(marks.filter("doc_id IS NOT NULL"), "doc_id", "left").fillna(0, ["good", "toxic"])
        # Copies with the same labels are one row: how many, the smallest doc_id, and how many rows carry that.
        alike = labelled.groupBy("digest", "part", "mask", "good", "toxic").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
        )
        first = F.min(F.col("least.doc_id")).over(Window.partitionBy("digest"))
        alone = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
        split = alike.withColumn("alone", alone).select(
            "part",
            F.explode(F.array(F.struct("mask", F.col("alone").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("alone")).alias("n")))).alias("one"),
            "good",
            "toxic",
        )
        return settled(
            split.select("part", F.col("one.mask").alias("mask"), F.col("one.n").alias("n"), (F.col("one.n") * F.col("good")).alias("good"), (F.col("one.n") * F.col("toxic")).alias("toxic"))
            .groupBy("part", "mask")
            .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        )


def interactions(counts: DataFrame) -> DataFrame:
    """The audit of every order of the filters from the masks of mask_counts: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley. A part has 32 masks at most, whatever the number of documents."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    orders = F.array(*(F.lit("".join(o)) for o in itertools.permutations(LETTERS)))
    steps = parts.select("part", "masks", F.explode(orders).alias("filter_order")).select(
        "part", "masks", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step")
    )
    bits = F.array(*(F.lit(1 << k) for k in range(len(LETTERS))))
    bit = lambda letter: F.get(bits, F.instr(F.lit(LETTERS), letter) - 1)
    before = F.aggregate(F.sequence(F.lit(1), F.lit(len(LETTERS))), F.lit(0), lambda s, k: s + F.when(k < F.col("step"), bit(F.substr("filter_order", k, F.lit(1)))).otherwise(0))
    steps = steps.withColumn("own", bit(F.substr("filter_order", F.col("step"), F.lit(1)))).withColumn("before", before)

    def total(holds, of: str = "n", weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate("masks", F.lit(0).cast("long"), lambda s, m: s + F.when(holds(m["mask"]), m[of] * weight(m["mask"])).otherwise(0).cast("long"))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    # In all orders together, the filters that a document fails come first equally often.
    all_orders = math.factorial(len(LETTERS))
    share = lambda m: F.when(m == 0, 0).otherwise((F.lit(all_orders) / F.greatest(F.bit_count(m), F.lit(1))).cast("long"))
    here = lambda m: fails(m) & ~gone(m)
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, weight=share).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs in every order of the filters; see interactions."""
    return interactions(mask_counts(docs, labels))
