"""Benchmark decontamination: which documents hold a passage within a small edit distance of a benchmark item.

Texts are lower-cased and their white space is collapsed. A passage of an item's size may lie anywhere in a document,
so a CGK random walk starts at every place of an item and at every STRIDE-th place of a document: at step j the walk
copies the current code point and then stays or moves on by a random bit of (j, code point), the same for items and
documents. An edit costs the walks their step only until they meet again, so a small edit distance becomes a small
Hamming distance; a walk takes a few steps, and as one starts at every place of a window, edits further on cost only
the walks that pass them. Some steps are the key of a bit-sampling LSH, repeated with bits and steps of its own. A place that shares a key with place o of an item names a window of the item's size that begins o
before it; where enough walks name windows that begin near each other, the window is a candidate. One that has too few
of the item's three-letter sequences for the bound is dropped (no passage within it can be); the exact edit distance, over
all substrings near the window, decides on the others. Steps, repetitions and the number of walks depend on the item's
length (BANDS), so that items of every length are found at edits near the bound. Known limit: of items from 80 code points
on that lose every fifth letter (the bound, at regular places), about two thirds are found.

An item under SHORT code points has too few walks: it is cut into one piece more than it may have edits, so one of the
pieces occurs unchanged in any passage (pigeonhole), and every occurrence of a piece is a candidate.

Items are the query set. They are broadcast in blocks of at most BLOCK_CHARS code points, and each block meets
all documents; nothing else is broadcast, no rows are shuffled. A text is searched in blocks of PLACES places.

Defined cases: null or blank items match nothing; null and empty documents match nothing; an item under five code points
must occur exactly; repeated rows give repeated results, equal items are reported each; an empty table on either side
gives an empty result; further columns are ignored, or carried by ``clean``. A text of any length is scanned whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import code_points
from .common import fresh, small_batches, trimmed
from .shingles import mixed

#: Edits allowed, as a share of the item's length.
MAX_EDITS = 0.2
STRIDE = 2
SHORT = 40


@dataclass(frozen=True)
class Band:
    """How items from a length on are searched for: steps of a walk, those that are its key, repetitions, walks that must name
    nearly the same window, and code points of the item that they must at least lie apart."""

    low: int
    steps: int
    sampled: int
    repetitions: int
    agree: int
    apart: int


#: A walk of s steps covers about s / 2 code points, so of n code points with an edit every five, the expected number of
#: walks without one falls with s and grows with n and the repetitions: shorter items take shorter walks, and more of them
#: must agree, for short keys are shared by chance.
BANDS = (Band(SHORT, 9, 8, 4, 6, 14), Band(52, 10, 9, 4, 6, 16), Band(64, 11, 9, 4, 6, 16), Band(80, 28, 12, 4, 3, 8))
BLOCK_CHARS = 2_000_000
#: Numbers of three-letter sequences.
GRAMS = 1 << 12
#: Passages that are compared together.
WAITING = 4_096
#: Item lengths that a passage is cut to.
REACH = 4
#: Characters of the documents that are searched together.
GATHERED = 8_000_000
#: Places of a text that are walked from at once, and hits that are held at once.
PLACES, HITS = 1 << 16, 1 << 21
_SEED = 12
_FACTOR = np.int64(0x1E3779B97F4A7C15)
#: Zeros between texts that are walked together: no walk passes them.
_GAP = max(b.steps for b in BANDS)
#: Bits under which walks over common letters keep moving; others find as much, with more windows to compare.
_FACTORS = mixed(np.arange(300, 364, dtype=np.uint64)) | np.uint64(1)
#: Walks that are stepped together, so that they stay in a core's cache.
CACHED = 1 << 14


def normalised(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Pattern:
    """An item for the bit-parallel edit distance: for each of its code points the places where it stands, 64 to a word."""

    def __init__(self, codes: np.ndarray):
        self.size, self.words = len(codes), (len(codes) + 63) // 64
        self.codes, which = np.unique(codes, return_inverse=True)
        # The last row stands for code points that the item does not hold.
        self.masks = np.zeros((len(self.codes) + 1, self.words), np.uint64)
        at = np.arange(len(codes))
        np.bitwise_or.at(self.masks, (which, at // 64), np.uint64(1) << (at % 64).astype(np.uint64))

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """The row of masks of each code point."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, len(self.codes))


def closest(pairs: list[tuple[Pattern, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern and text (edit distance, end) of the text's first substring that is closest to the pattern.

    Bit-parallel dynamic programming over all pairs at once, a text position after the other: the bits of a word are
    the vertical differences of 64 rows, and horizontal differences are carried from word to word. Longer texts come
    first, so that those which have ended drop out.
    """
    given = len(pairs)
    order = sorted(range(given), key=lambda k: -len(pairs[k][1]))
    lengths = np.array([len(pairs[k][1]) for k in order], np.int64)
    words, length = max((p.words for p, _ in pairs), default=0), int(lengths.max(initial=0))
    one, top = np.uint64(1), np.uint64(63)
    base = np.cumsum([0, *(len(pairs[k][0].masks) for k in order)])
    table = np.zeros((words, int(base[-1])), np.uint64)
    rows = np.zeros((length, given), np.int64)
    for c, k in enumerate(order):
        p, t = pairs[k]
        table[: p.words, base[c] : base[c + 1]] = p.masks.T
        rows[: len(t), c] = base[c] + p.rows(t)
    size = np.array([pairs[k][0].size for k in order], np.int64)
    last, last_bit = (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    closing = [last == w for w in range(words)]
    up, down = np.full((words, given), ~np.uint64(0)), np.zeros((words, given), np.uint64)
    score, best, end = size.copy(), size.copy(), np.zeros(given, np.int64)
    running = np.searchsorted(-lengths, -np.arange(length), "left")  # texts with more than j positions
    with np.errstate(over="ignore"):
        for j in range(length):
            n = int(running[j])
            row, plus_in, minus_in = rows[j, :n], np.uint64(0), np.uint64(0)
            for w in range(words):
                eq, u, d = table[w].take(row), up[w, :n], down[w, :n]
                x = eq | d
                eq |= minus_in
                across = eq & u
                across += u
                across ^= u
                across |= eq
                plus = across | u
                np.invert(plus, out=plus)
                plus |= d
                minus = u & across
                if closing[w].any():
                    change = (plus >> last_bit[:n] & one).astype(np.int64) - (minus >> last_bit[:n] & one).astype(np.int64)
                    score[:n] += np.where(closing[w][:n], change, 0)
                plus_out, minus_out = plus >> top, minus >> top
                plus <<= one
                plus |= plus_in
                minus <<= one
                minus |= minus_in
                plus_in, minus_in = plus_out, minus_out
                np.bitwise_and(plus, x, out=down[w, :n])
                x |= plus
                np.invert(x, out=x)
                np.bitwise_or(minus, x, out=up[w, :n])
            better = np.flatnonzero(score[:n] < best[:n])
            if len(better):
                best[better], end[better] = score[better], j + 1
    back = np.empty(given, np.int64)
    back[order] = np.arange(given)
    return best[back], end[back]


@lru_cache(maxsize=8)
def sampled_steps(band: Band) -> list[frozenset[int]]:
    """The steps that are the key, for each repetition."""
    return [frozenset(np.random.default_rng([_SEED, r]).choice(band.steps, band.sampled, replace=False).tolist()) for r in range(band.repetitions)]


def hashed(codes: np.ndarray) -> np.ndarray:
    return mixed(codes.astype(np.uint64))


def walk_keys(hashes: np.ndarray, begin: int, repetition: int, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Every STRIDE-th place from begin of a text, whose code points are given as hashes, and the LSH key of the walk of
    ``repetition`` from it; a walk past the end copies zeros."""
    wanted = sampled_steps(band)[repetition]
    places = np.arange(begin, len(hashes), STRIDE)
    keys = np.zeros(len(places), np.int64)
    # Bit j of a code point's hash says whether step j moves on; the hash stands for the code point in the key.
    moves = np.zeros(len(hashes) + band.steps + 1, np.int64)
    with np.errstate(over="ignore"):
        np.right_shift(hashes * (_FACTORS[repetition]), np.uint64(32), out=moves[: len(hashes)].view(np.uint64))
        for a in range(0, len(places), CACHED):
            at, key = places[a : a + CACHED].copy(), keys[a : a + CACHED]
            here = np.empty_like(at)
            for j in range(band.steps):
                moves.take(at, out=here, mode="wrap")  # the quickest mode; no place is out of range
                if j in wanted:
                    key *= _FACTOR
                    key += here
                if j + 1 < band.steps:
                    here >>= j
                    here &= 1
                    at += here
    return places, (keys.view(np.uint64) >> np.uint64(32)).astype(np.uint32)


def _all_walks(codes: np.ndarray, repetition: int, band: Band) -> np.ndarray:
    """The keys of the walks from all places of an item but the last, in order."""
    keys, hashes = np.empty(len(codes), np.uint32), hashed(codes)
    for k in range(STRIDE):
        keys[k::STRIDE] = walk_keys(hashes, k, repetition, band)[1]
    return keys[: len(codes) - band.steps // 2]


def grams(codes: np.ndarray) -> np.ndarray:
    """The three-letter sequences of a text as numbers under GRAMS; different ones may share a number."""
    with np.errstate(over="ignore"):
        c = codes.astype(np.uint32)
        return ((c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(20)).astype(np.int64)


def pieces(text: str) -> list[str]:
    """text cut into one piece more than it may have edits."""
    n = int(MAX_EDITS * len(text)) + 1
    cuts = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Items:
    """A block of items, ready to be searched for."""

    ids: list[int | None]
    texts: list[str]

    def __post_init__(self) -> None:
        codes = [code_points(t) for t in self.texts]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.patterns = [Pattern(c) if len(c) else None for c in codes]
        # An edit changes three of an item's three-letter sequences at most, so a passage within the bound has all others.
        self.profiles = [np.bincount(grams(c), minlength=GRAMS).astype(np.int16) if len(c) > 2 else None for c in codes]
        self.needed = self.sizes - 2 - 3 * (MAX_EDITS * self.sizes).astype(np.int64)
        self.short = [(k, pieces(t)) for k, t in enumerate(self.texts) if 0 < len(t) < SHORT]
        long = [k for k, t in enumerate(self.texts) if len(t) >= SHORT]
        self.longest = max((len(codes[k]) for k in long), default=0)
        self.tables = []
        of = np.maximum(np.searchsorted([b.low for b in BANDS], self.sizes, "right") - 1, 0)
        self.agree, self.apart = (np.array([getattr(b, name) for b in BANDS])[of] for name in ("agree", "apart"))
        for number, band in enumerate(BANDS):
            mine = [k for k in long if of[k] == number]
            for r in range(band.repetitions) if mine else ():
                # A walk that would run past the item's end meets other text in a document.
                walks = [_all_walks(codes[k], r, band) for k in mine]
                keys = np.concatenate(walks)
                order = np.argsort(keys, kind="stable")
                owner = np.repeat(np.array(mine, np.int32), [len(x) for x in walks])[order]
                offset = np.concatenate([np.arange(len(x)) for x in walks])[order].astype(np.int32)
                bits = min(32, max(16, (16 * len(keys)).bit_length()))
                seen = np.zeros(1 << bits, bool)
                seen[keys >> np.uint32(32 - bits)] = True
                self.tables.append((band, r, keys[order], owner, offset, seen, np.uint32(32 - bits)))

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(items, places, offsets in the items) of walks that share a key."""
        found, hashes = [], hashed(codes)
        for band, r, keys, owner, offset, seen, shift in self.tables:
            # Repetitions take places in turn: STRIDE walks begin at STRIDE places that follow each other.
            at, key = walk_keys(hashes, r % STRIDE, r, band)
            some = np.flatnonzero(seen.take(key >> shift))
            at, key = at[some], key[some]
            low = np.searchsorted(keys, key, "left")
            n = np.searchsorted(keys, key, "right") - low
            some = np.flatnonzero(n)
            at, low, n = at[some], low[some], n[some]
            which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found.append((owner[which].astype(np.int64), np.repeat(at, n), offset[which].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def windows(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first start, last start) of the candidate windows of some texts; a start may be negative."""
        overlap = 2 * self.longest
        # Pieces of texts: text, where it begins, where it ends. A long text has several, which overlap.
        work: list[list[tuple[int, int, int]]] = [[]]
        filled = 0
        for k, codes in enumerate(texts):
            for a in range(0, len(codes) if self.tables else 0, PLACES):
                piece = (k, a, min(a + PLACES + overlap, len(codes)))
                if filled + piece[2] - a > PLACES:
                    work.append([])
                    filled = 0
                work[-1].append(piece)
                filled += piece[2] - a + _GAP
        while work:
            block = work.pop()
            if not block:
                continue
            gap = np.zeros(_GAP, np.uint32)
            begin = np.cumsum([0, *(b - a + _GAP for _, a, b in block)])
            item, place, offset = self.hits(np.concatenate([x for k, a, b in block for x in (texts[k][a:b], gap)]))
            if len(item) > HITS and (len(block) > 1 or block[0][2] - block[0][1] > 4 * overlap):
                if len(block) > 1:
                    work += [block[: len(block) // 2], block[len(block) // 2 :]]
                else:
                    k, a, b = block[0]
                    work += [[(k, a, (a + b) // 2 + overlap)], [(k, (a + b) // 2, b)]]
                continue
            if not len(item):
                continue
            piece = np.searchsorted(begin, place, "right") - 1
            start = place - offset
            both = piece * len(self.sizes) + item
            order = np.lexsort((start, both))
            both, start, offset = both[order], start[order], offset[order]
            # Windows of one item agree as long as each begins near the next: edits between two walks shift what they name.
            new = np.ones(len(both), bool)
            new[1:] = (both[1:] != both[:-1]) | ((start[1:] - start[:-1]) * 8 > self.sizes[both[1:] % len(self.sizes)])
            lead = np.flatnonzero(new)
            ends = np.append(lead[1:], len(both)) - 1
            apart = np.maximum.reduceat(offset, lead) - np.minimum.reduceat(offset, lead)
            which = both[lead] % len(self.sizes)
            good = (ends - lead + 1 >= self.agree[which]) & (apart >= self.apart[which])
            for x, first, final in zip(both[lead[good]].tolist(), start[lead[good]].tolist(), start[ends[good]].tolist(), strict=True):
                k, a, _ = block[x // len(self.sizes)]
                shift = a - int(begin[x // len(self.sizes)])
                yield k, x % len(self.sizes), first + shift, final + shift

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(row, item, edits, start) of the closest passage for each row and item that match."""
        spans: list[tuple[int, int, int, np.ndarray]] = []
        found: dict[tuple[int, int], tuple[int, int]] = {}

        def compare() -> None:
            words = lambda span: self.patterns[span[1]].words
            for _, same in groupby(sorted(spans, key=words), words):
                some = list(same)
                edits, ends = closest([(self.patterns[k], passage) for _, k, _, passage in some])
                for (row, k, a, _), e, end in zip(some, edits.tolist(), ends.tolist(), strict=True):
                    if e <= MAX_EDITS * self.sizes[k]:
                        found[row, k] = min(found.get((row, k), (e, a + end)), (e, a + end))
            spans.clear()

        plain = [normalised(t) for t in texts]
        codes = [code_points(t) for t in plain]
        now, here = -1, np.zeros(0, np.int64)
        for (row, k), regions in sorted(self.regions(plain, codes).items()):
            if row != now:
                now, here = row, grams(codes[row])
            for a, b in regions:
                if self.needed[k] > 0 and np.minimum(np.bincount(here[a : max(a, b - 2)], minlength=GRAMS), self.profiles[k]).sum() < self.needed[k]:
                    continue
                spans.append((row, k, a, codes[row][a:b]))
            if len(spans) >= WAITING:
                compare()
        compare()
        return [(row, k, edits, max(0, end - int(self.sizes[k]))) for (row, k), (edits, end) in sorted(found.items())]

    def regions(self, texts: list[str], codes: list[np.ndarray]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """For each text and item the stretches that hold candidate windows, apart from each other and no longer than REACH
        item lengths (longer ones are cut, with an overlap of all that a passage may take)."""
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for row, k, first, last in self.windows(codes):
            slack = int(MAX_EDITS * self.sizes[k]) + 1
            near.setdefault((row, k), []).append((first - slack, last + int(self.sizes[k]) + 2 * slack))
        for k, cut in self.short:
            size, edits, before = len(self.texts[k]), len(cut) - 1, 0
            for piece in cut:
                for row, text in enumerate(texts):
                    at = text.find(piece)
                    while at >= 0:
                        near.setdefault((row, k), []).append((at - before - edits, at - before + size + edits))
                        at = text.find(piece, at + 1)
                before += len(piece)
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for (row, k), spans in near.items():
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                a, b = max(0, a), min(b, len(codes[row]))
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            step, overlap = REACH * int(self.sizes[k]), 2 * int(self.sizes[k])
            out[row, k] = [(at, min(b, at + step + overlap)) for a, b in merged for at in range(a, max(a + 1, b - overlap), step)]
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The items in blocks of at most BLOCK_CHARS code points (one item at least)."""
    ids: list[int | None] = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if size and size + len(text) > BLOCK_CHARS:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(text)
        size += len(text)
    yield Items(ids, texts)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together until their last columns, the texts, hold GATHERED bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.num_columns - 1).nbytes
        if size >= GATHERED:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _search(held):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in _gathered(batches):
            ids = batch.column(0)
            found = items.find(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([f[0] for f in found], pa.int64())),
                    pa.array([items.ids[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()),
                    pa.array([1 - f[2] / int(items.sizes[f[1]]) for f in found], pa.float64()),
                    pa.array([f[3] for f in found], pa.int64()),
                ],
                names=["doc_id", "item_id", "edit_distance", "similarity", "start"],
            )
        trimmed()

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edit_distance, similarity and start (in the normalised text) for each document that holds an item."""
    spark, out = docs.sparkSession, None
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in item_blocks(benchmark):
        found = rows.mapInArrow(
            _search(spark.sparkContext.broadcast(items)), "doc_id bigint, item_id bigint, edit_distance bigint, similarity double, start bigint"
        )
        out = found if out is None else out.unionByName(found)
    return out


def _passed(held, clean_name: str):
    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            hit = {f[0] for f in held.value.find(batch.column(batch.num_columns - 1).to_pylist())}
            yield batch.take(pa.array([k for k in range(batch.num_rows) if k not in hit], pa.int64())).drop_columns([clean_name])
        trimmed()

    return passed


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; columns as in docs."""
    out = docs
    small_batches(docs.sparkSession)
    for items in item_blocks(benchmark):
        searched = fresh("searched", docs.columns)
        rows = out.withColumn(searched, F.col("text").cast("string"))
        out = rows.mapInArrow(_passed(docs.sparkSession.sparkContext.broadcast(items), searched), docs.schema)
    return out
