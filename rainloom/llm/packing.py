"""Packing of tokenised documents into sequences by first-fit decreasing in randomised groups.

A document's ids are cut every ``size`` ids; whole cuts are sequences of their own and are never shuffled. What is
left of each document (fewer than ``size`` ids) goes, by a hash of its row number, to one of many groups of about GROUP
documents. Each group is packed by itself: pieces in descending order, each into the first sequence with room, which a
tournament tree of the sequences' room finds in logarithmic time. Then the emptiest sequences of the group give ids to
gaps of MIN_GAP or more of the fuller ones (their pieces are cut there), and the last, partly filled one is cut into
sequences whose sizes are powers of two, which need no padding. A group holds GROUP documents in the mean whatever the
data: row numbers are unique, so no key is hot, and a group's ids are size * GROUP * 4 bytes at most in the mean.

Texts are encoded by their different words (see words.py); the ids are those of the whole text.

Defined cases: a null or empty text is its end id alone, repeated rows are packed each, further columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settled, small_batches, trimmed
from .words import Words

#: Ids in a sequence; the id that ends a document; documents in a group in the mean.
SIZE, END, GROUP = 4_096, 2, 2_000
#: Smaller gaps stay padding, so that documents are not cut for a few ids.
MIN_GAP = 32
#: Bytes of texts that a worker encodes at once; the more, the fewer words are met again.
_HAND_ON = 4_000_000


class WordTokenizer:
    """A tokenizer file for executors, broadcast once; the file is a vocabulary of fixed size."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            self.model = spark.sparkContext.broadcast(file.read())

    def words(self) -> Words:
        return _words(self.model.value)

    def __reduce__(self):
        return _restored, (self.model,)


def _restored(model) -> WordTokenizer:
    known = WordTokenizer.__new__(WordTokenizer)
    known.model = model
    return known


@lru_cache(maxsize=2)
def _words(model: str) -> Words:
    return Words(model)


def _cut(tokens: WordTokenizer, size: int, end_id: int):
    """doc_id, text to rows doc_id, start, length, ids, doc_tokens: one for each ``size`` ids of a document and one for the rest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokens.words()
        names, kinds = ["doc_id", "start", "length", "ids", "doc_tokens"], (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(doc_ids):
                # Texts of some MB at once; a longer one by itself.
                end, chars = at, 0
                while end < len(doc_ids) and (end == at or chars < _HAND_ON):
                    chars += len(texts[end].as_buffer() or b"") if texts[end].is_valid else 0
                    end += 1
                out: list[list] = [[] for _ in names]
                for doc_id, ids in zip(doc_ids[at:end], words.encode(texts[at:end]), strict=True):
                    ids = np.append(ids, np.int32(end_id))
                    for start in range(0, len(ids), size):
                        piece = ids[start : start + size]
                        for column, value in zip(out, (doc_id, start, len(piece), piece.astype("<i4").tobytes(), len(ids)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                at = end
        trimmed()

    return cut


def first_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """First-fit decreasing: for each length its sequence and its offset there, and the fill of each sequence."""
    base = 1 << max(len(lengths) - 1, 0).bit_length()
    room = [size] * (2 * base)
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        length, at = int(lengths[k]), 1
        while at < base:
            at = 2 * at if room[2 * at] >= length else 2 * at + 1
        where[k], offset[k] = at - base, size - room[at]
        room[at] -= length
        at //= 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
    used = int(where.max()) + 1 if len(lengths) else 0
    return where, offset, [size - r for r in room[base : base + used]]


def plan(lengths: np.ndarray, size: int, min_gap: int = MIN_GAP) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece: first-fit decreasing, then gaps filled from the emptiest
    sequences, and the last of those cut into powers of two."""
    where, offset, fill = first_fit(lengths, size)
    content: list[list[list[int]]] = [[] for _ in fill]
    for k in np.argsort(offset, kind="stable").tolist():
        content[where[k]].append([k, 0, int(lengths[k])])
    # Fullest first; ties keep their order.
    order = sorted(range(len(fill)), key=lambda s: -fill[s])
    low, high = 0, len(order) - 1
    while low < high:
        taker, giver = order[low], order[high]
        gap = size - fill[taker]
        if gap < min_gap:
            low += 1
            continue
        item = content[giver][-1]
        moved = min(gap, item[2])
        content[taker].append([item[0], item[1] + item[2] - moved, moved])
        item[2] -= moved
        fill[taker] += moved
        fill[giver] -= moved
        if not item[2]:
            content[giver].pop()
        if not content[giver]:
            high -= 1
    out, number = [], 0
    for place, s in enumerate(order):
        if not content[s]:
            continue
        if place == high and size - fill[s] >= min_gap:
            cuts, left = [], fill[s]
            while left:
                cuts.append(1 << (left.bit_length() - 1))
                left -= cuts[-1]
        else:
            cuts = [fill[s]]
        at, room = 0, cuts[0]
        for item, start, length in content[s]:
            while length:
                if not room:
                    cuts.pop(0)
                    number, at, room = number + 1, 0, cuts[0]
                part = min(length, room)
                out.append((item, start, part, number, at))
                start, length, at, room = start + part, length - part, at + part, room - part
        number += 1
    return out


def _packed(size: int):
    """A group's rows doc_id, start, length, ids, doc_tokens, rid, number to its pieces."""

    def packed(table: pa.Table) -> pa.Table:
        rows = table.sort_by("rid").combine_chunks()
        lengths = rows["length"].to_numpy().astype(np.int64)
        pieces = np.array(plan(lengths, size), np.int64).reshape(-1, 5)
        item = pieces[:, 0]
        got = rows["ids"]
        ids = [got[int(k)].as_buffer().to_pybytes()[4 * s : 4 * (s + n)] for k, s, n in pieces[:, :3].tolist()]
        return pa.table(
            {
                "doc_id": rows["doc_id"].take(pa.array(item)),
                "start": pa.array(rows["start"].to_numpy()[item] + pieces[:, 1], pa.int64()),
                "length": pa.array(pieces[:, 2], pa.int64()),
                "ids": pa.array(ids, pa.binary()),
                "doc_tokens": rows["doc_tokens"].take(pa.array(item)),
                # Groups stay apart in the upper half; a group has far fewer sequences than the lower half counts.
                "sequence_id": pa.array((rows["number"].to_numpy()[item].astype(np.int64) << 32) + pieces[:, 3], pa.int64()),
                "offset": pa.array(pieces[:, 4], pa.int64()),
            }
        )

    return packed


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END, group: int = GROUP, derive: Callable[[DataFrame], DataFrame] = lambda pieces: pieces) -> DataFrame:
    """doc_id, start, length, ids (32-bit little-endian numbers), doc_tokens, sequence_id, offset: one row for each piece.

    Sequences of whole cuts have negative ids, packed ones carry their group's number in the upper half. What derive makes
    of the pieces is what is kept and returned: who needs no ids then keeps none."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with Scratch(spark) as scratch:
        cut = rows.mapInArrow(_cut(WordTokenizer(spark, path), size, end_id), "doc_id bigint, start bigint, length int, ids binary, doc_tokens bigint")
        # Row numbers are written down, so that a task that runs again finds the same ones.
        pieces = scratch.table("pieces", cut.withColumn("rid", F.monotonically_increasing_id()).withColumn("whole", F.col("length") == size))
        rest = pieces.filter(~F.col("whole"))
        groups = max(1, round(rest.count() / group))
        grouped = rest.drop("whole").withColumn("number", F.pmod(F.xxhash64("rid"), F.lit(groups)))
        out = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
        packed = grouped.groupBy("number").applyInArrow(_packed(size), out)
        whole = pieces.filter("whole").select(
            "doc_id", "start", F.col("length").cast("long").alias("length"), "ids", "doc_tokens", (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
        return settled(derive(packed.unionByName(whole)))
