"""Alignment of two tokenizers' tokens over the same bytes, relationally.

Token rows of a batch of documents are columns: ids and, by running sums of byte lengths, ends. Both sides of a document
have the same bytes, so ends that run on from document to document still agree. The equality join on (document, end) is
a merge of the two columns of ends; where both have one is a cut, and running cut counts number the groups. Links are
a range join done as running counts over the merged ends: between two neighbouring ends lies exactly one token of each
side, the nearest that ends there or later, so every link is one entry and no group is ever paired with itself (joining
on the group would emit all pairs of a group). A document's tokens are never shuffled; work is in proportion to tokens.
A link's pair is counted once for each document that holds it, in a shuffle by pair; counts go back to the documents by a
broadcast where the pairs were counted to be few, by a merge join else.

Tokenizers are the libraries' own. Long texts are encoded in pieces cut where neither joins text.

Defined cases: a document whose text is null or empty, or whose joined token bytes differ from space + text on either
side, has no tokens: zeros and ''. Repeated rows are aligned each, further columns are ignored, ties of counts are all best, an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, settled, small_batches, trimmed
from .runs import ids_of

#: Bytes of text whose tokens are aligned at once; a longer text by itself.
PART_BYTES = 1 << 20
#: Pairs of ids that may be broadcast with their counts: a hash relation of some 100 MB at most.
BROADCAST_PAIRS = 1_500_000


class Side:
    """Tokens with byte lengths of texts. encode takes texts that begin with a space."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        self.encode, self.bytes = encode, token_bytes
        self.size = np.array([len(b) for b in token_bytes], np.int64)

    def tokens(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; none where their bytes are not the text's."""
        out = []
        for text, ids in zip(texts, ids_of([f" {t or ''}" for t in texts], self.encode), strict=True):
            right = bool(text) and b"".join(map(self.bytes.__getitem__, ids.tolist())) == f" {text}".encode()
            out.append(ids if right else ids[:0])
        return out


@lru_cache(maxsize=2)
def _byte_level(model: str, pattern: str | None = None) -> Side:
    """With the pattern of its pre-tokens, a vocabulary whose merges come in order of ids is read as ranks, which is quicker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.encode_special_tokens = True
    # Byte-level tokens write each byte as a character: printable ones as themselves, the others from 256 on in order.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    pieces = [tokenizer.id_to_token(k) for k in range(tokenizer.get_vocab_size())]
    table = [bytes(byte[c] for c in p) if all(c in byte for c in p) else p.encode() for p in pieces]
    parts = json.loads(model)
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in parts["model"]["merges"]]
    places = [parts["model"]["vocab"][m] for m in merged]
    if pattern and places == sorted(places) and len(set(merged)) == len(merged):
        import tiktoken

        special = {t["id"] for t in parts["added_tokens"]}
        ranks = {b: k for k, b in enumerate(table) if k not in special}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return Side(lambda texts: [encoding.encode_ordinary(t) for t in texts], table)

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return Side(encode, table)


@lru_cache(maxsize=2)
def _pieces(model: bytes) -> Side:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = []
    for k in range(processor.get_piece_size()):
        piece = processor.id_to_piece(k)
        table.append(bytes([int(piece[3:5], 16)]) if processor.is_byte(k) else piece.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[list[int]]:
        return processor.encode([t[1:] for t in texts], num_threads=1)  # the library adds the space

    return Side(encode, table)


class Tokens:
    """A tokenizer file for executors, broadcast once (a vocabulary of fixed size), and the way to read it."""

    def __init__(self, spark: SparkSession, path: str, pattern: str | None = None):
        with open(path, "rb") as file:
            self.model, self.json, self.pattern = spark.sparkContext.broadcast(file.read()), path.endswith(".json"), pattern

    def side(self) -> Side:
        return _byte_level(self.model.value.decode(), self.pattern) if self.json else _pieces(self.model.value)

    def __reduce__(self):
        return _restored, (self.model, self.json, self.pattern)


def _restored(model, json: bool, pattern: str | None) -> Tokens:
    tokens = Tokens.__new__(Tokens)
    tokens.model, tokens.json, tokens.pattern = model, json, pattern
    return tokens


@lru_cache(maxsize=2)
def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits of every number below most, left-aligned in a row with one place to spare, and how many they are."""
    said = np.arange(most).astype("S")
    digits = np.zeros((most, said.itemsize + 1), np.uint8)
    digits[:, :-1] = said.view(np.uint8).reshape(most, -1)
    return digits, np.char.str_len(said)


def _bounds(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _groups(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, tokens: np.ndarray, most: int) -> pa.Array:
    """Each document's groups as text. last: whether a token ends at a cut; tokens: bounds of the documents over both sides' tokens."""
    # A token's place in the text comes after all tokens of earlier groups; side b's also after its own group's side a.
    place_a = np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(last_b) + 1])[np.cumsum(last_a) - last_a]
    place_b = np.arange(len(b)) + (np.flatnonzero(last_a) + 1)[np.cumsum(last_b) - last_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a], mark[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
    digits, width = _decimals(most)
    size, rows = width[ids], digits[ids]
    rows[np.arange(len(ids)), size] = mark
    size = size + 1
    size[tokens[1:][np.diff(tokens) > 0] - 1] -= 1  # no mark after a document's last token
    text = rows[np.arange(rows.shape[1]) < size[:, None]]
    return pa.StringArray.from_buffers(len(tokens) - 1, pa.py_buffer(_bounds(size)[tokens].astype(np.int32)), pa.py_buffer(text))


def _links(pairs: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each document's distinct pairs with the number of their links, sorted."""
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        pairs[low:high].sort()
    new = np.ones(len(pairs), bool)
    new[1:] = pairs[1:] != pairs[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    times = np.diff(np.append(np.flatnonzero(new), len(pairs))).astype(np.int32)
    held = pa.StructArray.from_arrays([pa.array(pairs[new]), pa.array(times)], names=["pair", "n"])
    return pa.ListArray.from_arrays(pa.array(_bounds(new)[bounds].astype(np.int32)), held)


_ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links array<struct<pair:bigint,n:int>>"


def aligned(doc_ids: pa.Array, texts: list[str | None], one: Side, two: Side) -> pa.RecordBatch:
    """Tokens of both sides merged by their ends; see the module's text."""
    both = [(a, b) if len(a) and len(b) else (a[:0], b[:0]) for a, b in zip(one.tokens(texts), two.tokens(texts), strict=True)]
    n_a, n_b = (np.array([len(ids[k]) for ids in both], np.int64) for k in (0, 1))
    a, b = (np.concatenate([ids[k] for ids in both]) for k in (0, 1))
    end_a, end_b = np.cumsum(one.size[a]), np.cumsum(two.size[b])
    at_a, at_b = (np.zeros(int(end_a[-1]) + 1 if len(end_a) else 1, bool) for _ in range(2))
    at_a[end_a], at_b[end_b] = True, True
    ends = np.flatnonzero(at_a | at_b)
    in_a, in_b = at_a[ends], at_b[ends]
    pairs = (a[np.cumsum(in_a) - in_a].astype(np.int64) << 32) + b[np.cumsum(in_b) - in_b]
    bounds = np.searchsorted(ends, np.concatenate([[0], end_a])[_bounds(n_a)], "right")
    columns = [
        doc_ids, pa.array(n_a), pa.array(n_b), pa.array(np.diff(_bounds(in_a & in_b)[bounds])), pa.array(np.diff(bounds)),
        _groups(a, b, at_b[end_a], at_a[end_b], _bounds(n_a + n_b), max(len(one.bytes), len(two.bytes))), _links(pairs, bounds),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in _ALIGNED.split(", ")])


def _align(one: Tokens, two: Tokens, part_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = one.side(), two.side()
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()
            at = 0
            while at < len(sizes):
                end, size = at + 1, sizes[at]
                while end < len(sizes) and size + sizes[end] <= part_bytes:
                    size += sizes[end]
                    end += 1
                yield aligned(batch.column(0)[at:end], texts[at:end].to_pylist(), a, b)
                at = end
        trimmed()

    return run


def align(docs: DataFrame, path_a: str, path_b: str, pattern: str | None = None, part_bytes: int = PART_BYTES, broadcast_pairs: int = BROADCAST_PAIRS, derive: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every document; see the module's text.

    pattern: of the pre-tokens of a byte-level side, where its vocabulary may be read as ranks. derive: what is kept of groups."""
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark) as scratch:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = rows.mapInArrow(_align(Tokens(spark, path_a, pattern), Tokens(spark, path_b, pattern), part_bytes), _ALIGNED)
        # Row numbers are written down, so that a task that runs again finds the same ones.
        found = scratch.table("found", found.withColumn("groups", derive(F.col("groups"))).withColumn("row", F.monotonically_increasing_id()), "zstd")
        counts = found.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("held"))
        best = F.col("held") == F.max("held").over(Window.partitionBy(F.shiftright("pair", 32)))
        counts = scratch.table("counts", counts.select("pair", "held", best.cast("long").alias("best")))
        few = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
        told = found.select("row", F.inline("links")).join(F.broadcast(counts) if few else counts.hint("merge"), "pair")
        sums = told.groupBy("row").agg(F.sum(F.col("n") * F.col("best")).alias("n_best"), F.sum(F.col("n") * F.col("held")).alias("count_sum"))
        rest = found.drop("links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
        return settled(rest.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"))
