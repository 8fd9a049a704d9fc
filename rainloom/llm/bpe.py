"""Byte-level BPE by overlapping chunks, and decoding back to bytes.

Texts longer than a chunk are cut into chunks that overlap. Each chunk is pre-tokenised by itself, as a row of
its own; where the pre-token boundaries of two neighbours agree inside their overlap, both are right from there
on, for a match depends only on the text after its start. The agreed places cut the text into pieces, which are
encoded apart and joined again. Only places after a character that is not white space count, so that a piece's
last pre-token does not change when the text ends there. Where an overlap has no agreed place (a pre-token longer
than it), what follows the last proven place is cut again, with an overlap WIDER times as long, in parallel with that
of all other such texts, until the chunks agree or what is left is one chunk. So a piece is long only where
pre-tokens are. Shorter texts are one piece and are encoded where they are, without a shuffle.

Decoding concatenates the bytes of the ids.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each, extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, settled, small_batches, trimmed

#: Code points in a chunk, and those that it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: How much longer overlaps are when chunks did not agree; a chunk is CHUNK, or four overlaps where that is more.
WIDER = 8


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Codec:
    """Encoder and decoder over a rank file's bytes, broadcast once; the file is a vocabulary of fixed size."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks, self.pattern = spark.sparkContext.broadcast(file.read()), pattern

    def encoding(self) -> tiktoken.Encoding:
        return _encoding(self.ranks.value, self.pattern)

    def __reduce__(self):
        return _restored, (self.ranks, self.pattern)


def _restored(ranks, pattern: str) -> Codec:
    codec = Codec.__new__(Codec)
    codec.ranks, codec.pattern = ranks, pattern
    return codec


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Starts of the pre-tokens of text whose left neighbour is not white space."""
    starts = (m.start() for m in _pattern(pattern).finditer(text))
    return np.array([p for p in starts if p and not text[p - 1].isspace()], dtype=np.int64)


def stitch(marks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[int]:
    """Where the pieces start: for each chunk its number, boundaries in its head and in its tail overlap (all in the text's
    code points). Agreement proves a chunk right only if its left neighbour is; where the chain ends, there are fewer cuts than chunks."""
    marks = sorted(marks, key=lambda m: m[0])
    cuts = [0]
    for (_, _, tail), (_, head, _) in zip(marks, marks[1:], strict=False):
        both = np.intersect1d(tail, head)
        if not len(both):
            break
        cuts.append(int(both[0]))
    return cuts


def _ids_text(ids: list[int]) -> bytes:
    return " ".join(map(str, ids)).encode()


def _short(codec: Codec, digests: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec.encoding()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoding.encode_ordinary(text.as_py() or "")
                out[0].append(doc_id)
                out[1].append(len(ids))
                if digests:
                    out[2].append(hashlib.sha256(_ids_text(ids)).hexdigest())
                    out[3].append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
                else:
                    out[2].append(ids)
                    out[3].append(encoding.decode_bytes(ids))
            kinds = (pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kinds[0]), pa.array(out[3], kinds[1])],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )
        trimmed()

    return encode


def _marks(pattern: str, chunk: int, overlap: int):
    @F.pandas_udf("struct<head: array<bigint>, tail: array<bigint>>")
    def marks(text: pd.Series, number: pd.Series) -> pd.DataFrame:
        heads, tails = [], []
        for t, k in zip(text, number, strict=True):
            found = boundaries(t, pattern)
            # What stands at the very end of a chunk may be cut off there.
            found = found[found < max(len(t) - 2, 0)]
            heads.append((found[found < overlap] + k * chunk).tolist())
            tails.append((found[found >= chunk] + k * chunk).tolist())
        return pd.DataFrame({"head": heads, "tail": tails})

    return marks


def _stitched():
    @F.pandas_udf("array<bigint>")
    def stitched(marks: pd.Series) -> pd.Series:
        return pd.Series(
            [stitch([(m["k"], np.asarray(m["head"], np.int64), np.asarray(m["tail"], np.int64)) for m in one]) for one in marks]
        )

    return stitched


#: Bytes of values after which a worker hands on what it has.
_HAND_ON = 4_000_000


def _pieces(codec: Codec):
    """Rows rid, doc_id, start, piece to rid, doc_id, start, ids (32-bit numbers as bytes), bytes: one piece in memory at a time."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = codec.encoding()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["rid", "doc_id", "start", "ids", "bytes"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for row in zip(*batch.columns, strict=True):
                ids = encoding.encode_ordinary(row[3].as_py() or "")
                raw = encoding.decode_bytes(ids)
                for column, value in zip(out, (*(v.as_py() for v in row[:3]), np.array(ids, "<i4").tobytes(), raw), strict=True):
                    column.append(value)
                size += 5 * len(raw)
                if size > _HAND_ON:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        trimmed()

    return pieces


def _joined(digests: bool):
    """Rows doc_id, parts to doc_id, n_tokens, ids, decoded: one document in memory at a time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), *((pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())))
        names = ["doc_id", "n_tokens", "ids", "decoded"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            size = 0
            for doc_id, parts in zip(*batch.columns, strict=True):
                parts = sorted(parts.as_py(), key=lambda p: p["start"])
                ids = np.concatenate([np.frombuffer(p["ids"], "<i4") for p in parts])
                if digests:
                    told, text = hashlib.sha256(), hashlib.sha256()
                    for k, p in enumerate(parts):
                        told.update((b" " if k else b"") + _ids_text(np.frombuffer(p["ids"], "<i4").tolist()))
                        text.update(p["bytes"])
                    row = (doc_id.as_py(), len(ids), told.hexdigest(), text.hexdigest())
                else:
                    row = (doc_id.as_py(), len(ids), ids, b"".join(p["bytes"] for p in parts))
                    size += 5 * len(row[3])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if size > _HAND_ON:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                    out, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
        trimmed()

    return joined


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))
    return (
        docs.select("rid", "doc_id", "base", "size", "text", F.explode(numbers).alias("k"))
        .select("rid", "doc_id", "base", "size", "k", F.substr("text", (F.col("k") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("chunk"))
        .repartition("rid", "k")
    )


def _cuts(docs: DataFrame, codec: Codec, chunk: int, overlap: int) -> DataFrame:
    """rid, size, cuts, open: where pieces start, and whether the last one is what no overlap cut."""
    marked = _chunks(docs, chunk, overlap).select("rid", "size", "k", _marks(codec.pattern, chunk, overlap)("chunk", "k").alias("m"))
    return (
        marked.groupBy("rid", "size")
        .agg(F.collect_list(F.struct("k", F.col("m.head").alias("head"), F.col("m.tail").alias("tail"))).alias("marks"))
        .select("rid", "size", F.size("marks").alias("chunks"), _stitched()("marks").alias("cuts"))
        .select("rid", "size", "cuts", (F.size("cuts") < F.col("chunks")).alias("open"))
    )


def _cut_pieces(docs: DataFrame, cuts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """rid, doc_id, start, piece; what is open is no piece yet. Starts count from the begin of the whole text."""
    ends = F.when(~F.col("open") | (F.col("i") + 1 < F.size("cuts")), F.coalesce(F.get("cuts", F.col("i") + 1), F.col("size")))
    spans = cuts.select("rid", "size", "open", "cuts", F.posexplode("cuts").alias("i", "start")).select("rid", "start", ends.alias("end")).filter("end IS NOT NULL")
    # A piece takes from each chunk that it meets what lies before the next chunk.
    parts = spans.select("rid", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))).alias("k"))
    got = parts.join(_chunks(docs, chunk, overlap), ["rid", "k"]).select(
        "rid",
        "doc_id",
        (F.col("base") + F.col("start")).alias("start"),
        "k",
        F.substr(
            "chunk",
            (F.greatest("start", F.col("k") * chunk) - F.col("k") * chunk + 1).cast("int"),
            (F.least("end", (F.col("k") + 1) * chunk) - F.greatest("start", F.col("k") * chunk)).cast("int"),
        ).alias("part"),
    )
    return got.groupBy("rid", "doc_id", "start").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda p: p["part"]), "").alias("piece")
    )


def _long(docs: DataFrame, codec: Codec, digests: bool, chunk: int, overlap: int, scratch: Scratch) -> DataFrame:
    """docs: rid, doc_id, text, size of texts that are longer than a chunk with its overlap."""
    rest, pieces, turn = docs.withColumn("base", F.lit(0).cast("long")), None, 0
    while True:
        cuts = scratch.table(f"cuts{turn}", _cuts(rest, codec, chunk, overlap))
        wider = (max(chunk, 4 * WIDER * overlap), WIDER * overlap)
        # What fits into one chunk of the next turn needs no turn of its own.
        left = F.col("open") & (F.col("size") - F.element_at("cuts", -1) > sum(wider))
        cuts = cuts.withColumn("open", left)
        cut = _cut_pieces(rest, cuts, chunk, overlap)
        pieces = cut if pieces is None else pieces.unionByName(cut)
        opened = cuts.filter("open").select("rid", F.element_at("cuts", -1).alias("at"))
        if opened.isEmpty():
            break
        moved = rest.join(opened, "rid").select(
            "rid",
            "doc_id",
            (F.col("base") + F.col("at")).alias("base"),
            F.substr("text", (F.col("at") + 1).cast("int")).alias("text"),
            (F.col("size") - F.col("at")).alias("size"),
        )
        turn += 1
        rest = scratch.table(f"rest{turn}", moved)
        chunk, overlap = wider
    kind = ("string", "string") if digests else ("array<int>", "binary")
    encoded = pieces.mapInArrow(_pieces(codec), "rid bigint, doc_id bigint, start bigint, ids binary, bytes binary")
    joined = encoded.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("start", "ids", "bytes")).alias("parts"))
    return joined.select("doc_id", "parts").mapInArrow(_joined(digests), f"doc_id bigint, n_tokens bigint, ids {kind[0]}, decoded {kind[1]}")


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, ids and decoded bytes of every whole text; with digests their SHA-256 in hex (ids as decimals
    joined by one space) in place of the values."""
    small_batches(docs.sparkSession)
    codec = Codec(docs.sparkSession, path, pattern)
    size = F.coalesce(F.length("text"), F.lit(0))
    kind = ("string", "string") if digests else ("array<int>", "binary")
    short = (
        docs.filter(size <= chunk + overlap)
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_short(codec, digests), f"doc_id bigint, n_tokens bigint, ids {kind[0]}, decoded {kind[1]}")
    )
    with Scratch(docs.sparkSession) as scratch:
        # Row numbers are written down, so that a task that runs again finds the same ones.
        long = scratch.table(
            "long",
            docs.filter(size > chunk + overlap).select(
                F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text", size.cast("long").alias("size")
            ),
        )
        return short.unionByName(settled(_long(long, codec, digests, chunk, overlap, scratch)))


def round_trips(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with what encoding and decoding gives: n_tokens, ids_sha256, decoded_sha256 for each row."""
    found = encode(docs, path, pattern, True, chunk, overlap)
    return found.select("doc_id", "n_tokens", F.col("ids").alias("ids_sha256"), F.col("decoded").alias("decoded_sha256"))
