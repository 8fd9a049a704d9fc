"""WARC archives with a two-level capture index.

Writing: every page becomes a gzip member of its own in a ``.warc.gz`` file of the task that writes it; the rows
that a task returns name file, offset and length. Those rows are stored before anything reads the files, so a
task that runs again leaves at most an unreferenced file. Of pages with equal payloads of at least MIN_REVISIT
bytes the one with the largest page_id is the response, the others are revisits of it; the winners of all
payloads come from a pre-aggregated group-by and are broadcast while they are few (BROADCAST_ROWS); a file begins with a
warcinfo record, and a revisit names the record id of its response.

Index: captures are sorted by reversed-host URL key and page_id over all tasks, cut into blocks of BLOCK_LINES
lines, and each block is compressed. The directory holds one row per block: first key, file, offset, length.

Lookup: the sorted keys to look up meet the directory (broadcast in slices of at most DIRECTORY_ROWS rows), a
binary search names the block, a range read fetches it, a second binary search in the block names the captures,
and range reads fetch their records.

Files are opened through pyarrow's file systems, in the folder that all executors share.

Defined cases: null html is an empty payload, a null url has an empty key, null page_ids never win and keep a null
refers_to unless a winner exists; of repeated rows with the winning page_id all are responses; an empty table
gives no files and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, settled, small_batches

MIN_REVISIT = 1_000
BLOCK_LINES = 512
FILE_BYTES = 1 << 30
#: Directory rows that are broadcast at once.
DIRECTORY_ROWS = 200_000
#: Bytes of records that a task reads back.
READ_BYTES = 32 << 20
_KIND = "page_id bigint, key string, file string, offset bigint, length bigint"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, as in ``com,example,www)/path?query``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").strip(".")
    except ValueError:
        return quote(url, safe="/:?=&%,;+@()!*'~#[]")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + quote(path, safe="/:?=&%,;+@()!*'~[]")


def capture_key(url: str | None, page_id: int | None) -> str:
    """Index key: URL key, a blank (keys hold none), and the page_id in an order-preserving form."""
    return f"{url_key(url)} {'-' if page_id is None else format(int(page_id) + 2**63, '020d')}"


def _identity(page_id: int | None, digest: str) -> str:
    """The record id of a page with a payload: a function of both, so that a revisit can name the response that it revisits."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _assembled(head: list[str], body: bytes) -> bytes:
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    """The record that a file begins with."""
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _assembled(head, b"software: rainloom\r\nformat: WARC File Format 1.1\r\n")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    own = _identity(page_id, digest) if not revisit else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'revisit:{page_id}:{digest}')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?=&%,;+@()!*~#[]')}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_identity(refers_to, digest)}", f"Page-Refers-To: {refers_to}"]
    return _assembled(head, http if revisit else http + payload)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC headers, HTTP head, payload) of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def _zipped(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """Files of one folder: appending one after another, and reading ranges."""

    def __init__(self, root: str):
        self.system, self.root = pa.fs.FileSystem.from_uri(root)
        self.open: dict[str, pa.NativeFile] = {}

    def create(self, name: str) -> pa.NativeFile:
        self.system.create_dir(self.root, recursive=True)
        return self.system.open_output_stream(f"{self.root}/{name}", compression=None)

    def range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.system.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)

    def close(self) -> None:
        for file in self.open.values():
            file.close()


def _writer(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, file, name, at = _Files(root), None, "", 0
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                if file is None or at > FILE_BYTES:
                    if file is not None:
                        file.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    file = files.create(name)
                    first = _zipped(_info(name, date))
                    file.write(first)
                    at = len(first)
                member = _zipped(_record(page_id, url, (html.as_py() or "").encode("utf-8", "replace"), refers_to, date))
                file.write(member)
                for column, value in zip(out, (page_id, capture_key(url, page_id), name, at, len(member)), strict=True):
                    column.append(value)
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                names=["page_id", "key", "file", "offset", "length"],
            )
        if file is not None:
            file.close()

    return write


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html and refers_to: the response's page_id for pages that revisit it."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    large = F.octet_length("html") >= min_bytes
    keyed = rows.withColumn("digest", F.when(large, F.sha1(F.col("html").cast("binary"))))
    winners = (
        keyed.filter("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND winner IS NOT NULL")
        .select("digest", "winner")
    )
    few = winners.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(winners) if few else winners.hint("merge"), "digest", "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))


def write_archive(pages: DataFrame, root: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes pages to WARC files under root when it is evaluated (store the result): the captures, one row per record."""
    return with_revisits(pages, min_bytes).select("page_id", "url", "html", "refers_to").mapInArrow(_writer(root), _KIND)


def _index_writer(root: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, file, name, at = _Files(root), None, f"{uuid.uuid4().hex}.cdx.gz", 0
        lines: list[str] = []
        out: list[list] = [[], [], [], []]

        def flush() -> None:
            nonlocal file, at, lines
            if not lines:
                return
            if file is None:
                file = files.create(name)
            block = _zipped("".join(lines).encode())
            file.write(block)
            first = lines[0].split("\t", 1)[0]
            for column, value in zip(out, (first, name, at, len(block)), strict=True):
                column.append(value)
            at += len(block)
            lines = []

        for batch in batches:
            for key, where, offset, length in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lines.append(f"{key}\t{where}\t{offset}\t{length}\n")
                if len(lines) >= block_lines:
                    flush()
        flush()
        if file is not None:
            file.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["first_key", "file", "offset", "length"]
        )

    return write


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes the sorted, blocked index under root when it is evaluated (store the result): the directory."""
    ordered = captures.select("key", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return ordered.mapInArrow(_index_writer(root, block_lines), "first_key string, file string, offset bigint, length bigint")


def _reader(held, index_root: str, warc_root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, blocks = held.value
        index, warc = _Files(index_root), _Files(warc_root)
        loaded, keys, lines = -1, [], []

        def load(k: int) -> None:
            nonlocal loaded, keys, lines
            if k != loaded:
                text = zlib.decompress(index.range(*blocks[k]), 31).decode()
                lines = [line.split("\t") for line in text.splitlines()]
                keys, loaded = [line[0] for line in lines], k

        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for key in batch.column(0).to_pylist():
                # A key's captures may start in the block before the first one that begins with it.
                k = max(0, bisect.bisect_left(firsts, key) - 1)
                while k < len(firsts) and firsts[k] <= key:
                    load(k)
                    for line in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                        fields, http, payload = parse_record(zlib.decompress(warc.range(line[1], int(line[2]), int(line[3])), 31))
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"damaged record in {line[1]} at {line[2]}")
                        size = int(http.decode().rsplit("Content-Length: ", 1)[1])
                        page = int(fields["Page-Id"]) if "Page-Id" in fields else None
                        refers_to = int(fields["Page-Refers-To"]) if revisit else None
                        row = (page, size, digest, fields["WARC-Type"], refers_to, None if revisit else payload)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                    k += 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, kinds, strict=True)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
            )
        index.close()
        warc.close()

    return read


def keys_of(pages: DataFrame) -> DataFrame:
    """The distinct capture keys (column key) of rows with url and page_id."""

    @F.pandas_udf("string")
    def key(url: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u, None if p == "" else int(p)) for u, p in zip(url, page_id, strict=True)], dtype=object)

    return pages.select(key(F.col("url").cast("string"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("key")).distinct()


def lookup(keys: DataFrame, directory: DataFrame, index_root: str, warc_root: str, slice_rows: int = DIRECTORY_ROWS, partitions: int | None = None) -> DataFrame:
    """The captures of the keys: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).
    ``partitions``: tasks that read; keys are small, so their size says nothing of what is read for them."""
    spark = keys.sparkSession
    ordered = keys.repartitionByRange(partitions or spark.sparkContext.defaultParallelism, "key").sortWithinPartitions("key")
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    out, held, begin = None, [], None

    def searched(slice_: list, after: str | None) -> DataFrame:
        chosen = ordered
        if begin is not None:
            chosen = chosen.filter(F.col("key") >= begin)
        if after is not None:
            chosen = chosen.filter(F.col("key") < after)
        shared = spark.sparkContext.broadcast(([r[0] for r in slice_], [tuple(r[1:]) for r in slice_]))
        return chosen.mapInArrow(_reader(shared, index_root, warc_root), schema)

    for row in directory.orderBy("first_key", "file", "offset").toLocalIterator():
        # Blocks that begin with one key stay in one slice.
        if len(held) >= slice_rows and row["first_key"] != held[-1][0]:
            found = searched(held, row["first_key"])
            out = found if out is None else out.unionByName(found)
            # The next slice has the last block too: captures of its first key may begin there.
            held, begin = [held[-1]], row["first_key"]
        held.append(tuple(row))
    found = searched(held, None)
    return found if out is None else out.unionByName(found)


def archived(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes pages to an archive, reads all of them back through its index: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    small_batches(pages.sparkSession)
    with Scratch(pages.sparkSession) as scratch:
        warc_root, index_root = scratch.path("warc"), scratch.path("index")
        captures = scratch.table("captures", write_archive(pages, warc_root, min_bytes))
        directory = scratch.table("directory", write_index(captures, index_root))
        size = captures.agg(F.sum("length")).first()[0] or 0
        tasks = max(pages.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)
        return settled(lookup(keys_of(pages), directory, index_root, warc_root, partitions=tasks).drop("payload"))
