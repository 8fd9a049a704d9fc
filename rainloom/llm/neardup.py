"""Near-duplicate documents by a MinHash LSH forest, with links confirmed on full shingle sets.

1. Each whole text gives its set of five-word shingles, a digest of the set and a signature of TREES x DEPTH
   MinHash values. Texts with equal sets become one node.
2. Each tree orders the nodes by its DEPTH values (a range-partitioned sort). Nodes next to each other share
   their longest prefix. A region is all nodes that share MIN_DEPTH values. One over REGION nodes is first split at
   the next value, and so on, so the depth follows the density. What leaves the largest child of a split meets
   that child's representatives: those deepest on its path of largest children, most central first.
3. Nodes of one group are compared on their full sets, all at once, in memory. Only a spanning set of the
   confirmed links leaves the task, so rows grow with the nodes and not with their pairs.
4. Where a large region is not one component by these links, it is dealt into blocks and each block meets each
   other block, but for blocks of one and the same component. So all pairs of a region that matter are compared.
5. Connected components of the links give the groups.

No partner is capped within a region. A pair at the threshold shares MIN_DEPTH values in one of TREES trees with
probability 1 - (1 - 0.85^4)^12 > 0.9998 at the threshold of 0.85, and > 0.998 at 0.8.

Defined cases: null texts and texts without words have no shingles and no links; null ids form their own nodes
by text and lose against any other id; repeated rows share a node; ties take the smallest id; an empty table
gives an empty result; further columns are ignored, or carried by ``keep_representatives``. Any text length
works, hashed block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, id_text, semi_join, settled, small_batches, trimmed
from .components import components
from .shingles import mixed, shingle_sets

TREES, DEPTH, MIN_DEPTH = 12, 12, 4
#: Nodes compared at once; memory for a comparison is bounded by it.
REGION = 256
#: Representatives of a large region that what leaves it is compared with.
REPRESENTATIVES = 64


@lru_cache(maxsize=2)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_24)
    draw = lambda: rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64)
    return draw(), draw() | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n 16-bit MinHash values for each of the sets, none of them empty."""
    flip, factor = _permutations(n)
    all_ = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out[:, k] = np.minimum.reduceat((all_ ^ flip[k]) * factor[k], starts)
    return (mixed(out) & np.uint64(0xFFFF)).astype(">u2")


def digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, waiting, sizes, nodes, sigs = batch.column(0), [], [], [], []

        def flush() -> None:
            full = [s for s in waiting if len(s)]
            found = iter(signatures(full, TREES * DEPTH) if full else [])
            for s in waiting:
                sizes.append(len(s))
                nodes.append(digest(s) if len(s) else None)
                sigs.append(next(found).tobytes() if len(s) else None)
            waiting.clear()

        total = 0
        for shingles in shingle_sets(_as_bytes(batch.column(1))):
            waiting.append(shingles)
            total += len(shingles)
            if total > 50_000:
                flush()
                total = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary()), batch.column(2)],
            names=["doc_id", "n_shingles", "node", "sig", "text_key"],
        )
    trimmed()


def split_region(values: np.ndarray, emit: Callable[[np.ndarray], None], depth: int, region: int = REGION, representatives: int = REPRESENTATIVES) -> None:
    """Emits index groups of at most ``region`` of the rows of values, which are sorted and share ``depth`` columns."""

    def children(lo: int, hi: int, depth: int) -> np.ndarray:
        column = values[lo:hi, depth]
        return np.concatenate([[lo], lo + 1 + np.flatnonzero(column[1:] != column[:-1]), [hi]])

    work = [(0, len(values), depth)]
    while work:
        lo, hi, depth = work.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= region:
            emit(np.arange(lo, hi))
            continue
        if depth == values.shape[1]:
            lead, step = np.arange(lo, lo + representatives), region - representatives
            for at in range(lo + representatives, hi, step):
                emit(np.concatenate([lead, np.arange(at, min(at + step, hi))]))
            continue
        bounds = children(lo, hi, depth)
        sizes = np.diff(bounds)
        heavy = int(sizes.argmax())
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            work.append((int(a), int(b), depth + 1))
        # Down the largest children, to the rows in the middle of this region.
        a, b, d = int(bounds[heavy]), int(bounds[heavy + 1]), depth + 1
        while b - a > representatives and d < values.shape[1]:
            inner = children(a, b, d)
            k = int(np.diff(inner).argmax())
            a, b, d = int(inner[k]), int(inner[k + 1]), d + 1
        lead = np.arange(a, min(b, a + representatives))
        rest = np.concatenate([np.arange(lo, bounds[heavy]), np.arange(bounds[heavy + 1], hi)])
        for at in range(0, len(rest), region - representatives):
            emit(np.concatenate([lead, rest[at : at + region - representatives]]))


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows tree, key, node in order of tree and key, to regions: group (a digest of its nodes), nodes."""
    head: tuple = ()
    keys: list[bytes] = []
    nodes: list[bytes] = []
    groups: list[bytes] = []
    members: list[list[bytes]] = []

    def flush() -> None:
        if len(nodes) < 2:
            return

        def emit(rows: np.ndarray) -> None:
            chosen = sorted(nodes[i] for i in rows)
            groups.append(xxhash.xxh3_128_digest(b"".join(chosen)))
            members.append(chosen)

        split_region(np.frombuffer(b"".join(keys), ">u2").reshape(len(keys), DEPTH), emit, MIN_DEPTH)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(groups, pa.binary()), pa.array(members, pa.list_(pa.binary()))], names=["group", "nodes"])

    for rows in batches:
        for tree, key, node in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
            now = (tree, key[: 2 * MIN_DEPTH])
            if now != head:
                flush()
                head, keys, nodes = now, [], []
            keys.append(key)
            nodes.append(node)
        if len(groups) > 5_000:
            yield batch()
            groups, members = [], []
    flush()
    yield batch()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the shingles that two sets at least hold."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros((n, n), np.float32)
    width = 8_192
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for block, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        one = np.zeros((n, width), np.float32)
        one[owner[a:b], column[a:b] - block * width] = 1
        out += one @ one.T
    return out.astype(np.int64)


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that connect what links of at least ``percent`` similarity connect; one for each set but the first of a component."""
    both, size = overlaps(sets), np.array([len(s) for s in sets], np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        low = np.where(linked, label[None, :], len(sets)).min(axis=1)
        low = low[low]
        if (low == label).all():
            return [(int(i), int(r)) for i, r in enumerate(label) if i != r]
        label = low


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(shingle_sets(_as_bytes(batch.column(0))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "shingles"]
        )


def _links(percent: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: bytes | None = None
        held: dict[bytes, np.ndarray] = {}

        def compared() -> tuple[list[bytes], list[bytes]]:
            names = list(held)
            found = spanning_links(list(held.values()), percent) if len(names) > 1 else []
            return [names[i] for i, _ in found], [names[j] for _, j in found]

        for batch in batches:
            a: list[bytes] = []
            b: list[bytes] = []
            for g, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if g != group:
                    x, y = compared()
                    a += x
                    b += y
                    group, held = g, {}
                held[node] = np.frombuffer(shingles.as_py(), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a, b = compared()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return links


def _block_pairs(dense: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(group, node): a group for each two blocks of a region (prefix) that are not of one component."""
    placed = scratch.table("placed", dense.join(roots, "node", "left").select("prefix", "node", F.coalesce("root", "node").alias("root")))
    parts = scratch.table("parts", placed.groupBy("prefix", "root").agg(F.count(F.lit(1)).alias("n_root")))
    still = parts.groupBy("prefix").agg(F.count(F.lit(1)).alias("n_roots"), F.sum("n_root").alias("n")).filter("n_roots > 1").select("prefix", "n")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.greatest(F.ceil(F.col(n) / REGION), F.lit(1))).cast("string")
    one = F.col("n_root") >= REGION
    held = placed.join(still, "prefix").join(parts, ["prefix", "root"]).select(
        "prefix",
        "node",
        F.when(one, F.col("root")).alias("root"),
        F.when(one, F.concat_ws(":", F.hex("root"), part("node", "n_root"))).otherwise(part("root", "n")).alias("block"),
    )
    held = scratch.table("blocks", held)
    blocks = held.select("prefix", "block", "root").distinct()
    a, b = (blocks.select("prefix", F.col("block").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    met = a.join(b, "prefix").filter("a <= b AND (root_a IS NULL OR root_b IS NULL OR root_a <> root_b)")
    met = scratch.table("met", met.select("prefix", "a", "b", F.unhex(F.sha2(F.concat_ws("|", "prefix", "a", "b").cast("binary"), 256)).alias("group")))
    sides = met.select("prefix", "group", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    return scratch.table("block-pairs", sides.join(held, ["prefix", "block"]).select("group", "node"))


def _text_key() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)


def groups(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    return _grouped(docs, percent).drop("text_key")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    small_batches(docs.sparkSession)
    with Scratch(docs.sparkSession) as scratch:
        described = scratch.table(
            "described",
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _text_key().alias("text_key")).mapInArrow(
                _described, "doc_id bigint, n_shingles bigint, node binary, sig binary, text_key string"
            ),
        )
        nodes = scratch.table(
            "nodes",
            described.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("low"), F.first("sig").alias("sig")),
        )
        trees = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "sig").select(
            "node", "tree", F.substring("sig", F.col("tree") * (2 * DEPTH) + 1, F.lit(2 * DEPTH)).alias("key")
        )
        trees = trees.withColumn("prefix", F.concat(F.hex("tree"), F.lit(":"), F.hex(F.substring("key", 1, 2 * MIN_DEPTH))))
        large = scratch.table("large", trees.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REGION).select("prefix"))
        dense = scratch.table("dense", semi_join(trees, large, "prefix"))
        small = (
            semi_join(trees, large, "prefix", "left_anti")
            .groupBy("prefix")
            .agg(F.array_sort(F.collect_list("node")).alias("nodes"))
            .filter(F.size("nodes") > 1)
            .select(F.unhex(F.sha2(F.array_join(F.transform("nodes", F.hex), "").cast("binary"), 256)).alias("group"), "nodes")
        )
        same = dense.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        central = scratch.table("central", dense.join(same, ["tree", "key"]).groupBy("node").agg(F.sum("n").alias("central")))
        ordered = (
            dense.join(central, "node", "left")
            .select("tree", "key", F.coalesce("central", F.lit(0)).alias("central"), "node")
            .repartitionByRange("tree", "key", F.desc("central"), "node")
            .sortWithinPartitions("tree", "key", F.desc("central"), "node")
        )
        split = ordered.select("tree", "key", "node").mapInArrow(_regions, "group binary, nodes array<binary>")
        found = scratch.table("regions", small.unionByName(split).dropDuplicates(["group"]))

        def linked(name: str, members: DataFrame) -> DataFrame:
            """Links among the members (group, node) of each group, of their full sets."""
            wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(id_text("low").alias("key")).distinct()
            wanted = scratch.table(f"wanted-{name}", wanted)
            texts = semi_join(docs.select(id_text().alias("key"), F.col("text").cast("string").alias("text")), wanted, "key")
            sets = texts.select("text").mapInArrow(_sets, "node binary, shingles binary")
            compared = members.join(sets, "node").select("group", "node", "shingles").repartition("group").sortWithinPartitions("group")
            return scratch.table(f"links-{name}", compared.mapInArrow(_links(percent), "a binary, b binary"))

        links = linked("near", found.select("group", F.explode("nodes").alias("node")))
        if not large.isEmpty():
            first = components(links, scratch, "first")
            pairs = _block_pairs(dense.select("prefix", "node"), first, scratch)
            if not pairs.isEmpty():
                links = links.unionByName(linked("blocks", pairs))
        roots = components(links, scratch)
        # One row for each node that has a link, with the smallest id of its component.
        placed = roots.join(nodes.select("node", "low"), "node")
        lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
        of_node = scratch.table("of_node", placed.join(lowest, "root").select("node", "component_id"))
        own = nodes.select("node", "low").join(of_node, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"))
        return settled(
            described.select("doc_id", "n_shingles", "node", "text_key")
            .join(own, "node", "left")
            .select(
                "doc_id",
                "n_shingles",
                F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                "text_key",
            )
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        )


def keep_representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without the rows whose group has a smaller doc_id; columns as in docs. Rows are told apart by doc_id and text."""
    key = F.concat_ws(":", id_text(), "text_key")
    lost_key = fresh("lost_key", docs.columns)
    lost = _grouped(docs, percent).filter(~F.col("kept")).select(key.alias(lost_key)).distinct()
    marked = docs.withColumn(lost_key, F.concat_ws(":", id_text(), _text_key()))
    return semi_join(marked, lost, lost_key, "left_anti").drop(lost_key)
