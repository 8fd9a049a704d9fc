"""Exact deduplication with a heavy-hitter split.

Keys are the SHA-256 digests of the whole texts. A Misra-Gries summary (the frequent-items sketch behind
``approx_top_k``, built per bucket of input partitions and merged) names the digests that may be frequent. One
exact count over those candidates verifies them. The verified ones, at most ``top_k`` rows, are broadcast, so
their copies are resolved on the map side and never meet in one task. All other digests go through an ordinary
shuffle; the summary's error bound keeps each of their groups under ``share`` of the rows.

Only DataFrame and SQL functions run. Defined cases: null text counts as empty, empty texts are equal to each
other, rows repeated with one doc_id are all copies (those that carry the kept doc_id stay), a null doc_id loses
against any other, an empty table gives an empty result, further columns of the input are ignored by
``duplicate_groups`` and carried by ``drop_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, fresh, id_text, semi_join, settled

#: Counters in a summary. It misses no digest that makes up over about 4 / COUNTERS of the rows.
COUNTERS = 10_000
#: A digest is frequent from this share of all rows on; there are at most 1 / SHARE such digests.
SHARE = 0.001
#: Partial summaries merged in the first step, so that the last merge reads a fixed number of them.
BUCKETS = 64


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"))


def frequent_digests(keys: DataFrame, total: int, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """(text_sha256, keep_id, group_size) of the verified frequent digests: 1 / share rows at most."""
    top_k = int(1 / share)
    keys = keys.withColumn("short", F.xxhash64("text_sha256"))
    partial = keys.groupBy((F.spark_partition_id() % BUCKETS).alias("bucket")).agg(
        F.expr(f"approx_top_k_accumulate(short, {counters})").alias("state")
    )
    # Grouped, not global: a partition without a bucket then has no empty state to merge.
    named = partial.groupBy(F.col("bucket") * 0).agg(F.expr(f"approx_top_k_combine(state, {counters})").alias("state")).select(
        F.explode(F.expr(f"approx_top_k_estimate(state, {top_k})")).alias("found")
    )
    named = named.filter(F.col("found.count") >= max(2, share * total / 2)).select(F.col("found.item").alias("short"))
    return (
        keys.join(F.broadcast(named), "short", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= max(2, share * total))
    )


def duplicate_groups(docs: DataFrame, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        keys = scratch.table("keys", keyed(docs))
        heavy = scratch.table("heavy", frequent_digests(keys, keys.count(), share, counters))
        resolved = keys.join(F.broadcast(heavy), "text_sha256", "inner")
        group = Window.partitionBy("text_sha256")
        rest = (
            keys.join(F.broadcast(heavy.select("text_sha256")), "text_sha256", "left_anti")
            .withColumn("keep_id", F.max("doc_id").over(group))
            .withColumn("group_size", F.count(F.lit(1)).over(group))
        )
        return settled(
            resolved.unionByName(rest).select(
                "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
            )
        )


def drop_duplicates(docs: DataFrame, share: float = SHARE, counters: int = COUNTERS) -> DataFrame:
    """docs without the copies: of equal texts the rows with the largest doc_id stay; columns as in docs."""
    key = F.concat_ws(":", id_text(), "text_sha256")
    lost_key = fresh("lost_key", docs.columns)
    lost = duplicate_groups(docs, share, counters).filter(~F.col("kept")).select(key.alias(lost_key)).distinct()
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn(lost_key, F.concat_ws(":", id_text(), digest))
    return semi_join(marked, lost, lost_key, "left_anti").drop(lost_key)
