"""Fingerprints of tables and files, computed where the data is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint) of a table, whatever the order of its rows and partitions."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws("|", F.sum(h).cast("string"), F.bit_xor(F.xxhash64(*sorted(df.columns))).cast("string")), 256).alias("fingerprint"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, read whole by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
