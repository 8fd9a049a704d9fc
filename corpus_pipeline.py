"""The corpus pipeline: language ID, exact dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage is a function of (spark, docs, sf_dir). ``run`` applies them to documents; what a stage returns is written
as Parquet in the shared folder and read again as the next one's docs, so a lost executor costs one stage at most.
All stages but the last return the columns of documents; each decides on what its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rainloom.llm import bpe, decontaminate, exactdup, langid, neardup
from rainloom.llm.common import Scratch, read, settled
from rainloom.llm.queries import RANKS

#: SQL has no language model, MinHash or BPE; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go."""
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return exactdup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 0.8 or more on five-word shingles) the smallest doc_id stays."""
    return neardup.keep_representatives(docs, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit distance go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.round_trips(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("benchmark_decontamination", decontaminated),
    ("byte_bpe", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        before = ""
        for name, stage in STAGES[:-1]:
            docs = scratch.table(name, stage(spark, docs, sf_dir))
            if before:
                scratch.drop(before)
            before = name
        return settled(STAGES[-1][1](spark, docs, sf_dir))
