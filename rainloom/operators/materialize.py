"""Results that several later steps read, computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def once(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster names for checkpoints, which outlives executors; cached where it names none."""
    context = df.sparkSession.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint() if folder else df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names for checkpoints; one of this machine's only for a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rainloom-')}"
    return f"{folder}/rainloom-{uuid.uuid4().hex}"
