"""What the operators share: reading tables, shared scratch space, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is named and all executors are on this machine."""
    context = spark.sparkContext
    # What is no longer used is dropped from it, where the user has not decided otherwise.
    if context.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints", None) is None:
        context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    found = context.getConf().get("spark.checkpoint.dir", None)
    if found:
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(found)
        return found
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="rainloom-")
    context.setCheckpointDir(own)
    return own


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of at most ``rows`` rows: with long texts the default of 10,000 makes them hundreds of MB in the JVM and
    in each Python worker at once. Sends the package to the workers too."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def trimmed() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; Spark's cleaner drops it with its last use."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Named Parquet tables in the shared folder that end with the block that made them.

    Each table cuts lineage: a lost executor costs the work since the last table, never the whole job.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rainloom-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str, df: DataFrame, codec: str | None = None) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name), compression=codec)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm, context = self.spark._jvm, self.spark.sparkContext
        if jvm is None or context._jsc is None:
            return
        where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self.drop()
        except Exception as ended:  # the session may be gone at exit; nothing is left to clean then
            if self.spark.sparkContext._jsc is not None:
                raise ended


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, made longer until it is none of the taken column names (case does not tell names apart)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def id_text(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(id_text(column).cast("binary")) % modulus


#: Rows of ids that may be broadcast: keys of 40 to 85 characters, a hash relation of at most some 50 MB.
BROADCAST_ROWS = 250_000


def semi_join(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Semi or anti join that broadcasts ids only when they were counted to be few; else both sides shuffle."""
    few = ids.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)
