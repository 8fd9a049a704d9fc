"""Tables of a data set by name, read when they are first asked for."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from .readers import problems, read_tabular


class Store:
    """The tables under a folder: ``name.parquet``, else ``name.csv``. Each is read once and kept until ``reload``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._held: dict[str, DataFrame] = {}

    def _path(self, name: str) -> str:
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind in ("parquet", "csv"):
            path = f"{self.root}/{name}.{kind}"
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            if where.getFileSystem(hadoop).exists(where):
                return path
        raise FileNotFoundError(f"no table {name} under {self.root}")

    def table(self, name: str) -> DataFrame:
        if name not in self._held:
            self._held[name] = read_tabular(self.spark, self._path(name)).persist(StorageLevel.MEMORY_AND_DISK)
        return self._held[name]

    def reload(self) -> None:
        """Lets all tables go; the next call reads what is there then."""
        for df in self._held.values():
            df.unpersist()
        self._held.clear()


def preview(spark: SparkSession, path: str, rows: int = 5) -> tuple[list[str], list[dict]]:
    """(what keeps an uploaded table from being observations, its first rows by station and date); nothing is merged."""
    df = read_tabular(spark, path)
    wrong = problems(df)
    shown = df.orderBy("station_id", "date") if not wrong else df
    return wrong, [r.asDict() for r in shown.limit(rows).collect()]
