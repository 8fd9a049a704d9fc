"""Sinks: versioned data sets, rasters, reports, relational tables, wide exports."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import fingerprint


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_dataset(root: str, tables: Mapping[str, DataFrame], core: str = "observations", metadata: Mapping | None = None, force: bool = False) -> str:
    """Writes tables under root/<version>/ and points root/LATEST at it; the version is the core table's fingerprint."""
    spark = tables[core].sparkSession
    version = fingerprint(tables[core]).first()["fingerprint"][:12]
    for name, df in tables.items():
        df.write.mode("overwrite" if force else "error").parquet(f"{root}/{version}/{name}.parquet")
    _write_text(spark, f"{root}/{version}/metadata.json", json.dumps({"version": version, **(metadata or {})}))
    _write_text(spark, f"{root}/LATEST", version)
    return version


def latest(spark: SparkSession, root: str) -> str:
    return f"{root}/{spark.read.text(f'{root}/LATEST', wholetext=True).first()[0]}"


def write_raster(cells: DataFrame, grid: tuple[float, float, float, float], path: str, crs: str = "EPSG:4326") -> None:
    cells.write.mode("overwrite").parquet(f"{path}/cells.parquet")
    _write_text(cells.sparkSession, f"{path}/grid.json", json.dumps({"crs": crs, "grid": list(grid)}))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file, NaN as empty."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*clean).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One column of JSON objects, NaN and infinities as null."""
    clean = [F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def wide(df: DataFrame, variable: str, stations: list[str]) -> DataFrame:
    """date by station."""
    return df.groupBy("date").pivot("station_id", stations).agg(F.first(variable))


def with_events_json(df: DataFrame, events: list[str], name: str = "events") -> DataFrame:
    """The label columns as one JSON object of integers and nulls."""
    packed = F.to_json(F.struct(*(F.col(e).cast("int").alias(e) for e in events)), {"ignoreNullFields": "false"})
    return df.withColumn(name, packed).drop(*events)


def insert_absent(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """existing with those rows whose key is not in it."""
    return existing.unionByName(rows.join(existing.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def constraint_violations(df: DataFrame, keys: list[str], parent: DataFrame | None = None, foreign: str | None = None, allowed: Mapping[str, list] | None = None) -> DataFrame:
    """(rule, n) of broken keys, references and checks."""
    out = df.groupBy(*keys).count().filter("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("primary key").alias("rule"), "n")
    if parent is not None and foreign:
        lost = df.filter(F.col(foreign).isNotNull()).join(parent.select(foreign), foreign, "left_anti")
        out = out.unionByName(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"foreign key {foreign}").alias("rule"), "n"))
    for column, values in (allowed or {}).items():
        bad = df.filter(~F.col(column).isin(values)).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(bad.select(F.lit(f"check {column}").alias("rule"), "n"))
    return out.filter("n > 0")


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 20_000) -> None:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode(mode).save()


def release_slice(observations: DataFrame, since: str, path: str) -> DataFrame:
    """Writes the observations since a date for a release, by year, and gives back what was written."""
    chosen = observations.filter(F.col("date") >= F.lit(since).cast("date")).withColumn("year", F.year("date"))
    # By ranges, so that a year of all stations is as many tasks and files as it needs.
    chosen.repartitionByRange("year", "station_id", "date").sortWithinPartitions("year", "station_id", "date").write.mode("overwrite").partitionBy("year").parquet(path)
    return observations.sparkSession.read.parquet(path).select(*observations.columns)


def ddl(df: DataFrame, table: str, keys: list[str], references: Mapping[str, str] | None = None, allowed: Mapping[str, list] | None = None) -> str:
    """CREATE TABLE with primary and foreign keys and checks, for a database that holds the table."""
    kinds = {"string": "TEXT", "double": "DOUBLE PRECISION", "float": "REAL", "long": "BIGINT", "integer": "INTEGER", "date": "DATE", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
    lines = []
    for f in df.schema.fields:
        line = f"  {f.name} {kinds.get(f.dataType.typeName(), 'TEXT')}{' NOT NULL' if f.name in keys else ''}"
        if f.name in (references or {}):
            line += f" REFERENCES {references[f.name]}"
        if f.name in (allowed or {}):
            line += f" CHECK ({f.name} IN ({', '.join(repr(v) for v in allowed[f.name])}))"
        lines.append(line)
    return f"CREATE TABLE {table} (\n" + ",\n".join([*lines, f"  PRIMARY KEY ({', '.join(keys)})"]) + "\n)"
