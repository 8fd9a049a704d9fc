"""Station-day views over the relational tables, as DataFrames and as the SQL that the oracle runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry

REFERENCE = ("1995-01-02", "1999-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _daily(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    places = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    if grain == "region":
        regions = table(spark, sf_dir, "region")
        places = places.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("station_id"))
    else:
        places = places.select("n_nationkey", F.col("n_name").alias("station_id"))
    # Nations are 25 rows at every scale.
    named = suppliers.join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "station_id")
    joined = lines.join(named, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy("station_id", F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").cast("double").alias("precip"), (F.max("l_extendedprice") / 1000).cast("double").alias("tmax"), (F.min("l_extendedprice") / 1000).cast("double").alias("tmin")
    )


def station_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 sparse stations."""
    return _daily(spark, sf_dir, "nation")


def region_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 dense stations."""
    return _daily(spark, sf_dir, "region")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.select(
        F.col("n_name").alias("station_id"),
        (26.3 + (k * 37 % 42) / 10.0).alias("lat"),
        (80.0 + (k * 53 % 83) / 10.0).alias("lon"),
        (k * 911 % 4500).cast("double").alias("elevation_m"),
        F.col("r_name").alias("basin"),
    )


_DAILY = """{name} AS (SELECT {place} AS station_id, CAST(l_shipdate AS DATE) AS date, CAST(SUM(l_quantity) AS DOUBLE) AS precip,
  CAST(MAX(l_extendedprice) / 1000 AS DOUBLE) AS tmax, CAST(MIN(l_extendedprice) / 1000 AS DOUBLE) AS tmin
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey {more} GROUP BY 1, 2)"""
SD = _DAILY.format(name="sd", place="n_name", more="")
RD = _DAILY.format(name="rd", place="r_name", more="JOIN region ON n_regionkey = r_regionkey")
ST = """st AS (SELECT n_name AS station_id, 26.3 + (n_nationkey * 37 % 42) / 10.0 AS lat, 80.0 + (n_nationkey * 53 % 83) / 10.0 AS lon,
  CAST(n_nationkey * 911 % 4500 AS DOUBLE) AS elevation_m, r_name AS basin FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def regular(source: str, name: str) -> str:
    """SQL of a view with every day of each station of another."""
    return f"""{name} AS (SELECT c.station_id, c.date, s.precip, s.tmax, s.tmin FROM (SELECT station_id,
  CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM {source} GROUP BY station_id) c
  LEFT JOIN {source} s ON s.station_id = c.station_id AND s.date = c.date)"""


SR, RR = regular("sd", "sr"), regular("rd", "rr")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines agree on them."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query under its name, with the SQL of its result."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        registry.QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if sql:
            registry.ORACLE_SQL[name] = sql
        return f

    return register
