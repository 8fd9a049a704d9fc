"""Streaming extension of our own: daily station values, sessions and wet runs over an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the event files in a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(station_id, date, n, total) by tumbling day; events later than ``late`` are left out."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), F.col("user_id").cast("string").alias("station_id"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("station_id", F.to_date("window.start").alias("date"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col("user_id").cast("string").alias("station_id"))
    return rows.agg(F.count(F.lit(1)).alias("n")).select("station_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def runs(events: DataFrame, threshold: float) -> DataFrame:
    """(station_id, event_id, run): how many values in a row, up to this one, exceed the threshold; state is one number a station."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            run = run + 1 if r.value > threshold else 0
            out.append((key[0], r.event_id, run))
        state.update((run,))
        yield pd.DataFrame(out, columns=["station_id", "event_id", "run"])

    keyed = events.withColumn("station_id", F.col("user_id").cast("string"))
    return keyed.groupBy("station_id").applyInPandasWithState(step, "station_id string, event_id long, run long", "run long", "append", GroupStateTimeout.NoTimeout)
