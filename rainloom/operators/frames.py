"""Windows and sequences over daily station series. Columns station_id and date; one row per day where noted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .materialize import once

STATION = "station_id"

def by_date():
    return Window.partitionBy(STATION).orderBy("date")


def trailing(rows: int):
    return by_date().rowsBetween(-(rows - 1), 0)


def rolling(x: Column, rows: int, least: int, how: Callable[[Column], Column] = F.sum) -> Column:
    """Aggregate of the last rows where at least ``least`` of them have a value."""
    frame = trailing(rows)
    return F.when(F.count(x).over(frame) >= least, how(x).over(frame))


def regularise(obs: DataFrame) -> DataFrame:
    """Every day from a station's first to its last; days without a row have nulls. A job on it fails where a key repeats."""
    counted = obs.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(STATION, "date")))
    days = obs.groupBy(STATION).agg(F.min("date").alias("low"), F.max("date").alias("high"))
    days = days.select(STATION, F.explode(F.sequence("low", "high")).alias("date"))
    # The check rides on the partitioning that the join needs anyway.
    once_a_day = F.when(F.col("_rows") > 1, F.raise_error(F.lit("duplicate (station_id, date)")).cast("boolean")).otherwise(True)
    return days.join(counted, [STATION, "date"], "left").filter(once_a_day).drop("_rows")


def densify(obs: DataFrame, stations: DataFrame) -> DataFrame:
    """Every station on every day from the first to the last of the table."""
    span = obs.agg(F.min("date").alias("low"), F.max("date").alias("high"))
    days = span.select(F.explode(F.sequence("low", "high")).alias("date"))
    # One row per calendar day: a few ten thousand rows for a century.
    return stations.select(STATION).crossJoin(F.broadcast(days)).join(obs, [STATION, "date"], "left")


def run_length(df: DataFrame, mask: Column, valid: Column, name: str, keys: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Length so far of the run of true days; a false day is 0, an invalid day is null and ends the run."""
    by = Window.partitionBy(*keys).orderBy("date")
    on = F.coalesce(mask, F.lit(False)) & valid
    marked = df.withColumn("_on", on.cast("int")).withColumn("_valid", valid)
    marked = marked.withColumn("_island", F.sum(1 - F.col("_on")).over(by))
    length = F.sum("_on").over(Window.partitionBy(*keys, "_island").orderBy("date"))
    return marked.withColumn(name, F.when(F.col("_valid"), length)).drop("_on", "_island", "_valid")


def islands(df: DataFrame, mask: Column, keys: tuple[str, ...] = (STATION,)) -> DataFrame:
    """Maximal runs of true days: keys, start, end, length_days."""
    by = Window.partitionBy(*keys).orderBy("date")
    marked = df.withColumn("_on", F.coalesce(mask, F.lit(False)))
    marked = marked.withColumn("_island", F.sum((~F.col("_on")).cast("int")).over(by)).filter("_on")
    runs = marked.groupBy(*keys, "_island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("length_days"))
    return runs.drop("_island")


def enclosing_run(df: DataFrame, mask: Column, name: str) -> DataFrame:
    """Length of the whole run that a true day is in, 0 elsewhere."""
    marked = df.withColumn("_on", F.coalesce(mask, F.lit(False)).cast("int"))
    marked = marked.withColumn("_island", F.sum(1 - F.col("_on")).over(by_date()))
    return marked.withColumn(name, F.when(F.col("_on") == 1, F.sum("_on").over(Window.partitionBy(STATION, "_island"))).otherwise(0)).drop("_on", "_island")


def find_gaps(obs: DataFrame, variable: str, least: int = 1) -> DataFrame:
    found = islands(obs, F.col(variable).isNull()).filter(F.col("length_days") >= least)
    return found.select(STATION, F.lit(variable).alias("variable"), "start", "end", "length_days")


def target(event: Column, lead: int, horizon: int) -> Column:
    """Whether the event happens in the ``horizon`` days from ``lead`` days ahead; null if all of them are unknown."""
    return F.max(event).over(by_date().rowsBetween(lead, lead + horizon - 1))


def circular_percentile(df: DataFrame, x: str, reference: Column, q: float, half: int = 7, more_than: int = 20) -> DataFrame:
    """(station_id, doy, threshold): percentile of reference values within ``half`` days of a day of year on a 366-day circle."""
    used = df.filter(reference & F.col(x).isNotNull()).select(STATION, F.dayofyear("date").alias("d"), x)
    spread = used.select(STATION, x, F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("o"), "d")
    spread = spread.select(STATION, x, (F.pmod(F.col("d") - 1 + F.col("o"), F.lit(366)) + 1).alias("doy"))
    return spread.groupBy(STATION, "doy").agg(F.when(F.count(x) > more_than, F.percentile(x, F.lit(q))).alias("threshold"))


def members_within(df: DataFrame, keys: list[str], date: str, member: str, days: int, name: str) -> DataFrame:
    """(keys, date, name): for each day that has a row, how many members have a row of equal keys within ``days`` of it.

    The answer is one for all rows of a day: each member and day is sent to the days that it reaches, and members are
    counted there, so rows grow with the days and never with pairs of rows.
    """
    present = df.select(*keys, date, member).distinct()
    reach = present.select(*keys, member, F.explode(F.sequence(F.date_sub(date, days), F.date_add(date, days))).alias(date))
    counted = reach.groupBy(*keys, date).agg(F.countDistinct(member).alias(name))
    return counted.join(present.select(*keys, date).distinct(), [*keys, date], "left_semi")


def asof_forward(events: DataFrame, keys: list[str], at: str, is_left: Column, is_right: Column, value: Column, name: str) -> DataFrame:
    """Left rows with the value of the first right row that comes later in order of ``at``."""
    later = Window.partitionBy(*keys).orderBy(at).rowsBetween(1, Window.unboundedFollowing)
    return events.withColumn("_left", is_left).withColumn(name, F.first(F.when(is_right, value), ignorenulls=True).over(later)).filter("_left").drop("_left")


def merge_variables(frames: list[DataFrame]) -> DataFrame:
    """Full outer join of frames on station and date."""
    return reduce(lambda a, b: a.join(b, [STATION, "date"], "full"), frames)


def drop_exact_duplicates(obs: DataFrame, order: str) -> DataFrame:
    """One row of rows that are equal in all columns but ``order``: the first in that order."""
    columns = [c for c in obs.columns if c != order]
    return obs.groupBy(*columns).agg(F.min(order).alias(order))


def resolve_conflicts(obs: DataFrame, variables: list[str], order: str) -> DataFrame:
    """One row per station and day, the first in ``order``; a variable with several distinct values is null there and
    counted in n_conflicts."""
    differs = {v: F.countDistinct(v) > 1 for v in variables}
    firsts = [F.when(~differs[v], F.min_by(F.struct(v), F.col(order))[v]).alias(v) for v in variables]
    clash = sum((differs[v].cast("int") for v in variables), F.lit(0)).cast("long").alias("n_conflicts")
    return obs.groupBy(STATION, "date").agg(*firsts, clash)


def melt(df: DataFrame, date_column: str, variable: str) -> DataFrame:
    """Wide station columns to long rows; what is no number is null."""
    stations = [c for c in df.columns if c != date_column]
    texts = df.select(F.col(date_column).alias("date"), *(F.col(c).cast("string").alias(c) for c in stations))
    return texts.unpivot(["date"], stations, STATION, variable).withColumn(variable, F.expr(f"try_cast({variable} AS DOUBLE)"))


def ordered_totals(df: DataFrame, order: Column, totals: dict[str, str], by: list[str]) -> DataFrame:
    """df with running sums (new name -> column) in the given order within few, large groups (by: columns without nulls). Rows are
    parted by range and each part starts from the sums of the parts before it, so no task orders a whole group."""
    ranged = once(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_{new}") for new, c in totals.items()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part and group.
    starts = parts.select("_part", *by, *(F.coalesce(F.sum(f"_{new}").over(before), F.lit(0)).alias(f"_{new}") for new in totals))
    inside = Window.partitionBy("_part", *by).orderBy(order)
    out = ranged.join(F.broadcast(starts), ["_part", *by])
    for new, c in totals.items():
        out = out.withColumn(new, F.sum(c).over(inside) + F.col(f"_{new}"))
    return out.drop("_part", *(f"_{new}" for new in totals))


def quantiles(df: DataFrame, x: str, shares: dict[str, float]) -> DataFrame:
    """One row with the exact percentiles of a column over a whole table, interpolated between neighbours; nulls aside, null where
    nothing is known. Distinct values are counted and ranked by range parts, so no task holds them all."""
    counts = df.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_totals(counts, F.asc("_x"), {"_upto": "_c"}, [])
    n = ranked.agg(F.sum("_c").alias("_n"))
    held = ranked.join(F.broadcast(n))
    place = {name: (F.col("_n") - 1) * q for name, q in shares.items()}
    # The value of rank r is the least whose running count exceeds r.
    at = {name: [F.min(F.when(F.col("_upto") > f(p), F.col("_x"))) for f in (F.floor, F.ceil)] for name, p in place.items()}
    ends = held.agg(F.first("_n").alias("_n"), *(v.alias(f"{name}_{k}") for name, both in at.items() for k, v in enumerate(both)))
    return ends.select(*((F.col(f"{name}_0") + (place[name] - F.floor(place[name])) * (F.col(f"{name}_1") - F.col(f"{name}_0"))).alias(name) for name in shares))
