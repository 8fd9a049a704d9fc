"""Quality control: a cascade of flags, audit, completeness, gaps and station issues."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km, season
from . import frames

OK, SUSPICIOUS, ERROR, MISSING = 0, 1, 2, 3
#: Default limits of the rules.
LIMITS = {
    "precip_max": 500.0, "unit_error_ratio": 4.0, "outlier_factor": 2.5, "temp_min": -45.0, "temp_max": 48.0, "max_jump": 15.0, "robust_z": 6.0,
    "stuck_days": 7, "annual_days": 200, "min_completeness": 0.8, "dem_tolerance": 300.0, "near_km": 0.5, "wet": 1.0,
}


@dataclass
class Rule:
    level: int
    code: str
    when: Column
    reason: str = ""


@dataclass
class QCResult:
    observations: DataFrame
    flags: DataFrame
    audit: DataFrame
    gaps: DataFrame
    completeness: DataFrame
    summary: DataFrame = field(default=None)


def flag_cascade(value: Column, rules: list[Rule]) -> Column:
    """struct<flag, emitted: array<struct<level, code, reason>>>: rules in order, each raises the flag of a cell whose flag is
    lower and says so; a missing cell is above all rules."""
    if not rules:
        return F.struct(F.when(value.isNull(), MISSING).otherwise(OK).alias("flag"), F.array().cast("array<struct<level:int,code:string,reason:string>>").alias("emitted"))
    listed = F.array(*(F.struct(F.lit(r.level).alias("level"), F.lit(r.code).alias("code"), F.lit(r.reason).alias("reason"), F.coalesce(r.when, F.lit(False)).alias("on")) for r in rules))
    start = F.struct(F.when(value.isNull(), MISSING).otherwise(OK).alias("flag"), F.array().cast("array<struct<level:int,code:string,reason:string>>").alias("emitted"))

    def step(seen: Column, rule: Column) -> Column:
        raised = rule["on"] & (seen["flag"] < rule["level"])
        said = F.struct(rule["level"].alias("level"), rule["code"].alias("code"), rule["reason"].alias("reason"))
        return F.struct(F.when(raised, rule["level"]).otherwise(seen["flag"]).alias("flag"), F.when(raised, F.array_append(seen["emitted"], said)).otherwise(seen["emitted"]).alias("emitted"))

    return F.aggregate(listed, start, step)


def annual_ratio(daily: DataFrame, least: int = LIMITS["annual_days"]) -> DataFrame:
    """(station_id, year, ratio): the year's total, negatives as zero, over the station's median total."""
    totals = daily.groupBy("station_id", F.year("date").alias("year")).agg(F.when(F.count("precip") >= least, F.sum(F.greatest("precip", F.lit(0.0)))).alias("total"))
    typical = F.percentile("total", F.lit(0.5)).over(Window.partitionBy("station_id"))
    return totals.select("station_id", "year", F.try_divide(F.col("total"), typical).alias("ratio"))


def robust_z(daily: DataFrame, variable: str, name: str) -> DataFrame:
    """Anomaly from a smoothed day-of-year median, in robust standard deviations of the station."""
    half = F.lit(0.5)
    station = Window.partitionBy("station_id")
    by_day = Window.partitionBy("station_id", F.dayofyear("date"))
    x = daily.withColumn("_m", F.percentile(variable, half).over(by_day))
    x = x.withColumn("_a", F.col(variable) - F.avg("_m").over(frames.by_date().rowsBetween(-15, 15)))
    x = x.withColumn("_med", F.percentile("_a", half).over(station))
    x = x.withColumn("_mad", F.percentile(F.abs(F.col("_a") - F.col("_med")), half).over(station))
    return x.withColumn(name, (F.col("_a") - F.col("_med")) / (1.4826 * F.col("_mad") + 1e-6)).drop("_m", "_a", "_med", "_mad")


def rules_for(daily: DataFrame, limits: dict) -> tuple[DataFrame, dict[str, list[Rule]]]:
    """The table with what the rules need, and the rules of each variable in order."""
    df, rules = daily, {}
    if "precip" in df.columns:
        p = F.col("precip")
        ratio = annual_ratio(df, limits["annual_days"]).withColumnRenamed("ratio", "_ratio")
        extreme = df.filter(p > limits["wet"]).groupBy("station_id").agg(F.percentile("precip", F.lit(0.999)).alias("_p999"))
        df = df.withColumn("year", F.year("date")).join(ratio, ["station_id", "year"], "left").drop("year").join(extreme, "station_id", "left")
        rules["precip"] = [
            Rule(ERROR, "negative_precip", p < 0, "precipitation below zero"),
            Rule(ERROR, "precip_above_max", p > limits["precip_max"], "above the physical maximum"),
            Rule(ERROR, "suspected_unit_error", F.col("_ratio") > limits["unit_error_ratio"], "annual total far above the station median"),
            Rule(SUSPICIOUS, "precip_outlier", p > limits["outlier_factor"] * F.col("_p999"), "far above the wet-day 99.9th percentile"),
        ]
    temperatures = [v for v in ("tmax", "tmin") if v in df.columns]
    for v in temperatures:
        df = robust_z(df, v, f"_{v}_z")
        df = df.withColumn(f"_{v}_jump", F.abs(F.col(v) - F.lag(v).over(frames.by_date())))
        df = frames.run_length(df.withColumn("_same", F.col(v) == F.lag(v).over(frames.by_date())), F.col("_same"), F.lit(True), f"_{v}_stuck").drop("_same")
        x = F.col(v)
        rules[v] = [
            Rule(ERROR, "temperature_out_of_range", (x < limits["temp_min"]) | (x > limits["temp_max"]), "outside the plausible range"),
            Rule(SUSPICIOUS, "abrupt_jump", F.col(f"_{v}_jump") > limits["max_jump"], "abrupt change from the day before"),
            Rule(SUSPICIOUS, "robust_z_spike", F.abs(f"_{v}_z") > limits["robust_z"], "far from the seasonal norm"),
            Rule(SUSPICIOUS, "repeated_values", F.col(f"_{v}_stuck") >= limits["stuck_days"] - 1, "identical values for days"),
        ]
    if len(temperatures) == 2:
        for v in temperatures:
            rules[v].append(Rule(ERROR, "tmax_lt_tmin", F.col("tmax") < F.col("tmin"), "maximum below minimum"))
    if "rh" in df.columns:
        rules["rh"] = [Rule(ERROR, "rh_out_of_range", (F.col("rh") < 0) | (F.col("rh") > 100), "humidity outside 0 to 100")]
    return df, rules


def run_qc(obs: DataFrame, limits: dict | None = None, order: str | None = None) -> QCResult:
    """Duplicates, calendar, flags, masked values, gaps and completeness of daily observations. With ``order`` rows that repeat a
    key are resolved in its order first."""
    limits = {**LIMITS, **(limits or {})}
    variables = [v for v in ("precip", "tmax", "tmin", "rh") if v in obs.columns]
    if order:
        obs = frames.resolve_conflicts(frames.drop_exact_duplicates(obs, order), variables, order).drop("n_conflicts")
    daily, rules = rules_for(frames.regularise(obs), limits)
    keep = ["station_id", "date", *variables]
    flagged = daily.select(*keep, *(flag_cascade(F.col(v), rules.get(v, [])).alias(f"_{v}") for v in variables))
    observations = flagged.select(
        *keep,
        *(F.col(f"_{v}.flag").cast("byte").alias(f"{v}_flag") for v in variables),
        *(F.when(F.col(f"_{v}.flag") != ERROR, F.col(v)).alias(f"{v}_qc") for v in variables),
    )
    said = F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("original"), F.col(f"_{v}.emitted").alias("emitted")) for v in variables))
    rows = flagged.select("station_id", "date", F.explode(said).alias("s")).select("station_id", "date", "s.variable", "s.original", F.explode("s.emitted").alias("e"))
    severity = F.when(F.col("e.level") == ERROR, "error").otherwise("suspicious")
    flags = rows.select("station_id", "date", "variable", F.col("e.code").alias("flag"), severity.alias("severity"), F.col("e.reason").alias("reason"))
    corrected = F.when(F.col("e.level") == ERROR, F.lit(None)).otherwise("unchanged")
    audit = rows.select("station_id", F.col("date").cast("string").alias("date"), "variable", "original", corrected.alias("corrected"), F.col("e.code").alias("flag"), F.col("e.reason").alias("reason"), F.current_timestamp().alias("timestamp"))
    gaps = None
    for v in variables:
        one = frames.find_gaps(observations, v)
        gaps = one if gaps is None else gaps.unionByName(one)
    table = completeness(observations, variables)
    return QCResult(observations, flags, audit, gaps, table, summary(observations, flags, variables))


def completeness(daily: DataFrame, variables: list[str]) -> DataFrame:
    """Share of days with a value by station, year, season of year and month of year, in one pass."""
    rows = daily.select("station_id", F.year("date").alias("year"), F.month("date").alias("month"), season(F.month("date")).alias("season"), *(F.col(v).isNotNull().cast("double").alias(v) for v in variables))
    sets = [["station_id"], ["station_id", "year"], ["station_id", "year", "season"], ["station_id", "year", "month"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], "station_id", "year", "season", "month")
    return grouped.agg(*(F.avg(v).alias(v) for v in variables))


def summary(observations: DataFrame, flags: DataFrame, variables: list[str]) -> DataFrame:
    """(measure, value) of a quality-control run."""
    counts = flags.groupBy(F.concat(F.lit("flag "), "flag").alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    kinds = flags.groupBy(F.concat(F.lit("severity "), "severity").alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    missing = observations.agg(*(F.round(100 * F.avg(F.col(f"{v}_qc").isNull().cast("double")), 2).alias(f"missing {v}") for v in variables))
    return counts.unionByName(kinds).unionByName(missing.unpivot([], missing.columns, "measure", "value"))


def station_issues(stations: DataFrame, bbox: tuple[float, float, float, float], cells: DataFrame | None = None, grid: tuple | None = None, limits: dict | None = None) -> DataFrame:
    """(station_id, issue, detail): outside the box, elevation against the raster, another station nearby, documented moves."""
    from .geo import nearest_other, sample_raster

    limits = {**LIMITS, **(limits or {})}
    lon0, lat0, lon1, lat1 = bbox
    place = F.concat(F.lit("("), F.col("lat"), F.lit(", "), F.col("lon"), F.lit(")"))
    outside = ~(F.col("lon").between(lon0, lon1) & F.col("lat").between(lat0, lat1))
    out = stations.filter(outside).select("station_id", F.lit("coordinates_outside_bbox").alias("issue"), place.alias("detail"))
    if cells is not None:
        off = F.col("elevation_m") - F.col("value")
        found = sample_raster(stations, cells, grid).filter(F.abs(off) > limits["dem_tolerance"])
        out = out.unionByName(found.select("station_id", F.lit("elevation_metadata_vs_dem").alias("issue"), F.concat(F.lit("difference "), F.round(off).cast("string"), F.lit(" m")).alias("detail")))
    near = nearest_other(stations, limits["near_km"])
    out = out.unionByName(near.select("station_id", F.lit("near_duplicate_location").alias("issue"), F.concat(F.format_number("km", 2), F.lit(" km")).alias("detail")))
    if "relocation_events" in stations.columns:
        told = stations.filter(~F.coalesce(F.col("relocation_events"), F.lit("")).isin("", "[]"))
        out = out.unionByName(told.select("station_id", F.lit("documented_station_history").alias("issue"), F.col("relocation_events").alias("detail")))
    return out


__all__ = ["LIMITS", "QCResult", "Rule", "annual_ratio", "completeness", "flag_cascade", "haversine_km", "robust_z", "run_qc", "station_issues", "summary"]
