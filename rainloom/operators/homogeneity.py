"""Homogeneity of station series: annual values, reference series, voting, classes and a bounded fix-point; trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import haversine_km
from . import stats
from .materialize import once

#: Smallest shifts that matter, by variable.
RELEVANT = {"tmax": 0.3, "tmin": 0.3, "precip": 0.08}


def annual_series(daily: DataFrame, variable: str, least: float = 0.8) -> DataFrame:
    """(station_id, year, value named after the variable): totals scaled up by completeness for precip, means for others."""
    x = f"{variable}_qc" if f"{variable}_qc" in daily.columns else variable
    share = F.count(x) / F.count(F.lit(1))
    value = F.sum(x) / share if variable == "precip" else F.avg(x)
    return daily.groupBy("station_id", F.year("date").alias("year")).agg(F.when(share >= least, value).alias(variable))


def reference_series(annual: DataFrame, stations: DataFrame, variable: str, k: int = 5, max_km: float = 250.0, overlap: int = 10, least_r: float = 0.2, excluded: DataFrame | None = None) -> DataFrame:
    """(station_id, year, reference, n_references): for each station the r-squared-weighted mean of the nearest stations
    within max_km whose year-to-year changes correlate; at most k, nearest first."""
    v = annual.filter(F.col(variable).isNotNull()).select("station_id", "year", F.col(variable).alias("v"))
    places = stations.select("station_id", "lat", "lon")
    others = places.select(F.col("station_id").alias("other"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    if excluded is not None:
        others = others.join(excluded.select(F.col("station_id").alias("other")), "other", "left_anti")
    # Grid cells of max_km by latitude: a pair within reach is in the same or a neighbouring band.
    band = max_km / 111.0
    a = places.withColumn("cell", F.floor(F.col("lat") / band))
    b = others.withColumn("cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda o: F.floor(F.col("lat2") / band) + o)))
    near = a.join(b, "cell").filter("station_id <> other").withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")))
    near = near.filter(F.col("km") <= max_km).select("station_id", "other", "km")
    pairs = near.join(v, "station_id").join(v.select(F.col("station_id").alias("other"), "year", F.col("v").alias("w")), ["other", "year"])
    by = Window.partitionBy("station_id", "other").orderBy("year")
    changes = pairs.withColumn("dv", F.col("v") - F.lag("v").over(by)).withColumn("dw", F.col("w") - F.lag("w").over(by))
    strength = changes.groupBy("station_id", "other", "km").agg(F.corr("dv", "dw").alias("r"), F.count(F.lit(1)).alias("n"))
    chosen = strength.filter((F.col("n") >= overlap) & (F.col("r") > least_r))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("station_id").orderBy("km", "other"))).filter(F.col("rank") <= k)
    used = chosen.join(v.select(F.col("station_id").alias("other"), "year", F.col("v").alias("w")), "other")
    weight = F.col("r") * F.col("r")
    return used.groupBy("station_id", "year").agg(F.try_divide(F.sum(weight * F.col("w")), F.sum(weight)).alias("reference"), F.count(F.lit(1)).alias("n_references"))


def vote(series: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(key, is_break, change_index): at least two of three tests significant; the index is the truncated median of theirs."""
    tests = stats.pettitt(series).select("key", "p_value", "change_index")
    for which, test in (("snht", stats.snht), ("buishand", stats.buishand)):
        tests = tests.unionByName(stats.with_p_value(test(series), which).select("key", "p_value", "change_index"))
    hit = F.when(F.col("p_value") < alpha, F.col("change_index"))
    out = tests.groupBy("key").agg(F.count(hit).alias("n"), F.floor(F.percentile(hit, F.lit(0.5))).alias("change_index"))
    return out.select("key", (F.col("n") >= 2).alias("is_break"), F.when(F.col("n") >= 2, F.col("change_index")).alias("change_index"))


def classify(daily: DataFrame, stations: DataFrame, variable: str, alpha: float = 0.05, least_years: int = 15, excluded: DataFrame | None = None, max_km: float = 250.0, overlap: int = 10) -> DataFrame:
    """One row per station: raw and relative breaks, shift across the relative break, and a class."""
    annual = once(annual_series(daily, variable).filter(F.col(variable).isNotNull()))
    years = annual.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_years"))
    enough = annual.join(years.filter(F.col("n_years") >= least_years), "station_id", "left_semi")
    raw = stats.indexed(enough, "station_id", "year", variable)
    year_of = enough.select(F.col("station_id").alias("key"), "year", F.col(variable).alias("x"), (F.row_number().over(Window.partitionBy("station_id").orderBy("year")) - 1).alias("t"))
    ref = reference_series(annual, stations, variable, excluded=excluded, max_km=max_km, overlap=overlap)
    gap = F.try_divide(F.col(variable), F.col("reference")) if variable == "precip" else F.col(variable) - F.col("reference")
    relative = once(enough.join(ref, ["station_id", "year"]).withColumn("gap", gap))
    long = relative.groupBy("station_id").agg(F.count("gap").alias("m"), F.max("n_references").alias("reference_stations")).filter(F.col("m") >= overlap)
    rel = stats.indexed(relative.join(long, "station_id", "left_semi"), "station_id", "year", "gap")
    rel_year = relative.filter(F.col("gap").isNotNull()).select(F.col("station_id").alias("key"), "year", "gap", (F.row_number().over(Window.partitionBy("station_id").orderBy("year")) - 1).alias("t"))
    raw_vote = once(vote(raw, alpha)).select("key", F.col("is_break").alias("raw_break"), F.col("change_index").alias("ri"))
    rel_vote = once(vote(rel, alpha)).select("key", F.col("is_break").alias("rel_break"), F.col("change_index").alias("li"))
    raw_at = raw_vote.join(year_of.select("key", F.col("t").alias("ri"), F.col("year").alias("raw_break_year")), ["key", "ri"], "left")
    sides = rel_year.join(rel_vote, "key").groupBy("key", "rel_break", "li").agg(
        F.avg(F.when(F.col("t") < F.col("li"), F.col("gap"))).alias("before"), F.avg(F.when(F.col("t") >= F.col("li"), F.col("gap"))).alias("after"), F.max(F.when(F.col("t") == F.col("li"), F.col("year"))).alias("rel_break_year")
    )
    shift = F.try_divide(F.col("after"), F.col("before")) if variable == "precip" else F.col("after") - F.col("before")
    sides = sides.withColumn("shift_estimate", F.when(F.col("rel_break"), shift))
    size = F.abs(F.col("shift_estimate") - (1 if variable == "precip" else 0))
    told = F.lit(False)
    if "relocation_events" in stations.columns:
        moves = stations.select(F.col("station_id").alias("key"), F.from_json("relocation_events", "array<struct<date:string,type:string,detail:string>>").alias("moves"))
        sides = sides.join(moves, "key", "left")
        told = F.coalesce(F.exists("moves", lambda e: F.abs(F.substring(e["date"], 1, 4).cast("int") - F.col("rel_break_year")) <= 2), F.lit(False))
    sides = sides.withColumn("documented", told & F.col("rel_break")).withColumn("relevant", F.coalesce(size >= RELEVANT.get(variable, 0.0), F.lit(False)))
    out = years.withColumnRenamed("station_id", "key").join(raw_at, "key", "left").join(sides.drop("before", "after", "li", *(["moves"] if "relocation_events" in stations.columns else [])), "key", "left")
    out = out.join(long.select(F.col("station_id").alias("key"), "reference_stations"), "key", "left")
    raw_, rel_ = F.coalesce("raw_break", F.lit(False)), F.coalesce("rel_break", F.lit(False))
    kind = (
        F.when(F.col("n_years") < least_years, "insufficient_data")
        .when(F.col("reference_stations").isNull() & raw_, "break_without_reference")
        .when(F.col("reference_stations").isNull(), "no_reference")
        .when(rel_ & ~F.col("relevant"), "minor_relative_shift")
        .when(rel_ & F.col("documented"), "documented_artifact")
        .when(rel_, "probable_artifact")
        .when(raw_, "regional_signal")
        .otherwise("homogeneous")
    )
    return out.select(F.col("key").alias("station_id"), F.lit(variable).alias("variable"), "n_years", raw_.alias("raw_break"), "raw_break_year", "reference_stations", rel_.alias("rel_break"), "rel_break_year", "shift_estimate", kind.alias("classification"))


def report(daily: DataFrame, stations: DataFrame, variables: list[str], passes: int = 3, **options) -> DataFrame:
    """classify, at most ``passes`` times: stations found to be artifacts no longer serve as references in the next pass.
    Stations are few; only their ids come to the driver, to tell whether the set still grows."""
    out = None
    for variable in variables:
        out_of: set[str] = set()
        for k in range(passes):
            names = daily.sparkSession.createDataFrame([(s,) for s in sorted(out_of)], "station_id string") if out_of else None
            found = classify(daily, stations, variable, excluded=names, **options)
            found = once(found)
            flagged = {r["station_id"] for r in found.filter(F.col("classification").isin("documented_artifact", "probable_artifact")).select("station_id").collect()}
            done = found.withColumn("iterations", F.lit(k + 1)).withColumn("excluded_from_references", F.col("station_id").isin(sorted(out_of)) if out_of else F.lit(False))
            if flagged <= out_of:
                break
            out_of |= flagged
        out = done if out is None else out.unionByName(done)
    return out


def trends(daily: DataFrame, variables: list[str], least_years: int = 15, q: float = 0.05) -> DataFrame:
    """(station_id, variable, n_years, sens_slope_per_year, mk_z, p_value, tau, significant_fdr)."""
    out = None
    for variable in variables:
        annual = once(annual_series(daily, variable).filter(F.col(variable).isNotNull()))
        years = annual.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_years")).filter(F.col("n_years") >= least_years)
        used = annual.join(years, "station_id")
        mk = stats.mann_kendall(stats.indexed(used, "station_id", "year", variable)).drop("sens_slope")
        by_year = used.select(F.col("station_id").alias("key"), F.col("year").alias("t"), F.col(variable).alias("x"))
        one = mk.join(stats.sen_slope(by_year), "key").join(years.withColumnRenamed("station_id", "key"), "key")
        one = one.select(F.col("key").alias("station_id"), F.lit(variable).alias("variable"), "n_years", F.col("slope").alias("sens_slope_per_year"), F.col("z").alias("mk_z"), "p_value", "tau")
        out = one if out is None else out.unionByName(one)
    return stats.benjamini_hochberg(out, "p_value", ["variable"], q)
