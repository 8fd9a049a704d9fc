"""Scans, filters, joins, aggregates, windows, set operations and scalar functions as registered queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars
from ..operators import frames
from ..sources import sinks
from .surrogate import RD, REFERENCE, RR, SD, SR, ST, query, region_day, station_day, stations, table


LOW, HIGH = REFERENCE
W = "OVER (PARTITION BY station_id ORDER BY date"

# ---- scans, filters, projections ----


@query("s1_scan_station_day", f"WITH {SD} SELECT station_id, date, precip, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin FROM sd")
def _(spark, d):
    return station_day(spark, d)


@query(
    "s5_events_json",
    "SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events WHERE props IS NOT NULL",
)
def _(spark, d):
    nested = F.from_json("props", "k bigint")
    return table(spark, d, "events").filter("props IS NOT NULL").select("event_id", "event_type", F.col("user_id").cast("string").alias("station_id"), F.to_date("ts").alias("date"), nested["k"].alias("props_k"))


@query("p2_unit_convert", f"WITH {SD} SELECT station_id, date, round(precip * 86400, 6) AS precip, round(tmax - 273.15, 6) AS tmax, round((tmin - 32) * 5 / 9, 6) AS tmin FROM sd")
def _(spark, d):
    conv = [scalars.convert(v, u, F.col(v)).alias(v) for v, u in (("precip", "kg m-2 s-1"), ("tmax", "K"), ("tmin", "F"))]
    return station_day(spark, d).select("station_id", "date", *conv)


@query("p10_range_filter", f"WITH {SD} SELECT station_id, date, precip FROM sd WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'")
def _(spark, d):
    return station_day(spark, d).filter("date BETWEEN DATE'1996-03-01' AND DATE'1996-06-30'").select("station_id", "date", "precip")


@query("p11_station_selector", f"WITH {SD}, {ST} SELECT station_id, date, precip FROM sd WHERE station_id IN (SELECT station_id FROM st WHERE basin = 'ASIA')")
def _(spark, d):
    chosen = stations(spark, d).filter("basin = 'ASIA'").select("station_id")
    return station_day(spark, d).join(F.broadcast(chosen), "station_id", "left_semi").select("station_id", "date", "precip")


@query("p12_dimension_listing", f"WITH {ST} SELECT station_id, basin, elevation_m FROM st WHERE basin IN ('EUROPE', 'AFRICA')")
def _(spark, d):
    st = stations(spark, d)
    return st.filter(F.col("basin").isin("EUROPE", "AFRICA")).select(*[c for c in ("station_id", "basin", "elevation_m", "province") if c in st.columns])


@query(
    "p15_bins_right_closed",
    f"WITH {ST} SELECT station_id, CASE WHEN elevation_m <= -1 THEN NULL WHEN elevation_m <= 500 THEN '<=500' WHEN elevation_m <= 1500 THEN '500-1500' WHEN elevation_m <= 2500 THEN '1500-2500' WHEN elevation_m <= 9000 THEN '>2500' END AS band FROM st",
)
def _(spark, d):
    return stations(spark, d).select("station_id", scalars.right_closed(F.col("elevation_m"), [-1, 500, 1500, 2500, 9000], ["<=500", "500-1500", "1500-2500", ">2500"]).alias("band"))


@query("p16_bins_left_closed", f"WITH {ST} SELECT station_id, (elevation_m >= 1000)::INT + (elevation_m >= 2000)::INT + (elevation_m >= 3000)::INT + (elevation_m >= 4000)::INT AS zone FROM st")
def _(spark, d):
    return stations(spark, d).select("station_id", scalars.digitized(F.col("elevation_m"), [1000, 2000, 3000, 4000]).alias("zone"))


@query(
    "p17_p18_regime_season",
    f"""WITH {RD} SELECT station_id, date, CASE WHEN precip IS NULL THEN -1 WHEN precip / 100 - 2 <= -1 THEN 0 WHEN precip / 100 - 2 >= 1 THEN 2 ELSE 1 END AS regime,
  CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'ON' END AS season,
  month(date) IN (6, 7, 8, 9) AS monsoon FROM rd""",
)
def _(spark, d):
    m = F.month("date")
    return region_day(spark, d).select("station_id", "date", scalars.regime(F.col("precip") / 100 - 2).alias("regime"), scalars.season(m).alias("season"), m.isin(*scalars.MONSOON).alias("monsoon"))


@query("p19_one_hot", f"WITH {ST} SELECT station_id, CAST(basin = 'ASIA' AS DOUBLE) AS is_asia, CAST(basin = 'EUROPE' AS DOUBLE) AS is_europe, CAST(NULL AS DOUBLE) AS ndvi_mean FROM st")
def _(spark, d):
    return stations(spark, d).select("station_id", *((F.col("basin") == b).cast("double").alias(f"is_{b.lower()}") for b in ("ASIA", "EUROPE")), F.lit(None).cast("double").alias("ndvi_mean"))


@query("p23_clean_numbers", "SELECT event_id, round(CASE WHEN value > 0 AND ln(value) BETWEEN -1e300 AND 1e300 THEN ln(value) END, 6) AS log_value FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", scalars.clean_number(F.when(F.col("value") > 0, F.log("value"))).alias("log_value"))


# ---- joins ----


@query("j1_left_dim", f"WITH {SD}, {ST} SELECT sd.station_id, date, precip, basin, elevation_m FROM sd LEFT JOIN st ON st.station_id = sd.station_id AND basin <> 'AMERICA'")
def _(spark, d):
    return station_day(spark, d).join(F.broadcast(stations(spark, d).filter("basin <> 'AMERICA'")), "station_id", "left").select("station_id", "date", "precip", "basin", "elevation_m")


@query(
    "j2_inner_composite",
    f"WITH {SD}, v AS (SELECT station_id, year(date) AS year FROM sd GROUP BY 1, 2 HAVING count(*) >= 100) SELECT sd.station_id, date, precip FROM sd JOIN v ON v.station_id = sd.station_id AND v.year = year(date)",
)
def _(spark, d):
    sd = station_day(spark, d).withColumn("year", F.year("date"))
    valid = sd.groupBy("station_id", "year").count().filter("count >= 100").select("station_id", "year")
    return sd.join(valid, ["station_id", "year"]).select("station_id", "date", "precip")


@query(
    "j3_left_fill_zero",
    f"WITH {SD} SELECT a.station_id, a.year, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT station_id, year(date) AS year FROM sd) a LEFT JOIN (SELECT station_id, year(date) AS year, count(*) AS n FROM sd WHERE precip > 150 GROUP BY 1, 2) b ON a.station_id = b.station_id AND a.year = b.year",
)
def _(spark, d):
    sd = station_day(spark, d).withColumn("year", F.year("date"))
    return sd.groupBy("station_id", "year").agg(F.count_if(F.col("precip") > 150).alias("n"))


@query(
    "j4_full_outer_merge",
    f"WITH {SD}, a AS (SELECT station_id, date, precip FROM sd WHERE precip > 60), b AS (SELECT station_id, date, tmax FROM sd WHERE tmax > 40) SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.date, b.date) AS date, precip, round(tmax, 6) AS tmax FROM a FULL JOIN b ON a.station_id = b.station_id AND a.date = b.date",
)
def _(spark, d):
    sd = station_day(spark, d)
    return frames.merge_variables([sd.filter("precip > 60").select("station_id", "date", "precip"), sd.filter("tmax > 40").select("station_id", "date", "tmax")])


@query(
    "j5_densify",
    f"WITH {RD}, days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM rd) SELECT s.station_id, days.date, precip FROM (SELECT DISTINCT station_id FROM rd) s CROSS JOIN days LEFT JOIN rd ON rd.station_id = s.station_id AND rd.date = days.date",
)
def _(spark, d):
    rd = region_day(spark, d)
    return frames.densify(rd, rd.select("station_id").distinct()).select("station_id", "date", "precip")


@query("j6_regularise_daily", f"WITH {SD}, {SR} SELECT station_id, date, precip, round(tmax, 6) AS tmax, round(tmin, 6) AS tmin FROM sr")
def _(spark, d):
    return frames.regularise(station_day(spark, d))


@query(
    "j7_lookup_thresholds",
    f"WITH {SD}, t AS (SELECT station_id, quantile_cont(precip, 0.95) AS p95 FROM sd GROUP BY 1) SELECT sd.station_id, date, CAST(precip > p95 AS DOUBLE) AS wet FROM sd JOIN t USING (station_id)",
)
def _(spark, d):
    sd = station_day(spark, d)
    t = sd.groupBy("station_id").agg(F.percentile("precip", F.lit(0.95)).alias("p95"))
    return sd.join(t, "station_id").select("station_id", "date", (F.col("precip") > F.col("p95")).cast("double").alias("wet"))


@query(
    "j9_range_self_join",
    f"""WITH {SD}, e AS (SELECT station_id, date FROM sd WHERE precip >= 200)
SELECT a.station_id, a.date, count(DISTINCT b.station_id) AS n_near FROM e a JOIN e b ON abs(date_diff('day', a.date, b.date)) <= 15 GROUP BY 1, 2""",
)
def _(spark, d):
    e = station_day(spark, d).filter("precip >= 200").select("station_id", "date")
    return e.join(frames.members_within(e, [], "date", "station_id", 15, "n_near"), "date")


@query(
    "j10_asof_forward",
    f"""WITH {RD}, m AS (SELECT station_id, date, precip < 60 AS dry, precip > 400 AS wet FROM rd)
SELECT a.station_id, a.date, min(b.date) AS next_wet FROM m a LEFT JOIN m b ON b.station_id = a.station_id AND b.wet AND b.date > a.date WHERE a.dry GROUP BY 1, 2""",
)
def _(spark, d):
    rd = region_day(spark, d)
    return frames.asof_forward(rd, ["station_id"], "date", F.col("precip") < 60, F.col("precip") > 400, F.col("date"), "next_wet").select("station_id", "date", "next_wet")


@query("j17_semi_in", f"WITH {SD.replace('sd AS (', 'sd AS MATERIALIZED (', 1)}, hit AS (SELECT DISTINCT station_id FROM sd WHERE precip > 200) SELECT sd.station_id, date, precip FROM sd JOIN hit ON hit.station_id = sd.station_id")
def _(spark, d):
    sd = station_day(spark, d)
    return sd.join(sd.filter("precip > 200").select("station_id").distinct(), "station_id", "left_semi").select("station_id", "date", "precip")


@query("j17_anti_not_in", f"WITH {SD}, {ST} SELECT station_id, basin FROM st WHERE station_id NOT IN (SELECT station_id FROM sd WHERE precip > 200)")
def _(spark, d):
    hit = station_day(spark, d).filter("precip > 200").select("station_id").distinct()
    return stations(spark, d).join(hit, "station_id", "left_anti").select("station_id", "basin")


# ---- aggregates ----


@query(
    "a1_completeness_grouping_sets",
    f"""WITH {SD}, {SR}, o AS (SELECT station_id, year(date) AS year, month(date) AS month, CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) IN (3, 4, 5) THEN 'MAM' WHEN month(date) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'ON' END AS season, precip FROM sr)
SELECT station_id, year, season, month, round(avg(CASE WHEN precip IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS precip FROM o GROUP BY GROUPING SETS ((station_id), (station_id, year), (station_id, year, season), (station_id, year, month))""",
)
def _(spark, d):
    from ..operators.qc import completeness

    return completeness(frames.regularise(station_day(spark, d)), ["precip"]).select("station_id", "year", "season", "month", "precip")


@query(
    "a2_annual_series",
    f"""WITH {RD}, {RR}, y AS (SELECT station_id, year(date) AS year, count(precip) * 1.0 / count(*) AS comp, sum(precip) AS total, avg(tmax) AS tmean FROM rr GROUP BY 1, 2)
SELECT station_id, year, round(CASE WHEN comp >= 0.8 THEN total / comp END, 6) AS precip, round(CASE WHEN comp >= 0.8 THEN tmean END, 6) AS tmax FROM y""",
)
def _(spark, d):
    from ..operators.homogeneity import annual_series

    rr = frames.regularise(region_day(spark, d))
    return annual_series(rr, "precip", 0.8).join(annual_series(rr, "tmax", 0.8), ["station_id", "year"], "full")


@query(
    "a4_unit_error_years",
    f"""WITH {RD}, {RR}, t AS (SELECT station_id, year(date) AS year, CASE WHEN count(precip) >= 200 THEN sum(greatest(precip, 0)) END AS total FROM rr GROUP BY 1, 2)
SELECT station_id, year, round(total / median(total) OVER (PARTITION BY station_id), 6) AS ratio FROM t""",
)
def _(spark, d):
    from ..operators.qc import annual_ratio

    return annual_ratio(frames.regularise(region_day(spark, d)), 200)


@query("a5_p999_wet", f"WITH {SD} SELECT station_id, round(quantile_cont(precip, 0.999), 6) AS p999 FROM sd WHERE precip > 1 GROUP BY 1")
def _(spark, d):
    return station_day(spark, d).filter("precip > 1").groupBy("station_id").agg(F.percentile("precip", F.lit(0.999)).alias("p999"))


@query("a8_missing_summary", f"WITH {SD}, {SR} SELECT station_id, round(100.0 * avg(CASE WHEN precip IS NULL THEN 1.0 ELSE 0.0 END), 2) AS precip FROM sr GROUP BY 1")
def _(spark, d):
    sr = frames.regularise(station_day(spark, d))
    return sr.groupBy("station_id").agg(F.round(100 * F.avg(F.col("precip").isNull().cast("double")), 2).alias("precip"))


@query(
    "a9_describe",
    f"WITH {SD}, {ST} SELECT min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, count(DISTINCT sd.station_id) AS n_stations, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max, round(min(lon), 6) AS lon_min, round(max(lon), 6) AS lon_max FROM sd JOIN st USING (station_id)",
)
def _(spark, d):
    return (
        station_day(spark, d)
        .join(F.broadcast(stations(spark, d)), "station_id")
        .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct("station_id").alias("n_stations"), *(f(c).alias(f"{c}_{n}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))))
    )


@query(
    "a11_overview_last_year",
    f"WITH {SD}, {ST}, l AS (SELECT max(date) AS last FROM sd) SELECT count(DISTINCT sd.station_id) AS n_stations, count(DISTINCT basin) AS n_basins, max(elevation_m) AS elevation_max, CAST(sum(CASE WHEN date > last - 365 AND precip > 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_wet FROM sd JOIN st USING (station_id) CROSS JOIN l",
)
def _(spark, d):
    sd = station_day(spark, d)
    last = sd.agg(F.max("date").alias("last"))
    joined = sd.join(F.broadcast(stations(spark, d)), "station_id").join(F.broadcast(last))
    return joined.agg(F.countDistinct("station_id").alias("n_stations"), F.countDistinct("basin").alias("n_basins"), F.max("elevation_m").alias("elevation_max"), F.count_if((F.col("date") > F.date_sub("last", 365)) & (F.col("precip") > 100)).alias("n_wet"))


@query(
    "a12_station_profile",
    f"WITH {SD}, {SR} SELECT station_id, round(count(precip) * 1.0 / count(*), 6) AS completeness, min(CASE WHEN precip IS NOT NULL THEN date END) AS first_valid, round(100 * avg(CASE WHEN precip IS NOT NULL THEN CASE WHEN precip > 80 THEN 1.0 ELSE 0.0 END END), 3) AS wet_rate FROM sr WHERE station_id = 'CHINA' GROUP BY 1",
)
def _(spark, d):
    sr = frames.regularise(station_day(spark, d).filter("station_id = 'CHINA'"))
    return sr.groupBy("station_id").agg((F.count("precip") / F.count(F.lit(1))).alias("completeness"), F.min(F.when(F.col("precip").isNotNull(), F.col("date"))).alias("first_valid"), F.round(100 * F.avg((F.col("precip") > 80).cast("double")), 3).alias("wet_rate"))


@query("a13_climate_daily", f"WITH {SD} SELECT date, round(avg(precip), 6) AS precip, round(avg(tmax), 6) AS tmax FROM sd GROUP BY 1")
def _(spark, d):
    return station_day(spark, d).groupBy("date").agg(F.avg("precip").alias("precip"), F.avg("tmax").alias("tmax"))


@query(
    "a14_climate_climatology",
    f"""WITH {RD}, m AS (SELECT station_id, year(date) AS year, month(date) AS month, CASE WHEN count(precip) >= 20 THEN sum(precip) END AS total FROM rd GROUP BY 1, 2, 3)
SELECT a.month, round(precip, 6) AS precip, round(tmax, 6) AS tmax FROM (SELECT month, avg(total) AS precip FROM m GROUP BY 1) a JOIN (SELECT month(date) AS month, avg(tmax) AS tmax FROM rd GROUP BY 1) b ON a.month = b.month""",
)
def _(spark, d):
    rd = region_day(spark, d).withColumn("month", F.month("date"))
    totals = rd.groupBy("station_id", F.year("date").alias("year"), "month").agg(F.when(F.count("precip") >= 20, F.sum("precip")).alias("total"), F.sum("tmax").alias("s"), F.count("tmax").alias("n"))
    return totals.groupBy("month").agg(F.avg("total").alias("precip"), (F.sum("s") / F.sum("n")).alias("tmax"))


def _period(unit: str, least: int) -> str:
    return f"""WITH {RD}, p AS (SELECT station_id, CAST(date_trunc('{unit}', date) AS DATE) AS start, CASE WHEN count(precip) >= {least} THEN sum(precip) END AS precip, CASE WHEN count(tmax) >= {least} THEN avg(tmax) END AS tmax FROM rd GROUP BY 1, 2)
SELECT start, round(avg(precip), 6) AS precip, round(avg(tmax), 6) AS tmax FROM p GROUP BY 1"""


def _periods(spark, d, unit: str, least: int):
    p = region_day(spark, d).groupBy("station_id", F.to_date(F.date_trunc(unit, "date")).alias("start"))
    per = p.agg(F.when(F.count("precip") >= least, F.sum("precip")).alias("precip"), F.when(F.count("tmax") >= least, F.avg("tmax")).alias("tmax"))
    return per.groupBy("start").agg(F.avg("precip").alias("precip"), F.avg("tmax").alias("tmax"))


@query("a15_climate_monthly", _period("month", 20))
def _(spark, d):
    return _periods(spark, d, "month", 20)


@query("a15_climate_annual", _period("year", 292))
def _(spark, d):
    return _periods(spark, d, "year", 292)


@query(
    "a16_extremes_annual",
    f"""WITH {RD}, y AS (SELECT station_id, year(date) AS year, count(precip) AS n, sum(CASE WHEN precip > 400 THEN 1 ELSE 0 END) AS e FROM rd GROUP BY 1, 2)
SELECT year, round(avg(e * 365.25 / n), 6) AS days_per_year FROM y WHERE n >= 292 GROUP BY 1""",
)
def _(spark, d):
    y = region_day(spark, d).groupBy("station_id", F.year("date").alias("year")).agg(F.count("precip").alias("n"), F.count_if(F.col("precip") > 400).alias("e"))
    return y.filter("n >= 292").groupBy("year").agg(F.avg(F.col("e") * 365.25 / F.col("n")).alias("days_per_year"))


@query("a16_extremes_seasonality", f"WITH {RD} SELECT month(date) AS month, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM rd WHERE precip > 400 GROUP BY 1")
def _(spark, d):
    n = region_day(spark, d).filter("precip > 400").groupBy(F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("month", (100 * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("percent"))


@query("a16_o2_extremes_recent", f"WITH {RD} SELECT station_id, date, precip FROM rd WHERE precip > 400 ORDER BY date DESC, station_id LIMIT 200")
def _(spark, d):
    return region_day(spark, d).filter("precip > 400").orderBy(F.desc("date"), "station_id").limit(200).select("station_id", "date", "precip")


@query(
    "a17_map_metric",
    f"WITH {SD} SELECT station_id, round(avg(CASE WHEN precip > 80 THEN 1.0 ELSE 0.0 END) * 365.25, 6) AS event_days, round(avg(precip) * 365.25, 6) AS annual_precip, round(avg((tmax + tmin) / 2), 6) AS mean_temp, round(sum(CASE WHEN precip > 80 THEN 1 ELSE 0 END) * 1.0 / count(DISTINCT year(date)), 6) AS per_year FROM sd GROUP BY 1",
)
def _(spark, d):
    e = (F.col("precip") > 80).cast("double")
    return station_day(spark, d).groupBy("station_id").agg((F.avg(e) * 365.25).alias("event_days"), (F.avg("precip") * 365.25).alias("annual_precip"), F.avg((F.col("tmax") + F.col("tmin")) / 2).alias("mean_temp"), (F.sum(e) / F.countDistinct(F.year("date"))).alias("per_year"))


@query("a26_pivot_model_mode", "SELECT p_brand AS model, round(avg(CASE WHEN p_size < 20 THEN p_retailprice END), 6) AS small, round(avg(CASE WHEN p_size >= 20 THEN p_retailprice END), 6) AS large FROM part GROUP BY 1")
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("model"), F.when(F.col("p_size") < 20, "small").otherwise("large").alias("mode"), F.col("p_retailprice").cast("double").alias("v"))
    return part.groupBy("model").pivot("mode", ["small", "large"]).avg("v")


@query("a27_value_counts", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("rate"))


@query("a28_normaliser_stats", f"WITH {SD} SELECT round(avg(ln(1 + precip)), 6) AS precip_mean, round(stddev_pop(ln(1 + precip)) + 1e-6, 6) AS precip_sd, round(avg(tmax), 6) AS tmax_mean, round(stddev_pop(tmax) + 1e-6, 6) AS tmax_sd FROM sd WHERE date BETWEEN DATE '{LOW}' AND DATE '{HIGH}'")
def _(spark, d):
    x = station_day(spark, d).filter(F.col("date").between(LOW, HIGH)).withColumn("precip", F.log1p("precip"))
    return x.agg(*(a.alias(f"{v}_{n}") for v in ("precip", "tmax") for n, a in (("mean", F.avg(v)), ("sd", F.stddev_pop(v) + 1e-6))))


@query("a32_irregular_intervals", f"WITH {SD} SELECT station_id, CAST(sum(CASE WHEN gap <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS irregular FROM (SELECT station_id, date_diff('day', lag(date) {W}), date) AS gap FROM sd) GROUP BY 1")
def _(spark, d):
    gaps = station_day(spark, d).withColumn("gap", F.datediff("date", F.lag("date").over(frames.by_date())))
    return gaps.groupBy("station_id").agg(F.count_if(F.col("gap") != 1).alias("irregular"))


# ---- windows ----


@query("w1_lags", f"WITH {RD}, {RR} SELECT station_id, date, " + ", ".join(f"round(lag(ln(1 + precip), {k}) {W}), 6) AS precip_lag{k}" for k in (1, 3, 7, 15, 30)) + " FROM rr")
def _(spark, d):
    rr = frames.regularise(region_day(spark, d))
    return rr.select("station_id", "date", *(F.lag(F.log1p("precip"), k).over(frames.by_date()).alias(f"precip_lag{k}") for k in (1, 3, 7, 15, 30)))


_ROLL = [(w, max(1, int(0.7 * w))) for w in (3, 7, 15, 30)]


@query(
    "w2_rolling_stats",
    f"WITH {SD}, {SR} SELECT station_id, date, "
    + ", ".join(f"round(CASE WHEN count(precip) {W} ROWS {w - 1} PRECEDING) >= {m} THEN {f}(precip) {W} ROWS {w - 1} PRECEDING) END, 6) AS precip_{n}{w}" for w, m in _ROLL for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max"), ("min", "min")))
    + " FROM sr",
)
def _(spark, d):
    sr = frames.regularise(station_day(spark, d))
    fs = (("mean", F.avg), ("std", F.stddev_samp), ("max", F.max), ("min", F.min))
    return sr.select("station_id", "date", *(frames.rolling(F.col("precip"), w, m, f).alias(f"precip_{n}{w}") for w, m in _ROLL for n, f in fs))


@query(
    "w3_accumulation_scaled",
    f"WITH {RD}, {RR} SELECT station_id, date, round(CASE WHEN count(precip) {W} ROWS 29 PRECEDING) >= 27 THEN sum(precip) {W} ROWS 29 PRECEDING) * 30 / count(precip) {W} ROWS 29 PRECEDING) END, 6) AS acc30 FROM rr",
)
def _(spark, d):
    from ..operators.indices import accumulation

    return frames.regularise(region_day(spark, d)).select("station_id", "date", accumulation(F.col("precip"), 30).alias("acc30"))


@query(
    "w6_robust_z",
    f"""WITH {RD}, {RR}, a AS (SELECT *, median(tmax) OVER (PARTITION BY station_id, dayofyear(date)) AS m FROM rr),
b AS (SELECT *, tmax - avg(m) {W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS anom FROM a),
c AS (SELECT *, median(anom) OVER (PARTITION BY station_id) AS med FROM b),
e AS (SELECT *, median(abs(anom - med)) OVER (PARTITION BY station_id) AS mad FROM c)
SELECT station_id, date, round((anom - med) / (1.4826 * mad + 1e-6), 6) AS z FROM e""",
)
def _(spark, d):
    from ..operators.qc import robust_z

    return robust_z(frames.regularise(region_day(spark, d)), "tmax", "z").select("station_id", "date", "z")


@query("w7_abs_jump", f"WITH {RD}, {RR} SELECT station_id, date, round(abs(tmax - lag(tmax) {W})), 6) AS jump FROM rr")
def _(spark, d):
    return frames.regularise(region_day(spark, d)).select("station_id", "date", F.abs(F.col("tmax") - F.lag("tmax").over(frames.by_date())).alias("jump"))


_RUN = """i AS (SELECT *, CASE WHEN {mask} THEN 1 ELSE 0 END AS o, sum(CASE WHEN {mask} THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY date) AS g FROM {view})"""


@query(
    "w8_run_length",
    f"WITH {SD}, {SR}, {_RUN.format(mask='precip >= 40', view='sr')} SELECT station_id, date, CAST(CASE WHEN precip IS NOT NULL THEN sum(o) OVER (PARTITION BY station_id, g ORDER BY date) END AS BIGINT) AS wet_run FROM i",
)
def _(spark, d):
    sr = frames.regularise(station_day(spark, d))
    return frames.run_length(sr, F.col("precip") >= 40, F.col("precip").isNotNull(), "wet_run").select("station_id", "date", "wet_run")


@query(
    "w9_stuck_runs",
    f"""WITH {RD}, {RR}, q AS (SELECT station_id, date, floor(tmax / 20) AS v FROM rr), s AS (SELECT *, v = lag(v) {W}) AS same FROM q),
{_RUN.format(mask='same', view='s')} SELECT station_id, date, CAST(sum(o) OVER (PARTITION BY station_id, g ORDER BY date) AS BIGINT) AS run FROM i""",
)
def _(spark, d):
    q = frames.regularise(region_day(spark, d)).select("station_id", "date", F.floor(F.col("tmax") / 20).alias("v"))
    same = q.withColumn("same", F.col("v") == F.lag("v").over(frames.by_date()))
    return frames.run_length(same, F.col("same"), F.lit(True), "run").select("station_id", "date", "run")


@query(
    "w10_warm_spell",
    f"WITH {RD}, {RR}, {_RUN.format(mask='tmax > 80', view='rr')} SELECT station_id, date, CAST(CASE WHEN o = 1 THEN sum(o) OVER (PARTITION BY station_id, g) ELSE 0 END AS BIGINT) AS spell FROM i",
)
def _(spark, d):
    return frames.enclosing_run(frames.regularise(region_day(spark, d)), F.col("tmax") > 80, "spell").select("station_id", "date", "spell")


@query(
    "w11_gaps",
    f"WITH {SD}, {SR}, {_RUN.format(mask='precip IS NULL', view='sr')} SELECT station_id, 'precip' AS variable, min(date) AS start, max(date) AS \"end\", count(*) AS length_days FROM i WHERE o = 1 GROUP BY station_id, g HAVING count(*) >= 2",
)
def _(spark, d):
    return frames.find_gaps(frames.regularise(station_day(spark, d)), "precip", 2)


@query(
    "w13_max_run",
    f"WITH {RD}, {RR}, y AS (SELECT *, year(date) AS year FROM rr), i AS (SELECT *, CASE WHEN precip < 200 THEN 1 ELSE 0 END AS o, sum(CASE WHEN precip < 200 THEN 0 ELSE 1 END) OVER (PARTITION BY station_id, year ORDER BY date) AS g FROM y), r AS (SELECT *, sum(o) OVER (PARTITION BY station_id, year, g ORDER BY date) AS run FROM i) SELECT station_id, year, CAST(max(run) AS BIGINT) AS cdd FROM r GROUP BY 1, 2",
)
def _(spark, d):
    y = frames.regularise(region_day(spark, d)).withColumn("year", F.year("date"))
    return frames.run_length(y, F.col("precip") < 200, F.lit(True), "run", ("station_id", "year")).groupBy("station_id", "year").agg(F.max("run").alias("cdd"))


CALENDAR = """{name} AS (SELECT station_id, doy, CASE WHEN count(*) > 20 THEN quantile_cont({v}, {q}) END AS threshold FROM
  (SELECT station_id, (dayofyear(date) - 1 + o + 366) % 366 + 1 AS doy, {v} FROM rr CROSS JOIN (SELECT unnest(range(-7, 8)) AS o) WHERE date BETWEEN DATE '{low}' AND DATE '{high}' AND {v} IS NOT NULL) GROUP BY 1, 2)"""


@query("w14_calendar_percentile", f"WITH {RD}, {RR}, {CALENDAR.format(name='c', v='tmax', q=0.9, low=LOW, high=HIGH)} SELECT station_id, CAST(doy AS BIGINT) AS doy, round(threshold, 6) AS threshold FROM c")
def _(spark, d):
    rr = frames.regularise(region_day(spark, d))
    return frames.circular_percentile(rr, "tmax", F.col("date").between(LOW, HIGH), 0.9).withColumn("doy", F.col("doy").cast("long"))


@query(
    "w15_persistence_window",
    f"WITH {RD}, {RR} SELECT station_id, date, CASE WHEN count(precip) {W} ROWS 9 PRECEDING) = 10 THEN CAST(sum(CASE WHEN precip >= 150 THEN 1 ELSE 0 END) {W} ROWS 9 PRECEDING) >= 8 AS DOUBLE) END AS persistent FROM rr",
)
def _(spark, d):
    wet = F.when(F.col("precip").isNotNull(), (F.col("precip") >= 150).cast("int"))
    return frames.regularise(region_day(spark, d)).select("station_id", "date", (frames.rolling(wet, 10, 10) >= 8).cast("double").alias("persistent"))


@query("w16_lead_target", f"WITH {RD}, {RR} SELECT station_id, date, max(CAST(precip > 400 AS DOUBLE)) {W} ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING) AS target FROM rr")
def _(spark, d):
    return frames.regularise(region_day(spark, d)).select("station_id", "date", frames.target((F.col("precip") > 400).cast("double"), 3, 3).alias("target"))


@query("w17_w18_shift", f"WITH {RD}, {RR} SELECT station_id, date, lag(precip) {W}) AS before, lead(precip, 3) {W}) AS ahead FROM rr")
def _(spark, d):
    return frames.regularise(region_day(spark, d)).select("station_id", "date", F.lag("precip").over(frames.by_date()).alias("before"), F.lead("precip", 3).over(frames.by_date()).alias("ahead"))


@query("w19_window_obs_frac", f"WITH {SD}, {SR} SELECT station_id, date, round(avg(CASE WHEN precip IS NULL THEN 0.0 ELSE 1.0 END) {W} ROWS 59 PRECEDING), 6) AS share FROM sr")
def _(spark, d):
    return frames.regularise(station_day(spark, d)).select("station_id", "date", F.avg(F.col("precip").isNotNull().cast("double")).over(frames.trailing(60)).alias("share"))


@query(
    "w20_window_gather",
    f"WITH {RD}, {RR} SELECT station_id, date, len(list(coalesce(precip, 0)) {W} ROWS 59 PRECEDING)) AS n, round(list_sum(list(coalesce(precip, 0)) {W} ROWS 59 PRECEDING)), 6) AS total FROM rr",
)
def _(spark, d):
    seen = F.collect_list(F.coalesce("precip", F.lit(0.0))).over(frames.trailing(60))
    rr = frames.regularise(region_day(spark, d)).withColumn("seen", seen)
    return rr.select("station_id", "date", F.size("seen").cast("long").alias("n"), F.aggregate("seen", F.lit(0.0), lambda a, x: a + x).alias("total"))


# ---- sets and dedup ----


@query(
    "u1_union_by_name",
    f"WITH {SD} SELECT station_id, date, precip, CAST(NULL AS DOUBLE) AS tmax FROM sd WHERE precip > 150 UNION ALL SELECT station_id, date, NULL, round(tmax, 6) FROM sd WHERE tmax > 90",
)
def _(spark, d):
    sd = station_day(spark, d)
    return sd.filter("precip > 150").select("station_id", "date", "precip").unionByName(sd.filter("tmax > 90").select("station_id", "date", "tmax"), allowMissingColumns=True)


def _raw(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("station_id"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").cast("double").alias("precip"), F.col("l_discount").cast("double").alias("tmax"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return lines


RAW = "raw AS (SELECT CAST(l_suppkey AS VARCHAR) AS station_id, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS DOUBLE) AS precip, CAST(l_discount AS DOUBLE) AS tmax, l_orderkey * 10 + l_linenumber AS ord FROM lineitem)"


@query("u2_drop_exact_dupes", f"WITH {RAW} SELECT station_id, date, precip, round(tmax, 6) AS tmax, min(ord) AS ord FROM raw GROUP BY station_id, date, precip, raw.tmax")
def _(spark, d):
    return frames.drop_exact_duplicates(_raw(spark, d), "ord")


@query(
    "u3_resolve_conflicts",
    f"""WITH {RAW} SELECT station_id, date, CASE WHEN count(DISTINCT precip) <= 1 THEN arg_min(precip, ord) END AS precip, round(CASE WHEN count(DISTINCT tmax) <= 1 THEN arg_min(tmax, ord) END, 6) AS tmax,
CAST((count(DISTINCT precip) > 1)::INT + (count(DISTINCT tmax) > 1)::INT AS BIGINT) AS n_conflicts FROM raw GROUP BY 1, 2""",
)
def _(spark, d):
    return frames.resolve_conflicts(_raw(spark, d), ["precip", "tmax"], "ord")


@query("u4_duplicate_keys", f"WITH {RAW} SELECT station_id, date, count(*) AS n FROM raw GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return _raw(spark, d).groupBy("station_id", "date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("u5_leakage_intersect", "SELECT CAST(c_nationkey AS BIGINT) AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT CAST(s_nationkey AS BIGINT) FROM supplier WHERE s_acctbal > 5000")
def _(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").cast("long").alias("k"))
    return a.intersect(table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").cast("long").alias("k")))


@query("u7_insert_if_absent", "SELECT o_orderkey AS k, 'old' AS source FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    old = orders.filter("k % 3 = 0")
    new = orders.filter("k % 2 = 0")
    return sinks.insert_absent(old.withColumn("source", F.lit("old")), new.withColumn("source", F.lit("new")), ["k"])


# ---- scalars ----


@query(
    "f2_haversine",
    f"WITH {ST} SELECT a.station_id, b.station_id AS other, round({scalars.HAVERSINE_SQL.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')}, 6) AS km FROM st a JOIN st b ON a.basin = b.basin AND a.station_id < b.station_id",
)
def _(spark, d):
    a, b = stations(spark, d).alias("a"), stations(spark, d).alias("b")
    c = F.col
    return a.join(b, (c("a.basin") == c("b.basin")) & (c("a.station_id") < c("b.station_id"))).select(c("a.station_id"), c("b.station_id").alias("other"), scalars.haversine_km(c("a.lat"), c("a.lon"), c("b.lat"), c("b.lon")).alias("km"))


@query(
    "f3_hargreaves_pet",
    f"""WITH {SD}, {ST}, x AS (SELECT sd.station_id, date, tmax, tmin, radians(lat) AS phi, 2 * pi() * dayofyear(date) / 365 AS a FROM sd JOIN st USING (station_id)),
y AS (SELECT *, 0.409 * sin(a - 1.39) AS tilt FROM x), z AS (SELECT *, acos(greatest(-1.0, least(1.0, -tan(phi) * tan(tilt)))) AS ws FROM y)
SELECT station_id, date, round(greatest(0.0, 0.0023 * 0.408 * (24 * 60 / pi() * 0.0820 * (1 + 0.033 * cos(a)) * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws))) * ((tmax + tmin) / 2 + 17.8) * sqrt(greatest(tmax - tmin, 0))), 6) AS pet FROM z""",
)
def _(spark, d):
    x = station_day(spark, d).join(F.broadcast(stations(spark, d)), "station_id")
    return x.select("station_id", "date", scalars.hargreaves_pet(F.col("tmax"), F.col("tmin"), F.dayofyear("date"), F.col("lat")).alias("pet"))


@query("f7_entropy_bits", "SELECT doc_id, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) AS h FROM (SELECT doc_id, least(greatest((doc_id % 101) / 100.0, 1e-7), 1 - 1e-7) AS q FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.entropy_bits((F.col("doc_id") % 101) / 100.0).alias("h"))


@query("f10_calendar_features", f"WITH {RD} SELECT DISTINCT date, round(sin(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(date) / 365.25), 6) AS doy_cos, month(date) AS month, CAST(month(date) IN (6, 7, 8, 9) AS DOUBLE) AS monsoon FROM rd")
def _(spark, d):
    a = 2 * F.pi() * F.dayofyear("date") / 365.25
    return region_day(spark, d).select("date").distinct().select("date", F.sin(a).alias("doy_sin"), F.cos(a).alias("doy_cos"), F.month("date").alias("month"), F.month("date").isin(*scalars.MONSOON).cast("double").alias("monsoon"))


@query("f15_melt_long", f"WITH {RD}, w AS (SELECT date, max(CASE WHEN station_id = 'ASIA' THEN precip END) AS \"ASIA\", max(CASE WHEN station_id = 'EUROPE' THEN precip END) AS \"EUROPE\" FROM rd GROUP BY 1) SELECT date, 'ASIA' AS station_id, \"ASIA\" AS precip FROM w UNION ALL SELECT date, 'EUROPE', \"EUROPE\" FROM w")
def _(spark, d):
    wide = region_day(spark, d).groupBy("date").pivot("station_id", ["ASIA", "EUROPE"]).agg(F.max("precip"))
    return frames.melt(wide, "date", "precip")


@query("f16_table_fingerprint")
def _(spark, d):
    from ..sources.hashing import fingerprint

    return fingerprint(station_day(spark, d))


@query("d4_relocation_events", "SELECT n_name AS station_id, n_nationkey % 3 AS n_events, n_nationkey % 3 = 2 AND 1990 + n_nationkey BETWEEN 1995 AND 1999 AS near_1997 FROM nation")
def _(spark, d):
    one = lambda o: F.concat(F.lit('{"date":"'), (1990 + F.col("n_nationkey") + o).cast("string"), F.lit('-05-01","type":"move","detail":"x"}'))
    k = F.col("n_nationkey") % 3
    text = F.concat(F.lit("["), F.when(k == 0, "").when(k == 1, one(40)).otherwise(F.concat(one(0), F.lit(","), one(40))), F.lit("]"))
    schema = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("date", "type", "detail")]))
    parsed = table(spark, d, "nation").select(F.col("n_name").alias("station_id"), F.from_json(text, schema).alias("e"))
    near = F.exists("e", lambda e: F.abs(F.substring(e["date"], 1, 4).cast("int") - 1997) <= 2)
    return parsed.select("station_id", F.size("e").cast("long").alias("n_events"), near.alias("near_1997"))
