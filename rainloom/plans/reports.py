"""Studies and reports as registered queries: folds, damaged inputs, summaries of predictions, resampling, station features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, specfun
from ..operators import events, frames, geo, homogeneity, indices, metrics, stats, studies
from ..sources import platform, sinks
from .analysis import _CELLS, _F, _INSIDE, _KM, _LABELS, _MONTHS, _SEG, _SY, _WHIPLASH, BOX, GRID, RIVER, SETTINGS, _cells, _daily, _forecasts, _months, _swings
from .surrogate import RD, REFERENCE, RR, SD, SR, ST, query, region_day, station_day, stations, table

LOW, HIGH = REFERENCE

# ---- predictions ----

_PRED = f"""{_F}, pr AS (SELECT CAST(g AS VARCHAR) AS station_id, CAST(DATE '2000-01-01' + CAST(doc_id % 11 AS INTEGER) AS DATE) AS target_date, p AS probability,
 CASE WHEN abs(p - 0.5) < 0.1 THEN 'high' ELSE 'low' END AS uncertainty, CASE WHEN doc_id % 5 > 0 THEN CAST(y AS DOUBLE) END AS observed_event FROM f)"""
_SUMMED = """count(*) AS n, round(avg(probability), 6) AS mean_probability, round(max(probability), 6) AS max_probability, round(sum(probability), 6) AS expected_events, round(quantile_cont(probability, 0.1), 6) AS p10, round(quantile_cont(probability, 0.9), 6) AS p90,
 round(avg(CASE WHEN uncertainty = 'high' THEN 1.0 ELSE 0.0 END), 6) AS share_high, round(avg(observed_event), 6) AS observed_rate FROM pr GROUP BY 1"""


def _predictions(spark, d):
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("doc_id") % 11).cast("int"))
    return _forecasts(spark, d).select(
        F.col("g").cast("string").alias("station_id"), day.alias("target_date"), F.col("p").alias("probability"), F.when(F.abs(F.col("p") - 0.5) < 0.1, "high").otherwise("low").alias("uncertainty"), F.when(F.col("doc_id") % 5 > 0, F.col("y").cast("double")).alias("observed_event")
    )


@query("a21_predictions_by_station", f"WITH {_PRED} SELECT station_id, {_SUMMED}")
def _(spark, d):
    return studies.prediction_summary(_predictions(spark, d), ["station_id"])


@query("a21_predictions_by_date", f"WITH {_PRED} SELECT target_date, {_SUMMED}")
def _(spark, d):
    return studies.prediction_summary(_predictions(spark, d), ["target_date"])


_TWO = "tw AS (SELECT 'a' AS model, CAST(2000 + doc_id % 4 AS INTEGER) AS year, y, p FROM f UNION ALL SELECT 'b', CAST(2000 + doc_id % 4 AS INTEGER), y, ((doc_id * 31) % 101) / 101.0 FROM f)"


@query(
    "a25_scores_by_year",
    f"""WITH {_F}, {_TWO}, b AS (SELECT model, year, p, sum(y) * 1.0 AS pos, count(*) * 1.0 AS n FROM tw GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model, year ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY model, year ORDER BY p DESC) AS seen, sum(pos) OVER (PARTITION BY model, year) AS pp, sum(n) OVER (PARTITION BY model, year) AS nn FROM b),
a AS (SELECT model, year, sum(pos / pp * tp / seen) AS auprc, max(pp / nn) AS base_rate FROM c GROUP BY 1, 2),
r AS (SELECT model, year, avg(pow(least(greatest(p, 1e-6), 1 - 1e-6) - y, 2)) AS brier FROM tw GROUP BY 1, 2)
SELECT model, year, round(auprc, 6) AS auprc, round(base_rate, 6) AS base_rate, round(brier, 6) AS brier FROM a JOIN r USING (model, year)""",
)
def _(spark, d):
    f = _forecasts(spark, d)
    year = (2000 + F.col("doc_id") % 4).cast("int").alias("year")
    other = (((F.col("doc_id") * 31) % 101) / 101.0).alias("p")
    return studies.scores_by_year(f.select(F.lit("a").alias("model"), year, "y", "p").unionByName(f.select(F.lit("b").alias("model"), year, "y", other)))


@query(
    "o5_top_attributions",
    "WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS rank FROM e) SELECT vec_id, CAST(i AS INTEGER) AS feature, round(CAST(v AS DOUBLE), 6) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8",
)
def _(spark, d):
    return studies.top_attributions(table(spark, d, "embeddings"), "vec_id", "embedding")


# ---- resampling ----

_DRAWN = f"""gs AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT g FROM f)),
dr AS (SELECT r AS replicate, CAST(floor({studies.uniform_sql('CAST(r AS VARCHAR)', 'CAST(k AS VARCHAR)', "'0'")} * n) AS BIGINT) AS k FROM gs CROSS JOIN (SELECT unnest(range(0, 200)) AS r)),
rp AS (SELECT replicate, f.* FROM dr JOIN gs ON gs.k = dr.k JOIN f ON f.g = gs.g)"""


def _ap_sql(source: str, by: str) -> str:
    """SQL of the average precision of rows y, p by some columns, as views x_b, x_c and x_ap."""
    return f"""x_b AS (SELECT {by}, p, sum(y) * 1.0 AS pos, count(*) * 1.0 AS n FROM {source} GROUP BY ALL),
x_c AS (SELECT *, sum(pos) OVER (PARTITION BY {by} ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY {by} ORDER BY p DESC) AS seen, sum(pos) OVER (PARTITION BY {by}) AS pp FROM x_b),
x_ap AS (SELECT {by}, sum(pos / pp * tp / seen) AS ap FROM x_c GROUP BY ALL)"""


@query("t15_bootstrap_ci", f"WITH {_F}, {_DRAWN}, {_ap_sql('rp', 'replicate')} SELECT round(quantile_cont(ap, 0.025), 6) AS low, round(quantile_cont(ap, 0.975), 6) AS high FROM x_ap")
def _(spark, d):
    return metrics.bootstrap_ci(_forecasts(spark, d), "g", metrics.average_precision)


_PAIRED = f"""{_F}, {_DRAWN}, both_ AS (SELECT replicate, 'a' AS w, y, p FROM rp UNION ALL SELECT replicate, 'b', y, ((doc_id * 31) % 101) / 101.0 FROM rp UNION ALL SELECT -1, 'a', y, p FROM f UNION ALL SELECT -1, 'b', y, ((doc_id * 31) % 101) / 101.0 FROM f),
{_ap_sql('both_', 'replicate, w')}, df AS (SELECT replicate, max(CASE WHEN w = 'a' THEN ap END) - max(CASE WHEN w = 'b' THEN ap END) AS diff FROM x_ap GROUP BY 1),
pd AS (SELECT max(CASE WHEN replicate = -1 THEN diff END) AS diff, quantile_cont(CASE WHEN replicate >= 0 THEN diff END, 0.025) AS ci_low, quantile_cont(CASE WHEN replicate >= 0 THEN diff END, 0.975) AS ci_high FROM df)"""


def _paired(spark, d):
    f = _forecasts(spark, d)
    return studies.paired_difference(f.select("g", "y", F.col("p").alias("a"), (((F.col("doc_id") * 31) % 101) / 101.0).alias("b")), "g", metrics.average_precision)


@query("t15_paired_bootstrap", f"WITH {_PAIRED} SELECT round(diff, 6) AS diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM pd")
def _(spark, d):
    return _paired(spark, d)


@query("v12_verdict", f"WITH {_PAIRED} SELECT 'a - b' AS comparison, CASE WHEN ci_low > 0 THEN 'supported' WHEN ci_high < 0 THEN 'contradicted' ELSE 'inconclusive' END AS more_is_better, CASE WHEN ci_high < 0 THEN 'supported' WHEN ci_low > 0 THEN 'contradicted' ELSE 'inconclusive' END AS less_is_better FROM pd")
def _(spark, d):
    low, high = F.col("ci_low"), F.col("ci_high")
    return _paired(spark, d).select(F.lit("a - b").alias("comparison"), studies.verdict(low, high).alias("more_is_better"), studies.verdict(low, high, False).alias("less_is_better"))


@query(
    "t12_permutation_test",
    f"""WITH x AS (SELECT s_suppkey AS k, CAST(s_acctbal AS DOUBLE) AS v, CAST(s_nationkey < 12 AS INTEGER) AS one FROM supplier),
s AS (SELECT sum(one) AS n_first, count(*) AS n, avg(CASE WHEN one = 1 THEN v END) - avg(CASE WHEN one = 0 THEN v END) AS difference FROM x),
w AS (SELECT draw, v, row_number() OVER (PARTITION BY draw ORDER BY {studies.uniform_sql('CAST(draw AS VARCHAR)', 'CAST(k AS VARCHAR)', "'0'")}, CAST(k AS VARCHAR)) AS r FROM x CROSS JOIN (SELECT unnest(range(1, 2001)) AS draw)),
m AS (SELECT draw, avg(CASE WHEN r <= n_first THEN v END) - avg(CASE WHEN r > n_first THEN v END) AS d FROM w CROSS JOIN s GROUP BY 1)
SELECT CAST(any_value(n_first) AS BIGINT) AS n_first, CAST(any_value(n - n_first) AS BIGINT) AS n_second, round(any_value(difference), 6) AS difference, round((sum(CASE WHEN abs(d) >= abs(difference) - 1e-12 THEN 1 ELSE 0 END) + 1) / 2001.0, 6) AS p_value FROM m CROSS JOIN s""",
)
def _(spark, d):
    values = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return studies.permutation_test(values, F.col("s_nationkey") < 12, "s_acctbal", "s_suppkey")


# ---- folds and inputs ----


def _folds_sql(group: str) -> str:
    drawn = studies.uniform_sql("grp", "'0'")
    return f"""WITH {ST}, nm AS (SELECT station_id, {group} AS grp FROM st), od AS (SELECT grp, row_number() OVER (ORDER BY {drawn}, grp) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM nm))
SELECT station_id, nm.grp AS "group", CASE WHEN k * 1.0 / n < 0.6 THEN 'train' WHEN k * 1.0 / n < 0.8 THEN 'val' ELSE 'test' END AS fold FROM nm JOIN od ON od.grp = nm.grp"""


for _by, _sql in (("basin", "basin"), ("longitude_block", "CAST(ntile(8) OVER (ORDER BY lon, station_id) AS VARCHAR)"), ("random", "station_id")):
    query(f"m3_spatial_folds_{_by}", _folds_sql(_sql))(lambda spark, d, by=_by: studies.folds_by_group(stations(spark, d), by))


@query("m3_stratified_validation", f"WITH {_F} SELECT doc_id, y, {studies.uniform_sql('CAST(doc_id AS VARCHAR)', 'CAST(y AS VARCHAR)', chr(39) + '0' + chr(39))} < 0.2 AS validation FROM f")
def _(spark, d):
    return studies.stratified(_forecasts(spark, d).select("doc_id", "y"), "y", ["doc_id"], 0.2)


@query("p21_label_subset", f"WITH {_F} SELECT doc_id, y FROM f WHERE {studies.uniform_sql('CAST(doc_id AS VARCHAR)', chr(39) + '0' + chr(39))} < 0.25")
def _(spark, d):
    return studies.thinned(_forecasts(spark, d), ["doc_id"], 0.25).select("doc_id", "y")


_LOST = studies.uniform_sql("station_id", "CAST(date AS VARCHAR)", "'0'")


@query("p22_masked_days", f"WITH {SD}, {SR} SELECT station_id, date, CASE WHEN {_LOST} < 0.3 OR precip IS NULL THEN 0.0 ELSE precip END AS precip, CASE WHEN {_LOST} < 0.3 OR precip IS NULL THEN 0 ELSE 1 END AS precip_mask FROM sr")
def _(spark, d):
    return studies.masked_days(frames.regularise(station_day(spark, d)), ["precip"], 0.3).select("station_id", "date", "precip", "precip_mask")


@query(
    "v13_missing_data_sweep",
    f"""WITH {RD}, {RR}, l AS (SELECT unnest([0.0, 0.1, 0.3, 0.5]) AS level), m AS (SELECT CAST(level AS DOUBLE) AS level, CASE WHEN {_LOST} < level OR precip IS NULL THEN 0.0 ELSE precip END AS v, precip AS truth FROM rr CROSS JOIN l)
SELECT level, round(avg(abs(v - truth)), 6) AS mae, round(avg(v - truth), 6) AS bias FROM m WHERE truth IS NOT NULL GROUP BY 1""",
)
def _(spark, d):
    daily = frames.regularise(region_day(spark, d)).filter("precip IS NOT NULL").withColumn("truth", F.col("precip"))
    error = F.col("precip") - F.col("truth")
    return studies.sweep(daily, [0.0, 0.1, 0.3, 0.5], lambda df: studies.masked_days(df, ["precip"], F.col("level")), lambda df, by: df.groupBy(*by).agg(F.avg(F.abs(error)).alias("mae"), F.avg(error).alias("bias")))


# ---- stations ----

_COMPLETE = f"""rc AS (SELECT st.station_id, coalesce(share, 0) AS completeness FROM st LEFT JOIN (SELECT station_id, avg(CASE WHEN precip IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM sr WHERE date BETWEEN DATE '{LOW}' AND DATE '{HIGH}' AND station_id <> 'NATION_3' GROUP BY 1) x ON x.station_id = st.station_id)"""


def _observed(spark, d):
    """All stations but one, which is then without observations."""
    return frames.regularise(station_day(spark, d)).filter("station_id <> 'NATION_3'")


@query("a29_reference_completeness", f"WITH {SD}, {SR}, {ST}, {_COMPLETE} SELECT station_id, round(completeness, 6) AS completeness FROM rc")
def _(spark, d):
    return studies.reference_completeness(_observed(spark, d), stations(spark, d), REFERENCE, "precip")


@query(
    "g3_static_features",
    f"""WITH {SD}, {SR}, {ST}, {_CELLS}, {_SEG}, {_COMPLETE},
n AS (SELECT c.row, c.col, c.value, dr, dc, coalesce(o.value, 0) AS v FROM cells c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dr) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc) LEFT JOIN cells o ON o.row = least(greatest(c.row + dr, 0), 8) AND o.col = least(greatest(c.col + dc, 0), 16)),
k AS (SELECT row, col, sum(dc * (2 - abs(dr)) * v) / (8 * 0.5 * 111320 * cos(radians(30.5 - (row + 0.5) * 0.5))) AS gx, sum(dr * (2 - abs(dc)) * v) / (8 * 0.5 * 111320) AS gy FROM n GROUP BY 1, 2),
s AS (SELECT row, col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (degrees(atan2(-gx, gy)) + 720) % 360 AS aspect FROM k),
rl AS (SELECT a.row, a.col, stddev_pop(b.value) AS relief FROM cells a JOIN cells b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2),
a AS (SELECT station_id, (x1 - lon) * 111.32 * cos(radians(lat)) AS ax, (y1 - lat) * 110.57 AS ay, (x2 - x1) * 111.32 * cos(radians(lat)) AS ux, (y2 - y1) * 110.57 AS uy FROM st CROSS JOIN seg),
t AS (SELECT *, greatest(0, least(1, -(ax * ux + ay * uy) / (ux * ux + uy * uy))) AS t FROM a),
rv AS (SELECT station_id, min(sqrt(pow(ax + t * ux, 2) + pow(ay + t * uy, 2))) AS km FROM t GROUP BY 1)
SELECT st.station_id, cells.value AS elevation, round(slope, 6) AS slope, round(relief, 6) AS relief, round(CASE WHEN slope IS NULL THEN NULL WHEN slope < 0.5 THEN 0 ELSE sin(radians(aspect)) END, 6) AS aspect_sin, round(CASE WHEN slope IS NULL THEN NULL WHEN slope < 0.5 THEN 0 ELSE cos(radians(aspect)) END, 6) AS aspect_cos,
 round(km, 6) AS river_km, CASE WHEN {_INSIDE['west']} THEN 'west' WHEN {_INSIDE['east']} THEN 'east' END AS zone, round(completeness, 6) AS completeness
FROM st LEFT JOIN cells ON cells.row = floor((30.5 - lat) / 0.5) AND cells.col = floor((lon - 80.0) / 0.5) LEFT JOIN s ON s.row = cells.row AND s.col = cells.col LEFT JOIN rl ON rl.row = cells.row AND rl.col = cells.col JOIN rv ON rv.station_id = st.station_id JOIN rc ON rc.station_id = st.station_id""",
)
def _(spark, d):
    segments = spark.createDataFrame(RIVER, "x1 double, y1 double, x2 double, y2 double")
    edges = spark.createDataFrame(geo.edges_of(BOX), geo.EDGES)
    return studies.static_features(stations(spark, d), _cells(spark, d), GRID, segments, edges, _observed(spark, d), REFERENCE, "precip")


@query(
    "j23_zone_of_observations",
    f"WITH {SD}, {ST}, z AS (SELECT station_id, CASE WHEN {_INSIDE['west']} THEN 'west' WHEN {_INSIDE['east']} THEN 'east' END AS zone FROM st) SELECT zone, count(DISTINCT sd.station_id) AS stations, count(precip) AS n_days, round(avg(precip), 6) AS mean_precip FROM sd JOIN z ON z.station_id = sd.station_id WHERE zone IS NOT NULL GROUP BY 1",
)
def _(spark, d):
    zones = geo.point_in_polygon(stations(spark, d), spark.createDataFrame(geo.edges_of(BOX), geo.EDGES)).select("station_id", F.col("attr").alias("zone")).filter("zone IS NOT NULL")
    # Aggregated by station before it meets the dimension.
    by_station = station_day(spark, d).groupBy("station_id").agg(F.count("precip").alias("n"), F.sum("precip").alias("s"))
    return by_station.join(F.broadcast(zones), "station_id").groupBy("zone").agg(F.count(F.lit(1)).alias("stations"), F.sum("n").alias("n_days"), (F.sum("s") / F.sum("n")).alias("mean_precip"))


_TRAIN = "tn AS (SELECT station_id FROM (" + _folds_sql("basin").replace("WITH " + ST + ", nm AS", "WITH nm AS") + ") WHERE fold = 'train')"


@query(
    "a28_normaliser_train_stations",
    f"""WITH {SD}, {ST}, {_TRAIN}, o AS (SELECT ln(1 + precip) AS precip, tmax FROM sd WHERE date BETWEEN DATE '{LOW}' AND DATE '{HIGH}' AND station_id IN (SELECT station_id FROM tn)), t AS (SELECT elevation_m, 3.0 AS level FROM st WHERE station_id IN (SELECT station_id FROM tn))
SELECT 'precip' AS variable, round(avg(precip), 6) AS mean, round(stddev_pop(precip) + 1e-6, 6) AS sd FROM o UNION ALL SELECT 'tmax', round(avg(tmax), 6), round(stddev_pop(tmax) + 1e-6, 6) FROM o
UNION ALL SELECT 'elevation_m', round(avg(elevation_m), 6), round(stddev_pop(elevation_m), 6) FROM t UNION ALL SELECT 'level', 3.0, 1.0""",
)
def _(spark, d):
    st = stations(spark, d)
    daily = station_day(spark, d).withColumn("precip", F.log1p("precip"))
    return studies.normaliser(daily, studies.folds_by_group(st, "basin"), REFERENCE, ["precip", "tmax"], st.select("station_id", "elevation_m", F.lit(3.0).alias("level")))


@query("p11_selected_station", f"WITH {SD} SELECT station_id, date, precip FROM sd WHERE station_id = 'NATION_3'")
def _(spark, d):
    chosen = studies.selected(stations(spark, d), "NATION_3").select("station_id")
    return station_day(spark, d).join(F.broadcast(chosen), "station_id", "left_semi").select("station_id", "date", "precip")


@query("s18_release_slice", f"WITH {SD} SELECT station_id, date, precip FROM sd WHERE date >= DATE '2000-06-01'")
def _(spark, d):
    from ..operators.materialize import shared_folder

    rows = station_day(spark, d).select("station_id", "date", "precip")
    return sinks.release_slice(rows, "2000-06-01", f"{shared_folder(spark)}/release")


# ---- tables side by side ----


@query(
    "j8_aligned_concat",
    f"WITH {SD}, a AS (SELECT year(date) AS year, count(*) AS wet FROM sd WHERE precip > 200 AND year(date) <> 1996 GROUP BY 1), b AS (SELECT year(date) AS year, count(*) AS days FROM sd WHERE year(date) <> 1998 GROUP BY 1) SELECT coalesce(a.year, b.year) AS year, wet, days, round(wet * 1.0 / days, 6) AS share FROM a FULL JOIN b ON a.year = b.year",
)
def _(spark, d):
    sd = station_day(spark, d).withColumn("year", F.year("date"))
    wet = sd.filter("precip > 200 AND year <> 1996").groupBy("year").agg(F.count(F.lit(1)).alias("wet"))
    days = sd.filter("year <> 1998").groupBy("year").agg(F.count(F.lit(1)).alias("days"))
    return studies.aligned(wet, days, ["year"]).withColumn("share", F.col("wet") / F.col("days"))


@query(
    "j22_parent_child",
    "SELECT o_orderkey, count(l_orderkey) AS n_children, coalesce(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS children FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def _(spark, d):
    parents = table(spark, d, "orders").select("o_orderkey")
    children = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag")
    both = studies.with_children(parents, children, "o_orderkey", ["l_linenumber", "l_returnflag"], "lines")
    said = F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_returnflag"])), ",")
    return both.select("o_orderkey", F.size("lines").cast("long").alias("n_children"), said.alias("children"))


# ---- transitions over time ----


def mann_kendall_sql(source: str, prewhiten: bool) -> str:
    """SQL of views that end in mk (key, s, z, p_value, tau, sens_slope) of the rows key, t, x of a view."""
    first, used = "", source
    if prewhiten:
        used = "pw"
        first = f"""ps AS (SELECT a.key, median((b.x - a.x) / (b.t - a.t)) AS slope FROM {source} a JOIN {source} b ON a.key = b.key AND a.t < b.t GROUP BY 1),
pd0 AS (SELECT s.key, s.t, s.x, slope, s.x - coalesce(slope, 0) * s.t AS d FROM {source} s LEFT JOIN ps ON ps.key = s.key),
pd1 AS (SELECT *, lag(d) OVER (PARTITION BY key ORDER BY t) AS before FROM pd0),
pr0 AS (SELECT key, corr(d, before) AS r, count(*) AS n FROM pd1 GROUP BY 1),
pd2 AS (SELECT pd1.*, r, coalesce(n > 10 AND abs(r) > 1.96 / sqrt(n), false) AS is_on FROM pd1 JOIN pr0 ON pr0.key = pd1.key),
pw AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS t, CASE WHEN is_on THEN d - r * before + slope * t ELSE x END AS x FROM pd2 WHERE NOT is_on OR before IS NOT NULL), """
    p = specfun.gamma_p_sql("0.5", "greatest(z * z / 2, 1e-300)")
    return f"""{first}mp AS (SELECT a.key, a.t, a.x, b.t AS u, b.x AS y FROM {used} a JOIN {used} b ON a.key = b.key AND a.t < b.t),
ms AS (SELECT key, sum(sign(y - x)) AS s, median((y - x) / (u - t)) AS sens_slope FROM mp GROUP BY 1),
mt AS (SELECT key, sum(c) * 1.0 AS n, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT key, x, count(*) AS c FROM {used} GROUP BY 1, 2) GROUP BY 1),
mz AS (SELECT ms.*, n, CASE WHEN s <> 0 AND n * (n - 1) * (2 * n + 5) > tie THEN (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tie) / 18.0) ELSE 0.0 END AS z FROM ms JOIN mt ON mt.key = ms.key),
mk AS (SELECT key, CAST(s AS DOUBLE) AS s, z, 1 - {p} AS p_value, s / (0.5 * n * (n - 1)) AS tau, sens_slope FROM mz)"""


_MK = "key, s, round(z, 6) AS z, round(p_value, 6) AS p_value, round(tau, 6) AS tau, round(sens_slope, 6) AS sens_slope"


@query(
    "t14_whiplash_trend",
    f"""{_WHIPLASH}, {_SY}, m AS (SELECT year, count(*) AS n_events FROM full_ev JOIN sy ON sy.station_id = full_ev.station_id AND sy.year = year(transition_date) GROUP BY 1),
an AS (SELECT 'all' AS key, row_number() OVER (ORDER BY c.year) - 1 AS t, coalesce(n_events, 0) * 1.0 / station_years AS x FROM (SELECT year, count(*) AS station_years FROM sy GROUP BY 1) c LEFT JOIN m ON m.year = c.year), {mann_kendall_sql('an', True)} SELECT {_MK} FROM mk""",
)
def _(spark, d):
    daily, ev = _swings(spark, d)
    annual = events.annual_metrics(ev, events.station_years(daily)).withColumn("network", F.lit("all"))
    return stats.mann_kendall(stats.indexed(annual, "network", "year", "frequency_per_station_year")).withColumn("s", F.col("s").cast("double"))


_COUNTS = f"""{_WHIPLASH}, {_SY}, ey AS (SELECT station_id, year(transition_date) AS year, count(*) AS n FROM full_ev GROUP BY 1, 2),
cy AS (SELECT sy.station_id, sy.year, coalesce(n, 0) AS n_events FROM sy LEFT JOIN ey ON ey.station_id = sy.station_id AND ey.year = sy.year)"""


@query("j3_left_fill_zero_events", f"{_COUNTS} SELECT station_id, year, n_events FROM cy")
def _(spark, d):
    daily, ev = _swings(spark, d)
    return events.station_year_counts(ev, events.station_years(daily))


@query(
    "t14_station_trends",
    f"""{_COUNTS}, sr0 AS (SELECT station_id AS key, row_number() OVER (PARTITION BY station_id ORDER BY year) - 1 AS t, n_events * 1.0 AS x, count(*) OVER (PARTITION BY station_id) AS m FROM cy),
sr1 AS (SELECT key, t, x FROM sr0 WHERE m >= 5), {mann_kendall_sql('sr1', False)},
rk AS (SELECT *, row_number() OVER (ORDER BY p_value, key) AS r, count(*) OVER () AS m FROM mk), kk AS (SELECT max(CASE WHEN p_value <= 0.05 * r / m THEN r END) AS k FROM rk)
SELECT {_MK}, coalesce(r <= k, false) AS significant_fdr FROM rk CROSS JOIN kk""",
)
def _(spark, d):
    daily, ev = _swings(spark, d)
    return events.station_trends(ev, events.station_years(daily), least_years=5).withColumn("s", F.col("s").cast("double"))


@query(
    "a20_decadal_table",
    f"""{_WHIPLASH}, {_SY}, pe AS (SELECT * FROM (VALUES ('1995-1997', 1995, 1997), ('1998-2001', 1998, 2001)) t(period, low, high)),
pv AS (SELECT period, direction, intensity_spi_swing AS i FROM full_ev JOIN sy ON sy.station_id = full_ev.station_id AND sy.year = year(transition_date) JOIN pe ON sy.year BETWEEN low AND high),
np AS (SELECT period, count(*) AS station_years FROM sy JOIN pe ON year BETWEEN low AND high GROUP BY 1),
nc AS (SELECT period, count(*) AS n_events, count(CASE WHEN direction = 'dry_to_wet' THEN 1 END) AS dry_to_wet, count(CASE WHEN direction = 'wet_to_dry' THEN 1 END) AS wet_to_dry, avg(i) AS mean_intensity FROM pv GROUP BY 1)
SELECT np.period, station_years, coalesce(n_events, 0) AS n_events, coalesce(dry_to_wet, 0) AS dry_to_wet, coalesce(wet_to_dry, 0) AS wet_to_dry, round(mean_intensity, 6) AS mean_intensity, round(coalesce(n_events, 0) * 1.0 / station_years, 6) AS rate FROM np LEFT JOIN nc ON nc.period = np.period""",
)
def _(spark, d):
    daily, ev = _swings(spark, d)
    return events.decadal_table(ev, events.station_years(daily), [("1995-1997", 1995, 1997), ("1998-2001", 1998, 2001)])



@query("t5_mann_kendall_prewhitened", f"{_MONTHS}, {mann_kendall_sql('s', True)} SELECT {_MK} FROM mk".replace("row_number() OVER (PARTITION BY key ORDER BY m) - 1 AS t, x", "row_number() OVER (PARTITION BY key ORDER BY m) - 1 AS t, CAST(x AS DOUBLE) AS x"))
def _(spark, d):
    return stats.mann_kendall(_months(spark, d)).withColumn("s", F.col("s").cast("double"))


_ANNUAL = "an AS (SELECT station_id, year(date) AS year, CASE WHEN count({v}) * 1.0 / count(*) >= {least} THEN {how} END AS v FROM {src} GROUP BY 1, 2)"


def _trend_sql(v: str, how: str) -> str:
    annual = _ANNUAL.format(v=v, least=0.8, src="rr", how=how)
    return f"""SELECT * FROM (WITH {annual}, ok AS (SELECT station_id AS key, year, v, row_number() OVER (PARTITION BY station_id ORDER BY year) - 1 AS t, count(*) OVER (PARTITION BY station_id) AS m FROM an WHERE v IS NOT NULL),
sx AS (SELECT key, t, v AS x, year, m FROM ok WHERE m >= 5), {mann_kendall_sql('sx', True)}, sl AS (SELECT a.key, median((b.x - a.x) / (b.year - a.year)) AS slope FROM sx a JOIN sx b ON a.key = b.key AND a.year < b.year GROUP BY 1),
rk AS (SELECT mk.*, slope, (SELECT max(m) FROM sx WHERE sx.key = mk.key) AS m, row_number() OVER (ORDER BY p_value, mk.key) AS r, count(*) OVER () AS c FROM mk JOIN sl ON sl.key = mk.key), kk AS (SELECT max(CASE WHEN p_value <= 0.05 * r / c THEN r END) AS k FROM rk)
SELECT key AS station_id, '{v}' AS variable, m AS n_years, round(slope, 6) AS sens_slope_per_year, round(z, 6) AS mk_z, round(p_value, 6) AS p_value, round(tau, 6) AS tau, coalesce(r <= k, false) AS significant_fdr FROM rk CROSS JOIN kk)"""


@query("t13_trend_report", f"WITH {RD}, {RR} {_trend_sql('precip', 'sum(precip) / (count(precip) * 1.0 / count(*))')} UNION ALL {_trend_sql('tmax', 'avg(tmax)')}")
def _(spark, d):
    return homogeneity.trends(_daily(spark, d), ["precip", "tmax"], least_years=5)


@query(
    "j16_reference_neighbours",
    f"""WITH {SD}, {SR}, {ST}, {_ANNUAL.format(v='tmax', least=0.5, src='sr', how='avg(tmax)')}, ok AS (SELECT * FROM an WHERE v IS NOT NULL),
nr AS (SELECT a.station_id, b.station_id AS other, {_KM} AS km FROM st a JOIN st b ON a.station_id <> b.station_id),
pr AS (SELECT nr.station_id, other, km, x.year, x.v - lag(x.v) OVER w AS dv, y.v - lag(y.v) OVER w AS dw FROM nr JOIN ok x ON x.station_id = nr.station_id JOIN ok y ON y.station_id = other AND y.year = x.year WHERE km <= 400 WINDOW w AS (PARTITION BY nr.station_id, other ORDER BY x.year)),
sg AS (SELECT station_id, other, km, corr(dv, dw) AS r, count(*) AS n FROM pr GROUP BY 1, 2, 3),
ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY km, other) AS k FROM sg WHERE n >= 4 AND r > 0.2) WHERE k <= 5)
SELECT ch.station_id, year, round(sum(r * r * v) / sum(r * r), 6) AS reference, count(*) AS n_references FROM ch JOIN ok ON ok.station_id = ch.other GROUP BY 1, 2""",
)
def _(spark, d):
    annual = homogeneity.annual_series(frames.regularise(station_day(spark, d)), "tmax", 0.5)
    return homogeneity.reference_series(annual, stations(spark, d), "tmax", max_km=400.0, overlap=4)


def _share(condition: str, valid: str) -> str:
    return f"round(100 * avg(CASE WHEN {valid} THEN CASE WHEN {condition} THEN 1.0 ELSE 0.0 END END), 3)"


_P, _X = "precip IS NOT NULL", "tmax IS NOT NULL"


@query(
    "a7_event_summary",
    f"""{_LABELS}, s30 AS (SELECT * FROM (WITH {indices.spi_sql('rr', REFERENCE, 30)} SELECT station_id, date, spi AS spi30 FROM spi)), s90 AS (SELECT * FROM (WITH {indices.spi_sql('rr', REFERENCE, 90)} SELECT station_id, date, spi AS spi90 FROM spi)),
al AS (SELECT v.*, spi30, spi90 FROM v LEFT JOIN s30 ON s30.station_id = v.station_id AND s30.date = v.date LEFT JOIN s90 ON s90.station_id = v.station_id AND s90.date = v.date)
SELECT station_id, """
    + ", ".join(
        f"{_share(c, w)} AS {n}"
        for n, c, w in (
            ("extreme_wet_day", "precip > p95_wet", _P), ("very_extreme_wet_day", "precip > p99_wet", _P), ("extreme_rainfall_event", "three > p99_3day", "three IS NOT NULL"), ("consecutive_wet_days", "wr >= 5", _P),
            ("rainfall_persistence", "wd >= 8", "wd IS NOT NULL"), ("dry_spell", "dr >= 15", _P), ("precipitation_deficit", "spi30 <= -1", "spi30 IS NOT NULL"), ("meteorological_drought", "spi90 <= -1", "spi90 IS NOT NULL"),
            ("hot_day", "tmax > tx", _X), ("warm_spell", "hr >= 3", _X), ("cold_night", "tmin < tn", "tmin IS NOT NULL"), ("hot_dry", "tmax > tx AND spi30 <= -1", f"{_X} AND spi30 IS NOT NULL"),
            ("wet_hot", "precip > p95_wet AND tmax > tx", f"{_P} AND {_X}"), ("rain_after_dryness", "precip > p95_wet AND before >= 20", f"{_P} AND before IS NOT NULL"),
        )
    )
    + " FROM al GROUP BY 1",
)
def _(spark, d):
    return events.event_summary(events.label_events(_daily(spark, d), REFERENCE, SETTINGS))


# ---- records ----


@query("o6_most_recent", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return platform.most_recent(rows, ["user_id"], "ts", "event_id")


@query("q8_compare_experiments", "SELECT CAST(o_custkey % 7 AS VARCHAR) AS experiment, o_orderpriority AS model, o_orderstatus AS split, CAST(o_totalprice AS DOUBLE) AS value FROM orders WHERE o_custkey % 7 IN (1, 2)")
def _(spark, d):
    metrics_ = F.create_map(F.lit("price"), F.col("o_totalprice").cast("double"))
    runs = table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("string").alias("experiment"), F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("split"), metrics_.alias("metrics"))
    return platform.compared(runs, ["1", "2"], "price")


_GROUPED = ", ".join(f"('{g}', '{e}')" for g, names in events.GROUPS.items() for e in names)


@query(
    "e19_event_groups",
    f"""{_LABELS}, lb AS (SELECT 'extreme_wet_day' AS event, precip > p95_wet AS on_, precip IS NOT NULL AS known FROM v UNION ALL SELECT 'dry_spell', dr >= 15, precip IS NOT NULL FROM v UNION ALL SELECT 'hot_day', tmax > tx, tmax IS NOT NULL FROM v UNION ALL SELECT 'wet_hot', precip > p95_wet AND tmax > tx, precip IS NOT NULL AND tmax IS NOT NULL FROM v)
SELECT gr."group", event, count(CASE WHEN known THEN 1 END) AS n_days, count(CASE WHEN known AND on_ THEN 1 END) AS n_events FROM lb JOIN (SELECT * FROM (VALUES {_GROUPED}) t("group", event)) gr USING (event) GROUP BY 1, 2""",
)
def _(spark, d):
    labeled = events.label_events(_daily(spark, d), REFERENCE, SETTINGS)
    return events.grouped(labeled, ["extreme_wet_day", "dry_spell", "hot_day", "wet_hot"])


# ---- larger tables ----

_PLACES = """pl AS (SELECT c_custkey AS station_id, 26.0 + (c_custkey * 37 % 4201) / 1000.0 AS lat, 80.0 + (c_custkey * 53 % 8311) / 1000.0 AS lon FROM customer),
qu AS (SELECT s_suppkey AS query, 26.0 + (s_suppkey * 911 % 4201) / 1000.0 AS qlat, 80.0 + (s_suppkey * 577 % 8311) / 1000.0 AS qlon FROM supplier)"""


@query(
    "j13_knn_customers",
    f"""WITH {_PLACES}, r AS (SELECT query, station_id, {_KM.replace("a.lat", "qlat").replace("a.lon", "qlon").replace("b.lat", "lat").replace("b.lon", "lon")} AS km FROM qu CROSS JOIN pl)
SELECT query, station_id, round(km, 6) AS km, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY km, station_id) AS rank FROM r) WHERE rank <= 5""",
)
def _(spark, d):
    """The five nearest customers of each supplier, on places made from their keys."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    places = table(spark, d, "customer").select(c.alias("station_id"), (26.0 + (c * 37 % 4201) / 1000.0).alias("lat"), (80.0 + (c * 53 % 8311) / 1000.0).alias("lon"))
    asked = table(spark, d, "supplier").select(s.alias("query"), (26.0 + (s * 911 % 4201) / 1000.0).alias("qlat"), (80.0 + (s * 577 % 8311) / 1000.0).alias("qlon"))
    return geo.nearest_k(asked, places, 5)


@query("a5_whole_table_quantiles", "SELECT round(quantile_cont(l_extendedprice, 0.5), 6) AS half, round(quantile_cont(l_extendedprice, 0.9), 6) AS most, round(quantile_cont(l_extendedprice, 0.999), 6) AS top FROM lineitem")
def _(spark, d):
    return frames.quantiles(table(spark, d, "lineitem").select(F.col("l_extendedprice").cast("double").alias("x")), "x", {"half": 0.5, "most": 0.9, "top": 0.999})


#: Transverse Mercator in plain SQL: series of the third flattening n, around the middle meridian of zone 45 (87 degrees).
_UTM = """k AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n),
a AS (SELECT *, 6378137.0 / (1 + n) * (1 + n * n / 4 + pow(n, 4) / 64) * 0.9996 AS r, 2 * sqrt(n) / (1 + n) AS c, n / 2 - 2 * n * n / 3 + 5 * pow(n, 3) / 16 + 41 * pow(n, 4) / 180 AS a1, 13 * n * n / 48 - 3 * pow(n, 3) / 5 + 557 * pow(n, 4) / 1440 AS a2, 61 * pow(n, 3) / 240 - 103 * pow(n, 4) / 140 AS a3, 49561 * pow(n, 4) / 161280 AS a4 FROM k),
u AS (SELECT station_id, radians(lon - 87) AS d, sin(radians(lat)) AS s, a.* FROM st CROSS JOIN a),
t AS (SELECT *, sinh(atanh(s) - c * atanh(c * s)) AS t FROM u),
e AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)"""


@query(
    "g5_utm",
    f"""WITH {ST}, {_UTM} SELECT station_id,
 round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 4) AS easting,
 round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 4) AS northing, 0.0::DOUBLE AS off_mm FROM e""",
)
def _(spark, d):
    """Stations in UTM zone 45 north, and how far the way back misses, in whole millimetres."""
    st = stations(spark, d)
    there = geo.reproject(st, "EPSG:4326", "EPSG:32645")
    back = geo.reproject(there, "EPSG:32645", "EPSG:4326").select("station_id", F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    both = there.select("station_id", F.col("lon").alias("easting"), F.col("lat").alias("northing")).join(back, "station_id").join(st, "station_id")
    miss = F.round(scalars.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")) * 1e6)
    return both.select("station_id", F.round("easting", 4).alias("easting"), F.round("northing", 4).alias("northing"), miss.alias("off_mm"))
