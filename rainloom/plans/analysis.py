"""Indices, events, statistics, geography, scores and models as registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, specfun
from ..operators import events, frames, geo, homogeneity, indices, metrics, models, qc, stats, studies
from ..operators.materialize import once
from .basics import CALENDAR
from .surrogate import RD, REFERENCE, RR, SD, ST, query, region_day, station_day, stations, table

LOW, HIGH = REFERENCE
#: Cuts on the scale of the stand-in data.
SETTINGS = {"wet": 150.0}
LIMITS = {"precip_max": 800.0, "temp_max": 104.0, "temp_min": 0.95, "max_jump": 25.0, "robust_z": 4.0, "stuck_days": 2, "outlier_factor": 1.0, "unit_error_ratio": 1.05, "wet": 150.0}
W = "OVER (PARTITION BY station_id ORDER BY date"
RUN = "CASE WHEN {p} IS NOT NULL THEN sum(o) OVER (PARTITION BY station_id, g ORDER BY date) END"


def _daily(spark, d):
    return frames.regularise(region_day(spark, d))


# ---- quality control ----

def _z_sql(v: str) -> str:
    """SQL views that add the robust z, the jump and the repetition of a variable to c_before, as c_v."""
    before = "rr" if v == "tmax" else "c_tmax"
    return f"""{v}0 AS (SELECT *, median({v}) OVER (PARTITION BY station_id, dayofyear(date)) AS m_{v} FROM {before}),
{v}1 AS (SELECT *, {v} - avg(m_{v}) {W} ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS a_{v} FROM {v}0),
{v}2 AS (SELECT *, median(a_{v}) OVER (PARTITION BY station_id) AS med_{v} FROM {v}1),
c_{v} AS (SELECT *, (a_{v} - med_{v}) / (1.4826 * median(abs(a_{v} - med_{v})) OVER (PARTITION BY station_id) + 1e-6) AS z_{v}, abs({v} - lag({v}) {W})) AS jump_{v}, coalesce({v} = lag({v}) {W}), false) AS same_{v} FROM {v}2)"""


_CASCADE = f"""WITH {RD}, {RR},
ratio0 AS (SELECT station_id, year(date) AS y, CASE WHEN count(precip) >= 200 THEN sum(greatest(precip, 0)) END AS total FROM rr GROUP BY 1, 2),
ratio AS (SELECT station_id, y, total / median(total) OVER (PARTITION BY station_id) AS ratio FROM ratio0),
p9 AS (SELECT station_id, quantile_cont(precip, 0.999) AS p999 FROM rr WHERE precip > 150 GROUP BY 1),
{_z_sql('tmax')}, {_z_sql('tmin')},
c AS (SELECT c_tmin.*, 50 + precip / 10 - tmax AS rh, ratio, p999 FROM c_tmin LEFT JOIN ratio ON ratio.station_id = c_tmin.station_id AND ratio.y = year(date) LEFT JOIN p9 ON p9.station_id = c_tmin.station_id)"""


def _observed(spark, d):
    """Region days with a humidity, made up on the scale of the others."""
    return region_day(spark, d).withColumn("rh", 50 + F.col("precip") / 10 - F.col("tmax"))


def _flag_sql(v: str) -> str:
    return f"CAST(CASE WHEN {v} IS NULL THEN 3 WHEN {v} < 0.95 OR {v} > 104 OR tmax < tmin THEN 2 WHEN coalesce(jump_{v} > 25, false) OR coalesce(abs(z_{v}) > 4, false) OR same_{v} THEN 1 ELSE 0 END AS INTEGER)"


@query(
    "p4_p8_qc_flag_cascade",
    _CASCADE
    + f""" SELECT station_id, date,
CAST(CASE WHEN precip IS NULL THEN 3 WHEN precip < 0 OR precip > 800 OR coalesce(ratio > 1.05, false) THEN 2 WHEN coalesce(precip > 1.0 * p999, false) THEN 1 ELSE 0 END AS INTEGER) AS precip_flag,
{_flag_sql('tmax')} AS tmax_flag, {_flag_sql('tmin')} AS tmin_flag, CAST(CASE WHEN rh IS NULL THEN 3 WHEN rh < 0 OR rh > 100 THEN 2 ELSE 0 END AS INTEGER) AS rh_flag,
round(CASE WHEN precip < 0 OR precip > 800 OR coalesce(ratio > 1.05, false) THEN NULL ELSE precip END, 6) AS precip_qc,
round(CASE WHEN tmin < 0.95 OR tmin > 104 OR tmax < tmin THEN NULL ELSE tmin END, 6) AS tmin_qc, round(CASE WHEN rh < 0 OR rh > 100 THEN NULL ELSE rh END, 6) AS rh_qc FROM c""",
)
def _(spark, d):
    done = qc.run_qc(_observed(spark, d), LIMITS).observations
    return done.select("station_id", "date", *(F.col(f"{v}_flag").cast("int").alias(f"{v}_flag") for v in ("precip", "tmax", "tmin", "rh")), "precip_qc", "tmin_qc", "rh_qc")


def _emitted_sql(v: str) -> str:
    """SQL of the flags that the cascade of a temperature says: the first suspicion, then the first error."""
    error = f"CASE WHEN {v} < 0.95 OR {v} > 104 THEN 'temperature_out_of_range' WHEN tmax < tmin THEN 'tmax_lt_tmin' END"
    doubt = f"CASE WHEN {v} < 0.95 OR {v} > 104 THEN NULL WHEN jump_{v} > 25 THEN 'abrupt_jump' WHEN abs(z_{v}) > 4 THEN 'robust_z_spike' WHEN same_{v} THEN 'repeated_values' END"
    return f"SELECT station_id, date, '{v}' AS variable, unnest([{error}, {doubt}]) AS flag FROM c WHERE {v} IS NOT NULL"


_FLAGS = (
    _CASCADE
    + f""", r AS (SELECT station_id, date, precip, precip < 0 AS e1, precip > 800 AS e2, coalesce(ratio > 1.05, false) AS e3, coalesce(precip > 1.0 * p999, false) AS s1 FROM c WHERE precip IS NOT NULL),
said AS (SELECT station_id, date, 'precip' AS variable, CASE WHEN e1 THEN 'negative_precip' WHEN e2 THEN 'precip_above_max' WHEN e3 THEN 'suspected_unit_error' WHEN s1 THEN 'precip_outlier' END AS flag FROM r
UNION ALL {_emitted_sql('tmax')} UNION ALL {_emitted_sql('tmin')} UNION ALL SELECT station_id, date, 'rh', CASE WHEN rh < 0 OR rh > 100 THEN 'rh_out_of_range' END FROM c),
fl AS (SELECT station_id, date, variable, flag, CASE WHEN flag IN ('precip_outlier', 'abrupt_jump', 'robust_z_spike', 'repeated_values') THEN 'suspicious' ELSE 'error' END AS severity FROM said WHERE flag IS NOT NULL)"""
)


@query("p6_p7_qc_flags", f"{_FLAGS} SELECT * FROM fl")
def _(spark, d):
    return qc.run_qc(_observed(spark, d), LIMITS).flags.select("station_id", "date", "variable", "flag", "severity")


@query("p6_qc_flags_precip", f"{_FLAGS} SELECT * FROM fl WHERE variable = 'precip'")
def _(spark, d):
    return qc.run_qc(region_day(spark, d), LIMITS).flags.filter("variable = 'precip'").select("station_id", "date", "variable", "flag", "severity")


@query("p4_qc_audit", f"{_FLAGS}, v AS (SELECT station_id, date, 'precip' AS variable, precip AS original FROM c UNION ALL SELECT station_id, date, 'tmax', tmax FROM c UNION ALL SELECT station_id, date, 'tmin', tmin FROM c UNION ALL SELECT station_id, date, 'rh', rh FROM c) SELECT fl.station_id, CAST(fl.date AS VARCHAR) AS date, fl.variable, round(original, 6) AS original, CASE WHEN severity = 'suspicious' THEN 'unchanged' END AS corrected, flag FROM fl JOIN v ON v.station_id = fl.station_id AND v.date = fl.date AND v.variable = fl.variable")
def _(spark, d):
    return qc.run_qc(_observed(spark, d), LIMITS).audit.select("station_id", "date", "variable", "original", "corrected", "flag")


_MISSED = {"precip": "precip < 0 OR precip > 800 OR coalesce(ratio > 1.05, false)", "tmax": "tmax < 0.95 OR tmax > 104 OR tmax < tmin", "tmin": "tmin < 0.95 OR tmin > 104 OR tmax < tmin", "rh": "rh < 0 OR rh > 100"}


@query(
    "a10_qc_summary",
    f"{_FLAGS} SELECT 'flag ' || flag AS measure, CAST(count(*) AS DOUBLE) AS value FROM fl GROUP BY 1 UNION ALL SELECT 'severity ' || severity, CAST(count(*) AS DOUBLE) FROM fl GROUP BY 1"
    + "".join(f" UNION ALL SELECT 'missing {v}', round(100 * avg(CASE WHEN {v} IS NULL OR {w} THEN 1.0 ELSE 0.0 END), 2) FROM c" for v, w in _MISSED.items()),
)
def _(spark, d):
    return qc.run_qc(_observed(spark, d), LIMITS).summary


# ---- thresholds, labels, indices ----

_THR = f"""t3 AS (SELECT *, CASE WHEN count(precip) {W} ROWS 2 PRECEDING) = 3 THEN sum(precip) {W} ROWS 2 PRECEDING) END AS three FROM (SELECT * FROM rr WHERE date BETWEEN DATE '{LOW}' AND DATE '{HIGH}')),
thr AS (SELECT station_id, count(precip) AS n_ref_days, count(CASE WHEN precip >= 150 THEN 1 END) AS n_ref_wet_days,
 CASE WHEN count(CASE WHEN precip >= 150 THEN 1 END) > 50 THEN quantile_cont(CASE WHEN precip >= 150 THEN precip END, 0.95) END AS p95_wet,
 CASE WHEN count(CASE WHEN precip >= 150 THEN 1 END) > 50 THEN quantile_cont(CASE WHEN precip >= 150 THEN precip END, 0.99) END AS p99_wet,
 CASE WHEN count(three) > 365 THEN quantile_cont(three, 0.99) END AS p99_3day FROM t3 GROUP BY 1)"""


@query("a3_fit_thresholds", f"WITH {RD}, {RR}, {_THR} SELECT station_id, n_ref_days, n_ref_wet_days, round(p95_wet, 6) AS p95_wet, round(p99_wet, 6) AS p99_wet, round(p99_3day, 6) AS p99_3day FROM thr")
def _(spark, d):
    return events.fit_thresholds(_daily(spark, d), REFERENCE, SETTINGS)


_HOT = CALENDAR.format(name="hot", v="tmax", q=0.9, low=LOW, high=HIGH)
_COLD = CALENDAR.format(name="cold", v="tmin", q=0.1, low=LOW, high=HIGH)
_LABELS = f"""WITH {RD}, {RR}, {_THR}, {_HOT}, {_COLD},
b AS (SELECT rr.*, p95_wet, p99_wet, p99_3day, hot.threshold AS tx, cold.threshold AS tn FROM rr LEFT JOIN thr ON thr.station_id = rr.station_id
 LEFT JOIN hot ON hot.station_id = rr.station_id AND hot.doy = dayofyear(date) LEFT JOIN cold ON cold.station_id = rr.station_id AND cold.doy = dayofyear(date)),
w AS (SELECT *, sum(CASE WHEN precip >= 150 THEN 0 ELSE 1 END) {W}) AS gw, sum(CASE WHEN precip < 150 THEN 0 ELSE 1 END) {W}) AS gd, sum(CASE WHEN tmax > tx THEN 0 ELSE 1 END) {W}) AS gh,
 CASE WHEN count(precip) {W} ROWS 2 PRECEDING) = 3 THEN sum(precip) {W} ROWS 2 PRECEDING) END AS three,
 CASE WHEN count(precip) {W} ROWS 9 PRECEDING) = 10 THEN sum(CASE WHEN precip >= 150 THEN 1 ELSE 0 END) {W} ROWS 9 PRECEDING) END AS wd FROM b),
r AS (SELECT *, CASE WHEN precip IS NOT NULL THEN sum(CASE WHEN precip >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, gw ORDER BY date) END AS wr,
 CASE WHEN precip IS NOT NULL THEN sum(CASE WHEN precip < 150 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, gd ORDER BY date) END AS dr,
 CASE WHEN tmax > tx THEN sum(CASE WHEN tmax > tx THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, gh) ELSE 0 END AS hr FROM w),
v AS (SELECT *, lag(dr) {W}) AS before FROM r)"""


def _l(condition: str, valid: str, name: str) -> str:
    return f"CASE WHEN {valid} THEN CASE WHEN {condition} THEN 1.0 ELSE 0.0 END END::DOUBLE AS {name}"


_P = "precip IS NOT NULL"


@query(
    "e_event_labels",
    f"{_LABELS} SELECT station_id, date, "
    + ", ".join(
        [
            _l("precip > p95_wet", _P, "extreme_wet_day"), _l("precip > p99_wet", _P, "very_extreme_wet_day"), _l("three > p99_3day", "three IS NOT NULL", "extreme_rainfall_event"),
            _l("wr >= 5", _P, "consecutive_wet_days"), _l("wd >= 8", "wd IS NOT NULL", "rainfall_persistence"), _l("dr >= 15", _P, "dry_spell"), _l("tmax > tx", "tmax IS NOT NULL", "hot_day"),
            _l("hr >= 3", "tmax IS NOT NULL", "warm_spell"), _l("tmin < tn", "tmin IS NOT NULL", "cold_night"), _l("precip > p95_wet AND tmax > tx", "precip IS NOT NULL AND tmax IS NOT NULL", "wet_hot"),
            _l("precip > p95_wet AND before >= 20", "precip IS NOT NULL AND before IS NOT NULL", "rain_after_dryness"),
        ]
    )
    + ", CAST(wr AS BIGINT) AS wet_spell_len, CAST(dr AS BIGINT) AS dry_spell_len FROM v",
)
def _(spark, d):
    labeled = events.label_events(_daily(spark, d), REFERENCE, SETTINGS)
    names = [e for e in events.EVENTS if e not in ("precipitation_deficit", "meteorological_drought", "hot_dry")]
    return labeled.select("station_id", "date", *names, "wet_spell_len", "dry_spell_len")


_SPI30 = f"WITH {RD}, {RR}, {indices.spi_sql('rr', REFERENCE, 30)}"


@query("e1_spi30", f"{_SPI30} SELECT station_id, date, round(spi, 6) AS spi30 FROM spi")
def _(spark, d):
    return indices.spi(_daily(spark, d), REFERENCE, 30).select("station_id", "date", "spi30")


@query("e1_spi90", f"WITH {RD}, {RR}, {indices.spi_sql('rr', REFERENCE, 90)} SELECT station_id, date, round(spi, 6) AS spi90 FROM spi")
def _(spark, d):
    return indices.spi(_daily(spark, d), REFERENCE, 90).select("station_id", "date", "spi90")


@query(
    "e10_meteorological_drought",
    f"WITH {RD}, {RR}, {indices.spi_sql('rr', REFERENCE, 90)} SELECT station_id, date, {_l('spi <= -1', 'spi IS NOT NULL', 'meteorological_drought')} FROM spi",
)
def _(spark, d):
    return events.label_events(_daily(spark, d), REFERENCE, SETTINGS).select("station_id", "date", "meteorological_drought")


@query(
    "e9_e14_deficit_labels",
    f"{_SPI30}, {_HOT} SELECT spi.station_id, spi.date, {_l('spi <= -1', 'spi IS NOT NULL', 'precipitation_deficit')}, {_l('spi <= -1 AND tmax > hot.threshold', 'spi IS NOT NULL AND tmax IS NOT NULL', 'hot_dry')} FROM spi JOIN rr ON rr.station_id = spi.station_id AND rr.date = spi.date LEFT JOIN hot ON hot.station_id = spi.station_id AND hot.doy = dayofyear(spi.date)",
)
def _(spark, d):
    return events.label_events(_daily(spark, d), REFERENCE, SETTINGS).select("station_id", "date", "precipitation_deficit", "hot_dry")


@query("e2_spei")
def _(spark, d):
    daily = _daily(spark, d)
    pet = scalars.hargreaves_pet(F.col("tmax"), F.col("tmin"), F.dayofyear("date"), F.lit(28.0))
    return indices.spei(daily, pet, REFERENCE)


@query(
    "a6_etccdi_annual",
    f"""WITH {RD}, {RR}, {_THR}, {_HOT}, {_COLD},
y AS (SELECT rr.*, year(date) AS year, p95_wet, hot.threshold AS tx, cold.threshold AS tn, sum(CASE WHEN precip < 150 THEN 0 ELSE 1 END) OVER (PARTITION BY rr.station_id, year(date) ORDER BY date) AS gd, sum(CASE WHEN precip >= 150 THEN 0 ELSE 1 END) OVER (PARTITION BY rr.station_id, year(date) ORDER BY date) AS gw,
 CASE WHEN count(precip) OVER (PARTITION BY rr.station_id, year(date) ORDER BY date ROWS 4 PRECEDING) = 5 THEN sum(precip) OVER (PARTITION BY rr.station_id, year(date) ORDER BY date ROWS 4 PRECEDING) END AS five
 FROM rr LEFT JOIN thr ON thr.station_id = rr.station_id LEFT JOIN hot ON hot.station_id = rr.station_id AND hot.doy = dayofyear(date) LEFT JOIN cold ON cold.station_id = rr.station_id AND cold.doy = dayofyear(date)),
q AS (SELECT *, sum(CASE WHEN precip < 150 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, year, gd ORDER BY date) AS dr, sum(CASE WHEN precip >= 150 THEN 1 ELSE 0 END) OVER (PARTITION BY station_id, year, gw ORDER BY date) AS wr FROM y)
SELECT station_id, year, round(count(precip) * 1.0 / count(*), 6) AS completeness, round(coalesce(sum(CASE WHEN precip >= 150 THEN precip END), 0), 6) AS "PRCPTOT", round(avg(CASE WHEN precip >= 150 THEN precip END), 6) AS "SDII",
count(CASE WHEN precip >= 300 THEN 1 END) AS "R10mm", count(CASE WHEN precip >= 400 THEN 1 END) AS "R20mm", max(precip) AS "Rx1day", max(five) AS "Rx5day", CAST(max(dr) AS BIGINT) AS "CDD", CAST(max(wr) AS BIGINT) AS "CWD", round(max(tmax), 6) AS "TXx", round(min(tmin), 6) AS "TNn",
coalesce(sum(CASE WHEN precip > p95_wet THEN precip END), 0) AS "R95pTOT", round(100 * avg(CASE WHEN tmax IS NOT NULL AND tx IS NOT NULL THEN CASE WHEN tmax > tx THEN 1.0 ELSE 0.0 END END), 6) AS "TX90p", round(100 * avg(CASE WHEN tmin IS NOT NULL AND tn IS NOT NULL THEN CASE WHEN tmin < tn THEN 1.0 ELSE 0.0 END END), 6) AS "TN10p"
FROM q GROUP BY 1, 2 HAVING count(precip) * 1.0 / count(*) >= 0.8""",
)
def _(spark, d):
    daily = _daily(spark, d)
    return indices.etccdi_annual(daily, events.fit_thresholds(daily, REFERENCE, SETTINGS), events.calendar_thresholds(daily, REFERENCE), 150.0, (300.0, 400.0))


# ---- transitions ----


def _swings(spark, d):
    daily = once(indices.spi(_daily(spark, d), REFERENCE, 30).select("station_id", "date", "spi30"))
    return daily, events.spatial_extent(events.transitions(daily), daily)


_WHIPLASH = f"""{_SPI30.replace('WITH ', 'WITH RECURSIVE ', 1)},
n AS (SELECT station_id, date, spi AS s, row_number() {W}) AS i, sum(CASE WHEN spi IS NULL THEN 1 ELSE 0 END) {W}) AS gone FROM spi),
k AS (SELECT *, CASE WHEN s <= -1 THEN 'dry' WHEN s >= 1 THEN 'wet' ELSE 'none' END AS kind FROM n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY station_id, kind ORDER BY i) AS grp FROM k),
ep AS (SELECT station_id, kind, min(i) AS a, max(i) AS b, min(date) AS start, max(date) AS fin, CASE WHEN kind = 'dry' THEN min(s) ELSE max(s) END AS ext,
 CASE WHEN kind = 'dry' THEN arg_min(i, s ORDER BY i) ELSE arg_max(i, s ORDER BY i) END AS pk FROM g WHERE kind <> 'none' GROUP BY station_id, kind, grp),
nx AS (SELECT e.*, (SELECT min(f.a) FROM ep f WHERE f.station_id = e.station_id AND f.kind <> e.kind AND f.a > e.b) AS a2 FROM ep e),
cand AS (SELECT nx.station_id, CASE WHEN nx.kind = 'dry' THEN 'dry_to_wet' ELSE 'wet_to_dry' END AS direction, nx.a, nx.b, nx.start, nx.ext, nx.pk, f.a AS a2, f.b AS b2, f.start AS start2, f.fin AS fin2, f.ext AS ext2, f.pk AS pk2
 FROM nx JOIN ep f ON f.station_id = nx.station_id AND f.a = nx.a2 AND nx.a2 - nx.b <= 30
 JOIN n g1 ON g1.station_id = nx.station_id AND g1.i = nx.b JOIN n g2 ON g2.station_id = nx.station_id AND g2.i = nx.a2 - 1
 WHERE nx.a2 - nx.b = 1 OR (g2.gone - g1.gone) / (nx.a2 - nx.b - 1.0) <= 0.5),
o AS (SELECT *, row_number() OVER (PARTITION BY station_id, direction ORDER BY a) AS r FROM cand),
gr AS (SELECT o.*, true AS ok, b2 AS last FROM o WHERE r = 1 UNION ALL
 SELECT o.*, o.a2 - gr.last >= 30 AS ok, CASE WHEN o.a2 - gr.last >= 30 THEN o.b2 ELSE gr.last END AS last FROM gr JOIN o ON o.station_id = gr.station_id AND o.direction = gr.direction AND o.r = gr.r + 1),
ev AS (SELECT station_id, direction, start, start2 AS transition_date, fin2 AS "end", CAST(b2 - a + 1 AS BIGINT) AS duration_days, CAST(a2 - b AS BIGINT) AS transition_days, abs(ext2 - ext) AS intensity_spi_swing, ext AS first_extreme, ext2 AS second_extreme, abs(ext2 - ext) / greatest(pk2 - pk, 1) AS speed_spi_per_day FROM gr WHERE ok),
rep AS (SELECT date, count(DISTINCT station_id) AS reporting FROM spi WHERE spi IS NOT NULL GROUP BY 1),
ex AS (SELECT e.station_id, e.direction, e.transition_date, count(DISTINCT f.station_id) AS near FROM ev e JOIN ev f ON f.direction = e.direction AND abs(date_diff('day', e.transition_date, f.transition_date)) <= 15 GROUP BY 1, 2, 3),
full_ev AS (SELECT ev.*, near * 1.0 / reporting AS spatial_extent FROM ev JOIN ex USING (station_id, direction, transition_date) LEFT JOIN rep ON rep.date = ev.transition_date)"""


@query(
    "e17_whiplash_events",
    f"{_WHIPLASH} SELECT station_id, direction, start, transition_date, \"end\", duration_days, transition_days, round(intensity_spi_swing, 6) AS intensity_spi_swing, round(first_extreme, 6) AS first_extreme, round(second_extreme, 6) AS second_extreme, round(speed_spi_per_day, 6) AS speed_spi_per_day, round(spatial_extent, 6) AS spatial_extent FROM full_ev",
)
def _(spark, d):
    return _swings(spark, d)[1]


_SY = "sy AS (SELECT station_id, year(date) AS year FROM spi GROUP BY 1, 2 HAVING avg(CASE WHEN spi IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8)"


@query("a18_station_years", f"{_SPI30}, {_SY} SELECT station_id, year FROM sy")
def _(spark, d):
    return events.station_years(indices.spi(_daily(spark, d), REFERENCE, 30))


@query(
    "a19_whiplash_annual",
    f"""{_WHIPLASH}, {_SY}, m AS (SELECT year, count(*) AS n_events, avg(intensity_spi_swing) AS i, avg(speed_spi_per_day) AS s, avg(spatial_extent) AS x, avg(transition_days) AS t FROM full_ev JOIN sy ON sy.station_id = full_ev.station_id AND sy.year = year(transition_date) GROUP BY 1)
SELECT c.year, station_years, coalesce(n_events, 0) AS n_events, round(i, 6) AS mean_intensity, round(s, 6) AS mean_speed, round(x, 6) AS mean_extent, round(t, 6) AS mean_transition_days, round(coalesce(n_events, 0) * 1.0 / station_years, 6) AS frequency_per_station_year FROM (SELECT year, count(*) AS station_years FROM sy GROUP BY 1) c LEFT JOIN m ON m.year = c.year""",
)
def _(spark, d):
    daily, ev = _swings(spark, d)
    return events.annual_metrics(ev, events.station_years(daily))


# ---- statistics, on monthly series ----

_MONTHS = f"WITH {RD}, s0 AS (SELECT station_id AS key, date_trunc('month', date) AS m, sum(precip) AS x FROM rd GROUP BY 1, 2), s AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY m) - 1 AS t, x FROM s0), p AS (SELECT a.key, a.t, a.x, b.t AS u, b.x AS y FROM s a JOIN s b ON a.key = b.key AND a.t < b.t)"


def _months(spark, d):
    m = region_day(spark, d).groupBy("station_id", F.trunc("date", "month").alias("m")).agg(F.sum("precip").alias("v"))
    return stats.indexed(m, "station_id", "m", "v")


@query(
    "t1_pettitt",
    f"""{_MONTHS}, u AS (SELECT c.key, c.t AS k, abs(sum(sign(y - p.x))) AS u FROM s c JOIN p ON p.key = c.key AND p.t <= c.t AND p.u > c.t GROUP BY 1, 2), n AS (SELECT key, count(*) * 1.0 AS n FROM s GROUP BY 1)
SELECT u.key, max(u) AS statistic, round(least(1.0, 2 * exp(-6 * max(u) * max(u) / (any_value(n) * any_value(n) * any_value(n) + any_value(n) * any_value(n)))), 6) AS p_value, CAST(arg_max(k, u ORDER BY k) + 1 AS BIGINT) AS change_index FROM u JOIN n ON n.key = u.key GROUP BY 1""",
)
def _(spark, d):
    return stats.pettitt(_months(spark, d))


_Z = f"{_MONTHS}, z0 AS (SELECT *, (x - avg(x) OVER (PARTITION BY key)) / stddev_samp(x) OVER (PARTITION BY key) AS z, count(*) OVER (PARTITION BY key) AS n FROM s), z AS (SELECT *, sum(z) OVER (PARTITION BY key ORDER BY t) AS c, t + 1 AS k, sum(z) OVER (PARTITION BY key) AS total FROM z0)"


@query("t2_snht_stat", f"{_Z}, v AS (SELECT *, k * pow(c / k, 2) + (n - k) * pow((total - c) / (n - k), 2) AS v FROM z WHERE k < n) SELECT key, n, round(max(v), 6) AS statistic, CAST(arg_max(k, v) AS BIGINT) AS change_index FROM v GROUP BY 1, 2")
def _(spark, d):
    return stats.snht(_months(spark, d))


@query("t3_buishand_stat", f"{_Z} SELECT key, n, round((greatest(max(c), 0) - least(min(c), 0)) / sqrt(n), 6) AS statistic, CAST(arg_max(CASE WHEN k < n THEN k END, CASE WHEN k < n THEN abs(c) END) AS BIGINT) AS change_index FROM z GROUP BY 1, 2")
def _(spark, d):
    return stats.buishand(_months(spark, d))


@query("t2_t3_monte_carlo_p")
def _(spark, d):
    s = _months(spark, d)
    both = [stats.with_p_value(f(s), n).withColumn("test", F.lit(n)) for n, f in (("snht", stats.snht), ("buishand", stats.buishand))]
    return both[0].unionByName(both[1])


_SEN = "sen AS (SELECT key, median((y - x) / (u - t)) AS slope FROM p GROUP BY 1)"


@query("t4_sen_slope", f"{_MONTHS}, {_SEN} SELECT s.key, round(slope, 6) AS slope, round(median(x - slope * t), 6) AS intercept FROM s JOIN sen ON sen.key = s.key GROUP BY s.key, slope")
def _(spark, d):
    return stats.sen_slope(_months(spark, d))


@query(
    "t5_mann_kendall",
    f"""{_MONTHS}, {_SEN}, a AS (SELECT key, sum(sign(y - x)) AS s FROM p GROUP BY 1), tie AS (SELECT key, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS tie FROM (SELECT key, x, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT a.key, CAST(s AS DOUBLE) AS s, round(CASE WHEN s <> 0 THEN (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - tie) / 18.0) ELSE 0 END, 6) AS z, round(s / (0.5 * n * (n - 1)), 6) AS tau, round(slope, 6) AS sens_slope FROM a JOIN tie USING (key) JOIN sen USING (key)""",
)
def _(spark, d):
    return stats.mann_kendall(_months(spark, d), False).select("key", F.col("s").cast("double").alias("s"), "z", "tau", "sens_slope")


@query(
    "t6_benjamini_hochberg",
    "WITH r AS (SELECT p_partkey, p_size / 2000.0 AS p, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS m, p_brand FROM part), k AS (SELECT p_brand, max(CASE WHEN p <= 0.05 * r / m THEN r END) AS k FROM r GROUP BY 1) SELECT p_partkey, coalesce(r <= k, false) AS significant FROM r JOIN k USING (p_brand)",
)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") / 2000.0 + F.col("p_partkey") * 1e-12).alias("p"))
    return stats.benjamini_hochberg(part, "p", ["p_brand"], name="significant").select("p_partkey", "significant")


@query(
    "t10_chi2",
    "WITH c AS (SELECT p_brand AS a, p_size % 5 AS b, count(*) AS o FROM part GROUP BY 1, 2), g AS (SELECT a, b, coalesce(o, 0) AS o, ra * rb * 1.0 / n AS e FROM (SELECT a, sum(o) AS ra FROM c GROUP BY 1) CROSS JOIN (SELECT b, sum(o) AS rb FROM c GROUP BY 1) CROSS JOIN (SELECT sum(o) AS n FROM c) LEFT JOIN c USING (a, b)) SELECT round(statistic, 6) AS statistic, freedom, round(1 - " + specfun.gamma_p_sql("freedom / 2.0", "statistic / 2") + ", 6) AS p_value FROM (SELECT sum(pow(o - e, 2) / e) AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS freedom FROM g)",
)
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("a"), (F.col("p_size") % 5).alias("b"))
    return stats.chi2_independence(t, "a", "b")


@query(
    "t11_kruskal",
    "WITH r AS (SELECT p_brand AS g, p_retailprice AS v, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS r FROM part), s AS (SELECT g, sum(r) AS r, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*) AS c FROM part GROUP BY p_retailprice)), n AS (SELECT count(*) * 1.0 AS n FROM part) SELECT round(h, 6) AS h, freedom, round(1 - " + specfun.gamma_p_sql("freedom / 2.0", "h / 2") + ", 6) AS p_value FROM (SELECT (12 / (any_value(n.n) * (any_value(n.n) + 1)) * sum(s.r * s.r / s.n) - 3 * (any_value(n.n) + 1)) / (1 - any_value(tie) / (pow(any_value(n.n), 3) - any_value(n.n))) AS h, count(*) - 1 AS freedom FROM s CROSS JOIN t CROSS JOIN n)",
)
def _(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_retailprice").cast("double").alias("v"))
    return stats.kruskal(t, "g", "v")


@query("t8_t9_homogeneity_report")
def _(spark, d):
    return homogeneity.report(frames.regularise(station_day(spark, d)), stations(spark, d), ["tmax"], least_years=5, overlap=4, max_km=400.0)


# ---- geography ----

GRID = (80.0, 0.5, 30.5, 0.5)
#: Cells from the line table: parts dealt to 9 rows of 17 cells, their quantities as heights.
_CELLS = "cells AS (SELECT CAST(l_partkey % 9 AS INTEGER) AS row, CAST((l_partkey // 9) % 17 AS INTEGER) AS col, CAST(CAST(sum(l_quantity) AS BIGINT) % 3001 AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2)"
BOX = [("west", [[(80.0, 26.0), (84.03, 26.0), (83.03, 31.0), (80.0, 31.0)]]), ("east", [[(84.03, 26.0), (88.5, 26.0), (88.5, 31.0), (83.03, 31.0)], [(79.0, 20.0), (79.5, 20.0), (79.5, 21.0)]])]
RIVER = [(80.0, 27.0, 83.0, 28.5), (83.0, 28.5, 86.0, 27.5), (86.0, 27.5, 88.0, 29.0)]
_INSIDE = {"west": "lat > 26 AND lat <= 31 AND lon >= 80 AND lon < 84.03 - (lat - 26) / 5", "east": "lat > 26 AND lat <= 31 AND lon >= 84.03 - (lat - 26) / 5 AND lon < 88.5"}


def _cells(spark, d):
    k = F.col("l_partkey")
    lines = table(spark, d, "lineitem").groupBy((k % 9).cast("int").alias("row"), (F.floor(k / 9) % 17).cast("int").alias("col"))
    return lines.agg((F.sum("l_quantity").cast("long") % 3001).cast("double").alias("value"))


@query("j11_point_in_polygon", f"WITH {ST} SELECT station_id, CASE WHEN {_INSIDE['west']} THEN 'west' WHEN {_INSIDE['east']} THEN 'east' END AS attr FROM st")
def _(spark, d):
    return geo.point_in_polygon(stations(spark, d), spark.createDataFrame(geo.edges_of(BOX), geo.EDGES))


@query("j12_raster_sample", f"WITH {ST}, {_CELLS} SELECT station_id, value FROM st LEFT JOIN cells ON cells.row = floor((30.5 - lat) / 0.5) AND cells.col = floor((lon - 80.0) / 0.5)")
def _(spark, d):
    return geo.sample_raster(stations(spark, d), _cells(spark, d), GRID).select("station_id", "value")


_KM = scalars.HAVERSINE_SQL.format(lat1="a.lat", lon1="a.lon", lat2="b.lat", lon2="b.lon")


@query("j13_knn_stations", f"WITH {ST}, r AS (SELECT a.station_id AS query, b.station_id, {_KM} AS km FROM st a CROSS JOIN st b) SELECT query, station_id, round(km, 6) AS km, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY km, station_id) AS rank FROM r) WHERE rank <= 3")
def _(spark, d):
    st = stations(spark, d)
    return geo.nearest_k(st.select(F.col("station_id").alias("query"), F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), st, 3)


@query("j14_nearest_grid", f"WITH {ST} SELECT station_id, round(26 + 0.5 * floor((lat - 26) / 0.5 + 0.5), 6) AS grid_lat, round(80 + 0.5 * floor((lon - 80) / 0.5 + 0.5), 6) AS grid_lon FROM st")
def _(spark, d):
    snap = lambda x, o: o + 0.5 * F.floor((x - o) / 0.5 + 0.5)
    return stations(spark, d).select("station_id", snap(F.col("lat"), 26).alias("grid_lat"), snap(F.col("lon"), 80).alias("grid_lon"))


_SEG = "seg AS (SELECT * FROM (VALUES " + ", ".join(map(str, RIVER)) + ") t(x1, y1, x2, y2))"


@query(
    "j15_polyline_distance",
    f"""WITH {ST}, {_SEG}, a AS (SELECT station_id, (x1 - lon) * 111.32 * cos(radians(lat)) AS ax, (y1 - lat) * 110.57 AS ay, (x2 - x1) * 111.32 * cos(radians(lat)) AS ux, (y2 - y1) * 110.57 AS uy FROM st CROSS JOIN seg),
t AS (SELECT *, greatest(0, least(1, -(ax * ux + ay * uy) / (ux * ux + uy * uy))) AS t FROM a) SELECT station_id, round(min(sqrt(pow(ax + t * ux, 2) + pow(ay + t * uy, 2))), 6) AS km FROM t GROUP BY 1""",
)
def _(spark, d):
    return geo.polyline_distance(stations(spark, d), spark.createDataFrame(RIVER, "x1 double, y1 double, x2 double, y2 double"))


@query("j18_near_duplicate_stations", f"WITH {ST} SELECT a.station_id, round(min({_KM}), 6) AS km FROM st a JOIN st b ON a.station_id <> b.station_id GROUP BY 1 HAVING min({_KM}) < 60")
def _(spark, d):
    return geo.nearest_other(stations(spark, d), 60.0)


@query("j19_nearest_train_station", f"WITH {ST} SELECT a.station_id, round(min({_KM}), 6) AS km FROM st a JOIN st b ON a.station_id <> b.station_id AND b.basin <> 'ASIA' GROUP BY 1")
def _(spark, d):
    st = stations(spark, d)
    return geo.nearest_member(st, st.filter("basin <> 'ASIA'"))


@query("j20_zonal_stats", f"WITH {_CELLS}, c AS (SELECT *, 80.0 + (col + 0.5) * 0.5 AS lon, 30.5 - (row + 0.5) * 0.5 AS lat FROM cells), z AS (SELECT *, CASE WHEN {_INSIDE['west']} THEN 'west' WHEN {_INSIDE['east']} THEN 'east' END AS attr FROM c) SELECT attr, count(value) AS count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std FROM z WHERE attr IS NOT NULL GROUP BY 1")
def _(spark, d):
    return geo.zonal(_cells(spark, d), GRID, spark.createDataFrame(geo.edges_of(BOX), geo.EDGES))


@query(
    "g1_slope_aspect",
    f"""WITH {_CELLS}, n AS (SELECT c.row, c.col, c.value, dr, dc, coalesce(o.value, 0) AS v FROM cells c CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dr) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS dc)
 LEFT JOIN cells o ON o.row = least(greatest(c.row + dr, 0), 8) AND o.col = least(greatest(c.col + dc, 0), 16)),
k AS (SELECT row, col, sum(dc * (2 - abs(dr)) * v) / (8 * 0.5 * 111320 * cos(radians(30.5 - (row + 0.5) * 0.5))) AS gx, sum(dr * (2 - abs(dc)) * v) / (8 * 0.5 * 111320) AS gy FROM n GROUP BY 1, 2),
s AS (SELECT row, col, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, (degrees(atan2(-gx, gy)) + 720) % 360 AS aspect FROM k)
SELECT row, col, round(slope, 6) AS slope, round(CASE WHEN slope < 0.5 THEN -1 ELSE aspect END, 6) AS aspect FROM s""",
)
def _(spark, d):
    return geo.slope_aspect(_cells(spark, d), GRID).select("row", "col", "slope", "aspect")


@query("g2_relief", f"WITH {_CELLS} SELECT a.row, a.col, round(stddev_pop(b.value), 6) AS relief FROM cells a JOIN cells b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2")
def _(spark, d):
    return geo.relief(_cells(spark, d)).select("row", "col", "relief")


@query(
    "g4_idw",
    f"""WITH {ST}, q AS (SELECT station_id AS query, lat + 0.2 AS lat, lon + 0.1 AS lon FROM st), r AS (SELECT a.query, b.station_id, b.elevation_m AS v, {_KM} AS km FROM q a CROSS JOIN st b),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY km, station_id) AS rank FROM r) WHERE rank <= 8)
SELECT query, round(CASE WHEN min(km) <= 150 THEN sum(v / pow(km, 2)) / sum(1 / pow(km, 2)) END, 6) AS value FROM k GROUP BY 1""",
)
def _(spark, d):
    st = stations(spark, d)
    return geo.idw(st.select(F.col("station_id").alias("query"), (F.col("lat") + 0.2).alias("qlat"), (F.col("lon") + 0.1).alias("qlon")), st, "elevation_m")


@query("g6_raster_metadata", f"WITH {_CELLS} SELECT CAST(max(row) + 1 AS INTEGER) AS rows, CAST(max(col) + 1 AS INTEGER) AS cols, min(value) AS min, max(value) AS max, 80.0::DOUBLE AS west, 88.5::DOUBLE AS east, 30.5::DOUBLE AS north, 26.0::DOUBLE AS south FROM cells")
def _(spark, d):
    return geo.raster_metadata(_cells(spark, d), GRID)


@query(
    "g8_station_issues",
    f"""WITH {ST}, {_CELLS}, q AS (SELECT station_id, lat, lon, elevation_m, CASE WHEN lat > 28 THEN '[{{"date":"1996-01-01","type":"move","detail":"x"}}]' ELSE '[]' END AS moves FROM st),
d AS (SELECT q.station_id, elevation_m - value AS off FROM q JOIN cells ON cells.row = floor((30.5 - lat) / 0.5) AND cells.col = floor((lon - 80.0) / 0.5)),
n AS (SELECT a.station_id, min({_KM}) AS km FROM st a JOIN st b ON a.station_id <> b.station_id GROUP BY 1)
SELECT station_id, 'coordinates_outside_bbox' AS issue FROM q WHERE NOT (lon BETWEEN 81 AND 87 AND lat BETWEEN 26.5 AND 30) UNION ALL SELECT station_id, 'elevation_metadata_vs_dem' FROM d WHERE abs(off) > 300
UNION ALL SELECT station_id, 'near_duplicate_location' FROM n WHERE km < 40 UNION ALL SELECT station_id, 'documented_station_history' FROM q WHERE moves <> '[]'""",
)
def _(spark, d):
    move = F.when(F.col("lat") > 28, '[{"date":"1996-01-01","type":"move","detail":"x"}]').otherwise("[]")
    found = qc.station_issues(stations(spark, d).withColumn("relocation_events", move), (81.0, 26.5, 87.0, 30.0), _cells(spark, d), GRID, {"near_km": 40.0})
    return found.select("station_id", "issue")


# ---- scores ----

_F = "f AS (SELECT doc_id, quality AS y, ((doc_id * 7919) % 997 + 300 * quality) / 1300.0 AS p, doc_id % 7 AS g FROM labels WHERE quality IN (0, 1))"
_B = "b AS (SELECT p, sum(y) * 1.0 AS pos, count(*) * 1.0 AS n FROM f GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen, sum(pos) OVER () AS pp, sum(n) OVER () AS nn FROM b)"


def _forecasts(spark, d):
    labels = table(spark, d, "labels").filter(F.col("quality").isin(0, 1))
    return labels.select("doc_id", F.col("quality").alias("y"), (((F.col("doc_id") * 7919) % 997 + 300 * F.col("quality")) / 1300.0).cast("double").alias("p"), (F.col("doc_id") % 7).alias("g"))


@query("v1_average_precision", f"WITH {_F}, {_B} SELECT round(sum(pos / pp * tp / seen), 6) AS ap, round(max(pp / nn), 6) AS base_rate, round(sum(pos / pp * tp / seen) / max(pp / nn), 6) AS lift FROM c")
def _(spark, d):
    return metrics.average_precision(_forecasts(spark, d))


@query("a24_ap_by_group", f"WITH {_F}, b AS (SELECT g, p, sum(y) * 1.0 AS pos, count(*) * 1.0 AS n FROM f GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY g ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY g ORDER BY p DESC) AS seen, sum(pos) OVER (PARTITION BY g) AS pp FROM b) SELECT g, round(sum(pos / pp * tp / seen), 6) AS ap FROM c GROUP BY 1")
def _(spark, d):
    return metrics.average_precision(_forecasts(spark, d), ["g"]).select("g", "ap")


@query("v1_auroc", f"WITH {_F}, {_B} SELECT round(sum(pos * (nn - pp - (seen - tp) + 0.5 * (n - pos))) / max(pp * (nn - pp)), 6) AS auroc FROM c")
def _(spark, d):
    return metrics.auroc(_forecasts(spark, d))


@query("v1_brier_log_loss", f"WITH {_F}, q AS (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS p FROM f) SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS n_events, round(avg(pow(p - y, 2)), 6) AS brier, round(1 - avg(pow(p - y, 2)) / (avg(y) * (1 - avg(y))), 6) AS brier_skill, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM q")
def _(spark, d):
    return metrics.brier(_forecasts(spark, d))


@query("v1_precision_recall", f"WITH {_F}, k AS (SELECT sum(CASE WHEN p >= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) AS yes, sum(y) AS pp FROM f) SELECT round(tp * 1.0 / yes, 6) AS precision, round(tp * 1.0 / pp, 6) AS recall, round(2.0 * tp / (yes + pp), 6) AS f1 FROM k")
def _(spark, d):
    return metrics.confusion(_forecasts(spark, d))


@query("v2_best_f1_threshold", f"WITH {_F}, {_B}, s AS (SELECT p, 2 * tp / (seen + pp) AS f1 FROM c) SELECT round(p, 6) AS threshold, round(f1, 6) AS f1 FROM s ORDER BY s.f1 DESC, s.p LIMIT 1")
def _(spark, d):
    return metrics.best_f1(_forecasts(spark, d))


def _bin(edges: str) -> str:
    return f"e AS (SELECT {edges} AS e FROM f), x AS (SELECT y, p, len(list_filter(e[2:len(e) - 1], lambda v: v <= p)) AS bin FROM f CROSS JOIN e)"


@query("v3_ece", f"WITH {_F}, {_bin('quantile_cont(p, list_transform(range(0, 16), lambda k: k / 15.0)::DOUBLE[])')}, g AS (SELECT bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM x GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM g".replace("list_transform(range(0, 16), lambda k: k / 15.0)::DOUBLE[]", "[" + ", ".join(repr(k / 15) for k in range(16)) + "]"))
def _(spark, d):
    return metrics.expected_calibration_error(_forecasts(spark, d))


@query("v4_reliability_curve", f"WITH {_F}, {_bin('list_sort(list_distinct(quantile_cont(p, [' + ', '.join(repr(k / 10) for k in range(11)) + '])))')} SELECT CAST(bin AS INTEGER) AS bin, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_frequency, count(*) AS count FROM x GROUP BY 1")
def _(spark, d):
    return metrics.reliability_curve(_forecasts(spark, d))


@query("v5_regression_metrics", "SELECT round(avg(abs(l_discount * 1000 - l_quantity)), 6) AS mae, round(sqrt(avg(pow(l_discount * 1000 - l_quantity, 2))), 6) AS rmse, round(1 - avg(pow(l_discount * 1000 - l_quantity, 2)) / var_pop(l_quantity), 6) AS r2, round(avg(l_discount * 1000 - l_quantity), 6) AS bias FROM lineitem")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("y"), (F.col("l_discount").cast("double") * 1000).alias("yhat"))
    return metrics.regression(t, "y", "yhat")


_M = "m AS (SELECT doc_id, y, [p, ((doc_id * 31) % 101) / 101.0, ((doc_id * 17) % 89) / 89.0] AS ms FROM f)"


def _members(spark, d):
    i = F.col("doc_id")
    return _forecasts(spark, d).withColumn("ms", F.array("p", ((i * 31) % 101) / 101.0, ((i * 17) % 89) / 89.0))


@query("v6_crps", f"WITH {_F}, {_M}, u AS (SELECT doc_id, y, unnest(ms) AS a FROM m), t1 AS (SELECT doc_id, avg(abs(a - y)) AS v FROM u GROUP BY 1), t2 AS (SELECT a.doc_id, avg(abs(a.a - b.a)) AS v FROM u a JOIN u b ON a.doc_id = b.doc_id GROUP BY 1) SELECT t1.doc_id, round(t1.v - t2.v / 2, 6) AS crps FROM t1 JOIN t2 USING (doc_id)")
def _(spark, d):
    return _members(spark, d).select("doc_id", metrics.crps(F.col("y").cast("double"), F.col("ms")).alias("crps"))


_H = "-(least(greatest({p}, 1e-7), 1 - 1e-7) * log2(least(greatest({p}, 1e-7), 1 - 1e-7)) + (1 - least(greatest({p}, 1e-7), 1 - 1e-7)) * log2(1 - least(greatest({p}, 1e-7), 1 - 1e-7)))"
_D = f"u AS (SELECT doc_id, y, unnest(ms) AS a FROM m), de AS (SELECT doc_id, any_value(y) AS y, avg(a) AS p, stddev_pop(a) AS sd, avg({_H.format(p='a')}) AS al FROM u GROUP BY 1), ep AS (SELECT *, greatest(0, {_H.format(p='p')} - al) AS epi FROM de)"


@query("v7_decomposition", f"WITH {_F}, {_M}, {_D} SELECT doc_id, round(p, 6) AS probability, round(sd, 6) AS std, round(al, 6) AS aleatoric, round(epi, 6) AS epistemic FROM ep")
def _(spark, d):
    parts = metrics.decompose(F.col("ms"))
    return _members(spark, d).select("doc_id", *(parts[k].alias(k) for k in ("probability", "std", "aleatoric", "epistemic")))


_Q = "s AS (SELECT y, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM f), o AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS r, count(*) OVER (PARTITION BY y) AS n FROM s), q AS (SELECT max(CASE WHEN y = 0 THEN s END) AS q0, max(CASE WHEN y = 1 THEN s END) AS q1 FROM o WHERE r = least(ceil((n + 1) * 0.9), n))"


@query("v8_conformal_fit", f"WITH {_F}, {_Q} SELECT round(q0, 6) AS q0, round(q1, 6) AS q1 FROM q")
def _(spark, d):
    return metrics.conformal_fit(_forecasts(spark, d))


@query("v8_conformal_eval", f"WITH {_F}, {_Q}, i AS (SELECT y, p <= q0 AS a, 1 - p <= q1 AS b FROM f CROSS JOIN q), k AS (SELECT y, CASE WHEN y = 1 THEN b ELSE a END::INT AS c, a::INT + b::INT AS z FROM i) SELECT round(avg(c), 6) AS coverage, round(avg(CASE WHEN y = 1 THEN c END), 6) AS coverage_events, round(avg(CASE WHEN y = 0 THEN c END), 6) AS coverage_non_events, round(avg(z), 6) AS mean_set_size, round(avg((z = 2)::INT), 6) AS frac_ambiguous, round(avg((z = 0)::INT), 6) AS frac_empty FROM k")
def _(spark, d):
    f = _forecasts(spark, d)
    return metrics.conformal_evaluate(metrics.conformal_sets(f, metrics.conformal_fit(f)))


@query("v9_temperature")
def _(spark, d):
    t = metrics.temperature(_forecasts(spark, d))
    return spark.range(1).select(F.lit(t).alias("temperature"))


@query("v10_uncertainty_category", f"WITH {_F}, {_M}, {_D}, q AS (SELECT quantile_cont(epi, 0.5) AS a, quantile_cont(epi, 0.9) AS b FROM ep) SELECT doc_id, CASE WHEN epi > b THEN 'high' WHEN epi > a THEN 'moderate' ELSE 'low' END AS uncertainty FROM ep CROSS JOIN q")
def _(spark, d):
    m = _members(spark, d).withColumn("epistemic", metrics.decompose(F.col("ms"))["epistemic"])
    return metrics.categorise(m, m).select("doc_id", "uncertainty")


@query(
    "v12_uncertainty_verdict",
    f"""WITH {_F}, {_M}, {_D}, q AS (SELECT quantile_cont(epi, 0.5) AS a, quantile_cont(epi, 0.9) AS b FROM ep),
c AS (SELECT ep.doc_id, epi, CASE WHEN epi > b THEN 'high' WHEN epi > a THEN 'moderate' ELSE 'low' END AS u, CASE WHEN (f.p >= 0.5) <> (f.y = 1) THEN 1 ELSE 0 END AS e FROM ep JOIN f ON f.doc_id = ep.doc_id CROSS JOIN q),
k AS (SELECT epi, sum(e) AS pos, count(*) AS n FROM c GROUP BY 1), w AS (SELECT *, sum(n - pos) OVER (ORDER BY epi) - (n - pos) AS below, sum(pos) OVER () AS events, sum(n) OVER () AS rows FROM k),
s AS (SELECT sum(pos * (below + 0.5 * (n - pos))) / max(events * (rows - events)) AS auroc FROM w), r AS (SELECT avg(CASE WHEN u = 'high' THEN e END) AS high, avg(CASE WHEN u = 'low' THEN e END) AS low FROM c)
SELECT round(high, 6) AS high, round(low, 6) AS low, round(auroc, 6) AS auroc, CASE WHEN coalesce(high, 0) > coalesce(low, 1) AND coalesce(auroc, 0) > 0.6 THEN 'supported' ELSE 'inconclusive' END AS verdict FROM r CROSS JOIN s""",
)
def _(spark, d):
    m = _members(spark, d).withColumn("epistemic", metrics.decompose(F.col("ms"))["epistemic"])
    told = metrics.categorise(m, m).select("doc_id", "uncertainty", "epistemic").join(_forecasts(spark, d), "doc_id")
    return studies.error_by_uncertainty(told.withColumn("error", (F.col("p") >= 0.5) != (F.col("y") == 1)))


_QD = "CASE WHEN abs(p - 0.5) > 0.2 AND (p >= 0.5) = (y = 1) THEN 'confident_correct' WHEN abs(p - 0.5) > 0.2 THEN 'confident_wrong' WHEN (p >= 0.5) = (y = 1) THEN 'uncertain_correct' ELSE 'uncertain_wrong' END"


@query("p14_a23_quadrants", f"WITH {_F} SELECT {_QD} AS quadrant, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS fraction FROM f GROUP BY 1")
def _(spark, d):
    q = _forecasts(spark, d).groupBy(metrics.quadrants(0.5, F.abs(F.col("p") - 0.5) > 0.2).alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))
    return q.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query(
    "a22_error_clustering",
    f"""WITH {_F}, k AS (SELECT y, ((p >= 0.5) <> (y = 1))::INT AS e, {_QD} AS q, CAST(g AS VARCHAR) AS g, CAST(doc_id % 3 AS VARCHAR) AS h FROM f), l AS (SELECT 'g' AS factor, g AS level, * FROM k UNION ALL SELECT 'h', h, * FROM k)
SELECT factor, level, count(*) AS n, CAST(sum(y) AS BIGINT) AS events, round(avg(e), 6) AS error_rate, round(avg(CASE WHEN y = 1 THEN e END), 6) AS miss_rate, round(avg(CASE WHEN y = 0 THEN e END), 6) AS false_alarm_rate, round(avg((q = 'confident_wrong')::INT), 6) AS confident_wrong FROM l GROUP BY 1, 2""",
)
def _(spark, d):
    f = _forecasts(spark, d)
    frame = f.select("y", ((F.col("p") >= 0.5) != (F.col("y") == 1)).alias("error"), metrics.quadrants(0.5, F.abs(F.col("p") - 0.5) > 0.2).alias("quadrant"), F.col("g").cast("string").alias("g"), (F.col("doc_id") % 3).cast("string").alias("h"))
    return metrics.error_clustering(frame, ["g", "h"])


# ---- baselines and models ----

_EV = "ev AS (SELECT station_id, date, CAST(precip > 400 AS DOUBLE) AS e FROM rr)"


def _events(spark, d):
    return _daily(spark, d).select("station_id", "date", "precip", "tmax", "tmin", (F.col("precip") > 400).cast("double").alias("e"))


@query("m5_climatology", f"WITH {RD}, {RR}, {_EV}, x AS (SELECT (dayofyear(date) - 1 + o + 366) % 366 + 1 AS doy, e FROM ev CROSS JOIN (SELECT unnest(range(-15, 16)) AS o) WHERE e IS NOT NULL) SELECT CAST(doy AS INTEGER) AS doy, round((sum(e) + 0.5) / (count(*) + 1), 6) AS probability FROM x GROUP BY 1")
def _(spark, d):
    return models.climatology(_events(spark, d), "e").withColumn("doy", F.col("doy").cast("int"))


@query("m6_persistence", f"WITH {RD}, {RR}, {_EV}, x AS (SELECT lag(e) {W}) AS today, e FROM ev) SELECT today, round((sum(e) + 0.5) / (count(*) + 1), 6) AS probability FROM x WHERE e IS NOT NULL AND today IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, round(avg(e), 6) FROM x WHERE e IS NOT NULL")
def _(spark, d):
    ev = _events(spark, d).withColumn("today", F.lag("e").over(frames.by_date()))
    return models.persistence(ev, "today", "e")


_PERIODS = {"train": (date(1995, 1, 1), date(1998, 12, 31)), "val": (date(1999, 1, 1), date(1999, 12, 31)), "test": (date(2000, 1, 1), date(2001, 12, 31))}
#: A gap of 30 days before every fold but the first, a lead of one day off every end.
_SPANS = "(VALUES ('train', DATE '1995-01-01', DATE '1998-12-31' - 1), ('val', DATE '1999-01-01' + 30, DATE '1999-12-31' - 1), ('test', DATE '2000-01-01' + 30, DATE '2001-12-31' - 1)) f(fold, s, e)"


@query("m3_splits", f"WITH {ST} SELECT f.fold, station_id, CAST(f.s AS DATE) AS start, CAST(f.e AS DATE) AS \"end\" FROM st CROSS JOIN {_SPANS}")
def _(spark, d):
    return models.split("temporal", stations(spark, d), _PERIODS, gap=30)


def _spatial_sql(test: str, spans: str, join: str) -> str:
    """Folds by a condition for test stations; the rest's validation stations by a drawn order within their basin."""
    drawn = studies.uniform_sql("station_id", "'val'", "'0'")
    return f"""WITH {ST}, mk AS (SELECT station_id, basin, {test} AS test FROM st),
rk AS (SELECT *, row_number() OVER (PARTITION BY basin, test ORDER BY {drawn}, station_id) AS rank, count(*) OVER (PARTITION BY basin, test) AS n FROM mk),
fo AS (SELECT station_id, CASE WHEN test THEN 'test' WHEN rank <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'val' ELSE 'train' END AS fold FROM rk)
SELECT fo.fold, station_id, CAST(f.s AS DATE) AS start, CAST(f.e AS DATE) AS "end" FROM fo JOIN {spans} ON {join}"""


_STRATEGIES = {
    "basin": ("basin IN ('ASIA')", {"test_groups": ("ASIA",)}),
    "longitude_block": ("lon >= quantile_cont(lon, 0.7) OVER ()", {}),
    "random_station": (f"row_number() OVER (ORDER BY {studies.uniform_sql('station_id', chr(39) + 'test' + chr(39), chr(39) + '0' + chr(39))}, station_id) <= floor(count(*) OVER () * 0.3)", {}),
}
for _strategy, (_test, _more) in _STRATEGIES.items():
    query(f"m3_spatial_{_strategy}", _spatial_sql(_test, _SPANS, "f.fold = 'train'"))(
        lambda spark, d, strategy=_strategy, more=_more: models.split("spatial", stations(spark, d), _PERIODS, gap=30, strategy=strategy, **more)
    )
    query(f"m3_spatiotemporal_{_strategy}", _spatial_sql(_test, _SPANS, "f.fold = fo.fold"))(
        lambda spark, d, strategy=_strategy, more=_more: models.split("spatiotemporal", stations(spark, d), _PERIODS, gap=30, strategy=strategy, **more)
    )


@query("m1_p20_samples", f"WITH {RD}, {RR}, days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM rd), dn AS (SELECT s.station_id, days.date, precip FROM (SELECT DISTINCT station_id FROM rd) s CROSS JOIN days LEFT JOIN rd ON rd.station_id = s.station_id AND rd.date = days.date), w AS (SELECT *, max(CAST(precip > 400 AS DOUBLE)) {W} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS target, avg(CASE WHEN precip IS NULL THEN 0.0 ELSE 1.0 END) {W} ROWS 59 PRECEDING) AS observed, row_number() {W}) AS t FROM dn) SELECT station_id, date, target, round(observed, 6) AS observed FROM w WHERE target IS NOT NULL AND observed >= 0.5 AND t >= 60")
def _(spark, d):
    rd = region_day(spark, d).withColumn("e", (F.col("precip") > 400).cast("double"))
    return models.samples(rd, rd.select("station_id").distinct(), "e").select("station_id", "date", "target", "observed")


def _tabular(spark, d):
    # Days by station, which every pass of a learner and of its scores reads: without this each joins and sums the lines anew.
    rows = once(models.tabular_features(_events(spark, d), ("precip", "tmax"), (1, 3), (7,)).withColumn("label", frames.target(F.col("e"), 1, 1)).filter("label IS NOT NULL"))
    columns = [c for c in rows.columns if c.startswith(("precip_", "tmax_", "doy_"))]
    return rows, columns


def _learned(kind: str):
    def run(spark, d):
        rows, columns = _tabular(spark, d)
        train = rows.filter(F.col("date") <= HIGH)
        pipeline = models.classifier(kind, columns, train.count())
        test = models.scored(pipeline.fit(train), rows.filter(F.col("date") > HIGH)).select(F.col("label").alias("y"), "p")
        return metrics.average_precision(test).join(metrics.auroc(test))

    return run


for _kind, _name in (("logistic", "m7_logistic"), ("random_forest", "m8_random_forest"), ("gbt", "m9_gbt")):
    query(_name)(_learned(_kind))


@query("m10_tweedie")
def _(spark, d):
    rows, columns = _tabular(spark, d)
    rows = rows.withColumn("label", F.lead("precip").over(frames.by_date())).filter("label IS NOT NULL")
    model = models.regressor("tweedie", columns).fit(rows.filter(F.col("date") <= HIGH))
    return metrics.regression(model.transform(rows.filter(F.col("date") > HIGH)), "label", "prediction")


@query("f5_special_functions", f"SELECT p_partkey AS k, round({specfun.gamma_p_sql('(p_size / 4.0)', '(p_retailprice / 300.0)')}, 6) AS p, round({specfun.norm_ppf_sql('((p_partkey % 40 + 1) / 41.0)')}, 6) AS z FROM part")
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 4.0).alias("a"), (F.col("p_retailprice") / 300.0).cast("double").alias("x"))
    # Some narrow columns are one task's read; the series are much more work than that and are spread by key.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = parts.repartition(tasks, "k")
    return parts.select("k", specfun.gamma_p(F.col("a"), F.col("x")).alias("p"), specfun.norm_ppf((F.col("k") % 40 + 1) / 41.0).alias("z"))


@query("f4_thom_gamma", f"WITH {RD}, g AS (SELECT station_id, avg(precip) AS m, ln(avg(precip)) - avg(ln(precip)) AS a FROM rd WHERE precip > 0 GROUP BY 1) SELECT station_id, round((1 + sqrt(1 + 4 * a / 3)) / (4 * a), 6) AS shape, round(m / ((1 + sqrt(1 + 4 * a / 3)) / (4 * a)), 6) AS scale FROM g")
def _(spark, d):
    g = region_day(spark, d).filter("precip > 0").groupBy("station_id").agg(F.avg("precip").alias("m"), (F.log(F.avg("precip")) - F.avg(F.log("precip"))).alias("a"))
    shape = (1 + F.sqrt(1 + 4 * F.col("a") / 3)) / (4 * F.col("a"))
    return g.select("station_id", shape.alias("shape"), (F.col("m") / shape).alias("scale"))
