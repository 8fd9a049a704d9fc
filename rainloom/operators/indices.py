"""Standardised precipitation, potential evapotranspiration balance and annual extreme indices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import specfun
from ..session import ship
from . import frames


def accumulation(x: Column, window: int, share: float = 0.9) -> Column:
    """Sum of the last rows, scaled up for missing ones; null below ``share`` of the window."""
    frame = frames.trailing(window)
    n = F.count(x).over(frame)
    return F.when(n >= int(share * window), F.sum(x).over(frame) * window / n)


def spi(obs: DataFrame, reference: tuple[str, str], window: int = 30, least: int = 30, variable: str = "precip", name: str | None = None) -> DataFrame:
    """obs (daily) with the standardised index of the accumulated variable: by station and month a gamma law (Thom's
    estimate) for positive amounts with a mass at zero, then the normal quantile; probabilities within [1e-4, 1 - 1e-4]."""
    name = name or f"spi{window}"
    acc = obs.withColumn("_acc", accumulation(F.col(variable), window)).withColumn("_month", F.month("date"))
    used = acc.filter(F.col("date").between(*reference) & F.col("_acc").isNotNull())
    wet = F.when(F.col("_acc") > 0, F.col("_acc"))
    fit = used.groupBy("station_id", "_month").agg(
        F.count(F.lit(1)).alias("_n"), F.avg((F.col("_acc") <= 0).cast("double")).alias("_q"), F.count(wet).alias("_wet"), F.avg(wet).alias("_mean"), F.avg(F.log(wet)).alias("_log")
    )
    gap = F.log("_mean") - F.col("_log")
    shape = (1 + F.sqrt(1 + 4 * gap / 3)) / (4 * gap)
    fit = fit.withColumn("_a", F.when((F.col("_n") >= least) & (F.col("_wet") >= 5) & (gap > 0), shape))
    fit = fit.select("station_id", "_month", "_q", "_a", (F.col("_mean") / F.col("_a")).alias("_scale"), specfun.lgamma(F.col("_a") + 1).alias("_lg"))
    # Twelve rows a station.
    joined = acc.join(fit, ["station_id", "_month"], "left")
    dry = F.when(F.col("_q") > 0, F.col("_q") / 2).otherwise(1e-3)
    h = F.when(F.col("_acc") <= 0, dry).otherwise(F.col("_q") + (1 - F.col("_q")) * specfun.gamma_p(F.col("_a"), F.col("_acc") / F.col("_scale"), F.col("_lg")))
    h = F.when(F.col("_a").isNotNull() & F.col("_acc").isNotNull(), F.least(F.greatest(h, F.lit(1e-4)), F.lit(1 - 1e-4)))
    return joined.withColumn("_h", h).withColumn(name, specfun.norm_ppf(F.col("_h"))).drop("_acc", "_month", "_q", "_a", "_scale", "_lg", "_h")


def spi_sql(view: str, reference: tuple[str, str], window: int = 30, least: int = 30) -> str:
    """CTEs that end in ``spi(station_id, date, spi)`` over a daily view, for the oracle."""
    low, high = reference
    frame = f"OVER (PARTITION BY station_id ORDER BY date ROWS {window - 1} PRECEDING)"
    return f"""acc AS (SELECT station_id, date, month(date) AS m, CASE WHEN count(precip) {frame} >= {int(0.9 * window)} THEN sum(precip) {frame} * {window} / count(precip) {frame} END AS acc FROM {view}),
fit0 AS (SELECT station_id, m, count(*) AS n, avg(CASE WHEN acc <= 0 THEN 1.0 ELSE 0.0 END) AS q, count(CASE WHEN acc > 0 THEN 1 END) AS wet, avg(CASE WHEN acc > 0 THEN acc END) AS mean,
  ln(avg(CASE WHEN acc > 0 THEN acc END)) - avg(CASE WHEN acc > 0 THEN ln(acc) END) AS gap FROM acc WHERE date BETWEEN DATE '{low}' AND DATE '{high}' AND acc IS NOT NULL GROUP BY 1, 2),
fit AS (SELECT *, CASE WHEN n >= {least} AND wet >= 5 AND gap > 0 THEN (1 + sqrt(1 + 4 * gap / 3)) / (4 * gap) END AS a FROM fit0),
h0 AS (SELECT acc.station_id, date, acc, q, a, acc / (mean / a) AS x FROM acc LEFT JOIN fit ON fit.station_id = acc.station_id AND fit.m = acc.m),
h1 AS (SELECT station_id, date, CASE WHEN a IS NOT NULL AND acc IS NOT NULL THEN least(greatest(CASE WHEN acc <= 0 THEN CASE WHEN q > 0 THEN q / 2 ELSE 1e-3 END ELSE q + (1 - q) * ({specfun.gamma_p_sql('a', 'x')}) END, 1e-4), 1 - 1e-4) END AS h FROM h0),
spi AS (SELECT station_id, date, CASE WHEN h IS NOT NULL THEN {specfun.norm_ppf_sql('h')} END AS spi FROM h1)"""


def fisk_fit(x: np.ndarray, rounds: int = 400) -> tuple[float, float, float]:
    """(shape, location, scale) of the log-logistic law by maximum likelihood: Nelder-Mead from quartiles."""
    x = np.sort(x[np.isfinite(x)])
    spread = max(float(np.subtract(*np.percentile(x, [75, 25]))), 1e-6)

    def loss(v: np.ndarray) -> float:
        shape, loc, scale = np.exp(np.clip(v[0], -20, 20)), v[1], np.exp(np.clip(v[2], -20, 20))
        z = (x - loc) / scale
        if (z <= 0).any():
            return 1e12 + float(np.sum(np.minimum(z, 0) ** 2))
        t = shape * np.log(z)
        return float(-np.sum(np.log(shape / scale) + t - np.log(z) - 2 * np.logaddexp(0, t)))

    start = np.array([1.0, x[0] - spread, np.log(2 * spread)])
    simplex = np.vstack([start, start + np.diag([0.4, -0.5 * spread, 0.4])])
    values = np.array([loss(v) for v in simplex])
    for _ in range(rounds):
        order = values.argsort()
        simplex, values = simplex[order], values[order]
        if values[-1] - values[0] < 1e-9 * (1 + abs(values[0])):
            break
        centre, worst = simplex[:-1].mean(axis=0), simplex[-1]
        tried = [(p, loss(p)) for p in (2 * centre - worst,)]
        if tried[0][1] < values[0]:
            p = 3 * centre - 2 * worst
            tried.append((p, loss(p)))
        elif tried[0][1] >= values[-2]:
            p = centre + 0.5 * ((tried[0][0] if tried[0][1] < values[-1] else worst) - centre)
            tried.append((p, loss(p)))
        best = min(tried, key=lambda t: t[1])
        if best[1] < values[-1]:
            simplex[-1], values[-1] = best
        else:
            simplex[1:] = simplex[0] + 0.5 * (simplex[1:] - simplex[0])
            values[1:] = [loss(v) for v in simplex[1:]]
    k = int(values.argmin())
    return float(np.exp(simplex[k][0])), float(simplex[k][1]), float(np.exp(simplex[k][2]))


def spei(obs: DataFrame, pet: Column, reference: tuple[str, str], window: int = 30, least: int = 30) -> DataFrame:
    """(station_id, date, spei): the balance precip - pet summed over the window, standardised by a log-logistic law per
    station and month. A group is one station's days of one month of the year, so it is bounded by the record's length."""
    ship(obs.sparkSession)
    frame = frames.trailing(window)
    balance = F.col("precip") - pet
    acc = F.when(F.count(balance).over(frame) >= int(0.9 * window), F.sum(balance).over(frame))
    rows = obs.select("station_id", "date", acc.alias("acc"), F.month("date").alias("month"), F.col("date").between(*reference).alias("reference"))

    def standardised(group: pd.DataFrame) -> pd.DataFrame:
        used = group.loc[group["reference"], "acc"].dropna().to_numpy()
        h = np.full(len(group), np.nan)
        if len(used) >= least and np.ptp(used) > 0:
            shape, loc, scale = fisk_fit(used)
            z = np.clip((group["acc"].to_numpy() - loc) / scale, 1e-12, None)
            h = np.clip(1 / (1 + z**-shape), 1e-4, 1 - 1e-4)
            h[group["acc"].isna()] = np.nan
        return pd.DataFrame({"station_id": group["station_id"], "date": group["date"], "h": h})

    found = rows.groupBy("station_id", "month").applyInPandas(standardised, "station_id string, date date, h double")
    h = F.when(~F.isnan("h"), F.col("h"))
    return found.select("station_id", "date", specfun.norm_ppf(h).alias("spei"))


def etccdi_annual(obs: DataFrame, thresholds: DataFrame, calendar: DataFrame, wet: float = 1.0, heavy: tuple[float, float] = (10.0, 20.0), least: float = 0.8) -> DataFrame:
    """Annual indices by station of a daily table; runs and five-day sums stay within the year. thresholds has p95_wet;
    calendar has doy, tx90_thr, tn10_thr."""
    from pyspark.sql import Window

    p = F.col("precip")
    year = obs.withColumn("year", F.year("date")).withColumn("doy", F.dayofyear("date"))
    rows = year.join(thresholds.select("station_id", "p95_wet"), "station_id", "left").join(calendar, ["station_id", "doy"], "left")
    keys = ("station_id", "year")
    rows = frames.run_length(rows, p < wet, F.lit(True), "dry", keys)
    rows = frames.run_length(rows, p >= wet, F.lit(True), "wetrun", keys)
    by = Window.partitionBy(*keys).orderBy("date").rowsBetween(-4, 0)
    rows = rows.withColumn("five", F.when(F.count(p).over(by) == 5, F.sum(p).over(by)))
    is_wet = p >= wet
    out = rows.groupBy(*keys).agg(
        (F.count(p) / F.count(F.lit(1))).alias("completeness"),
        F.coalesce(F.sum(F.when(is_wet, p)), F.lit(0.0)).alias("PRCPTOT"),
        F.avg(F.when(is_wet, p)).alias("SDII"),
        F.count_if(p >= heavy[0]).alias("R10mm"),
        F.count_if(p >= heavy[1]).alias("R20mm"),
        F.max(p).alias("Rx1day"),
        F.max("five").alias("Rx5day"),
        F.max("dry").alias("CDD"),
        F.max("wetrun").alias("CWD"),
        F.max("tmax").alias("TXx"),
        F.min("tmin").alias("TNn"),
        F.coalesce(F.sum(F.when(p > F.col("p95_wet"), p)), F.lit(0.0)).alias("R95pTOT"),
        (100 * F.avg(F.when(F.col("tmax").isNotNull() & F.col("tx90_thr").isNotNull(), (F.col("tmax") > F.col("tx90_thr")).cast("double")))).alias("TX90p"),
        (100 * F.avg(F.when(F.col("tmin").isNotNull() & F.col("tn10_thr").isNotNull(), (F.col("tmin") < F.col("tn10_thr")).cast("double")))).alias("TN10p"),
    )
    return out.filter(F.col("completeness") >= least)
