"""Window models as registered queries: forecasts of a given weight table, attributions, what-ifs, training."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import frames, networks, sequences
from ..operators.materialize import once
from .surrogate import RD, query, region_day

WINDOW, DAYS, MEMBERS = 60, 512, 3
#: A day with more than this is an event on the scale of the stand-in data.
EVENT = 300
#: The settings that a saved model would bring.
SAVED = {"window": WINDOW, "lead": 1, "mean": (5.4, 85.0, 12.0), "sd": (0.6, 12.0, 9.0), "temperature": 1.7, "q": (0.62, 0.71), "epistemic": (0.02, 0.05), "threshold": 0.4}


def _weight(lag: int, channel: int, member: int) -> float:
    return math.cos(0.37 * lag + 1.3 * channel + 0.7 * member) * math.exp(-lag / 20.0) * 0.12


def _members() -> list[networks.Weighted]:
    """The weight table: member m's weight of a channel some days back, and its bias."""
    return [
        networks.Weighted(np.array([[_weight(WINDOW - 1 - i, c, m) for c in range(len(sequences.CHANNELS))] for i in range(WINDOW)]), -0.8 + 0.2 * m) for m in range(MEMBERS)
    ]


_X = [
    *(f"CASE WHEN {v} IS NULL THEN 0.0 ELSE ({x} - {m}) / {s} END" for v, x, m, s in zip(sequences.VALUES, ("ln(1 + greatest(precip, 0.0))", "tmax", "tmin"), SAVED["mean"], SAVED["sd"], strict=True)),
    *(f"CASE WHEN {v} IS NULL THEN 0.0 ELSE 1.0 END" for v in sequences.VALUES),
    "sin(2 * pi() * dayofyear(date) / 365.25)",
    "cos(2 * pi() * dayofyear(date) / 365.25)",
    "CASE WHEN month(date) IN (6, 7, 8, 9) THEN 1.0 ELSE 0.0 END",
]
#: Days times channels, and each member's logit over the 60 days that end on a date.
_DAYS = f"""{RD}, days AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM rd),
dn AS (SELECT s.station_id, days.date, precip, tmax, tmin FROM (SELECT DISTINCT station_id FROM rd) s CROSS JOIN days LEFT JOIN rd ON rd.station_id = s.station_id AND rd.date = days.date),
ch AS (SELECT station_id, date, precip, {", ".join(f"{x} AS x{c}" for c, x in enumerate(_X))},
  lead(CASE WHEN precip IS NULL THEN NULL WHEN precip > {EVENT} THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY station_id ORDER BY date) AS y FROM dn)"""
_Z = f"""pr AS (SELECT a.station_id, a.date, a.y, date_diff('day', b.date, a.date) AS lag, b.* EXCLUDE (station_id, date, y) FROM ch a JOIN ch b ON a.station_id = b.station_id AND b.date <= a.date AND b.date > a.date - {WINDOW}),
lg AS (SELECT station_id, date, any_value(y) AS y, avg(CASE WHEN precip IS NULL THEN 0.0 ELSE 1.0 END) AS seen, {{sums}} FROM pr GROUP BY 1, 2 HAVING count(*) = {WINDOW})"""


def _w_sql(c: int, m: int) -> str:
    return f"cos(0.37 * lag + {1.3 * c!r} + {0.7 * m!r}) * exp(-lag / 20.0) * 0.12"


def _z_sql(m: int, factor: str = "{x}") -> str:
    return f"{-0.8 + 0.2 * m!r} + sum(" + " + ".join(f"{_w_sql(c, m)} * {factor.format(x=f'x{c}', c=c)}" for c in range(len(_X))) + ")"


def _blocks(spark, d):
    daily = region_day(spark, d).withColumn("e", (F.col("precip") > EVENT).cast("double"))
    dense = frames.densify(daily, daily.select("station_id").distinct())
    dense = dense.withColumn("target", frames.target(F.col("e"), 1, 1))
    return sequences.blocks(dense, sequences.channels(SAVED["mean"], SAVED["sd"]), F.col("target"), WINDOW, DAYS)


_H = "-(least(greatest({p}, 1e-7), 1 - 1e-7) * log2(least(greatest({p}, 1e-7), 1 - 1e-7)) + (1 - least(greatest({p}, 1e-7), 1 - 1e-7)) * log2(1 - least(greatest({p}, 1e-7), 1 - 1e-7)))"
_P = ", ".join(f"1 / (1 + exp(-ln(least(greatest(1 / (1 + exp(-z{m})), 1e-7), 1 - 1e-7) / (1 - least(greatest(1 / (1 + exp(-z{m})), 1e-7), 1 - 1e-7))) / {SAVED['temperature']})) AS p{m}" for m in range(MEMBERS))
_ISSUED = f"""WITH {_DAYS}, {_Z.format(sums=", ".join(f"{_z_sql(m)} AS z{m}" for m in range(MEMBERS)))},
p AS (SELECT *, {_P} FROM lg), q AS (SELECT *, (p0 + p1 + p2) / 3 AS p FROM p),
d AS (SELECT *, sqrt((pow(p0 - p, 2) + pow(p1 - p, 2) + pow(p2 - p, 2)) / 3) AS std, {_H.format(p="p")} AS total, ({_H.format(p="p0")} + {_H.format(p="p1")} + {_H.format(p="p2")}) / 3 AS inner_part FROM q),
f AS (SELECT *, greatest(0.0, total - inner_part) AS epistemic, p <= {SAVED["q"][0]} AS in0, 1 - p <= {SAVED["q"][1]} AS in1 FROM d)
SELECT station_id, date AS issued, CAST(date + 1 AS DATE) AS target_date, round(p, 6) AS probability, round(std, 6) AS ensemble_std, round(1 - total, 6) AS confidence, round(epistemic, 6) AS epistemic,
  CASE WHEN in0 AND in1 THEN '{{0,1}}' WHEN in0 THEN '{{0}}' WHEN in1 THEN '{{1}}' ELSE '{{}}' END AS conformal_set,
  CASE WHEN epistemic > {SAVED["epistemic"][1]} OR NOT (in0 OR in1) THEN 'high' WHEN epistemic > {SAVED["epistemic"][0]} THEN 'moderate' ELSE 'low' END AS uncertainty,
  CAST(p >= {SAVED["threshold"]} AS INTEGER) AS predicted_event, CAST(y AS INTEGER) AS observed_event, round(seen, 6) AS window_observed_fraction FROM f"""


@query("m15_window_forecasts", _ISSUED)
def _(spark, d):
    daily = region_day(spark, d).withColumn("e", (F.col("precip") > EVENT).cast("double"))
    return sequences.forecast(daily, daily.select("station_id").distinct(), _members(), SAVED, "e", DAYS)


#: Gradient of the probability on the straight way: the logit's own gradient times s (1 - s) at the middles of 32 parts.
_IG = f"""WITH {_DAYS}, {_Z.format(sums=f"{_z_sql(0)} AS z0, " + ", ".join(f"sum({_w_sql(c, 0)} * x{c}) AS a{c}" for c in range(len(_X))))},
st AS (SELECT *, (k + 0.5) / 32 AS alpha FROM lg CROSS JOIN (SELECT unnest(range(0, 32)) AS k)),
sl AS (SELECT station_id, date, any_value(z0) AS z0, avg(exp(-(-0.8 + alpha * (z0 + 0.8))) / pow(1 + exp(-(-0.8 + alpha * (z0 + 0.8))), 2)) AS slope, {", ".join(f"any_value(a{c}) AS a{c}" for c in range(len(_X)))} FROM st GROUP BY 1, 2)
SELECT station_id, date, round(1 / (1 + exp(-z0)), 6) AS value, round(1 / (1 + exp(0.8)), 6) AS base, {", ".join(f"round(slope * a{c}, 6) AS {n}" for c, n in enumerate(sequences.CHANNELS))} FROM sl"""


@query("m16_integrated_gradients", _IG)
def _(spark, d):
    found = sequences.integrated_gradients(_blocks(spark, d), _members()[0], WINDOW, probability=True)
    return found.select("station_id", "date", "value", "base", *(F.col("channel")[c].alias(n) for c, n in enumerate(sequences.CHANNELS)))


_RECENT = [f"CASE WHEN lag < 7 AND x3 > 0.5 THEN (ln(1 + f * greatest(exp(x0 * {SAVED['sd'][0]} + {SAVED['mean'][0]}) - 1, 0)) - {SAVED['mean'][0]}) / {SAVED['sd'][0]} ELSE x0 END", *(f"x{c}" for c in range(1, len(_X)))]


@query(
    "m16_counterfactual_precip",
    f"""WITH {_DAYS}, pr AS (SELECT a.station_id, a.date, f, date_diff('day', b.date, a.date) AS lag, b.* EXCLUDE (station_id, date, y, precip) FROM ch a JOIN ch b ON a.station_id = b.station_id AND b.date <= a.date AND b.date > a.date - {WINDOW} CROSS JOIN (SELECT unnest([0.5, 1.0, 1.5, 2.0]) AS f)),
lg AS (SELECT station_id, date, f, -0.8 + sum({" + ".join(f"{_w_sql(c, 0)} * ({x})" for c, x in enumerate(_RECENT))}) AS z FROM pr GROUP BY 1, 2, 3 HAVING count(*) = {WINDOW})
SELECT CAST(f AS DOUBLE) AS factor, round(avg(1 / (1 + exp(-z))), 6) AS mean_probability FROM lg GROUP BY 1""",
)
def _(spark, d):
    return sequences.counterfactual(_blocks(spark, d), _members()[0], SAVED["mean"][0], SAVED["sd"][0], window=WINDOW)


_GROUPS = {"values": [0, 1, 2], "masks": [3, 4, 5], "calendar": [6, 7, 8]}


@query(
    "m16_modality_ablation",
    f"""WITH {_DAYS}, {_Z.format(sums=", ".join(f"{_z_sql(0, factor)} AS z_{name}" for name, factor in [("none", "{x}")]) + "".join(", " + f"-0.8 + sum({' + '.join(f'{_w_sql(c, 0)} * x{c}' for c in range(len(_X)) if c not in chosen)}) AS z_{name}" for name, chosen in _GROUPS.items()))},
lo AS (SELECT y, unnest(['none', 'values', 'masks', 'calendar']) AS modality, unnest([z_none, z_values, z_masks, z_calendar]) AS z FROM lg WHERE y IS NOT NULL),
sc AS (SELECT modality, z, sum(y) AS pos, count(*) AS n FROM lo GROUP BY 1, 2),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY modality ORDER BY z DESC) AS tp, sum(n) OVER (PARTITION BY modality ORDER BY z DESC) AS seen, sum(pos) OVER (PARTITION BY modality) AS events FROM sc),
ap AS (SELECT modality, sum(pos / events * tp / seen) AS auprc FROM cu GROUP BY 1)
SELECT modality, round(auprc, 4) AS auprc, round(max(CASE WHEN modality = 'none' THEN auprc END) OVER () - auprc, 4) AS auprc_drop FROM ap""",
)
def _(spark, d):
    found = sequences.ablation(_blocks(spark, d), _members()[0], _GROUPS, WINDOW)
    return found.select("modality", F.round("auprc", 4).alias("auprc"), F.round("auprc_drop", 4).alias("auprc_drop"))


@query("m14_tcn_training")
def _(spark, d):
    """epoch, train_loss, val_auprc of a small network: trained on the first three quarters of the blocks' days, judged on the last."""
    table = once(_blocks(spark, d))
    last = table.agg(F.max("block")).first()[0] or 0
    cut = max(1, round(0.75 * (last + 1)))
    model = networks.Tcn(len(sequences.CHANNELS), hidden=8, levels=5).started(7)
    _, history = sequences.train(table.filter(F.col("block") < cut), table.filter(F.col("block") >= cut), model, WINDOW, epochs=3, steps=2)
    return spark.createDataFrame(history, "epoch int, train_loss double, val_auprc double")
