"""Blocks, window models, training and attributions against plain versions."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.operators import frames, networks, sequences

W, C = 6, len(sequences.CHANNELS)
MEAN, SD = (1.0, 20.0, 10.0), (0.5, 4.0, 3.0)


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in ("a", "b", "c"):
        for k in range(75):
            if rng.random() < 0.8:
                v = [None if rng.random() < 0.1 else float(x) for x in (rng.gamma(1, 5), rng.normal(20, 4), rng.normal(10, 3))]
                rows.append((s, date(2020, 2, 1) + timedelta(k), *v))
    return spark.createDataFrame(rows, "station_id string, date date, precip double, tmax double, tmin double")


def plain(daily, window=W):
    """{(station, date): (window, y)} by loops over dictionaries."""
    held = {(r.station_id, r.date): r for r in daily.collect()}
    days = sorted({d for _, d in held})
    days = [days[0] + timedelta(k) for k in range((days[-1] - days[0]).days + 1)]

    def channels(s, d):
        r, out, seen = held.get((s, d)), [], []
        for name, m, sd in zip(sequences.VALUES, MEAN, SD, strict=True):
            v = getattr(r, name) if r else None
            seen.append(float(v is not None))
            out.append(0.0 if v is None else ((math.log1p(max(v, 0)) if name == "precip" else v) - m) / sd)
        angle = 2 * math.pi * d.timetuple().tm_yday / 365.25
        return [*out, *seen, math.sin(angle), math.cos(angle), float(d.month in (6, 7, 8, 9))]

    def event(s, d):
        r = held.get((s, d))
        return float(r.precip > 6) if r and r.precip is not None else math.nan

    return {(s, d): (np.array([channels(s, e) for e in days[k - window + 1 : k + 1]]), event(s, d + timedelta(1))) for s in {s for s, _ in held} for k, d in enumerate(days) if k >= window - 1}


def table_of(daily, size, window=W):
    daily = daily.withColumn("e", (F.col("precip") > 6).cast("double"))
    dense = frames.densify(daily, daily.select("station_id").distinct()).withColumn("target", frames.target(F.col("e"), 1, 1))
    return sequences.blocks(dense, sequences.channels(MEAN, SD), F.col("target"), window, size)


def net(seed=3):
    return networks.Tcn(C, hidden=4, levels=3).started(seed)


def weighted():
    rng = np.random.default_rng(5)
    return networks.Weighted(rng.normal(0, 0.2, (W, C)), 0.1)


@pytest.mark.parametrize("size", [5, 7, 1000])
def test_windows_are_whole_and_once(daily, size):
    want = plain(daily)
    models = [net(), weighted()]
    rows = sequences.scores(table_of(daily, size), models, W).collect()
    assert len(rows) == len(want) and {(r.station_id, r.date) for r in rows} == set(want)
    for r in rows:
        x, y = want[r.station_id, r.date]
        assert np.allclose(r.logits, [m.logits(x[None])[0] for m in models], atol=1e-9)
        assert (r.y is None and math.isnan(y)) or r.y == y
    assert max(r.n for r in table_of(daily, size).select(F.size("y").alias("n")).collect()) <= size + W - 1


def test_blocks_of_few_or_no_days(daily):
    assert sequences.scores(table_of(daily.filter("false"), 7), [weighted()], W).collect() == []
    assert sequences.scores(table_of(daily.filter("date < '2020-02-05'"), 7), [weighted()], W).collect() == []
    with pytest.raises(ValueError):
        table_of(daily, W - 2)


def test_network_gradients_are_finite_differences():
    rng = np.random.default_rng(2)
    model = net()
    model = model.at(model.theta + rng.normal(0, 0.05, model.size))
    x, y = rng.normal(0, 1, (5, W, C)), rng.integers(0, 2, 5).astype(float)
    loss, grad = model.loss_gradient(x, y)
    for k in range(model.size):
        up, down = model.theta.copy(), model.theta.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert abs((model.at(up).loss_gradient(x, y)[0] - model.at(down).loss_gradient(x, y)[0]) / 2e-6 - grad[k]) < 1e-4
    z, dx = model.input_gradient(x)
    for i, j, c in ((0, W - 1, 0), (3, 2, 5), (4, 0, 8)):
        up, down = x.copy(), x.copy()
        up[i, j, c] += 1e-6
        down[i, j, c] -= 1e-6
        assert abs((model.logits(up)[i] - model.logits(down)[i]) / 2e-6 - dx[i, j, c]) < 1e-5
    assert np.allclose(z, model.logits(x)) and loss > 0


def test_distributed_gradient_is_that_of_one_batch(daily):
    want = [v for v in plain(daily).values() if not math.isnan(v[1])]
    x, y = np.stack([v[0] for v in want]), np.array([v[1] for v in want])
    loss, grad = net().loss_gradient(x, y)
    for parts in (1, 4, 24):
        got = sequences.gradient(table_of(daily, 7).repartition(parts), net(), W)
        assert got[2] == len(y) and abs(got[0] - loss / len(y)) < 1e-9 and np.allclose(got[1], grad / len(y), atol=1e-9)
    assert sequences.gradient(table_of(daily.filter("false"), 7), net(), W)[2] == 0


def test_training_learns_stops_and_goes_on(spark, daily, tmp_path):
    table = table_of(daily, 20).cache()
    first, history = sequences.train(table, table, net(), W, epochs=4, steps=2, rate=0.03)
    again, other = sequences.train(table.repartition(24), table.repartition(4), net(), W, epochs=4, steps=2, rate=0.03)
    assert np.allclose(first.theta, again.theta, atol=1e-7) and np.allclose(history, other, atol=1e-7)
    assert history[-1][1] < history[0][1]
    folder = f"file://{tmp_path}/run"
    sequences.train(table, table, net(), W, epochs=2, steps=2, rate=0.03, folder=folder)
    resumed, whole = sequences.train(table, table, net(), W, epochs=4, steps=2, rate=0.03, folder=folder)
    assert np.allclose(whole, history, atol=1e-7) and np.allclose(resumed.theta, first.theta, atol=1e-7)
    # A rate of zero gains nothing, so training ends with the patience.
    assert len(sequences.train(table, table, net(), W, epochs=9, steps=1, rate=0.0, patience=2)[1]) == 3


def test_label_scarcity_thins_labels_only(daily):
    table = table_of(daily, 20).cache()
    known = sum(not math.isnan(y) for _, y in plain(daily).values())
    events = sum(y for _, y in plain(daily).values() if y == 1)
    some = {(r.station_id, r.date): r.y for r in sequences.scores(sequences.thinned_labels(table, 0.4), [weighted()], W).collect()}
    whole = {(r.station_id, r.date): r.y for r in sequences.scores(table, [weighted()], W).collect()}
    left = {k for k, y in some.items() if y is not None}
    assert some.keys() == whole.keys() and all(some[k] == whole[k] for k in left) and 0.2 * known < len(left) < 0.6 * known
    rows = sequences.label_scarcity(table, table, table, net(), (0.4, 1.0), W, epochs=1, steps=1)
    assert [r[:3] for r in rows] == [(0.4, len(left), sum(some[k] == 1 for k in left)), (1.0, known, events)]
    assert all(0 < r[3] <= 1 for r in rows)


def test_attributions_add_up(daily):
    want = plain(daily)
    table = table_of(daily, 9)
    for probability in (False, True):
        for model in (net(), weighted()):
            rows = sequences.integrated_gradients(table, model, W, steps=400, probability=probability).collect()
            assert len(rows) == len(want)
            for r in rows[::17]:
                x = want[r.station_id, r.date][0]
                z, base = model.logits(x[None])[0], model.logits(np.zeros((1, W, C)))[0]
                ends = [networks.sigmoid(np.array(v)) if probability else v for v in (z, base)]
                assert abs(r.value - ends[0]) < 1e-9 and abs(r.base - ends[1]) < 1e-9
                assert abs(sum(r.channel) - (r.value - r.base)) < 5e-3
                assert all(abs(a) <= b + 1e-12 for a, b in zip(r.channel, r.channel_abs, strict=True)) and abs(sum(r.channel_abs) - sum(r.lag_abs)) < 1e-9
    exact = sequences.integrated_gradients(table, weighted(), W, steps=1)
    r = exact.first()
    assert np.allclose(r.channel, (want[r.station_id, r.date][0] * weighted().weights).sum(0))
    assert np.allclose(r.lag_abs, np.abs(want[r.station_id, r.date][0] * weighted().weights).sum(1)[::-1])
    named = {r.name: r.importance for r in sequences.importance(exact, "channel_abs", list(sequences.CHANNELS)).collect()}
    assert set(named) == set(sequences.CHANNELS)
    assert abs(named["tmax"] - np.mean([np.abs(x[:, 1] * weighted().weights[:, 1]).sum() for x, _ in want.values()])) < 1e-9


def test_ablation_and_counterfactual(daily):
    want, model, table = plain(daily), weighted(), table_of(daily, 9)

    def ap(p, y):
        order = np.argsort(-p, kind="stable")
        total, hits, out = sum(y), 0, 0.0
        for k, i in enumerate(order, 1):
            hits += y[i]
            out += y[i] / total * hits / k
        return out

    known = [(x, y) for x, y in want.values() if not math.isnan(y)]
    x, y = np.stack([a for a, _ in known]), np.array([b for _, b in known])
    kept = np.ones(C)
    kept[:3] = 0
    scores = {"none": ap(model.logits(x), y), "values": ap(model.logits(x * kept), y)}
    for r in sequences.ablation(table, model, {"values": [0, 1, 2]}, W).collect():
        assert abs(r.auprc - scores[r.modality]) < 1e-9 and abs(r.auprc_drop - (scores["none"] - scores[r.modality])) < 1e-9
    got = {r.factor: r.mean_probability for r in sequences.counterfactual(table, model, MEAN[0], SD[0], (1.0, 2.0), 3, W).collect()}
    alls = np.stack([a for a, _ in want.values()])
    assert abs(got[1.0] - networks.sigmoid(model.logits(alls)).mean()) < 1e-9
    changed = alls.copy()
    seen = changed[:, -3:, 3] > 0.5
    changed[:, -3:, 0] = np.where(seen, (np.log1p(2 * np.maximum(np.expm1(changed[:, -3:, 0] * SD[0] + MEAN[0]), 0)) - MEAN[0]) / SD[0], changed[:, -3:, 0])
    assert abs(got[2.0] - networks.sigmoid(model.logits(changed)).mean()) < 1e-9
