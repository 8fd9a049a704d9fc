"""Windows of daily channels as a table of blocks, and what window models do over them: scores, training, attributions.

A block holds a station's days [k * size, (k + 1) * size) and the window - 1 days before them, so every window of its own
days lies inside it and no task needs a neighbour's rows. A station of any length is many blocks; a block's memory is
bounded by its size. Blocks are made once, by one shuffle on (station, block), and every later pass reads them as they
are: windows are views on a block's array, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import logit
from ..session import ship
from . import frames, metrics
from .networks import Tcn, sigmoid
from .studies import uniform

#: Channels of a day, in this order: standardised values, whether they were observed, the calendar.
VALUES = ("precip", "tmax", "tmin")
CHANNELS = ("precip_log1p", "tmax", "tmin", "precip_obs", "tmax_obs", "tmin_obs", "doy_sin", "doy_cos", "monsoon")
#: Days of a block, windows that are computed at once.
BLOCK, BATCH = 4_096, 2_048


def channels(mean: tuple[float, ...], sd: tuple[float, ...]) -> Column:
    """The channels of a day as an array: a missing value is 0 (the mean) with 0 in its mask."""
    raw = (F.log1p(F.greatest("precip", F.lit(0.0))), F.col("tmax"), F.col("tmin"))
    values = [F.when(F.col(v).isNull(), 0.0).otherwise((x - m) / s) for v, x, m, s in zip(VALUES, raw, mean, sd, strict=True)]
    seen = [F.col(v).isNotNull().cast("double") for v in VALUES]
    angle = 2 * F.pi() * F.dayofyear("date") / 365.25
    return F.array(*values, *seen, F.sin(angle), F.cos(angle), F.month("date").isin(6, 7, 8, 9).cast("double"))


def blocks(dense: DataFrame, x: Column, target: Column, window: int = 60, size: int = BLOCK) -> DataFrame:
    """station_id, block, start (date of the first day), before (days that belong to the block before), x (days times channels,
    flat), y (target or null) of dense: every station on every day of one span, as frames.densify gives.

    Rows of a day that are repeated are an error of the caller (frames.regularise checks). A block with no day of its own is
    none."""
    if window - 1 > size:
        raise ValueError("a window is longer than a block")
    first = dense.agg(F.min("date").alias("zero"))
    # One row with the first date of the table.
    rows = dense.join(F.broadcast(first)).select("station_id", "date", F.datediff("date", "zero").alias("t"), x.alias("x"), target.cast("double").alias("y"))
    own = F.floor(F.col("t") / size)
    late = F.col("t") % size >= size - (window - 1)
    rows = rows.withColumn("block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("own", own == F.col("block"))
    held = rows.groupBy("station_id", "block").agg(F.array_sort(F.collect_list(F.struct("t", "date", "own", "x", "y"))).alias("days"))
    return held.filter(F.element_at("days", -1)["own"]).select(
        "station_id",
        "block",
        F.get("days", F.lit(0))["date"].alias("start"),
        F.size(F.filter("days", lambda d: ~d["own"])).alias("before"),
        F.flatten(F.transform("days", lambda d: d["x"])).alias("x"),
        F.transform("days", lambda d: d["y"]).alias("y"),
    )


def windows(batch: pa.RecordBatch, window: int, width: int, size: int = BATCH) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(station ids, dates, y, windows) of the blocks of an Arrow batch: whole windows that end on a block's own days, ``size`` at most at once."""
    for k in range(batch.num_rows):
        one = {name: batch.column(name)[k] for name in ("station_id", "start", "before", "x", "y")}
        days = one["x"].values.to_numpy(zero_copy_only=False).reshape(-1, width)
        y = one["y"].values.to_numpy(zero_copy_only=False).astype(float)
        first = max(one["before"].as_py(), window - 1)
        if first >= len(days):
            continue
        view = np.lib.stride_tricks.sliding_window_view(days, window, axis=0)
        start = np.datetime64(one["start"].as_py(), "D")
        for a in range(first, len(days), size):
            b = min(a + size, len(days))
            x = view[a - window + 1 : b - window + 1].transpose(0, 2, 1)
            yield [one["station_id"].as_py()] * (b - a), start + np.arange(a, b), y[a:b], x


def each_window(table: DataFrame, window: int, width: int, out: dict[str, pa.DataType], compute: Callable[[np.ndarray, np.ndarray], tuple], size: int = BATCH) -> DataFrame:
    """station_id, date, y and the columns out that compute(windows, y) gives, for every window of a table of blocks."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, dates, y, x in windows(batch, window, width, size):
                columns = [pa.array(c.tolist() if isinstance(c, np.ndarray) else c, t) for c, t in zip(compute(x, y), out.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(dates), pa.array(y, pa.float64(), from_pandas=True), *columns], names=["station_id", "date", "y", *out])

    kinds = {pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}
    return table.mapInArrow(run, "station_id string, date date, y double, " + ", ".join(f"{c} {kinds[t]}" for c, t in out.items()))


def scores(table: DataFrame, models: list, window: int = 60, width: int = len(CHANNELS)) -> DataFrame:
    """station_id, date, y, logits (one for each member) of every window."""
    return each_window(table, window, width, {"logits": pa.list_(pa.float64())}, lambda x, y: (np.stack([m.logits(x) for m in models], 1),))


def issued(scored: DataFrame, settings: dict) -> DataFrame:
    """Forecasts of member logits: probability, spread, confidence, epistemic part, conformal set, uncertainty, event.

    settings: temperature, q (quantiles of the classes 0 and 1), epistemic (median and 90th percentile on validation), threshold, lead."""
    p = F.transform("logits", lambda z: 1 / (1 + F.exp(-z)))
    tempered = F.transform(p, lambda v: 1 / (1 + F.exp(-logit(v) / settings["temperature"])))
    rows = scored.withColumn("members", tempered)
    parts = metrics.decompose(F.col("members"))
    rows = rows.select("station_id", "date", "y", *(parts[k].alias(k) for k in ("probability", "std", "confidence", "epistemic")))
    in0, in1 = F.col("probability") <= settings["q"][0], (1 - F.col("probability")) <= settings["q"][1]
    half, most = settings["epistemic"]
    return rows.select(
        "station_id",
        F.col("date").alias("issued"),
        F.date_add("date", settings["lead"]).alias("target_date"),
        "probability",
        F.col("std").alias("ensemble_std"),
        "confidence",
        "epistemic",
        F.concat(F.lit("{"), F.concat_ws(",", F.when(in0, "0"), F.when(in1, "1")), F.lit("}")).alias("conformal_set"),
        F.when((F.col("epistemic") > most) | (~in0 & ~in1), "high").when(F.col("epistemic") > half, "moderate").otherwise("low").alias("uncertainty"),
        (F.col("probability") >= settings["threshold"]).cast("int").alias("predicted_event"),
        F.col("y").cast("int").alias("observed_event"),
    )


def forecast(daily: DataFrame, stations: DataFrame, models: list, settings: dict, event: str, size: int = BLOCK) -> DataFrame:
    """The members' forecasts for every station and day with a whole window, with the share of its days that had precip."""
    window = settings["window"]
    dense = frames.densify(daily, stations)
    dense = dense.withColumn("_target", frames.target(F.col(event), settings["lead"], 1))
    told = issued(scores(blocks(dense, channels(settings["mean"], settings["sd"]), F.col("_target"), window, size), models, window), settings)
    seen = dense.select("station_id", F.col("date").alias("issued"), F.avg(F.col("precip").isNotNull().cast("double")).over(frames.trailing(window)).alias("window_observed_fraction"))
    return told.join(seen, ["station_id", "issued"])


# ---- training ----


def gradient(table: DataFrame, model: Tcn, window: int) -> tuple[float, np.ndarray, int]:
    """Mean log loss over the windows with a known y, its gradient by the parameters, and their number. Each task sums its own
    windows; the tasks' sums are added by an aggregate of one row for each parameter, which is all that reaches the driver."""
    width, size = model.channels, model.size
    ship(table.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2)
        for batch in batches:
            for _, _, y, x in windows(batch, window, width):
                known = ~np.isnan(y)
                if known.any():
                    loss, grad = model.loss_gradient(x[known], y[known])
                    total += np.concatenate([grad, [loss, known.sum()]])
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2), pa.int32()), pa.array(total, pa.float64())], names=["place", "value"])

    added = np.zeros(size + 2)
    for r in table.mapInArrow(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        added[r.place] = r.value
    n = int(added[-1])
    return added[-2] / max(n, 1), added[:-2] / max(n, 1), n


def _state(table: DataFrame, folder: str, values: np.ndarray) -> None:
    spark = table.sparkSession
    spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "place int, value double").coalesce(1).write.mode("overwrite").parquet(folder)


def train(table: DataFrame, validation: DataFrame, model: Tcn, window: int = 60, epochs: int = 10, steps: int = 4, rate: float = 1e-2, decay: float = 1e-4, patience: int = 3, folder: str | None = None) -> tuple[Tcn, list[tuple[int, float, float]]]:
    """(model with the best validation AUPRC, rows of epoch, train loss, val_auprc).

    Synchronous steps: in each epoch every block belongs to one of ``steps`` batches by a hash of its key and the epoch; the
    batch's gradient, clipped to norm 1, moves the parameters by Adam with decoupled decay. Training stops after ``patience``
    epochs without a gain of 1e-4. With a folder every epoch's state is written there and a later call goes on after the
    last whole epoch. table and validation should be stored, as each step reads them."""
    theta, m, v, t = model.theta.copy(), np.zeros(model.size), np.zeros(model.size), 0
    best, best_score, bad, history = theta.copy(), -np.inf, 0, []
    spark = table.sparkSession
    if folder:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(int(f.getPath().getName()) for f in files.listStatus(path)) if files.exists(path) else []
        for epoch in reversed([e for e in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{e}/_SUCCESS"))]):
            held = np.array([r.value for r in spark.read.parquet(f"{folder}/{epoch}").orderBy("place").collect()])
            theta, m, v, best = np.split(held[: 4 * model.size], 4)
            t, best_score, bad, *rest = held[4 * model.size :]
            history = [(int(a), float(b), float(c)) for a, b, c in np.reshape(rest, (-1, 3))]
            break
    for epoch in range(len(history), epochs):
        if bad >= patience:
            break
        losses, counts = 0.0, 0
        for step in range(steps):
            mine = table.filter(F.pmod(F.xxhash64("station_id", "block", F.lit(epoch)), F.lit(steps)) == step) if steps > 1 else table
            loss, grad, n = gradient(mine, model.at(theta), window)
            if not n:
                continue
            grad = grad / max(1.0, float(np.linalg.norm(grad)))
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta - rate * (m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + decay * theta)
            losses, counts = losses + loss * n, counts + n
        held = scores(validation, [model.at(theta)], window, model.channels).filter("y IS NOT NULL").select("y", (1 / (1 + F.exp(-F.col("logits")[0]))).alias("p"))
        found = metrics.average_precision(held).first()
        score = float(found.ap) if found is not None and found.ap is not None else -np.inf
        history.append((epoch, float(losses / max(counts, 1)), score))
        if score > best_score + 1e-4:
            best, best_score, bad = theta.copy(), score, 0
        else:
            bad += 1
        if folder:
            _state(table, f"{folder}/{epoch}", np.concatenate([theta, m, v, best, [t, best_score, bad], np.array(history, float).reshape(-1)]))
    return model.at(best), history


def thinned_labels(table: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """table with each known y kept with the given chance, by a hash of station and day; the windows stay."""
    day = lambda k: F.date_add(F.col("start"), k).cast("string")
    return table.withColumn("y", F.transform("y", lambda v, k: F.when(uniform(F.col("station_id"), day(k), seed) < share, v)))


def label_scarcity(table: DataFrame, validation: DataFrame, test: DataFrame, model: Tcn, shares: tuple[float, ...] = (0.05, 0.2, 1.0), window: int = 60, seed: int = 0, **training) -> list[tuple[float, int, int, float]]:
    """(label_fraction, n_train, n_train_events, auprc on test) of the model trained with part of the labels."""
    rows = []
    for share in shares:
        some = thinned_labels(table, share, seed)
        own = F.slice("y", F.greatest(F.col("before") + 1, F.lit(window)), F.size("y"))
        known = some.select(F.explode(own).alias("y")).agg(F.count("y").alias("n"), F.sum("y").alias("events")).first()
        fitted, _ = train(some, validation, model, window, **training)
        held = scores(test, [fitted], window, model.channels).filter("y IS NOT NULL").select("y", (1 / (1 + F.exp(-F.col("logits")[0]))).alias("p"))
        found = metrics.average_precision(held).first()
        rows.append((share, int(known.n), int(known.events or 0), float(found.ap) if found is not None and found.ap is not None else float("nan")))
    return rows


# ---- what a model relies on ----


def integrated_gradients(table: DataFrame, model, window: int = 60, width: int = len(CHANNELS), steps: int = 32, probability: bool = False) -> DataFrame:
    """station_id, date, y, value and base (the output of the window and of an all-zero one), channel (attribution by channel),
    channel_abs and lag_abs (sums of sizes by channel, and by lag with the newest day first) of every window.

    Gradients of the logit, or of the probability, are averaged over the middles of ``steps`` parts of the straight way from
    zero (the mean of every channel, nothing observed); attributions add up to value - base as steps grow."""

    def compute(x: np.ndarray, _) -> tuple:
        average = np.zeros(x.shape)
        for k in range(steps):
            z, grad = model.input_gradient((k + 0.5) / steps * x)
            if probability:
                s = sigmoid(z)
                grad = grad * (s * (1 - s))[:, None, None]
            average += grad / steps
        parts = x * average
        ends = [model.logits(x), model.logits(np.zeros_like(x[:1])).repeat(len(x))]
        value, base = map(sigmoid, ends) if probability else ends
        return value, base, parts.sum(1), np.abs(parts).sum(1), np.abs(parts).sum(2)[:, ::-1]

    many = pa.list_(pa.float64())
    return each_window(table, window, width, {"value": pa.float64(), "base": pa.float64(), "channel": many, "channel_abs": many, "lag_abs": many}, compute, 256)


def importance(attributions: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(name, importance): mean over windows of an array column of attributions."""
    rows = attributions.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("importance"))
    return rows.select(F.get(F.array(*map(F.lit, names)), F.col("k")).alias("name"), "importance")


def ablation(table: DataFrame, model, groups: dict[str, list[int]], window: int = 60, width: int = len(CHANNELS)) -> DataFrame:
    """(modality, auprc, auprc_drop): what average precision loses when a group's channels are zero, all groups in one pass."""
    names = ["none", *groups]

    def compute(x: np.ndarray, _) -> tuple:
        out = [model.logits(x)]
        for chosen in groups.values():
            kept = np.ones(width)
            kept[chosen] = 0
            out.append(model.logits(x * kept))
        return (sigmoid(np.stack(out, 1)),)

    scored = each_window(table, window, width, {"p": pa.list_(pa.float64())}, compute).filter("y IS NOT NULL")
    long = scored.select("y", F.posexplode("p").alias("k", "p")).select("y", "p", F.get(F.array(*map(F.lit, names)), F.col("k")).alias("modality"))
    found = metrics.average_precision(long, ["modality"]).select("modality", F.col("ap").alias("auprc"))
    whole = F.max(F.when(F.col("modality") == "none", F.col("auprc"))).over(Window.partitionBy())
    # One row for each modality.
    return found.select("modality", "auprc", (whole - F.col("auprc")).alias("auprc_drop"))


def counterfactual(table: DataFrame, model, mean: float, sd: float, factors: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0), days: int = 7, window: int = 60, width: int = len(CHANNELS)) -> DataFrame:
    """(factor, mean_probability): precipitation of the last ``days`` days times a factor where it was observed, in the
    measure's own unit."""

    def compute(x: np.ndarray, _) -> tuple:
        out = []
        for f in factors:
            changed = x.copy()
            recent = changed[:, -days:, 0]
            amount = np.maximum(np.expm1(recent * sd + mean), 0) * f
            changed[:, -days:, 0] = np.where(changed[:, -days:, 3] > 0.5, (np.log1p(amount) - mean) / sd, recent)
            out.append(sigmoid(model.logits(changed)))
        return (np.stack(out, 1),)

    scored = each_window(table, window, width, {"p": pa.list_(pa.float64())}, compute)
    return scored.select(F.posexplode("p").alias("k", "p")).groupBy("k").agg(F.avg("p").alias("mean_probability")).select(F.get(F.array(*map(F.lit, factors)), F.col("k")).alias("factor"), "mean_probability")
