"""Splits without leakage, statistical baselines and tabular learners."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .studies import uniform

FOLDS = ("train", "val", "test")


def embargoed(periods: dict[str, tuple[date, date]], gap: int, lead: int) -> dict[str, tuple[date, date]]:
    """Every fold but the first starts ``gap`` days late; every fold ends ``lead`` days early, so that target dates stay inside."""
    first = min(periods, key=lambda f: periods[f][0])
    return {f: (a if f == first else a + timedelta(days=gap), b - timedelta(days=lead)) for f, (a, b) in periods.items()}


def station_folds(stations: DataFrame, strategy: str = "basin", test_groups: tuple[str, ...] = (), test_share: float = 0.3, val_share: float = 0.2, seed: int = 0) -> DataFrame:
    """(fold, station_id): test stations are those of the named basins (basin), those at or east of the longitude that leaves
    test_share of them in the east (longitude_block), or a drawn test_share of all (random_station). Of each basin's other
    stations the rounded val_share, one at least but never all, is drawn for validation.

    Stations are a dimension of some thousand rows: an order of all of them is one small task. Draws are hashes of ids."""
    if strategy == "basin":
        marked = stations.select("station_id", "basin", F.col("basin").isin(*test_groups).alias("test"))
    elif strategy == "longitude_block":
        cut = stations.agg(F.percentile("lon", F.lit(1 - test_share)).alias("cut"))
        marked = stations.join(F.broadcast(cut)).select("station_id", "basin", (F.col("lon") >= F.col("cut")).alias("test"))
    elif strategy == "random_station":
        drawn = F.row_number().over(Window.orderBy(uniform(F.col("station_id"), "test", seed), "station_id"))
        marked = stations.select("station_id", "basin", (drawn <= F.floor(F.count(F.lit(1)).over(Window.partitionBy()) * test_share)).alias("test"))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    rest = Window.partitionBy("basin", "test")
    rank = F.row_number().over(rest.orderBy(uniform(F.col("station_id"), "val", seed), "station_id"))
    n = F.count(F.lit(1)).over(rest)
    val = rank <= F.least(F.greatest(F.lit(1), F.bround(n * val_share)), n - 1)
    return marked.select(F.when(F.col("test"), "test").when(val, "val").otherwise("train").alias("fold"), "station_id")


def split(mode: str, stations: DataFrame, periods: dict[str, tuple[date, date]], gap: int = 60, lead: int = 1, **grouping) -> DataFrame:
    """(fold, station_id, start, end). temporal: all stations, a period each; spatial: station groups, all over the training
    period; spatiotemporal: station groups, a period each. grouping goes to station_folds. Fails on leakage."""
    if mode not in ("temporal", "spatial", "spatiotemporal"):
        raise ValueError(f"unknown split {mode}")
    timed = embargoed(periods, gap, lead)
    if mode == "spatial":
        timed = dict.fromkeys(timed, timed["train"])
    folds = F.broadcast(stations.sparkSession.createDataFrame([(f, *timed[f]) for f in timed], "fold string, start date, end date"))
    if mode == "temporal":
        out = stations.select("station_id").join(folds)
    else:
        out = station_folds(stations, **grouping).join(folds, "fold")
    out = out.select("fold", "station_id", "start", "end")
    check_leakage(out, mode)
    return out


def check_leakage(folds: DataFrame, mode: str) -> None:
    """Fails where folds share stations (spatial and spatiotemporal) or their periods overlap (temporal and spatiotemporal)."""
    if mode != "temporal" and not folds.groupBy("station_id").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty():
        raise AssertionError("a station is in two folds")
    if mode != "spatial":
        spans = folds.groupBy("fold").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        # One row for each fold.
        before = F.max("end").over(Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
        if not spans.withColumn("before", before).filter(F.col("before") >= F.col("start")).isEmpty():
            raise AssertionError("two folds overlap in time")


def climatology(train: DataFrame, event: str, half: int = 15) -> DataFrame:
    """(doy, probability): smoothed event rate within ``half`` days on a 366-day circle, (s + 0.5) / (n + 1)."""
    days = train.filter(F.col(event).isNotNull()).groupBy(F.dayofyear("date").alias("d")).agg(F.sum(event).alias("s"), F.count(event).alias("n"))
    spread = days.select("s", "n", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda o: F.pmod(F.col("d") - 1 + o, F.lit(366)) + 1)).alias("doy"))
    return spread.groupBy("doy").agg(((F.sum("s") + 0.5) / (F.sum("n") + 1)).alias("probability"))


def persistence(train: DataFrame, today: str, event: str) -> DataFrame:
    """(today, probability) of the event given today's state; the base rate where today is unknown."""
    known = train.filter(F.col(event).isNotNull())
    rates = known.filter(F.col(today).isNotNull()).groupBy(F.col(today).alias("today")).agg(((F.sum(event) + 0.5) / (F.count(event) + 1)).alias("probability"))
    return rates.unionByName(known.agg(F.lit(None).cast("double").alias("today"), F.avg(event).alias("probability")))


def samples(daily: DataFrame, stations: DataFrame, target: str, lead: int = 1, horizon: int = 1, window: int = 60, least: float = 0.5) -> DataFrame:
    """Rows that can be learned from: a known target, and at least ``least`` of the last ``window`` days observed."""
    dense = frames.densify(daily, stations)
    rows = dense.withColumn("target", frames.target(F.col(target), lead, horizon))
    rows = rows.withColumn("observed", F.avg(F.col("precip").isNotNull().cast("double")).over(frames.trailing(window)))
    rows = rows.withColumn("t", F.row_number().over(frames.by_date()))
    return rows.filter(F.col("target").isNotNull() & (F.col("observed") >= least) & (F.col("t") >= window)).drop("t")


def tabular_features(daily: DataFrame, variables: tuple[str, ...] = ("precip", "tmax", "tmin"), lags: tuple[int, ...] = (1, 3, 7, 15, 30), windows: tuple[int, ...] = (3, 7, 15, 30)) -> DataFrame:
    """Lags, trailing statistics and calendar columns, all over one partitioning and order."""
    out = {}
    for v in variables:
        x = F.log1p(v) if v == "precip" else F.col(v)
        out[f"{v}_now"] = x
        out |= {f"{v}_lag{k}": F.lag(x, k).over(frames.by_date()) for k in lags}
        for w in windows:
            least = max(1, int(0.7 * w))
            out |= {f"{v}_mean{w}": frames.rolling(x, w, least, F.avg), f"{v}_std{w}": frames.rolling(x, w, least, F.stddev_samp)}
            if v == "precip" or w >= 7:
                out |= {f"{v}_max{w}": frames.rolling(x, w, least, F.max), f"{v}_min{w}": frames.rolling(x, w, least, F.min)}
    angle = 2 * F.pi() * F.dayofyear("date") / 365.25
    out |= {"doy_sin": F.sin(angle), "doy_cos": F.cos(angle), "monsoon": F.month("date").isin(6, 7, 8, 9).cast("double")}
    return daily.withColumns(out)


def _prepared(columns: list[str]) -> list:
    filled = [f"_{c}" for c in columns]
    return [Imputer(inputCols=columns, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]


def classifier(kind: str, columns: list[str], rows: int, seed: int = 0) -> Pipeline:
    """logistic (C = 0.5), random_forest (300 trees, leaves of 20) or gbt, over imputed and scaled columns; label column ``label``."""
    known = {
        "logistic": lambda: LogisticRegression(regParam=1 / (0.5 * max(rows, 1)), maxIter=100),
        "random_forest": lambda: RandomForestClassifier(numTrees=300, minInstancesPerNode=20, featureSubsetStrategy="sqrt", maxDepth=12, seed=seed),
        "gbt": lambda: GBTClassifier(maxIter=50, maxDepth=4, stepSize=0.1, seed=seed),
    }
    return Pipeline(stages=[*_prepared(columns), known[kind]()])


def regressor(kind: str, columns: list[str], seed: int = 0) -> Pipeline:
    known = {
        "linear": lambda: LinearRegression(),
        "tweedie": lambda: GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, maxIter=50, regParam=1e-3),
        "poisson": lambda: GeneralizedLinearRegression(family="poisson", link="log", maxIter=50, regParam=1e-3),
        "gbt": lambda: GBTRegressor(maxIter=50, maxDepth=4, seed=seed),
    }
    return Pipeline(stages=[*_prepared(columns), known[kind]()])


def scored(model, rows: DataFrame) -> DataFrame:
    """rows with p, the probability of the event."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def permutation_importance(model, rows: DataFrame, columns: list[str], metric, seed: int = 0) -> list[tuple[str, float]]:
    """Loss of the metric (a one-value table of y and p) when a column's values are dealt to other rows, largest first."""
    key = rows.withColumn("y", F.col("label"))
    value = lambda df: metric(scored(model, df).select("y", "p")).first()[0]
    base, out = value(key), []
    for c in columns:
        # Positions by two different orders within hash buckets, so that no task holds all rows.
        bucket = F.pmod(F.xxhash64("station_id", "date"), F.lit(64))
        numbered = key.withColumn("_b", bucket)
        a = numbered.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy("station_id", "date"))).drop(c)
        b = numbered.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(F.xxhash64("date", "station_id", F.lit(seed))))).select("_b", "_n", c)
        out.append((c, float(base - value(a.join(b, ["_b", "_n"])))))
    return sorted(out, key=lambda t: -t[1])
