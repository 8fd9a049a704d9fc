"""What a study of event forecasts needs around the models: station features, folds by station groups, thinned and damaged
inputs, summaries of predictions, resampling tests and verdicts.

Random draws are functions of row keys (``uniform``), so a job that is run again, or whose executor is lost, draws the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geo
from .materialize import once


def _digits(*keys: Column | str | int) -> Column:
    """The eight hex digits that uniform is made of, in the same order."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8)


def uniform(*keys: Column | str | int) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.conv(_digits(*keys), 16, 10).cast("double") / 4294967296.0


def uniform_sql(*keys: str) -> str:
    """The same in SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0)"


# ---- stations ----


def reference_completeness(daily: DataFrame, stations: DataFrame, reference: tuple[str, str], variable: str) -> DataFrame:
    """(station_id, completeness): share of a station's days of the reference period that have a value; 0 without any day."""
    held = daily.filter(F.col("date").between(*reference)).groupBy("station_id").agg(F.avg(F.col(variable).isNotNull().cast("double")).alias("share"))
    return stations.select("station_id").join(held, "station_id", "left").select("station_id", F.coalesce("share", F.lit(0.0)).alias("completeness"))


def static_features(stations: DataFrame, cells: DataFrame, grid: tuple, segments: DataFrame, edges: DataFrame, daily: DataFrame, reference: tuple[str, str], variable: str) -> DataFrame:
    """One row per station: elevation, slope, sine and cosine of the aspect and relief of its raster cell, distance to the
    river, its zone and its completeness in the reference period."""
    x0, dx, y0, dy = grid
    # A station meets the terrain of one cell: an equi-join.
    placed = stations.select("station_id", F.floor((y0 - F.col("lat")) / dy).cast("int").alias("row"), F.floor((F.col("lon") - x0) / dx).cast("int").alias("col"))
    terrain = geo.slope_aspect(cells, grid).select("row", "col", "slope", "aspect").join(geo.relief(cells).select("row", "col", "relief"), ["row", "col"])
    terrain = terrain.join(cells.select("row", "col", F.col("value").alias("elevation")), ["row", "col"])
    flat = F.col("aspect") < 0
    out = placed.join(terrain, ["row", "col"], "left").select(
        "station_id", "elevation", "slope", "relief",
        F.when(flat, 0.0).otherwise(F.sin(F.radians("aspect"))).alias("aspect_sin"), F.when(flat, 0.0).otherwise(F.cos(F.radians("aspect"))).alias("aspect_cos"),
    )
    for more in (
        geo.polyline_distance(stations, segments).withColumnRenamed("km", "river_km"),
        geo.point_in_polygon(stations, edges).select("station_id", F.col("attr").alias("zone")),
        reference_completeness(daily, stations, reference, variable),
    ):
        out = out.join(more, "station_id", "left")
    return out


def folds_by_group(stations: DataFrame, by: str, seed: int = 0, blocks: int = 8) -> DataFrame:
    """(station_id, group, fold): whole groups of stations to train (60 %), val (20 %) and test, in an order drawn by the seed.
    ``by``: a column, "longitude_block" (blocks of equal size from west to east) or "random" (every station for itself).

    Stations are a dimension of some thousand rows, so an order of all of them is one small task.
    """
    if by == "longitude_block":
        group = F.ntile(blocks).over(Window.orderBy("lon", "station_id")).cast("string")
    else:
        group = F.col("station_id" if by == "random" else by).cast("string")
    named = stations.select("station_id", group.alias("group"))
    order = named.select("group").distinct().withColumn("k", F.row_number().over(Window.orderBy(uniform(F.col("group"), seed), "group")) - 1)
    share = F.col("k") / F.count(F.lit(1)).over(Window.partitionBy())
    dealt = order.select("group", F.when(share < 0.6, "train").when(share < 0.8, "val").otherwise("test").alias("fold"))
    return named.join(F.broadcast(dealt), "group").select("station_id", "group", "fold")


def stratified(rows: DataFrame, label: str, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """rows with ``validation``: each row with the given chance, drawn apart for each value of the label, so a value's share is near it."""
    # Drawn by a threshold on a hash and not by a rank, so that no task holds a whole class.
    drawn = uniform(*(F.col(k).cast("string") for k in keys), F.col(label).cast("string"), seed)
    return rows.withColumn("validation", drawn < share)


def selected(stations: DataFrame, station_id: str | None = None, **where: str) -> DataFrame:
    """The station of an id, or those whose columns have the given values; none at all is an error."""
    chosen = stations.filter(F.col("station_id") == station_id) if station_id is not None else stations
    for column, value in where.items() if station_id is None else ():
        chosen = chosen.filter(F.col(column) == value)
    if chosen.isEmpty():
        raise LookupError(f"no station: {station_id or where}")
    return chosen


def check_request(days: int, stations: int, max_days: int = 400, factor: int = 40) -> None:
    """Refuses a request for more station-days than max_days times factor."""
    if days * stations > max_days * factor:
        raise ValueError(f"{days} days of {stations} stations are too many")


def normaliser(daily: DataFrame, folds: DataFrame, period: tuple[str, str], variables: list[str], static: DataFrame | None = None) -> DataFrame:
    """(variable, mean, sd) of the train stations' days of the train period (sd + 1e-6), and of their static columns (an sd of at
    most 1e-5 is 1)."""
    train = folds.filter(F.col("fold") == "train").select("station_id")
    used = daily.filter(F.col("date").between(*period)).join(F.broadcast(train), "station_id", "left_semi")

    def moments(df: DataFrame, names: list[str]) -> DataFrame:
        both = df.agg(*(F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd")).alias(v) for v in names))
        return both.unpivot([], names, "variable", "m").select("variable", "m.mean", "m.sd")

    out = moments(used, variables).withColumn("sd", F.col("sd") + 1e-6)
    if static is not None:
        names = [c for c, t in static.dtypes if c != "station_id" and t in ("double", "float", "int", "bigint")]
        groups = moments(static.join(F.broadcast(train), "station_id", "left_semi").select(*(F.col(c).cast("double").alias(c) for c in names)), names)
        out = out.unionByName(groups.withColumn("sd", F.when(F.col("sd") > 1e-5, F.col("sd")).otherwise(1.0)))
    return out


# ---- thinned and damaged inputs ----


def thinned(rows: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample of rows by their keys."""
    return rows.filter(uniform(*(F.col(k).cast("string") for k in keys), seed) < share)


def masked_days(daily: DataFrame, variables: list[str], rate: Column | float, seed: int = 0) -> DataFrame:
    """Whole days lost at random: values 0 and their masks 0, as where a day was never observed."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    lost = uniform(F.col("station_id"), F.col("date").cast("string"), seed) < rate
    out = {}
    for v in variables:
        here = ~lost & F.col(v).isNotNull()
        out[v] = F.when(here, F.col(v)).otherwise(0.0)
        out[f"{v}_mask"] = here.cast("int")
    return daily.withColumns(out)


def sweep(rows: DataFrame, levels: list[float], change: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The metric by ``level``: every row once per level, changed by what its level column says, in one pass."""
    leveled = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return metric(change(leveled), ["level"])


# ---- predictions ----


def prediction_summary(predictions: DataFrame, by: list[str]) -> DataFrame:
    """By station, or by target date: number, mean, largest and sum of the probabilities, their 10th and 90th percentiles, the
    share of high uncertainty, and the mean of what was observed (unknown ones aside)."""
    p = F.col("probability")
    return predictions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.max(p).alias("max_probability"), F.sum(p).alias("expected_events"), F.percentile(p, F.lit(0.1)).alias("p10"), F.percentile(p, F.lit(0.9)).alias("p90"),
        F.avg((F.col("uncertainty") == "high").cast("double")).alias("share_high"), F.avg("observed_event").alias("observed_rate"),
    )


def scores_by_year(predictions: DataFrame) -> DataFrame:
    """(model, year, auprc, base_rate, brier) of columns model, year, y and p."""
    from .metrics import average_precision, brier

    by = ["model", "year"]
    return average_precision(predictions, by).select(*by, F.col("ap").alias("auprc"), "base_rate").join(brier(predictions, by).select(*by, "brier"), by)


def top_attributions(rows: DataFrame, key: str, values: str, k: int = 8) -> DataFrame:
    """(key, feature, value, rank): the k entries of an array of attributions that are largest in size, the first on ties."""
    # Within the row: no shuffle, however many rows there are.
    ranked = F.array_sort(F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("feature"), v.cast("double").alias("value"))))
    out = rows.select(key, F.posexplode(F.slice(ranked, 1, k)).alias("rank", "a"))
    return out.select(key, F.col("a.feature").alias("feature"), F.col("a.value").alias("value"), (F.col("rank") + 1).alias("rank"))


# ---- tables side by side ----


def aligned(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables side by side on their keys, rows of either kept."""
    return left.join(right, keys, "full")


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """parents with the array of their children, in order of their fields; an empty one without any."""
    grouped = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = grouped.schema[name].dataType.simpleString()
    return parents.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


# ---- tests by resampling ----


def permutation_test(values: DataFrame, in_first: Column, value: str, key: str, draws: int = 2000, seed: int = 0, least: int = 5, band: float = 6.0) -> DataFrame:
    """(n_first, n_second, difference, p_value): two-sided test of the difference of means under dealt membership.

    Each draw orders the values by a hash of draw and key and calls the first n_first of them the first sample; p is
    (hits + 1) / (draws + 1). Hashes are uniform, so where the first sample ends is known within a few standard deviations
    (``band``): values before and after that are summed where they are made, and only those between, which grow with the
    root of the number of values, are shuffled and ordered. A draw that ends elsewhere is ordered whole. Null where a sample
    has no more than ``least`` values.
    """
    # Values may come from one small file: they are spread before each is dealt ``draws`` times.
    parts = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.sparkSession.sparkContext.defaultParallelism)
    x = values.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), in_first.cast("int").alias("one"))
    seen = x.agg(F.sum("one").alias("n_first"), F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("one") == 1, F.col("v"))) - F.avg(F.when(F.col("one") == 0, F.col("v")))).alias("difference"))
    size = seen.first()
    n_first, n = size["n_first"] or 0, max(size["n"], 1)
    reach = band * (n_first * (n - n_first) / n) ** 0.5 / n
    low, high = (min(max(int((n_first / n + way * reach) * 2**32), 0), 2**32 - 1) for way in (-1, 1))
    spread = x.select("k", "v").repartition(parts, "k")
    found = once(_dealt(spread, list(range(1, draws + 1)), n_first, low, high, seed))
    # Numbers of draws, of which there are some thousand.
    missed = [r["draw"] for r in found.filter("NOT held").select("draw").collect()]
    if missed:
        found = found.filter("held").unionByName(_dealt(spread, missed, n_first, 0, 2**32 - 1, seed))
    hits = found.join(F.broadcast(seen)).agg(F.count_if(F.abs("d") >= F.abs("difference") - 1e-12).alias("hits"))
    enough = (F.col("n_first") > least) & (F.col("n") - F.col("n_first") > least)
    return seen.join(F.broadcast(hits)).select(
        "n_first", (F.col("n") - F.col("n_first")).alias("n_second"), "difference", F.when(enough, (F.col("hits") + 1) / (draws + 1.0)).alias("p_value")
    )


def _dealt(x: DataFrame, draws: list[int], n_first: int, low: int, high: int, seed: int) -> DataFrame:
    """(draw, d, held): the difference of means of each draw's first n_first values and the others; held is false, and d wrong,
    where the first ones do not end between the hashes low and high."""
    numbers = F.sequence(F.lit(draws[0]), F.lit(draws[-1])) if len(draws) == draws[-1] - draws[0] + 1 else F.array(*map(F.lit, draws))
    dealt = x.withColumn("draw", F.explode(numbers)).withColumn("h", _digits(F.col("draw").cast("string"), F.col("k"), seed))
    dealt = dealt.withColumn("place", F.when(F.col("h") < f"{low:08x}", 0).when(F.col("h") > f"{high:08x}", 2).otherwise(1))
    between = lambda c: F.when(F.col("place") == 1, F.col(c)).alias(c)
    summed = dealt.groupBy("draw", "place", between("h"), between("k"), between("v").alias("own")).agg(F.sum("v").alias("s"), F.count("v").alias("known"), F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("draw").orderBy("place", "h", "k", "own").rowsBetween(Window.unboundedPreceding, -1)
    left = n_first - F.coalesce(F.sum("c").over(before), F.lit(0))
    told = summed.withColumn("first", F.greatest(F.lit(0), F.least("c", left)))
    # Rows of one hash, key and value are alike, so any of them may be the first.
    share = F.col("first") / F.col("c")
    mean = lambda part: F.try_divide(F.sum(F.col("s") * part), F.sum(F.col("known") * part))
    held = F.bool_and(F.when(F.col("place") == 0, F.col("first") == F.col("c")).when(F.col("place") == 2, F.col("first") == 0).otherwise(True))
    return told.groupBy("draw").agg((mean(share) - mean(1 - share)).alias("d"), held.alias("held"))


def replicates(groups: DataFrame, group: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """(replicate, group, times): for each replicate as many groups as there are, drawn with replacement."""
    named = groups.select(group).distinct()
    # Groups are stations: numbering them is one small task; the draws, groups times replicates, are spread.
    numbered = named.withColumn("k", F.row_number().over(Window.orderBy(group)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    drawn = numbered.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.select("replicate", F.floor(uniform(F.col("replicate").cast("string"), F.col("k").cast("string"), seed) * F.col("n")).alias("k"))
    times = drawn.groupBy("replicate", "k").agg(F.count(F.lit(1)).cast("int").alias("times"))
    return times.join(numbered.select("k", group), "k").select("replicate", group, "times")


def replicated(rows: DataFrame, group: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """rows as often as their group was drawn, with the number of the replicate."""
    drawn = rows.join(replicates(rows, group, draws, seed), group)
    return drawn.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("_k", "times")


def paired_difference(rows: DataFrame, group: str, metric: Callable[[DataFrame, list[str]], DataFrame], draws: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(diff, ci_low, ci_high): metric of forecast a less that of forecast b (columns y, a, b), on the rows and over resampled
    groups, the same draws for both."""

    def both(df: DataFrame, by: list[str]) -> DataFrame:
        long = df.select(*by, "y", F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col("a").alias("p")), F.struct(F.lit("b").alias("which"), F.col("b").alias("p")))).alias("f"))
        scored = metric(long.select(*by, "y", "f.which", "f.p"), [*by, "which"])
        value = next(c for c in scored.columns if c not in (*by, "which"))
        return scored.groupBy(*by).agg((F.max(F.when(F.col("which") == "a", F.col(value))) - F.max(F.when(F.col("which") == "b", F.col(value)))).alias("diff"))

    spread = both(replicated(rows, group, draws, seed), ["replicate"]).agg(F.percentile("diff", F.lit(alpha / 2)).alias("ci_low"), F.percentile("diff", F.lit(1 - alpha / 2)).alias("ci_high"))
    return both(rows, []).join(F.broadcast(spread))


def verdict(low: Column, high: Column, favourable_positive: bool = True) -> Column:
    """supported, contradicted or inconclusive, by which side of zero an interval lies on."""
    above, below = low > 0, high < 0
    yes, no = (above, below) if favourable_positive else (below, above)
    return F.when(yes, "supported").when(no, "contradicted").otherwise("inconclusive")


def degradation_verdict(drop: Column, z: Column, p_value: Column, mode: Column) -> Column:
    """Whether skill falls with time: by a falling trend of the yearly scores (Mann-Kendall z and p, null for too few years) or by
    more than 0.05 from validation to test. Where all folds lie in one period the question does not arise."""
    falling = F.coalesce((p_value < 0.05) & (z < 0), F.lit(False)) | F.coalesce(drop < -0.05, F.lit(False))
    return F.when(falling, "supported").when(mode == "spatial", "not applicable (same period)").otherwise("inconclusive")


def uncertainty_verdict(high: Column, low: Column, auroc: Column) -> Column:
    """Whether uncertainty tells errors: more of them where it is high than where it is low, and an AUROC over 0.6."""
    tells = (F.coalesce(high, F.lit(0.0)) > F.coalesce(low, F.lit(1.0))) & (F.coalesce(auroc, F.lit(0.0)) > 0.6)
    return F.when(tells, "supported").otherwise("inconclusive")


def error_by_uncertainty(rows: DataFrame) -> DataFrame:
    """(high, low, auroc, verdict) of rows with error (boolean), uncertainty (low, moderate, high) and epistemic."""
    from .metrics import auroc

    rate = lambda level: F.avg(F.when(F.col("uncertainty") == level, F.col("error").cast("double")))
    rates = rows.agg(rate("high").alias("high"), rate("low").alias("low"))
    told = auroc(rows.select(F.col("error").cast("int").alias("y"), F.col("epistemic").alias("p")))
    return rates.join(told).select("high", "low", "auroc", uncertainty_verdict(F.col("high"), F.col("low"), F.col("auroc")).alias("verdict"))
