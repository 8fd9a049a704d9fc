"""Rare-event scores, calibration, ensembles, conformal sets and failure analysis.

Forecast tables have columns y (0 or 1) and p. Rows are first counted by distinct score, so the cumulative windows run over
scores and not over rows; ``by`` gives groups that are scored apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import entropy_bits
from .frames import ordered_totals, quantiles


def _by_score(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by, "p").agg(F.sum(F.col("y").cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))


def _curve(df: DataFrame, by: list[str]) -> DataFrame:
    c = _by_score(df, by)
    if not by:
        whole = c.agg(F.sum("pos").alias("events"), F.sum("n").alias("rows"))
        return ordered_totals(c, F.desc("p"), {"tp": "pos", "seen": "n"}, []).crossJoin(F.broadcast(whole))
    down = Window.partitionBy(*by).orderBy(F.desc("p"))
    all_ = Window.partitionBy(*by)
    c = c.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
    return c.withColumn("events", F.sum("pos").over(all_)).withColumn("rows", F.sum("n").over(all_))


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., ap, base_rate, lift): sum over distinct scores, from the top, of recall gained times precision."""
    by = by or []
    c = _curve(df, by).groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), F.col("events")) * F.col("tp") / F.col("seen")).alias("ap"), F.first(F.col("events") / F.col("rows")).alias("base_rate"))
    return c.withColumn("lift", F.try_divide(F.col("ap"), F.col("base_rate")))


def auroc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., auroc): chance that an event scores above a non-event, ties half."""
    by = by or []
    c = _curve(df, by).withColumn("below", F.col("rows") - F.col("events") - (F.col("seen") - F.col("tp")))
    won = F.sum(F.col("pos") * (F.col("below") + 0.5 * (F.col("n") - F.col("pos"))))
    return c.groupBy(*by).agg(F.try_divide(won, F.first(F.col("events") * (F.col("rows") - F.col("events")))).alias("auroc"))


def brier(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n, n_events, brier, brier_skill, log_loss)."""
    by = by or []
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col("y").cast("double")
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("n_events"), F.avg((q - y) * (q - y)).alias("brier"), F.avg(y).alias("_b"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss")
    )
    # The mean squared error of the base rate is b (1 - b).
    return out.withColumn("brier_skill", 1 - F.try_divide(F.col("brier"), F.col("_b") * (1 - F.col("_b")))).drop("_b")


def best_f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, f1): the score that gives the best F1 for p >= threshold, the lowest on ties; 0.5 without events."""
    by = by or []
    f1 = F.try_divide(2 * F.col("tp"), F.col("seen") + F.col("events"))
    c = _curve(df, by).withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    best = c.groupBy(*by).agg(F.max("events").alias("events"), F.min(F.struct((-F.col("f1")).alias("f"), "p")).alias("m"))
    return best.select(*by, F.when(F.col("events") > 0, F.col("m.p")).otherwise(0.5).alias("threshold"), F.when(F.col("events") > 0, -F.col("m.f")).otherwise(0.0).alias("f1"))


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    by = by or []
    hit, yes = (F.col("p") >= threshold) & (F.col("y") == 1), F.col("p") >= threshold
    out = df.groupBy(*by).agg(F.count_if(hit).alias("tp"), F.count_if(yes).alias("yes"), F.sum("y").alias("P"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(*by, zero(F.col("tp"), F.col("yes")).alias("precision"), zero(F.col("tp"), F.col("P")).alias("recall"), zero(2 * F.col("tp"), F.col("yes") + F.col("P")).alias("f1"))


def _binned(df: DataFrame, bins: int, strategy: str, distinct: bool) -> DataFrame:
    steps = [k / bins for k in range(bins + 1)]
    if strategy == "quantile":
        edges = df.agg(F.percentile("p", F.array(*map(F.lit, steps))).alias("edges"))
        if distinct:
            edges = edges.select(F.array_distinct("edges").alias("edges"))
    else:
        edges = df.sparkSession.range(1).select(F.array(*map(F.lit, steps)).alias("edges"))
    inner = F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2)).otherwise(F.array().cast("array<double>"))
    held = df.join(F.broadcast(edges.select(inner.alias("inner"))))
    return held.withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("p"))))


def expected_calibration_error(df: DataFrame, bins: int = 15, strategy: str = "quantile") -> DataFrame:
    b = _binned(df, bins, strategy, False).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg(F.col("y").cast("double")).alias("y"))
    return b.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))


def reliability_curve(df: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, mean_predicted, observed_frequency, count) of the bins with rows."""
    b = _binned(df, bins, "quantile", True)
    return b.groupBy("bin").agg(F.avg("p").alias("mean_predicted"), F.avg(F.col("y").cast("double")).alias("observed_frequency"), F.count(F.lit(1)).alias("count"))


def regression(df: DataFrame, y: str, yhat: str) -> DataFrame:
    e = F.col(yhat) - F.col(y)
    out = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.avg(e * e).alias("_m"), F.var_pop(y).alias("_v"))
    return out.select("mae", "rmse", (1 - F.try_divide(F.col("_m"), F.col("_v"))).alias("r2"), "bias")


def crps(y: Column, members: Column) -> Column:
    """Empirical CRPS of a row's ensemble (array): mean distance to y less half the mean distance within."""
    n = F.size(members).cast("double")
    to_y = F.aggregate(members, F.lit(0.0), lambda s, m: s + F.abs(m - y)) / n
    # Sum of |a - b| over all ordered pairs from the sorted members.
    ranked = F.transform(F.array_sort(members), lambda m, i: m * (2 * i - n + 1))
    within = 2 * F.aggregate(ranked, F.lit(0.0), lambda s, v: s + v) / (n * n)
    return to_y - within / 2


def decompose(members: Column) -> dict[str, Column]:
    """Mean, spread and the entropy split of a row's member probabilities (array)."""
    n = F.size(members).cast("double")
    p = F.aggregate(members, F.lit(0.0), lambda s, m: s + m) / n
    var = F.aggregate(members, F.lit(0.0), lambda s, m: s + (m - p) * (m - p)) / n
    total, inner = entropy_bits(p), F.aggregate(members, F.lit(0.0), lambda s, m: s + entropy_bits(m)) / n
    return {"probability": p, "std": F.sqrt(var), "total_entropy": total, "aleatoric": inner, "epistemic": F.greatest(F.lit(0.0), total - inner), "confidence": 1 - total}


def conformal_fit(df: DataFrame, alpha: float = 0.1) -> DataFrame:
    """(q0, q1): class-conditional quantiles of 1 - p(own class), the ceil((n + 1)(1 - alpha))-th smallest score."""
    s = df.select(F.col("y").cast("int").alias("y"), F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("s"))
    # Cumulative counts over distinct scores find the order statistic without one task sorting a class.
    counts = s.filter("y IN (0, 1)").groupBy("y", "s").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("y").agg(F.sum("c").alias("n"))
    counts = ordered_totals(counts, F.asc("s"), {"upto": "c"}, ["y"]).join(F.broadcast(sizes), "y")
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)), F.col("n"))
    q = counts.filter(F.col("upto") >= k).groupBy("y").agg(F.min("s").alias("q"))
    return q.agg(F.coalesce(F.max(F.when(F.col("y") == 0, F.col("q"))), F.lit(1.0)).alias("q0"), F.coalesce(F.max(F.when(F.col("y") == 1, F.col("q"))), F.lit(1.0)).alias("q1"))


def conformal_sets(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """df with in0 and in1, membership of the classes."""
    held = df.join(F.broadcast(fitted))
    return held.withColumn("in0", F.col("p") <= F.col("q0")).withColumn("in1", (1 - F.col("p")) <= F.col("q1")).drop("q0", "q1")


def conformal_evaluate(sets: DataFrame) -> DataFrame:
    cover = F.when(F.col("y") == 1, F.col("in1")).otherwise(F.col("in0")).cast("double")
    size = F.col("in0").cast("int") + F.col("in1").cast("int")
    return sets.agg(
        F.avg(cover).alias("coverage"), F.avg(F.when(F.col("y") == 1, cover)).alias("coverage_events"), F.avg(F.when(F.col("y") == 0, cover)).alias("coverage_non_events"), F.avg(size).alias("mean_set_size"), F.avg((size == 2).cast("double")).alias("frac_ambiguous"), F.avg((size == 0).cast("double")).alias("frac_empty")
    )


def categorise(df: DataFrame, reference: DataFrame, epistemic: str = "epistemic") -> DataFrame:
    """df with uncertainty low, moderate or high by the reference's median and 90th percentile; an empty set is high."""
    q = quantiles(reference, epistemic, {"_half": 0.5, "_most": 0.9})
    held = df.join(F.broadcast(q))
    empty = ~(F.col("in0") | F.col("in1")) if "in0" in df.columns else F.lit(False)
    level = F.when((F.col(epistemic) > F.col("_most")) | empty, "high").when(F.col(epistemic) > F.col("_half"), "moderate").otherwise("low")
    return held.withColumn("uncertainty", level).drop("_half", "_most")


def temperature(df: DataFrame, low: float = 0.05, high: float = 20.0, steps: int = 40) -> float:
    """The temperature with the least mean log loss, by golden section over one aggregate per step."""
    from ..functions.scalars import logit

    held = df.select(logit(F.col("p")).alias("z"), F.col("y").cast("double").alias("y")).cache()
    ratio = (5**0.5 - 1) / 2

    def loss(t: float) -> float:
        z = F.col("z") / t
        # log(1 + e^z) - y z, written so that e never overflows.
        return held.agg(F.avg(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z)).first()[0]

    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = loss(c), loss(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = loss(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = loss(d)
        if b - a < 1e-3:
            break
    held.unpersist()
    return (a + b) / 2


def quadrants(threshold: float, confident: Column) -> Column:
    right = (F.col("p") >= threshold) == (F.col("y") == 1)
    return F.when(confident & right, "confident_correct").when(confident, "confident_wrong").when(right, "uncertain_correct").otherwise("uncertain_wrong")


def error_clustering(frame: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, level, n, events, error_rate, miss_rate, false_alarm_rate, confident_wrong) from columns y, error, quadrant."""
    long = frame.unpivot(["y", "error", "quadrant"], factors, "factor", "level").filter("level IS NOT NULL")
    e = F.col("error").cast("double")
    return long.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("events"), F.avg(e).alias("error_rate"), F.avg(F.when(F.col("y") == 1, e)).alias("miss_rate"), F.avg(F.when(F.col("y") == 0, e)).alias("false_alarm_rate"), F.avg((F.col("quadrant") == "confident_wrong").cast("double")).alias("confident_wrong")
    )


def bootstrap_ci(df: DataFrame, group: str, metric, draws: int = 200, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(low, high) of a metric over resampled groups. metric(df, by) scores each replicate; a replicate repeats a group's rows as
    often as it was drawn. Draws are made on the executors."""
    from .studies import replicated

    scored = metric(replicated(df, group, draws, seed), ["replicate"])
    value = next(c for c in scored.columns if c != "replicate")
    return scored.agg(F.percentile(value, F.lit(alpha / 2)).alias("low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("high"))
