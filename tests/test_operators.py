import hashlib
import math
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rainloom.functions import scalars, specfun
from rainloom.operators import events, frames, geo, homogeneity, indices, metrics, models, qc, stats, studies

DAY = date(2000, 1, 1)


def series(spark, values, name="x", station="a"):
    return spark.createDataFrame([(station, DAY + timedelta(days=k), v) for k, v in enumerate(values)], f"station_id string, date date, {name} double")


def column(df, name):
    return [r[name] for r in df.orderBy("station_id", "date").collect()]


def test_run_length(spark):
    df = series(spark, [1.0, 1.0, 0.0, 1.0, None, 1.0, 1.0, 1.0, 0.0, 1.0])
    got = frames.run_length(df, F.col("x") == 1, F.col("x").isNotNull(), "run")
    assert column(got, "run") == [1, 2, 0, 1, None, 1, 2, 3, 0, 1]


def test_target_alignment(spark):
    df = series(spark, [0.0, 1.0, 0.0, None, 1.0])
    assert column(df.withColumn("t", frames.target(F.col("x"), 1, 1)), "t") == [1, 0, None, 1, None]


def test_rolling_needs_enough_values(spark):
    df = series(spark, [1.0, None, 3.0, 4.0])
    assert column(df.withColumn("r", frames.rolling(F.col("x"), 3, 2)), "r") == [None, None, 4.0, 7.0]


def test_regularise_fills_and_refuses(spark):
    df = series(spark, [1.0, 2.0, 3.0]).filter("x <> 2")
    assert column(frames.regularise(df), "x") == [1.0, None, 3.0]
    with pytest.raises(Exception, match="duplicate"):
        frames.regularise(df.unionByName(df)).collect()


def test_conflicts_keep_the_first_unless_they_differ(spark):
    rows = [("a", DAY, None, 1.0, 1), ("a", DAY, 5.0, 1.0, 2), ("b", DAY, 1.0, 2.0, 3), ("b", DAY, 3.0, 2.0, 4)]
    df = spark.createDataFrame(rows, "station_id string, date date, precip double, tmax double, ord int")
    got = {r.station_id: (r.precip, r.tmax, r.n_conflicts) for r in frames.resolve_conflicts(df, ["precip", "tmax"], "ord").collect()}
    assert got == {"a": (None, 1.0, 0), "b": (None, 2.0, 1)}


def test_cascade_order_and_missing(spark):
    df = spark.createDataFrame([(1.0, True, True, True), (1.0, False, True, False), (None, True, True, True), (1.0, None, None, True)], "v double, s1 boolean, s2 boolean, e1 boolean")
    rules = [qc.Rule(1, "s1", F.col("s1")), qc.Rule(1, "s2", F.col("s2")), qc.Rule(2, "e1", F.col("e1"))]
    got = [(r.c.flag, [e.code for e in r.c.emitted]) for r in df.select(qc.flag_cascade(F.col("v"), rules).alias("c")).collect()]
    assert got == [(2, ["s1", "e1"]), (1, ["s2"]), (3, []), (2, ["e1"])]


def test_qc_on_injected_errors(spark):
    n = 800
    rng = np.random.default_rng(0)
    tmax = 20 + 5 * np.sin(np.arange(n) / 58) + rng.normal(0, 1, n)
    tmin, precip = tmax - 8, rng.gamma(1, 5, n)
    tmax[100], precip[200], precip[300], tmin[400] = 99.0, -5.0, 900.0, tmax[400] + 5
    rows = [("a", DAY + timedelta(days=k), float(precip[k]), float(tmax[k]), float(tmin[k])) for k in range(n) if k != 500]
    done = qc.run_qc(spark.createDataFrame(rows, "station_id string, date date, precip double, tmax double, tmin double"))
    flags = {(r.date - DAY).days: r.flag for r in done.flags.filter("severity = 'error'").collect()}
    assert flags[100] == "temperature_out_of_range" and flags[200] == "negative_precip" and flags[300] == "precip_above_max" and flags[400] == "tmax_lt_tmin"
    obs = {(r.date - DAY).days: r for r in done.observations.collect()}
    assert obs[100].tmax == 99.0 and obs[100].tmax_qc is None and obs[500].precip_flag == 3
    assert [(r.variable, r.length_days) for r in done.gaps.filter("variable = 'precip'").collect()] == [("precip", 1)]
    assert done.audit.filter("corrected = 'unchanged'").count() == done.flags.filter("severity = 'suspicious'").count()


def test_whiplash_of_one_swing(spark):
    spi = [0.0] * 10 + [-1.5] * 20 + [0.0] * 5 + [1.6] * 20 + [0.0] * 10
    got = events.transitions(series(spark, spi, "spi30")).collect()
    assert [(r.direction, r.transition_days, round(r.intensity_spi_swing, 6)) for r in got] == [("dry_to_wet", 6, 3.1)]


def test_whiplash_separation_and_gap(spark):
    swing = [-1.5] * 5 + [0.0] * 3 + [1.5] * 5 + [0.0] * 3
    # Onsets at rows 9, 25, 41 and 57; the first ends at 13, so only the last is 30 rows or more after it.
    near = events.transitions(series(spark, swing * 4, "spi30")).filter("direction = 'dry_to_wet'")
    assert near.count() == 2
    gap = [-1.5] * 5 + [None] * 6 + [0.0] * 2 + [1.5] * 5
    assert events.transitions(series(spark, gap, "spi30")).count() == 0


def test_spi_is_standard(spark):
    rng = np.random.default_rng(1)
    df = series(spark, [float(v) for v in rng.gamma(0.7, 6.0, 3650)], "precip")
    z = [v for v in column(indices.spi(df, ("2000-01-01", "2010-01-01"), 30), "spi30") if v is not None]
    assert abs(statistics.mean(z)) < 0.1 and 0.85 < statistics.stdev(z) < 1.15


def test_special_functions(spark):
    rows = spark.range(1, 100).select((F.col("id") / 100.0).alias("p")).select("p", specfun.norm_ppf(F.col("p")).alias("z"), specfun.norm_cdf(F.lit(1.5)).alias("c")).collect()
    normal = statistics.NormalDist()
    assert max(abs(r.z - normal.inv_cdf(r.p)) for r in rows) < 1e-12 and abs(rows[0].c - normal.cdf(1.5)) < 1e-12
    one = spark.range(1).select(specfun.gamma_p(F.lit(1.0), F.lit(3.0)).alias("a"), specfun.lgamma(F.lit(5.5)).alias("b"), specfun.chi2_tail(F.lit(3.84), F.lit(1.0)).alias("c")).first()
    assert abs(one.a - (1 - math.exp(-3))) < 1e-13 and abs(one.b - math.lgamma(5.5)) < 1e-12 and abs(one.c - 0.05004) < 1e-4


def test_gamma_series_ends_early(spark):
    """Small arguments take few terms, and the sums are those of all of them."""
    df = spark.createDataFrame([(a, x) for a in (0.25, 3.0, 12.5, 60.0) for x in (0.01, 1.0, 7.5, 40.0, 90.0)] + [(1.0, float("inf")), (1.0, -2.0), (1.0, None)], "a double, x double")
    got = [r.p for r in df.select(specfun.gamma_p(F.col("a"), F.col("x")).alias("p")).collect()]
    for (a, x), p in zip(((r.a, r.x) for r in df.collect()), got):
        if x is None or x <= 0 or x > a + 10 * math.sqrt(a) + 40:
            assert p == (None if x is None else float(x > 0))
            continue
        term = total = 1.0
        for n in range(1, 400):
            term *= x / (a + n)
            total += term
        assert abs(p - total * math.exp(a * math.log(x) - x - math.lgamma(a + 1))) < 1e-12
    plan = df.select(specfun.gamma_p(F.col("a"), F.col("x")))._jdf.queryExecution().analyzed().toString()
    assert "sequence(1, least(200" in plan


def test_learners_and_series_work_where_rows_are_spread(spark, sf_dir):
    """Learners pass over stored days, not over the lines; a small file's rows are spread before long series."""
    from rainloom.plans import analysis, registry

    rows, columns = analysis._tabular(spark, sf_dir)
    spark_plan = rows.select(*columns)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in spark_plan or "lineitem" not in spark_plan
    assert "REPARTITION_BY_NUM" in registry.QUERIES["f5_special_functions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def steps(spark, values, key="a"):
    return spark.createDataFrame([(key, k, float(v)) for k, v in enumerate(values)], "key string, t int, x double")


def test_change_points_find_a_step(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, 40)
    x[20:] += 3
    s = steps(spark, x)
    assert abs(stats.pettitt(s).first().change_index - 20) <= 2
    for which, test in (("snht", stats.snht), ("buishand", stats.buishand)):
        r = stats.with_p_value(test(s), which).first()
        assert abs(r.change_index - 20) <= 5 and r.p_value < 0.01
    assert homogeneity.vote(s).first().is_break
    sign = np.sign(x[None, :] - x[:, None])
    assert stats.pettitt(s).first().statistic == max(abs(sign[: t + 1, t + 1 :].sum()) for t in range(39))


def test_trend(spark):
    rng = np.random.default_rng(4)
    x = 0.1 * np.arange(50) + rng.normal(0, 0.5, 50)
    r = stats.mann_kendall(steps(spark, x)).first()
    assert r.p_value < 0.01 and abs(stats.sen_slope(steps(spark, x)).first().slope - 0.1) < 0.03


def test_false_discovery(spark):
    df = spark.createDataFrame([("v", p) for p in (0.001, 0.01, 0.04, 0.5, 0.9)], "g string, p double")
    got = stats.benjamini_hochberg(df, "p", ["g"]).orderBy("p").collect()
    assert [r.significant_fdr for r in got] == [True, True, False, False, False]


def test_permutation_test_tells_samples_apart(spark):
    def p(a, b):
        rows = [(k, float(v), k < len(a)) for k, v in enumerate([*a, *b])]
        df = spark.createDataFrame(rows, "k long, v double, one boolean")
        return studies.permutation_test(df, F.col("one"), "v", "k", draws=500).first().p_value

    low, high = list(range(10)), list(range(20, 32))
    assert p(low, high) == p(low, high) < 0.01 and p(low, [v + 0.5 for v in low]) > 0.3 and p(low[:5], high) is None


def test_series_without_spread(spark):
    """No events in any year, or a rise by the same in each: nothing to pre-whiten and no break."""
    for x, sign in (([0.0] * 7, 0), ([0.5] * 12, 0), (np.arange(12.0), 1)):
        r = stats.mann_kendall(steps(spark, x)).first()
        assert r.s == sign * len(x) * (len(x) - 1) / 2 and r.sens_slope == sign and (r.p_value < 0.01) == (sign == 1)
    flat = steps(spark, [0.5] * 12)
    assert stats.with_p_value(stats.snht(flat), "snht").first().p_value is None and stats.with_p_value(stats.buishand(flat), "buishand").first().p_value == 1
    assert not homogeneity.vote(flat).first().is_break


def test_permutation_test_orders_few_rows(spark):
    """Draws by brute force, with nulls and equal keys; the same where the band holds all draws, some or none; rows that are ordered."""
    rng = np.random.default_rng(8)
    rows = [(k // 2 if k < 20 else k, None if k % 17 == 0 else float(v), k % 3 == 0) for k, v in enumerate(rng.normal(0, 1, 400).tolist())]
    df = spark.createDataFrame(rows, "k long, v double, one boolean")

    def mean(values):
        return statistics.mean(v for v in values if v is not None)

    size, true = sum(o for *_, o in rows), mean(v for _, v, o in rows if o) - mean(v for _, v, o in rows if not o)
    hits = 0
    for draw in range(1, 201):
        dealt = [v for *_, v in sorted((hashlib.md5(f"{draw}:{k}:0".encode()).hexdigest()[:8], str(k), v is not None, v or 0.0, v) for k, v, _ in rows)]
        hits += abs(mean(dealt[:size]) - mean(dealt[size:])) >= abs(true) - 1e-12
    for band in (6.0, 1.0, 0.0):
        r = studies.permutation_test(df, F.col("one"), "v", "k", draws=200, band=band).first()
        assert (r.n_first, r.n_second) == (size, 400 - size) and abs(r.difference - true) < 1e-12 and abs(r.p_value - (hits + 1) / 201) < 1e-12
    many = spark.range(20_000).select(F.col("id").cast("string").alias("k"), F.rand(1).alias("v"))
    plan = studies._dealt(many, list(range(1, 5)), 10_000, int(0.48 * 2**32), int(0.52 * 2**32), 0)
    assert all(r.held for r in plan.collect())


def plane(spark, rise):
    return spark.createDataFrame([(r, c, float(rise(r, c))) for r in range(5) for c in range(5)], "row int, col int, value double")


def test_slope_and_aspect_of_planes(spark):
    grid = (0.0, 1000.0, 0.0, 1000.0)
    middle = "row = 2 AND col = 2"
    south = geo.slope_aspect(plane(spark, lambda r, c: 100 * r), grid, geographic=False).filter(middle).first()
    assert abs(south.slope - math.degrees(math.atan(0.1))) < 1e-9 and abs(south.aspect % 360) < 1e-9
    east = geo.slope_aspect(plane(spark, lambda r, c: 100 * c), grid, geographic=False).filter(middle).first()
    assert abs(east.aspect - 270) < 1e-9
    assert geo.slope_aspect(plane(spark, lambda r, c: 5), grid, geographic=False).filter("aspect <> -1").count() == 0


def test_geography(spark):
    km = spark.range(1).select(scalars.haversine_km(F.lit(27.7172), F.lit(85.3240), F.lit(28.2096), F.lit(83.9856)).alias("d")).first().d
    assert abs(km - 141) < 5
    st = spark.createDataFrame([("a", 27.0, 85.0, 10.0), ("b", 27.0, 86.0, 20.0)], "station_id string, lat double, lon double, v double")
    q = spark.createDataFrame([("x", 27.0, 85.0), ("y", 27.0, 85.5), ("z", 40.0, 10.0)], "query string, qlat double, qlon double")
    got = {r.query: r.value for r in geo.idw(q, st, "v").collect()}
    assert got["x"] == 10.0 and 14 < got["y"] < 16 and got["z"] is None
    with pytest.raises(geo.CRSMismatchError):
        geo.check_crs("EPSG:32645")
    cells = spark.createDataFrame([(r, c, 0.0) for r in range(3) for c in range(3)], "row int, col int, value double")
    at = spark.createDataFrame([("p", 29.5, 81.5), ("q", 10.0, 10.0)], "station_id string, lat double, lon double")
    assert {r.station_id: r.value for r in geo.sample_raster(at, cells, (80.0, 1.0, 31.0, 1.0)).collect()} == {"p": 0.0, "q": None}
    square = geo.clip_half_plane([(0, 0), (2, 0), (2, 2), (0, 2)], 1, 0, 1)
    assert sorted(square) == [(0, 0), (0, 2), (1.0, 0.0), (1.0, 2.0)]


def forecasts(spark, y, p):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double")


def test_reliability(spark):
    one = metrics.reliability_curve(forecasts(spark, [0, 1, 0, 0], [0.3] * 4)).collect()
    assert [(round(r.mean_predicted, 9), r.observed_frequency, r["count"]) for r in one] == [(0.3, 0.25, 4)]
    two = metrics.reliability_curve(forecasts(spark, [0, 0, 1, 1], [0.1, 0.1, 0.9, 0.9])).orderBy("mean_predicted").collect()
    assert [(round(r.mean_predicted, 9), r.observed_frequency) for r in two] == [(0.1, 0.0), (0.9, 1.0)]


def test_scores(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p).astype(int)
    df = forecasts(spark, y, p)
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert abs(metrics.auroc(df).first().auroc - wins) < 1e-9
    assert metrics.average_precision(df).first().lift > 1
    constant = forecasts(spark, [1] * 20 + [0] * 980, [0.02] * 1000)
    assert metrics.expected_calibration_error(constant).first().ece < 0.02
    assert abs(metrics.temperature(df) - 1) < 0.5
    ci = metrics.bootstrap_ci(df.withColumn("g", (F.col("p") * 100).cast("int") % 10), "g", metrics.average_precision, 20).first()
    assert ci.low <= metrics.average_precision(df).first().ap <= ci.high


def test_conformal_coverage(spark):
    rng = np.random.default_rng(6)
    p = rng.beta(1, 6, 6000)
    y = (rng.random(6000) < p).astype(int)
    fitted = metrics.conformal_fit(forecasts(spark, y[:3000], p[:3000]))
    r = metrics.conformal_evaluate(metrics.conformal_sets(forecasts(spark, y[3000:], p[3000:]), fitted)).first()
    assert r.coverage_events > 0.85 and r.coverage_non_events > 0.85


def test_ensembles(spark):
    df = spark.createDataFrame([(0, [0.99, 0.01]), (1, [0.5, 0.5])], "i int, m array<double>")
    parts = metrics.decompose(F.col("m"))
    got = {r.i: r for r in df.select("i", parts["epistemic"].alias("e"), metrics.crps(F.lit(1.0), F.col("m")).alias("c")).collect()}
    assert got[0].e > 0.5 and abs(got[1].e) < 1e-9
    assert abs(got[0].c - (0.5 - 0.98 / 4)) < 1e-12


def test_splits(spark):
    rows = [(f"s{k}", f"b{k % 9}" if k else "alone", (k * 37 % 60) / 10) for k in range(60)]
    st = spark.createDataFrame(rows, "station_id string, basin string, lon double")
    periods = {"train": (date(2000, 1, 1), date(2005, 12, 31)), "val": (date(2006, 1, 1), date(2007, 12, 31)), "test": (date(2008, 1, 1), date(2009, 12, 31))}
    spans = lambda df: {r.fold: (r.start, r.end) for r in df.collect()}
    late = {"train": (date(2000, 1, 1), date(2005, 12, 30)), "val": (date(2006, 1, 31), date(2007, 12, 30)), "test": (date(2008, 1, 31), date(2009, 12, 30))}
    folds = models.split("temporal", st, periods, gap=30, lead=1)
    assert spans(folds) == late and folds.count() == 180
    choices = {"basin": {"test_groups": ("b1", "b2")}, "longitude_block": {}, "random_station": {}}
    for strategy, more in choices.items():
        both = models.split("spatiotemporal", st, periods, gap=30, strategy=strategy, **more)
        assert spans(both) == late
        apart = models.split("spatial", st, periods, gap=30, strategy=strategy, **more)
        assert set(spans(apart).values()) == {late["train"]}
        for df in (both, apart):
            dealt = {}
            for r in df.collect():
                assert dealt.setdefault(r.station_id, r.fold) == r.fold
            assert len(dealt) == 60
            if strategy == "basin":
                assert {s for s, f in dealt.items() if f == "test"} == {s for s, b, _ in rows if b in ("b1", "b2")}
            elif strategy == "longitude_block":
                cut = float(np.quantile([x for *_, x in rows], 0.7))
                assert {s for s, f in dealt.items() if f == "test"} == {s for s, _, x in rows if x >= cut}
            else:
                assert sum(f == "test" for f in dealt.values()) == 18
            for basin in {b for _, b, _ in rows}:
                rest = [dealt[s] for s, b, _ in rows if b == basin and dealt[s] != "test"]
                assert rest.count("val") == (min(max(1, round(0.2 * len(rest))), len(rest) - 1) if rest else 0)
    with pytest.raises(AssertionError):
        models.check_leakage(folds, "spatial")
    with pytest.raises(AssertionError):
        models.split("spatiotemporal", st, periods | {"val": (date(2005, 1, 1), date(2007, 12, 31))}, gap=30)
    with pytest.raises(ValueError):
        models.split("other", st, periods)
    with pytest.raises(ValueError):
        models.split("spatial", st, periods, strategy="other")


def test_order_and_partitions_do_not_matter(spark):
    df = series(spark, [float(k * 7 % 11) for k in range(300)], "precip").withColumn("tmax", F.col("precip") + 10).withColumn("tmin", F.col("precip"))
    one, many = df.coalesce(1), df.orderBy(F.rand(1)).repartition(8)
    a, b = (sorted(map(str, events.label_events(x, ("2000-01-01", "2000-12-31")).collect())) for x in (one, many))
    assert a == b


def test_ordered_totals_over_many_parts(spark):
    """Running sums by range parts are those of plain loops, in both directions, with groups, one value holding most rows."""
    from rainloom.operators.frames import ordered_totals

    rows = [(k % 2, (k * 37) % 101 / 7 if k % 3 else 2.0 + k / 1e6, k % 5 + 1) for k in range(600)]
    distinct = {(g, x): sum(c for h, y, c in rows if (h, y) == (g, x)) for g, x, _ in rows}
    df = spark.createDataFrame([(g, x, c) for (g, x), c in distinct.items()], "g int, x double, c long").repartition(5)
    for order, down in ((F.asc("x"), False), (F.desc("x"), True)):
        got = {(r.g, r.x): r.upto for r in ordered_totals(df, order, {"upto": "c"}, ["g"]).collect()}
        assert got == {(g, x): sum(c for (h, y), c in distinct.items() if h == g and (y >= x if down else y <= x)) for g, x in distinct}
    assert ordered_totals(df.filter("false"), F.asc("x"), {"upto": "c"}, []).collect() == []


def test_nearest_k_by_rings_is_all_pairs(spark):
    """Rings over clusters, lone points, both sides of the date line, poles, ties, and more neighbours than there are."""
    rng = np.random.default_rng(4)
    crowd = [(float(27 + rng.normal(0, 0.05)), float(85 + rng.normal(0, 0.05))) for _ in range(120)]
    lone = [(float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for _ in range(40)]
    places = crowd + lone + [(10.0, 179.95), (10.0, -179.95), (89.9, 0.0), (89.9, 180.0), (-89.95, 77.0), (27.0, 85.0), (27.0, 85.0)]
    st = spark.createDataFrame([(f"s{k:03}", *p) for k, p in enumerate(places)] + [("none", None, 3.0)], "station_id string, lat double, lon double")
    asked = [(27.0, 85.0), (10.0, 179.99), (89.99, 90.0), (-45.0, -120.0), *lone[:5]]
    queries = spark.createDataFrame([(f"q{k}", *p) for k, p in enumerate(asked)] + [("none", None, None)], "query string, qlat double, qlon double")

    def km(a, b):
        (p, q), (r, s) = (tuple(map(math.radians, x)) for x in (a, b))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * scalars.EARTH_KM * math.asin(math.sqrt(min(1.0, h)))

    for k in (1, 4, 500):
        for cell in (None, 0.5, 40.0) if k < 500 else (None,):
            got = {(r.query, r["rank"]): (r.station_id, r.km) for r in geo.nearest_k(queries, st, k, cell=cell).collect()}
            for q, a in enumerate(asked):
                best = sorted((km(a, p), f"s{n:03}") for n, p in enumerate(places))[:k]
                mine = [got[f"q{q}", r + 1] for r in range(len(best))]
                assert np.allclose([m[1] for m in mine], [b[0] for b in best], atol=1e-6)
                assert k == 500 or [m[0] for m in mine] == [b[1] for b in best]
            assert len(got) == len(asked) * min(k, len(places))
    assert geo.nearest_k(queries, st.filter("false"), 3).collect() == [] and geo.nearest_k(queries.filter("false"), st, 3).collect() == []
    near = {r.station_id: r.km for r in geo.nearest_member(st, st.filter("station_id IN ('s165', 's000')")).collect()}
    assert near["none"] is None and abs(near["s165"] - km(places[165], places[0])) < 1e-6 and near["s166"] == 0


def test_utm_there_and_back(spark):
    points = [(87.0, 0.0), (87.0, 45.0), (85.324, 27.717), (83.97, 28.21), (81.0, -33.0), (90.0, 70.0), (84.0, 26.3)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k int, lon double, lat double")
    there = geo.reproject(df, "EPSG:4326", "EPSG:32645")
    back = {r.k: r for r in geo.reproject(there, "EPSG:32645", "OGC:CRS84").collect()}
    assert all(abs(back[k].lon - p[0]) < 1e-9 and abs(back[k].lat - p[1]) < 1e-9 for k, p in enumerate(points))
    got = {r.k: r for r in there.collect()}
    assert abs(got[0].lon - 500_000) < 1e-6 and abs(got[0].lat) < 1e-6
    # The length of the meridian to 45 degrees is 4984944.378 m.
    assert abs(got[1].lat - 0.9996 * 4984944.378) < 2e-3 and abs(got[1].lon - 500_000) < 1e-6
    # Scale and direction beside the middle meridian: small steps on the ground are as long as on the map times about 0.9996.
    a, b = (spark.createDataFrame([(0, 85.324 + d, 27.717)], "k int, lon double, lat double") for d in (0.0, 1e-4))
    p, q = (geo.reproject(x, "EPSG:4326", "EPSG:32645").first() for x in (a, b))
    prime = geo.AXIS / math.sqrt(1 - geo.FLATTENING * (2 - geo.FLATTENING) * math.sin(math.radians(27.717)) ** 2)
    assert abs(math.hypot(q.lon - p.lon, q.lat - p.lat) / (prime * math.cos(math.radians(27.717)) * math.radians(1e-4)) - 0.9999) < 3e-4
    south = geo.reproject(df, "EPSG:4326", "EPSG:32745").filter("k = 4").first()
    assert abs(south.lat - (got[4].lat + 10_000_000)) < 1e-6
    for crs in ("EPSG:3857", "EPSG:32661", "x"):
        with pytest.raises(geo.CRSMismatchError):
            geo.reproject(df, "EPSG:4326", crs)


def test_quantiles_of_a_whole_table(spark):
    rng = np.random.default_rng(9)
    for values in ([3.0], [1.0, 2.0], [7.0] * 300 + [1.0, 9.0], rng.normal(0, 1, 501).tolist(), [0.0, None, 5.0, None]):
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
        known = [v for v in values if v is not None]
        shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
        assert np.allclose(list(frames.quantiles(df, "x", shares).first()), [np.quantile(known, q) for q in shares.values()])
    assert list(frames.quantiles(spark.createDataFrame([], "x double"), "x", {"a": 0.5}).first()) == [None]


def test_units_of_temperature(spark):
    df = spark.createDataFrame([(212.0, 373.15)], "f double, k double")
    row = df.select(*(scalars.convert("tmax", u, F.col("f")).alias(u) for u in ("degF", "F")), scalars.convert("tmin", "K", F.col("k")).alias("K")).first()
    assert all(abs(v - 100) < 1e-9 for v in row)
    with pytest.raises(ValueError):
        scalars.convert("rh", "degF", F.col("f"))


def test_verdicts_of_degradation_and_uncertainty(spark):
    rows = [(-0.1, None, None, "temporal"), (-0.01, -3.0, 0.01, "temporal"), (-0.01, 3.0, 0.01, "temporal"), (None, None, None, "spatial"), (-0.2, None, None, "spatial"), (0.0, -3.0, 0.2, "temporal")]
    df = spark.createDataFrame(rows, "drop double, z double, p double, mode string").coalesce(1)
    got = [r.v for r in df.select(studies.degradation_verdict(*map(F.col, ("drop", "z", "p", "mode"))).alias("v")).collect()]
    assert got == ["supported", "supported", "inconclusive", "not applicable (same period)", "supported", "inconclusive"]
    rows = [(0.4, 0.1, 0.7), (0.1, 0.4, 0.7), (0.4, 0.1, 0.6), (None, 0.1, 0.9), (0.4, None, 0.9), (0.4, 0.1, None)]
    df = spark.createDataFrame(rows, "h double, l double, a double").coalesce(1)
    assert [r.v for r in df.select(studies.uncertainty_verdict(*map(F.col, "hla")).alias("v")).collect()] == ["supported"] + ["inconclusive"] * 5
