"""Registered queries against their SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from rainloom.plans import analysis, basics, registry, reports, sequences  # noqa: F401

#: A sample of every group; all of them run in the driver's gate.
NAMES = [
    "s1_scan_station_day", "j6_regularise_daily", "j9_range_self_join", "j10_asof_forward", "a1_completeness_grouping_sets", "w2_rolling_stats", "w6_robust_z", "w8_run_length",
    "w14_calendar_percentile", "u3_resolve_conflicts", "p4_p8_qc_flag_cascade", "e1_spi30", "e17_whiplash_events", "a6_etccdi_annual", "t1_pettitt", "t5_mann_kendall", "t11_kruskal",
    "g1_slope_aspect", "j11_point_in_polygon", "v1_average_precision", "v3_ece", "v8_conformal_eval", "a25_scores_by_year", "g3_static_features", "t14_station_trends", "t15_paired_bootstrap", "m3_spatial_folds_longitude_block", "p22_masked_days", "m15_window_forecasts", "m16_integrated_gradients", "m16_counterfactual_precip", "m16_modality_ablation", "m3_splits", "m3_spatial_basin", "m3_spatiotemporal_random_station", "j13_knn_customers", "a5_whole_table_quantiles", "g5_utm",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.4f}"
        return str(v)[:10]

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
