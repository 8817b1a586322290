"""Driver contract and a sample of queries against their DuckDB oracles."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from lodestat.plans import registry
from lodestat.sources.tables import TABLES

from conftest import SF_SMALL


def test_registry_is_consistent():
    assert set(E.oracle_sql()) <= set(E.queries())
    qs, sqls = registry.queries(), registry.oracle_sql()
    assert set(qs) <= set(E.queries())
    assert set(qs) == set(sqls)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == E.entry(spark).columns


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM parquet_scan('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["univariate_price_on_quantity", "bucket_join", "landing_features",
                                  "outlier_fences", "season_models", "season_metrics", "cv_scores",
                                  "log_candidates", "exact_split", "qq_points", "durbin_watson",
                                  "residual_histogram", "correlation_matrix", "seasonal_report_landings",
                                  "seasonal_report_all_months", "season_models_all_months", "corr_heatmap_v3",
                                  "fitted_line_landings", "fitted_line_food"])
def test_query_matches_oracle(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toPandas()
    want = duck.sql(E.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert gr == wr


def test_every_oracle_plans_in_duckdb(duck):
    bad = {}
    for name, sql in E.oracle_sql().items():
        try:
            duck.sql("EXPLAIN " + sql).fetchall()
        except Exception as ex:  # noqa: BLE001
            bad[name] = str(ex)[:200]
    assert not bad
