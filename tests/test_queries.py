"""Every query that has SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from tarn.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def canonical(df):
    df = df[sorted(df.columns)]
    rows = [tuple(round(v, 6) if isinstance(v, float) and v == v else None if v is None or v != v else v for v in r) for r in df.itertuples(index=False)]
    return sorted(map(repr, rows))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_lags_of_all_columns(spark):
    """The reference's six columns and five lags, and every one that the query had before."""
    got = {r.column for r in QUERIES["corr_lags"](spark, SF).collect()}
    assert got >= {f"{x}_lag{k}" for x in ("tmp", "tmp_range", "prec", "wind", "surf_pre", "humidity") for k in (1, 3, 7, 14, 21)}
    assert got >= {f"{x}_lag{k}" for x in ("prec", "tmp", "humidity", "wind") for k in (1, 7, 14, 30, 60)}


@pytest.mark.parametrize("name", ["gbt_lgb", "gbt_cat", "extra_trees", "chain", "clf_hurdle", "importance_groups", "best_iter", "multi_seed_models", "weights_guard", "fx_synth", "clf_drift", "perm_importance", "tune"])
def test_models_run(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        for k, v in r.asDict().items():
            if k.startswith("pred_week"):
                assert 0 <= v <= 5
            if k.startswith("chance"):
                assert 0 <= v <= 1
