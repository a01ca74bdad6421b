"""Every registered raster query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from cubeloom.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_but_the_models_has_sql():
    assert set(QUERIES) - set(SQL) == {"convlstm_predict", "predictor_predict"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, sf, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    order = sorted(columns, key=lambda c: ours[c].dtype.kind == "f")
    frames = [f[columns].sort_values(order).reset_index(drop=True) for f in (ours, theirs)]
    pd.testing.assert_frame_equal(*frames, check_dtype=False, rtol=0, atol=1e-8)


def test_entry(spark):
    import __spark_entry__

    rows = {r["target_year"]: r["n"] for r in __spark_entry__.entry(spark).collect()}
    assert set(rows) == {2005, 2010, 2015, 2020}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
