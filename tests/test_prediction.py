"""Tiled prediction against loops over tiles with three by three kernels, and against SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from cubeloom.operators import prediction, predictor
from cubeloom.plans import region_prediction, region_prediction_sql

SF = "/root/testdata/sf0.01"


def test_against_loops(spark):
    rng, height, width, size, stride = np.random.default_rng(5), 13, 11, 6, 4
    x = rng.normal(size=(3, height, width))
    valid, complete = rng.random((height, width)) > 0.15, rng.random((height, width)) > 0.1
    valid[8:, :] = False  # tiles without a valid cell
    cells = [(r, c, bool(valid[r, c]), bool(complete[r, c]), *(float(x[k, r, c]) for k in range(3))) for r in range(height) for c in range(width) if (r, c) != (3, 3)]
    valid[3, 3], x[:, 3, 3] = False, 0
    cells += [(5, 40, True, True, 1.0, 1.0, 1.0)]  # outside of the window
    pixels = spark.createDataFrame(cells, "r long, c long, valid boolean, complete boolean, a double, b double, e double")
    r0, r1, c0, c1 = 1, 12, 2, 11
    window = spark.createDataFrame([(r0, r1, c0, c1)], "r0 long, r1 long, c0 long, c1 long")
    w = predictor.drawn(3, channels=2, hidden=2, layers=1, horizons=1)
    got = {(q["r"], q["c"]): q for q in prediction.predict_region(pixels, window, size, stride, [["a"], ["b"]], ["e"], w, predictor.forward, 3).collect()}
    total, weight = np.zeros((3, height, width)), np.zeros((height, width))
    for i in range(r0, r1, stride):
        for j in range(c0, c1, stride):
            h, v = min(size, r1 - i), min(size, c1 - j)
            image = np.zeros((2, 2, size, size))
            image[0, 0, :h, :v], image[1, 0, :h, :v] = x[0, i : i + h, j : j + v], x[1, i : i + h, j : j + v]
            image[:, 1, :h, :v] = x[2, i : i + h, j : j + v]
            out = predictor.forward(image, w)
            zeros = [(r, c) for r in range(h) for c in range(v) if not valid[i + r, j + c] or r in (0, h - 1) or c in (0, v - 1)]
            for r in range(h):
                for c in range(v):
                    if valid[i + r, j + c]:
                        near = min(math.hypot(r - y, c - z) for y, z in zeros)
                        weight[i + r, j + c] += near
                        total[:, i + r, j + c] += near * out[:, r, c]
    assert set(got) == {(r, c) for r in range(height) for c in range(width) if weight[r, c] > 0}
    for (r, c), q in got.items():
        assert q["weight"] == pytest.approx(weight[r, c])
        assert q["v"] == ([pytest.approx(v) for v in total[:, r, c] / weight[r, c]] if complete[r, c] else [None] * 3)
    assert prediction.predict_region(pixels.filter("r > 99"), window, size, stride, [["a"], ["b"]], ["e"], w, predictor.forward, 3).isEmpty()


@pytest.mark.parametrize("name", sorted(region_prediction.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours = region_prediction.QUERIES[name](spark, SF)
    theirs = con.execute(region_prediction_sql.SQL[name]).df()[ours.columns]
    got, want = (x.sort_values([c for c in ours.columns if c not in ("v", "weight")]).reset_index(drop=True) for x in (ours.toPandas(), theirs))
    assert len(got)
    np.testing.assert_allclose(got.astype(float), want.astype(float), atol=1e-9, rtol=0)
