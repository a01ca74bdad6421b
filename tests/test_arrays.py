"""Array tiles, their filters and distances, and keyed permutations, against brute force."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.operators import arrays, neighbourhood
from cubeloom.operators.permutation import place, side
from cubeloom.plans import shuffling, shuffling_sql

SF = "/root/testdata/sf0.01"


def test_tiles_have_all_places(spark):
    rows = [("a", 0, 1, 1.5, True), ("a", 1, 0, None, None), ("a", 0, 1, 0.5, True), ("a", 2, 0, 9.0, True), ("b", 1, 1, 2.0, False)]
    x = spark.createDataFrame(rows, "k string, r long, c long, p double, m boolean")
    got = {r["k"]: (r["p"], r["m"]) for r in arrays.packed(x, ["k"], 2, {"p": -1.0, "m": False}).collect()}
    assert got == {"a": ([-1.0, 0.5, -1.0, -1.0], [False, True, False, False]), "b": ([-1.0, -1.0, -1.0, 2.0], [False] * 4)}
    assert arrays.packed(x.filter("k > 'z'"), ["k"], 2, {"p": 0.0}).isEmpty()


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 1.0])
def test_distances_are_exact(share):
    valid = np.random.default_rng(int(share * 100)).random((3, 17, 17)) >= share
    got = arrays.edge_distances(valid)
    for k, tile in enumerate(valid):
        edge = [(r, c) for r in range(17) for c in range(17) if not tile[r, c] or r in (0, 16) or c in (0, 16)]
        for r in range(17):
            for c in range(17):
                want = min(math.hypot(r - y, c - x) for y, x in edge) if tile[r, c] else 0.0
                assert got[k, r, c] == pytest.approx(want)


def test_envelope_with_ties_and_steep_lines():
    rng = np.random.default_rng(3)
    f = np.concatenate([rng.integers(0, 5, (40, 23)), rng.integers(0, 400, (40, 23)), np.zeros((1, 23)), np.arange(23.0)[None] ** 2]).astype(float)
    at = np.arange(23)
    assert np.array_equal(arrays.envelope(f), ((at[:, None] - at[None, :]) ** 2 + f[:, None, :]).min(axis=2))
    assert np.array_equal(arrays.envelope(np.array([[4.0]])), [[4.0]])


def test_missing_cells_are_edges_and_other_columns_stay(spark):
    x = spark.createDataFrame([("k", r, c, True, f"{r}{c}") for r in range(5) for c in range(5) if (r, c) != (2, 2)], "tile string, r long, c long, m boolean, name string")
    got = {(r["r"], r["c"]): (r["name"], r["weight"]) for r in neighbourhood.edge_distance(x, ["tile"], 5).collect()}
    assert len(got) == 25 and got[2, 2] == (None, 0.0) and got[1, 2] == ("12", 1.0) and got[1, 1] == ("11", 1.0)


def test_filters():
    x = np.random.default_rng(1).random((2, 8, 8))
    g = arrays.gaussian(5, 1.0)
    padded = np.pad(x, ((0, 0), (2, 2), (2, 2)))
    want = sum(a * b * padded[:, i : i + 8, j : j + 8] for i, a in enumerate(g) for j, b in enumerate(g))
    assert np.allclose(arrays.blurred(x), want)
    assert np.allclose(arrays.halved(x)[0, 1, 2], x[0, 2:4, 4:6].mean())
    up = arrays.enlarged(x[:, :4, :4])
    assert np.allclose(up[:, 0, 0], x[:, 0, 0]) and np.allclose(up[:, 1, 0], 0.75 * x[:, 0, 0] + 0.25 * x[:, 1, 0]) and np.allclose(up[:, 7, 7], x[:, 3, 3])
    with pytest.raises(ValueError):
        arrays.with_similarity(None, 8)


def test_no_exchange_after_the_tile_is_built(spark):
    x = spark.range(1).select(F.lit("k").alias("tile"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1.0).alias("p"), F.lit(0.0).alias("t"), F.lit(True).alias("m"))
    plan = neighbourhood.pyramid_loss(x, ["tile"], 16)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window") == 0 and plan.count("Join") == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 17, 100, 101, 4097])
def test_every_number_has_its_own_place(spark, n):
    x = spark.range(n).select("id", place(F.col("id"), F.lit(n), F.lit(0)).alias("a"), place(F.col("id"), F.lit(n), F.lit(1)).alias("b"))
    rows = x.collect()
    for k in "ab":
        assert sorted(r[k] for r in rows) == list(range(n))
    if n > 50:
        assert sum(r["a"] == r["b"] for r in rows) < n / 10
        near = sum(abs(p["a"] - q["a"]) < n / 20 for p, q in zip(rows, rows[1:], strict=False))
        assert near < n / 4


def test_places_of_large_sets(spark):
    row = spark.range(1).select(*[place(F.lit(k), F.lit(1 << 50), F.lit(100_000)).alias(f"p{k}") for k in range(40)], side(F.lit(1 << 50)).alias("a"), place(F.lit(None), F.lit(9), F.lit(0)).alias("none")).first()
    places = [row[f"p{k}"] for k in range(40)]
    assert len(set(places)) == 40 and all(0 <= p < 1 << 50 for p in places) and row["a"] == 1 << 25 and row["none"] is None


@pytest.mark.parametrize("name", sorted(shuffling.QUERIES))
def test_shuffle_on_a_grid_of_several_chips(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours = shuffling.QUERIES[name](spark, SF)
    theirs = con.execute(shuffling_sql.SQL[name]).df()[ours.columns]
    got, want = (sorted(map(tuple, x.values.tolist())) for x in (ours.toPandas(), theirs))
    assert got and got == want
