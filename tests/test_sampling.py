"""Summed-area tables against sums over the cells, and draws until a chip holds targets."""

from __future__ import annotations

import random
from pathlib import Path

import duckdb
import pytest

from cubeloom.operators.areas import summed_area, window_cells, window_sums
from cubeloom.plans import sampling, sampling_sql

SF = "/root/testdata/sf0.01"
CELLS, WINDOWS = "g string, r long, c long, v long", "w long, g string, r0 long, c0 long, r1 long, c1 long"


@pytest.mark.parametrize(("height", "width", "block"), [(37, 23, 8), (16, 16, 16), (5, 40, 4), (1, 1, 16)])
def test_windows_have_the_sums_of_their_cells(spark, height, width, block):
    rng = random.Random(height)
    cells = [(g, rng.randrange(height), rng.randrange(width), rng.randrange(-9, 10**9)) for g in "ab" for _ in range(height * width // 3 + 1)]
    cells += [("a", height, 0, 5), ("a", 0, width, 5), ("a", -1, 0, 5), ("b", 0, 0, None), cells[0]]  # outside, null, a place twice
    windows = []
    for w in range(60):
        (r0, r1), (c0, c1) = (sorted(rng.choices(range(n + 1), k=2)) for n in (height, width))
        windows.append((w, rng.choice(["a", "b", "z", "empty"]), r0, c0, r1, c1))
    windows.append((60, "a", 0, 0, height, width))
    areas = summed_area(spark.createDataFrame(cells, CELLS), spark.createDataFrame([("a",), ("b",), ("empty",)], "g string"), spark.createDataFrame([(height,)], "height long"), width, block=block)
    got = {r["w"]: r["total"] for r in window_sums(areas, spark.createDataFrame(windows, WINDOWS), ["g"], ["w"], block).collect()}
    assert got == {w: sum(v for g, r, c, v in cells if g == of and r0 <= r < r1 and c0 <= c < c1 and v is not None) for w, of, r0, c0, r1, c1 in windows}


def test_no_cells_and_no_windows(spark):
    one = spark.createDataFrame([(20,)], "height long")
    names = spark.createDataFrame([("a",)], "g string")
    areas = summed_area(spark.createDataFrame([], CELLS), names, one, 20)
    assert areas.count() == 4 and summed_area(spark.createDataFrame([], CELLS), names.filter("g > 'a'"), one, 20).isEmpty()
    windows = spark.createDataFrame([(0, "a", 0, 0, 20, 20)], WINDOWS)
    assert [r["total"] for r in window_sums(areas, windows, ["g"], ["w"]).collect()] == [0]
    assert window_sums(areas, windows.filter("w > 0"), ["g"], ["w"]).isEmpty()


def test_retries_end_at_the_first_that_will_do(spark):
    samples = sampling.per_chip(spark, SF).unionByName(spark.createDataFrame([(10**9,)], "sample long"))
    by = lambda **k: {r["sample"]: r for r in sampling.retried(spark, SF, samples, **k).collect()}
    every = {t: by(least=10**9, tries=t + 1) for t in range(4)}  # nothing will do: the last draw
    assert all(r["attempt"] == t for t, rows in every.items() for r in rows.values())
    counts = sorted(r["n_valid"] for rows in every.values() for r in rows.values())
    least = counts[len(counts) * 2 // 3]
    got, seen = by(least=least, tries=4), set()
    for k, r in got.items():
        want = next((t for t in range(4) if every[t][k]["n_valid"] >= least), 3)
        assert r == every[want][k]
        seen.add(want)
    assert len(seen) > 1


@pytest.mark.parametrize("name", sorted(sampling.QUERIES))
def test_query_on_a_grid_of_several_chips(spark, name):
    """The smallest tables' grid is lower than a chip."""
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    ours = sampling.QUERIES[name](spark, SF)
    theirs = con.execute(sampling_sql.SQL[name]).df()[ours.columns]
    got, want = (sorted(map(tuple, x.values.tolist())) for x in (ours.toPandas(), theirs))
    assert got and got == want


def test_few_windows_go_to_the_cells(spark):
    rng = random.Random(3)
    cells = [(rng.choice("ab"), rng.randrange(30), rng.randrange(50), k) for k in range(900)]
    windows = [(k, rng.choice("abz"), r, c, r + rng.randrange(20), c + rng.randrange(20)) for k, (r, c) in enumerate((rng.randrange(-5, 30), rng.randrange(-5, 50)) for _ in range(40))]
    got = sorted(tuple(r) for r in window_cells(spark.createDataFrame(cells, CELLS), spark.createDataFrame(windows, WINDOWS), ["g"], 8).collect())
    assert got and got == sorted(x for x in cells for _, g, r0, c0, r1, c1 in windows if x[0] == g and r0 <= x[1] < r1 and c0 <= x[2] < c1)


def test_sampled_stats_shuffles_pixels_only(spark, capsys):
    """The cells of layers, kinds of sums and blocks are not shuffled: exchanges are the cube's and that of four layers."""
    sampling.sampled_stats(spark, SF).explain()
    shuffles = [x for x in capsys.readouterr().out.splitlines() if "hashpartitioning(" in x]
    assert len(shuffles) == 2 and not [x for x in shuffles if "bi#" in x or "yr#" in x and "pid#" not in x]
