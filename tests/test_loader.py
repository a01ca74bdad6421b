"""Batches as a loader yields them: years by the sample's own end year, targets that end with the last year, one split."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cubeloom.plans import loader
from cubeloom.plans.cube import CHIP, cube, height, statics
from cubeloom.plans.queries import split_chips

SF = "/root/testdata/sf0.01"


def test_samples_stay_in_their_split_and_grid(spark):
    chips = {(r["ci"], r["cj"]): r["split"] for r in split_chips(spark, SF).collect()}
    top = height(spark, SF).first()[0]
    for split in (1, 2):
        got = loader.split_samples(spark, SF, split, 3).collect()
        assert len(got) == 3 * sum(k == split for k in chips.values()) and len({r["sample"] for r in got}) == len(got)
        for r in got:
            ci, cj = r["sample"] // 3 // 4, r["sample"] // 3 % 4
            assert chips[ci, cj] == split and abs(r["r0"] - ci * CHIP) <= CHIP and abs(r["c0"] - cj * CHIP) <= 4
            assert 0 <= r["r0"] <= top - CHIP and 0 <= r["c0"] <= 64 - CHIP


def test_batches_hold_the_right_years(spark):
    samples = spark.createDataFrame([(0, 2000, 3, 5), (1, 2015, 0, 48), (2, 2005, 3, 5)], "sample long, end_year int, r0 long, c0 long")
    got = {r["sample"]: r for r in loader.batches(spark, SF, samples).collect()}
    values = {(r["pid"], r["yr"]): r for r in cube(spark, SF).collect()}
    fixed = {r["pid"]: r for r in statics(spark, SF).collect()}
    layer = [r["hm"] for r in values.values()]
    mean = sum(layer) / len(layer)
    std = math.sqrt(sum((v - mean) ** 2 for v in layer) / len(layer)) + 1e-8
    gdp = [r["gdp"] for r in values.values()]
    gdp_mean = sum(gdp) / len(gdp)
    gdp_std = math.sqrt(sum((v - gdp_mean) ** 2 for v in gdp) / len(gdp)) + 1e-8
    near = lambda a, b: (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)
    for s in samples.collect():
        r = got[s["sample"]]
        assert len(r["x"]) == len(r["y"]) == len(r["lonlat"]) == CHIP * CHIP and len(r["x"][0]) == 14
        for n in range(CHIP * CHIP):
            pid = (s["r0"] + n // CHIP) * 64 + s["c0"] + n % CHIP
            for t, k in enumerate((-10, -5, 0)):
                one = values.get((pid, s["end_year"] + k))
                assert near(r["x"][n][4 * t], None if one is None else (one["hm"] - mean) / std)
                assert near(r["x"][n][4 * t + 3], ((0.0 if one is None else one["gdp"]) - gdp_mean) / gdp_std)  # missing means none
            assert (r["x"][n][13] is None) == (pid not in fixed or fixed[pid]["tas"] is None)
            assert r["x"][n][12] is not None
            for t, k in enumerate((5, 10, 15, 20)):
                one = values.get((pid, s["end_year"] + k)) if s["end_year"] + k <= 2020 else None
                assert near(r["y"][n][t], None if one is None else (one["hm"] - mean) / std)
            assert near(r["lonlat"][n][0], -180 + (s["c0"] + n % CHIP + 0.5) * 5.625)
    assert any(y[0] is not None for y in got[1]["y"]) and all(y[1:] == [None] * 3 for y in got[1]["y"])
    # a sample without any target is left out
    assert loader.batches(spark, SF, samples.withColumn("end_year", F.lit(2020))).isEmpty()
