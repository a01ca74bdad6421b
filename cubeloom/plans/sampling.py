"""Statistics over a few windows drawn at random, and chips drawn again until they hold targets, by summed-area tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators.areas import summed_area, window_cells, window_sums
from cubeloom.plans.assembly import END_YEARS, picked
from cubeloom.plans.cube import CHIP, WIDTH, YEARS, cube, height, long_layers, placed
from cubeloom.plans.queries import r9

col = F.col
#: Units a value of each layer, so that their sums are whole numbers; windows a layer and year; draws of a chip.
UNITS, DRAWN, TRIES = {"hm": 10_000, "ag": 10_000, "ti": 10_000, "gdp": 1}, 32, 10


def drawn(windows: DataFrame, s, d, salt: str, number) -> DataFrame:
    """``r0, c0, r1, c1`` of a chip anywhere on the grid, the same for the same ``number`` at every layout. A grid lower than a
    chip has none."""
    x = windows.crossJoin(F.broadcast(height(s, d))).filter(col("height") >= CHIP)
    x = x.withColumns({"r0": picked(f"{salt}row", number, col("height") - CHIP + 1), "c0": picked(f"{salt}col", number, F.lit(WIDTH - CHIP + 1))})
    return x.withColumns({"r1": col("r0") + CHIP, "c1": col("c0") + CHIP}).drop("height")


def sampled_stats(s, d):
    """Mean and standard deviation of each layer over windows drawn in each year; cells of several windows count each time, as
    they do in the stacked windows of a loader."""
    v = F.floor(col("v") * F.element_at(F.create_map(*[F.lit(k) for e in UNITS.items() for k in e]), col("layer")) + 0.5).cast("long")
    x = placed(long_layers(s, d)).filter("v IS NOT NULL").select("layer", "yr", "r", "c", v.alias("u"))
    few = lambda name, values: F.explode(F.array(*map(F.lit, values))).alias(name)
    w = s.range(1).select(few("layer", UNITS)).select("*", few("yr", YEARS)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWN - 1))))
    w = drawn(w, s, d, "st", F.concat_ws("_", "layer", "yr", "draw"))
    # a fixed number of windows goes to the cells
    total = lambda c: F.sum(c).cast("double")
    x = window_cells(x, w, ["layer", "yr"]).groupBy("layer").agg(F.count("*").cast("double").alias("n"), total("u").alias("t"), total(col("u") * col("u")).alias("q"))
    unit = F.element_at(F.create_map(*[F.lit(k) for e in UNITS.items() for k in e]), col("layer"))
    mean = col("t") / col("n")
    return x.filter("n > 0").select("layer", col("n").cast("long").alias("cells"), F.round(mean / unit, 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), col("q") / col("n") - mean * mean)) / unit, 6).alias("std"))


def retried(s, d, samples: DataFrame, least: int = 1, tries: int = TRIES) -> DataFrame:
    """``sample, end_year, attempt, r0, c0, n_valid``: of up to ``tries`` chips drawn for each ``sample`` with an end year each, the
    first that has ``least`` valid target cells (of the years after its inputs, each counted), else the last."""
    x = samples.select("sample", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("attempt"))
    number = F.concat_ws("_", "sample", "attempt")
    year = F.element_at(F.array(*[F.lit(y) for y in END_YEARS]), (picked("reyear", number, len(END_YEARS)) + 1).cast("int"))
    x = drawn(x.withColumn("end_year", year), s, d, "re", number)
    key = ["sample", "attempt", "end_year", "r0", "c0"]
    later = F.explode(F.filter(F.array(*[col("end_year") + k for k in (5, 10, 15, 20)]), lambda y: y <= YEARS[-1])).alias("yr")
    cells = placed(cube(s, d)).filter("hm IS NOT NULL").select("yr", "r", "c", F.lit(1).cast("long").alias("v"))
    sums = window_sums(summed_area(cells, s.range(1).select(F.explode(F.array(*map(F.lit, YEARS))).alias("yr")), height(s, d), WIDTH), x.select(*key, "r1", "c1", later), ["yr"], key)
    n = sums.groupBy(*key).agg(F.sum("total").alias("n_valid"))
    first = F.when(col("n_valid") >= least, F.struct("attempt", "end_year", "r0", "c0", "n_valid"))
    got = n.groupBy("sample").agg(F.coalesce(F.min(first), F.max(F.struct("attempt", "end_year", "r0", "c0", "n_valid"))).alias("x"))
    return got.select("sample", "x.*")


def per_chip(s, d) -> DataFrame:
    """``sample``: as many numbers as the grid has chips."""
    n = F.floor(col("height") / CHIP).cast("long") * (WIDTH // CHIP)
    return height(s, d).select(F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))).alias("sample"))


def chip_retry(s, d):
    """A chip for each number with any target."""
    return retried(s, d, per_chip(s, d))


def chip_retry_dense(s, d):
    """As ``chip_retry``, by chips with at least two targets a cell on average: one that ends late or lies in a gap is drawn again."""
    x = retried(s, d, per_chip(s, d), least=2 * CHIP * CHIP)
    return x.withColumn("targets", r9(col("n_valid") / (CHIP * CHIP)))


PLAIN = [sampled_stats, chip_retry, chip_retry_dense]
QUERIES = {f.__name__: f for f in PLAIN}
