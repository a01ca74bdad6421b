"""Training batches: chips of one split with an end year each, their inputs, places and targets, normalised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators import pixel
from cubeloom.plans.assembly import BATCH, END_YEARS, picked
from cubeloom.plans.cube import CHIP, WIDTH, cube, height, statics
from cubeloom.plans.queries import DX, X0, Y0, r9, split_chips, stats

col = F.col
DRAWS, JITTER = 2, CHIP // 4
INPUTS, TARGETS = (-10, -5, 0), (5, 10, 15, 20)
#: Layers whose missing values mean none; those of the others stay missing.
COVARIATES = ("ag", "ti", "gdp")


def split_samples(s, d, split: int = 1, draws: int = DRAWS) -> DataFrame:
    """``sample, end_year, r0, c0``: every chip of a split some times, each time moved a little and with a year of its own. A
    draw depends on its number only, so that it is the same at every layout."""
    x = split_chips(s, d).filter(col("split") == split).crossJoin(F.broadcast(height(s, d)))
    x = x.withColumn("draw", F.explode(F.array(*map(F.lit, range(draws)))))
    x = x.withColumn("sample", ((col("ci") * (WIDTH // CHIP) + col("cj")) * draws + col("draw")).cast("long"))
    moved = lambda salt, c, top: F.greatest(F.lit(0), F.least(col(c) * CHIP + picked(salt, col("sample"), 2 * JITTER) - JITTER, top)).cast("long")
    year = F.element_at(F.array(*[F.lit(y) for y in END_YEARS]), (picked("end", col("sample"), len(END_YEARS)) + 1).cast("int"))
    return x.select("sample", year.alias("end_year"), moved("down", "ci", col("height") - CHIP).alias("r0"), moved("right", "cj", F.lit(WIDTH - CHIP)).alias("c0"))


def one_row(df: DataFrame, name: str, columns: dict) -> DataFrame:
    return F.broadcast(df.agg(*[c.alias(f"{name}_{k}") for k, c in columns.items()]))


def cells(s, d, samples: DataFrame) -> DataFrame:
    """A row a cell of each sample's chip: its place, inputs ``<layer>_<t>`` and static layers by z-scores, targets ``t_<years>``
    by z-scores of the target layer; null where there is none. A cell finds its pixel by one equi-join on its number, so that
    nothing is matched that is not in the batch."""
    span = lambda c: F.explode(F.sequence(col(c), col(c) + CHIP - 1))
    x = samples.withColumn("r", span("r0")).withColumn("c", span("c0")).withColumn("pid", col("r") * WIDTH + col("c"))
    years = cube(s, d).groupBy("pid").agg(F.map_from_entries(F.collect_list(F.struct("yr", F.struct("hm", *COVARIATES)))).alias("m"))
    x = x.join(years, "pid", "left").join(statics(s, d), "pid", "left")
    layers = stats(s, d)
    x = x.crossJoin(one_row(layers, "mean", {k: F.max(F.when(col("layer") == k, col("mean"))) for k in ("hm", *COVARIATES)}))
    x = x.crossJoin(one_row(layers, "std", {k: F.max(F.when(col("layer") == k, col("std"))) for k in ("hm", *COVARIATES)}))
    x = x.crossJoin(one_row(statics(s, d), "mean", {k: F.avg(k) for k in ("ele", "tas")})).crossJoin(one_row(statics(s, d), "std", {k: F.stddev_pop(k) + 1e-8 for k in ("ele", "tas")}))
    x = x.crossJoin(F.broadcast(height(s, d)))
    z = lambda v, k: pixel.zscore(v, col(f"mean_{k}"), col(f"std_{k}"))
    at = lambda k: F.try_element_at("m", col("end_year") + k)
    inputs = {f"hm_{t}": z(at(k)["hm"], "hm") for t, k in enumerate(INPUTS)}
    inputs |= {f"{v}_{t}": z(F.coalesce(at(k)[v], F.lit(0.0)), v) for v in COVARIATES for t, k in enumerate(INPUTS)}
    inputs |= {"ele": z(F.coalesce("ele", F.lit(0.0)), "ele"), "tas": z(col("tas"), "tas")}
    targets = {f"t_{k}": F.when(col("end_year") + k <= 2020, z(at(k)["hm"], "hm")) for k in TARGETS}
    lon, lat = pixel.lonlat(col("r"), col("c"), X0, Y0, DX, -180.0 / col("height"))
    return x.select("sample", "end_year", (col("r") - col("r0")).alias("i"), (col("c") - col("c0")).alias("j"), lon.alias("lon"), lat.alias("lat"), *[c.alias(k) for k, c in (inputs | targets).items()])


def batches(s, d, samples: DataFrame) -> DataFrame:
    """``batch, sample, end_year, lonlat, x, y``: cells by rows of the chip; ``x`` holds the dynamic layers of each input time
    and then the static ones, ``y`` the four targets. A sample without any target is left out."""
    c = cells(s, d, samples)
    dynamic = [k for t in range(len(INPUTS)) for k in (f"hm_{t}", *(f"{v}_{t}" for v in COVARIATES))]
    cell = F.struct("i", "j", F.array("lon", "lat").alias("lonlat"), F.array(*dynamic, "ele", "tas").alias("x"), F.array(*[f"t_{k}" for k in TARGETS]).alias("y"))
    seen = reduce(lambda a, b: a | b, [col(f"t_{k}").isNotNull() for k in TARGETS])
    x = c.groupBy("sample", "end_year").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max(seen).alias("seen")).filter("seen")
    part = lambda name: F.transform("cells", lambda e: e[name]).alias(name)
    return x.select(F.expr(f"sample div {BATCH}").alias("batch"), "sample", "end_year", part("lonlat"), part("x"), part("y"))


def batch_assembly(s, d):
    """The batches of the training split, as sums and counts of what a model gets of each channel."""
    x = batches(s, d, split_samples(s, d))
    total = lambda name, k: F.round(F.aggregate(name, F.lit(0.0), lambda a, e: a + F.coalesce(e[k], F.lit(0.0))), 4)
    known = lambda name, k: F.aggregate(name, F.lit(0), lambda a, e: a + e[k].isNotNull().cast("int"))
    dynamic = [f"{v}_{t}" for t in range(len(INPUTS)) for v in ("hm", *COVARIATES)]
    sums = [total("x", k).alias(f"sum_{v}") for k, v in enumerate([*dynamic, "ele", "tas"])]
    counts = [known("x", k).alias(f"n_{v}") for k, v in enumerate(dynamic) if v.startswith("hm")] + [known("x", len(dynamic) + 1).alias("n_tas")]
    targets = [f(*a).alias(f"{n}_t_{y}") for k, y in enumerate(TARGETS) for n, f, a in (("sum", total, ("y", k)), ("n", known, ("y", k)))]
    return x.select("batch", "sample", "end_year", F.size("x").alias("cells"), total("lonlat", 0).alias("sum_lon"), total("lonlat", 1).alias("sum_lat"), *sums, *counts, *targets)


def target_years(s, d):
    """How many samples of each end year have each target, by split: what is missing after the last year."""
    parts = [batches(s, d, split_samples(s, d, k)).withColumn("split", F.lit(k)) for k in (1, 2)]
    x = parts[0].unionByName(parts[1])
    has = lambda k: F.sum(F.exists("y", lambda e: e[k].isNotNull()).cast("long"))
    return x.groupBy("split", "end_year").agg(F.count("*").alias("samples"), *[has(k).alias(f"n_{y}") for k, y in enumerate(TARGETS)])


PLAIN = [batch_assembly, target_years]
QUERIES = {f.__name__: f for f in PLAIN}
