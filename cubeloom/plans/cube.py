"""The raster cube that the registered queries run on, derived from the driver's tables.

A pixel is four consecutive order keys; a grid has 64 columns; a ship year is a layer year. Values come from sums of whole
numbers, so that they don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, CHIP = 64, 16
YEARS = (1990, 1995, 2000, 2005, 2010, 2015, 2020)
LAYERS = ("hm", "ag", "ti", "gdp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(c: str, scale: int) -> Column:
    return F.sum(F.round(F.col(c) * scale).cast("long"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, yr, hm, ag, ti, gdp``: one row a pixel and year."""
    t = table(spark, sf_dir, "lineitem")
    n = F.count("*")
    return t.groupBy(F.expr("l_orderkey div 4").alias("pid"), (1990 + 5 * (F.year("l_shipdate") - 1995)).cast("int").alias("yr")).agg(
        (whole("l_discount", 100) / (10.0 * n)).alias("hm"), (whole("l_tax", 100) / (8.0 * n)).alias("ag"),
        (whole("l_quantity", 1) / (50.0 * n)).alias("ti"), (whole("l_extendedprice", 100) / (100.0 * n)).alias("gdp"),
    )


def placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"r": F.expr("pid div 64"), "c": F.col("pid") % WIDTH})


def long_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, yr, layer, v``."""
    return cube(spark, sf_dir).unpivot(["pid", "yr"], list(LAYERS), "layer", "v")


def statics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, ele, tas``: two layers without time; ``tas`` may be negative."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    n = F.count("*")
    return joined.groupBy(F.expr("o_orderkey div 4").alias("pid")).agg((whole("o_totalprice", 100) / (100.0 * n)).alias("ele"), (whole("c_acctbal", 100) / (100.0 * F.count("c_acctbal"))).alias("tas"))


def wide(spark: SparkSession, sf_dir: str, layer: str = "hm") -> DataFrame:
    """``pid, r, c, y1990 .. y2020``: all years of a layer, one row a pixel."""
    years = [F.max(F.when(F.col("yr") == y, F.col(layer))).alias(f"y{y}") for y in YEARS]
    return placed(cube(spark, sf_dir).groupBy("pid").agg(*years))


def horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, r, c, h, first, prev, last, target, pred, lower, upper``: inputs 1990 to 2000, the target of each of four
    horizons (left-outer: null where there is none) and a stand-in for a model's three outputs."""
    w = wide(spark, sf_dir)
    h = F.explode(F.array(*[F.struct(F.lit(i).alias("h"), F.col(f"y{2000 + 5 * i}").alias("target")) for i in range(1, 5)])).alias("x")
    w = w.select("pid", "r", "c", F.col("y1990").alias("first"), F.col("y1995").alias("prev"), F.col("y2000").alias("last"), h)
    w = w.select("pid", "r", "c", "x.h", "first", "prev", "last", "x.target")
    p = F.col("last") + (F.col("last") - F.col("prev")) * F.col("h") / 2.0
    return w.withColumn("pred", p).withColumns({"lower": p - 0.2, "upper": p + 0.2})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``horizons`` where inputs and target are present."""
    return horizons(spark, sf_dir).dropna(subset=["first", "prev", "last", "target"])


def height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the grid's height."""
    # the largest key alone: no pixel has to be built for it
    return table(spark, sf_dir, "lineitem").agg((F.expr("max(l_orderkey) div 4 div 64") + 1).alias("height"))


def tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``tile, p, t``: an embedding, and the one after it where there is one, as arrays."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tile"), F.col("embedding").alias("p"))
    return e.join(e.select((F.col("tile") - 1).alias("tile"), F.col("p").alias("t")), "tile", "left")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight by eight tiles ``tile, r, c, p, t``: an embedding and the one after it. Arrays are joined, then opened."""
    e = tensor(spark, sf_dir).filter(F.col("t").isNotNull()).select("tile", F.posexplode(F.arrays_zip("p", "t")).alias("pos", "v"))
    place = (F.expr("cast(pos div 8 as bigint)").alias("r"), (F.col("pos") % 8).cast("long").alias("c"))
    return e.select("tile", *place, F.col("v.p").cast("double").alias("p"), F.col("v.t").cast("double").alias("t"))
