"""Masked accuracy, distribution and interval metrics, one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.histogram import CHANGE_EDGES, bin_of, widths


def mse(p: Column, t: Column) -> Column:
    return F.avg((p - t) * (p - t))


def mae(p: Column, t: Column) -> Column:
    return F.avg(F.abs(p - t))


def pinball(p: Column, t: Column, q: float) -> Column:
    """The mean quantile loss; 0 without rows."""
    e = t - p
    return F.coalesce(F.avg(F.when(e >= 0, e * q).otherwise(e * (q - 1))), F.lit(0.0))


def coverage(low: Column, t: Column, high: Column) -> Column:
    return 100.0 * F.avg(F.when((t >= low) & (t <= high), 1.0).otherwise(0.0))


def histogram(df: DataFrame, value: Column, keys: list[str], edges=CHANGE_EDGES) -> DataFrame:
    """``keys, bin, n`` with every bin of every key that has rows; values outside the edges are in none."""
    counts = df.withColumn("bin", bin_of(value, edges)).groupBy(*keys).agg(*[F.sum(F.when(F.col("bin") == b, 1).otherwise(0)).alias(str(b)) for b in range(len(edges) - 1)])
    return counts.unpivot(keys, [str(b) for b in range(len(edges) - 1)], "bin", "n").withColumn("bin", F.col("bin").cast("int"))


def proportions(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``p`` of each bin; without any value in a bin all are equally likely."""
    w = Window.partitionBy(*keys)
    total = F.sum("n").over(w)
    return hist.withColumn("p", F.when(total == 0, 1.0 / F.count("*").over(w)).otherwise(F.col("n") / total))


def rarity(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``weight``: the inverse of each bin's count, scaled to a mean of 1 a key."""
    w = Window.partitionBy(*keys)
    raw = 1.0 / (F.col("n") + 1e-3)
    return hist.withColumn("weight", raw * F.count("*").over(w) / F.sum(raw).over(w))


def wasserstein(observed: DataFrame, predicted: DataFrame, keys: list[str], weights: DataFrame | None = None, weight_keys: list[str] | None = None) -> DataFrame:
    """``w2``: the squared distance of cumulated proportions a key, weighted by the distances of the bins' middles."""
    both = observed.select(*keys, "bin", F.col("p").alias("a")).join(predicted.select(*keys, "bin", F.col("p").alias("b")), [*keys, "bin"])
    return wasserstein_of(both, keys, weights, weight_keys)


def paired_proportions(df: DataFrame, a: Column, b: Column, keys: list[str], edges=CHANGE_EDGES) -> DataFrame:
    """``keys, bin, a, b``: two values' proportions in every bin of every key, from one pass over the rows."""
    bins = range(len(edges) - 1)
    both = df.withColumns({"_a": bin_of(a, edges), "_b": bin_of(b, edges)})
    counts = both.groupBy(*keys).agg(*[F.array(*[F.sum(F.when(F.col(c) == k, 1).otherwise(0)) for k in bins]).alias(c) for c in ("_a", "_b")])

    def parts(c):
        total = F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
        return F.transform(c, lambda n: F.when(total == 0, 1.0 / len(bins)).otherwise(n / total))

    each = F.posexplode(F.arrays_zip(parts("_a").alias("a"), parts("_b").alias("b"))).alias("bin", "x")
    return counts.select(*keys, each).select(*keys, "bin", F.col("x.a").alias("a"), F.col("x.b").alias("b"))


def wasserstein_of(both: DataFrame, keys: list[str], weights: DataFrame | None = None, weight_keys: list[str] | None = None) -> DataFrame:
    """``w2`` of rows ``keys, bin, a, b``."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("d", F.sum(F.col("a") - F.col("b")).over(w))
    step = F.element_at(F.array(*[F.lit(x) for x in widths()]), F.col("bin") + 1)
    term = F.col("d") * F.col("d") * step
    if weights is not None:
        both = both.join(weights, [*(weight_keys or []), "bin"])
        term = term * F.col("weight")
    return both.groupBy(*keys).agg(F.sum(term).alias("w2"))


def blend(parts: DataFrame, keys: list[str], value: str = "v", weight: str = "w") -> DataFrame:
    """Weighted means; null where the weights sum to 0."""
    total = F.sum(weight)
    return parts.groupBy(*keys).agg(F.when(total > 0, F.sum(F.col(value) * F.col(weight)) / total).alias(value), total.alias(weight))


def blend_columns(parts: DataFrame, keys: list[str], values: list[str], weight: str = "w") -> DataFrame:
    """As ``blend``, of several values that share their weight: one group a key."""
    total = F.sum(weight)
    return parts.groupBy(*keys).agg(*[F.when(total > 0, F.sum(F.col(v) * F.col(weight)) / total).alias(v) for v in values], total.alias(weight))


def macro(per_group: DataFrame, groups: int, columns: list[str]) -> DataFrame:
    """The mean over a fixed number of groups; a group without rows counts as 0 (not a pooled mean)."""
    return per_group.agg(*[(F.coalesce(F.sum(c), F.lit(0.0)) / groups).alias(c) for c in columns])
