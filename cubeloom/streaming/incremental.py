"""Incremental statistics and blends: states that merge, kept up to date as new files land."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def layer_moments(pixels: DataFrame) -> DataFrame:
    """``layer, n, mean, m2`` (the sum of squared distances from the mean): mergeable, and no difference of large sums."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return pixels.groupBy("layer").agg(F.count(v).alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row a layer from any number of rows with moments."""

    def add(a, b):
        n = a["n"] + b["n"]
        safe, d = F.greatest(n, F.lit(1)), b["mean"] - a["mean"]
        return F.struct(n.alias("n"), (a["mean"] + d * b["n"] / safe).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / safe).alias("m2"))

    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    folded = parts.groupBy("layer").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("n", "mean", "m2"))), zero, add).alias("x"))
    return folded.select("layer", "x.*")


def finished(moments: DataFrame) -> DataFrame:
    """Mean and population deviation; 0 and 1 for a layer without values."""
    some = F.col("n") > 0
    m = merged_moments(moments)
    return m.select("layer", F.when(some, F.col("mean")).otherwise(0.0).alias("mean"), F.when(some, F.sqrt(F.col("m2") / F.col("n")) + 1e-8).otherwise(1.0).alias("std"))


def blend_sums(parts: DataFrame) -> DataFrame:
    """``row, col, vw, w`` of weighted predictions."""
    return parts.groupBy("row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("vw"), F.sum("w").alias("w"))


def merged_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("row", "col").agg(F.sum("vw").alias("vw"), F.sum("w").alias("w"))


def blended(sums: DataFrame) -> DataFrame:
    """``row, col, v``: null where no weight is."""
    return merged_sums(sums).select("row", "col", F.when(F.col("w") > 0, F.col("vw") / F.col("w")).alias("v"))


def keep(stream: DataFrame, path: str, checkpoint: str, of: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Keep the merged state of a stream: each micro-batch merges its own with the last version and writes the next one,
    then drops those before the last. A batch that is repeated after a failure replaces its own version, so that every
    row counts once, and the state has two versions however long the stream runs."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        before = sorted(int(n.partition("=")[2]) for n in names if n.startswith("version="))
        before = [v for v in before if v < number]
        state = of(batch)
        if before:
            state = merge(state.unionByName(spark.read.parquet(f"{path}/version={before[-1]}")))
        state.write.mode("overwrite").parquet(f"{path}/version={number}")
        for v in before[:-1]:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}"), True)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str) -> DataFrame:
    """The last version of a kept state."""
    versions = spark.read.parquet(path)
    return versions.join(F.broadcast(versions.agg(F.max("version").alias("version"))), "version").drop("version")


def keep_layer_moments(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return keep(stream, path, checkpoint, layer_moments, merged_moments)


def keep_blend_sums(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return keep(stream, path, checkpoint, blend_sums, merged_sums)
