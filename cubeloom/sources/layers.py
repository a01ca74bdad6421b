"""Raster layers at rest: long Parquet by layer and year, sorted so that a window reads few row groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TILE = 512


def write_layers(pixels: DataFrame, path: str, tile: int = TILE) -> None:
    """``layer, year, row, col, value`` with NaN as null. Rows of a tile stay together; a layer of a year is spread over
    its tiles' hashes, so that a large one is no single task."""
    rows = pixels.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    keyed = rows.withColumns({"tile_row": F.floor(F.col("row") / tile), "tile_col": F.floor(F.col("col") / tile)})
    spread = keyed.repartition("layer", "year", "tile_row", "tile_col").sortWithinPartitions("layer", "year", "tile_row", "tile_col", "row", "col")
    spread.write.mode("overwrite").partitionBy("layer", "year").parquet(path)


def read_window(spark: SparkSession, path: str, layers: list[str], years: list[int], rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """A half-open window of some layers and years; every condition reaches the scan."""
    df = spark.read.parquet(path)
    inside = (F.col("row") >= rows[0]) & (F.col("row") < rows[1]) & (F.col("col") >= cols[0]) & (F.col("col") < cols[1])
    return df.filter(F.col("layer").isin(layers) & F.col("year").isin(years) & inside).drop("tile_row", "tile_col")


def write_predictions(pred: DataFrame, path: str) -> None:
    """One folder a target year and quantile."""
    pred.write.mode("overwrite").partitionBy("target_year", "quantile").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """``phase, epoch, horizon, metric, value`` appended."""
    metrics.select("phase", "epoch", "horizon", "metric", "value").write.mode("append").parquet(path)


def full_validation_rows(per_horizon: DataFrame, epoch: int, names: list[str]) -> DataFrame:
    """``phase, epoch, horizon, metric, value`` from a column a metric (``h`` and ``names``): each horizon's values, and the
    mean over the horizons that are there as ``<name>_avg`` of horizon 0."""
    one = per_horizon.unpivot(["h"], names, "metric", "value").select(F.lit("val_full").alias("phase"), F.lit(epoch).alias("epoch"), (F.col("h") * 5).cast("int").alias("horizon"), "metric", F.col("value").cast("double").alias("value"))
    mean = one.groupBy("phase", "epoch", "metric").agg(F.avg("value").alias("value")).select("phase", "epoch", F.lit(0).alias("horizon"), F.concat("metric", F.lit("_avg")).alias("metric"), "value")
    return one.unionByName(mean)


def step_rows(steps: DataFrame, phase: str, names: list[str]) -> DataFrame:
    """``phase, epoch, horizon, metric, value`` of an epoch from the metrics of its steps (``epoch, batch_size`` and
    ``names``), each step counted by its batch."""
    weighted = [(F.sum(F.col(c) * F.col("batch_size")) / F.sum("batch_size")).alias(c) for c in names]
    return steps.groupBy("epoch").agg(*weighted).unpivot(["epoch"], names, "metric", "value").select(F.lit(phase).alias("phase"), "epoch", F.lit(0).alias("horizon"), "metric", "value")


def observed(pred: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The predictions and a count of their tiles and valid pixels, taken as they are written: no second pass."""
    seen = Observation(name)
    valid = F.sum(F.when(F.col("pred").isNotNull() & ~F.isnan("pred"), 1).otherwise(0))
    return pred.observe(seen, F.approx_count_distinct(F.struct("ti", "tj")).alias("tiles"), F.count("*").alias("pixels"), valid.alias("valid_pixels")), seen


def best_checkpoint(metrics: DataFrame) -> DataFrame:
    """The path of the smallest total loss; ties go to the first path."""
    return metrics.agg(F.min_by("path", F.struct("val_total_loss", "path")).alias("path"), F.min("val_total_loss").alias("val_total_loss"))
