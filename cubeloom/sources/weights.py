"""Stored weights of models: one Parquet row an array."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession


def save(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    rows = [(name, list(w.shape), [float(v) for v in w.ravel()]) for name, w in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, weights array<double>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A model's weights, which fit the driver as they fit every worker."""
    rows = spark.read.parquet(path).collect()
    return {r["name"]: np.array(r["weights"]).reshape(r["shape"]) for r in rows}


def resolved(spark: SparkSession, *candidates: str | None) -> str | None:
    """The first of the paths that exists, in any file system that Spark reads; None if there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in filter(None, candidates):
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    return None
