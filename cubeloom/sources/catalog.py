"""Layer files by name: ``HM_{year}_{layer}_1000.tiff`` has a year, ``hm_static_{layer}_1000.tiff`` none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of the layers: the target, what goes with it, and the static ones in order.
TARGET = "AA"
DYNAMIC = ("AG", "BU", "EX", "FR", "HI", "NS", "PO", "TI", "gdp", "population")
STATIC = ("ele", "tas", "tasmin", "pr", "dpi_dsi", "iucn_nostrict", "iucn_strict")


def file_name(layer: str, year: int | None) -> str:
    return f"hm_static_{layer}_1000.tiff" if year is None else f"HM_{year}_{layer}_1000.tiff"


def parsed(path: Column) -> tuple[Column, Column]:
    """Layer and year (null for static layers) of a path; null where the name is of neither kind."""
    name = F.element_at(F.split(path, "/"), -1)
    year = F.regexp_extract(name, r"^HM_([0-9]{4})_.+_1000\.tiff$", 1)
    layer = F.regexp_extract(name, r"^(?:HM_[0-9]{4}|hm_static)_(.+)_1000\.tiff$", 1)
    return F.nullif(layer, F.lit("")), F.nullif(year, F.lit("")).cast("int")


def manifest(paths: DataFrame, column: str = "path") -> DataFrame:
    layer, year = parsed(F.col(column))
    return paths.withColumns({"layer": layer, "year": year}).filter(F.col("layer").isNotNull())
