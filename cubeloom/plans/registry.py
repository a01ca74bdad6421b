"""All registered raster queries and their SQL."""

from __future__ import annotations

from cubeloom.plans import assembly, assembly_sql, loader, loader_sql, queries, rasters, rasters_sql, region_prediction, region_prediction_sql, sampling, sampling_sql, shuffling, shuffling_sql, sql

QUERIES = queries.QUERIES | assembly.QUERIES | rasters.QUERIES | loader.QUERIES | sampling.QUERIES | shuffling.QUERIES | region_prediction.QUERIES
SQL = sql.SQL | assembly_sql.SQL | rasters_sql.SQL | loader_sql.SQL | sampling_sql.SQL | shuffling_sql.SQL | region_prediction_sql.SQL
