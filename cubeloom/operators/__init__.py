"""Operators over raster cubes held as long DataFrames."""
