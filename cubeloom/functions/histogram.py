"""Bins of a histogram as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed edges of the change histogram and of its report.
CHANGE_EDGES = (-1.0, -0.005, 0.005, 0.02, 0.1, 0.2, 0.4, 0.6, 1.0)
REPORT_EDGES = (-1.0, -0.05, 0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0)


def bin_of(x: Column, edges=CHANGE_EDGES) -> Column:
    """The bin's number from 0; bins hold their left edge, the last also its right one; null outside."""
    out = F.when((x >= edges[-2]) & (x <= edges[-1]), len(edges) - 2)
    for i in range(len(edges) - 3, -1, -1):
        out = out.when((x >= edges[i]) & (x < edges[i + 1]), i)
    return out


def midpoints(edges=CHANGE_EDGES) -> list[float]:
    return [(a + b) / 2 for a, b in zip(edges[:-1], edges[1:], strict=True)]


def widths(edges=CHANGE_EDGES) -> list[float]:
    """Distances of neighbouring midpoints, the last repeated."""
    m = midpoints(edges)
    d = [b - a for a, b in zip(m[:-1], m[1:], strict=True)]
    return [*d, d[-1]]
