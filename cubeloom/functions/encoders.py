"""Position encoders of longitude and latitude in degrees, as arrays of column expressions."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def frequencies(n: int, low: float, high: float) -> list[float]:
    """``n`` frequencies, geometric between the reciprocals of ``low`` and ``high``."""
    if n < 2:
        raise ValueError("at least two frequencies are needed")
    return [1.0 / (low * math.exp(k * math.log(high / low) / (n - 1))) for k in range(n)]


def random_frequencies(n: int, high: float, seed: int = 0) -> list[float]:
    """``n`` frequencies drawn evenly from 0 to ``high``."""
    rng = random.Random(seed)
    return [rng.random() * high for _ in range(n)]


def direct(lon: Column, lat: Column) -> list[Column]:
    return [F.radians(lon) - math.pi, F.radians(lat) - math.pi]


def cartesian3d(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(a) * F.cos(b), F.sin(a) * F.cos(b), F.sin(b)]


def wrap(lon: Column, lat: Column) -> list[Column]:
    a, b = F.radians(lon), F.radians(lat)
    return [F.cos(a), F.sin(a), F.cos(b), F.sin(b)]


def grid(lon: Column, lat: Column, freqs: list[float]) -> list[Column]:
    """Sine and cosine of each coordinate at each frequency; degrees are taken as they are."""
    return [f(x * w) for x in (lon, lat) for w in freqs for f in (F.sin, F.cos)]


def _sphere(freqs: list[float], terms: Callable[[float], list[Column]]) -> list[Column]:
    """Each term twice: the frequency matrix has two equal columns."""
    return [t for w in freqs for t in terms(w) for _ in range(2)]


def spherec(lon, lat, freqs):
    return _sphere(freqs, lambda w: [F.sin(lat * w), F.cos(lat * w) * F.cos(lon * w), F.cos(lat * w) * F.sin(lon * w)])


def spherecplus(lon, lat, freqs):
    return _sphere(freqs, lambda w: [F.sin(lat * w), F.cos(lat * w), F.sin(lon * w), F.cos(lon * w), F.cos(lat * w) * F.cos(lon * w), F.cos(lat * w) * F.sin(lon * w)])


def _mixed(lon, lat, w):
    return [F.cos(lat * w) * F.cos(lon), F.cos(lat) * F.cos(lon * w), F.cos(lat * w) * F.sin(lon), F.cos(lat) * F.sin(lon * w)]


def spherem(lon, lat, freqs):
    return _sphere(freqs, lambda w: [F.sin(lat * w), *_mixed(lon, lat, w)])


def spheremplus(lon, lat, freqs):
    return _sphere(freqs, lambda w: [F.sin(lat * w), F.cos(lat * w), F.sin(lon * w), F.cos(lon * w), *_mixed(lon, lat, w)])


def theory(lon, lat, freqs):
    """Three directions 120 degrees apart at every frequency; sine and cosine alternate anew in the second half."""
    axes = [(1.0, 0.0), (-0.5, math.sqrt(3) / 2), (-0.5, -math.sqrt(3) / 2)]
    half = 3 * len(freqs)
    out = []
    for i in range(2 * half):
        x, y = axes[i % 6 // 2]
        angle = (lon * x + lat * y) * freqs[i // 6]
        out.append(F.sin(angle) if i % half % 2 == 0 else F.cos(angle))
    return out


def _legendre(degree: int, order: int, x: Column) -> Column:
    """The associated Legendre function with the Condon-Shortley phase, by its three-term recurrence in the degree."""
    sine = F.sqrt((1 - x) * (1 + x))
    now = F.lit(1.0)
    for i in range(order):
        now = now * sine * -(2.0 * i + 1)
    before = None
    for n in range(order + 1, degree + 1):
        now, before = (x * now * (2.0 * n - 1) - (0 if before is None else before * (n + order - 1.0))) / (n - order), now
    return now


def spherical_harmonics(phi: Column, theta: Column, degrees: int) -> list[Column]:
    """Real harmonics of degrees below ``degrees``, each by its orders from -degree to degree."""
    out = []
    for n in range(degrees):
        for m in range(-n, n + 1):
            k = abs(m)
            scale = math.sqrt((2 * n + 1) * math.factorial(n - k) / (4 * math.pi * math.factorial(n + k))) * (math.sqrt(2) if m else 1)
            turn = F.lit(1.0) if m == 0 else F.cos(phi * k) if m > 0 else F.sin(phi * k)
            out.append(turn * _legendre(n, k, F.cos(theta)) * scale)
    return out


def harmonics(lon: Column, lat: Column, degrees: int, analytic: bool = False) -> list[Column]:
    """Harmonics at a place; ``analytic`` takes the convention without the alternating sign of odd orders."""
    values = spherical_harmonics(F.radians(lon + 180), F.radians(lat + 90), degrees)
    orders = [m for n in range(degrees) for m in range(-n, n + 1)]
    return [-v if analytic and m % 2 else v for v, m in zip(values, orders, strict=True)]


def discretized(lon: Column, lat: Column, degrees: int) -> list[Column]:
    """Harmonics looked up in a table of 360 by 180 nodes: the nodes below and above a place, both weighted by its
    fraction along the longitude and by what its latitude lacks to the next node."""
    x, y = lon + 180, lat + 90
    fx, fy = x - F.floor(x), y - F.floor(y)
    clamp = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top)).cast("double")

    def table(step):
        return spherical_harmonics(F.radians(clamp(step(x), 359) * (360.0 / 359)), F.radians(clamp(step(y), 179) * (180.0 / 179)), degrees)

    return [a * (1 - fx) * (1 - fy) + b * fx * (1 - fy) for a, b in zip(table(F.floor), table(F.ceil), strict=True)]


def encoder(name: str, **options) -> Callable[[Column, Column], list[Column]]:
    """An encoder by name; options are ``freqs`` or ``degrees`` where it has any."""
    plain = {"direct": direct, "cartesian3d": cartesian3d, "wrap": wrap}
    by_frequency = {"grid": grid, "spherec": spherec, "spherecplus": spherecplus, "spherem": spherem, "spheremplus": spheremplus, "theory": theory}
    by_degree = {"sphericalharmonics": harmonics, "discretized": discretized}
    if name in plain:
        return plain[name]
    if name in by_frequency:
        return lambda lon, lat: by_frequency[name](lon, lat, options["freqs"])
    if name in by_degree:
        return lambda lon, lat: by_degree[name](lon, lat, options["degrees"])
    raise ValueError(f"unknown encoder {name!r}")
