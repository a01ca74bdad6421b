"""Map projections as column expressions: longitude and latitude in degrees to metres, and back.

Equal-area cylindrical and transverse Mercator are those of an ellipsoid, Mollweide that of a sphere. Where no closed form
exists, a fixed number of Newton steps or terms of a series stand in its place, so that plans do not depend on values. Points
outside a projection's outline are null.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid of WGS 84 (half axis and flattening), and the mean radius of the sphere.
AXIS, FLATTENING, RADIUS = 6378137.0, 1 / 298.257223563, 6371007.181
ECC2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(ECC2)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def authalic(sine: Column) -> Column:
    """The area between the equator and a latitude, by its sine."""
    es = F.lit(ECC) * sine
    return F.lit(1 - ECC2) * (sine / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * ECC))


def _q(phi: float) -> float:
    s = math.sin(phi)
    return (1 - ECC2) * (s / (1 - ECC2 * s * s) - math.log((1 - ECC * s) / (1 + ECC * s)) / (2 * ECC))


@dataclass(frozen=True)
class EqualAreaCylindrical:
    """True to scale at ``parallel`` degrees."""

    parallel: float = 30.0

    @property
    def k0(self) -> float:
        s = math.sin(math.radians(self.parallel))
        return math.cos(math.radians(self.parallel)) / math.sqrt(1 - ECC2 * s * s)

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return F.radians(lon) * (AXIS * self.k0), authalic(F.sin(F.radians(lat))) * (AXIS / (2 * self.k0))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        top = _q(math.pi / 2)
        q = y * (2 * self.k0 / AXIS)
        # the series of the authalic latitude starts near enough for one Newton step
        beta = F.asin(_clamped(q / top))
        e2, e4, e6 = ECC2, ECC2**2, ECC2**3
        phi = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)

        def step(phi: Column) -> Column:
            s = F.sin(phi)
            f = 1 - ECC2 * s * s
            near = F.abs(s) < 1 - 1e-12  # at the poles the step has no limit, and phi is right
            return F.when(near, phi + f * f / (2 * F.cos(phi)) * (q - authalic(s)) / (1 - ECC2)).otherwise(phi)

        lon = F.degrees(x / (AXIS * self.k0))
        inside = (F.abs(q) <= top * (1 + 1e-12)) & (F.abs(lon) <= 180.0 + 1e-9)
        return F.when(inside, lon), F.when(inside, F.degrees(step(phi)))


@dataclass(frozen=True)
class Mollweide:
    steps: int = 40

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        want = F.sin(F.radians(lat)) * math.pi

        def step(t: Column, _: Column) -> Column:
            slope = 2 + 2 * F.cos(t)
            return F.when(slope > 1e-13, t - (t + F.sin(t) - want) / slope).otherwise(t)

        # t is twice the auxiliary angle; steps towards a pole only shrink by halves, so that there are many
        t = F.aggregate(F.array_repeat(F.lit(0), self.steps), F.radians(lat) * 2, step)
        return F.radians(lon) * F.cos(t / 2) * (2 * math.sqrt(2) / math.pi * RADIUS), F.sin(t / 2) * (math.sqrt(2) * RADIUS)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        s = y / (math.sqrt(2) * RADIUS)
        t = F.asin(_clamped(s))
        width = F.cos(t) * (2 * math.sqrt(2) * RADIUS)
        lat = F.degrees(F.asin(_clamped((2 * t + F.sin(2 * t)) / math.pi)))
        lon = F.when(width > 1e-9, x * 180.0 / width).otherwise(0.0)
        inside = (F.abs(s) <= 1.0) & (F.abs(x) <= width + 1e-6)
        return F.when(inside, lon), F.when(inside, lat)


@dataclass(frozen=True)
class TransverseMercator:
    """Series to the fourth power of the third flattening; ``zone`` gives the usual zones of six degrees."""

    meridian: float
    scale: float = 0.9996
    easting: float = 500_000.0
    northing: float = 0.0

    @classmethod
    def zone(cls, number: int, south: bool = False) -> TransverseMercator:
        return cls(6.0 * number - 183.0, northing=10_000_000.0 if south else 0.0)

    @property
    def n(self) -> float:
        return FLATTENING / (2 - FLATTENING)

    @property
    def radius(self) -> float:
        n = self.n
        return AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * self.scale

    def _waves(self, terms: list[float], xi: Column, eta: Column, sign: int) -> tuple[Column, Column]:
        a, b = xi, eta
        for j, k in enumerate(terms, 1):
            a = a + sign * k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            b = b + sign * k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return a, b

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n = self.n
        alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
        s, east = F.sin(F.radians(lat)), F.radians(lon - self.meridian)
        atanh = lambda c: F.log((1 + c) / (1 - c)) / 2
        t = F.sinh(F.asinh(F.tan(F.radians(lat))) - ECC * atanh(ECC * s))
        xi, eta = F.atan2(t, F.cos(east)), F.asinh(F.sin(east) / F.hypot(t, F.cos(east)))
        xi, eta = self._waves(alpha, xi, eta, 1)
        return eta * self.radius + self.easting, xi * self.radius + self.northing

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n = self.n
        beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
        delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
        xi, eta = self._waves(beta, (y - self.northing) / self.radius, (x - self.easting) / self.radius, -1)
        chi = F.asin(_clamped(F.sin(xi) / F.cosh(eta)))
        lat = chi
        for j, k in enumerate(delta, 1):
            lat = lat + k * F.sin(2 * j * chi)
        return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + self.meridian, F.degrees(lat)
