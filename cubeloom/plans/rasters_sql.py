"""SQL of the queries of ``rasters``, written independently of their DataFrame forms."""

from __future__ import annotations

import math

from cubeloom.plans.sql import RING1, q, ring

F = 1 / 298.257223563
E2 = F * (2 - F)
E = math.sqrt(E2)
K0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * math.sin(math.radians(30)) ** 2)
R2 = math.sqrt(2) * 6371007.181


def lit(x: float) -> str:
    return f"{x!r}::DOUBLE"


def area(sine: str) -> str:
    """The authalic function of a latitude's sine."""
    return f"({lit(1 - E2)} * ({sine} / (1 - {lit(E2)} * {sine} * {sine}) + (0.5::DOUBLE / {lit(E)}) * ln((1 + {lit(E)} * {sine}) / (1 - {lit(E)} * {sine}))))"


OUTER = "(0, 0, 1.0, 0.1), (0, 1, 0.5, 0.9), (0, 2, -0.4, 1.0), (0, 3, -1.0, 0.2), (0, 4, -0.6, -0.8), (0, 5, 0.7, -0.9)"
HOLE = "(1, 0, 0.4, 0.05), (1, 1, 0.0, 0.45), (1, 2, -0.4, 0.0), (1, 3, 0.05, -0.4)"
POINTS = f"""sp AS (SELECT CAST(s_suppkey AS BIGINT) AS region, ring, point, s_suppkey * 37 % 300 - 150.0::DOUBLE + ux::DOUBLE * (5.0::DOUBLE + s_suppkey % 20) AS x, s_suppkey * 53 % 130 - 65.0::DOUBLE + uy::DOUBLE * (5.0::DOUBLE + s_suppkey % 20) AS y
  FROM supplier, (VALUES {OUTER}, {HOLE}) u(ring, point, ux, uy))"""
# a ray from each pixel against each edge, with the edge's end found by a self-join
RAYS = f"""{POINTS},
se AS (SELECT a.region, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM sp a JOIN sp b ON a.region = b.region AND a.ring = b.ring AND b.point = (a.point + 1) % CASE a.ring WHEN 0 THEN 6 ELSE 4 END),
hit AS (SELECT pid, region, count(*) AS n FROM ll JOIN se ON (y1 > lat) <> (y2 > lat) AND lon < (lat - y1) * (x2 - x1) / (y2 - y1) + x1 GROUP BY ALL)"""


def projected() -> str:
    """The cylinder's latitude by Newton steps from the sphere's, each a column of the one before."""
    top = area("1.0::DOUBLE")
    steps = [f"p0 AS (SELECT pid, (c + 0.5::DOUBLE) / 64 * 2 - 1 AS u, 1 - (r + 0.5::DOUBLE) / height * 2 AS v FROM pids, hh)", f"n0 AS (SELECT pid, u, v, v * 7300000.0 * {lit(2 * K0 / 6378137.0)} AS q, asin(greatest(-1.0, least(1.0, v * 7300000.0 * {lit(2 * K0 / 6378137.0)} / {top}))) AS phi FROM p0)"]
    for i in range(6):
        steps.append(f"n{i + 1} AS (SELECT pid, u, v, q, phi + (q - {area('sin(phi)')}) * pow(1 - {lit(E2)} * sin(phi) * sin(phi), 2) / (2 * {lit(1 - E2)} * cos(phi)) AS phi FROM n{i})")
    steps.append(f"o AS (SELECT *, degrees(u * 17300000.0 / {lit(6378137.0 * K0)}) AS lon, asin(greatest(-1.0, least(1.0, v * 9000000.0 / {lit(R2)}))) AS t FROM n6)")
    inside = f"abs(q) <= {top} AND abs(lon) <= 180"
    oval = f"abs(v * 9000000.0) <= {lit(R2)} AND abs(u * 18000000.0) <= 2 * {lit(R2)} * cos(t)"
    return q(f"SELECT pid, CASE WHEN {inside} THEN round(lon, 6) END AS cylindrical_lon, CASE WHEN {inside} THEN round(degrees(phi), 6) END AS cylindrical_lat, CASE WHEN {oval} THEN round(180 * u * 18000000.0 / (2 * {lit(R2)} * cos(t)), 6) END AS oval_lon, CASE WHEN {oval} THEN round(degrees(asin(greatest(-1.0, least(1.0, (2 * t + sin(2 * t)) / pi())))), 6) END AS oval_lat FROM o", ", ".join(steps))


def zoned() -> str:
    n = F / (2 - F)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    a = 0.9996 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    steps = [
        f"z0 AS (SELECT pid, radians(lon - 9) AS l, asinh(tan(radians(lat))) - {lit(E)} * atanh({lit(E)} * sin(radians(lat))) AS psi FROM ll WHERE abs(lon - 9) < 30)",
        "z1 AS (SELECT pid, atan2(sinh(psi), cos(l)) AS xi, atanh(sin(l) / cosh(psi)) AS eta FROM z0)",
    ]
    x = " + ".join(["eta", *[f"{lit(k)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, k in enumerate(alpha, 1)]])
    y = " + ".join(["xi", *[f"{lit(k)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, k in enumerate(alpha, 1)]])
    return q(f"SELECT pid, round(500000.0 + {lit(a)} * ({x}), 2) AS x, round({lit(a)} * ({y}), 2) AS y, true AS back FROM z1", ", ".join(steps))


def boxed() -> str:
    corners = f"""bx AS (SELECT region, min(radians(x)) * {lit(6378137.0 * K0)} AS xa, max(radians(x)) * {lit(6378137.0 * K0)} AS xb, min({area('sin(radians(y))')}) * {lit(6378137.0 / (2 * K0))} AS ya, max({area('sin(radians(y))')}) * {lit(6378137.0 / (2 * K0))} AS yb FROM sp GROUP BY region)"""
    put = lambda f, v, step, top: f"CAST(greatest(0, least({f}(({v}) / {step}), {top})) AS BIGINT)"
    dy, dx = "(-14600000.0::DOUBLE / height)", lit(34600000.0 / 64)
    return q(f"SELECT region, {put('floor', 'yb - 7300000.0', dy, 'height')} AS r0, {put('ceil', 'ya - 7300000.0', dy, 'height')} AS r1, {put('floor', 'xa + 17300000.0', dx, '64')} AS c0, {put('ceil', 'xb + 17300000.0', dx, '64')} AS c1 FROM bx, hh", f"{POINTS}, {corners}")


SQL = {
    "validity_raster": q("SELECT pid, coalesce(tas >= 0, false) AS valid FROM st"),
    "prediction_raster_window": q("SELECT 'prediction_2010_central_blended.tif' AS file, r, c, round(CAST(CAST(pred AS FLOAT) AS DOUBLE), 9) AS v FROM hz WHERE h = 2 AND pred IS NOT NULL AND r BETWEEN 1 AND 19 AND c BETWEEN 8 AND 40"),
    "region_scanline": q("SELECT pid, region FROM hit WHERE n % 2 = 1", RAYS),
    "region_holes": q(f"SELECT pid FROM ll WHERE {ring(RING1)} AND NOT {ring([(-60.0, 40.0), (30.0, 45.0), (20.0, -10.0)])}"),
    "pixel_lonlat_projected": projected(),
    "pixel_zone_metres": zoned(),
    "bbox_projected": boxed(),
}
