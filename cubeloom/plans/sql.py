"""The registered queries in SQL, written independently of their DataFrame forms."""

from __future__ import annotations

import math

CUBE = """
pix AS (SELECT CAST(l_orderkey // 4 AS BIGINT) AS pid, CAST(1990 + 5 * (year(l_shipdate) - 1995) AS INTEGER) AS yr,
  sum(CAST(round(l_discount * 100) AS BIGINT)) / (10.0::DOUBLE * count(*)) AS hm, sum(CAST(round(l_tax * 100) AS BIGINT)) / (8.0::DOUBLE * count(*)) AS ag,
  sum(CAST(l_quantity AS BIGINT)) / (50.0::DOUBLE * count(*)) AS ti, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / (100.0::DOUBLE * count(*)) AS gdp
  FROM lineitem GROUP BY 1, 2),
pids AS (SELECT DISTINCT pid, pid // 64 AS r, pid % 64 AS c FROM pix),
hh AS (SELECT max(r) + 1 AS height FROM pids),
st AS (SELECT CAST(o_orderkey // 4 AS BIGINT) AS pid, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / (100.0::DOUBLE * count(*)) AS ele,
  sum(CAST(round(c_acctbal * 100) AS BIGINT)) / (100.0::DOUBLE * count(c_acctbal)) AS tas FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1),
years AS (SELECT CAST(unnest([1990, 1995, 2000, 2005, 2010, 2015, 2020]) AS INTEGER) AS yr),
wide AS (SELECT pid, pid // 64 AS r, pid % 64 AS c, max(hm) FILTER (yr = 1990) AS y1990, max(hm) FILTER (yr = 1995) AS y1995, max(hm) FILTER (yr = 2000) AS y2000,
  max(hm) FILTER (yr = 2005) AS y2005, max(hm) FILTER (yr = 2010) AS y2010, max(hm) FILTER (yr = 2015) AS y2015, max(hm) FILTER (yr = 2020) AS y2020 FROM pix GROUP BY pid),
hz AS (SELECT pid, r, c, h, y1990 AS first, y1995 AS prev, y2000 AS last, CASE h WHEN 1 THEN y2005 WHEN 2 THEN y2010 WHEN 3 THEN y2015 ELSE y2020 END AS target,
  y2000 + (y2000 - y1995) * h / 2.0::DOUBLE AS pred FROM wide, (SELECT CAST(unnest([1, 2, 3, 4]) AS INTEGER) AS h)),
sc AS (SELECT *, pred - 0.2::DOUBLE AS lower, pred + 0.2::DOUBLE AS upper FROM hz WHERE first IS NOT NULL AND prev IS NOT NULL AND last IS NOT NULL AND target IS NOT NULL),
ch AS (SELECT *, round(pred - last, 6) AS dp, round(target - last, 6) AS dt FROM sc),
ly AS (SELECT pid, yr, 'hm' AS layer, hm AS v FROM pix UNION ALL SELECT pid, yr, 'ag', ag FROM pix UNION ALL SELECT pid, yr, 'ti', ti FROM pix UNION ALL SELECT pid, yr, 'gdp', gdp FROM pix),
stats AS (SELECT layer, avg(v) AS mean, stddev_pop(v) + 1e-8 AS std FROM ly GROUP BY layer),
ll AS (SELECT pid, r, c, -180.0::DOUBLE + (c + 0.5::DOUBLE) * 5.625::DOUBLE AS lon, 90.0::DOUBLE + (r + 0.5::DOUBLE) * (-180.0::DOUBLE / height) AS lat FROM pids, hh)
"""
EDGES = [-1.0, -0.005, 0.005, 0.02, 0.1, 0.2, 0.4, 0.6, 1.0]
REPORT = [-1.0, -0.05, 0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
RING1 = [(-120.0, 60.0), (40.0, 75.0), (100.0, -20.0), (-30.0, -70.0)]
RING2 = [(50.0, 10.0), (150.0, 10.0), (150.0, 80.0), (50.0, 80.0)]


def q(select: str, ctes: str = "") -> str:
    return f"WITH {CUBE}{', ' + ctes if ctes else ''}\n{select}"


def fix(x: str, n: int = 9) -> str:
    """Rounded, without a negative zero."""
    return f"(round({x}, {n}) + 0.0::DOUBLE)"


def ring(points, x: str = "lon", y: str = "lat") -> str:
    """Odd number of crossed edges."""
    parts = []
    for i, (x1, y1) in enumerate(points):
        x2, y2 = points[(i + 1) % len(points)]
        if y1 != y2:
            parts.append(f"CAST((({y1} > {y}) <> ({y2} > {y})) AND {x} < ({y} - {y1}::DOUBLE) * {x2 - x1}::DOUBLE / {y2 - y1}::DOUBLE + {x1}::DOUBLE AS INTEGER)")
    return "((" + " + ".join(parts) + ") % 2 = 1)"


REGION = f"({ring(RING1)} OR {ring(RING2)})"


def hist(source: str, value: str, keys: str, edges=EDGES) -> str:
    """Counts of every bin of every key; edges joined as a table of intervals."""
    last = len(edges) - 2
    rows = ", ".join(f"({i}, {edges[i]}::DOUBLE, {edges[i + 1]}::DOUBLE)" for i in range(last + 1))
    on = " AND ".join(f"k.{k} = x.{k}" for k in keys.split(", "))
    return f"""SELECT {", ".join("k." + k for k in keys.split(", "))}, CAST(b.bin AS INTEGER) AS bin, count(x.{value}) AS n
FROM (SELECT DISTINCT {keys} FROM {source}) k CROSS JOIN (VALUES {rows}) b(bin, lo, hi)
LEFT JOIN {source} x ON {on} AND x.{value} >= b.lo AND (x.{value} < b.hi OR (b.bin = {last} AND x.{value} = b.hi)) GROUP BY ALL"""


def props(source: str, keys: str) -> str:
    return f"SELECT {keys}, bin, CASE WHEN sum(n) OVER w = 0 THEN 1.0::DOUBLE / count(*) OVER w ELSE n / sum(n) OVER w END AS p FROM {source} WINDOW w AS (PARTITION BY {keys})"


CHIPPED = "cc AS (SELECT ch.*, r // 16 AS ci, c // 16 AS cj FROM ch, hh WHERE r < (height // 16) * 16)"
K3 = "ci, cj, h"
RATIO = """ratio AS (SELECT r // 16 AS ci, c // 16 AS cj, round(count(*) FILTER (tas >= 0) / 256.0::DOUBLE, 9) AS ratio FROM pids LEFT JOIN st USING (pid), hh WHERE r < (height // 16) * 16 GROUP BY 1, 2),
kept AS (SELECT * FROM ratio WHERE ratio >= 0.2),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5(ci || '_' || cj), ci, cj) AS p, count(*) OVER () AS n FROM kept),
split AS (SELECT ci, cj, CAST(CASE WHEN p <= floor(n * 0.7::DOUBLE) THEN 1 WHEN p <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 2 WHEN p <= floor(n * 0.7::DOUBLE) + 2 * floor(n * 0.1::DOUBLE) THEN 3 ELSE 4 END AS INTEGER) AS split FROM ranked)"""
SLIDE = "slide AS (SELECT a.v AS r0, b.v AS c0 FROM hh, (SELECT unnest(range(0, 100000, 4)) AS v) a, (SELECT unnest(range(0, 49, 4)) AS v) b WHERE a.v <= height - 16)"


def tiled(source: str, size: int, stride: int, name: str = "tl") -> str:
    """Pixels in every tile that covers them, by comparing with all tiles' bounds."""
    return f"""{name} AS (SELECT x.*, a.v AS ti, b.v AS tj FROM {source} x JOIN (SELECT unnest(range(0, 100000, {stride})) AS v) a ON x.r >= a.v AND x.r < a.v + {size}
JOIN (SELECT unnest(range(0, 64, {stride})) AS v) b ON x.c >= b.v AND x.c < b.v + {size})"""


IMAGES = """em AS (SELECT vec_id AS tile, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings),
a0 AS (SELECT tile, pos // 8 AS r, pos % 8 AS c, CAST(v AS DOUBLE) AS v FROM em),
im AS (SELECT x.tile, x.r, x.c, x.v AS p, y.v AS t FROM a0 x JOIN a0 y ON y.tile = x.tile + 1 AND x.r = y.r AND x.c = y.c)"""


def kernel(size: int, sigma: float) -> str:
    g = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    return ", ".join(f"({i - size // 2}, {x / sum(g)!r}::DOUBLE)" for i, x in enumerate(g))


def blurred(source: str, columns: list[str], tile: str, size: int = 5, sigma: float = 1.0) -> str:
    """Two-dimensional convolution by a join of cells with shifted cells; zeros outside contribute nothing."""
    k = kernel(size, sigma)
    sums = ", ".join(f"sum(y.{c} * ka.w * kb.w) AS {c}" for c in columns)
    on = " AND ".join(f"x.{t} = y.{t}" for t in tile.split(", "))
    return f"SELECT {', '.join('x.' + t for t in tile.split(', '))}, x.r, x.c, {sums} FROM {source} x CROSS JOIN (VALUES {k}) ka(d, w) CROSS JOIN (VALUES {k}) kb(d, w) JOIN {source} y ON {on} AND y.r = x.r + ka.d AND y.c = x.c + kb.d GROUP BY ALL"


def halved(source: str, columns: list[str], tile: str) -> str:
    return f"SELECT {tile}, r // 2 AS r, c // 2 AS c, {', '.join(f'avg({c}) AS {c}' for c in columns)} FROM {source} GROUP BY ALL"


def enlarged(source: str, columns: list[str], tile: str, size: int, to: int) -> str:
    """Bilinear: the four cells around each target's place."""
    axis = f"SELECT i, CAST(floor(g) AS BIGINT) AS lo, least(CAST(floor(g) AS BIGINT) + 1, {size - 1}) AS hi, g - floor(g) AS f FROM (SELECT i, greatest(0.0::DOUBLE, (i + 0.5::DOUBLE) * {size / to!r}::DOUBLE - 0.5::DOUBLE) AS g FROM (SELECT unnest(range({to})) AS i))"
    on = lambda s, r, c: f"{s}.r = a.{r} AND {s}.c = b.{c} AND " + " AND ".join(f"{s}.{t} = k.{t}" for t in tile.split(", "))
    vals = ", ".join(f"(s1.{c} * (1 - b.f) + s2.{c} * b.f) * (1 - a.f) + (s3.{c} * (1 - b.f) + s4.{c} * b.f) * a.f AS {c}" for c in columns)
    return f"SELECT {', '.join('k.' + t for t in tile.split(', '))}, a.i AS r, b.i AS c, {vals} FROM (SELECT DISTINCT {tile} FROM {source}) k CROSS JOIN ({axis}) a CROSS JOIN ({axis}) b JOIN {source} s1 ON {on('s1', 'lo', 'lo')} JOIN {source} s2 ON {on('s2', 'lo', 'hi')} JOIN {source} s3 ON {on('s3', 'hi', 'lo')} JOIN {source} s4 ON {on('s4', 'hi', 'hi')}"


DENSE = """cells AS (SELECT a.v AS ci, b.v AS cj, i.v AS r, j.v AS c FROM hh, (SELECT unnest(range(0, 100000)) AS v) a, (SELECT unnest(range(4)) AS v) b, (SELECT unnest(range(16)) AS v) i, (SELECT unnest(range(16)) AS v) j WHERE a.v < height // 16),
dense AS (SELECT cells.*, y2020 IS NOT NULL AS m, coalesce(y2020, 0) AS t, coalesce(y2015, 0) AS p FROM cells LEFT JOIN wide ON wide.r = ci * 16 + cells.r AND wide.c = cj * 16 + cells.c)"""

SCORES = "round(avg(abs(pred - target)), 9)"
FREQ = [1.0 / math.exp(k * math.log(360.0) / 3) for k in range(4)]


def encoded(values: list[str], digits: int = 8) -> str:
    """One row a value; coordinates as the query rounds them."""
    return q(f"SELECT pid, CAST(unnest(range({len(values)})) AS INTEGER) AS k, unnest([{', '.join(fix(v, digits) for v in values)}]) AS v FROM (SELECT pid, round(lon, 9) AS lon, round(lat, 9) AS lat FROM ll)")


RA, RB = "radians(lon)", "radians(lat)"


def twice(terms) -> list[str]:
    out = []
    for f in FREQ:
        lo, la = f"(lon * {f!r}::DOUBLE)", f"(lat * {f!r}::DOUBLE)"
        for t in terms(lo, la):
            out += [t, t]
    return out


def sphere_m(lo: str, la: str) -> list[str]:
    return [f"cos({la}) * cos(lon)", f"cos(lat) * cos({lo})", f"cos({la}) * sin(lon)", f"cos(lat) * sin({lo})"]


def theory() -> list[str]:
    s = math.sqrt(3) / 2
    dots = ["lon", f"(lon * -0.5::DOUBLE + lat * {s!r}::DOUBLE)", f"(lon * -0.5::DOUBLE + lat * {-s!r}::DOUBLE)"]
    return [f"{'sin' if k % 2 == 0 else 'cos'}({dots[k // 2]} * {f!r}::DOUBLE)" for f in FREQ for k in range(6)]


def sh(phi: str, theta: str, degrees: int) -> list[str]:
    """Harmonics from written-out Legendre functions (with the Condon-Shortley phase)."""
    x, s = f"cos({theta})", f"sqrt((1 - cos({theta})) * (1 + cos({theta})))"
    poly = {
        (0, 0): "1.0::DOUBLE", (1, 0): x, (1, 1): f"-{s}", (2, 0): f"(3 * {x} * {x} - 1) / 2.0::DOUBLE", (2, 1): f"-3 * {x} * {s}", (2, 2): f"3 * {s} * {s}",
        (3, 0): f"(5 * {x} * {x} * {x} - 3 * {x}) / 2.0::DOUBLE", (3, 1): f"-1.5::DOUBLE * (5 * {x} * {x} - 1) * {s}", (3, 2): f"15 * {x} * {s} * {s}", (3, 3): f"-15 * {s} * {s} * {s}",
    }
    out = []
    for n in range(degrees):
        for m in range(-n, n + 1):
            k = abs(m)
            scale = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k)) * (math.sqrt(2) if m else 1)
            turn = "1" if m == 0 else f"cos({k} * {phi})" if m > 0 else f"sin({k} * {phi})"
            out.append(f"{scale!r}::DOUBLE * {turn} * ({poly[n, k]})")
    return out


def sh_table(degrees: int) -> list[str]:
    def node(step):
        i = f"least(greatest({step}(lon + 180), 0), 359)"
        j = f"least(greatest({step}(lat + 90), 0), 179)"
        return sh(f"radians({i} * {360.0 / 359!r}::DOUBLE)", f"radians({j} * {180.0 / 179!r}::DOUBLE)", degrees)

    fx, fy = "(lon + 180 - floor(lon + 180))", "(lat + 90 - floor(lat + 90))"
    return [f"({a}) * (1 - {fx}) * (1 - {fy}) + ({b}) * {fx} * (1 - {fy})" for a, b in zip(node("floor"), node("ceil"), strict=True)]


SH = sh("radians(lon + 180)", "radians(lat + 90)", 4)
ORDERS = [m for n in range(4) for m in range(-n, n + 1)]
W2 = f"""{CHIPPED}, ho AS ({hist("cc", "dt", K3)}), hp AS ({hist("cc", "dp", K3)}), po AS ({props("ho", K3)}), pp AS ({props("hp", K3)}),
ha AS ({hist("ch", "dt", "h")}), ra AS (SELECT h, bin, (1 / (n + 0.001::DOUBLE)) * 8 / sum(1 / (n + 0.001::DOUBLE)) OVER (PARTITION BY h) AS weight FROM ha),
cd AS (SELECT po.ci, po.cj, po.h, po.bin, sum(po.p - pp.p) OVER (PARTITION BY po.ci, po.cj, po.h ORDER BY po.bin) AS d FROM po JOIN pp USING (ci, cj, h, bin)),
w2c AS (SELECT ci, cj, h, sum(d * d * [0.5025, 0.0125, 0.0475, 0.09, 0.15, 0.2, 0.3, 0.3][bin + 1] * weight) AS w2 FROM cd JOIN ra USING (h, bin) GROUP BY ALL),
w2 AS (SELECT h, round(avg(w2), 8) AS w2 FROM w2c GROUP BY h)"""
LOSS = """loss AS (SELECT h, avg((pred - target) * (pred - target)) AS mse, avg(abs(pred - target)) AS mae,
avg(CASE WHEN target >= lower THEN 0.025::DOUBLE * (target - lower) ELSE -0.975::DOUBLE * (target - lower) END) AS pin_l,
avg(CASE WHEN target >= upper THEN 0.975::DOUBLE * (target - upper) ELSE -0.025::DOUBLE * (target - upper) END) AS pin_u FROM sc GROUP BY h)"""
SPATIAL = f"""dk AS (SELECT DISTINCT h, ci, cj FROM cc),
dn AS (SELECT dk.h, dk.ci, dk.cj, a.v AS r, b.v AS c, coalesce(x.pred, 0) AS p, coalesce(x.target, 0) AS t, x.pid IS NOT NULL AS m FROM dk CROSS JOIN (SELECT unnest(range(16)) AS v) a CROSS JOIN (SELECT unnest(range(16)) AS v) b
  LEFT JOIN cc x ON x.h = dk.h AND x.ci = dk.ci AND x.cj = dk.cj AND x.r % 16 = a.v AND x.c % 16 = b.v),
mo AS (SELECT h, ci, cj, r, c, p, t, p * p AS pp, t * t AS tt, p * t AS pt FROM dn), sb AS ({blurred("mo", ["p", "t", "pp", "tt", "pt"], "h, ci, cj", 11, 1.5)}),
ss AS (SELECT h, ci, cj, avg((2 * p * t + 0.0001::DOUBLE) * (2 * (pt - p * t) + 0.0009::DOUBLE) / ((p * p + t * t + 0.0001::DOUBLE) * (pp - p * p + tt - t * t + 0.0009::DOUBLE))) AS ssim FROM sb WHERE r BETWEEN 5 AND 10 AND c BETWEEN 5 AND 10 GROUP BY ALL),
sl AS (SELECT h, 1 - avg(ssim) AS ssim FROM ss GROUP BY h),
g1b AS ({blurred("dn", ["p", "t"], "h, ci, cj")}), g1 AS ({halved("g1b", ["p", "t"], "h, ci, cj")}), g2b AS ({blurred("g1", ["p", "t"], "h, ci, cj")}), g2 AS ({halved("g2b", ["p", "t"], "h, ci, cj")}),
u0 AS ({enlarged("g1", ["p", "t"], "h, ci, cj", 8, 16)}), u1 AS ({enlarged("g2", ["p", "t"], "h, ci, cj", 4, 8)}),
m1 AS (SELECT h, ci, cj, r // 2 AS r, c // 2 AS c, count(*) FILTER (m) >= 3 AS m FROM dn GROUP BY ALL), m2 AS (SELECT h, ci, cj, r // 2 AS r, c // 2 AS c, count(*) FILTER (m) >= 3 AS m FROM m1 GROUP BY ALL),
lv AS (SELECT h, avg(abs(dn.p - u0.p - (dn.t - u0.t))) FILTER (m) AS x FROM dn JOIN u0 USING (h, ci, cj, r, c) GROUP BY h UNION ALL
SELECT h, avg(abs(g1.p - u1.p - (g1.t - u1.t))) FILTER (m) FROM g1 JOIN u1 USING (h, ci, cj, r, c) JOIN m1 USING (h, ci, cj, r, c) GROUP BY h UNION ALL SELECT h, avg(abs(p - t)) FILTER (m) FROM g2 JOIN m2 USING (h, ci, cj, r, c) GROUP BY h),
lp AS (SELECT h, sum(coalesce(x, 0)) / 3 AS lap FROM lv GROUP BY h)"""
LOGITS = "lg AS (SELECT vec_id, CAST(label AS INTEGER) AS label, [CAST(v AS DOUBLE) FOR v IN embedding[1:10]] AS z FROM embeddings WHERE label IS NOT NULL)"
BLEND = f"""{tiled("wide", 8, 4, "t0")}, tl AS (SELECT d.ti, d.tj, i.v AS r, j.v AS c FROM (SELECT DISTINCT ti, tj FROM t0) d, (SELECT unnest(range(8)) AS v) i, (SELECT unnest(range(8)) AS v) j),
tm AS (SELECT tl.*, pid, y2020, y1990 IS NOT NULL AND y2020 IS NOT NULL AS m FROM tl LEFT JOIN wide ON wide.r = ti + tl.r AND wide.c = tj + tl.c),
ew AS (SELECT d.ti, d.tj, d.r, d.c, any_value(d.pid) AS pid, any_value(d.y2020) AS y2020, CASE WHEN any_value(d.m) THEN min(sqrt(((d.r - e.r) ** 2 + (d.c - e.c) ** 2)::DOUBLE)) ELSE 0.0::DOUBLE END AS w
  FROM tm d JOIN tm e ON d.ti = e.ti AND d.tj = e.tj AND (NOT e.m OR e.r IN (0, 7) OR e.c IN (0, 7)) WHERE d.pid IS NOT NULL GROUP BY d.ti, d.tj, d.r, d.c)"""

SQL = {
    "validity_mask": q("SELECT pid, coalesce(tas >= 0, false) AS valid FROM st"),
    "validity_summary": q("SELECT count(*) AS total, count(*) FILTER (tas >= 0) AS n_valid, round(100.0::DOUBLE * count(*) FILTER (tas >= 0) / count(*), 9) AS percent FROM st"),
    "zscore_normalize": q(f"SELECT layer, yr, pid, {fix('(v - mean) / std', 6)} AS z FROM ly JOIN stats USING (layer)"),
    "denormalize_clip": q(f"SELECT pid, h, {fix('greatest(0.0, least(1.0, (pred - mean) / std * std + mean))')} AS v FROM sc, (SELECT * FROM stats WHERE layer = 'hm')"),
    "impute_zero_components": q("SELECT yr, round(avg(coalesce(ag, 0)), 9) AS ag, round(avg(coalesce(ti, 0)), 9) AS ti, round(avg(coalesce(gdp, 0)), 9) AS gdp FROM pids CROSS JOIN years LEFT JOIN pix USING (pid, yr) GROUP BY yr"),
    "impute_zero_static": q("SELECT pid, 'ele' AS layer, round(coalesce(CASE WHEN ele > 100000 THEN ele END, 0), 9) AS v FROM pids LEFT JOIN st USING (pid) UNION ALL SELECT pid, 'tas', round(CASE WHEN tas > 0 THEN tas END, 9) FROM pids LEFT JOIN st USING (pid)"),
    "mean_impute": q(f"SELECT pid, yr, {fix('coalesce((hm - mean) / std, 0)', 6)} AS z FROM pids CROSS JOIN years LEFT JOIN pix USING (pid, yr), (SELECT * FROM stats WHERE layer = 'hm')"),
    "pixel_validity": q("SELECT pid, y1990 IS NOT NULL AND y1995 IS NOT NULL AND y2000 IS NOT NULL AS dynamic_valid, ele IS NOT NULL AND tas IS NOT NULL AS static_valid FROM wide LEFT JOIN st USING (pid)"),
    "validation_mask": q("SELECT pid, " + ", ".join(f"ok AND y{y} IS NOT NULL AS mask_{y}" for y in (2005, 2010, 2015, 2020)) + " FROM (SELECT *, y2020 IS NOT NULL AND y1990 IS NOT NULL AND y1995 IS NOT NULL AND y2000 IS NOT NULL AND ele IS NOT NULL AND tas IS NOT NULL AS ok FROM wide LEFT JOIN st USING (pid))"),
    "prediction_mask": q(f"SELECT pid, {REGION} AND y2010 IS NOT NULL AND y2015 IS NOT NULL AND y2020 IS NOT NULL AND ele IS NOT NULL AS mask FROM wide JOIN (SELECT pid, lon, lat FROM ll) USING (pid) LEFT JOIN st USING (pid)"),
    "masked_prediction": q(f"SELECT pid, h, CASE WHEN ok THEN {fix('pred')} END AS masked, CASE WHEN ok THEN {fix('pred')} ELSE 0.0::DOUBLE END AS zeroed FROM (SELECT *, first IS NOT NULL AND prev IS NOT NULL AND last IS NOT NULL AND target IS NOT NULL AS ok FROM hz)"),
    "change_delta": q(f"SELECT pid, h, {fix('pred - last')} AS pred_delta, {fix('target - last')} AS target_delta FROM sc"),
    "delta_range_filter": q("SELECT pid, h, dp + 0.0::DOUBLE AS pred_delta, dt + 0.0::DOUBLE AS target_delta FROM ch WHERE dp BETWEEN -0.01 AND 0.2 AND dt BETWEEN -0.01 AND 0.2"),
    "abs_error": q("SELECT pid, h, round(abs(pred - target), 9) AS error FROM sc"),
    "interval_width": q("SELECT pid, h, round(upper - lower, 9) AS width FROM sc"),
    "pixel_lonlat": q(f"SELECT pid, {fix('lon')} AS lon, {fix('lat')} AS lat FROM ll"),
    "bbox_to_rowcol": q("""SELECT least(greatest(CAST(floor(least(a, b)) AS BIGINT), 0), height) AS r0, least(greatest(CAST(ceil(greatest(a, b)) AS BIGINT), 0), height) AS r1,
      CAST(floor(60.0 / 5.625) AS BIGINT) AS c0, CAST(ceil(330.0 / 5.625) AS BIGINT) AS c1 FROM (SELECT height, (-70.0::DOUBLE - 90) / (-180.0::DOUBLE / height) AS a, (80.0::DOUBLE - 90) / (-180.0::DOUBLE / height) AS b FROM hh)"""),
    "nonempty_chips": q("SELECT r // 16 AS ci, c // 16 AS cj, count(y2020) AS n FROM wide, hh WHERE r < (height // 16) * 16 GROUP BY 1, 2 HAVING count(y2020) > 0"),
    "channel_unpivot": q(f"SELECT pid, h - 1 AS horizon, 0 AS quantile, {fix('lower')} AS v FROM sc UNION ALL SELECT pid, h - 1, 1, {fix('pred')} FROM sc UNION ALL SELECT pid, h - 1, 2, {fix('upper')} FROM sc"),
    "layer_name_parse": "SELECT p_partkey, replace(lower(p_type), ' ', '-') AS layer FROM part",
    "stack_layers": q("SELECT pid, " + ", ".join(f"round(max({x}) FILTER (yr = {y}), 9) AS {x}_{y}" for y in (1990, 1995, 2000) for x in ("hm", "ag", "ti", "gdp")) + " FROM pix GROUP BY pid"),
    "temporal_offset_join": q("""SELECT a.pid, CAST(e.y AS INTEGER) AS end_year, round(a.hm, 9) AS in0, round(b.hm, 9) AS in1, round(c.hm, 9) AS in2, round(t1.hm, 9) AS t5, round(t2.hm, 9) AS t10, round(t3.hm, 9) AS t15, round(t4.hm, 9) AS t20
      FROM (SELECT unnest([2000, 2005, 2010, 2015]) AS y) e JOIN pix a ON a.yr = e.y - 10 JOIN pix b ON b.pid = a.pid AND b.yr = e.y - 5 JOIN pix c ON c.pid = a.pid AND c.yr = e.y
      LEFT JOIN pix t1 ON t1.pid = a.pid AND t1.yr = e.y + 5 LEFT JOIN pix t2 ON t2.pid = a.pid AND t2.yr = e.y + 10 LEFT JOIN pix t3 ON t3.pid = a.pid AND t3.yr = e.y + 15 LEFT JOIN pix t4 ON t4.pid = a.pid AND t4.yr = e.y + 20"""),
    "temporal_sampling_targets": q("""SELECT CAST(e.y AS INTEGER) AS end_year, count(*) AS n, count(t1.hm) AS n5, count(t2.hm) AS n10, count(t3.hm) AS n15, count(t4.hm) AS n20
      FROM (SELECT unnest([2000, 2005, 2010, 2015]) AS y) e JOIN pix a ON a.yr = e.y - 10 JOIN pix b ON b.pid = a.pid AND b.yr = e.y - 5 JOIN pix c ON c.pid = a.pid AND c.yr = e.y
      LEFT JOIN pix t1 ON t1.pid = a.pid AND t1.yr = e.y + 5 LEFT JOIN pix t2 ON t2.pid = a.pid AND t2.yr = e.y + 10 LEFT JOIN pix t3 ON t3.pid = a.pid AND t3.yr = e.y + 15 LEFT JOIN pix t4 ON t4.pid = a.pid AND t4.yr = e.y + 20 GROUP BY 1"""),
    "static_repeat": q("SELECT pid, yr, round(ele, 9) AS ele, round(tas, 9) AS tas FROM st, years WHERE yr <= 2000"),
    "pixel_in_polygon": q(f"SELECT pid FROM ll WHERE {ring(RING1)}"),
    "region_union": q(f"SELECT pid FROM ll WHERE {ring(RING1)} UNION SELECT pid FROM ll WHERE {ring(RING2)}"),
    "tile_semi_join": q(f"SELECT DISTINCT r // 8 * 8 AS ti, c // 8 * 8 AS tj FROM ll WHERE {REGION}"),
    "tile_anti_join": q(f"SELECT DISTINCT r // 8 * 8 AS ti, c // 8 * 8 AS tj FROM ll EXCEPT SELECT r // 8 * 8, c // 8 * 8 FROM ll WHERE {REGION}"),
    "pixel_tile_explode": q("SELECT ti, tj, count(*) AS n, CAST(sum(pid) AS BIGINT) AS pids FROM tl GROUP BY ti, tj", tiled("pids", 8, 4)),
    "tile_grid": q("""SELECT t.v AS ti, u.v AS tj, least(8, r1 - t.v) AS h, least(8, c1 - u.v) AS w FROM b, (SELECT unnest(range(0, 100000)) AS v) t, (SELECT unnest(range(0, 64)) AS v) u
      WHERE t.v >= r0 AND t.v < r1 AND (t.v - r0) % 4 = 0 AND u.v >= c0 AND u.v < c1 AND (u.v - c0) % 4 = 0""", """b AS (SELECT greatest(CAST(floor((80.0::DOUBLE - 90) / (-180.0::DOUBLE / height)) AS BIGINT), 0) AS r0,
      least(CAST(ceil((-70.0::DOUBLE - 90) / (-180.0::DOUBLE / height)) AS BIGINT), height) AS r1, CAST(10 AS BIGINT) AS c0, CAST(59 AS BIGINT) AS c1 FROM hh)"""),
    "tile_pad": q("""SELECT ti, tj, CAST(a.v AS INTEGER) AS i, CAST(b.v AS INTEGER) AS j, round(coalesce(y2020, 0), 9) AS v FROM (SELECT DISTINCT r // 8 * 8 AS ti, c // 8 * 8 AS tj FROM wide WHERE y2020 IS NOT NULL)
      CROSS JOIN (SELECT unnest(range(8)) AS v) a CROSS JOIN (SELECT unnest(range(8)) AS v) b LEFT JOIN wide ON r = ti + a.v AND c = tj + b.v"""),
    "sweep_grid": "SELECT * FROM (SELECT CAST(unnest([16, 32, 64]) AS INTEGER) AS hidden), (SELECT CAST(unnest([1, 2]) AS INTEGER) AS layers), (SELECT unnest([0.0001::DOUBLE, 0.001::DOUBLE]) AS lr), (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS w_ssim)",
    "logit_fusion": f"SELECT vec_id, CAST(k AS INTEGER) AS k, {fix('CAST(embedding[k + 1] AS DOUBLE) + CAST(embedding[k + 11] AS DOUBLE)')} AS v FROM embeddings, (SELECT unnest(range(10)) AS k)",
    "chip_valid_ratio": q("SELECT * FROM kept", RATIO),
    "chip_grid": q("SELECT a.v AS ci, b.v AS cj, a.v * 16 AS r0, b.v * 16 AS c0 FROM hh, (SELECT unnest(range(0, 100000)) AS v) a, (SELECT unnest(range(4)) AS v) b WHERE (a.v + 1) * 16 <= height"),
    "sliding_chips": q("SELECT r0, c0, 2020 AS yr FROM slide", SLIDE),
    "spatial_split_assign": q("SELECT ci, cj, split FROM split", RATIO),
    "split_pixel_counts": q("SELECT split, count(*) * 256 AS pixels, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 9) AS percent FROM split GROUP BY split", RATIO),
    "split_semi_join": q("SELECT r0, c0 FROM slide WHERE EXISTS (SELECT 1 FROM split WHERE split = 1 AND r0 < ci * 16 + 16 AND r0 + 16 > ci * 16 AND c0 < cj * 16 + 16 AND c0 + 16 > cj * 16)", f"{RATIO}, {SLIDE}"),
    "split_chip_jitter": q("""SELECT ci, cj, split, greatest(0, least(ci * 16 + CAST('0x' || substr(md5('r_' || ci || '_' || cj), 1, 6) AS BIGINT) % 8 - 4, height - 16)) AS r0,
      greatest(0, least(cj * 16 + CAST('0x' || substr(md5('c_' || ci || '_' || cj), 1, 6) AS BIGINT) % 8 - 4, 48)) AS c0 FROM split, hh""", RATIO),
    "latitude_band_counts": q("SELECT CAST(r // nullif(height // 20, 0) AS INTEGER) AS band, split, count(*) AS n FROM pids, hh, split WHERE ci = r // 16 AND cj = c // 16 AND r // nullif(height // 20, 0) < 20 GROUP BY 1, 2", RATIO),
    "hm_stats": q("SELECT round(avg(hm), 9) AS mean, round(stddev_pop(hm) + 1e-8, 9) AS std FROM pix"),
    "layer_stats": q("SELECT layer, round(mean, 6) AS mean, round(std, 6) AS std FROM stats"),
    "fallback_stats": q("SELECT coalesce(avg(hm), 0.0::DOUBLE) AS mean, coalesce(stddev_pop(hm), 1.0::DOUBLE) AS std FROM pix WHERE yr > 2020"),
    "change_histogram": q(hist("cc", "dt", K3), CHIPPED),
    "histogram_proportions": q(f"SELECT {K3}, bin, round(p, 9) AS p FROM pr", f"{CHIPPED}, ho AS ({hist('cc', 'dt', K3)}), pr AS ({props('ho', K3)})"),
    "histogram_cdf": q(f"SELECT a.ci, a.cj, a.h, a.bin, round(sum(b.p), 9) AS cdf FROM pr a JOIN pr b ON a.ci = b.ci AND a.cj = b.cj AND a.h = b.h AND b.bin <= a.bin GROUP BY ALL", f"{CHIPPED}, ho AS ({hist('cc', 'dt', K3)}), pr AS ({props('ho', K3)})"),
    "change_histogram_report": q(hist("ch", "dt", "h", REPORT)),
    "rarity_weights": q("SELECT h, bin, round((1 / (n + 0.001::DOUBLE)) * 8 / sum(1 / (n + 0.001::DOUBLE)) OVER (PARTITION BY h), 9) AS weight FROM ha", f"ha AS ({hist('ch', 'dt', 'h')})"),
    "wasserstein_histogram": q("SELECT h, w2 FROM w2", W2),
    "masked_mse": q("SELECT h, round(avg((pred - last - (target - last)) * (pred - last - (target - last))), 9) AS mse FROM sc GROUP BY h"),
    "masked_mae": q(f"SELECT h, {SCORES} AS mae FROM sc GROUP BY h"),
    "pinball_loss": q('SELECT h, round(pin_l, 9) AS "lower", round(pin_u, 9) AS "upper" FROM loss', LOSS),
    "interval_coverage": q("SELECT h, round(100.0::DOUBLE * count(*) FILTER (round(target, 6) BETWEEN round(lower, 6) AND round(upper, 6)) / count(*), 9) AS coverage, count(*) AS n FROM sc GROUP BY h"),
    "macro_average_losses": q("SELECT round(sum(mse) / 4, 9) AS mse, round(sum(mae) / 4, 9) AS mae, round(sum(pin_l) / 4, 9) AS pin_l, round(sum(pin_u) / 4, 9) AS pin_u FROM loss", LOSS),
    "composite_loss": q("SELECT h, round(mse + pin_l + pin_u + 2 * ssim + lap + 0.67::DOUBLE * w2, 7) AS total FROM loss JOIN w2 USING (h) JOIN sl USING (h) JOIN lp USING (h)", f"{LOSS}, {W2}, {SPATIAL}"),
    "full_val_metrics": q("""SELECT h, count(*) AS n, round(avg((pred - target) ** 2), 9) AS mse, round(avg(abs(pred - target)), 9) AS mae, round(avg(abs(last - target)), 9) AS mae_no_change,
      round(avg((last - target) ** 2), 9) AS mse_no_change, round(avg(abs(last + (last - prev) * h - target)), 9) AS mae_linear FROM sc GROUP BY h"""),
    "baseline_no_change": q("SELECT 2000 + 5 * h AS target_year, count(*) AS n, round(avg(abs(last - target)), 9) AS mae_no_change FROM sc GROUP BY h"),
    "baseline_linear": q("SELECT 2000 + 5 * h AS target_year, count(*) AS n, round(avg(abs(last - target)), 9) AS mae_no_change, round(avg(abs(last + (last - prev) * h - target)), 9) AS mae_linear FROM sc GROUP BY h"),
    "pixel_weighted_metric": q("SELECT h, round(sum(w2 * n) / sum(n), 8) AS w2 FROM w2c JOIN (SELECT ci, cj, h, count(*) AS n FROM cc GROUP BY ALL) USING (ci, cj, h) GROUP BY h", W2),
    "sweep_objective": q("SELECT round(avg(mse + 2 * ssim + lap + 0.67::DOUBLE * w2), 7) AS objective FROM loss JOIN w2 USING (h) JOIN sl USING (h) JOIN lp USING (h)", f"{LOSS}, {W2}, {SPATIAL}"),
    "hexbin_density": q("""SELECT CAST(CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END AS BIGINT) AS hr, count(*) AS n
      FROM (SELECT *, round(abs(rq - q), 6) AS dq, round(abs(rr - r), 6) AS dr, round(abs(rs + q + r), 6) AS ds FROM (SELECT *, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM (
      SELECT round((dt * (sqrt(3.0::DOUBLE) / 3) - dp / 3.0::DOUBLE) / (0.21::DOUBLE / 80), 6) AS q, round(dp * (2.0::DOUBLE / 3.0::DOUBLE) / (0.21::DOUBLE / 80), 6) AS r FROM ch WHERE dp BETWEEN -0.01 AND 0.2 AND dt BETWEEN -0.01 AND 0.2))) GROUP BY 1, 2"""),
    "best_checkpoint": "SELECT o_custkey AS best, round(loss, 6) AS loss FROM (SELECT o_custkey, min(o_totalprice) AS loss FROM orders GROUP BY o_custkey) ORDER BY loss, o_custkey LIMIT 1",
    "classification_metrics": q("SELECT (SELECT round(avg(CAST(label = guess AS INTEGER)), 9) FROM g) AS accuracy, (SELECT round(avg(j), 9) FROM (SELECT k, count(*) FILTER (label = k AND guess = k) / count(*)::DOUBLE AS j FROM g, (SELECT label AS k FROM g UNION SELECT guess FROM g) WHERE label = k OR guess = k GROUP BY k)) AS jaccard",
      f"{LOGITS}, g AS (SELECT label, list_position(z, list_max(z)) - 1 AS guess FROM lg)"),
    "topk_accuracy": q("SELECT round(avg(CAST(above < 1 AS INTEGER)), 9) AS top1, round(avg(CAST(above < 3 AS INTEGER)), 9) AS top3 FROM (SELECT len([v FOR v IN z IF v > z[label + 1]]) AS above FROM lg)", LOGITS),
    "cross_entropy": q("SELECT round(avg(ln(list_sum([exp(v) FOR v IN z])) - z[label + 1]), 9) AS loss FROM lg", LOGITS),
    "linear_head": f"SELECT vec_id, {fix('0.5::DOUBLE + sum(CAST(v AS DOUBLE) * (i % 7 - 3) / 10.0::DOUBLE)')} AS y FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM embeddings) GROUP BY vec_id",
    "gaussian_blur": f"WITH {IMAGES}, i1 AS (SELECT tile, r, c, v AS p FROM a0), b AS ({blurred('i1', ['p'], 'tile')}) SELECT tile, r, c, {fix('p')} AS p FROM b",
    "downsample2x": f"WITH {IMAGES}, i1 AS (SELECT tile, r, c, v AS p FROM a0), b AS ({halved('i1', ['p'], 'tile')}) SELECT tile, r, c, {fix('p')} AS p FROM b",
    "upsample_bilinear": f"WITH {IMAGES}, i1 AS (SELECT tile, r, c, v AS p FROM a0), b AS ({halved('i1', ['p'], 'tile')}), u AS ({enlarged('b', ['p'], 'tile', 4, 8)}) SELECT tile, r, c, {fix('p')} AS p FROM u",
    "mask_downsample": f"WITH {IMAGES} SELECT tile, r // 2 AS r, c // 2 AS c, count(*) FILTER (p > 0) >= 3 AS m FROM im GROUP BY ALL",
    "laplacian_pyramid": f"""WITH {IMAGES}, g1b AS ({blurred('im', ['p', 't'], 'tile')}), g1 AS ({halved('g1b', ['p', 't'], 'tile')}), g2b AS ({blurred('g1', ['p', 't'], 'tile')}), g2 AS ({halved('g2b', ['p', 't'], 'tile')}),
      u0 AS ({enlarged('g1', ['p', 't'], 'tile', 4, 8)}), u1 AS ({enlarged('g2', ['p', 't'], 'tile', 2, 4)}), m0 AS (SELECT tile, r, c, p + t > -0.1 AS m FROM im),
      m1 AS (SELECT tile, r // 2 AS r, c // 2 AS c, count(*) FILTER (m) >= 3 AS m FROM m0 GROUP BY ALL), m2 AS (SELECT tile, r // 2 AS r, c // 2 AS c, count(*) FILTER (m) >= 3 AS m FROM m1 GROUP BY ALL),
      l AS (SELECT avg(abs(im.p - u0.p - (im.t - u0.t))) AS x FROM im JOIN u0 USING (tile, r, c) JOIN m0 USING (tile, r, c) WHERE m UNION ALL
      SELECT avg(abs(g1.p - u1.p - (g1.t - u1.t))) FROM g1 JOIN u1 USING (tile, r, c) JOIN m1 USING (tile, r, c) WHERE m UNION ALL SELECT avg(abs(p - t)) FROM g2 JOIN m2 USING (tile, r, c) WHERE m)
      SELECT round(sum(coalesce(x, 0)) / 3, 9) AS loss FROM l""",
    "ssim": q("""SELECT ci, cj, round(avg((2 * p * t + 0.0001::DOUBLE) * (2 * (pt - p * t) + 0.0009::DOUBLE) / ((p * p + t * t + 0.0001::DOUBLE) * (pp - p * p + tt - t * t + 0.0009::DOUBLE))), 8) AS ssim
      FROM b WHERE r BETWEEN 5 AND 10 AND c BETWEEN 5 AND 10 GROUP BY ci, cj""", f"{DENSE}, mo AS (SELECT ci, cj, r, c, p, t, p * p AS pp, t * t AS tt, p * t AS pt FROM dense), b AS ({blurred('mo', ['p', 't', 'pp', 'tt', 'pt'], 'ci, cj', 11, 1.5)})"),
    "edt_weights": q("""SELECT d.ci, d.cj, d.r, d.c, CASE WHEN d.m THEN round(min(sqrt(((d.r - e.r) ** 2 + (d.c - e.c) ** 2)::DOUBLE)), 9) ELSE 0.0::DOUBLE END AS weight
      FROM dense d JOIN dense e ON d.ci = e.ci AND d.cj = e.cj AND (NOT e.m OR e.r IN (0, 15) OR e.c IN (0, 15)) GROUP BY d.ci, d.cj, d.r, d.c, d.m""", DENSE),
    "weighted_blend": q("SELECT pid, channel, CASE WHEN sum(w) > 0 THEN round(sum(v * w) / sum(w), 9) END AS v, round(sum(w), 9) AS weight FROM bl GROUP BY ALL", f"""{BLEND}, bl AS (SELECT pid, CAST(h * 3 + k AS INTEGER) AS channel, y2020 + k * 0.2::DOUBLE + h * 0.01::DOUBLE + ti * 0.001::DOUBLE AS v, w FROM ew, (SELECT unnest(range(4)) AS h), (SELECT unnest(range(3)) AS k))"""),
    "blend_coverage": q("SELECT count(*) FILTER (w > 0) AS n, round(100.0::DOUBLE * count(*) FILTER (w > 0) / count(*), 9) AS percent FROM (SELECT pid, sum(w) AS w FROM ew GROUP BY pid)", BLEND),
    "temporal_lag": q("SELECT pid, yr, round(hm, 9) AS hm, round(lag(hm) OVER w, 9) AS last, round(lag(hm, 2) OVER w, 9) AS second_last FROM pix WINDOW w AS (PARTITION BY pid ORDER BY yr)"),
    "nearest_downsample": q("SELECT r // 4 AS r, c // 4 AS c, round(y2020, 9) AS v FROM wide WHERE r % 4 = 0 AND c % 4 = 0"),
    "valid_intersect": q("SELECT pid FROM pix WHERE yr = 2000 INTERSECT SELECT pid FROM pix WHERE yr = 2020"),
    "invalid_except": q("SELECT pid FROM pids EXCEPT SELECT pid FROM pix WHERE yr = 2020"),
    "mask_union": q("SELECT pid FROM wide WHERE y2000 IS NULL UNION SELECT pid FROM wide WHERE y2020 IS NULL"),
    "union_all_batches": q(f"SELECT h, count(*) AS n, {fix('sum(dt)', 5)} AS total FROM ch GROUP BY h"),
    "pe_direct": encoded([f"{RA} - pi()", f"{RB} - pi()"]),
    "pe_cartesian3d": encoded([f"cos({RA}) * cos({RB})", f"sin({RA}) * cos({RB})", f"sin({RB})"]),
    "pe_wrap": encoded([f"cos({RA})", f"sin({RA})", f"cos({RB})", f"sin({RB})"]),
    "pe_grid": encoded([f"{t}({x} * {f!r}::DOUBLE)" for x in ("lon", "lat") for f in FREQ for t in ("sin", "cos")]),
    "pe_spherec": encoded(twice(lambda lo, la: [f"sin({la})", f"cos({la}) * cos({lo})", f"cos({la}) * sin({lo})"])),
    "pe_spherecplus": encoded(twice(lambda lo, la: [f"sin({la})", f"cos({la})", f"sin({lo})", f"cos({lo})", f"cos({la}) * cos({lo})", f"cos({la}) * sin({lo})"])),
    "pe_spherem": encoded(twice(lambda lo, la: [f"sin({la})", *sphere_m(lo, la)])),
    "pe_spheremplus": encoded(twice(lambda lo, la: [f"sin({la})", f"cos({la})", f"sin({lo})", f"cos({lo})", *sphere_m(lo, la)])),
    "pe_theory": encoded(theory()),
    "pe_spherical_harmonics": encoded(SH),
    "pe_spherical_harmonics_analytic": encoded([f"-({v})" if m % 2 else v for v, m in zip(SH, ORDERS, strict=True)]),
    "pe_discretized_sh": encoded(sh_table(3)),
}
