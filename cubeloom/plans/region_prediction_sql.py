"""The region's prediction in SQL. With kernels of one cell all tiles agree on a pixel, so that the blend must give the
model's value, and the weights are sums of distances over the tiles."""

from __future__ import annotations

from cubeloom.plans.assembly_sql import TILES, unrolled
from cubeloom.plans.sql import REGION, fix, q

BOUNDS = """bb AS (SELECT height, least(greatest(CAST(floor((80.0::DOUBLE - 90) / (-180.0::DOUBLE / height)) AS BIGINT), 0), height) AS r0, least(CAST(ceil((-70.0::DOUBLE - 90) / (-180.0::DOUBLE / height)) AS BIGINT), height) AS r1, 10 AS c0, 59 AS c1 FROM hh)"""
PIXELS = f"""hs AS (SELECT mean, std FROM stats WHERE layer = 'hm'),
sm AS (SELECT avg(ele) AS em, stddev_pop(ele) + 1e-8 AS es, avg(tas) AS tm, stddev_pop(tas) + 1e-8 AS ts FROM st),
px AS (SELECT ll.r, ll.c, {REGION} AND y2010 IS NOT NULL AND y2015 IS NOT NULL AND y2020 IS NOT NULL AS ok, tas IS NOT NULL AS complete, (y2010 - mean) / std AS x0, (y2015 - mean) / std AS x1, (y2020 - mean) / std AS x2,
  (coalesce(ele, 0) - em) / es AS e, (tas - tm) / ts AS t, radians(round(lon, 9)) / pi() AS lo, radians(round(lat, 9)) / pi() AS la, 0.0::DOUBLE AS z
  FROM ll JOIN wide USING (pid) LEFT JOIN st USING (pid), hs, sm)"""
WEIGHTS = f"""{TILES.split("tb AS")[0].rstrip().rstrip(",")}, {BOUNDS},
ce AS (SELECT ti, tj, ti + i.v AS r, tj + j.v AS c, coalesce(ok, false) AND i.v > 0 AND j.v > 0 AND ti + i.v < least(ti + 8, r1) - 1 AND tj + j.v < least(tj + 8, c1) - 1 AS m
  FROM tg CROSS JOIN bb CROSS JOIN (SELECT unnest(range(8)) AS v) i CROSS JOIN (SELECT unnest(range(8)) AS v) j LEFT JOIN px ON px.r = ti + i.v AND px.c = tj + j.v WHERE ti + i.v < r1 AND tj + j.v < c1),
di AS (SELECT d.ti, d.tj, d.r, d.c, min(sqrt(((d.r - e.r) ** 2 + (d.c - e.c) ** 2)::DOUBLE)) AS w FROM ce d JOIN ce e ON d.ti = e.ti AND d.tj = e.tj WHERE d.m AND NOT e.m GROUP BY ALL),
ws AS (SELECT r, c, sum(w) AS weight FROM di GROUP BY r, c)"""
STEPS, LAST, VALUES = unrolled("px")
CLIPPED = "CASE WHEN v IS NOT NULL THEN greatest(0.0, least(1.0, v * std + mean)) END"

SQL = {
    "region_prediction": q(
        f"SELECT r, c, CAST(2020 + 5 * (k // 3 + 1) AS INTEGER) AS yr, CAST(k % 3 AS INTEGER) AS q, CASE WHEN complete THEN {fix(CLIPPED, 6)} END AS v, round(weight, 9) AS weight FROM (SELECT r, c, complete, unnest(range(12)) AS k, unnest([{', '.join(VALUES)}]) AS v FROM {LAST}) JOIN ws USING (r, c), hs",
        ", ".join([PIXELS, WEIGHTS, *STEPS]),
    ),
    "region_prediction_coverage": q("SELECT count(*) AS weighted, count(*) FILTER (complete) AS with_value, round(sum(weight), 6) AS weight FROM ws JOIN px USING (r, c)", f"{PIXELS}, {WEIGHTS}"),
}
