"""SQL of the queries of ``sampling``: windows joined with their cells one by one."""

from __future__ import annotations

from cubeloom.plans.sql import q

PICK = lambda salt, number, n: f"CAST('0x' || substr(md5('{salt}_' || {number}), 1, 7) AS BIGINT) % {n}"
STAT = "layer || '_' || yr || '_' || draw"
UNIT = "CASE layer WHEN 'gdp' THEN 1 ELSE 10000 END"
WINDOWS = f"""dr AS (SELECT layer, yr, {PICK("strow", STAT, "(height - 15)")} AS r0, {PICK("stcol", STAT, "49")} AS c0
  FROM (SELECT unnest(['hm', 'ag', 'ti', 'gdp']) AS layer), years, (SELECT unnest(range(32)) AS draw), hh WHERE height >= 16),
un AS (SELECT layer, yr, pid // 64 AS r, pid % 64 AS c, floor(v * {UNIT} + 0.5::DOUBLE) AS u FROM ly WHERE v IS NOT NULL),
hit AS (SELECT layer, count(*) AS cells, sum(CAST(u AS HUGEINT)) AS t, sum(CAST(u AS HUGEINT) * CAST(u AS HUGEINT)) AS q FROM dr JOIN un USING (layer, yr) WHERE r >= r0 AND r < r0 + 16 AND c >= c0 AND c < c0 + 16 GROUP BY layer)"""
TRY = "sample || '_' || attempt"
TRIES = f"""ats AS (SELECT sample, attempt, CAST([2000, 2005, 2010, 2015][{PICK("reyear", TRY, "4")} + 1] AS INTEGER) AS end_year, {PICK("rerow", TRY, "(height - 15)")} AS r0, {PICK("recol", TRY, "49")} AS c0
  FROM (SELECT unnest(range((SELECT height // 16 * 4 FROM hh))) AS sample), (SELECT CAST(unnest(range(10)) AS INTEGER) AS attempt), hh WHERE height >= 16),
val AS (SELECT sample, attempt, end_year, r0, c0, count(pid) AS n_valid FROM ats
  LEFT JOIN (SELECT pid, yr, pid // 64 AS r, pid % 64 AS c FROM pix WHERE hm IS NOT NULL) ON yr > end_year AND r BETWEEN r0 AND r0 + 15 AND c BETWEEN c0 AND c0 + 15 GROUP BY ALL)"""


def first(least: int, more: str = "") -> str:
    return q(f"SELECT sample, attempt, end_year, r0, c0, n_valid{more} FROM val QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n_valid < {least}, CASE WHEN n_valid < {least} THEN -attempt ELSE attempt END) = 1", TRIES)


SQL = {
    "sampled_stats": q(f"SELECT layer, cells, round(t / cells::DOUBLE / {UNIT}, 6) AS mean, round(sqrt(greatest(0, q / cells::DOUBLE - (t / cells::DOUBLE) * (t / cells::DOUBLE))) / {UNIT}, 6) AS std FROM hit", WINDOWS),
    "chip_retry": first(1),
    "chip_retry_dense": first(512, ", round(n_valid / 256.0::DOUBLE, 9) AS targets"),
}
