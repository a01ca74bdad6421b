"""SQL of the queries of ``loader``: a sample's steps one by one, each year by a join of its own."""

from __future__ import annotations

from cubeloom.plans.sql import RATIO, q

DRAW = lambda salt, n: f"CAST('0x' || substr(md5('{salt}_' || sample), 1, 7) AS BIGINT) % {n}"
YEARS = ((-10, 0), (-5, 1), (0, 2))
LATER = (5, 10, 15, 20)


def samples(split: int) -> str:
    return f"""SELECT sample, {split} AS split, CAST([2000, 2005, 2010, 2015][{DRAW("end", 4)} + 1] AS INTEGER) AS end_year, greatest(0, least(ci * 16 + {DRAW("down", 8)} - 4, height - 16)) AS r0, greatest(0, least(cj * 16 + {DRAW("right", 8)} - 4, 48)) AS c0
  FROM (SELECT ci, cj, CAST((ci * 4 + cj) * 2 + draw AS BIGINT) AS sample FROM split, (SELECT unnest(range(2)) AS draw) WHERE split = {split}), hh"""


STEPS = f"""{RATIO},
smp AS ({samples(1)} UNION ALL {samples(2)}),
cell AS (SELECT split, sample, end_year, r0 + i.v AS r, c0 + j.v AS c, (r0 + i.v) * 64 + c0 + j.v AS pid FROM smp, (SELECT unnest(range(16)) AS v) i, (SELECT unnest(range(16)) AS v) j),
joined AS (SELECT cell.*, {", ".join(f"p{t}.{v} AS {v}_{t}" for _, t in YEARS for v in ("hm", "ag", "ti", "gdp"))}, {", ".join(f"q{k}.hm AS t_{k}" for k in LATER)}, ele, tas FROM cell
  {" ".join(f"LEFT JOIN pix p{t} ON p{t}.pid = cell.pid AND p{t}.yr = end_year + {k}" for k, t in YEARS)}
  {" ".join(f"LEFT JOIN pix q{k} ON q{k}.pid = cell.pid AND q{k}.yr = end_year + {k} AND q{k}.yr <= 2020" for k in LATER)} LEFT JOIN st ON st.pid = cell.pid),
good AS (SELECT split, sample FROM joined GROUP BY split, sample HAVING {" OR ".join(f"count(t_{k}) > 0" for k in LATER)}),
ss AS (SELECT avg(ele) AS me, stddev_pop(ele) + 1e-8 AS se, avg(tas) AS mt, stddev_pop(tas) + 1e-8 AS sd FROM st)"""


def of(v: str, layer: str) -> str:
    return f"({v} - (SELECT mean FROM stats WHERE layer = '{layer}')) / (SELECT std FROM stats WHERE layer = '{layer}')"


def total(x: str, name: str) -> str:
    return f"round(sum(coalesce({x}, 0)), 4) AS sum_{name}"


SUMS = [total(of(f"hm_{t}", "hm"), f"hm_{t}") for _, t in YEARS] + [total(of(f"coalesce({v}_{t}, 0)", v), f"{v}_{t}") for v in ("ag", "ti", "gdp") for _, t in YEARS]
SUMS += [total("(coalesce(ele, 0) - me) / se", "ele"), total("(tas - mt) / sd", "tas"), *[total(of(f"t_{k}", "hm"), f"t_{k}") for k in LATER]]
SUMS += [f"CAST(count({x}) AS INTEGER) AS n_{x}" for x in (*[f"hm_{t}" for _, t in YEARS], "tas", *[f"t_{k}" for k in LATER])]
SUMS += ["CAST(count(*) AS INTEGER) AS cells", total("-180.0::DOUBLE + (c + 0.5::DOUBLE) * 5.625::DOUBLE", "lon"), total("90.0::DOUBLE + (r + 0.5::DOUBLE) * (-180.0::DOUBLE / height)", "lat")]
SQL = {
    "batch_assembly": q(f"SELECT CAST(sample // 16 AS BIGINT) AS batch, sample, end_year, {', '.join(SUMS)} FROM joined JOIN good USING (split, sample), ss, hh WHERE split = 1 GROUP BY sample, end_year", STEPS),
    "target_years": q(f"SELECT CAST(split AS INTEGER) AS split, end_year, count(*) AS samples, {', '.join(f'count(*) FILTER (k{k} > 0) AS n_{k}' for k in LATER)} FROM (SELECT split, sample, end_year, {', '.join(f'count(t_{k}) AS k{k}' for k in LATER)} FROM joined JOIN good USING (split, sample) GROUP BY ALL) GROUP BY split, end_year", STEPS),
}
