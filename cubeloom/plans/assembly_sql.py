"""SQL of the queries of ``assembly``, written independently of their DataFrame forms."""

from __future__ import annotations

from cubeloom.plans.sql import CHIPPED, EDGES, LOGITS, fix, hist, q

TILES = """tg AS (SELECT ti.v AS ti, tj.v AS tj, ((ti.v - r0) // 4) * ((c1 - c0 + 3) // 4) + (tj.v - c0) // 4 AS place FROM (SELECT least(greatest(CAST(floor((80.0::DOUBLE - 90) / (-180.0::DOUBLE / height)) AS BIGINT), 0), height) AS r0,
  least(CAST(ceil((-70.0::DOUBLE - 90) / (-180.0::DOUBLE / height)) AS BIGINT), height) AS r1, CAST(10 AS BIGINT) AS c0, CAST(59 AS BIGINT) AS c1 FROM hh) b,
  (SELECT unnest(range(0, 100000)) AS v) ti, (SELECT unnest(range(64)) AS v) tj WHERE ti.v >= r0 AND ti.v < r1 AND (ti.v - r0) % 4 = 0 AND tj.v >= c0 AND tj.v < c1 AND (tj.v - c0) % 4 = 0),
tb AS (SELECT ti, tj, CAST(place // 16 AS BIGINT) AS batch FROM tg)"""
PICK = lambda salt, n: f"CAST('0x' || substr(md5('{salt}_' || sample), 1, 7) AS BIGINT) % {n}"
SAMPLES = f"""sm AS (SELECT sample, {PICK("row", "(height - 15)")} AS r0, {PICK("col", "49")} AS c0, CAST([2000, 2005, 2010, 2015][{PICK("year", "4")} + 1] AS INTEGER) AS end_year FROM (SELECT unnest(range(200)) AS sample), hh WHERE height >= 16)"""


def weight(name: str, i: int, j: int) -> str:
    return f"{((7 * i + 5 * j + 3 * len(name) + sum(map(ord, name))) % 11 - 5) / 10.0!r}::DOUBLE"


def product(name: str, row: int, inputs: list[str], bias: str | None) -> str:
    terms = [f"{weight(name, row, j)} * ({x})" for j, x in enumerate(inputs)] + ([weight(bias, row, 0)] if bias else [])
    return "(" + " + ".join(terms) + ")"


def layer(source: str, name: str, keep: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM {source})"


def siren() -> str:
    steps = [layer("ll", "s0", "pid", {f"h{i}": f"sin(30 * {product('w0', i, ['radians(round(lon, 9)) - pi()', 'radians(round(lat, 9)) - pi()'], 'b0')})" for i in range(4)})]
    h = [f"h{i}" for i in range(4)]
    steps.append(layer("s0", "s1", "pid", {f"h{i}": f"sin({product('w1', i, h, 'b1')})" for i in range(4)}))
    values = ", ".join(fix(product("w_out", i, h, "b_out"), 6) for i in range(3))
    return q(f"SELECT pid, CAST(unnest(range(3)) AS INTEGER) AS k, unnest([{values}]) AS v FROM s1", ", ".join(steps))


def fcnet() -> str:
    relu = lambda x: f"greatest({x}, 0.0::DOUBLE)"
    h, y = [f"h{i}" for i in range(4)], [f"y{i}" for i in range(4)]
    steps = [layer("ll", "f0", "pid", {f"h{i}": relu(product("w_in", i, ["radians(round(lon, 9)) - pi()", "radians(round(lat, 9)) - pi()"], "b_in")) for i in range(4)})]
    for k in range(4):
        steps.append(layer(f"f{k}", f"g{k}", f"pid, {', '.join(h)}", {f"y{i}": relu(product(f"u{k}", i, h, f"ub{k}")) for i in range(4)}))
        steps.append(layer(f"g{k}", f"f{k + 1}", "pid", {f"h{i}": f"h{i} + {relu(product(f'v{k}', i, y, f'vb{k}'))}" for i in range(4)}))
    values = ", ".join(fix(product("w_out", i, h, None), 6) for i in range(3))
    return q(f"SELECT pid, CAST(unnest(range(3)) AS INTEGER) AS k, unnest([{values}]) AS v FROM f4", ", ".join(steps))


def pixelwise() -> str:
    """Two layers of two hidden channels over three times, unrolled: each step adds its states as columns."""
    place = ["radians(lon) / pi()", "radians(lat) / pi()"]
    cells = f"""mc AS (SELECT a.v AS ci, b.v AS cj, i.v AS r, j.v AS c, coalesce(y1990, 0) AS x0, coalesce(y1995, 0) AS x1, coalesce(y2000, 0) AS x2, coalesce(ele, 0) / 1e6::DOUBLE AS e, coalesce(tas, 0) / 1e4::DOUBLE AS t,
round(-180.0::DOUBLE + (b.v * 16 + j.v + 0.5::DOUBLE) * 5.625::DOUBLE, 9) AS lon, round(90.0::DOUBLE + (a.v * 16 + i.v + 0.5::DOUBLE) * (-180.0::DOUBLE / height), 9) AS lat
FROM hh CROSS JOIN (SELECT unnest(range(0, 100000)) AS v) a CROSS JOIN (SELECT unnest(range(4)) AS v) b CROSS JOIN (SELECT unnest(range(16)) AS v) i CROSS JOIN (SELECT unnest(range(16)) AS v) j
LEFT JOIN wide w ON w.r = a.v * 16 + i.v AND w.c = b.v * 16 + j.v LEFT JOIN st USING (pid) WHERE a.v < height // 16),
k0 AS (SELECT *, {place[0]} AS lo, {place[1]} AS la, 0.0::DOUBLE AS z FROM mc)"""
    steps, source, values = unrolled("k0")
    return q(f"SELECT ci, cj, r, c, unnest(range(12)) AS channel, unnest([{', '.join(fix(v, 6) for v in values)}]) AS pred FROM {source}", ", ".join([cells, *steps]))


def unrolled(source: str) -> tuple[list[str], str, list[str]]:
    """Steps, the last one's name and its twelve outputs, from columns ``x0, x1, x2, e, t, lo, la`` and ``z``, a zero."""
    steps = []
    sigmoid = lambda x: f"(1 / (1 + exp(-{x})))"
    for k in range(2):
        for t in range(3):
            x = [f"x{t}", "e", "t", "lo", "la"] if k == 0 else [f"h0_{t}_0", f"h0_{t}_1"]
            x = x + ([f"h{k}_{t - 1}_{i}" for i in range(2)] if t else ["z", "z"])
            gate = lambda n, i, x=x, k=k: product(f"gates{k}", 2 * n + i, x, f"gates{k}_bias")
            name = f"c{k}_{t}"
            before = [f"m{k}_{t - 1}_{i}" if t else "z" for i in range(2)]
            steps.append(layer(source, f"{name}a", "*", {f"m{k}_{t}_{i}": f"{sigmoid(gate(1, i))} * {before[i]} + {sigmoid(gate(0, i))} * tanh({gate(3, i)})" for i in range(2)}))
            steps.append(layer(f"{name}a", name, "*", {f"h{k}_{t}_{i}": f"{sigmoid(gate(2, i))} * tanh(m{k}_{t}_{i})" for i in range(2)}))
            source = name
    last, values = ["h1_2_0", "h1_2_1"], []
    for h in range(4):
        for name in ("lower", "central", "upper"):
            width = 2 if name == "central" else 1
            inner = [f"greatest({product(f'{name}{h}_a', i, last, f'{name}{h}_a_bias')}, 0.0::DOUBLE)" for i in range(width)]
            values.append(product(f"{name}{h}_b", 0, inner, f"{name}{h}_b_bias"))
    return steps, source, values


LAYER_YEARS = ", ".join(f"round(max({v}) FILTER (yr = {y}), 9) AS {v}_{y}" for v in ("hm", "ag", "ti", "gdp") for y in (1990, 1995, 2000))
STATIC = "sx AS (SELECT pid, CAST(0 AS INTEGER) AS idx, ele AS v FROM st UNION ALL SELECT pid, 1, tas FROM st)"
CLIP = lambda v: f"greatest(0.0, least(1.0, ({v} - mean) / std * std + mean))"

SQL = {
    "raster_metadata": q("SELECT layer, yr, height, CAST(64 AS INTEGER) AS width, -180.0::DOUBLE AS x0, 90.0::DOUBLE AS y0, 5.625::DOUBLE AS dx, round(-180.0::DOUBLE / height, 9) AS dy, count(v) AS n_values, round(min(v), 9) AS least, round(max(v), 9) AS most FROM ly, hh GROUP BY layer, yr, height"),
    "input_invalid_mask": q("SELECT pid, h, CASE WHEN first IS NOT NULL AND prev IS NOT NULL AND last IS NOT NULL AND ele IS NOT NULL AND tas IS NOT NULL THEN round(pred, 9) END AS pred FROM hz LEFT JOIN st USING (pid)"),
    "horizon_index": q("SELECT pid, name, CAST(CASE name WHEN '10yr' THEN 1 WHEN '15yr' THEN 2 WHEN '20yr' THEN 3 ELSE 0 END AS INTEGER) AS idx FROM (SELECT pid, (h * 5 + CAST(pid % 3 = 0 AS INTEGER)) || 'yr' AS name FROM hz)"),
    "first_statics": q("SELECT pid, idx, round(v, 9) AS v FROM sx WHERE idx = 0", STATIC),
    "static_stats": q("SELECT idx, round(avg(v), 4) AS mean, round(stddev_pop(v) + 1e-8, 4) AS std FROM sx GROUP BY idx", STATIC),
    "stack_all_layers": q(f"SELECT y.*, round(ele, 9) AS ele, round(tas, 9) AS tas FROM (SELECT pid, {LAYER_YEARS} FROM pix GROUP BY pid) y LEFT JOIN st USING (pid)"),
    "channel_concat": q("SELECT pid, CAST(unnest(range(5)) AS INTEGER) AS k, unnest([round(coalesce(v, 0), 9) FOR v IN [y1990, y1995, y2000, ele, tas]]) AS v FROM wide LEFT JOIN st USING (pid)"),
    "panel_histogram": q(hist("pn", "delta", "ci, cj, h", EDGES), f"{CHIPPED}, pn AS (SELECT ci, cj, h, round({CLIP('pred')} - {CLIP('last')}, 6) AS delta FROM cc, (SELECT mean, std FROM stats WHERE layer = 'hm'))"),
    "random_samples": q("SELECT * FROM sm", SAMPLES),
    "tile_batches": q("SELECT * FROM tb", TILES),
    "first_batches": q("SELECT * FROM tb WHERE batch < 10", TILES),
    "first_batch": q("SELECT ti, tj FROM tb WHERE batch = (SELECT min(batch) FROM tb)", TILES),
    "rarity_weights_sampled": q("SELECT h, bin, round((1 / (n + 0.001::DOUBLE)) * 8 / sum(1 / (n + 0.001::DOUBLE)) OVER (PARTITION BY h), 9) AS weight FROM ha", f"{CHIPPED}, c10 AS (SELECT * FROM cc WHERE (ci * 4 + cj) // 2 < 10), ha AS ({hist('c10', 'dt', 'h')})"),
    "tile_crop": q("""SELECT ti + a.v AS r, tj + b.v AS c, round(coalesce(y2020, 0), 9) AS v FROM (SELECT DISTINCT r // 8 * 8 AS ti, c // 8 * 8 AS tj FROM wide WHERE y2020 IS NOT NULL)
      CROSS JOIN (SELECT unnest(range(8)) AS v) a CROSS JOIN (SELECT unnest(range(8)) AS v) b CROSS JOIN hh LEFT JOIN wide ON r = ti + a.v AND c = tj + b.v WHERE ti + a.v < height"""),
    "overview": q("SELECT r // k AS r, c // k AS c, round(y2020, 9) AS v FROM wide, (SELECT greatest(1, CAST(ceil(greatest(height, 64) / 32.0::DOUBLE) AS BIGINT)) AS k FROM hh) WHERE r % k = 0 AND c % k = 0"),
    "binary_metrics": q("SELECT round(avg(CAST((label >= 5) = (z[1] > 0) AS INTEGER)), 9) AS accuracy, round(count(*) FILTER (label >= 5 AND z[1] > 0) / count(*) FILTER (label >= 5 OR z[1] > 0)::DOUBLE, 9) AS jaccard, round(avg(abs(z[1] - label)), 9) AS mae FROM lg", LOGITS),
    "location_siren": siren(),
    "location_fcnet": fcnet(),
    "predictor_pixelwise": pixelwise(),
}
