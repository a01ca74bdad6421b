"""The multi-horizon predictor: stacked recurrent convolutions over dynamic, static and location channels, and a central,
a lower and an upper head for each horizon."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cubeloom.operators.convlstm import conv, dense
from cubeloom.session import ship

HEADS = ("lower", "central", "upper")
Weights = dict[str, np.ndarray]


def shapes(channels: int, hidden: int, layers: int, horizons: int = 4, kernel: int = 3, head_kernel: int = 3) -> dict[str, tuple[int, ...]]:
    """The weights by name: gates of each layer (input, forget, output, candidate), and two convolutions a head. A central
    head keeps the hidden width, the two quantile heads halve it."""
    out: dict[str, tuple[int, ...]] = {}
    for k in range(layers):
        into = (channels if k == 0 else hidden) + hidden
        out |= {f"gates{k}": (4 * hidden, into, kernel, kernel), f"gates{k}_bias": (4 * hidden,)}
    for h in range(horizons):
        for name in HEADS:
            width = hidden if name == "central" else hidden // 2
            out |= {f"{name}{h}_a": (width, hidden, head_kernel, head_kernel), f"{name}{h}_a_bias": (width,), f"{name}{h}_b": (1, width, 1, 1), f"{name}{h}_b_bias": (1,)}
    return out


def drawn(seed: int, **sizes: int) -> Weights:
    rng = np.random.default_rng(seed)
    return {k: rng.normal(0, 0.2, v) for k, v in shapes(**sizes).items()}


def forward(x: np.ndarray, w: Weights) -> np.ndarray:
    """``x``: time, channels, rows, columns, or time, tiles, channels, rows, columns. Lower, central and upper of each horizon, in this order, from the last state of
    the last layer; all first states are zero."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    k = 0
    while f"gates{k}" in w:
        gates, bias = w[f"gates{k}"], w[f"gates{k}_bias"]
        h = c = np.zeros((*x.shape[1:-3], len(bias) // 4, *x.shape[-2:]))
        states = []
        for t in x:
            i, f, o, g = np.split(conv(np.concatenate([t, h], axis=-3), gates, bias), 4, axis=-3)
            c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h = sigmoid(o) * np.tanh(c)
            states.append(h)
        x, k = np.stack(states), k + 1
    out, horizon = [], 0
    while f"central{horizon}_a" in w:
        for name in (f"{n}{horizon}" for n in HEADS):
            inner = np.maximum(conv(x[-1], w[f"{name}_a"], w[f"{name}_a_bias"]), 0)
            out.append(conv(inner, w[f"{name}_b"], w[f"{name}_b_bias"])[..., 0, :, :])
        horizon += 1
    return np.stack(out, axis=-3)


def predict(cells: DataFrame, tile: list[str], size: int, weights: Weights, run_model: Callable[[np.ndarray, Weights], np.ndarray] = forward) -> DataFrame:
    """``tile, r, c, channel, pred`` from cells ``tile, r, c, x, s``: dynamic channels by time, and static ones (with those
    of the location), which are repeated at each time. A tile is a bounded group."""
    spark = ship(cells.sparkSession)
    shared = spark.sparkContext.broadcast(weights)
    kinds = [cells.schema[c].dataType.simpleString() for c in tile]

    def run(table: pa.Table) -> pa.Table:
        x, s = dense(table.column("x"), 2), dense(table.column("s"), 1)
        x = np.concatenate([x, np.repeat(s[:, None], x.shape[1], axis=1)], axis=2)
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        image = np.zeros((x.shape[1], x.shape[2], size, size))
        image[:, :, r, c] = x.transpose(1, 2, 0)
        out = np.round(run_model(image, shared.value), 6) + 0.0
        channel, rows, columns = np.unravel_index(np.arange(out.size), out.shape)
        keys = [pa.array([table.column(k)[0].as_py()] * out.size, table.schema.field(k).type) for k in tile]
        return pa.table([*keys, *(pa.array(v.astype(np.int64)) for v in (rows, columns, channel)), pa.array(out.ravel())], names=[*tile, "r", "c", "channel", "pred"])

    return cells.groupBy(*tile).applyInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(tile, kinds, strict=True)) + ", r long, c long, channel long, pred double")
