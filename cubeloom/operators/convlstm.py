"""Inference of a recurrent convolution over tiles, in Arrow batches of whole tiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cubeloom.session import ship


@dataclass
class Weights:
    """Kernels of the gates (input, forget, output, candidate, in this order) and of the output head."""

    gates: np.ndarray  # 4 * hidden, channels + hidden, 3, 3
    gate_bias: np.ndarray
    head: np.ndarray  # outputs, hidden, 3, 3
    head_bias: np.ndarray

    @property
    def hidden(self) -> int:
        return len(self.gate_bias) // 4

    @staticmethod
    def drawn(seed: int, channels: int, hidden: int, outputs: int) -> Weights:
        rng = np.random.default_rng(seed)
        return Weights(rng.normal(0, 0.2, (4 * hidden, channels + hidden, 3, 3)), rng.normal(0, 0.1, 4 * hidden), rng.normal(0, 0.2, (outputs, hidden, 3, 3)), rng.normal(0, 0.1, outputs))


def dense(column: pa.ChunkedArray, depth: int) -> np.ndarray:
    """Nested lists of equal lengths as an array of ``depth`` more dimensions, without a Python object a number."""
    flat, sizes = column.combine_chunks(), [len(column)]
    for _ in range(depth):
        before, flat = len(flat), flat.flatten()
        sizes.append(len(flat) // max(before, 1))
    return flat.to_numpy(zero_copy_only=False).reshape(sizes)


def conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A convolution (channels, rows, columns; any axes before them are tiles) with zeros outside, as one product over shifted
    views."""
    half = kernel.shape[-1] // 2
    padded = np.pad(x, (*[(0, 0)] * (x.ndim - 2), (half, half), (half, half)))
    views = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[-2:], axis=(-2, -1))
    return np.einsum("...chwij,ocij->...ohw", views, kernel, optimize=True) + bias[:, None, None]


def step(x: np.ndarray, h: np.ndarray, c: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    i, f, o, g = np.split(conv(np.concatenate([x, h]), w.gates, w.gate_bias), 4)
    c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
    return sigmoid(o) * np.tanh(c), c


def forward(x: np.ndarray, w: Weights) -> np.ndarray:
    """``x``: time, channels, rows, columns. The head of the last hidden state; the first state is zero."""
    h = c = np.zeros((w.hidden, *x.shape[-2:]))
    for t in x:
        h, c = step(t, h, c, w)
    return conv(h, w.head, w.head_bias)


def predict(cells: DataFrame, tile: list[str], size: int, weights: Weights) -> DataFrame:
    """``tile, r, c, channel, pred`` from cells ``tile, r, c, x`` (time by channel); a tile is a bounded group."""
    spark = ship(cells.sparkSession)
    shared = spark.sparkContext.broadcast((weights.gates, weights.gate_bias, weights.head, weights.head_bias))
    kinds = [cells.schema[c].dataType.simpleString() for c in tile]

    def run(table: pa.Table) -> pa.Table:
        x = dense(table.column("x"), 2)
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        image = np.zeros((x.shape[1], x.shape[2], size, size))
        image[:, :, r, c] = x.transpose(1, 2, 0)
        out = np.round(forward(image, Weights(*shared.value)), 6)
        n = out.size
        channel, rows, columns = np.unravel_index(np.arange(n), out.shape)
        keys = [pa.array([table.column(k)[0].as_py()] * n, table.schema.field(k).type) for k in tile]
        return pa.table([*keys, *(pa.array(v.astype(np.int64)) for v in (rows, columns, channel)), pa.array(out.ravel())], names=[*tile, "r", "c", "channel", "pred"])

    return cells.groupBy(*tile).applyInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(tile, kinds, strict=True)) + ", r long, c long, channel long, pred double")
