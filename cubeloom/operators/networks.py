"""Location networks: sinusoidal layers and residual layers over encoded coordinates, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.session import ship

Weights = dict[str, np.ndarray]


def linear(x: np.ndarray, w: Weights) -> np.ndarray:
    return x @ w["w"].T + w["b"]


def siren(x: np.ndarray, w: Weights, w0: float = 1.0, w0_initial: float = 30.0) -> np.ndarray:
    """Layers ``w0 b0, w1 b1 ..`` of sin(w0 (W x + b)), the first at its own frequency; the last layer ``w_out b_out`` is linear."""
    k = 0
    while f"w{k}" in w:
        x = np.sin((w0_initial if k == 0 else w0) * (x @ w[f"w{k}"].T + w[f"b{k}"]))
        k += 1
    return x @ w["w_out"].T + w["b_out"]


def fcnet(x: np.ndarray, w: Weights) -> np.ndarray:
    """A rectified layer ``w_in b_in``, residual blocks ``u0 v0, u1 v1 ..`` of two rectified layers each, and a last layer
    ``w_out`` without bias."""
    x, k = np.maximum(x @ w["w_in"].T + w["b_in"], 0), 0
    while f"u{k}" in w:
        y = np.maximum(x @ w[f"u{k}"].T + w[f"ub{k}"], 0)
        x = x + np.maximum(y @ w[f"v{k}"].T + w[f"vb{k}"], 0)
        k += 1
    return x @ w["w_out"].T


NETWORKS: dict[str, Callable[[np.ndarray, Weights], np.ndarray]] = {"linear": linear, "siren": siren, "fcnet": fcnet}


def network(name: str) -> Callable[[np.ndarray, Weights], np.ndarray]:
    if name not in NETWORKS:
        raise ValueError(f"unknown network {name}: one of {', '.join(sorted(NETWORKS))}")
    return NETWORKS[name]


def initial(name: str, dim_in: int, hidden: int, dim_out: int, layers: int = 2, seed: int = 0) -> Weights:
    """Weights as they are before training: uniform in 1/d for the first sinusoidal layer and in sqrt(6/d) for the others,
    uniform in 1/sqrt(d) for linear layers."""
    rng = np.random.default_rng(seed)

    def layer(out: int, into: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        return rng.uniform(-bound, bound, (out, into)), rng.uniform(-bound, bound, out)

    plain = lambda out, into: layer(out, into, into**-0.5)
    network(name)
    if name == "linear":
        return dict(zip(("w", "b"), plain(dim_out, dim_in), strict=True))
    if name == "siren":
        found = [layer(hidden, dim_in, 1 / dim_in), *(layer(hidden, hidden, (6 / hidden) ** 0.5) for _ in range(layers - 1))]
        last = layer(dim_out, hidden, (6 / hidden) ** 0.5)
        return {f"{c}{k}": a for k, pair in enumerate(found) for c, a in zip("wb", pair, strict=True)} | {"w_out": last[0], "b_out": last[1]}
    out = dict(zip(("w_in", "b_in"), plain(hidden, dim_in), strict=True))
    for k in range(4):
        for names in ((f"u{k}", f"ub{k}"), (f"v{k}", f"vb{k}")):
            out |= dict(zip(names, plain(hidden, hidden), strict=True))
    return out | {"w_out": plain(dim_out, hidden)[0]}


def encode(df: DataFrame, encoding: list[Column], name: str, weights: Weights, out: str = "loc") -> DataFrame:
    """``df`` with ``out``: the network's values of the encoded coordinates, as an array."""
    run_network = network(name)
    shared = ship(df.sparkSession).sparkContext.broadcast(weights)
    given = df.withColumn(out, F.array(*[c.cast("double") for c in encoding]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(out)
            column = batch.column(at)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = run_network(x, shared.value)
            offsets = np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(y.ravel()))
            columns = [batch.column(i) if i != at else values for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return given.mapInArrow(run, given.schema)
