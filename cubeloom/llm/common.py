"""Helpers that the training-data operators share."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cubeloom.session import cut, ship, stored  # noqa: F401

#: The only characters that separate words in the word contracts.
SPACES = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | list]], schema: str, most_bytes: int = 8_000_000) -> DataFrame:
    """``mapInArrow`` with state: ``make()`` runs once a task and returns the function of a batch.

    That function returns columns in the order of ``schema`` (lists or arrays), or None for no rows.
    """
    ship(df.sparkSession)
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to = to_arrow_schema(fields)
        f = make()
        for batch in batches:
            for piece in pieces(batch, most_bytes):
                columns = f(piece)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, to, strict=True)], schema=to)
                    del columns
            del batch
        del f
        released()

    return df.mapInArrow(run, fields)


def by_group(df: DataFrame, make: Callable[[], Callable[..., list | None]], schema: str) -> DataFrame:
    """Groups of rows with an equal first column (a long), each given to a function as columns: arrays of numbers, lists of
    anything else. Rows are sorted and groups stream by, so that a task holds one group at a time."""
    ship(df.sparkSession)
    fields, first = StructType.fromDDL(schema), df.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, f = to_arrow_schema(fields), make()
        held: list[list] = []

        def done() -> list | None:
            columns = [c[0] if len(c) == 1 else np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*held, strict=True)]
            held.clear()
            return f(*columns)

        def out(found: list[list]) -> Iterator[pa.RecordBatch]:
            if found:
                parts = [[pa.array(c, t.type) for c, t in zip(columns, to, strict=True)] for columns in found]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*parts, strict=True)], schema=to)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() if pa.types.is_integer(c.type) and not c.null_count else c.to_pylist() for c in batch.columns]
            found, keys = [], columns[0]
            ends = np.concatenate([np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).tolist()
            start = 0
            for end in ends:
                if held and held[0][0][0] != keys[start] and (got := done()) is not None:
                    found.append(got)
                held.append([c[start:end] for c in columns])
                start = end
            yield from out(found)
        if held and (got := done()) is not None:
            yield from out([got])
        released()

    return df.repartition(first).sortWithinPartitions(first).mapInArrow(run, fields)


def folded(parts: DataFrame, size: int, kind: type, join: np.ufunc, blocks: int = 64) -> np.ndarray:
    """The arrays (``size`` numbers of ``kind``, packed by ``packed``) in the rows of a binary column, joined place by place:
    a task joins its own, tasks then join a block each, and the driver gets every block once, packed. No row gives zeros."""
    ship(parts.sparkSession)
    step = -(-size // blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0):
                one = unpacked(raw.as_py(), kind)
                total = one.copy() if total is None else join(total, one, out=total)
        if total is not None:
            starts = range(0, size, step)
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([packed(total[i : i + step]) for i in starts], pa.binary())], names=["at", "m"])

    def joiner():
        return lambda at, raws: [at[:1], [packed(functools.reduce(join, (unpacked(r, kind) for r in raws)))]]

    out = np.zeros(size, kind)
    for at, raw in by_group(parts.mapInArrow(run, "at long, m binary"), joiner, "at long, m binary").collect():
        out[at : at + step] = unpacked(raw, kind)
    return out


def packed(a: np.ndarray) -> bytes:
    return zs.ZstdCompressor(level=3).compress(a.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zs.ZstdDecompressor().decompress(raw), kind)


def released() -> None:
    """Give freed memory back to the system: a worker that waits for its next task keeps none of the last one's."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def pieces(batch: pa.RecordBatch, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes (a row is never cut)."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, int(n * most / max(1, batch.nbytes)))
    for i in range(0, n, step):
        yield batch.slice(i, min(step, n - i))


def crc_fold(doc_id, n: int):
    """``crc32(doc_id as text) mod n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sampled(df: DataFrame, key: str, group: str, rows: int, seed: int, most_groups: int = 10_000) -> DataFrame:
    """About ``rows`` rows of each group, chosen by the hash of ``key``: the same rows at every layout.

    Each group's share comes from a count over all rows; a group with fewer rows is taken whole. Groups are classes to
    learn: over ``most_groups`` of them are an error.
    """
    counts = df.groupBy(group).agg(F.count("*").alias("_n"))
    share = counts.select(F.col(group).alias("_g"), (F.lit(float(rows)) / F.col("_n")).alias("_share"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    known = [(r["_g"], r["_share"]) for r in share.filter(F.col("_g").isNotNull()).limit(most_groups + 1).collect()]
    if len(known) > most_groups:
        raise ValueError(f"{group} has over {most_groups} values: too many classes to learn")
    keep = F.lit(False)
    for g, s in known:
        keep = keep | ((F.col(group) == F.lit(g)) & (draw < F.lit(s)))
    return df.filter(keep)


def fit_logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge-regularised logistic regression; ``counts`` says how often each row was seen."""
    n = np.ones(len(y)) if counts is None else counts
    mean = np.average(x, axis=0, weights=n)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=n)) + 1e-9
    z, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(x.shape[1] + 1)
    penalty = ridge * n.sum() * np.eye(len(w)) + 1e-6 * np.eye(len(w))
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (n * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w[1:] / scale, float(w[0] - (w[1:] / scale) @ mean)


def newton_logistic(x: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The function of the probabilities of ``fit_logistic``."""
    w, bias = fit_logistic(x, y)
    return lambda v: 1 / (1 + np.exp(-np.clip(v @ w + bias, -35, 35)))


class Interner(dict):
    """Numbers for strings in the order of their first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n
