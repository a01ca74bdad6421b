"""Exact n-gram Jaccard join as a metric-space join.

The Jaccard distance of shingle sets is a metric. The join keeps to distances of at most ``e`` (15 hundredths for a
similarity of 85 percent) and works on distinct sets:

1. Pivots. Shingles have one order, the rarer first by a count sketch over all documents, then by hash. A set without its
   first i shingles is i/n away from the whole, so a set within e has one of the first ``e n + 1``: these are the set's
   window of shingles. Of the sets that share a shingle of their windows, and are not alone there by size, the one of the
   least hash is the shingle's pivot document.
2. Cells. Each pivot document has a cell, and a set is replicated to the cells of all pivots of its window. Sets with a
   pivot in no window are farther than e from it, and two sets within e meet in the cell of a shingle that both windows
   have, whichever side of it they are on. In a cell, sketches come first: the parities of counts in buckets, which
   differ in no more places than two sets do (Hamming distance). They part the cell into groups of sets that may be close.
3. Regions. The sets of a group are sent to one task, which joins them by recursion over Voronoi regions with
   triangle-inequality windows (``cells.Cell``). A set that is linked to a pivot's group is not compared within it, so a group
   of near copies gives a link a member. Groups and cells too large for a task are dealt to tiles, every two blocks in one.
4. Linked sets are joined to components, by a distributed propagation of least labels with pointer jumping.

Pivots that are documents alone, without step 1, would not do: nearly all texts are at distance 1 from any document, so
each would be in every window.

Shingles are 64-bit hashes, sets are told apart by 64-bit hashes of these: two different ones agree with a chance of
about 2^-64 a pair.

Defined results: a null text, or one without words, has no shingles and is linked with nothing. A very long text is one
set, however many shingles it has; no part of it is left out. Rows with equal sets are one class. Repeated rows each get
their own row. Ties: of equal sets and in a component, the smallest id names it. A null id never names a component unless
all its members' ids are null. An empty table gives no row. Columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.cells import Cell, Sketches, sketch
from cubeloom.llm.common import by_group, folded, map_batches, packed, pieces, read, stored
from cubeloom.llm.shingles import shingle_sets
from cubeloom.session import ship

CELLS = 1 << 20
BATCH = 2_000_000


def _sig(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def class_rows(docs: DataFrame, text: str, key: str, k: int) -> tuple[DataFrame, np.ndarray]:
    """``_k, n, sig, th, f`` of every row: the set's size, its hash, the text's hash and the set's sketch; and a count
    sketch: in how many sets the shingles of each cell are. Count sketches are summed by blocks in tasks; their size is fixed."""
    kind = docs.schema[key].dataType.simpleString()
    arrow, raw = pa.int64(), pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, schema = np.zeros(CELLS, np.int64), None
        for batch in batches:
            schema = pa.schema([("_k", batch.schema.field("_k").type), ("n", arrow), ("sig", arrow), ("th", arrow), ("f", raw)])
            for b in pieces(batch, BATCH):
                sets = shingle_sets(b.column("_t").to_pylist(), k)
                cells += np.bincount((np.concatenate(sets) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                columns = [[len(s) for s in sets], [_sig(s) for s in sets], b.column("th"), [sketch(s) if len(s) else None for s in sets]]
                yield pa.RecordBatch.from_arrays([b.column("_k"), *[c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]], schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field("_k").type), pa.array([-1], arrow), pa.array([0], arrow), pa.array([0], arrow), pa.array([packed(cells)], raw)], schema=schema)

    ship(docs.sparkSession)
    source = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.xxhash64(F.col(text)).alias("th"))
    both = stored(source.mapInArrow(run, f"_k {kind}, n long, sig long, th long, f binary"))
    return both.filter(F.col("n") >= 0), folded(both.filter(F.col("n") == -1).select("f"), CELLS, np.int64, np.add)


def ordered(s: np.ndarray, heat: np.ndarray) -> np.ndarray:
    """The set's shingles in the order of pivots. ``heat``: of each cell, 0 for rare shingles and more for common ones."""
    h = heat[(s & np.uint64(CELLS - 1)).astype(np.int64)]
    return s[np.lexsort((s, h))]


def windows(docs: DataFrame, heat, text: str, k: int, percent: int, hot: int) -> DataFrame:
    """``r, sig, n, hot``: the shingles of every distinct set's window, those of heat ``hot`` or more marked. Copies within
    a task are left out here, so that a group of copies sends a row a task and shingle."""

    def maker():
        seen: set[int] = set()

        def run(batch: pa.RecordBatch):
            out = []
            for s in shingle_sets(batch.column("_t").to_pylist(), k):
                sig = _sig(s)
                if not len(s) or sig in seen:
                    continue
                seen.add(sig)
                near = ordered(s, heat.value)[: len(s) * (100 - percent) // 100 + 1]
                out.append((near, np.full(len(near), sig), np.full(len(near), len(s))))
            if not out:
                return None
            r = np.concatenate([o[0] for o in out])
            marked = heat.value[(r & np.uint64(CELLS - 1)).astype(np.int64)] >= hot
            return [r.view(np.int64), *[np.concatenate([o[c] for o in out]) for c in (1, 2)], marked]

        return run

    return map_batches(docs.select(F.col(text).alias("_t")), maker, "r long, sig long, n int, hot boolean", BATCH)


def cells(w: DataFrame, percent: int, any_hot: bool) -> DataFrame:
    """``cell, sig``: every set that is not alone by size with one of its window's shingles, in the cells of these shingles'
    pivots, a pivot being named by its hash.

    A shingle that very many sets may have is not dealt to one task: its pivot comes from an aggregation with partial sums."""
    fits = lambda small, large: F.coalesce(100 * small >= percent * large, F.lit(False))
    by_size = Window.partitionBy("r").orderBy("n", "sig")
    cold = (w.filter(~F.col("hot")) if any_hot else w).select("r", "sig", "n").withColumn("_was", F.lag("sig").over(by_size))
    cold = cold.filter(F.col("_was").isNull() | (F.col("_was") != F.col("sig")))  # else a copy from another task
    cold = cold.withColumns({"_before": F.lag("n").over(by_size), "_next": F.lead("n").over(by_size)})
    cold = cold.filter(fits(F.col("_before"), F.col("n")) | fits(F.col("n"), F.col("_next")))
    # sets of far sizes are apart: a pivot serves those around its size
    cold = cold.withColumn("_gap", F.when(fits(F.col("_before"), F.col("n")), 0).otherwise(1))
    cold = cold.withColumn("_run", F.sum("_gap").over(by_size.rowsBetween(Window.unboundedPreceding, 0)))
    cold = cold.withColumn("cell", F.min("sig").over(Window.partitionBy("r", "_run"))).select("cell", "sig")
    if any_hot:
        hot = stored(w.filter("hot").select("r", "sig").distinct())
        pivots = hot.groupBy("r").agg(F.min("sig").alias("cell"))
        cold = cold.unionByName(hot.join(pivots, "r").select("cell", "sig"))
    others = stored(cold.filter("cell <> sig").distinct())
    return others.unionByName(others.select("cell", F.col("cell").alias("sig")).distinct())


def tiled(rows: DataFrame, weight, most: int) -> DataFrame:
    """Rows with ``cell, sig``; a cell of more than ``most`` weight is dealt to blocks by hash, and every two blocks of it
    are a cell of their own (the row in as many cells as there are blocks), so that each pair of rows still meets."""
    large = stored(rows.groupBy("cell").agg(F.sum(weight).alias("_w")).filter(F.col("_w") > most))
    if large.isEmpty():
        return rows
    blocks = F.ceil(F.col("_w") * 2 / most)
    split = rows.join(large, "cell").withColumn("_b", F.pmod(F.xxhash64(F.lit(5), F.col("sig")), blocks))
    split = split.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    split = split.withColumn("cell", F.xxhash64("cell", F.least("_b", "_j"), F.greatest("_b", "_j")))
    return rows.join(large, "cell", "left_anti").unionByName(split.select(*rows.columns))


def close_groups(rows: DataFrame, percent: int) -> DataFrame:
    """``cell, sig`` from rows ``cell, sig, n, f``: groups of sets whose sketches don't tell them apart, named by their
    smallest member, so that a group found in several cells is one."""

    def maker():
        def run(_, sig, n, f):
            sig, at = np.unique(sig, return_index=True)
            if len(sig) < 2:
                return None
            found = Sketches(n[at], [f[k] for k in at], percent).clusters()
            if not found:
                return None
            return [np.concatenate([np.full(len(g), sig[g].min()) for g in found]), np.concatenate([sig[g] for g in found])]

        return run

    return by_group(rows.select("cell", "sig", "n", "f"), maker, "cell long, sig long")


def marked(values: DataFrame, bits: int) -> np.ndarray:
    """A bit map of fixed size with the low bits of the numbers of a column, joined by blocks in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(bits, bool)
        for batch in batches:
            out[batch.column(0).to_numpy() & (bits - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([packed(np.packbits(out))], pa.binary())], names=["m"])

    return folded(values.mapInArrow(run, "m binary"), bits // 8, np.uint8, np.bitwise_or)


def group_links(docs: DataFrame, members: DataFrame, words: int, percent: int, bits: int = 1 << 24) -> DataFrame:
    """``a, b``: every set that is linked, and the smallest one of its linked group within a cell. ``members``: ``cell, sig,
    th``, the text's hash by which a set's text is found in ``docs`` (``_t``). Texts that a bit map of these hashes rules out
    are not read on; the map has one size at all scales, and a full one rules out nothing."""
    wanted = stored(members.groupBy("sig", "th").agg(F.collect_set("cell").alias("in")))
    some = docs.sparkSession.sparkContext.broadcast(marked(wanted.select("th"), bits))

    def loader():
        seen: set[int] = set()

        def run(batch: pa.RecordBatch):
            at = batch.column("_h").to_numpy() & (bits - 1)
            batch = batch.filter(pa.array((some.value[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)))
            sets = [(_sig(s), s) for s in shingle_sets(batch.column("_t").to_pylist(), words) if len(s)]
            fresh = {g: s.tobytes() for g, s in sets if g not in seen}
            seen.update(fresh)
            return [list(fresh), list(fresh.values())] if fresh else None

        return run

    source = docs.select("_t", F.xxhash64("_t").alias("_h")).filter(F.col("_t").isNotNull())
    sets = map_batches(source, loader, "sig long, s binary", BATCH).join(wanted.select("sig", "in").hint("merge"), "sig")
    sets = sets.select(F.explode("in").alias("cell"), "sig", "s")

    def solver():
        def run(_, sig, raw):
            sig, at = np.unique(sig, return_index=True)
            if len(sig) < 2:
                return None
            root = Cell([np.frombuffer(raw[k], np.uint64) for k in at], percent).solve()
            some = np.flatnonzero(root != np.arange(len(sig)))
            return [sig[some], sig[root[some]]] if len(some) else None

        return run

    return by_group(sets, solver, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``v, c``: of every vertex of the edges ``a, b``, the least vertex that it reaches."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter(F.col("a") != F.col("b")).distinct())
    state = stored(both.groupBy(F.col("a").alias("v")).agg(F.least("v", F.min("b")).alias("c")))
    while True:
        near = both.join(state.select(F.col("v").alias("b"), F.col("c").alias("d")), "b").groupBy(F.col("a").alias("v")).agg(F.min("d").alias("d"))
        step = stored(state.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "d").alias("c")))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("to"))
        nxt = stored(step.join(jump, "c", "left").select("v", "old", F.least("c", "to").alias("c")))
        state = nxt.select("v", "c")
        if nxt.filter(F.col("c") != F.col("old")).isEmpty():
            return state


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, percent: int = 85, cell_sets: int = 8192, group_shingles: int = 4_000_000, hot_sets: int = 200_000) -> DataFrame:
    """``key, n_shingles, component_id`` for every row: two rows are linked when their sets' similarity is at least
    ``percent`` hundredths, and ``component_id`` is the smallest id reachable by links. The sizes bound what one task
    holds; they don't change results."""
    rows, counts = class_rows(docs, text, key, words)
    classes = rows.filter("n > 0").groupBy("sig").agg(F.min("_k").alias("rep"), F.max("n").alias("n"), F.min("th").alias("th"), F.count("*").alias("rows"))

    # 1. pivots and cells. Rare: no more than a cell's share of all sets and its noise
    usual = counts.mean() + 4 * np.sqrt(counts.mean()) + 16
    heat = np.concatenate([np.log2(np.maximum(1, c / usual)).astype(np.int8) for c in np.split(counts, 64)])
    del counts
    hot = int(np.ceil(np.log2(max(2, hot_sets / usual))))
    any_hot = bool((heat >= hot).any())
    heat = docs.sparkSession.sparkContext.broadcast(heat)  # one byte a cell
    members = cells(windows(docs, heat, text, words, percent, hot), percent, any_hot)

    # 2. groups by sketches
    kept = stored(classes.join(members.select("sig").distinct(), "sig"))
    sketches = rows.join(kept.select("sig", "th").hint("merge"), ["sig", "th"]).select("sig", "n", "f").dropDuplicates(["sig"])
    groups = stored(close_groups(tiled(members.join(sketches, "sig"), F.lit(1), cell_sets), percent).distinct())

    # 3. links within groups
    sized = groups.join(kept.select("sig", "th", "n"), "sig")
    edges = group_links(docs.select(F.col(text).alias("_t")), tiled(sized, F.col("n"), group_shingles), words, percent)

    # 4. components of sets, and their smallest ids
    named = components(edges).join(classes.select(F.col("sig").alias("v"), "rep"), "v")
    least = named.groupBy("c").agg(F.min("rep").alias("least"))
    ids = named.join(least, "c").select(F.col("v").alias("sig"), "least")
    # rows that are alone name themselves; the others' names are stored, so that the join can split a group of many copies
    names = classes.join(ids, "sig", "left").filter("rows > 1 or least is not null").select("sig", F.coalesce("least", "rep").alias("component_id"))
    out = rows.withColumn("sig", F.when(F.col("n") > 0, F.col("sig"))).join(stored(names), "sig", "left")
    return out.select(F.col("_k").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "_k").alias("component_id"))


def op2(spark, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
