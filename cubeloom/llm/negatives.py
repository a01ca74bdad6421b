"""Hard-negative mining over a vantage-point tree of norm-augmented vectors.

Every vector gets one more component that brings its length to the largest length R of all; a query's is 0. The squared
distance of a query q and a row x is then q² + R² - 2qx, so that high scores are near rows and a window of scores is an
annulus of distances. A vantage-point tree holds rows by their distance to chosen rows; the triangle inequality bounds the
distances from a query to all rows of a node. The traversal is incremental: a heap holds nodes by their least distance inside
the annulus and rows by their exact score, so that rows come out nearest first, and it ends with the k-th row asked for.

Equal vectors of one label are one row of the tree with their ``k`` least ids, cut to that by a window with a limit a task
before the shuffle: more than k of a group can't be among the first k. The upper levels of the tree are fitted on a bounded
sample (``sample_rows``); its leaves deal all rows to groups (large leaves to several, by hash, of about ``group_rows``), and
each group has the lower levels of its own. A query goes to the groups that its annulus meets: positives first to the group
of the anchor's own leaf, whose fifth score then bounds the ball; negatives likewise. Queries stream past a group's tree, so
that a task holds one group and one batch. What groups find is cut to the first rows of an anchor (a positive) by a window.

Defined results: rows with a null label, a null vector or a null or non-finite component take no part; nor do components of
2**20 or more in size, whose scores would not fit 64 bits. Shorter vectors are filled up with zeros. A null id is no anchor
and comes after all others. Repeated rows are rows of their own: a copy of the anchor can be its positive, and a repeated
anchor gives its rows again. Ties go by id, equal ids are all given. An empty table, one label, or anchors without positives
give no rows. Only the three columns are read, whatever others are named.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import map_batches, read, released, ship, stored

#: What rounding of distances may add up to, at the least and by share.
SLACK = 1e-6
#: Rows of a leaf of a group's tree, whose scores are computed together.
BUCKET = 256
#: Below this squared length sums of products are whole numbers in double precision.
EXACT = 1 << 52
NO_ID = (1 << 63) - 1


def augmented(v: np.ndarray, r2: int) -> np.ndarray:
    """Rows with the component that brings their squared length to ``r2``."""
    v = v.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(0.0, r2 - (v * v).sum(axis=1)))[:, None]], axis=1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, ((x - y) ** 2).sum(axis=-1)))


class Upper:
    """The upper levels: ``2**depth`` leaves, numbered by the sides taken at vantage points (row i of a heap-ordered array)."""

    def __init__(self, sample: np.ndarray, r2: int, depth: int, seed: int = 5):
        self.r2, self.depth = r2, depth
        n = (1 << depth) - 1
        width = sample.shape[1] + 1
        self.points, self.radii = np.zeros((n, width)), np.zeros(n)
        rng, parts = np.random.Generator(np.random.PCG64(seed)), {0: augmented(sample, r2)}
        for i in range(n):
            rows = parts.pop(i)
            if len(rows):
                self.points[i] = rows[rng.integers(len(rows))]
                d = distances(rows, self.points[i])
                self.radii[i] = np.median(d)
                inside = d <= self.radii[i]
            else:
                inside = np.zeros(0, bool)
            if 2 * i + 1 < n:
                parts[2 * i + 1], parts[2 * i + 2] = rows[inside], rows[~inside]

    def leaf(self, v: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        x, at = augmented(v, self.r2), np.zeros(len(v), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (distances(x, self.points[at]) > self.radii[at])
        return at - ((1 << self.depth) - 1)

    def meet(self, v: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Whether each leaf (columns) can hold rows at distances ``near`` to ``far`` from each query."""
        q = np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1)
        alive = np.ones((len(v), 1), bool)
        slack = SLACK * (1 + np.sqrt(self.r2))
        for level in range(self.depth):
            nodes = np.arange((1 << level) - 1, (2 << level) - 1)
            d = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1)[:, None] + (self.points[nodes] ** 2).sum(axis=1) - 2 * q @ self.points[nodes].T))
            r = self.radii[nodes]
            inside = (d - r <= far[:, None] + slack) & (d + r >= near[:, None] - slack)
            outside = r - d <= far[:, None] + slack
            alive = np.stack([alive & inside, alive & outside], axis=2).reshape(len(v), -1)
        return alive


class Tree:
    """A group's tree: rows sorted by node; a node has its rows' range, its vantage point and its children's distances to it."""

    def __init__(self, ids: list[list[int]], labels: np.ndarray, v: np.ndarray, r2: int, seed: int = 7):
        x, rng = augmented(v, r2), np.random.Generator(np.random.PCG64(seed))
        order, self.nodes, todo = np.arange(len(v)), [], [(0, len(v), None)]
        while todo:
            a, b, parent = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent[0]][2].append((at, parent[1], parent[2]))
            rows = order[a:b]
            node: tuple = (a, b, [], None)
            if b - a > BUCKET:
                point = int(rows[rng.integers(len(rows))])
                d = distances(x[rows], x[point])
                by = np.argsort(d, kind="stable")
                order[a:b], d, m = rows[by], d[by], (b - a) // 2
                node = (a, b, [], point)
                todo += [(a, a + m, (at, d[0], d[m - 1])), (a + m, b, (at, d[m], d[-1]))]
            self.nodes.append(node)
        self.kind = np.float64 if r2 < EXACT else np.int64
        self.ids, self.labels, self.v, self.r2 = [ids[i] for i in order], labels[order], v[order].astype(self.kind), r2
        self.points = {i: v[n[3]].astype(self.kind) for i, n in enumerate(self.nodes) if n[3] is not None}
        self.slack = SLACK * (1 + float(np.sqrt(r2)))

    def query(self, q: np.ndarray) -> Query:
        return Query(self, q)


class Query:
    """One query's scores and distances in a tree, computed where the traversal comes."""

    def __init__(self, tree: Tree, q: np.ndarray):
        self.tree, self.q = tree, q.astype(tree.kind)
        self.base = int(self.q @ self.q) + tree.r2
        self.scores: dict[int, np.ndarray] = {}
        self.near: dict[int, float] = {}

    def distance(self, score) -> float:
        return float(np.sqrt(max(0.0, float(self.base - 2 * score))))

    def _to_point(self, node: int) -> float:
        if node not in self.near:
            self.near[node] = self.distance(int(self.tree.points[node] @ self.q))
        return self.near[node]

    def rows(self, k: int, low: int | None, high: int | None, same: bool, label: int) -> Iterator[tuple[int, int]]:
        """``(score, row)`` of the rows with scores in the window and a label that is ``label`` (or is not), highest first: the
        first ``k`` and all that tie with the last of them."""
        t, slack = self.tree, self.tree.slack
        start = 0.0 if high is None else self.distance(high)
        end = np.inf if low is None else self.distance(low)
        heap: list[tuple] = [(0.0, 0, 0, 0)]
        seen: list[int] = []  # the k best scores so far, as a heap
        while heap:
            _, kind, minus, at = heapq.heappop(heap)
            if kind:
                yield -minus, at
                continue
            a, b, children, point = t.nodes[at]
            if point is not None:
                d = self._to_point(at)
                for child, least, most in children:
                    low_d = max(start - slack, d - most - slack, least - d - slack, 0.0)
                    if low_d <= end + slack and d + most >= start - slack:
                        heapq.heappush(heap, (low_d, 0, 0, child))
                continue
            if at not in self.scores:
                self.scores[at] = t.v[a:b] @ self.q
            s = self.scores[at]
            ok = (t.labels[a:b] == label) == same
            if high is not None:
                ok &= s <= high
            if low is not None:
                ok &= s >= low
            if len(seen) == k:
                ok &= s >= seen[0]
            found = np.flatnonzero(ok)
            if len(found) > k:
                found = found[s[found] >= np.partition(s[found], -k)[-k]]
            for i in found.tolist():
                score = int(s[i])
                heapq.heappush(heap, (self.distance(score) + slack, 1, -score, a + i))
                if len(seen) < k:
                    heapq.heappush(seen, score)
                elif score > seen[0]:
                    heapq.heapreplace(seen, score)

    def first(self, k: int, low: int | None, high: int | None, same: bool, label: int, but: int | None = None) -> list[tuple[int, int]]:
        """The first ``k`` of ``(score, id)``, and all rows that tie with the last; one row of id ``but`` with the vector of
        the query is left out."""
        out: list[tuple[int, int]] = []
        # a row may be the query's own, which is left out
        for score, row in self.rows(k + (but is not None), low, high, same, label):
            if len(out) >= k and score < out[k - 1][0]:
                break
            ids = self.tree.ids[row]
            if but is not None and but in ids and np.array_equal(self.tree.v[row], self.q):
                ids = list(ids)
                ids.remove(but)
                but = None
            out += [(score, i) for i in ids]
            out.sort(key=lambda x: (-x[0], x[1]))
        return out[:k]


def clean(df: DataFrame, key: str, vector: str, label: str, relabel: Column | None) -> DataFrame:
    """``id, label, v`` of the rows that take part, components as integers."""
    x = F.col(vector)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(1 << 20)))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * 256).cast("int"))
    rows = df.filter(F.col(label).isNotNull() & x.isNotNull()).filter(fine)
    return rows.select(F.col(key).cast("long").alias("id"), (F.col(label) if relabel is None else relabel).cast("long").alias("label"), ints.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of a matrix, filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    out = np.zeros((len(column), width), np.int32)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


class Index:
    """Rows dealt to groups by the upper levels; ``searched`` joins queries with the groups that they meet."""

    def __init__(self, rows: DataFrame, keep: int, sample_rows: int, group_rows: int, depth: int):
        ids = Window.partitionBy("label", "v").orderBy(F.col("id").asc_nulls_last())
        few = rows.withColumn("_n", F.row_number().over(ids)).filter(F.col("_n") <= keep)
        few = few.groupBy("label", "v").agg(F.array_sort(F.collect_list(F.coalesce("id", F.lit(NO_ID)))).alias("ids"))
        square = F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c.cast("long"))
        self.rows = stored(few.withColumn("_s", square))
        size = self.rows.agg(F.count("*"), F.max("_s"), F.max(F.size("v"))).first()
        self.n, self.r2, self.width = size[0], size[1] or 0, max(1, size[2] or 1)
        part = self.rows.sample(min(1.0, sample_rows / max(1, self.n)), 3).select("v").limit(2 * sample_rows).toArrow().column(0).combine_chunks()
        self.upper = Upper(_matrix(part, self.width), self.r2, depth)
        leaves, salts, width = self._leaves(self.rows.select("label", "v", "ids"), "label long, v array<int>, ids array<long>"), {}, group_rows
        self.dealt = stored(leaves)
        for leaf, n in self.dealt.groupBy("leaf").count().collect():  # no more rows than leaves
            salts[leaf] = -(-n // width)
        self.salts = np.array([salts.get(i, 0) for i in range(1 << depth)])
        self.starts = np.cumsum(self.salts) - self.salts

    def _leaves(self, df: DataFrame, schema: str) -> DataFrame:
        upper, width, at = self.upper, self.width, df.columns.index("v")

        def make():
            return lambda batch: [upper.leaf(_matrix(batch.column(at), width)), *batch.columns]

        return map_batches(df, make, f"leaf long, {schema}")

    def _groups(self) -> DataFrame:
        salts, starts = (F.array(*map(F.lit, x.tolist())) for x in (self.salts, self.starts))
        at = F.col("leaf").cast("int")
        return self.dealt.withColumn("g", F.get(starts, at) + F.pmod(F.xxhash64("v", "label"), F.get(salts, at)))

    def searched(self, queries: DataFrame, home: bool) -> DataFrame:
        """``queries``: ``q`` (a number), ``id, label, v``, and windows ``w`` as ``(rank, low, high, k, same)``: rows found in the
        anchor's own leaf (``home``) or in all others that a window meets, as ``q, rank, score, found``."""
        upper, width, salts, starts, r2 = self.upper, self.width, self.salts, self.starts, self.r2
        kind = "q long, id long, label long, v array<int>, w array<struct<rank:int,low:long,high:long,k:int,same:boolean>>"

        def router():
            def run(batch: pa.RecordBatch):
                v = _matrix(batch.column("v"), width)
                own = upper.leaf(v)
                alive = np.zeros((len(v), len(salts)), bool)
                if home:
                    alive[np.arange(len(v)), own] = True
                else:
                    base = (v.astype(np.int64) ** 2).sum(axis=1) + r2
                    w = batch.column("w")
                    of, flat = np.repeat(np.arange(len(v)), w.value_lengths().to_numpy()), w.flatten()
                    low, high = (flat.field(c) for c in ("low", "high"))
                    bound = lambda c, of_null: np.where(c.is_null().to_numpy(zero_copy_only=False), of_null, np.sqrt(np.maximum(0.0, base[of] - 2.0 * c.fill_null(0).to_numpy())))
                    for i, hit in zip(of.tolist(), upper.meet(v[of], bound(high, 0.0), bound(low, np.inf)), strict=True):
                        alive[i] |= hit
                    alive[np.arange(len(v)), own] = False
                out = [[g for leaf in np.flatnonzero(a).tolist() for g in range(starts[leaf], starts[leaf] + salts[leaf])] for a in alive]
                return [*batch.columns, out]

            return run

        routed = map_batches(queries, router, f"{kind}, gs array<long>", 1_000_000).withColumn("g", F.explode("gs")).drop("gs")
        rows = self._groups().select("g", F.lit(0).alias("side"), "label", "v", "ids", F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(queries.schema["w"].dataType).alias("w"))
        asked = routed.select("g", F.lit(1).alias("side"), "label", "v", F.lit(None).cast("array<long>").alias("ids"), "q", "id", "w")
        both = rows.unionByName(asked).repartition("g").sortWithinPartitions("g", "side")
        ship(both.sparkSession)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, held, tree = None, [], None
            for batch in batches:
                g, side = batch.column("g").to_numpy(), batch.column("side").to_numpy()
                ends = np.flatnonzero((g[1:] != g[:-1]) | (side[1:] != side[:-1])) + 1
                out: list[tuple] = []
                for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(g)], strict=True):
                    part = batch.slice(a, b - a)
                    if g[a] != group:
                        group, held, tree = g[a], [], None
                    label, v = part.column("label").to_numpy(), _matrix(part.column("v"), width)
                    if side[a] == 0:
                        held.append((part.column("ids").to_pylist(), label, v))
                        continue
                    if tree is None and held:
                        tree = Tree([i for x, _, _ in held for i in x], np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held]), r2)
                        held = []
                    if tree is None:
                        continue
                    for q, i, mine, x, windows in zip(part.column("q").to_pylist(), part.column("id").to_pylist(), label.tolist(), v, part.column("w").to_pylist(), strict=True):
                        query = tree.query(x)
                        for w in windows:
                            found = query.first(w["k"], w["low"], w["high"], w["same"], mine, i if w["same"] else None)
                            out += [(q, w["rank"], s, f) for s, f in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["q", "rank", "score", "found"])
            del tree, held
            released()

        return both.mapInArrow(search, "q long, rank int, score long, found long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each query's window, numbered."""
    order = Window.partitionBy("q", "rank").orderBy(F.desc("score"), "found")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def mine(df: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", relabel: Column | None = None, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, sample_rows: int = 8192, group_rows: int = 65_536, depth: int = 6) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor (a row for which
    ``anchors``, a column of ``id``, holds) and each of its first ``positives`` of the same label, the first ``negatives`` of
    other labels with ``low`` to ``high`` hundredths of the positive's score."""
    rows = stored(clean(df, key, vector, label, relabel))
    index = Index(rows, max(negatives, positives + 1), sample_rows, group_rows, depth)
    distinct = rows.filter(anchors & F.col("id").isNotNull()).groupBy("id", "label", "v").agg(F.count("*").alias("times"))
    asked = stored(distinct.withColumn("q", F.monotonically_increasing_id()))
    window = lambda rank, lo, hi, k, same: F.struct(F.lit(rank).cast("int").alias("rank"), lo.cast("long").alias("low"), hi.cast("long").alias("high"), F.lit(k).cast("int").alias("k"), F.lit(same).alias("same"))
    none, columns = F.lit(None), ["q", "id", "label", "v", "w"]

    at_home = stored(index.searched(asked.withColumn("w", F.array(window(0, none, none, positives, True))).select(columns), True))
    least = _first(at_home, positives).filter(F.col("n") == positives).select("q", F.col("score").alias("least"))
    ball = asked.join(least, "q", "left").withColumn("w", F.array(window(0, F.col("least"), none, positives, True)))
    near = stored(_first(at_home.unionByName(index.searched(ball.select(columns), False)), positives))

    # 100 s >= low p and 100 s <= high p in whole numbers
    bounds = near.filter(F.col("score") >= 0).select("q", F.col("n").alias("rank"), F.expr(f"(score * {low} + 99) div 100").alias("lo"), F.expr(f"(score * {high}) div 100").alias("hi"))
    bounds = stored(bounds.filter(F.col("lo") <= F.col("hi")))
    struct = F.struct(F.col("rank").cast("int").alias("rank"), F.greatest("lo", F.coalesce("least", "lo")).alias("low"), F.col("hi").alias("high"), F.lit(negatives).alias("k"), F.lit(False).alias("same"))

    def windows(b: DataFrame) -> DataFrame:
        w = b.groupBy("q").agg(F.sort_array(F.collect_list(struct)).alias("w"))  # no more than the positives
        return asked.join(w, "q").select(columns)

    at_home = stored(index.searched(windows(bounds.withColumn("least", F.lit(None).cast("long"))), True))
    least = _first(at_home, negatives).filter(F.col("n") == negatives).select("q", "rank", F.col("score").alias("least"))
    away = index.searched(windows(bounds.join(least, ["q", "rank"], "left")), False)
    found = _first(at_home.unionByName(away), negatives)

    positive = near.select("q", F.col("n").alias("rank"), F.col("found").alias("positive"), F.col("score").alias("p"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    out = found.join(positive, ["q", "rank"]).join(asked.select("q", "id", "times"), "q").withColumn("_t", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select(F.col("id").alias("anchor_id"), real("positive").alias("positive_id"), F.col("n").cast("int").alias("rank"), real("found").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def op13(spark, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel=shifted)


SQL = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.id AS aid, b.r, b.id, a.label = b.label AS same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5)
SELECT p.aid AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.id) <= 10
"""
