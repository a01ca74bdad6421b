"""Cross-tokenizer alignment: how the tokens of two tokenizers cover the same bytes.

Each text is encoded by a byte-level tokenizer (A) and a sentence-piece tokenizer (B). A merge of the cumulative byte ends
of their tokens, both sorted, cuts the text into groups where both end, and every A-B pair of occurrences in a group is a
link. Neither tokenizer joins a visible character with a following space, so that a text is the sequence of its segments
(spaces and what follows them up to the next space after a visible character), and tokens and groups end where segments do:
a task merges each distinct segment once, in a memory of bounded size, and a text sums up its segments.

Each document is written once with its distinct pairs and their multiplicities. A pair of ids counts the documents that hold
it linked (Spark's aggregation by pair, with sums a task); maxima a side (no more rows than a vocabulary) are joined back to
the pairs. Documents get the counts in two ways. Of the pairs, those with over 1 / ``most_hot`` of all incidences are fewer
than ``most_hot`` whatever the corpus; these are sent to the tasks, so that no hot pair is a join's key. All other pairs of
a document are rows joined by pair and summed up a document.

Defined results: null and empty texts, and texts whose tokens' bytes are not a space and the text, have no tokens: zeros and
an empty digest. Special tokens' strings are plain text. Very long texts and segments are aligned whole; a segment's links
are kept as distinct pairs with multiplicities. Ties: all pairs of the highest count are best. Repeated rows are documents
of their own; an empty table gives no rows. Only id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_batches, read, stored

#: Bits of a B id in a pair's number, and of a pair's number.
SHIFT, BITS = 20, 40
MASK = (1 << SHIFT) - 1
#: Segments with a larger group (numbers of both sides' tokens multiplied) are counted by themselves.
LARGE = 4096


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i] .. starts[i] + sizes[i] - 1`` of all i in a row."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def group_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The ends that both sides have; both are sorted, none repeats."""
    at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
    return ends_a[ends_b[at] == ends_a]


def links(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The distinct pairs of a group's tokens and how often each is there."""
    of_a, of_b = Counter(a), Counter(b)
    return [x << SHIFT | y for x in of_a for y in of_b], [n * m for n in of_a.values() for m in of_b.values()]


class Aligner:
    """Segments numbered by the text after their first space, and what each adds to its texts: numbers of tokens and groups,
    the groups as text, its linked pairs. ``bad`` ones have tokens of other bytes; ``odd`` ones can't stand before another."""

    kept: tuple | None = None  # a worker's last one: its tasks share the memory of segments

    def __init__(self, path_a: str, pattern: str, path_b: str, most: int = 300_000):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        with open(path_a, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=path_b)
        piece, of_a = self.b.id_to_piece, {i: t for t, i in ranks.items()}
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("\u2581", " ").encode() for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, t))) for t in ([of_a.get(i, b"") for i in range(max(of_a) + 1)], self.bytes_b))
        self.decimal = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        if len(self.decimal) > MASK:
            raise ValueError(f"ids of over {SHIFT} bits are not supported")
        if any("\u2581" in piece(i).lstrip("\u2581") for i in range(len(self.bytes_b))):
            raise ValueError("pieces that span a visible character and a following space are not supported")
        self.most = most
        self._clear()

    @classmethod
    def of(cls, *paths: str) -> Aligner:
        if cls.kept is None or cls.kept[0] != paths:
            cls.kept = (paths, cls(*paths))
        return cls.kept[1]

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.n_a, self.n_b, self.n_groups, self.starts, self.sizes, self.pairs, self.times = (array("q") for _ in range(7))
        self.bad, self.odd = array("b"), array("b")

    def _same(self, flat: np.ndarray, n: np.ndarray, raws: list[bytes]) -> np.ndarray:
        """Whether each segment's B tokens have its bytes (those of A always do)."""
        ends = np.concatenate([[0], np.cumsum(n)])
        sizes = np.concatenate([[0], np.cumsum(self.size_b[flat])])[ends]
        found = b"".join(map(self.bytes_b.__getitem__, flat.tolist()))
        if found == b"".join(raws):
            return np.diff(sizes) == np.fromiter(map(len, raws), np.int64, len(raws))
        return np.array([found[i:j] == r for i, j, r in zip(sizes[:-1].tolist(), sizes[1:].tolist(), raws, strict=True)])

    def _add(self, rests: list[str]) -> None:
        """Align new segments."""
        segments = [" " + r for r in rests]
        a, b = list(map(self.a.encode_ordinary, segments)), self.b.encode(rests, num_threads=1)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        del a, b
        good = self._same(flat_b, n_b, [s.encode() for s in segments])
        if not good.all():
            flat_a, flat_b = flat_a[np.repeat(good, n_a)], flat_b[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        n_groups, sizes, slow, base, texts = np.zeros(len(rests), np.int64), np.zeros(len(rests), np.int64), [], len(self.pairs), []
        if len(flat_a):
            ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
            cuts = group_ends(ends_a, ends_b)
            full = np.flatnonzero(n_a)
            segment = full[np.searchsorted(ends_a[np.cumsum(n_a)[full] - 1], cuts)]
            to_a, to_b = np.searchsorted(ends_a, cuts) + 1, np.searchsorted(ends_b, cuts) + 1
            from_a, from_b = np.concatenate([[0], to_a[:-1]]), np.concatenate([[0], to_b[:-1]])
            counts = (to_a - from_a) * (to_b - from_b)
            n_groups = np.bincount(segment, minlength=len(rests))
            slow = np.unique(segment[counts > LARGE]).tolist()
            counts[np.isin(segment, slow)] = 0
            sizes = np.bincount(segment, counts, len(rests)).astype(np.int64)
            within, wide = spread(np.zeros(len(cuts), np.int64), counts), np.repeat(to_b - from_b, counts)
            x, y = flat_a[np.repeat(from_a, counts) + within // np.maximum(wide, 1)], flat_b[np.repeat(from_b, counts) + within % np.maximum(wide, 1)]
            self.pairs.frombytes((x << SHIFT | y).tobytes())
            self.times.frombytes(np.ones(len(x), np.int64).tobytes())
            text_a, text_b = (list(map(self.decimal.__getitem__, f.tolist())) for f in (flat_a, flat_b))
            ranges = zip(*(c.tolist() for c in (from_a, to_a, from_b, to_b)), strict=True)
            texts = [text_a[i] + "|" + text_b[k] if j - i == 1 == m - k else f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in ranges]
        first = len(self.texts)
        self.index.update(zip(rests, range(first, first + len(rests)), strict=True))
        ends = np.cumsum(n_groups)
        self.texts += [texts[j - 1] if j - i == 1 else ";".join(texts[i:j]) for i, j in zip((ends - n_groups).tolist(), ends.tolist(), strict=True)]
        for to, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.sizes, sizes), (self.starts, base + np.cumsum(sizes) - sizes)):
            to.frombytes(values.astype(np.int64).tobytes())
        self.bad.frombytes((~good).astype(np.int8).tobytes())
        self.odd.extend([not r or r[-1].isspace() for r in rests])
        for i in slow:
            self.starts[first + i] = len(self.pairs)
            for j in np.flatnonzero(segment == i).tolist():
                pairs, times = links(flat_a[from_a[j] : to_a[j]].tolist(), flat_b[from_b[j] : to_b[j]].tolist())
                self.pairs.extend(pairs)
                self.times.extend(times)
            self.sizes[first + i] = len(self.pairs) - self.starts[first + i]

    @staticmethod
    def _joined(parts: list[str]) -> list[str]:
        """Parts between spaces as segments: cut before a space only where a visible character stands, not at the text's end."""
        out = [parts[0]]
        for p in parts[1:]:
            if out[-1] and not out[-1][-1].isspace():
                out.append(p)
            else:
                out[-1] += " " + p
        if not out[-1] and len(out) > 1:
            out.pop()
            out[-1] += " "
        return out

    def _numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = set().union(*texts).difference(self.index)
        if new:
            self._add(list(new))
        return [np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts)) for parts in texts]

    def __call__(self, texts: list[str | None]) -> list:
        """``n_a, n_b, n_groups, n_links, groups, pairs, times`` of the texts; the last two as Arrow lists."""
        if len(self.index) > self.most or len(self.pairs) > 16 * self.most:
            self._clear()
        parts = [t.split(" ") if t else [] for t in texts]
        rows = self._numbers(parts)
        odd = np.frombuffer(self.odd, np.int8).copy()
        again = [i for i, r in enumerate(rows) if len(r) and (odd[r[:-1]].any() or not parts[i][-1])]
        for i, r in zip(again, self._numbers([self._joined(parts[i]) for i in again]), strict=True):
            rows[i] = r
        bad = np.frombuffer(self.bad, np.int8).copy()
        rows = [r if not len(r) or not bad[r].any() else r[:0] for r in rows]
        lengths = np.array(list(map(len, rows)), np.int64)
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])

        def total(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[ends[1:]] - sums[ends[:-1]]

        table = lambda x: np.frombuffer(x, np.int64).copy()
        sums = [total(table(x)[at], ends) for x in (self.n_a, self.n_b, self.n_groups)]
        sizes = table(self.sizes)[at]
        places = spread(table(self.starts)[at], sizes)
        keys = np.repeat(np.repeat(np.arange(len(rows)), lengths), sizes) << BITS | table(self.pairs)[places]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        times = np.add.reduceat(table(self.times)[places][order], first) if len(keys) else np.zeros(0, np.int64)
        keys = keys[first]
        cuts = np.searchsorted(keys, np.arange(len(rows) + 1) << BITS)
        digests = [hashlib.sha256(";".join(map(self.texts.__getitem__, r.tolist())).encode()).hexdigest() if len(r) else "" for r in rows]
        kind = pa.list_(pa.field("element", pa.int64()))
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(v), type=kind) for v in (keys & ((1 << BITS) - 1), times)]
        return [*sums, total(times, cuts), digests, *lists]


SUMS = "n_a long, n_b long, n_groups long, n_links long, groups string"


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``pair, n, best_a, best_b`` for every value of the lists ``pairs``: how many lists have it, and whether no pair of its A
    id (B id) is in more."""
    counts = pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.shiftright("pair", SHIFT)).withColumn("b", F.col("pair").bitwiseAND(F.lit(MASK))))
    # no more rows than a vocabulary has ids
    per_a = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("most_a")))
    per_b = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most_b")))
    joined = counts.join(per_a, "a").join(per_b, "b")
    return stored(joined.select("pair", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b")))


def align(docs: DataFrame, path_a: str, pattern: str, path_b: str, text: str = "text", key: str = "doc_id", most_hot: int = 100_000) -> DataFrame:
    """``key``, the columns of SUMS (``groups`` is a digest), ``best_a, best_b`` (links of the highest count of their A id and
    B id) and ``count_sum``, a row a document. ``path_a`` is a file of ranks."""
    kind = docs.schema[key].dataType.simpleString()

    def aligned():
        aligner = Aligner.of(path_a, pattern, path_b)
        return lambda batch: [batch.column(0), *aligner(batch.column(1).to_pylist())]

    lists = "pairs array<long>, times array<long>"
    rows = stored(map_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), aligned, f"_k {kind}, {SUMS}, {lists}", 2_000_000))
    counts = pair_counts(rows)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * most_hot > total
    hot = counts.filter(is_hot).sort("pair").toArrow()  # fewer than most_hot rows
    hot_pairs, *hot_values = (hot.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair", "best_a", "best_b", "n"))

    def counted():
        def run(batch: pa.RecordBatch):
            *kept, pairs, times = batch.columns
            flat, t = pairs.flatten().to_numpy(), times.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(hot_pairs, flat), max(0, len(hot_pairs) - 1))
            known = hot_pairs[at] == flat if len(hot_pairs) else np.zeros(len(flat), bool)
            ends = np.searchsorted(row[known], np.arange(batch.num_rows + 1))
            sums = [np.concatenate([[0], np.cumsum(t[known] * v[at[known]])]) for v in hot_values]
            cuts = pa.array(np.searchsorted(row[~known], np.arange(batch.num_rows + 1)), pa.int32())
            cold = [pa.ListArray.from_arrays(cuts, pa.array(v[~known]), type=pairs.type) for v in (flat, t)]
            return [*kept, *(s[ends[1:]] - s[ends[:-1]] for s in sums), *cold]

        return run

    found = map_batches(rows, counted, f"_k {kind}, {SUMS}, best_a long, best_b long, count_sum long, {lists}")
    found = stored(found.withColumn("_r", F.monotonically_increasing_id()))
    links = found.filter(F.size("pairs") > 0).select("_r", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_r", "x.pairs", "x.times")
    cold = links.join(counts.filter(~is_hot), F.col("pairs") == F.col("pair"))
    t = F.col("times")
    cold = cold.groupBy("_r").agg(F.sum(t * F.col("best_a").cast("long")).alias("_a"), F.sum(t * F.col("best_b").cast("long")).alias("_b"), F.sum(t * F.col("n")).alias("_n"))
    out = found.drop("pairs", "times").join(cold, "_r", "left")
    added = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return out.select(F.col("_k").alias(key), "n_a", "n_b", "n_groups", "n_links", "groups", added("best_a", "_a"), added("best_b", "_b"), added("count_sum", "_n"))


def op12(spark, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN, path

    # the ranks of byte_bpe_50k.json: the same ids
    found = align(read(spark, sf_dir, "documents"), path("byte_bpe_50k.tiktoken"), PATTERN, path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.col("best_a").alias("n_best"), "count_sum", F.col("groups").alias("groups_sha256"), F.col("best_b").alias("n_best_b"))
