"""Lexical retrieval packing: documents that share rare terms fill windows together.

Documents are tokenized where they are read and dealt to shards by lexical affinity: each term draws a weight by hash, in
favour of rare terms, and a document's key is the terms of its least draws, so that two documents have the same key as often
as their rare terms overlap. Sorted by these keys, neighbours in the corpus are neighbours in the order, and each
``shard_docs`` documents in a row are a shard; a key that very many documents have, as a group of copies, fills as many
shards as it takes. Each shard builds a BM25 inverted index of its documents. A window starts with a seed (what is left of
a cut document, else the next unused one); the seed's terms query the index, and its unused neighbours fill the window in
the order of their scores, the last one cut where the window ends. A window that a shard leaves open goes on in the next
one of the task; the last one is cut into sequences of powers of two, which need no padding. All other sequences are full.

Defined results: a null or empty text is a document of the end token alone. Repeated rows are packed each for itself; ties
go by id, then by tokens. An empty table gives no sequence. A document longer than a window, however long, fills windows by
itself first. Only id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import base64
import bisect
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_batches, read, released

WINDOW, END = 2048, 1
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class PieceTokenizer:
    """Byte-level BPE ids as bytes (16-bit, little-endian), with a bounded memory of the pieces between spaces.

    Pre-tokens never span from a visible character to white space, so a text is the sum of its pieces at single spaces;
    a text with any other white space next to a space is encoded as a whole. ``added`` tokens (their ids by content) are
    split off first, wherever they stand; without them, their strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, most: int = 1_000_000, added: dict[str, int] | None = None):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.added = {a: np.uint16(i).tobytes() for a, i in (added or {}).items()}
        self.splitter = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        if max([*ranks.values(), *(added or {}).values()]) >= 1 << 16:
            raise ValueError("ids of over 16 bits are not supported")
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most = most
        self._clear()

    kept: tuple | None = None  # a worker's last one: its tasks share the memory of pieces

    @classmethod
    def of(cls, path: str, pattern: str, added: dict[str, int] | None) -> PieceTokenizer:
        name = (path, pattern, tuple(sorted((added or {}).items())))
        if cls.kept is None or cls.kept[0] != name:
            cls.kept = (name, cls(path, pattern, added=added))
        return cls.kept[1]

    def _clear(self) -> None:
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def raw(self, text: str) -> bytes:
        return array("H", self.encoding.encode_ordinary(text)).tobytes()

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not any(a in text for a in self.added):
            return self._plain(text)
        out, at = [], 0
        for m in self.splitter.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m.group()]]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self.later) + len(self.first) > self.most:
            self._clear()
        head, *rest = text.split(" ")
        try:
            return self.first[head] + b"".join(map(self.later.__getitem__, rest))
        except KeyError:
            return self.raw(text)


class _Pieces(dict):
    def __init__(self, tokenizer: PieceTokenizer, space: str):
        self.tokenizer, self.space = tokenizer, space

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise KeyError(piece)
        ids = self.tokenizer.raw(self.space + piece)
        if len(piece) <= 256:
            self[piece] = ids
        return ids


class Index:
    """BM25 over the token ids of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        n = len(docs)
        terms, rows, tf = [], [], []
        for i, ids in enumerate(docs):
            t, c = np.unique(ids, return_counts=True)
            terms.append(t)
            rows.append(np.full(len(t), i, np.int32))
            tf.append(c)
        self.terms = terms
        term, row, tf = np.concatenate(terms), np.concatenate(rows), np.concatenate(tf).astype(float)
        length = np.array([len(x) for x in docs], float)
        order = np.argsort(term, kind="stable")
        term, row, tf = term[order].astype(np.int64), row[order], tf[order]
        self.starts = np.searchsorted(term, np.arange(int(term[-1]) + 2))
        df = np.diff(self.starts)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = k1 * (1 - b + b * length / length.mean())
        self.rows, self.weights, self.n = row, idf[term] * tf * (k1 + 1) / (tf + norm[row]), n
        self.kept = n

    def drop(self, used: np.ndarray) -> None:
        """Take out the postings of ``used`` documents once they are half of those there: no other score changes."""
        left = len(used) - int(used.sum())
        if 2 * left > self.kept:
            return
        stay = ~used[self.rows]
        self.starts = np.concatenate([[0], np.cumsum(stay)])[self.starts]
        self.rows, self.weights, self.kept = self.rows[stay], self.weights[stay], left

    def scores(self, seed: int) -> np.ndarray:
        """Every document's score for the terms of document ``seed``."""
        t = self.terms[seed]
        low, size = self.starts[t], self.starts[t + 1] - self.starts[t]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.rows[at], self.weights[at], self.n)


def pack(docs: list[np.ndarray], window: int = WINDOW, carried: list[tuple[int, int, int]] | None = None, last: bool = True) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, length, sequence, offset) that hold every id of the documents once, and the pieces (document,
    start, length) of a window that is still open (none at the ``last`` call). ``carried`` are those of the call before."""
    if not docs:
        return [], []
    index = Index(docs)
    used = np.zeros(len(docs), bool)
    sizes = [len(x) for x in docs]
    out: list[tuple[int, int, int, int, int]] = []
    sequence, filled, open_pieces = 0, 0, []
    for doc, start, length in carried or []:
        open_pieces.append((doc, start, length, 0, filled))
        filled += length
    cut: tuple[int, int] | None = None  # a document and where it goes on
    nxt = 0

    def put(doc: int, start: int) -> int | None:
        """Fill the window from ``start``; where the document was cut, if it was."""
        nonlocal sequence, filled, open_pieces
        length = min(sizes[doc] - start, window - filled)
        open_pieces.append((doc, start, length, sequence, filled))
        filled += length
        if filled == window:
            out.extend(open_pieces)
            sequence, filled, open_pieces = sequence + 1, 0, []
        return start + length if start + length < sizes[doc] else None

    while True:
        if cut is not None:
            doc, start = cut
        else:
            while nxt < len(docs) and used[nxt]:
                nxt += 1
            if nxt == len(docs):
                break
            doc, start = nxt, 0
            used[doc] = True
        while start is not None:
            start = put(doc, start)
            if filled:
                break
        cut = None if start is None else (doc, start)
        if filled == 0 or cut is not None:
            continue
        left = np.flatnonzero(~used)
        if len(left):
            index.drop(used)
            s = index.scores(doc)[left]
            for other in left[np.argsort(-s, kind="stable")]:
                used[other] = True
                rest = put(int(other), 0)
                if filled == 0:
                    cut = None if rest is None else (int(other), rest)
                    break
    if not last:
        return out, [p[:3] for p in open_pieces]
    # what is left goes to sequences of powers of two
    total = filled
    for doc, start, length, _, _ in open_pieces:
        while length:
            part = 1 << (total.bit_length() - 1)
            take = min(length, part - (filled - total))
            out.append((doc, start, take, sequence, filled - total))
            start, length, filled = start + take, length - take, filled + take
            if filled - total == part:
                sequence, total, filled = sequence + 1, total - part, total - part
    return out, []


KEYS = 3
VOCABULARY = 1 << 16


def draws(seed: int = 11) -> np.ndarray:
    """A draw for each term, the less the rarer: exponential, at a rate of the term's number, since merges of byte pairs
    are numbered from the most frequent on."""
    u = np.random.Generator(np.random.PCG64(seed)).random(VOCABULARY)
    return -np.log1p(-u) / (1 + np.arange(VOCABULARY))


def affinity(ids: np.ndarray, draw: np.ndarray) -> list[int]:
    """The terms of a document's least draws in order (-1 where it has no more)."""
    terms = np.unique(ids)
    best = terms[np.argsort(draw[terms], kind="stable")[:KEYS]].tolist() if len(terms) <= 64 else _least(terms, draw)
    return best + [-1] * (KEYS - len(best))


def _least(terms: np.ndarray, draw: np.ndarray) -> list[int]:
    w = draw[terms]
    some = np.argpartition(w, KEYS)[:KEYS]
    return terms[some[np.argsort(w[some], kind="stable")]].tolist()


def ranges(docs: DataFrame, encode: Callable[[DataFrame, list], DataFrame], sample_rows: int, range_docs: int) -> list[tuple]:
    """The bounds that cut the order of keys into ranges of about ``range_docs`` documents, five sampled rows each at least."""
    n = docs.count()
    if n <= range_docs:
        return []
    rows = encode(docs.sample(min(1.0, sample_rows / n), 7), []).select(*PLACES, "_c", "_u")
    keys = sorted(map(tuple, rows.collect()))
    parts = min(-(-n // range_docs), max(1, len(keys) // 5))
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)})


PLACES = [f"_a{i}" for i in range(KEYS)]


def dealt(docs: DataFrame, tokenizer: str, pattern: str, text: str, key: str, end: int, added: dict[str, int] | None, sample_rows: int, range_docs: int) -> DataFrame:
    """``range`` (its number), PLACES, ``_c, _u`` (the rest of the order), ``_k`` and ``ids``."""
    kind = docs.schema[key].dataType.simpleString()

    def encode(rows: DataFrame, bounds: list[tuple]) -> DataFrame:
        def encoder():
            encode = PieceTokenizer.of(tokenizer, pattern, added)
            last, draw = np.uint16(end).tobytes(), draws()

            def run(batch: pa.RecordBatch):
                ids = [encode(t) + last for t in batch.column("_t").to_pylist()]
                keys = np.array([affinity(np.frombuffer(x, np.uint16), draw) for x in ids], np.int32).reshape(-1, KEYS)
                crc = list(map(zlib.crc32, ids))
                at = [bisect.bisect_right(bounds, k) for k in zip(*keys.T.tolist(), crc, batch.column("_u").to_pylist(), strict=True)]
                return [at, *keys.T, crc, batch.column("_u"), batch.column("_k"), ids]

            return run

        rows = rows.select(F.col(key).alias("_k"), F.xxhash64(F.col(key)).alias("_u"), F.col(text).alias("_t"))
        return map_batches(rows, encoder, f"range int, {', '.join(f'{c} int' for c in PLACES)}, _c long, _u long, _k {kind}, ids binary")

    return encode(docs, ranges(docs.select(key, text), encode, sample_rows, range_docs))


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, text: str = "text", key: str = "doc_id", shard_docs: int = 512, end: int = END, added: dict[str, int] | None = None, sample_rows: int = 5_000, range_docs: int = 4096) -> DataFrame:
    """``key`` and the columns of SCHEMA, a row a piece. A task streams the shards of its ranges."""
    kind = docs.schema[key].dataType.simpleString()
    rows = dealt(docs, tokenizer, pattern, text, key, end, added, sample_rows, range_docs)
    rows = rows.repartition("range").sortWithinPartitions("range", *PLACES, "_c", "_u", "_k").select("_k", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 20
        held: list[tuple] = []
        open_rows: list[tuple] = []
        open_pieces: list[tuple[int, int]] = []

        def packed(rows: list[tuple], last: bool) -> pa.RecordBatch:
            nonlocal open_rows, open_pieces
            rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            n, rows = len(rows), rows + open_rows
            arrays = [np.frombuffer(x, np.uint16) for _, x in rows]
            pieces, left = pack(arrays[:n], carried=[(n + i, s, size) for i, (s, size) in enumerate(open_pieces)], last=last)
            open_rows, open_pieces = [rows[d] for d, _, _ in left], [(s, size) for _, s, size in left]
            crc = [zlib.crc32(arrays[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
            d, s, n, q, o = zip(*pieces, strict=True) if pieces else [()] * 5
            columns = [[rows[i][0] for i in d], s, n, crc, [len(arrays[i]) for i in d], [(number << 20) + x for x in q], o]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind_of] + [pa.int64()] * 6, strict=True)], names=["_k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind_of = batch.schema.field("_k").type
            held += zip(batch.column("_k").to_pylist(), batch.column("ids").to_pylist(), strict=True)
            while len(held) >= 2 * shard_docs:
                yield packed(held[:shard_docs], False)
                held, number = held[shard_docs:], number + 1
        while held:
            size = len(held) if len(held) <= shard_docs + shard_docs // 2 else shard_docs
            yield packed(held[:size], size == len(held))
            held, number = held[size:], number + 1
        released()

    return rows.mapInArrow(shards, f"_k {kind}, {SCHEMA}").withColumnRenamed("_k", key)


def public_tokenizer() -> tuple[str, str]:
    """The ranks of the public 50k byte-level vocabulary (the ids of its tokenizers file) and its pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_added() -> dict[str, int]:
    """The added tokens of its tokenizers file: their ids by content."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t[k] for t in tokens for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that take spaces, whole words or normalised text are not supported")
    return {t["content"]: t["id"] for t in tokens}


def op4(spark, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), *public_tokenizer(), added=public_added())
