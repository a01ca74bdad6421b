"""Exact substring dedup by suffix sorting.

A document loses each byte that a 50-byte string covers which also starts in a document of a smaller id. Suffixes are
sorted where a repeat is possible:

1. Groups. Texts are dealt by hash to groups of some megabytes, once, compressed; exact copies of a text of a smaller id are
   not among them (they go whole), nor texts of under 50 bytes (they stay). All that follows is summed up in a group
   before it is sent, so that a passage in very many texts sends a row a group.
2. Anchors. Of each 50-byte window, the 24-byte gram of the least hash is an anchor; equal windows have the same anchor
   at the same place. A group sends its distinct anchors to ranges of their hashes; a range finds those that several texts
   have, and tells the groups.
3. Contexts. Around each of its shared anchors, a group sends the 26 bytes before and the 50 bytes from it, equal
   contexts once with their smallest id.
4. Sorting. Contexts of an anchor are sorted to the right as suffixes and to the left reversed, by deep-shallow sorting.
   Cutting both orders at the prefix lengths j and 50 - j gives the classes of contexts that share the window starting
   j bytes before the anchor; the smallest id of each class goes back to the groups that sent the context.
5. Marks. A group's places of a context, which it sent to itself, are compared with these ids; where a smaller id has the
   window, it is covered, and what is covered is dropped.

Defined results: a null or empty text keeps its nothing. A text equal to one of a smaller id goes whole if it has 50 bytes.
Rows that share their id don't delete each other. A null id counts as larger than all others. Ids are integers; another
type of id is refused. A very long text is worked on in overlapping parts, with the same result. Ties: equal windows have
one smallest id. An empty table gives no row. Only id and text are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cubeloom.llm.common import pieces, read, released, stored
from cubeloom.llm.shingles import mixed
from cubeloom.llm.suffixes import deep_shallow
from cubeloom.session import ship

LENGTH, GRAM = 50, 24
LEFT = LENGTH - GRAM
SPAN = LENGTH - GRAM + 1
NO_ID = (1 << 63) - 1
BATCH = 1_000_000
_rng = np.random.Generator(np.random.PCG64(99))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_rng.integers(1 << 40, 1 << 62)) * 2 + 1


def _times(n: int) -> np.uint64:
    return np.uint64(pow(_STEP, n, 1 << 64))


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """The best of ``x[i : i + n]`` for every i that has n values."""
    out, size = x, 1
    while size * 2 <= n:
        out, size = best(out[: len(out) - size], out[size:]), size * 2
    return best(out[: len(x) - n + 1], out[n - size : n - size + len(x) - n + 1]) if size < n else out[: len(x) - n + 1]


def anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, the place and the hash of every anchor."""
    b = np.frombuffer(b"".join(raws), np.uint8)
    none = np.zeros(0, np.int64)
    if len(b) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    sizes = np.array([len(r) for r in raws])
    ends = np.cumsum(sizes)
    h = _BYTE[b]
    for n in (1, 2, 4):
        h = h[:-n] + h[n:] * _times(n)  # grams of 2, 4 and 8
    wide = h[:-8] + h[8:] * _times(8)
    h = mixed(wide[: len(b) - GRAM + 1] + h[16 : 16 + len(b) - GRAM + 1] * _times(16))
    del wide
    least = _sliding(h, SPAN, np.minimum)
    room = np.repeat(ends, sizes)[: len(least)] - np.arange(len(least))
    least[room < LENGTH] = 0  # such a window leaves its text
    del room
    # a gram is an anchor if it is the least of any window it is in; no such window has a larger least
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)])
    at = np.flatnonzero((_sliding(padded, SPAN, np.maximum) == h) & (h > 0))
    text = np.searchsorted(ends, at, side="right")
    # least hashes are small ones; mixed again, they are spread evenly over the ranges
    return text, at - (ends - sizes)[text], mixed(h[at])


def _packed(x: np.ndarray) -> bytes:
    """Sorted numbers as zstandard over the byte planes of their differences."""
    d = np.diff(x, prepend=x[:1] * 0)
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zs.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _text_anchors(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``anchors`` of texts of any length, hashes cut to 48 bits, in the order of texts and places. Long texts are cut
    to parts that share 49 bytes, so that each window is in one."""
    parts, sizes, out = [], 0, []

    def done() -> None:
        nonlocal parts, sizes
        if parts:
            part, place, h = anchors([raw for _, _, raw in parts])
            of = np.array([(t, s) for t, s, _ in parts], np.int64)
            out.append((of[part, 0], of[part, 1] + place, h >> np.uint64(16)))
        parts, sizes = [], 0

    for t, raw in enumerate(raws):
        for s in range(0, max(1, len(raw) - LENGTH + 1), BATCH):
            parts.append((t, s, raw[s : s + BATCH + LENGTH - 1]))
            sizes += len(parts[-1][2])
            if sizes >= BATCH:
                done()
    done()
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text, place, h = (np.concatenate(c) for c in zip(*out, strict=True))
    by = np.lexsort((place, text))
    text, place, h = text[by], place[by], h[by]
    once = np.concatenate([[True], (text[1:] != text[:-1]) | (place[1:] != place[:-1])]) if len(text) else np.zeros(0, bool)
    return text[once], place[once], h[once]


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers as zstandard over their byte planes."""
    x = np.ascontiguousarray(x)
    return zs.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()) if x.size else b""


def _grown(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zs.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1) if raw else np.zeros((size, 0), np.uint8)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _table(rows: list[list], names: str, kinds: list) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    released()
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names.split())


def _ranged(h: np.ndarray, ranges: int) -> np.ndarray:
    return (((h >> np.uint64(16)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of the runs of equal values."""
    heads = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return list(zip(heads.tolist(), [*heads[1:].tolist(), len(x)], strict=True)) if len(x) else []


def send_texts(base: DataFrame) -> DataFrame:
    """``pid, _o, _k, _h, _z, times``: the texts compressed, as they are shuffled, from rows ``pid, _o, _k, _h, _t``. What a
    task has more of a row of one id and text follows at its end as a number of times, without the text."""
    kind = base.schema["_o"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen, more = zs.ZstdCompressor(level=2), set(), {}
        schema = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([pa.field("pid", pa.int64()), batch.schema.field("_o"), pa.field("_k", pa.int64()), pa.field("_h", pa.binary()), pa.field("_z", pa.binary()), pa.field("times", pa.int64())])
            for part in pieces(batch, BATCH):
                rows = []
                for pid, o, k, h, t in zip(*(part.column(x).to_pylist() for x in ("pid", "_o", "_k", "_h", "_t")), strict=True):
                    if (k, h) in seen:
                        more[pid, o, k, h] = more.get((pid, o, k, h), 0) + 1
                    else:
                        seen.add((k, h))
                        rows.append((pid, o, k, h, c.compress(t.encode("utf-8", "surrogatepass")), 1))
                if rows:
                    yield out(rows)
        if more:
            yield out([(*key, None, n) for key, n in more.items()])
        released()

    ship(base.sparkSession)
    return base.mapInArrow(run, f"pid long, _o {kind}, _k long, _h binary, _z binary, times long")


def _texts(table: pa.Table, copies: list[bytes]) -> tuple[list[tuple], np.ndarray, list[bytes]]:
    """The distinct texts of a group by id and digest: (row's id, times, whether it is a copy), their ids, and those texts
    themselves that are no copies, which come first."""
    found: dict[tuple, list] = {}
    for o, k, h, z, n in zip(*(table.column(c).to_pylist() for c in ("_o", "_k", "_h", "_z", "times")), strict=True):
        row = found.setdefault((k, h), [o, 0, None])
        row[1] += n
        row[2] = row[2] or z
    gone = {raw[i : i + 24] for raw in copies for i in range(0, len(raw), 24)}
    order = sorted(((k.to_bytes(8, "big", signed=True) + h in gone, k, h) for k, h in found))
    inflate = zs.ZstdDecompressor().decompress
    rows = [(found[k, h][0], found[k, h][1], copy, found[k, h][2]) for copy, k, h in order]
    return rows, np.array([k for _, k, _ in order], np.int64), [inflate(z) for _, _, copy, z in rows if not copy]


def _of_kind(table: pa.Table, column: str, kind: int) -> list[bytes]:
    return [x for k, x in zip(table.column("kind").to_pylist(), table.column(column).to_pylist(), strict=True) if k == kind]


COPIES = 2


def group_anchors(table: pa.Table, copies: pa.Table, ranges: int) -> pa.Table:
    """``range, pid, hashes, several``: a group's distinct anchors, and whether several of its texts have each."""
    _, _, raws = _texts(table, _of_kind(copies, "a", COPIES))
    text, _, h = _text_anchors(raws)
    if not len(h):
        return _table([], "range pid hashes several", [pa.int64(), pa.int64(), pa.binary(), pa.binary()])
    by = np.lexsort((text, h))
    text, h = text[by], h[by]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    several = np.maximum.reduceat(np.concatenate([[False], (text[1:] != text[:-1])]) & ~new, at) if len(h) else new
    h = h[at]
    pid = table.column("pid")[0].as_py()
    which = _ranged(h, ranges)
    rows = [[int(which[a]), pid, _packed(h[a:b]), np.packbits(several[a:b]).tobytes()] for a, b in _runs(which)]
    return _table(rows, "range pid hashes several", [pa.int64(), pa.int64(), pa.binary(), pa.binary()])


def shared_anchors(table: pa.Table) -> pa.Table:
    """``pid, kind, a``: the anchors of a range that several texts have, for each group that has them."""
    columns = (table.column(c).to_pylist() for c in ("pid", "hashes", "several"))
    parts = [(p, _unpacked(h), s) for p, h, s in zip(*columns, strict=True)]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(h)).astype(bool) for _, h, s in parts]
    names, of = np.unique(np.concatenate([h for _, h, _ in parts]), return_inverse=True)
    count = np.bincount(of, minlength=len(names)) + np.bincount(of, np.concatenate(several), len(names))
    rows, at = [], 0
    for p, h, _ in parts:
        keep = count[of[at : at + len(h)]] > 1
        at += len(h)
        if keep.any():
            rows.append([p, 0, _packed(h[keep])])
    return _table(rows, "pid kind a", [pa.int64(), pa.int32(), pa.binary()])


def _first_of_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of distinct rows of bytes, and which of them each row equals."""
    n, width = rows.shape
    keys = np.zeros((n, -(-width // 8) * 8), np.uint8)
    keys[:, :width] = rows
    h = np.zeros(n, np.uint64)
    for word in keys.view(np.uint64).T:
        h = mixed(h * np.uint64(_STEP) + word)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(rows[first][of], rows):  # two rows of one hash
        _, first, of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, of.ravel()


CONTEXT = LEFT + LENGTH


def group_contexts(table: pa.Table, lists: pa.Table, ranges: int) -> pa.Table:
    """``part, pid, kind, a, b, c``. Of kind 0: a group's distinct contexts of a range of anchors, their numbers and smallest
    ids. Of kind 1, which the group sends to itself: each context's places, as its number, the text's number and the place."""
    known = _of_kind(lists, "a", 0)
    if not known or not table.num_rows:
        return _table([], "part pid kind a b c", _SENT)
    _, ids, raws = _texts(table, _of_kind(lists, "a", COPIES))
    shared = np.sort(np.concatenate([_unpacked(x) for x in known]))
    sizes = np.array([len(r) for r in raws])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text, place, h = _text_anchors(raws)
    keep = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
    text, place, h = text[keep], place[keep], h[keep]
    flat = np.frombuffer(b"\0" * LEFT + b"".join(raws) + b"\0" * LENGTH, np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(flat, CONTEXT)[starts[text] + place]  # a copy, of these places only
    lefts, rights = np.minimum(place, LEFT), np.minimum(sizes[text] - place, LENGTH)
    side = np.arange(CONTEXT) - LEFT
    around[(side < -lefts[:, None]) | (side >= rights[:, None])] = 0
    whole = np.concatenate([around, lefts[:, None].astype(np.uint8), rights[:, None].astype(np.uint8)], axis=1)
    first, of = _first_of_equal(whole)
    least = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(least, of, ids[text])
    which = _ranged(h[first], ranges)
    by = np.lexsort((first, which))
    pid = table.column("pid")[0].as_py()
    rows = []
    for a, b in _runs(which[by]):
        at = by[a:b]
        rows.append([int(which[at[0]]), pid, 0, zs.ZstdCompressor(level=2).compress(whole[first[at]].tobytes()), _squeezed(at.astype("<u4")), _squeezed(least[at])])
    if len(of):
        rows.append([-1 - pid, pid, 1, _squeezed(of.astype("<u4")), _squeezed(text.astype("<u4")), _squeezed(place)])
    return _table(rows, "part pid kind a b c", _SENT)


_SENT = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def _classes(body: np.ndarray, lefts: np.ndarray, rights: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For contexts and j from 0 to LEFT: the smallest id that has the context's window from j bytes before its anchor."""
    n = len(body)
    right, left = np.ascontiguousarray(body[:, LEFT:]), np.ascontiguousarray(body[:, :LEFT][:, ::-1])
    # an anchor's gram starts the right side, so that the sort itself tells anchors apart
    order, lcp = deep_shallow(right, rights, np.zeros(n, np.int64))
    gram = np.empty(n, np.int64)
    gram[order] = np.cumsum((lcp < GRAM) | (lcp < 0))
    out = np.full((n, LEFT + 1), NO_ID, np.int64)
    orders = [(order, lcp), deep_shallow(left, lefts, gram)]
    for j in range(LEFT + 1):
        classes = []
        for (by, common), need in zip(orders, (LENGTH - j, j), strict=True):
            c = np.empty(n, np.int64)
            c[by] = np.cumsum((common < need) | (common < 0))
            classes.append(c)
        fit = np.flatnonzero((rights >= LENGTH - j) & (lefts >= j))
        if len(fit):
            _, of = np.unique(classes[0][fit] * (n + 1) + classes[1][fit], return_inverse=True)
            best = np.full(of.max() + 1, NO_ID, np.int64)
            np.minimum.at(best, of, least[fit])
            out[fit, j] = best[of]
    return out


def sorted_contexts(table: pa.Table) -> pa.Table:
    """``pid, kind, a, b, c``. Of kind 0: contexts' numbers in their group, and the smallest ids of their windows. Of kind 1:
    as it came."""
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = {c: table.column(c).to_pylist() for c in ("pid", "kind", "a", "b", "c")}
    if columns["kind"][0] == 1:
        return _table(list(zip(*(columns[c] for c in ("pid", "kind", "a", "b", "c")), strict=True)), "pid kind a b c", kinds)
    inflate = zs.ZstdDecompressor().decompress
    bodies = [np.frombuffer(inflate(x), np.uint8).reshape(-1, CONTEXT + 2) for x in columns["a"]]
    sizes = [len(x) for x in bodies]
    whole, ids = np.concatenate(bodies), np.concatenate([_grown(x, "<i8") for x in columns["c"]])
    del bodies
    first, of = _first_of_equal(whole)
    least = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(least, of, ids)
    some = whole[first]
    found = _classes(some[:, :CONTEXT], some[:, CONTEXT].astype(np.int64), some[:, CONTEXT + 1].astype(np.int64), least)
    rows, at = [], 0
    for pid, numbers, n in zip(columns["pid"], columns["b"], sizes, strict=True):
        own = of[at : at + n]
        at += n
        rows.append([pid, 0, numbers, _squeezed(found[own].T.ravel()), b""])
    return _table(rows, "pid kind a b c", kinds)


def cut_out(table: pa.Table, marks: pa.Table, kind: pa.DataType) -> pa.Table:
    """``_o, n_bytes, n_removed, n_spans, kept`` of a group's texts."""
    names = "_o n_bytes n_removed n_spans kept"
    kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    if not table.num_rows:
        return _table([], names, kinds)
    texts, ids, raws = _texts(table, _of_kind(marks, "a", COPIES))
    sizes = np.array([len(r) for r in raws], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    drop = np.zeros(starts[-1] + 1, np.int32)
    columns = list(zip(*(marks.column(c).to_pylist() for c in ("kind", "a", "b", "c")), strict=True))
    told = [(_grown(a, "<u4"), _grown(b, "<i8").reshape(LEFT + 1, -1)) for k, a, b, _ in columns if k == 0]
    for k, a, b, c in columns:
        if k != 1:
            continue
        number, text, place = _grown(a, "<u4").astype(np.int64), _grown(b, "<u4").astype(np.int64), _grown(c, "<i8")
        least = np.full((LEFT + 1, int(number.max()) + 1), NO_ID, np.int64)
        for numbers, found in told:
            least[:, numbers] = found
        for s in range(0, len(number), 200_000):
            n, t, p = number[s : s + 200_000], text[s : s + 200_000], place[s : s + 200_000]
            seen = least[:, n] < ids[t]
            some = np.flatnonzero(seen.any(0))
            low, high = seen[:, some].argmax(0), LEFT - seen[::-1, some].argmax(0)
            # windows that start within 26 bytes of each other cover all between
            at = starts[t[some]] + p[some]
            np.add.at(drop, at - high, 1)
            np.add.at(drop, at - low + LENGTH, -1)
    gone = np.cumsum(drop[:-1]) > 0
    lead = np.concatenate([[False], gone[:-1]])
    lead[starts[:-1]] = False
    flat = np.frombuffer(b"".join(raws), np.uint8)
    removed = np.add.reduceat(gone, starts[:-1], dtype=np.int64) if raws else sizes
    spans = np.add.reduceat(gone & ~lead, starts[:-1], dtype=np.int64) if raws else sizes
    kept = flat[~gone].tobytes()
    ends = np.concatenate([[0], np.cumsum(sizes - removed)])
    rows = []
    for j, (o, times, copy, z) in enumerate(texts):
        size = zs.frame_content_size(z) if copy else 0
        row = [o, size, size, 1, b""] if copy else [o, int(sizes[j]), int(removed[j]), int(spans[j]), kept[ends[j] : ends[j + 1]]]
        rows += [row] * times
    return _table(rows, names, kinds)


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", range_bytes: int = 8_000_000, group_bytes: int = 12_000_000) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row of ``docs``. ``range_bytes`` and
    ``group_bytes`` say for how much text there is a range of anchors and a group; they don't change results."""
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"ids must be integers: {key} is {docs.schema[key].dataType.simpleString()}")
    base = docs.select(F.col(key).alias("_o"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    base = base.withColumn("_n", F.octet_length("_t").cast("long"))
    size = base.agg(F.sum("_n")).first()[0] or 0
    ranges, groups = int(size // range_bytes) + 1, int(size // group_bytes) + 1

    # texts that a smaller id has too: they go whole and take no part in what follows
    long = base.filter(F.col("_n") >= LENGTH).withColumn("_h", F.unhex(F.md5("_t")))
    long = long.withColumn("pid", F.pmod(F.xxhash64("_k", "_h"), F.lit(groups)))
    narrow = long.select("pid", "_k", "_h")
    first = narrow.groupBy("_h").agg(F.min("_k").alias("least"), F.max("_k").alias("most")).filter("least < most").drop("most")
    # stored, so that the join can split a group of very many copies
    copies = narrow.join(stored(first), "_h").filter("_k > least").select("pid", "_k", "_h").distinct()
    name = F.concat(F.unhex(F.lpad(F.hex("_k"), 16, "0")), "_h")
    copies = stored(copies.select("pid", name.alias("a")))

    def packed(table: pa.Table) -> pa.Table:
        return _table([[table.column("pid")[0].as_py(), COPIES, b"".join(table.column("a").to_pylist())]], "pid kind a", [pa.int64(), pa.int32(), pa.binary()])

    texts = send_texts(long.select("pid", "_o", "_k", "_h", "_t"))
    copies = stored(copies.groupBy("pid").applyInArrow(packed, "pid long, kind int, a binary"))
    kind = texts.schema["_o"].dataType.simpleString()
    dealt = lambda: texts.groupBy("pid")
    found = dealt().cogroup(copies.groupBy("pid")).applyInArrow(lambda t, c: group_anchors(t, c, ranges), "range long, pid long, hashes binary, several binary")
    lists = found.groupBy("range").applyInArrow(shared_anchors, "pid long, kind int, a binary").unionByName(copies)
    sent = dealt().cogroup(lists.groupBy("pid")).applyInArrow(lambda t, x: group_contexts(t, x, ranges), "part long, pid long, kind int, a binary, b binary, c binary")
    marks = sent.groupBy("part").applyInArrow(sorted_contexts, "pid long, kind int, a binary, b binary, c binary")
    marks = marks.unionByName(copies, allowMissingColumns=True)
    arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.int16() if kind == "smallint" else pa.int8()
    done = dealt().cogroup(marks.groupBy("pid")).applyInArrow(lambda t, m: cut_out(t, m, arrow), f"_o {kind}, n_bytes long, n_removed long, n_spans long, kept binary")

    short = base.filter(F.col("_n") < LENGTH).select("_o", F.col("_n").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("_t").cast("binary").alias("kept"))
    return done.unionByName(short).withColumnRenamed("_o", key)


def op3(spark, sf_dir: str) -> DataFrame:
    return remove(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
