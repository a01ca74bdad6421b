"""Benchmark decontamination by a prefix-filtered set join, in DataFrame expressions only.

An item's windows are its runs of ten words (an item of fewer words is one window). A window's shingles are its three-word
runs. Every occurrence of a benchmark shingle in a document is found in one pass; the counts of these occurrences over all
documents order each window's shingles by rarity. Containment needs all shingles, so the prefix of a window that an
occurrence can't do without is its rarest shingle: only that one is joined. An occurrence at which the window would start
before the document or end after it is dropped (positional and length bounds); what is left is compared word by word.

The benchmark's shingles and windows are broadcast only if a count proves them small (``most_windows``); beyond it the same
joins run as shuffles, which adaptive execution splits by itself where they are skewed.

Defined results: null texts have no words, neither as documents nor as items; an item without words has no window. Items
that share their id count once. Repeated documents are reported each for itself (rows are told apart by id and text). An
empty benchmark hits nothing, and no documents give no row. A very long text is one row's words, searched whole. Ties: of
equally rare shingles a window's first is its prefix. Clashing columns do no harm: only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import LOWER, UPPER, cut, read

#: Everything else in ASCII separates words, after A-Z are lower-cased.
SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
SHINGLE = 3


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[{SEPARATORS}]+")
    return F.filter(parts, lambda x: x != "")


def item_windows(benchmark: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """``w`` (the words), ``items`` (ids as sorted strings) for every distinct window."""
    w = benchmark.select(F.col(key).cast("string").alias("item"), words(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - window + 1))
    w = w.select("item", "ws", F.explode(starts).alias("i")).select("item", F.expr(f"slice(ws, i, {window})").alias("w"))
    return w.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _shingles(ws: Column, size: Column, k: int) -> Column:
    """Hashes of the runs of ``k`` words, by their place from 0."""
    at = lambda i: F.xxhash64(F.lit(k), *[ws[i + j] for j in range(k)])
    return F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), at)).otherwise(F.array().cast("array<bigint>"))


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = 10, most_windows: int = 200_000) -> DataFrame:
    """``key, n_words, n_hit, n_items, items`` (sorted strings) for every row of ``docs``."""
    windows = cut(item_windows(benchmark, item_text, item_key, window).withColumn("n", F.size("w")))
    small = windows.count() <= most_windows
    held = F.broadcast if small else (lambda x: x)
    lengths = sorted(r[0] for r in windows.select(F.least(F.lit(SHINGLE), "n").alias("k")).distinct().collect())  # among 1, 2, 3

    parts = None
    for k in lengths:
        part = windows.filter(F.least(F.lit(SHINGLE), "n") == k).select("w", "items", "n", F.posexplode(_shingles(F.col("w"), F.col("n"), k)).alias("offset", "h"))
        parts = part if parts is None else parts.unionByName(part)

    base = docs.select(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_x"), F.col(text).alias("_t"))
    if parts is None:
        return base.select(key, F.size(words(F.col("_t"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.array().cast("array<string>").alias("items"))

    split = base.select(key, "_x", words(F.col("_t")).alias("_w")).withColumn("_n", F.size("_w"))
    found = None
    for k in lengths:
        known = held(parts.select("h").distinct())
        one = split.select(key, "_x", "_n", F.posexplode(_shingles(F.col("_w"), F.col("_n"), k)).alias("_p", "h")).join(known, "h", "left_semi")
        found = one if found is None else found.unionByName(one)
    found = cut(found)

    rarity = found.groupBy("h").agg(F.count("*").alias("c"))
    # a shingle that no document has makes its window impossible: its count of 0 is the rarest
    prefix = parts.join(rarity, "h", "left").groupBy("w", "items", "n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("offset"), F.col("h"))).alias("m"))
    prefix = prefix.filter(F.col("m.c") > 0).select("w", "items", "n", F.col("m.offset").alias("offset"), F.col("m.h").alias("h"))
    start = F.col("_p") - F.col("offset")
    placed = found.join(held(prefix), "h").filter((start >= 0) & (start + F.col("n") <= F.col("_n")))
    cands = placed.groupBy(key, "_x").agg(F.collect_set(F.struct(start.alias("s"), F.col("w"), F.col("items"))).alias("_c"))
    cands = cands.withColumnsRenamed({key: "_k", "_x": "_y"})

    joined = base.join(cands, base[key].eqNullSafe(cands["_k"]) & (base["_x"] == cands["_y"]), "left")
    v = joined.select(key, words(F.col("_t")).alias("_w"), F.col("_c"))
    v = v.select(key, F.size("_w").cast("long").alias("n_words"), F.when(F.col("_c").isNotNull(), F.col("_w")).alias("_w"), F.coalesce("_c", F.expr("cast(array() as array<struct<s:int,w:array<string>,items:array<string>>>)")).alias("_c"))
    w = F.col("_w")
    v = v.withColumn("_c", F.sort_array(F.filter("_c", lambda x: F.slice(w, x["s"] + 1, F.size(x["w"])) == x["w"])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def cover(a, x):
        stop = x["s"] + F.size(x["w"])
        return F.struct((a["n"] + F.greatest(F.lit(0), stop - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], stop).alias("end"))

    items = F.array_sort(F.array_distinct(F.flatten(F.transform("_c", lambda x: x["items"]))))
    v = v.select(key, "n_words", F.aggregate("_c", zero, cover, lambda a: a["n"]).cast("long").alias("n_hit"), items.alias("items"))
    return v.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def op10(spark, sf_dir: str) -> DataFrame:
    found = hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT item_id, list_slice(ws, i, i + 9) AS w FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(w) AS l FROM iw),
dw AS (SELECT doc_id, l, i, list_slice(ws, i, i + l - 1) AS w FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM d, lens WHERE len(ws) >= l)),
m AS (SELECT doc_id, i, l, item_id FROM dw JOIN iw USING (w)),
p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
