"""Quality rules by host, in DataFrame expressions only.

Each document's statistics are array expressions within its row. Failures of the base rule are summed by host (partial
sums first, so that a hot host costs no more than another), every host's rate is shrunk towards all hosts' mean by a beta
prior whose strength the method of moments takes from the spread of the hosts' rates, and a host whose shrunk rate
reaches ``host_limit`` is rejected with all its documents. Verdicts go back to the documents by a salted join.

Defined results: a null or empty text has no word and fails the base rule. A null host counts as the host ''. With fewer
than two hosts, or hosts of equal rates, the prior is as strong as it may be. Repeated rows count each for itself. A very
long text is one row's arrays, and nothing of it is left out. Ties: a host whose rate equals the limit is rejected. An
empty table gives no row. Columns whose names clash with the statistics' give way to them; others are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import SPACES, cut, read

_TRIM = " \t\n\x0b\f\r"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``; the text itself is dropped.

    Repeated three-word windows are found by sorting hashes that carry their position in their low bits; windows that
    agree in their hash are then compared as words. Every step is a projection of its own, so that no array is computed
    anew for each element.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(t, F.lit(_TRIM))
    d = docs.select(
        *[c for c in docs.columns if c != text],
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACES}]+")).alias("_w"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACES}]")).alias("_lines"),
    )
    d = d.select("*", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines")).drop("_lines")
    d = d.withColumn("_bits", F.ceil(F.log2(F.col("n_words") + F.lit(2))).cast("int"))
    w = F.col("_w")
    hashed = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.call_function("shiftleft", F.xxhash64(w[i], w[i + 1], w[i + 2]), F.col("_bits")).bitwiseOR(i.cast("long")))
    d = d.withColumn("_s", F.when(F.col("n_words") >= 3, F.sort_array(hashed)).otherwise(F.array().cast("array<bigint>")))
    s, bits = F.col("_s"), F.col("_bits")
    head = lambda x: F.call_function("shiftright", x, bits)
    agree = F.filter(s, lambda x, k: _same(head(F.get(s, k - 1)), head(x)) | _same(head(F.get(s, k + 1)), head(x)))
    d = d.withColumn("_c", agree).drop("_s")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    d = d.withColumn("_i", F.transform("_c", lambda x: x.bitwiseAND(low).cast("int"))).drop("_c")
    d = d.withColumn("_e", F.sort_array(F.transform("_i", lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))).drop("_w", "_i")
    e = F.col("_e")
    equal = lambda x, y: _same(x["a"], y["a"]) & _same(x["b"], y["b"]) & _same(x["c"], y["c"])
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter(e, lambda x, k: equal(F.get(e, k - 1), x) | equal(F.get(e, k + 1), x)), lambda x: x["i"]))).drop("_e")
    p = F.col("_p")
    d = d.withColumn("_n", F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))).drop("_p")
    return d.withColumn("n_repeat_words", F.aggregate("_n", F.lit(0).cast("long"), lambda a, x: a + x)).drop("_n", "_bits")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def host_verdicts(stats: DataFrame, host: str = "source", host_limit: float = 0.8, least_strength: float = 1.0, most_strength: float = 1e4) -> DataFrame:
    """``_host, n_docs, n_failed, shrunk_rate, host_ok`` from rows with ``base_failed``."""
    hosts = stats.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("_host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    overall = hosts.agg(F.sum("n_docs").alias("_n"), (F.sum("n_failed") / F.sum("n_docs")).alias("_m"), F.count("*").alias("_k"), (F.sum(F.col("n_docs") * rate * rate) / F.sum("n_docs")).alias("_q"))
    # one row: its size is proven
    m, within = F.col("_m"), F.col("_m") * (1 - F.col("_m")) * (F.col("_k") - 1) / F.col("_n")
    between = F.col("_q") - m * m - within
    strength = F.when(between > 0, F.least(F.lit(most_strength), F.greatest(F.lit(least_strength), m * (1 - m) / between - 1))).otherwise(F.lit(most_strength))
    prior = overall.select(m.alias("_m"), strength.alias("_strength"))
    out = hosts.join(F.broadcast(prior))
    out = out.withColumn("shrunk_rate", (F.col("n_failed") + F.col("_m") * F.col("_strength")) / (F.col("n_docs") + F.col("_strength")))
    return out.withColumn("host_ok", F.col("shrunk_rate") < host_limit).drop("_m", "_strength")


def judge(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id", host_limit: float = 0.8, salts: int = 32) -> DataFrame:
    """``key``, the statistics, ``base_failed``, ``host_rate`` and ``kept`` for every row."""
    stats = statistics(docs.select(F.col(key), F.col(host), F.col(text))) if text in docs.columns else docs
    stats = cut(stats.withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(stats, host, host_limit).select("_host", "shrunk_rate", "host_ok", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    salted = stats.withColumn("_host", F.coalesce(F.col(host).cast("string"), F.lit(""))).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    return salted.join(verdicts, ["_host", "_salt"], "left").select(key, *STATS, "base_failed", (~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).alias("kept"), F.col("shrunk_rate").alias("host_rate"))


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("host_rate")


SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM documents),
pos AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words
  FROM w LEFT JOIN hit USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
h AS (SELECT host, count(*) AS n, count(*) FILTER (base_failed) AS x FROM f GROUP BY host),
o AS (SELECT sum(n) AS n, sum(x) / sum(n) AS m, count(*) AS k, sum(n * (x / n) * (x / n)) / sum(n) AS q FROM h),
b AS (SELECT m, q - m * m - m * (1 - m) * (k - 1) / n AS v FROM o),
p AS (SELECT m, CASE WHEN v > 0 THEN least(10000.0, greatest(1.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS strength FROM b),
g AS (SELECT host, (x + m * strength) / (n + strength) < 0.8 AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM f JOIN g USING (host)
"""
