"""Toxicity by compression distance: two zstandard dictionaries, one from toxic and one from ordinary text.

Both dictionaries hold the same sample of ordinary words; each then holds the pieces of words by which its own class stands
out among the labelled rows, the most distinctive nearest to the text, as many as its size holds. Dictionaries that
zstandard's own trainer builds from a class's text were tried (README): they hold what is frequent there, which is mostly
what is frequent anywhere, and miss more. A window is one word within a fixed carrier that both dictionaries hold, since
zstandard stores a shorter input as it is. The bytes that the ordinary dictionary needs more than the toxic one are the window's
gain; the gains of all windows of a text, calibrated on other labelled rows, give its score.

Defined results: a null or empty text, or one without a letter, has no window; its score is the calibrated one of no
window at all. A very long text is scored by all its words. Without labels of both classes every score is 0. Repeated rows
are scored each for itself; labels are joined by id after repeated ids among them are reduced to their largest label. Ties:
pieces of one distinctiveness go by their letters. An empty table gives no row. Columns other than the id and the text are
not read, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Interner, crc_fold, cut, map_batches, newton_logistic, read, sampled

_LETTERS = re.compile(r"[^\W\d_]+")
#: Bytes that no text in UTF-8 has, so that the carrier never matches a word.
CARRIER = bytes(0xF8 + (i * i // 3 + i) % 8 for i in range(48))


def word_pieces(word: str) -> list[str]:
    """The starts of a word of four letters up, and any word itself, each after a space."""
    return [f" {word[:k]}" for k in range(3, min(len(word), 12))] + [f" {word} "]


def _compressor(content: bytes) -> zs.ZstdCompressor:
    how = zs.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=4, min_match=4, target_length=16, strategy=zs.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
    return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=how)


class Gains:
    """Features of texts from the gains of their windows, with a bounded memory of words."""

    def __init__(self, ordinary: bytes, toxic: bytes, most_words: int = 400_000):
        self.ordinary, self.toxic, self.most = _compressor(ordinary), _compressor(toxic), most_words
        self.ids, self.gain = Interner(), np.zeros(0, np.int8)
        self.words, self.word_gain = Interner(), []

    def window(self, word: str) -> int:
        b = CARRIER[:24] + f" {word} ".encode("utf-8", "replace") + CARRIER[24:]
        return max(-100, min(100, len(self.ordinary.compress(b)) - len(self.toxic.compress(b))))

    def features(self, texts: list[str | None]) -> np.ndarray:
        if len(self.words) > self.most:
            self.words, self.word_gain = Interner(), []
        known, flat = len(self.words), []
        for text in texts:
            words = _LETTERS.findall((text or "").lower())
            flat.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        self.word_gain += [self.window(w) for w in list(self.words)[known:]]
        gains = np.array(self.word_gain, float)
        out = np.zeros((len(texts), 8))
        for i, at in enumerate(flat):
            if n := len(at):
                g = gains[at]
                top = np.sort(np.partition(g, max(0, n - 3))[-3:])[::-1]
                many = [(g >= k).sum() for k in (2, 3, 4)]
                out[i] = [top[0], top.mean(), g.mean(), *np.log1p(many), np.sqrt(many[1] / n), np.log1p(n)]
        return out


@dataclass
class Toxicity:
    ordinary: bytes
    toxic: bytes
    weights: tuple | None

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id", fit_rows: int = 6000, calibration_rows: int = 3000, base_bytes: int = 16384, class_bytes: int = 8192, least_z: float = 4.0) -> Toxicity:
        """Learns from about ``fit_rows`` rows of each class and calibrates on about ``calibration_rows`` others
        (documented bounds of a labelled sample; whole texts). The ids are drawn first, from the labels alone: they are
        what is broadcast, so the bounds hold for it. Piece counts are summed before they reach the driver, which gets
        the most distinctive ones."""
        known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).dropna().groupBy("_k").agg(F.max("_y").alias("_y"))
        side = F.pmod(F.xxhash64(F.lit(78), F.col("_k")), F.lit(10)) < 3
        drawn = sampled(known.filter(~side), "_k", "_y", fit_rows, 3).withColumn("_fit", F.lit(True))
        drawn = drawn.unionByName(sampled(known.filter(side), "_k", "_y", calibration_rows, 4).withColumn("_fit", F.lit(False)))
        sample = cut(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(drawn), "_k"))
        chosen, held = sample.filter("_fit"), sample.filter("not _fit")
        sizes = {r["_y"]: r["n"] for r in chosen.groupBy("_y").agg(F.count("*").alias("n")).collect()}
        if not sizes.get(0) or not sizes.get(1):
            return Toxicity(CARRIER, CARRIER, None)

        def counter():
            from collections import Counter

            def count(batch: pa.RecordBatch):
                seen = (Counter(), Counter())
                for y, t in zip(batch.column("_y").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                    seen[y > 0].update({p for w in set(_LETTERS.findall((t or "").lower())) for p in word_pieces(w)})
                flat = sorted(seen[0].keys() | seen[1].keys())
                return [flat, [seen[0][p] for p in flat], [seen[1][p] for p in flat]] if flat else None

            return count

        n0, n1 = float(sizes[0]), float(sizes[1])
        counts = map_batches(chosen.select("_y", "_t"), counter, "p string, a long, b long").groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        mean = (F.col("a") + F.col("b")) / (n0 + n1)
        z = (F.col("b") / n1 - F.col("a") / n0) / F.sqrt(mean * (1 - mean) * (1 / n0 + 1 / n1) + 1e-9)
        ranked = counts.filter(F.col("a") + F.col("b") >= 4).withColumn("z", z)
        # a piece has three bytes at least, so that none is left out that a dictionary has room for
        best = lambda way: [r["p"] for r in ranked.filter(F.col("z") * way > least_z).orderBy(F.col("z") * -way, "p").limit(class_bytes // 3).collect()]
        toxic, plain = _section(best(1), class_bytes), _section(best(-1), class_bytes)
        # the sections are equally long, so that what stands before them is equally far for both
        size = max(len(toxic), len(plain))
        filler = bytes(0xF8 + (i * 7 + i // 11) % 8 for i in range(size))
        toxic, plain = filler[: size - len(toxic)] + toxic, filler[: size - len(plain)] + plain
        words = counts.filter(F.col("p").endswith(" ") & (F.col("a") > 0) & (z <= least_z)).orderBy(F.col("a").desc(), "p").limit(base_bytes // 3).collect()
        base = _section([r["p"] for r in words], base_bytes)
        out = Toxicity(base + plain + CARRIER, base + toxic + CARRIER, None)
        shared = docs.sparkSession.sparkContext.broadcast((out.ordinary, out.toxic))

        def measurer():
            gains = Gains(*shared.value)
            return lambda batch: [batch.column("_y"), list(gains.features(batch.column("_t").to_pylist()))]

        got = map_batches(held.select("_y", "_t"), measurer, "y int, f array<double>").toPandas().sort_values("y", kind="stable")
        if got["y"].nunique() == 2:
            out.weights = (np.array(sorted(map(tuple, np.c_[np.stack(got["f"]), got["y"]]))),)
        return out

    def score(self, docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
        """``key, score, predicted`` for every row."""
        shared = docs.sparkSession.sparkContext.broadcast((self.ordinary, self.toxic, self.weights))

        def scorer():
            ordinary, toxic, weights = shared.value
            gains = Gains(ordinary, toxic)
            p = newton_logistic(weights[0][:, :-1], weights[0][:, -1]) if weights else (lambda f: np.zeros(len(f)))

            def score(batch: pa.RecordBatch):
                s = p(gains.features(batch.column("_t").to_pylist()))
                return [batch.column("_k"), s, (s >= threshold).astype(int)]

            return score

        kind = docs.schema[key].dataType.simpleString()
        return map_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), scorer, f"_k {kind}, score double, predicted int").withColumnRenamed("_k", key)


    def keep(self, docs: DataFrame, text: str = "text", threshold: float = 0.7) -> DataFrame:
        """The rows of ``docs``, all columns, whose score is under ``threshold``; null texts stay."""
        names = docs.columns
        shared = docs.sparkSession.sparkContext.broadcast((self.ordinary, self.toxic, self.weights))

        def keeper():
            ordinary, toxic, weights = shared.value
            gains = Gains(ordinary, toxic)
            p = newton_logistic(weights[0][:, :-1], weights[0][:, -1]) if weights else (lambda f: np.zeros(len(f)))

            def keep(batch: pa.RecordBatch):
                texts = batch.column(names.index(text)).to_pylist()
                stay = (p(gains.features(texts)) < threshold) | np.array([t is None for t in texts])
                kept = batch.filter(pa.array(stay))
                return [kept.column(i) for i in range(len(names))] if kept.num_rows else None

            return keep

        return map_batches(docs, keeper, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def _section(pieces: list[str], size: int) -> bytes:
    """The pieces, the first last (nearest to the text), as many whole ones as ``size`` bytes hold; a piece that a longer one
    starts with is left out where that one is ranked before it."""
    kept: list[bytes] = []
    starts: set[str] = set()
    for p in pieces:
        raw = p.encode("utf-8", "replace")
        if p in starts or len(raw) > size:
            continue
        kept.append(raw)
        size -= len(raw)
        starts.update(p[:k] for k in range(1, len(p) + 1))
    return b"".join(reversed(kept))


def op9(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fold = crc_fold(F.col("doc_id"), 3)
    model = Toxicity.fit(docs, read(spark, sf_dir, "labels").filter(fold != 1))
    return model.score(docs).withColumn("held_out", fold == 1).select("doc_id", "held_out", "score", "predicted")
