"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

One model a language, trained on a bounded sample of labelled rows; each distinct word of a batch is scored once by
binary search in the arrays, and a text's languages are compared by their cross-entropy a character. A logistic
calibration turns the lead of the best language into a probability, by which a text can be rejected.

Defined results: a null or empty text, or one without a letter (Unicode category L), is ``und`` with score 0. A very long
text is scored whole, word by word. Ties: equal cross-entropies go to the language first in order. No labelled row at all:
every text is ``und``. An empty table gives no row. Repeated rows are predicted each for itself; columns other than the id
and the text are not read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import Interner, crc_fold, map_batches, newton_logistic, read, sampled

ORDER = 5
_LETTERS = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no decimal digits


def words_of(token: str) -> list[str]:
    """The runs of letters."""
    found = _LETTERS.findall(token)
    return found if all(map(str.isalpha, found)) else [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]


_STEP, _SALT, _WORD = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 1 << 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every character of each word and its closing space: hashes of the 0- to ``order``-grams that end there
    (row n), the same for the character before, how long a gram may be there, and the word's number. A word's history
    starts at the space before it."""
    text = " " + " ".join(words) + " "
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    space = code == 32
    n = len(code)
    last = np.maximum.accumulate(np.where(space, np.arange(n), 0))
    before = np.concatenate([[0], last[:-1]])
    room = np.minimum(np.arange(n) - before + 1, order)
    sums = np.zeros((order + 1, n), np.uint64)
    power, moved = 1, code + np.uint64(1)
    for k in range(1, order + 1):
        sums[k] = sums[k - 1] + moved * np.uint64(power)
        power = power * _STEP % _WORD
        moved = np.concatenate([np.zeros(1, np.uint64), moved[:-1]])
    hashes = np.stack([_mixed(sums[k] + np.uint64(k * _SALT % _WORD)) for k in range(order + 1)])
    word = np.cumsum(space) - 1
    word = np.where(space, word - 1, word)
    return hashes[:, 1:], hashes[:, :-1], room[1:], word[1:]


@dataclass
class CharModel:
    """``keys[n]``: sorted hashes of the seen n-grams, ``logs[n]`` their log-probabilities; ``contexts[n]``: sorted
    hashes of the seen contexts of n characters, ``backs[n]`` their log back-off weights."""

    order: int
    floor: float
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backs: list[np.ndarray]

    def score(self, hashes: np.ndarray, previous: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The log-probability of each character."""
        out = np.full(hashes.shape[1], self.floor)
        for n in range(1, self.order + 1):
            at = np.flatnonzero(room >= n)
            if n == 1:
                out[at] += self.backs[0][0]
            else:
                out[at] += _found(self.contexts[n - 1], self.backs[n - 1], previous[n - 1, at], 0.0)
            seen = _found(self.keys[n], self.logs[n], hashes[n, at], np.nan)
            hit = ~np.isnan(seen)
            out[at[hit]] = seen[hit]
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def train(words: list[str], counts: np.ndarray, order: int = ORDER) -> CharModel:
    """Interpolated Kneser-Ney: raw counts at the longest grams and at those that start a word, elsewhere the number of
    different characters seen before."""
    hashes, previous, room, word = _grams(words, order)
    weight = counts[word].astype(float)
    alphabet = max(2, len(np.unique(hashes[1])))
    floor = -np.log(alphabet)
    keys, logs = [np.zeros(0, np.uint64)] * (order + 1), [np.zeros(0)] * (order + 1)
    contexts, backs = [np.zeros(0, np.uint64)] * order, [np.zeros(0)] * order
    lower = np.zeros(0)
    for n in range(1, order + 1):
        at = np.flatnonzero(room >= n)
        gram, first, inverse = np.unique(hashes[n, at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weight[at])
        if n < order:
            longer = at[room[at] > n]
            _, once = np.unique(hashes[n + 1, longer], return_index=True)
            ends = np.searchsorted(gram, hashes[n, longer[once]])
            kinds = np.bincount(ends, minlength=len(gram)).astype(float)
            count = np.where(kinds > 0, kinds, count)
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        context = previous[n - 1, at[first]] if n > 1 else np.zeros(len(gram), np.uint64)
        ctx, of = np.unique(context, return_inverse=True)
        total, types = np.bincount(of, count), np.bincount(of)
        back = discount * types / total
        if n == 1:
            below = np.full(len(gram), np.exp(floor))
        else:
            suffix = np.searchsorted(keys[n - 1], hashes[n - 1, at[first]])
            below = np.exp(lower[suffix])
        lower = np.log((np.maximum(count - discount, 0) / total[of]) + back[of] * below)
        keys[n], logs[n], contexts[n - 1], backs[n - 1] = gram, lower, ctx, np.log(back)
    return CharModel(order, floor, keys, logs, contexts, backs)


class Merged:
    """The models of several languages in one sorted hash array an order: a row of values a gram, a column a language."""

    def __init__(self, models: dict[str, CharModel]):
        self.names = sorted(models)
        own = [models[k] for k in self.names]
        self.order, self.floor = own[0].order, np.array([m.floor for m in own])
        self.grams = [_merged([m.keys[n] for m in own], [m.logs[n] for m in own], np.nan) for n in range(self.order + 1)]
        self.contexts = [_merged([m.contexts[n] for m in own], [m.backs[n] for m in own], 0.0) for n in range(self.order)]

    def score(self, hashes: np.ndarray, previous: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The log-probability of each character in each language."""
        out = np.repeat(self.floor[None], hashes.shape[1], axis=0)
        for n in range(1, self.order + 1):
            at = np.flatnonzero(room >= n)
            below = out[at] + (self.contexts[0][1][0] if n == 1 else _rows(self.contexts[n - 1], previous[n - 1, at]))
            seen = _rows(self.grams[n], hashes[n, at])
            out[at] = np.where(np.isnan(seen), below, seen)
        return out


def _merged(keys: list[np.ndarray], values: list[np.ndarray], default: float) -> tuple[np.ndarray, np.ndarray]:
    """All keys in order, and a row of values for each and one for any other."""
    names = np.unique(np.concatenate(keys))
    table = np.full((len(names) + 1, len(keys)), default)
    for j, (k, v) in enumerate(zip(keys, values, strict=True)):
        table[np.searchsorted(names, k), j] = v
    return names, table


def _rows(array: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    keys, table = array
    if not len(keys):
        return np.repeat(table, len(wanted), axis=0)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return table[np.where(keys[at] == wanted, at, len(keys))]


class Scorer:
    """Cross-entropies of texts, one column a language, with a bounded memory of words."""

    kept: tuple | None = None  # a worker's last one: its tasks share the memory of words

    def __init__(self, models: dict[str, CharModel], most_words: int = 400_000):
        self.models, self.most = Merged(models), most_words
        self.names = self.models.names
        self._clear()

    @classmethod
    def of(cls, shared, models: dict[str, CharModel]) -> Scorer:
        """The scorer of a broadcast's models."""
        if cls.kept is None or cls.kept[0] != shared:
            cls.kept = (shared, cls(models))
        return cls.kept[1]

    def _clear(self) -> None:
        self.ids, self.table = Interner(), np.zeros((0, len(self.names) + 1))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The entropies (texts x languages, in nats a character) and the characters scored (0: no letter)."""
        if len(self.ids) > self.most:
            self._clear()
        known, sizes, flat = len(self.ids), [], []
        for text in texts:
            words = (text or "").lower().split()
            sizes.append(len(words))
            flat.append(np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words)))
        if len(self.ids) > known:
            self._learn(list(self.ids)[known:])
        sums = np.zeros((len(texts), len(self.names) + 1))
        for i, at in enumerate(flat):
            if len(at):
                sums[i] = self.table[at].sum(0)
        return -sums[:, :-1] / np.maximum(sums[:, -1:], 1), sums[:, -1]

    def _learn(self, tokens: list[str]) -> None:
        owner, words = [], []
        for i, token in enumerate(tokens):
            for w in (token,) if token.isalpha() else words_of(token):
                owner.append(i)
                words.append(w)
        rows = np.zeros((len(tokens), len(self.names) + 1))
        if words:
            hashes, previous, room, word = _grams(words, ORDER)
            of = np.array(owner)[word]
            scores = self.models.score(hashes, previous, room)
            for j in range(len(self.names)):
                rows[:, j] = np.bincount(of, scores[:, j], len(tokens))
            rows[:, -1] = np.bincount(of, minlength=len(tokens))
        self.table = np.concatenate([self.table, rows])


def _features(entropies: np.ndarray, chars: np.ndarray) -> np.ndarray:
    two = np.sort(entropies, axis=1)[:, :2]
    lead = two[:, 1] - two[:, 0] if two.shape[1] > 1 else np.ones(len(two))
    return np.stack([np.minimum(lead, 3), np.log1p(np.minimum(lead * chars, 1e4)), np.log1p(chars)], axis=1)


@dataclass
class LanguageId:
    """Trained models and their calibration; ``predict`` maps documents to languages."""

    models: dict[str, CharModel]
    weights: tuple | None

    @staticmethod
    def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = 1500, calibration_rows: int = 400) -> LanguageId:
        """Learns from about ``fit_rows`` rows of each language, whole texts, and calibrates on about
        ``calibration_rows`` others: documented bounds of a labelled sample. Word counts are summed before they reach
        the driver; what reaches it is bounded by these rows."""
        labelled = rows.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).cast("string").alias("_l")).filter(F.col("_l").isNotNull() & F.col("_t").isNotNull())
        side = F.pmod(F.xxhash64(F.lit(77), F.col("_k")), F.lit(5)) == 0
        chosen = sampled(labelled.filter(~side), "_k", "_l", fit_rows, 1)

        def counter():
            from collections import Counter

            def count(batch: pa.RecordBatch):
                seen: dict[str, Counter] = {}
                for language, t in zip(batch.column("_l").to_pylist(), batch.column("_t").to_pylist(), strict=True):
                    seen.setdefault(language, Counter()).update(words_of(t.lower()))
                flat = [(a, w, n) for a, c in seen.items() for w, n in c.items()]
                return [list(x) for x in zip(*flat, strict=True)] if flat else None

            return count

        words = map_batches(chosen.select("_l", "_t"), counter, "_l string, w string, n long").groupBy("_l", "w").agg(F.sum("n").alias("n")).toPandas().sort_values(["_l", "w"])
        models = {name: train(part["w"].tolist(), part["n"].to_numpy()) for name, part in words.groupby("_l")}
        out = LanguageId(models, None)
        if not models:
            return out
        held = sampled(labelled.filter(side), "_k", "_l", calibration_rows, 2)
        names = sorted(models)
        sc = rows.sparkSession.sparkContext.broadcast(models)
        name = uuid.uuid4().hex

        def measurer():
            scorer = Scorer.of(name, sc.value)

            def measure(batch: pa.RecordBatch):
                e, n = scorer(batch.column("_t").to_pylist())
                best = [names[i] for i in e.argmin(1)]
                f = _features(e, n)
                return [[int(a == b) for a, b in zip(best, batch.column("_l").to_pylist(), strict=True)], *f.T]

            return measure

        got = map_batches(held.select("_l", "_t"), measurer, "y int, a double, b double, c double").toPandas()
        if len(got):
            y = got["y"].to_numpy(float)
            n = len(y)
            x, y = got[["a", "b", "c"]].to_numpy(), np.where(y > 0, 1 - 1 / (n + 2), 1 / (n + 2))  # never certain
            out.weights = (x, y)
        return out

    def predict(self, docs: DataFrame, text: str = "text", key: str = "doc_id", reject_below: float | None = None) -> DataFrame:
        """``key, lang_pred, score, accepted``. With ``reject_below``, a text of a lower score is ``und`` too."""
        shared = docs.sparkSession.sparkContext.broadcast((self.models, self.weights))
        name = uuid.uuid4().hex

        def predictor():
            models, weights = shared.value
            scorer = Scorer.of(name, models) if models else None
            calibrated = newton_logistic(*weights) if weights else None

            def predict(batch: pa.RecordBatch):
                texts = batch.column("_t").to_pylist()
                if not models:
                    return [batch.column("_k"), ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)]
                e, n = scorer(texts)
                p = calibrated(_features(e, n)) if calibrated else np.full(len(texts), 0.5)
                p = np.where(n > 0, p, 0.0)
                ok = (n > 0) & (p >= (0.5 if reject_below is None else reject_below))
                drop = n == 0 if reject_below is None else ~ok
                return [batch.column("_k"), ["und" if d else scorer.names[i] for d, i in zip(drop, e.argmin(1), strict=True)], p, ok]

            return predict

        kind = docs.schema[key].dataType.simpleString()
        return map_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), predictor, f"_k {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("_k", key)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = LanguageId.fit(docs.filter(crc_fold(F.col("doc_id"), 5) != 0))
    return model.predict(docs).withColumn("held_out", crc_fold(F.col("doc_id"), 5) == 0).select("doc_id", "held_out", "lang_pred", "score", "accepted")
