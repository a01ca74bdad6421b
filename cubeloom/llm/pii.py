"""Personal data by weak supervision.

Base kinds, leftmost and non-overlapping each for itself: ``email``, ``ip``, ``card`` and ``phone``. Beyond them, broader
patterns propose candidates (``iban``, ``ssn``, ``local_phone``, ``masked_email``, ``person``), and labelers of three sorts
vote on every candidate and base span: patterns with checks, gazetteers and context words. Votes are counted by pattern
of votes over the whole corpus; expectation-maximisation over these counts estimates each labeler's reliability and each
kind's share of true spans. The resulting probabilities train a final span classifier, which also sees what no labeler
does: the span's shape and the words on both sides, hashed. It decides which candidates are added; base spans always stay.

Defined results: a null or empty text has no span. Very long texts are scanned whole, in time that grows with their
length. Ties: spans of one start are in the order of kinds; of overlapping candidates the first in order is kept. Repeated
rows are scanned each for itself, and counted each. Only the id and the text are read, whatever other columns are named.
An empty table trains no classifier and has no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import cut, fit_logistic, map_batches, read, stored
from cubeloom.llm.secrets import counted, digest, meeting, union

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone", "masked_email", "person")
KINDS = BASE + ADDED
BUCKETS = 32
LABELERS = ("pattern", "check", "gazetteer", "context", "border", "contrary")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{1,63})+")
_PERSON = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+")
_LAST, _FIRST = re.compile(r"[^\W\d_]+(?=[\W\d_]*\Z)"), re.compile(r"[^\W\d_]+")
_CLASS = bytes(48 if 48 <= i < 58 else i if i in b"+.@([" else 32 for i in range(256))

#: Fixed word lists of the gazetteer and context labelers.
ENDINGS = frozenset("com org net edu gov info io de fr es it uk eu us ca".split())
NAMES = frozenset("john mary james anna peter maria david paul laura thomas julia michael sarah robert linda marie jean pierre hans juan jose carlos ana luis".split())
CONTEXT = re.compile(r"mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|account|iban|bank|ssn|social|security|address|server|host|name|dear|signed", re.I | re.A)
CONTRARY = re.compile(r"version|release|isbn|section|chapter|page|price|figure|build|v$|\$\x20?$|#\x20?$", re.I | re.A)


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` outwards."""
    out, low = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """Start, kind and end of the base spans."""
    raw = text.encode("utf-8", "replace").translate(_CLASS)
    out = []
    if b"@" in raw:
        out += [(s, "email", e) for s, e in emails(text)]
    if b"0.0" in raw:
        out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    if b"0" in raw:
        if b"0" * 12 in re.sub(rb"[\x20-]", b"", text.encode("utf-8", "replace")).translate(_CLASS):
            for m in _CARD.finditer(text):
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), "card", m.end()))
        if b"+0" in raw:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans of the broader patterns that no base span and no earlier candidate overlaps."""
    found = []
    digits = any(c in text for c in "0123456789")
    for kind, pattern, ask in (("iban", _IBAN, digits), ("ssn", _SSN, digits and "-" in text), ("local_phone", _LOCAL_PHONE, digits), ("masked_email", _MASKED, "at" in text.lower() and ("(" in text or "[" in text)), ("person", _PERSON, any(x in text for x in ("Mr", "Ms", "Dr", "Prof")))):
        if ask:
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    out, end, covered = [], 0, union([(s, 0, e) for s, _, e in base])
    for s, k, e in sorted(found):
        if s >= end and not meeting(covered, s, e):
            out.append((s, k, e))
            end = e
    return out


def surroundings(text: str, start: int, end: int) -> list[int]:
    """Buckets of the span's shape (runs of letters and of digits, other characters as they are) and of the words before
    and after it."""
    shape = _RUNS.sub(lambda m: "A" if m[0].isupper() else "a" if m[0].isalpha() else "9", text[start:end])
    before, after = _LAST.search(text[max(0, start - 32) : start]), _FIRST.search(text[end : end + 32])
    words = ("<" + before[0].lower() if before else "", ">" + after[0].lower() if after else "")
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in (shape, *words)]


def votes(text: str, start: int, kind: str, end: int) -> list[int]:
    """Each labeler's vote: 1 for, -1 against, 0 none."""
    it, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 1]
    digits = "".join(c for c in it if c in "0123456789")
    check = _checked(kind, it, digits)
    ending = it.rpartition(".")[2].lower() if kind in ("email", "masked_email") else ""
    gazetteer = 1 if ending in ENDINGS or any(w.lower() in NAMES for w in re.findall(r"[A-Za-z]+", it)) else -1 if kind == "person" else 0
    near = before[-1:]
    return [
        1 if kind in BASE else 0,
        0 if check is None else 1 if check else -1,
        gazetteer,
        1 if CONTEXT.search(before) else 0,
        -1 if near.isalnum() or after.isalnum() else 1,
        -1 if CONTRARY.search(before[-16:]) else 0,
    ]


def _checked(kind: str, it: str, digits: str) -> bool | None:
    """Whether a span of this kind passes the kind's own check; None where there is none."""
    if kind == "card":
        return luhn(digits)
    if kind == "iban":
        return _iban_ok(it)
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return 10 <= len(digits) <= 13
    if kind == "local_phone":
        return len(digits) == 10 and digits[0] not in "01"
    return not it.startswith("0.") if kind == "ip" else None


def _iban_ok(it: str) -> bool:
    s = it.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def aggregate(patterns: np.ndarray, kinds: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over counted patterns of votes.

    Returns the probability that each pattern's spans are true, and the reliabilities: for a true and for an untrue span,
    how likely each labeler votes -1, 0 and 1. Counts are smoothed, and a pattern check starts as mostly right.
    """
    p = np.clip(0.5 + 0.15 * patterns.sum(1), 0.05, 0.95)
    which = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    names = np.unique(kinds)
    rates = np.zeros((2, patterns.shape[1], 3))
    for _ in range(rounds):
        for truth, w in ((1, p), (0, 1 - p)):
            # pseudo-counts keep a labeler better than chance and out of reach of 0 and 1
            prior = np.array([0.5, 1.0, 2.0] if truth else [2.0, 1.0, 0.5]) * 2
            sums = (which * (w * counts)[:, None, None]).sum(0) + prior
            rates[truth] = sums / sums.sum(1, keepdims=True)
        share = {k: ((p * counts)[kinds == k].sum() + 1) / (counts[kinds == k].sum() + 2) for k in names}
        prior = np.array([share[k] for k in kinds])
        logs = [(which * np.log(rates[t])[None]).sum((1, 2)) for t in (0, 1)]
        odds = np.log(prior / (1 - prior)) + logs[1] - logs[0]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return p, rates


def _features(patterns: np.ndarray, kinds: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Votes, the kind, and the buckets of shape and words: a column each."""
    hot = [near[:, [j]] == np.arange(BUCKETS) for j in range(near.shape[1])]
    return np.concatenate([patterns, np.array([[k == x for x in KINDS] for k in kinds]), *hot], axis=1).astype(float)


def propose(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, found``: every row's base spans and candidates with their votes and surroundings."""

    def proposer():
        def run(batch: pa.RecordBatch):
            found = []
            for t in batch.column("_t").to_pylist():
                t = t or ""
                base = base_spans(t)
                spans = sorted(base + candidates(t, base), key=lambda x: (x[0], KINDS.index(x[1])))
                found.append([{"kind": k, "start": s, "stop": e, "votes": votes(t, s, k, e), "near": surroundings(t, s, e)} for s, k, e in spans])
            return [batch.column("_k"), found]

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), proposer, f"_k {kind}, found array<struct<kind:string,start:long,stop:long,votes:array<int>,near:array<int>>>").withColumnRenamed("_k", key)


def detect(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.8, fit_patterns: int = 100_000) -> DataFrame:
    """``key, found``: base spans and the candidates that the classifier accepts, an array of ``kind, start, stop``. The
    classifier is fitted on about ``fit_patterns`` of the distinct patterns of votes and surroundings, drawn by hash and
    weighted by their counts: a documented bound of its sample. Expectation-maximisation counts all spans."""
    proposed = cut(propose(docs, text, key))
    seen = stored(proposed.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.near").agg(F.count("*").alias("n")))
    # at most kinds x 3^labelers rows, whatever the corpus
    voted = seen.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").toPandas()
    if len(voted):
        patterns, kinds = np.array(voted["votes"].tolist(), float), voted["kind"].to_numpy()
        probability, _ = aggregate(patterns, kinds, voted["n"].to_numpy(float))
        known = {(k, tuple(v)): p for k, v, p in zip(kinds, patterns.astype(int).tolist(), probability, strict=True)}
        draw = F.pmod(F.xxhash64("kind", "votes", "near"), F.lit(1 << 30))
        some = seen.filter(draw < int(min(1.0, fit_patterns / seen.count()) * (1 << 30))).orderBy("kind", "votes", "near").toPandas()
        patterns, kinds, near = np.array(some["votes"].tolist(), float), some["kind"].to_numpy(), np.array(some["near"].tolist())
        truth = np.array([known[k, tuple(v)] for k, v in zip(kinds, patterns.astype(int).tolist(), strict=True)])
        weights, bias = fit_logistic(_features(patterns, kinds, near), truth, some["n"].to_numpy(float))
        own = dict(zip(KINDS, weights[len(LABELERS) :].tolist(), strict=False))
        votes_at, near_at = weights[: len(LABELERS)].tolist(), weights[len(LABELERS) + len(KINDS) :].reshape(-1, BUCKETS).tolist()

        def odds(x):
            total = F.lit(float(bias)) + F.element_at(F.create_map(*[F.lit(v) for kind in own.items() for v in kind]), x["kind"])
            for j, w in enumerate(votes_at):
                total = total + F.lit(w) * F.element_at(x["votes"], j + 1)
            for j, ws in enumerate(near_at):
                total = total + F.element_at(F.array(*[F.lit(w) for w in ws]), F.element_at(x["near"], j + 1) + 1)
            return total

        least = float(np.log(threshold / (1 - threshold)))
        return proposed.select(key, F.filter("found", lambda x: x["kind"].isin(*BASE) | (odds(x) >= least)).alias("found"))
    return proposed


def op8(spark, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"))
    f = F.col("found")
    return found.select("doc_id", *[counted(f, k).alias(f"n_{k}") for k in BASE], F.sha2(digest(f, BASE), 256).alias("base_sha256"), digest(f, KINDS).alias("spans"))
