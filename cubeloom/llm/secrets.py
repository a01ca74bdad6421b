"""Secret scans: three base patterns, and strings that dictionary-primed zstandard finds novel in a sensitive context.

Base kinds, leftmost and non-overlapping each for itself: ``assign``, ``access`` and ``hex``. The method adds ``novel``:
a candidate (a run of credential characters, shortly after a word such as *key* or *bearer*, that does not read as words:
see ``reads_as_words``) is compressed after its surrounding text with a dictionary of common identifiers and of that surrounding text;
if its marginal bytes come near those of a random string of its alphabet and length (or of its own length, if that is
less), nothing there predicts it, and it is reported unless a base span overlaps it. Copies of it that stand in a
sensitive context or a base span don't count as surroundings; copies elsewhere do.

Defined results: a null or empty text has no span, an empty table no row. Very long texts are scanned whole, in time that
grows with their length. Spans of different kinds may overlap; ties, spans of one start, are in the order of kinds.
Repeated rows are scanned each for itself; only the id and the text are read, whatever other columns are named.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_left, bisect_right

import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import map_batches, read

KINDS = ("assign", "access", "hex", "novel")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_IS_HEX = bytes(49 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_SENSITIVE = re.compile(r"key|secret|token|passw|passphrase|pwd|auth|bearer|credential|private|signature", re.I | re.A)
_SENSITIVE_WORDS = ("key", "secret", "token", "passw", "passphrase", "pwd", "auth", "bearer", "credential", "private", "signature")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
_PIECE, _CONSONANTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
#: Identifiers that code and configuration repeat; a candidate made of them is no secret.
IDENTIFIERS = (
    "access_key_id secret_access_key client_secret client_id private_key public_key api_key auth_token bearer_token refresh_token session_token "
    "authorization authentication credentials password username configuration environment production development application connection database "
    "localhost example default undefined function return import export class string integer boolean request response header content-type "
    "application/json charset=utf-8 https://www. .example.com /usr/local/bin /etc/ssl/certs abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "0123456789 1234567890 xxxxxxxxxxxxxxxx 0000000000000000 XXXXXXXXXXXXXXXX ---------------- ================ deadbeefdeadbeef changeme placeholder"
)
#: What a candidate may be drawn from, the first that holds all its characters.
_ALPHABETS = tuple(map(frozenset, (string.digits, "0123456789abcdef", "0123456789ABCDEF", string.digits + string.ascii_lowercase, string.digits + string.ascii_uppercase, string.digits + string.ascii_letters, string.digits + string.ascii_letters + "+/_=-")))


def alike(it: str) -> str:
    """A random string of a candidate's alphabet and length, the same one each time."""
    alphabet = next(a for a in _ALPHABETS if a.issuperset(it))
    return "".join(random.Random(len(it)).choices(sorted(alphabet), k=len(it)))


def reads_as_words(it: str) -> bool:
    """Whether a candidate with less than two digits is made of words, which nothing near has to predict: its pieces (split at
    signs and at capitals) have four letters on average, and those of four or more have a vowel in every five letters and no
    five consonants in a row (compounds of some languages do, and are reported when nothing near predicts them). Random letters of both cases have shorter pieces, of one case seldom enough vowels."""
    if sum(c in string.digits for c in it) > 1:
        return False
    pieces = _PIECE.findall(it)
    long = [p.lower() for p in pieces if len(p) > 3]
    return sum(map(len, pieces)) >= 4 * len(pieces) and all(5 * sum(c in "aeiouy" for c in p) >= len(p) and not _CONSONANTS.search(p) for p in long)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"1" * 24 in text.encode("utf-8", "replace").translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


class Novelty:
    """Spans of novel strings in sensitive contexts."""

    def __init__(self, least: float = 0.8, context: int = 512, near: int = 48):
        self.least, self.context, self.near = least, context, near

    def share(self, text: str, start: int, end: int, copies: list[tuple[int, int]]) -> float:
        """The candidate's marginal compressed bytes after its surroundings without ``copies`` (sorted spans), by those of a
        random string or by its length, whichever are fewer."""
        left, right = _without(text, max(0, start - self.context), start, copies), _without(text, end, min(len(text), end + self.context), copies)
        known = zs.ZstdCompressionDict(f"{IDENTIFIERS} {right} {left}".encode("utf-8", "replace"), dict_type=zs.DICT_TYPE_RAWCONTENT)
        c = zs.ZstdCompressor(dict_data=known, level=12, write_content_size=False, write_dict_id=False)
        # an unseen tail closes both inputs, since matches are not looked for in the last bytes of an input
        head, tail = left[-24:].encode("utf-8", "replace"), bytes(range(240, 248)) * 2
        none = len(c.compress(head + tail))
        more = lambda it: len(c.compress(head + it.encode() + tail)) - none
        it = text[start:end]
        got = more(it)
        return got / len(it) if got >= self.least * len(it) else got / min(len(it), more(alike(it)))

    def spans(self, text: str, base: list[Span]) -> list[Span]:
        lower = text.lower()
        if not any(w in lower for w in _SENSITIVE_WORDS):
            return []
        ends = [word.end() for word in _SENSITIVE.finditer(text)]
        covered = union(base)
        found = []
        for m in _CANDIDATE.finditer(text):
            k = bisect_right(ends, m.start())
            it = m.group()
            if k and m.start() <= ends[k - 1] + self.near and not meeting(covered, m.start(), m.end()) and not reads_as_words(it):
                found.append((m.start(), m.end(), it))
        same: dict[str, list[tuple[int, int]]] = {}
        for s, e, it in found:
            same.setdefault(it, []).append((s, e))
        out = []
        for start, end, it in found:
            low, high = start - self.context, end + self.context
            near = same[it][max(0, bisect_left(same[it], (low,)) - 1) : bisect_left(same[it], (high,))] + [(s, e) for s, e in meeting(covered, low, high) if it in text[max(s, low - len(it)) : min(e, high + len(it))]]
            if self.share(text, start, end, sorted(near)) >= self.least:
                out.append((start, 3, end))
        return out


def union(spans: list[Span]) -> list[tuple[int, int]]:
    """What the spans cover, as disjoint spans in order."""
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def meeting(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
    """Those of disjoint spans in order that share a place with ``low`` to ``high``."""
    k = bisect_right(spans, (low, -1))
    k -= bool(k and spans[k - 1][1] > low)
    return spans[k : bisect_left(spans, (high,))]


def _without(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    out = []
    for s, e in spans:
        if s < end and e > start:
            out.append(text[start : max(start, s)])
            start = max(start, e)
    return "".join([*out, text[start:end]])


def joined(spans: list[Span], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.8) -> DataFrame:
    """``key, found``: the spans of every row in order, an array of ``kind, start, stop`` in code points."""

    def scanner():
        novelty = Novelty(least)

        def run(batch: pa.RecordBatch):
            found = []
            for t in batch.column("_t").to_pylist():
                base = base_spans(t or "")
                spans = sorted(base + novelty.spans(t or "", base))
                found.append([{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in spans])
            return [batch.column("_k"), found]

        return run

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), scanner, f"_k {kind}, found array<struct<kind:string,start:long,stop:long>>").withColumnRenamed("_k", key)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", least: float = 0.8) -> DataFrame:
    """All rows and columns, each union of overlapping spans in the text replaced by ``mark``; null texts stay null."""
    names = docs.columns

    def redactor():
        novelty = Novelty(least)

        def clean(t: str | None) -> str | None:
            if not t:
                return t
            base = base_spans(t)
            out, at = [], 0
            for s, _, e in sorted(base + novelty.spans(t, base)):
                if s >= at:
                    out += [t[at:s], mark]
                at = max(at, e)
            return "".join([*out, t[at:]])

        return lambda batch: [[clean(t) for t in batch.column(i).to_pylist()] if c == text else batch.column(i) for i, c in enumerate(names)]

    return map_batches(docs, redactor, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def digest(found, kinds: tuple[str, ...]):
    """The joined spans of an array of spans, those of ``kinds`` only."""
    return F.array_join(F.transform(F.filter(found, lambda x: x["kind"].isin(*kinds)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def counted(found, kind: str):
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op7(spark, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    f = F.col("found")
    return found.select("doc_id", *[counted(f, k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(digest(f, KINDS[:3]), 256).alias("base_sha256"), digest(f, KINDS).alias("spans"))
