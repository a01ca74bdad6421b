"""License scans, token alignment and hard negatives against brute force, with every edge case."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from cubeloom.llm import alignment, licenses, negatives

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def ws(text):
    return WORD.findall((text or "").translate(LOW))


def license_rows():
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, "... \n"), (3, "CC BY, cc-by and General Public License; All rights reserved"), (3, "CC BY, cc-by and General Public License; All rights reserved"), (None, "Released under the MIT License")]
    filler = ["the", "of", "É", "software", "license", "any", "under", "x1", "public"]
    for i, (_, t) in enumerate(licenses.TEMPLATES * 3):
        w = t.split()
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(filler)
        for _ in range(rng.choice([0, 2])):
            w.insert(rng.randrange(len(w)), rng.choice(filler))
        around = [[rng.choice(filler) for _ in range(rng.randrange(60))] for _ in range(2)]
        rows.append((10 + i, " ".join([*around[0], *w, *around[1]]).upper() if i % 2 else " ".join([*around[0], *w, "\n", *w])))
    return [*rows, (99, "word " * 30_000 + licenses.TEMPLATES[0][1])]


def blocks(words, template, share):
    """All runs of overlapping blocks that meet the share: (first, after the last, most words)."""
    t, n = set(ws(template)), len(ws(template))
    width, runs = -(-5 * n // 4), []
    for i, w in enumerate(words):
        if w in t:
            part = [(j, words[j]) for j in range(i, min(len(words), i + width)) if words[j] in t]
            k = len({x for _, x in part})
            if share[1] * k >= share[0] * len(t):
                end = part[-1][0] + 1
                if runs and i < runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(end, runs[-1][1]), max(k, runs[-1][2]))
                else:
                    runs.append((i, end, k))
    return [(a, b, k / len(t)) for a, b, k in runs]


@pytest.mark.parametrize("share", [(9, 10), (3, 5), (1, 1)])
def test_license_scan(spark, share):
    rows = license_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_words": F.lit(1), "blocks": F.lit("x"), "w": F.lit(2)})
    got = sorted(licenses.scan(df, share=share).collect(), key=str)
    want = []
    for i, t in rows:
        w = ws(t)
        places = [(label, [p for p in range(len(w)) if w[p : p + len(ws(q))] == ws(q)]) for label, q in licenses.PHRASES]
        found = sorted(((label, a, b, s) for label, q in licenses.TEMPLATES for a, b, s in blocks(w, q, share)), key=lambda x: (x[1], x[0], x[2]))
        want.append((i, len(w), [(label, len(p), p[0], p[-1]) for label, p in places if p], found))
    have = [(r["doc_id"], r["n_words"], [tuple(p) for p in r["phrases"]], [tuple(b) for b in r["blocks"]]) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    assert sum(len(x[3]) for x in want) > 15 and any(b[0] == "agpl" for x in have if x[0] == 99 for b in x[3])


def test_license_options(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "all rights reserved")], "doc_id long, text string")
    none = {r["doc_id"]: r for r in licenses.scan(df, templates=[]).collect()}
    assert not none[1]["blocks"] and none[2]["phrases"][0]["label"] == "reserved"
    assert [r["blocks"] for r in licenses.scan(df.limit(0)).collect()] == []
    assert licenses.scan(df, templates=[("x", "B c!")], phrases=[]).filter(F.size("blocks") > 0).first()["blocks"][0][:] == ("x", 1, 3, 1.0)
    with pytest.raises(ValueError):
        licenses.scan(df, templates=[("x", "!?")])
    with pytest.raises(ValueError):
        licenses.scan(df, templates=[("x", "a")] * 3, most_templates=2)


def groups(text, a_tok, b_tok, letters, name):
    """The contract's groups from whole texts' tokens."""
    if not text:
        return None
    a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
    a_bytes = [bytes(letters[c] for c in name[i]) for i in a]
    b_bytes = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return None
    ends = [np.cumsum(list(map(len, x))).tolist() for x in (a_bytes, b_bytes)]
    out, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [x.index(end) + 1 for x in ends]
        out.append((a[i : to[0]], b[j : to[1]]))
        i, j = to
    return out


@pytest.mark.parametrize(("most_hot", "large"), [(100_000, 4096), (40, 4096), (1, 2)])
def test_alignment(spark, monkeypatch, most_hot, large):
    path = public_tokenizers.path
    a, b = Tokenizer.from_file(path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(x for x in range(256) if x not in own)}
    name = {i: t for t, i in a.get_vocab().items()}
    rng = random.Random(8)
    alphabet = [*"ab1 '.-\n\t　\x1c\x85é中▁ ", "  ", "   ", "the ", "<|endoftext|>", "</s>", "<0x41>", "\r\n", "'s", "😀", "\x00", "ﬁ", "​"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(300)]
    texts += [None, "", " ", "x" * 500 + "中é" * 50, "the same", "the same", "word " * 20_000, "a ▁ b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"pair": F.lit(1), "n": F.lit(2), "_r": F.lit(3)}).unionByName(spark.createDataFrame([(None, "the end", 1, 2, 3)], "doc_id long, text string, pair int, n int, _r int"))
    monkeypatch.setattr(alignment, "LARGE", large)
    alignment.Aligner.kept = None
    got = {r["doc_id"]: r for r in alignment.align(df, path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"), most_hot=most_hot).collect()}
    assert len(got) == len(texts) + 1
    cut = {i: groups(t, a, b, letters, name) for i, t in [*enumerate(texts), (None, "the end")]}
    pairs = {i: Counter((x, y) for p, q in g or [] for x in p for y in q) for i, g in cut.items()}
    counts = Counter(p for c in pairs.values() for p in c)
    best, best_b = ({s: max(n for p, n in counts.items() if p[k] == s) for s in {p[k] for p in counts}} for k in (0, 1))
    assert any(cut[i] is None for i in cut if i is not None and texts[i])
    for i, g in cut.items():
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or [])
        c = pairs[i]
        want = (sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n for p, n in c.items() if counts[p] == best_b[p[1]]), sum(n * counts[p] for p, n in c.items()))
        assert tuple(got[i][x] for x in ("n_a", "n_b", "n_groups", "n_links", "best_a", "best_b", "count_sum")) == want, i
        assert got[i]["groups"] == (hashlib.sha256(text.encode()).hexdigest() if g else "")


def mined(rows, positives, negatives_):
    """The contract by all pairs."""
    kept = [(i, lab, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, lab, v in rows if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    for a, (i, lab, v) in enumerate(kept):
        if i is None or i % 10:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), j, other == lab) for b, (j, other, w) in enumerate(kept) if b != a]
        for p, j, _ in sorted((s for s in scores if s[2]), key=order)[:positives]:
            found = sorted((s for s in scores if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives_]
            out += [(i, j, r + 1, k, p, s) for r, (s, k, _) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("labels", "options"), [(3, {}), (3, {"group_rows": 20, "depth": 2, "sample_rows": 30}), (1, {}), (40, {"negatives": 2, "positives": 1})])
def test_hard_negatives(spark, labels, options):
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.normal(0, 0.2, (6, 5))
    rows = [(i, int(rng.integers(labels)), (centres[i % 6] + rng.normal(0, 0.05, 5)).tolist()) for i in range(300)]
    rows += [(300 + i, i % labels, rows[7][2]) for i in range(150)]  # copies: a third of all rows
    rows += [(10, None, [1.0]), (20, 1, None), (20, 0, [0.1, None]), (20, 0, [float("nan")] * 5), (20, 0, [float("inf")] * 5), (20, 0, []), (30, 0, [0.5, 0.5]), (None, 0, rows[3][2]), rows[40], rows[40], rows[41], rows[307]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({"q": F.lit(1), "id": F.lit("x"), "score": F.lit(2), "v": F.lit(3)})
    got = negatives.mine(df, F.col("id") % 10 == 0, **options)
    want = mined(rows, options.get("positives", 5), options.get("negatives", 10))
    assert sorted(map(tuple, got.collect()), key=str) == want and (labels == 1) == (not want)


def test_hard_negatives_of_large_numbers(spark, monkeypatch):
    rows = [(i, i % 3, [float(i % 7), -1.5 * (i % 5), float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    for exact in (negatives.EXACT, 0):
        monkeypatch.setattr(negatives, "EXACT", exact)
        assert sorted(map(tuple, negatives.mine(df, F.col("id") % 10 == 0, depth=1).collect()), key=str) == mined(rows, 5, 10)
    assert negatives.mine(df.limit(0), F.col("id") % 10 == 0).isEmpty()


def test_tree_visits_few_rows():
    """The traversal computes the scores of few buckets where rows are clustered."""
    rng = np.random.Generator(np.random.PCG64(5))
    v = np.concatenate([rng.integers(-8, 9, (2000, 8)) + 200 * np.eye(8, dtype=int)[k] for k in range(8)]).astype(np.int64)
    tree = negatives.Tree([[i] for i in range(len(v))], np.zeros(len(v), int), v, int((v * v).sum(axis=1).max()))
    query = tree.query(v[0])
    s = v @ v[0]
    order = np.lexsort((np.arange(len(v)), -s))[:10]
    assert query.first(10, None, None, True, 0) == [(int(s[i]), int(i)) for i in order]
    assert 2 * len(query.scores) < sum(n[3] is None for n in tree.nodes)
