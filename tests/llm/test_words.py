"""Native operators and joins against brute force, with every edge case in one table."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cubeloom.llm import decontam, hostrules, jaccard, substrings

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = {c: c + 32 for c in range(65, 91)}


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "The", "#x", "a&b"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 9, 20, 60]))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w), "hot" if i % 3 else None))
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, " \n\t", "x"), (n + 3, "for " * 3000, "x"), (n + 4, "word", "x"), (n + 5, rows[0][1], "x")]
    return rows


def frame(spark, rows):
    # an extra column whose name clashes with those the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit(1), "w": F.lit("x"), "sig": F.lit(2), "h": F.lit(3)})


def components(rows, k, percent):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if n and 100 * n >= percent * len(sets[x] | sets[y]):
                a, b = group[x], group[y]
                group = [b if g == a else g for g in group]
    least = {}
    for g, (i, _, _) in zip(group, rows, strict=True):
        least[g] = min(least.get(g, i), i)
    return {i: (len(s), least[g]) for s, g, (i, _, _) in zip(sets, group, rows, strict=True)}


@pytest.mark.parametrize(("k", "percent", "options"), [(4, 85, {}), (2, 80, {"cell_sets": 6, "group_shingles": 300, "hot_sets": 20})])
def test_jaccard_join(spark, k, percent, options):
    rows = corpus()
    got = jaccard.join(frame(spark, rows), words=k, percent=percent, **options).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components(rows, k, percent)
    assert len(got) == len(rows)


def test_jaccard_join_of_repeated_and_null_ids_and_nothing(spark):
    rows = [(1, "a b c d e", "s"), (1, "a b c d e", "s"), (None, "a b c d e", "s"), (None, "z y x w v", "s")]
    got = sorted(str(r["component_id"]) for r in jaccard.join(frame(spark, rows)).collect())
    assert got == ["1", "1", "1", "None"]
    assert jaccard.join(frame(spark, rows).filter("doc_id > 9")).isEmpty()


def removed(rows, n=50):
    first, out = {}, {}
    raws = [(i, (t or "").encode()) for i, t, _ in rows]
    for i, r in raws:
        for p in range(len(r) - n + 1):
            first[r[p : p + n]] = min(first.get(r[p : p + n], i), i)
    for i, r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - n + 1):
            if first[r[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for j in range(len(r)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(r), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(r, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"range_bytes": 3000, "group_bytes": 2000}])
def test_substrings(spark, options):
    rows = corpus(2)
    got = substrings.remove(frame(spark, rows), **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == removed(rows)
    assert len(got) == len(rows)


def test_substrings_of_repeated_and_null_ids_and_nothing(spark):
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(200))
    rows = [(1, text, "s"), (1, text, "s"), (2, text + "tail", "s"), (None, text, "s"), (None, "tail" + text, "s")]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substrings.remove(frame(spark, rows)).collect())
    assert got == [("1", 0), ("1", 0), ("2", 200), ("None", 200), ("None", 200)]
    assert substrings.remove(frame(spark, rows).filter("doc_id > 9")).isEmpty()


def test_substrings_of_repeated_and_null_ids_in_any_groups(spark):
    text = "".join(random.Random(5).choice("abcdef ") for _ in range(200))
    rows = [(1, text, "s"), (2, "head" + text, "s"), (2, "head" + text, "s"), (None, text + "tail", "s"), (None, "tail" + text, "s")]
    got = [sorted(tuple(map(str, r)) for r in substrings.remove(frame(spark, rows), group_bytes=size).collect()) for size in (100, 12_000_000)]
    assert got[0] == got[1]
    assert sorted((r[0], r[2]) for r in got[0]) == [("1", "0"), ("2", "200"), ("2", "200"), ("None", "200"), ("None", "200")]


def test_substrings_of_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(4)]
    raws = [t.encode() for t in texts + [texts[0][100:400] + texts[1][:333]]]
    whole = substrings._text_anchors(raws)
    monkeypatch.setattr(substrings, "BATCH", 64)
    parts = substrings._text_anchors(raws)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_host_statistics(spark):
    rows = corpus(3)
    got = {r["doc_id"]: r for r in hostrules.judge(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        t, w = t or "", WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p + d for p in range(len(w) - 2) if tri[tuple(w[p : p + 3])] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert tuple(got[i][c] for c in hostrules.STATS) == want, t[:80]
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_host_verdicts(spark):
    rows = [(f"{h}", i < bad) for h, n, bad in (("good", 1000, 50), ("bad", 1000, 990), ("tiny", 1, 1)) for i in range(n)]
    got = {r["_host"]: r for r in hostrules.host_verdicts(spark.createDataFrame(rows, "source string, base_failed boolean")).collect()}
    assert got["good"]["host_ok"] and not got["bad"]["host_ok"]
    assert got["tiny"]["host_ok"] and 0.05 < got["tiny"]["shrunk_rate"] < 0.9  # one failure proves little
    assert hostrules.judge(frame(spark, corpus()).filter("doc_id > 9999")).isEmpty()


def test_decontamination(spark):
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(12)] + ["É1", "x"]
    items = [(f"i{i}", " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([25, 12, 10, 9, 3, 2, 1, 14])] + [("i8", None), ("i9", "?!"), ("i0", "again the same id")]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 2:
            item = re.findall("[^ ]+", items[rng.randrange(8)][1])
            at = rng.randint(0, len(w))
            w[at:at] = item[: rng.randint(1, len(item))]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 5 == 0 else " ".join(w), "s"))
    docs += [(80, None, "s"), (81, "", "s"), (82, docs[1][1], "s"), (82, docs[1][1], "s")]
    parts = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOW))
    windows = {}
    for k, t in items:
        w = parts(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[p : p + 10]), set()).add(k)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("h", F.lit(0))
    for most in (200_000, 0):
        got = sorted(tuple(r) for r in decontam.hits(frame(spark, docs), bench, most_windows=most).withColumn("items", F.array_join("items", ",")).collect())
        want = []
        for i, t, _ in docs:
            w, hit, found = parts(t), set(), set()
            for x, ids in windows.items():
                for p in range(len(w) - len(x) + 1):
                    if tuple(w[p : p + len(x)]) == x:
                        hit.update(range(p, p + len(x)))
                        found |= ids
            want.append((i, len(w), len(hit), len(found), ",".join(sorted(found))))
        assert got == sorted(want)
    assert all(r["n_hit"] == 0 for r in decontam.hits(frame(spark, docs), bench.filter("item_id = 'none'")).collect())
