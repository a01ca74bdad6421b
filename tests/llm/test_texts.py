"""Operators on single texts: scans, classifiers, extraction, packing."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import html, langid, packing, pii, queries, secrets, suffixes, toxicity
from cubeloom.llm.common import crc_fold


def fragments(seed: int, parts: list[str], n: int, most: int = 30) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_secret_base_spans():
    assign = r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    texts = fragments(1, ['token = "', "password: ", "API_key=", "secret", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "deadbeef", "é", "ſecret", "K", "\n", '"', "=", " ", "-"], 3000)
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(secrets.base_spans(t)) == sorted(want)


def test_novel_secrets():
    n = secrets.Novelty()
    t = "The api key is Zx9Kq2LmP4vT7wYbN3 here"
    assert n.spans(t, secrets.base_spans(t)) == [(15, 3, 33)]
    assert n.spans("private key: hello-world-example-123456", []) == []
    assert n.spans("Zx9Kq2LmP4vT7wYbN3 without a sensitive word", []) == []
    again = "id Zx9Kq2LmP4vT7wYbN3 and the key Zx9Kq2LmP4vT7wYbN3"
    assert n.spans(again, []) == []  # its surroundings know it


def test_novel_secrets_of_any_length_alphabet_and_number():
    n, rng = secrets.Novelty(), random.Random(8)
    for alphabet in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"):
        for size in (48, 96, 128, 256, 512, 2000):
            for _ in range(5):
                t = "My private key is " + "".join(rng.choices(alphabet, k=size)) + " and no other"
                assert n.spans(t, []) == [(18, 3, 18 + size)], t
    it = "Zx9Kq2LmP4vT7wYbN3"
    twice = f"The key is {it} and again: the key {it}"
    assert n.spans(twice, []) == [(11, 3, 29), (twice.rindex(it), 3, len(twice))]
    t = f"token={it} as said, the private key {it}"
    assert [(s, k) for s, k, _ in n.spans(t, secrets.base_spans(t))] == [(t.rindex(it), 3)]
    words = "the-private-keys-of-a-house-are-kept-in-2-or-3-places-that-only-its-people-know-and-some-of-them-are-given-to-friends-who-live-near-it-since-doors-fall-shut-"
    for t in (words * 3, words, "0" * 60 + "abcd" * 9, "deadbeef" * 12 + "00"):
        assert n.spans("private key: " + t.strip("-"), []) == [], t


def test_planted_secrets():
    """Recall of random strings of several alphabets in a sensitive sentence, and words and placeholders left alone."""
    n, rng = secrets.Novelty(), random.Random(21)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sentence = "As agreed, the private key is {} and should be rotated soon."

    def recall(alphabet, size):
        planted = ["".join(rng.choices(alphabet, k=size)) for _ in range(100)]
        return sum(n.spans(sentence.format(it), []) == [(30, 3, 30 + size)] for it in planted) / 100

    for size in (16, 20, 28, 40):
        for alphabet in (low + up, digits, low + digits, low + up + digits, low + up + digits + "+/"):
            assert recall(alphabet, size) >= 0.94, (alphabet, size)
        for alphabet in (low, up):  # some random strings of one case can be read as words
            assert recall(alphabet, size) >= 0.75, (alphabet, size)
    assert n.spans("the private key is QWxhZGRpbjpvcGVuIHNlc2FtZQ", []) == [(19, 3, 45)]
    plain = """internationalization responsibilities-of-the-owner application/x-www-form-urlencoded AbstractSingletonProxyFactoryBean getUserAuthenticationDetails
        telecommunications counterrevolutionary /usr/share/doc/packages user_account_settings_page state-of-the-art-technology MAXIMUM_CONNECTION_POOL_SIZE
        electroencephalographically 0000000000000000 1234567890123456 ---------------- ================ org/apache/spark/sql/functions
        uncharacteristically anticonstitutionnellement straightforwardness""".split()
    assert [it for it in plain if n.spans(sentence.format(it), [])] == []
    assert n.spans(sentence.format("Donaudampfschifffahrtsgesellschaft"), []) != []  # known false alarm: six consonants in a row


def test_secret_scan_of_long_texts():
    n, rng = secrets.Novelty(), random.Random(4)
    many = " ".join(f"key {''.join(rng.choices('abcdefghijkmnpqrstuvwxyz23456789', k=20))}" for _ in range(1000))
    start = time.perf_counter()
    for t in ("key " * 250_000, "key" * 300_000, "A1b2" * 250_000, "token=abcdef " * 80_000, "key " + "a1B2c3D4" * 2 + " " + "deadbeef" * 100_000):
        base = secrets.base_spans(t)
        n.spans(t, base)
    assert time.perf_counter() - start < 6
    assert len(n.spans(many, [])) > 900


def test_secret_scan_and_redaction(spark):
    long = "x" * 200_000 + " token = abcdef123456 " + "y" * 200_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "token: abcdef99 and token: abcdef99"), (4, long), (None, "secret=abcdefgh")], "doc_id long, text string").withColumn("found", F.lit("clash"))
    got = {r["doc_id"]: secrets.joined([(x["start"], secrets.KINDS.index(x["kind"]), x["stop"]) for x in r["found"]]) for r in secrets.scan(df).collect()}
    assert got == {1: "", 2: "", 3: "assign:0:15,assign:20:35", 4: "assign:200001:200021", None: "assign:0:15"}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert clean[3] == "[SECRET] and [SECRET]" and clean[1] is None and clean[2] == "" and len(clean[4]) == len(long) - 20 + 8
    assert secrets.scan(df.filter("doc_id > 9")).isEmpty()


def test_personal_data_base_spans():
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits(s)))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    for t in fragments(2, ["@", "a.b", "x@y.z", "@c.d", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "-", "+1 (407) 555-7710", "+", "12", " ", "  ", "é", "5.6", ".", "0001"], 3000):
        want = [(m.start(), k, m.end()) for k, (rx, ok) in rules.items() for m in re.finditer(rx, t) if ok(m[0])]
        assert sorted(pii.base_spans(t)) == sorted(want)
    assert pii.base_spans("1" * 50_000 + "a" * 50_000 + "@") == []


def test_weak_supervision():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, np.where(truth, 1, -1), np.where(truth, -1, 1)) for a in (0.95, 0.8, 0.7, 0.6)], axis=1).astype(float)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, rates = pii.aggregate(patterns, np.array(["ssn"] * len(patterns)), counts.astype(float))
    assert ((p[at.ravel()] > 0.5) == truth).mean() > 0.93
    right = rates[1, :, 2]
    assert right[0] > right[1] > right[3]


def test_personal_data_added_spans(spark):
    rows = [(i, f"Please call 407-555-{7000 + i} or mail to a{i}@mail{i}.example.com today") for i in range(40)] + [(100, "release 407-555-1234x"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"]) for x in r["found"]] for r in pii.detect(df).collect()}
    assert all(("email", rows[i][1].index(f"a{i}@")) in got[i] and ("local_phone", 12) in got[i] for i in range(40))
    assert got[100] == got[101] == got[102] == []
    assert pii.detect(df.filter("doc_id > 999")).isEmpty()


def test_language(spark):
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["qwark", "zyxt", "vrok", "kiwz"]}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i in range(300) for k in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "12 !?", "xx"), (903, "lorem " * 50_000, "xx"), (904, "Lorem", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.LanguageId.fit(df.filter(crc_fold(F.col("doc_id"), 5) != 0))
    got = {r["doc_id"]: r for r in model.predict(df).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k in rows if i < 300)
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "xx", "xx"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.LanguageId.fit(df.filter("doc_id < 0")).predict(df).select("lang_pred").distinct().collect() == [("und",)]


def test_character_model_sums_to_one():
    model = langid.train(["abba", "baab", "abc"], np.array([3, 2, 1]))
    for history in ("", "a", "ab", "abb"):
        total = 0.0
        for c in ["a", "b", "c", " "]:
            hashes, previous, room, _ = langid._grams([history if c == " " else history + c], langid.ORDER)
            total += np.exp(model.score(hashes, previous, room)[len(history)])
        assert total == pytest.approx(1, abs=1e-6)


def test_toxicity_on_the_small_tables(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op9(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y, s = got["toxic"].to_numpy(), got["score"].to_numpy()
    rank = s.argsort().argsort()
    n1, n0 = y.sum(), len(y) - y.sum()
    assert (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.8
    assert got["predicted"][got["toxic"] == 0].mean() < 0.03
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 100_000)], "doc_id long, text string")
    model = toxicity.Toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["score"] for r in model.score(odd).collect()] == [0.0] * 3
    assert model.keep(odd).count() == 3


def test_compression_windows():
    plain = b" the of and " * 20
    g = toxicity.Gains(plain + b" qqqqqqq " + toxicity.CARRIER, plain + b" idiotic " + toxicity.CARRIER)
    assert g.window("idiotic") >= 3 and g.window("the") == 0


def test_page_lines():
    page = """<html><head><title>x</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>menu</a></ul></nav><!-- c --><div class="ad">buy</div>
    <article><h1>A &amp; B</h1><p><b>one<br>two <p>three &lt;x&gt;</p><div class='user comments'><p>me too</div><p class="cookie-notice">ok<p>four</article><footer>&copy;</footer>"""
    assert html.text_of(html.lines(page), set(), set()) == "A & B\none two\nthree <x>\nfour"
    assert html.text_of(html.lines("<div>a<p>b</div><aside>no</aside>c"), set(), {1}) == "a\nc"
    assert html.lines(None) == [] and html.text_of([], set(), set()) == ""


def test_odd_tags_and_long_pages():
    kept = lambda page: [t for _, t in html.lines(page)]
    assert kept("a<img alt='<p>'>b <i title=\"x>y\">c</i><p class='>'>d") == ["ab c", "d"]
    assert kept("1 < 2 <b>and <a 'x") == ["1 < 2 and <a 'x"]
    start = time.perf_counter()
    for page in ("<a '" * 250_000, "<script" * 150_000, "<!" * 500_000, "<div>" * 200_000, "</p>" * 250_000, "<p>line " * 120_000, "<p>" + "word " * 200_000, "<a \"'>" * 160_000):
        html.lines(page)
    assert time.perf_counter() - start < 8
    start = time.perf_counter()
    assert len(html.common([1] * 40_000, [1, 2] * 20_000)) == 20_000
    assert time.perf_counter() - start < 8


def test_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.choice([rng.randint(0, 12), 40]))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept, at = sorted(html.common(a, b)), 0
        assert len(kept) == best[-1][-1]
        for i in kept:
            at = b.index(a[i], at) + 1


def test_page_differencing(spark):
    body = lambda i: f"<body><p>Site name</p><p>Story {i} only here</p><p>All rights</p></body>"
    rows = [(i, f"http://h.example/a/{i}", body(i)) for i in range(30)] + [(50, "http://alone.example/", body(50)), (51, None, None), (52, "http://h.example/z", "")]
    for size in (1000, 8):
        got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)), range_pages=size).collect()}
        assert all(got[i]["text"] == f"Story {i} only here" for i in range(30))
        assert got[50]["text"] == "Site name\nStory 50 only here\nAll rights" and got[51]["text"] == "" and got[52]["n_chars"] == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_neighbours_of_a_large_host(spark):
    page = lambda i: f"<p>Site</p><p>Section {i // 3}</p><p>Story {i}</p>"
    rows = [(i, f"http://h.example/{i // 3:03}/{i % 3}", page(i)) for i in range(150)] + [(None, "http://h.example/000/0", page(0)), (200, "http://h.example/000/0", page(0))]
    df = spark.createDataFrame(rows[:150], "page_id long, url string, html string")
    for size in (1000, 32, 7, 1):
        got = {r["page_id"]: r["text"] for r in html.extract(df, range_pages=size).collect()}
        assert got == {i: f"Story {i}" for i in range(150)}, size
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    few, many = (sorted(map(str, html.extract(df, range_pages=size).collect())) for size in (1000, 7))
    assert few == many


def test_differencing_decides_within_articles(spark):
    page = lambda i, more: f"<nav>x</nav><article><h1>Title {i}</h1><p>Subscribe to our letter</p><p>Body {i}</p>{more}</article><p>Read more</p>"
    quote = "<p>A quoted paragraph</p>"
    rows = [(i, f"http://h.example/{i:02}?q={i}", page(i, quote if i in (3, 4) else "")) for i in range(10)]
    rows += [(20, "http://h.example/05?again", page(5, "")), (21, "http://h.example/055", page(5, "")), (22, rows[5][1], rows[5][2]), (22, rows[5][1], rows[5][2])]
    got = sorted((r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    want = [(i, f"Title {i}\nBody {i}" + ("\nA quoted paragraph" if i in (3, 4) else "")) for i in range(10)]
    assert got == sorted(want + [(20, want[5][1]), (21, want[5][1]), (22, want[5][1]), (22, want[5][1])])


def check_pieces(docs, pieces):
    covered = [np.zeros(len(d), int) for d in docs]
    sequences = {}
    for d, s, n, q, o in pieces:
        covered[d][s : s + n] += 1
        sequences.setdefault(q, []).append((o, n))
    assert all((c == 1).all() for c in covered)
    for parts in sequences.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end and n > 0
            end += n
        assert end == 2048 or end < 2048 and end & (end - 1) == 0


def test_packing():
    rng = np.random.default_rng(1)
    for most in (50, 3000, 9000):
        for _ in range(8):
            docs = [rng.integers(0, 300, rng.integers(1, most)).astype(np.uint16) for _ in range(rng.integers(1, 30))]
            check_pieces(docs, packing.pack(docs)[0])
    a, b = (np.arange(k, k + 1000, dtype=np.uint16) for k in (0, 5000))
    first = [d for d, _, _, q, _ in packing.pack([a, b, b + 1, a + 1])[0] if q == 0]
    assert first[:2] == [0, 3]  # the neighbour comes before the next in order
    assert packing.pack([]) == ([], [])
    # windows that go on in the next shard: nothing is cut to powers of two before the last
    docs, pieces, rest = [rng.integers(0, 300, rng.integers(1, 900)).astype(np.uint16) for _ in range(60)], [], []
    for i in range(0, 60, 20):
        names = [*range(i, i + 20), *(d for d, _, _ in rest)]
        found, left = packing.pack(docs[i : i + 20], carried=[(20 + j, s, n) for j, (_, s, n) in enumerate(rest)], last=i == 40)
        pieces += [(names[d], s, n, (i, q), o) for d, s, n, q, o in found]
        rest = [(names[d], s, n) for d, s, n in left]
    check_pieces(docs, pieces)
    ends = {}
    for _, _, n, q, o in pieces:
        ends[q] = max(ends.get(q, 0), o + n)
    assert all(n == 2048 for (i, _), n in ends.items() if i < 40)


def test_tokens_and_packed_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.PieceTokenizer(*packing.public_tokenizer(), added=packing.public_added())
    texts = fragments(4, ["a", " ", "  ", "\n", " \n", "\t", "é", "的", "1", "23", "'s", "!?", "\x1c", "\x85", "<|endoftext|>", "The", "😀"], 1500, 15)
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own(text), np.uint16).tolist() == e.ids
    rows = [(i, x) for i, x in enumerate(texts[:300])] + [(400, None), (401, "word " * 30_000), (401, "word " * 30_000), (None, "x")]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1)), *packing.public_tokenizer(), shard_docs=50, added=packing.public_added(), range_docs=40, sample_rows=100).toPandas()
    assert got.groupby("doc_id", dropna=False)["length"].sum()[401.0] == 2 * (len(own("word " * 30_000)) // 2 + 1)
    assert got["length"].sum() == sum(len(own(x)) // 2 + 1 for _, x in rows)
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), *packing.public_tokenizer()).isEmpty()


def test_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.PieceTokenizer(*packing.public_tokenizer(), added=packing.public_added())
    texts = ["abc <|endoftext|> def", *fragments(9, ["a", " ", "\n", "é", "<|endoftext|>", "<|endof", "text|>", "The"], 500, 12)]
    ids = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert ids[0] == [39305, 220, 50256, 825]
    assert [np.frombuffer(own(x), np.uint16).tolist() for x in texts] == ids
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["doc_tokens"] for r in packing.op4(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(x) + 1 for x in ids]


def test_neighbours_of_shards(spark):
    rng = random.Random(3)
    topics = [[f"{c}{k}zq{k * 7}" for k in range(12)] for c in "abcdefghij"]
    rows = [(i, " ".join(rng.choice(topics[i % 10]) if rng.random() < 0.7 else rng.choice(["the", "of", "and", "to"]) for _ in range(120))) for i in range(600)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), *packing.public_tokenizer(), shard_docs=60).toPandas()
    assert sorted(got.groupby("doc_id")["length"].sum()) == sorted(got.drop_duplicates("doc_id")["doc_tokens"])
    mates = got.groupby("sequence_id")["doc_id"].agg(lambda x: max((x % 10).value_counts()) / len(x))
    assert mates.mean() > 0.5  # a tenth by chance


def test_deep_shallow_sort():
    rng = random.Random(2)
    for _ in range(150):
        alphabet, strings = rng.choice([2, 3, 255]), []
        for _ in range(rng.randint(1, 50)):
            s = bytearray(rng.choice(strings)) if strings and rng.random() < 0.6 else bytearray(rng.randrange(alphabet) for _ in range(rng.randint(0, 50)))
            if s and rng.random() < 0.5:
                s[rng.randrange(len(s))] = rng.randrange(alphabet)
            strings.append(bytes(s[: rng.choice([50, rng.randint(0, 50)])]))
        group = np.array([rng.randrange(3) for _ in strings])
        rows = np.zeros((len(strings), 50), np.uint8)
        for i, s in enumerate(strings):
            rows[i, : len(s)] = np.frombuffer(s, np.uint8)
        order, lcp = suffixes.deep_shallow(rows, np.array([len(s) for s in strings]), group)
        want = sorted(range(len(strings)), key=lambda i: (group[i], strings[i]))
        assert [(group[i], strings[i]) for i in order] == [(group[i], strings[i]) for i in want]
        for p in range(1, len(strings)):
            a, b = strings[order[p - 1]], strings[order[p]]
            n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert lcp[p] == (-1 if group[order[p]] != group[order[p - 1]] else n)


def test_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 14) for n in queries.QUERIES if n.startswith(f"op{k}_")]
    assert len(queries.QUERIES) == 13


@pytest.mark.parametrize("range_docs", [10**6, 200, 40])
def test_copies_share_a_shard(spark, range_docs):
    """However many ranges the order is cut into, equal texts stay together; a range holds its shards alone."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    texts = ["the " * 5 + " ".join(rng.choice(words) for _ in range(40)) for _ in range(700)]
    rows = [(i, texts[i % 700]) for i in range(1400)] + [(2000 + i, "a hot copy of many") for i in range(700)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), *packing.public_tokenizer(), shard_docs=100, range_docs=range_docs, sample_rows=2000).toPandas()
    assert got["length"].sum() == got.drop_duplicates("doc_id")["doc_tokens"].sum()
    shards = got.assign(shard=got["sequence_id"] // (1 << 20)).groupby("doc_id")["shard"].agg(set)
    assert np.mean([any(abs(a - b) <= 1 for a in shards[i] for b in shards[i + 700]) for i in range(700)]) > 0.95
    if range_docs == 40:
        ranges = packing.dealt(spark.createDataFrame(rows, "doc_id long, text string"), *packing.public_tokenizer(), "text", "doc_id", 1, None, 2000, 40).groupBy("range").count().toPandas()
        assert len(ranges) > 20 and ranges["count"].max() < 300


def test_names_of_layouts_do_not_drop_the_article():
    """Hand-written pages and texts: class, id and role names rule out parts of a page, not what holds the article."""
    cases = [
        ('<div class="post-with-sidebar"><p>Whole text here</p></div>', "Whole text here"),
        ('<div class="page no-sidebar has-menu"><main>a</main></div>', "a"),
        ('<article>x<h2 id="search-results">Search results</h2><section id="social-history">b</section><p class="lead share">c</p><blockquote class="notice">d</blockquote></article>', "x\nSearch results\nb\nc\nd"),
        ('<article><p>One body line of text.</p><div class="share-buttons">Share</div><div class="post-comments"><p>first!</p></div></article>', "One body line of text."),
        ('<div class="cookie-banner">We use cookies</div><div class="main-menu">Home</div><div role="navigation">Up</div><p>The text of the page itself.</p><div id="comments">No</div><div class="sidebar_left">s</div>', "The text of the page itself."),
        ('<div class="related"><article class="card">Another</article></div><p>What the page says, at some length.</p>', "Another\nWhat the page says, at some length."),
        ('<article><h1>T</h1><p>Text of it, long enough.</p></article><div class="related"><article class="card">Another</article></div>', "T\nText of it, long enough."),
        ('<div class="sidebar">all of this page stands in one element</div>', "all of this page stands in one element"),
        ('<div id="menu"><h1>Menu of the day</h1><p>Soup</p></div>', "Menu of the day\nSoup"),
        ('<nav class="x">n</nav><body class="sidebar"><p class="comment">c</p><p>kept text</p></body>', "kept text"),
    ]
    for page, text in cases:
        assert html.text_of(html.lines(page), set(), set()) == text, page
