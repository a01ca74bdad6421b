"""The pipeline's stages, one after the other, on the smallest tables and on a table of edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cubeloom.llm import decontam, jaccard, secrets
from cubeloom.llm.common import folded, packed, read
from tests.llm.test_words import components

STAGES = dict(corpus_pipeline.STAGES)


def test_stages(spark, sf):
    docs = read(spark, sf, "documents").cache()
    columns = docs.columns
    assert list(STAGES) == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "packing"]

    mild = STAGES["toxicity"](spark, docs, sf)
    assert mild.columns == columns and mild.count() <= docs.count()
    single = STAGES["near_duplicates"](spark, docs, sf).cache()
    groups = jaccard.join(docs, words=5, percent=80).select("component_id").distinct().count()
    assert single.columns == columns and single.count() == groups
    assert jaccard.join(single, words=5, percent=80).filter("doc_id <> component_id").isEmpty()
    clean = STAGES["decontamination"](spark, docs, sf)
    assert clean.columns == columns
    assert decontam.hits(clean, read(spark, sf, "benchmark")).filter("n_hit > 0").isEmpty()
    safe = STAGES["secret_scan"](spark, docs, sf)
    assert safe.columns == columns and safe.count() == docs.count()
    assert secrets.scan(safe).filter("size(found) > 0").isEmpty()


def test_run(spark, sf):
    got = corpus_pipeline.run(spark, sf).toPandas()
    sizes = got.groupby("sequence_id")["length"].sum()
    assert len(got) and all(n == 2048 or n & (n - 1) == 0 for n in sizes)


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("edges"))
    body = " ".join(f"w{i}" for i in range(60))
    item = "the quick brown fox jumps over the lazy dog today"
    rows = [(1, body, "a"), (2, body + " more", "a"), (2, body + " more", "a"), (None, body, "a"), (None, "another text without an id", "a"), (None, "another text without an id", "a")]
    rows += [(3, None, None), (4, "", None), (5, " \n", None), (6, f"see {item} ok", "b"), (None, f"also {item} ok", "b"), (7, "long " * 40_000, "b"), (8, "token: abcdef99 x", "b"), (9, None, "c"), (10, "few words", "c")]
    rows += [(i, f"mild text number {i} of a few", "d") for i in range(20, 60)] + [(i, f"you idiot number {i} of a few", "d") for i in range(60, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n_chars": F.length("text"), "sig": F.lit(1), "_t": F.lit("x"), "n_hit": F.lit(7)})
    docs.write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i >= 60)) for i in range(20, 100)], "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    spark.createDataFrame([("i", item), ("j", None)], "item_id string, text string").write.parquet(f"{to}/benchmark.parquet")
    return to


def test_edge_cases(spark, edges):
    docs = read(spark, edges, "documents")
    kept = lambda stage: sorted(((r["doc_id"], r["text"]) for r in STAGES[stage](spark, docs, edges).collect()), key=str)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept("toxicity") == sorted([r for r in rows if "idiot" not in (r[1] or "")], key=str)

    texts = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0, str(r[1])))
    found = components([(k, t, None) for k, (_, t) in enumerate(texts)], 5, 80)
    assert kept("near_duplicates") == sorted([texts[k] for k, (_, c) in found.items() if c == k], key=str)
    assert kept("decontamination") == sorted([r for r in rows if "quick" not in (r[1] or "")], key=str)
    assert kept("secret_scan") == sorted([(i, "[SECRET] x" if i == 8 else t) for i, t in rows], key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, edges).columns == docs.columns, name
    packed = STAGES["packing"](spark, docs, edges).toPandas()
    assert (packed["length"] > 0).all() and packed.groupby("doc_id")["length"].sum()[3.0] == 1


def test_empty(spark, edges, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        read(spark, edges, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_driver_gets_packed_blocks(spark, sf):
    """What near_duplicates sends to the driver is held to 4 MB a stage: a count sketch unpacked has 8 MB."""
    docs = read(spark, sf, "documents").repartition(12).cache()
    want = sorted((r["doc_id"], r["text"]) for r in STAGES["near_duplicates"](spark, docs, sf).collect())
    conf = spark.sparkContext._jsc.sc().conf()  # the application's own, which each stage reads
    conf.set("spark.driver.maxResultSize", "4m")
    try:
        assert sorted((r["doc_id"], r["text"]) for r in STAGES["near_duplicates"](spark, docs, sf).collect()) == want
    finally:
        conf.remove("spark.driver.maxResultSize")


def test_folded(spark):
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 1 << 40, 1000) for _ in range(30)]
    parts = spark.createDataFrame([(bytearray(packed(a)),) for a in arrays], "m binary").repartition(7)
    assert (folded(parts, 1000, np.int64, np.add) == sum(arrays)).all()
    assert (folded(parts, 1000, np.int64, np.bitwise_or) == np.bitwise_or.reduce(arrays)).all()
    assert not folded(parts.limit(0), 1000, np.int64, np.add).any()
