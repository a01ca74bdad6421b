"""A training corpus from raw documents: five stages, each of one operator.

Every stage takes what its predecessor kept, as ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``, others than theirs included. Intermediate results are written as Parquet in the shared folder of
``spark.checkpoint.dir`` (a temporary folder only in a session on one machine that names none) and read again.

Defined results of every stage: an empty table gives an empty table. Null and empty texts are kept by all filters, as they
are neither toxic nor copies of anything nor contaminated, and are packed as documents of the end token alone. A null id is
an id of its own kind: such rows are told apart by their texts. Very long texts are worked on whole. Repeated rows are one
document from the second stage on. Ties: of near-duplicates, the smallest id stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import decontam, jaccard, packing, secrets
from cubeloom.llm.common import read
from cubeloom.llm.toxicity import Toxicity
from cubeloom.session import shared_folder

WORDS, PERCENT = 5, 80


def row_key():
    """The document's id; for a null one, a number by its text that is larger than all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance calls toxic go (a score of at least 0.7); null texts stay, and without
    labels of both classes all do."""
    model = Toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return model.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, a similarity of at least 0.8, by links) the document of the
    smallest id stays; rows of equal id and text are one document. Texts without words are copies of nothing."""
    keyed = docs.withColumn("_key", row_key())
    found = jaccard.join(keyed, key="_key", words=WORDS, percent=PERCENT)
    first = found.filter(F.col("_key") == F.col("component_id")).select("_key").distinct()
    return keyed.join(first, "_key", "left_semi").dropDuplicates(["_key", "text"]).drop("_key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item (an item of fewer words is one window) go. An empty
    benchmark takes none; neither are documents without words taken."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    hit = decontam.hits(keyed, read(spark, sf_dir, "benchmark"), key="_key").filter("n_hit > 0").select("_key").distinct()
    return keyed.join(hit, "_key", "left_anti").drop("_key")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, overlapping ones by one mark; every document stays, null texts as they are, and
    ``n_chars`` follows its text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens; a null or empty text is its end token alone, and no
    document gives no sequence."""
    return packing.pack_documents(docs, *packing.public_tokenizer(), added=packing.public_added())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]

#: Zstandard's lengths, a trained classifier and a tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
