"""A corpus through five stages: each is one operator, its result a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import held_out, save, table
from quillon.llm.decontaminate import drop_contaminated
from quillon.llm.minhash import near_duplicates
from quillon.llm.packing import pack
from quillon.llm.pii import redact
from quillon.llm.toxicity import drop_toxic

#: Score from which a document is rejected.
TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text scores toxic; learns from the labels not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return drop_toxic(docs, labels, TOXIC)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group the document with the least doc_id.

    Rows that share a doc_id are one document: they stay or go together, but of
    rows equal in doc_id and text one stays (the one whose columns hash least).
    Rows without doc_id stay; an empty table stays empty.
    """
    judged = near_duplicates(docs.select("doc_id", "text"), k=5, percent=80)
    dropped = judged.filter("not kept and doc_id is not null").select("doc_id").distinct()
    named, rest = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    left = named.join(dropped, "doc_id", "left_anti").select(F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    first = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy(F.xxhash64("row")))
    return left.withColumn("n", first).filter("n = 1").select("row.*").unionByName(rest)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; every document stays."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens: a row per piece."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learned scores, BM25 and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of ``sf_dir`` through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
