"""Corpus pipeline: documents to packed training sequences.

Stages, each over all that its predecessor kept: toxic documents go, one
document of each near-duplicate component stays, secrets are blanked out, the sources are mixed to target weights
(documents repeat or drop out accordingly), and what is left is packed.
All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm import mixing, near_copies, packing, secrets, toxicity
from docquery.llm.common import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is below one half."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.drop_near_copies(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets' spans replaced; n_chars follows."""
    found = secrets.find(docs, owner=F.col("source"), repo=F.col("lang"))
    clean = secrets.redact(docs, secrets.classify(found))
    changed = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))
    return clean.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("secrets", blank_secrets),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The trained classifier has no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
