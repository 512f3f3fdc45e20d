"""From documents to packed training sequences: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrain.llm.exact_dedup import exact_dedup
from tracegrain.llm.jaccard_join import JaccardJoin
from tracegrain.llm.packing import pack
from tracegrain.llm.pii import Pii
from tracegrain.llm.quality_rules import quality_rules as judged
from tracegrain.llm.shared import cut, without_ids

#: Learned lists, packing and corpus estimates are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the base rules and the learned decision list keep."""
    rows = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("__row"))
    return judged(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("__row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.85 connect, the one with the smallest doc_id; rows without a doc_id stay."""
    others = JaccardJoin(docs).membership().where("id != component").select(F.col("id").alias("doc_id"))
    return without_ids(docs, others, "doc_id")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose it replaced; n_chars follows."""
    return Pii(docs).sanitise().withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("pii", personal_data),
    ("sum_of_squares_packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
