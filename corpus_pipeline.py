"""The corpus pipeline: stages over documents, each written and read by the next.

What a stage decides takes effect: rejected documents and copies leave, documents of
small sources come more than once so that the sources reach their weights, and the last
stage turns texts into tokens. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.bpe import encode_and_decode
from loomline.llm.exact_dedup import exact_dedup
from loomline.llm.minhash import near_texts
from loomline.llm.mixing import mix
from loomline.llm.quality_rules import quality_filter
from loomline.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the adaptive fences keep."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with similar sets of five-word shingles the document with the smallest doc_id."""
    return near_texts(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are drawn; the budget draws every source whole, so none is lost."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded), one row for each draw."""
    return encode_and_decode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixing), ("bpe tokens", tokens)]

#: SQL can't express components of similar texts, permutations and tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is Parquet in a folder of this run under the shared one."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
