"""Token counts from an exact length histogram.

Documents are encoded and only their lengths go on: counts by length combine before the
shuffle, so its size follows the number of distinct lengths. Sums from the longest
length down then answer, for every context limit, how many documents exceed it, how
many tokens there are, and how many remain when documents are cut at the limit.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.bpe import broadcast_automaton
from loomline.llm.common import durable, free_name, mapped, schema_with, slices

#: Lengths are summed in blocks of so many, then within each block.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, text_col: str = "text", length_col: str = "n_tokens", path: str | None = None) -> DataFrame:
    """`docs` with the number of tokens of each whole text in `length_col`; null texts have none, underscores follow a name that is taken."""
    length_col = free_name(docs, length_col)
    shared = broadcast_automaton(docs.sparkSession, path)
    k = docs.columns.index(text_col)

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, k)):
            auto = shared.value
            n = pa.array([len(auto.encode(t.as_py())) for t in batch.column(k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, length_col])

    return mapped(docs, run, schema_with(docs, length_col, "long"))


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs) for each length that occurs; null lengths count as 0."""
    return lengths.groupBy(F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram, as a context limit:

    docs_ge and tokens_ge: documents of L tokens or more, and their tokens;
    docs_total, tokens_total: of all documents;
    truncated_total: tokens that remain when every document is cut to L;
    docs_cut: documents longer than L;
    docs_le: documents that fit, from which quantiles are read.
    An empty histogram gives no rows.
    """
    hist = durable(hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")))
    after = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # One row for each block of lengths: the longest document's length over 1,024.
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t")).select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    down = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = hist.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.col("docs_after") + F.sum("n_docs").over(down)).alias("docs_ge"),
        (F.col("tokens_after") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(down)).alias("tokens_ge"), "docs_total", "tokens_total")
    return out.withColumns({
        "docs_cut": F.col("docs_ge") - F.col("n_docs"),
        "docs_le": F.col("docs_total") - F.col("docs_ge") + F.col("n_docs"),
        "truncated_total": F.col("tokens_total") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens"),
    })


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_cut, truncated_total) for any limits, whether a document has that length or not."""
    asked = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits]))
    longer = sums.withColumn("limit", asked).groupBy("limit").agg(
        F.max("tokens_total").alias("total"), F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs"))).alias("cut"),
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs") * (F.col("n_tokens") - F.col("limit")))).alias("lost"))
    return longer.select("limit", F.coalesce("cut", F.lit(0)).alias("docs_cut"), (F.col("total") - F.coalesce("lost", F.lit(0))).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that the share of the documents does not exceed."""
    asked = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    fits = F.col("docs_le") >= F.col("share") * F.col("docs_total")
    return sums.withColumn("share", asked).groupBy("share").agg(F.min(F.when(fits, F.col("n_tokens"))).alias("n_tokens"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return suffix_sums(histogram(encoded_lengths(docs)))
