"""Exact dedup by deterministic block naming, with DataFrame functions only.

The normalised text is cut into blocks of a fixed number of characters. Distinct
blocks are sorted and get integer names; then adjacent pairs of names are sorted and
named, level by level, until a document has one name. Two documents have equal texts
if and only if they end on the same level with the same name.

A block's content is shuffled once, to be named. All that follows moves integers. A
hash only routes the blocks: distinct blocks that share a hash get different names,
and rows with such a hash are matched by content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import WS, by_value, durable, numbered_columns

BLOCK_CHARS = 2048
#: The second half of a pair where a document has an odd number of names.
NOTHING = -1


def _blocks(docs: DataFrame, text_col: str, block_chars: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.withColumn("norm", F.regexp_replace(text, WS + "+", "")).withColumn("points", F.length(text).cast("long"))
    return norm.withColumn("blocks", F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0)))


def _route(block, hash_bits: int):
    return F.shiftright(F.xxhash64(block), 64 - hash_bits)


def _numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Sort and number rows; materialised, so that a lost task cannot number them anew."""
    ranked = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable(ranked.withColumn("name", F.monotonically_increasing_id()))


def _named_blocks(cut: DataFrame, light: DataFrame, hash_bits: int) -> DataFrame:
    """(doc_id, sha, n, i, name): the blocks of each document under integer names."""
    rows = cut.select("doc_id", "norm", F.explode("blocks").alias("block")).withColumn("h", _route("block", hash_bits))
    # One row for each hash; its set has one block unless the hash collides.
    sets = rows.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("set"))
    names = _numbered(
        sets.select("h", F.size("set").alias("shared"), F.posexplode("set").alias("tie", "block"))
        .select("h", "tie", "shared", F.when(F.col("shared") > 1, F.col("block")).alias("block")),
        "h", "tie",
    )
    alone = names.filter("shared = 1").select("h", "name")
    placed = light.select("doc_id", "sha", F.size("hs").cast("long").alias("n"), F.posexplode("hs").alias("i", "h"))
    named = placed.join(alone, "h")
    clashing = names.filter("shared > 1").select("h", "block", "name")
    if not clashing.isEmpty():
        full = cut.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.size("blocks").cast("long").alias("n"), F.posexplode("blocks").alias("i", "block"))
        named = named.unionByName(full.withColumn("h", _route("block", hash_bits)).join(clashing, ["h", "block"]).drop("block"))
    return named.select("doc_id", "sha", "n", F.col("i").cast("long").alias("i"), "name")


def _identities(docs: DataFrame, id_col: str, text_col: str, block_chars: int, hash_bits: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, points, sha, hs) for each row, and (doc_id, sha, level, name) for each id and normalised text."""
    cut = _blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text", block_chars)
    light = durable(cut.select(
        "doc_id", "points", F.unhex(F.sha2("norm", 256)).alias("sha"),
        F.transform("blocks", lambda b: _route(b, hash_bits)).alias("hs")))
    seq = durable(_named_blocks(cut, light.dropDuplicates(["doc_id", "sha"]), hash_bits).distinct())
    empty = light.filter("size(hs) = 0").select("doc_id", "sha").distinct()
    ended = empty.select("doc_id", "sha", F.lit(-1).alias("level"), F.lit(0).cast("long").alias("name"))
    level = 0
    while True:
        ended = ended.unionByName(seq.filter("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name"))
        rest = seq.filter("n > 1")
        if rest.isEmpty():
            return light, ended
        pairs = (
            rest.groupBy("doc_id", "sha", "n", F.expr("i div 2").alias("i"))
            .agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("l"),
                 F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(NOTHING)).alias("r"))
        )
        names = _numbered(pairs.select("l", "r").distinct(), "l", "r")
        seq = durable(
            pairs.join(names, ["l", "r"]).select("doc_id", "sha", F.expr("(n + 1) div 2").alias("n"), "i", "name")
        )
        level += 1


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """One row for each row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, points, nth.

    Null texts count as empty; empty texts are one group. Of a group the row with the
    most code points stays, then the one with the smallest doc_id; a null doc_id comes
    last. If the same doc_id comes with the same text more than once, one such row stays
    (`nth` numbers rows of equal id and normalised text). Other columns are not read.
    """
    rows, named = _identities(docs, id_col, text_col, block_chars, hash_bits)
    same = (F.col("doc_id").eqNullSafe(F.col("id2"))) & (F.col("sha") == F.col("sha2"))
    rows = durable(
        rows.drop("hs").join(named.select(F.col("doc_id").alias("id2"), F.col("sha").alias("sha2"), "level", "name"), same)
        .select("doc_id", "points", "sha", "level", "name")
    )
    groups = rows.groupBy("level", "name").agg(
        F.count("*").alias("group_size"),
        F.max(F.struct("points", F.expr("doc_id is not null").alias("known"), F.expr("~doc_id").alias("low"))).alias("best"),
    ).select("level", "name", "group_size", F.expr("~best.low").alias("keep_id"), F.col("best.points").alias("most"))
    out = rows.join(groups, ["level", "name"])
    first = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("points") == F.col("most"))
    # Only rows that may stay are numbered, by keys of their own, so that the join above
    # is free to split a large group.
    stay = out.filter(first).withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "sha").orderBy("points")))
    go = out.filter(~first).withColumn("nth", F.lit(0))
    return stay.unionByName(go).select(
        "doc_id", "keep_id", "group_size", (F.col("nth") == 1).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "points",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of `docs` that stay, with the columns they had.

    Rows are told apart by id, normalised text and length; of rows that agree in all three
    the first by text and then by the other columns stays. Empty tables give empty results.
    """
    plain, at = numbered_columns(docs)
    ident, body = at[id_col], at[text_col]
    text = F.coalesce(F.col(body), F.lit(""))
    marked = plain.withColumn("sha", F.sha2(F.regexp_replace(text, WS + "+", ""), 256)).withColumn("points", F.length(text).cast("long"))
    stay = decisions(plain, ident, body, block_chars).filter("kept").select(
        F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"), F.col("points").alias("k_points"))
    on = F.col(ident).cast("long").eqNullSafe(F.col("k_id")) & (F.col("sha") == F.col("k_sha")) & (F.col("points") == F.col("k_points"))
    found = marked.join(stay, on, "left_semi")
    one = W.partitionBy(ident, "sha", "points").orderBy(*by_value(plain, body))
    return found.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select(*plain.columns).toDF(*docs.columns)


def op9_block_naming(spark, sf_dir):
    return decisions(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("points")


OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, norm, length(t) AS points,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
