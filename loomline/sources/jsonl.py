"""JSONL as a source: strict and tolerant scans, unions and merges of readers."""

from __future__ import annotations

import base64
import gzip
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.session import durable


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw bytes): every line of every file; one trailing CR goes, a last line feed ends the file.

    Files are read by Spark's text source, which splits them by ranges of bytes and reads
    a line with the range where it starts, so neither a file nor a split is ever held
    whole. Lines are numbered by their place in a range, shifted by the lines of the
    ranges before. Bytes are kept as they are. A file without bytes has no lines.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    # The text source gives bytes as they are; only the type says that they are UTF-8.
    rows = text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("raw"))
    # Ids grow along a block, so those below a block's first one are not its own.
    first = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = durable(first.select("file", "block", (before - F.col("first") + 1).alias("shift")))
    raw = F.encode(F.regexp_replace(F.decode("raw", "ISO-8859-1"), r"\r\z", ""), "ISO-8859-1")
    return rows.join(start, ["file", "block"]).select("file", (F.col("at") + F.col("shift")).cast("int").alias("line"), raw.alias("raw"))


def parsed(rows: DataFrame) -> DataFrame:
    """(file, line, raw text, value variant, code): code names what is wrong with a line, or is null."""
    valid = F.expr("is_valid_utf8(raw)")
    text = F.when(valid, F.decode("raw", "UTF-8"))
    out = rows.withColumn("text", text).withColumn("value", F.try_parse_json("text"))
    kind = F.schema_of_variant("value")
    code = (F.when(F.col("text").isNull(), "invalid_utf8").when(F.trim("text") == "", "empty_line")
            .when(F.col("value").isNull(), "invalid_json").when(~kind.startswith("OBJECT"), "non_object"))
    return out.withColumn("code", code).select("file", "line", F.col("text").alias("raw"), "value", "code")


def strict(rows: DataFrame) -> DataFrame:
    """Lines before the first faulty one of their file, and that one with its code."""
    first = F.min(F.when(F.col("code").isNotNull(), F.col("line"))).over(W.partitionBy("file"))
    return parsed(rows).withColumn("first_bad", first).filter("first_bad is null or line <= first_bad").drop("first_bad")


def tolerant(rows: DataFrame) -> DataFrame:
    """Lines that hold an object."""
    return parsed(rows).filter("code is null").drop("code")


def chain(readers: list[DataFrame]) -> DataFrame:
    """All rows with `reader`, their reader's place; order by (reader, line)."""
    return reduce(DataFrame.unionByName, [r.withColumn("reader", F.lit(i)) for i, r in enumerate(readers)])


def merge_by_timestamp(readers: list[DataFrame], ts: str = "ts", line: str = "line") -> DataFrame:
    """All rows with their `place` by time; rows without a time come first, ties keep the readers' order."""
    at = F.coalesce(F.col(ts).cast("string").try_cast("double"), F.lit(float("-inf")))
    return placed(chain(readers).withColumn("_time", at), "_time", "reader", line).drop("_time")


def placed(rows: DataFrame, *order) -> DataFrame:
    """`rows` with `place`, from 1, in a total order: ranges of the order are sorted apart and shifted by the number of rows before them.

    No task sees more than a range. Rows that tie in the whole order get places in any order.
    """
    at = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # One row for each partition.
    n = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = n.select("_part", before.alias("_start"))
    nth = F.col("_at").bitwiseAND((1 << 33) - 1)
    return at.withColumn("_part", part).join(F.broadcast(start), "_part").withColumn("place", F.col("_start") + nth + 1).drop("_at", "_part", "_start")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, identity): SHA-256 of a file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.sha2("content", 256).alias("identity"))


def combined_identity(identities: list[DataFrame], source: list[str]) -> DataFrame:
    """(source, identity) of chained or merged readers: SHA-256 of their identities, one a line, in the order of the readers.

    identities: a frame (source, identity) of each reader. A source that a reader does not
    know has no identity, since the chain could not read it.
    """
    rows = chain([i.select(*source, "identity") for i in identities]).groupBy(*source).agg(F.array_sort(F.collect_list(F.struct("reader", "identity"))).alias("r"), F.count_distinct("reader").alias("n"))
    joined = F.array_join(F.transform("r", lambda x: x["identity"]), "\n")
    return rows.filter((F.col("n") == len(identities)) & (F.size("r") == len(identities))).select(*source, F.sha2(joined, 256).alias("identity"))


def decode_payload(payload: str) -> str:
    """Text of a shared payload: base64 of gzip of UTF-8, white space around it ignored."""
    return gzip.decompress(base64.b64decode(payload.strip())).decode()


def encode_payload(text: str) -> str:
    return base64.b64encode(gzip.compress(text.encode(), mtime=0)).decode()


def shared_id(url) -> F.Column:
    """The id in a shared address, or a bare id of 20 to 32 hex digits; queries and fragments are ignored."""
    u = F.regexp_replace(F.trim(F.col(url) if isinstance(url, str) else url), r"[?#].*$", "")
    found = F.regexp_extract(u, r"^(?:https?://[^/]+/(?:[^/]+/)*)?([0-9a-fA-F]{20,32})(?:/[^/]*)?/?$", 1)
    return F.when(found != "", F.lower(found))
