"""The leaves of nested records as rows: one pass of repeated explodes, without Python and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.scalars import pointer_escape
from loomline.operators import redact


def depth(json_text: Column) -> Column:
    """How many containers of a JSON text stand inside each other, at most; 0 for null and for a scalar."""
    # Escapes go first, then strings: one pattern for both would recurse with the length of a string.
    plain = F.regexp_replace(F.regexp_replace(json_text, r"\\.", ""), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    step = lambda s, c: F.struct((s["d"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)).alias("d"), F.greatest(s["m"], s["d"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("m"))
    return F.coalesce(F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step)["m"], F.lit(0))


def leaves(records: DataFrame, value: str, keep: list[str], root: str = "", levels: int | None = None) -> DataFrame:
    """(keep, path, kind, leaf): the scalars and empty containers of a variant column, by JSON Pointer below `root`.

    Each level is an outer explode that leaves rows without a container as they are, so one
    scan and one chain of generators give all levels. `levels` is how deep records go; if it is
    not given the records are asked. A null variant has no leaves, a JSON null is one.
    """
    rows = records.filter(F.col(value).isNotNull()).select(*keep, F.lit(root).alias("path"), F.col(value).alias("leaf"))
    if levels is None:
        levels = rows.agg(F.max(depth(F.to_json("leaf")))).first()[0] or 0
    spark = records.sparkSession
    for _ in range(levels):
        parts = spark.tvf.variant_explode_outer(F.col("leaf").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
        inner = F.col("_pos").isNotNull()
        rows = rows.lateralJoin(parts).select(
            *keep, F.when(inner, F.concat("path", F.lit("/"), F.coalesce(pointer_escape("_key"), F.col("_pos").cast("string")))).otherwise(F.col("path")).alias("path"), F.when(inner, F.col("_value")).otherwise(F.col("leaf")).alias("leaf"))
    return rows.select(*keep, "path", F.schema_of_variant("leaf").alias("kind"), "leaf")


def matching(text: Column, patterns) -> Column:
    """Ids of the patterns that a text matches, each looked for in the text as it is."""
    hits = [F.when(redact._may_hold(name, text) & text.rlike(pattern), F.lit(name)) for name, pattern, _ in patterns]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def secrets(records: DataFrame, value: str, keep: list[str], root: str = "", patterns=redact.CREDENTIALS, levels: int | None = None) -> DataFrame:
    """(keep, path, pattern): each string leaf with each pattern that it matches, once however often it does.

    Only records whose JSON text may hold a match are taken apart.
    """
    some = records.filter(redact.suspect(F.to_json(value), patterns))
    texts = leaves(some, value, keep, root, levels).filter("kind = 'STRING'").select(*keep, "path", F.try_variant_get("leaf", "$", "string").alias("text"))
    return texts.select(*keep, "path", F.explode(matching(F.col("text"), patterns)).alias("pattern"))


def redacted_values(records: DataFrame, raw: str, patterns=redact.CREDENTIALS) -> DataFrame:
    """`records` with every string in the JSON text `raw` redacted; texts that can't hold a match stay byte for byte and never reach Python."""
    return redact.scrubbed(records, raw, patterns)
