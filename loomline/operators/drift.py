"""How the records of a source differ from the ones that its schema was written for.

A profile is a set of paths with counts, by agent, version and record type. It combines
before the shuffle and profiles add up, so that of any number of records only a few hundred
rows are compared, and a new field is one row a version, not one a record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.leaves import leaves

KEYS = ["agent", "version", "type"]


def _kind(kind: Column) -> Column:
    """One name for each kind of leaf: numbers are numbers, whatever their size."""
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null")


def profile(records: DataFrame, value: str, opaque: tuple[str, ...] = (), levels: int | None = None) -> DataFrame:
    """(agent, version, type, path, kind, n) of `records(agent, version, type, <variant>)`: how often each path holds a leaf of a kind.

    A place in an array is `*`. What stands below one of the `opaque` paths is data and not
    form, such as the arguments of a tool: all of it is one path that ends in `**`.
    """
    rows = leaves(records, value, KEYS, levels=levels)
    path = F.regexp_replace(F.regexp_replace("path", "/[0-9]+(?=/|$)", "/*"), "/[0-9]+(?=/|$)", "/*")
    kind = _kind(F.col("kind"))
    for p in sorted(opaque, key=len, reverse=True):
        below = path.startswith(p + "/")
        path, kind = F.when(below, F.lit(p + "/**")).otherwise(path), F.when(below, F.lit("any")).otherwise(kind)
    return rows.select(*KEYS, path.alias("path"), kind.alias("kind")).groupBy(*KEYS, "path", "kind").agg(F.count("*").alias("n"))


def merged(profiles: list[DataFrame]) -> DataFrame:
    """One profile of several."""
    return reduce(DataFrame.unionByName, profiles).groupBy(*KEYS, "path", "kind").agg(F.sum("n").alias("n"))


def drift(seen: DataFrame, known: DataFrame) -> DataFrame:
    """(agent, version, type, path, kind, n, code) of what a profile has and the known form (agent, type, path, kind) does not have.

    `source-unknown-type`: no record of this type is known, one row with the number of leaves.
    `source-unknown-field`: the path is not known for the type. `source-type-mismatch`: it is,
    with leaves of other kinds only. Null is a leaf of any kind.
    """
    own = ["agent", "type"]
    types = known.select(*own).distinct().withColumn("_type", F.lit(True))
    paths = known.groupBy(*own, "path").agg(F.collect_set("kind").alias("_kinds"))
    rows = seen.join(types, own, "left").join(paths, [*own, "path"], "left")
    fits = F.coalesce((F.col("kind") == "null") | F.array_contains("_kinds", F.col("kind")), F.lit(False))
    code = F.when(F.col("_type").isNull(), "source-unknown-type").when(F.col("_kinds").isNull(), "source-unknown-field").when(~fits, "source-type-mismatch")
    found = rows.withColumn("code", code).filter("code is not null")
    new = F.col("code") == "source-unknown-type"
    return found.groupBy(*KEYS, F.when(new, "").otherwise(F.col("path")).alias("path"), F.when(new, "").otherwise(F.col("kind")).alias("kind"), "code").agg(F.sum("n").alias("n")).select(*KEYS, "path", "kind", "n", "code")
