"""Comparing what two adapters make of the same records, without the ids that differ between them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from loomline.session import durable, ship

# Fields that hold ids, by the part of an entry they stand in.
VOLATILE = {(): ("id", "parent_id"), ("payload",): ("for_id", "abandoned_branch_id", "open_call_ids"), ("semantic",): ("call_id", "group_id"), ("source", "raw"): ("envelope_ref",)}


def _plain(value):
    """A value with single spaces for the white space in its strings."""
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return {k: _plain(x) for k, x in value.items()} if isinstance(value, dict) else value


def _signature(text: str | None) -> str | None:
    try:
        entry = None if text is None else json.loads(text)
    except ValueError:
        entry = None
    if entry is None:
        return None
    for path, names in VOLATILE.items():
        at = entry
        for part in path:
            at = at.get(part) if isinstance(at, dict) else None
        for name in names if isinstance(at, dict) else ():
            at.pop(name, None)
    return json.dumps(_plain(entry), ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def signatures(entries: DataFrame, raw: str = "raw", out: str = "signature") -> DataFrame:
    """`entries` with what their JSON text says apart from ids and white space; null for null and for what is no JSON."""
    ship(entries.sparkSession)
    return entries.withColumn(out, F.pandas_udf(lambda s: s.map(_signature).astype(object), T.StringType())(raw))


def numbered(rows: DataFrame, group: list[str], order: list[str], out: str = "nth") -> DataFrame:
    """`rows` with their number within their group, from 1, in order; nulls of a group are one value.

    Rows are sorted in ranges of (group, order), and a group that fills many ranges is numbered in
    each of them and moved by what stands before, so the most frequent group costs no task more
    than its range.
    """
    at = durable(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id()))
    n = at.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).filter("_before > 0")
    right = before.select(*[F.col(c).alias(f"_{c}") for c in (*group, "_part")], "_before")
    local = at.withColumn("_nth", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*group, "_part")]
    return durable(local.join(right, on, "left").select(*rows.columns, (F.col("_nth") + F.coalesce("_before", F.lit(0))).alias(out)))


def compare_entries(old: DataFrame, new: DataFrame, order: list[str], expected: Column | None = None, raw: str = "raw", scope: list[str] = ()) -> DataFrame:
    """(scope, order, raw, side, verdict) of all entries of both sides; entries are compared within their scope, such as a file.

    Equal entries are matched one to one, in order: a matched old one is `preserved`, one
    without a match a `regression`, or `expected` where that condition on it holds; a new
    one without a match is an `addition`, a matched one `preserved`.
    """
    both = signatures(old.select(*scope, *order, raw), raw).withColumn("side", F.lit("old")).unionByName(signatures(new.select(*scope, *order, raw), raw).withColumn("side", F.lit("new")))
    of = [*scope, "signature"]
    both = numbered(both, [*of, "side"], order)
    n = durable(both.groupBy(*of).agg(F.count_if(F.col("side") == "old").alias("n_old"), F.count_if(F.col("side") == "new").alias("n_new")).select(*[F.col(c).alias(f"_{c}") for c in of], "n_old", "n_new"))
    rows = both.join(n, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in of])
    matched = F.col("nth") <= F.least("n_old", "n_new")
    lost = F.lit("regression") if expected is None else F.when(F.coalesce(expected, F.lit(False)), "expected").otherwise("regression")
    return rows.select(*scope, *order, raw, "side", F.when(matched, "preserved").when(F.col("side") == "new", "addition").otherwise(lost).alias("verdict"))


def harness(compared: DataFrame, scope: list[str], errors: DataFrame | None = None) -> DataFrame:
    """(scope, preserved, regressions, expected, additions, error, blocking): a row for each file that two adapters were run on.

    compared: what `compare_entries` says, in the same scope. errors(scope, error): files that
    one of the adapters could not read; such a file blocks, whatever else is known of it, and
    so does one with a regression.
    """
    n = lambda side, verdict: F.count_if((F.col("side") == side) & (F.col("verdict") == verdict))
    out = compared.groupBy(*scope).agg(n("old", "preserved").alias("preserved"), n("old", "regression").alias("regressions"), n("old", "expected").alias("expected"), n("new", "addition").alias("additions"))
    if errors is not None:
        out = out.join(errors.groupBy(*scope).agg(F.min("error").alias("error")), scope, "full")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    counts = ["preserved", "regressions", "expected", "additions"]
    return out.select(*scope, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "error", (F.col("error").isNotNull() | (F.coalesce("regressions", F.lit(0)) > 0)).alias("blocking"))
