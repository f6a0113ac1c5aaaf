"""What the operators share: durable cuts, row reading, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import durable, ship

#: The white space that the operators know, as a character class of Java, RE2 and Python.
WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not have yet (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows up to which a table of groups is broadcast.
SMALL_ROWS = 20_000


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it has few rows; else joins with it are left to adaptive execution."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` under column names that clash with nothing, and the new name of each old one."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def by_value(df: DataFrame, first: str) -> list[Column]:
    """An order of rows by all they hold, `first` first, so that rows that tie are equal; maps and variants count as JSON."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = lambda c: not any(k in kinds[c] for k in ("map<", "variant"))
    return [F.col(c) if plain(c) else F.to_json(F.struct(c)) for c in [first, *(c for c in df.columns if c != first)]]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Label the nodes of `edges(a long, b long)` with the smallest node that they reach.

    Large-star and small-star steps alternate until the edges stay the same, so the
    number of rounds follows the logarithm of the size and no step gathers a component:
    a star's centre is found with `min`, which combines before the shuffle, and its
    rays are rewritten by a join that adaptive execution may split.

    Returns (node, root), one row for each node with an edge; empty for no edges.
    Self loops and null ends are dropped, repeated edges count once.
    """
    e = durable(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a node moves to the node's minimum.
        e = (
            both.filter("b > a").join(low, F.col("a") == F.col("k"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # Small star: the smaller neighbours of a node, and the node, move to the smallest of them.
        low = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = e.join(low, F.col("a") == F.col("k")).select("a", "b", "m")
        e = durable(
            joined.select(F.explode(F.array(F.struct(F.col("a").alias("x")), F.struct(F.col("b").alias("x")))).alias("s"), "m")
            .select(F.col("s.x").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def schema_with(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The frame's schema and one more column; the frame's own is left as it is."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


#: Bytes of text that are worked on at once.
SLICE = 1 << 20


def slices(batch: pa.RecordBatch, k: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with `most` bytes in column k or with one row; lists count eight bytes an element."""
    column = batch.column(k)
    sizes = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def mapped(df: DataFrame, run, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def grouped(groups, run, schema: T.StructType | str, spark: SparkSession) -> DataFrame:
    """applyInArrow of grouped data with this package at hand on the executors."""
    ship(spark)
    return groups.applyInArrow(run, schema)
