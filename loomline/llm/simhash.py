"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints within three bits have a point between them: one fingerprint flips
half of the differing bits to get there, the other the rest. Every fingerprint emits
the variants within half the radius, a shuffle brings equal variants together, and what
meets is linked. Parity says which of the two goes how far:

* even fingerprints emit themselves and their 64 one-bit variants;
* odd ones emit their 64 one-bit variants, and the two-bit variants with both bits in one
  32-bit half (of three differing bits two share a half).

At a variant of even parity any two that meet lie within two bits. At a variant of odd
parity an even and an odd fingerprint lie within three, while two odd ones may lie four
apart and are only linked through an even one. So the verified links at a variant are a
star, its size is bounded by the geometry (64 even and 992 odd ones), and no pairs
within a group are formed.

Most fingerprints have no neighbour. They are found beforehand with the same idea on
halves: within three bits one half differs by one bit at most, so each half emits
itself, and, if its own parity is odd, its 32 one-bit variants. What is left is asked
again with a byte of the other half in each key, so that chance meetings in 32 bits,
which grow with the number of fingerprints, don't bring full balls with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import by_value, connected_components, durable, free_name, mapped, numbered_columns, schema_with, slices

SHINGLE = 3
SEED = 42
#: Differing bits up to which fingerprints link; the halves below are made for it.
RADIUS = 3
#: Shingles that are turned to bits at once, which bounds memory for very long texts.
AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """64 bits, signed: a bit is set if over half the shingle hashes have it; no words: 0."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    k = min(SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:min(n, at + AT_ONCE)], ends[at + k - 1:])], np.uint64) for at in range(0, n, AT_ONCE))


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits, signed: a bit is set if over half of all the hashes have it."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", fp_col: str = "fp") -> DataFrame:
    """`docs` with the fingerprint of `text_col` in the new column `fp_col` (long); underscores follow a name that is taken."""
    fp_col = free_name(docs, fp_col)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, k)):
            fp = pa.array([fingerprint(t.as_py()) for t in batch.column(k)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], [*batch.schema.names, fp_col])

    return mapped(docs, run, schema_with(docs, fp_col, "long"))


def _flips(masks: list[int]) -> F.Column:
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: F.col("fp").bitwiseXOR(m))


ONE = [1 << i for i in range(64)]
TWO = [1 << i | 1 << j for i in range(64) for j in range(i) if i // 32 == j // 32]


def _odd(c) -> F.Column:
    return F.bit_count(c) % 2 == 1


def _half_keys(fine: bool) -> F.Column:
    """Keys of which two fingerprints within RADIUS bits share one.

    One half differs by one bit at most: each half emits itself and, if its parity is odd,
    its one-bit variants. Fine keys carry one of the four bytes of the other half besides,
    of which three differing bits leave one as it is.
    """
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    near = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    out = []
    for side, half, other in ((0, low, high), (1, high, low)):
        own = _variants(half, near)
        for j in range(4) if fine else (0,):
            tag = F.shiftleft(F.shiftrightunsigned(other, 8 * j).bitwiseAND(0xFF), 35) if fine else F.lit(0).cast("long")
            tag = tag.bitwiseOR(F.lit((4 * side + j) << 32).cast("long"))
            out.append(_tagged(own, tag))
    return F.concat(*out)


def _variants(half: F.Column, near: F.Column) -> F.Column:
    return F.when(_odd(half), F.transform(near, lambda m: half.bitwiseXOR(m))).otherwise(F.array(half))


def _tagged(keys: F.Column, tag: F.Column) -> F.Column:
    return F.transform(keys, lambda k: k.bitwiseOR(tag))


def _sharing(fps: DataFrame, keys: F.Column) -> DataFrame:
    """The distinct fingerprints `fp` that share a key with another."""
    each = fps.select("fp", F.explode(keys).alias("key"))
    shared = each.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo < hi").select("key")
    return each.join(shared, "key").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b): stars that connect all fingerprints `fp` within three bits; fps: distinct."""
    near = durable(_sharing(durable(_sharing(fps, _half_keys(False))), _half_keys(True)))
    two = F.when(_odd(F.col("fp")), F.concat(_flips(ONE), _flips(TWO))).otherwise(F.concat(F.array("fp"), _flips(ONE)))
    met = near.select("fp", F.explode(two).alias("v"))
    at = W.partitionBy("v")
    even = F.when(~_odd(F.col("fp")), F.col("fp"))
    centre = F.when(_odd(F.col("v")), F.min(even).over(at)).otherwise(F.min("fp").over(at))
    pairs = met.withColumn("centre", centre).filter("centre is not null and centre <> fp").select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def _rooted(rows: DataFrame) -> DataFrame:
    """(fp, root) of the distinct fingerprints of rows(fp)."""
    fps = durable(rows.select("fp").distinct())
    roots = connected_components(links(fps))
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of `docs`.

    Null, empty and blank texts have fingerprint zero and link like any other. A null
    doc_id is never a component's smallest unless all its ids are null, then
    component_id is null. Repeated rows are one node. Other columns are not read.
    """
    rows = durable(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fp"))
    low = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = low.join(_rooted(rows), "fp")
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = durable(rooted.join(named, "root").select("fp", "component_id"))
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each component, with the columns they had.

    The row with the smallest doc_id stays, nulls last; of several rows with that id the
    one with the smallest fingerprint and text digest, then the first by the other columns.
    """
    plain, at = numbered_columns(docs)
    ident, text = at[id_col], F.coalesce(F.col(at[text_col]), F.lit(""))
    rows = durable(fingerprints(plain.select(F.col(ident).cast("long").alias("doc_id"), F.col(at[text_col]).alias("text"))).select("doc_id", "fp", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "fp", "digest")
    low = rows.groupBy("fp").agg(F.min(first).alias("low"))
    stay = low.join(_rooted(rows), "fp").groupBy("root").agg(F.min("low").alias("low"))
    stay = durable(stay.select(F.col("low.doc_id").alias("k_id"), F.col("low.digest").alias("k_digest")))
    on = F.col(ident).cast("long").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    found = plain.withColumn("digest", F.sha2(text, 256)).join(stay, on, "left_semi")
    one = W.partitionBy(ident, "digest").orderBy(*by_value(plain, at[text_col]))
    return found.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select(*plain.columns).toDF(*docs.columns)


def op2_simhash(spark, sf_dir):
    out = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
