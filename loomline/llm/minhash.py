"""Near-dedup of the pipeline: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

First the balls of simhash.py bring together SimHash fingerprints, here of the five-word
shingles, within three bits, and what meets is compared exactly. At that similarity most
fingerprints lie about ten of 64 bits apart, too far for balls of a size that can be sent.
So what the balls leave meets where a band of their MinHash signatures is equal: of pairs at the threshold
(1 - 0.8^6)^30, one in ten thousand, do not meet. Who meets is compared by the exact
Jaccard similarity of the shingle sets of the whole texts.

Within a band's bucket members are compared with one centre first, the one that meets
most others. Only a bucket that verified links leave in several components is compared
further, with other centres and at last between its components, so a large bucket of
copies costs one comparison for each member and no similar pair that meets is skipped.

A pair is only formed if its sizes and parity sketches allow the similarity. A sketch has
a bit for each of 256 cells, set if an odd number of the set's hashes falls there. A hash
that is in one of two sets flips one bit, so the sketches differ in at most as many bits
as the sets differ in hashes, and no similar pair is lost. Many texts made from one by
many changes share bands with each other, and are kept apart by their sketches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm import simhash
from loomline.llm.common import by_value, connected_components, durable, mapped, numbered_columns, slices

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 30, 6
#: Rounds compare a bucket with one centre as long as one in so many of the rows gains a link; then its components are compared with each other.
WORTH = 100
#: Shingles that meet all permutations at once, which bounds memory for very long texts.
AT_ONCE = 1 << 12

_RANDOM = np.random.default_rng(SEED)
_XOR = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; a shorter text is one shingle, no words are none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1:])], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key, signed, for each band of the MinHash signature."""
    import xxhash

    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), AT_ONCE):
        np.minimum(low, ((hashes[at:at + AT_ONCE, None] ^ _XOR) * _TIMES).min(axis=0), out=low)
    return np.array([xxhash.xxh64_intdigest(low[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """256 bits, as four signed numbers: which cells an odd number of the hashes falls into."""
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _node(hashes: np.ndarray) -> int:
    """64 bits, signed, that name a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _fingerprint(hashes: np.ndarray) -> int:
    return simhash.majority(hashes[at:at + AT_ONCE] for at in range(0, len(hashes), AT_ONCE))


def _sketched(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest, node, n, fp, bits, keys) of docs(doc_id, digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            sets = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            lists = [pa.array([f(s) for s in sets], pa.list_(pa.int64())) for f in (parity_sketch, band_keys)]
            longs = [pa.array(map(f, sets), pa.int64()) for f in (_node, len, _fingerprint)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *longs, *lists], ["doc_id", "digest", "node", "n", "fp", "bits", "keys"])

    out = mapped(docs, run, "doc_id long, digest string, node long, n long, fp long, bits array<long>, keys array<long>")
    return out.withColumn("bits", F.struct(*[F.col("bits")[i].alias(f"b{i}") for i in range(4)]))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes) of texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [shingles(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return mapped(texts, run, "node long, hashes array<long>")


def _may_be_near(a: tuple[Column, Column], b: tuple[Column, Column], similarity: float) -> Column:
    """Whether two sets, each given by its size and sketch, can have the similarity."""
    (n, bits), (m, others) = a, b
    differ = sum((F.bit_count(bits[f"b{i}"].bitwiseXOR(others[f"b{i}"])) for i in range(4)), F.lit(0))
    sizes = F.least(n, m) >= F.greatest(n, m) * similarity - 1e-6
    return sizes & (differ <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    left, right = (sets.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
    both = F.size(F.array_intersect("ha", "hb"))
    alike = both * (1 + similarity) >= (F.size("ha") + F.size("hb")) * similarity - 1e-6
    return durable(pairs.join(left, "a").join(right, "b").filter(alike).select("a", "b"))


def _ball_pairs(sketches: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of nodes that SimHash balls bring together and whose sketches allow the similarity.

    sketches(node, n, fp, bits): one row a node. Nodes of one fingerprint are paired with the
    first of them, and first nodes along the stars that link fingerprints.
    """
    first = durable(sketches.groupBy("fp").agg(F.min_by(F.struct("node", "n", "bits"), "node").alias("c"), F.count("*").alias("g")))
    star = simhash.links(first.select("fp"))
    one, two = (first.select(F.col("fp").alias(k), F.col("c").alias(f"c{k}")) for k in "ab")
    apart = star.join(one, "a").join(two, "b").select("ca", "cb")
    same = sketches.join(first.filter("g > 1"), "fp").filter("node <> c.node").select(F.struct("node", "n", "bits").alias("ca"), F.col("c").alias("cb"))
    near = _may_be_near((F.col("ca.n"), F.col("ca.bits")), (F.col("cb.n"), F.col("cb.bits")), similarity)
    return apart.unionByName(same).filter(near).select(F.least("ca.node", "cb.node").alias("a"), F.greatest("ca.node", "cb.node").alias("b")).distinct()


def _rooted(buckets: DataFrame, sets: DataFrame, similarity: float, links: DataFrame | None = None) -> DataFrame | None:
    """(node, root) of the nodes that are linked by `links(a, b)` or in buckets(key, node, n, bits); None without links."""
    k, last = 0, False
    roots = None if links is None else durable(connected_components(links))
    size = buckets.groupBy("key").agg(F.count("*").alias("g"))
    weight = buckets.join(size, "key").groupBy("node").agg(F.sum("g").alias("weight"))
    placed = buckets.join(weight, "node").withColumn("root", F.col("node"))
    if roots is not None:
        placed = placed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    while True:
        order = F.struct("weight", "node") if k == 0 else F.struct(F.xxhash64(F.lit(k), "node"), "node")
        many = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max_by(F.struct("node", "n", "bits", "root"), order).alias("c"))
        unsettled = durable(placed.join(many.filter("lo < hi").select("key", "c"), "key"))
        rows = unsettled.count()
        if not rows:
            break
        if not last:
            pairs = unsettled.filter("root <> c.root").filter(_may_be_near((F.col("n"), F.col("bits")), (F.col("c.n"), F.col("c.bits")), similarity)).select("node", F.col("c.node").alias("other"))
        else:
            other = unsettled.select(F.col("key").alias("o_key"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("bits").alias("o_bits"), F.col("root").alias("o_root"))
            near = _may_be_near((F.col("n"), F.col("bits")), (F.col("m"), F.col("o_bits")), similarity)
            pairs = unsettled.join(other, (F.col("key") == F.col("o_key")) & (F.col("node") < F.col("other")) & (F.col("root") != F.col("o_root")) & near).select("node", "other")
        found = _verified(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), sets, similarity)
        n = found.count()
        links = found if links is None else links.union(found)
        done, last, k = last, n * WORTH < rows, k + 1
        placed = unsettled.drop("c")
        if not last or done:
            roots = durable(connected_components(links))
            placed = placed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if done:
            break
    return roots


def near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that stay, one of each component of similar texts, with the columns they had.

    Null, empty and blank texts have no shingles and are one component. The row with the
    smallest doc_id stays, nulls last; of several rows with that id the one with the
    smallest text digest, then the first by the other columns.
    """
    plain, at = numbered_columns(docs)
    ident, text = at[id_col], F.coalesce(F.col(at[text_col]), F.lit(""))
    hashed = plain.withColumn("digest", F.sha2(text, 256))
    rows = durable(_sketched(hashed.select(F.col(ident).cast("long").alias("doc_id"), "digest", text.alias("text")), shingle))
    members = rows.dropDuplicates(["node"]).select("node", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    # Most texts share no bucket: sketches go with the others only.
    buckets = durable(members.join(shared, "key").join(rows.select("node", "bits").dropDuplicates(["node"]), "node"))
    pairs = durable(_ball_pairs(rows.select("node", "n", "fp", "bits").dropDuplicates(["node"]), similarity))
    asked = buckets.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct()
    picked = rows.join(asked, "node").groupBy("node").agg(F.min("digest").alias("digest"))
    texts = hashed.select("digest", text.alias("text")).join(picked, "digest").dropDuplicates(["node"]).select("node", "text")
    sets = durable(_sets(texts, shingle))
    met = _verified(pairs, sets, similarity)
    roots = _rooted(buckets, sets, similarity, None if met.isEmpty() else met)
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "digest")
    stay = rows.groupBy("node").agg(F.min(first).alias("low"))
    if roots is not None:
        stay = stay.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("low").alias("low"))
    stay = durable(stay.select(F.col("low.doc_id").alias("k_id"), F.col("low.digest").alias("k_digest")))
    on = F.col(ident).cast("long").eqNullSafe(F.col("k_id")) & (F.col("digest") == F.col("k_digest"))
    one = W.partitionBy(ident, "digest").orderBy(*by_value(plain, at[text_col]))
    found = hashed.join(stay, on, "left_semi")
    return found.withColumn("nth", F.row_number().over(one)).filter("nth = 1").select(*plain.columns).toDF(*docs.columns)
