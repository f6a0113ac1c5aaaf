"""Long repeats by a logarithmic family of suffix arrays, over bytes.

Documents come in batches. A batch gets a sorted array of its sampled suffixes (see
`sampling`: a sampled suffix starts at the least gram of the 400 bytes around it) and is
merge-scanned against every level of the family: where batch and level have a prefix in
common, the suffixes of both may hold a long match. Then the batch becomes a level, and
levels of equal size are merged, so a family of n batches has at most log2(n) + 1 levels
and a suffix is written again as often.

What the scans find, and nothing else, is confirmed on the bytes: suffixes that share a
prefix are brought together with the bytes under them, a suffix array over these is
built by prefix doubling, and suffixes that agree in 400 bytes are repeats. A prefix
that too many suffixes share is extended from 32 bytes, step by step, to the window's 400.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import durable, grouped, mapped, slices
from loomline.llm.sampling import LAST_ID, SPANS, Bytes, apart, chosen, contexts, entries, extended, grouped_by_gram, keyed, located, merged, most_of_one, twins, with_spans

GROUP_ROWS = 4_000
BATCHES = 4


class Family:
    """Levels of sorted suffixes (gram, key, start, more), the prefix first; `size` in batches, sizes fall from level to level.

    A level is a reliable checkpoint. `add` returns the suffixes that the new batch has
    brought together, its own and the levels', so a growing corpus is only compared with
    what is new.
    """

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """Add entries(gram, key, start, more) of new documents; returns the suffixes (gram, key, start) with a match that were not known to have it, or again."""
        self._merge()
        array = durable(batch.select("gram", "key", "start", "more").repartition("gram").sortWithinPartitions("gram", "key", "start"))
        inner = array.groupBy("gram").agg((F.count("*") + F.max("more")).alias("n")).filter("n > 1").select("gram")
        found = [self._scan(array, inner)]
        for _, level in self.levels:
            found += [self._scan(array, level.select("gram")), self._scan(level, array.select("gram"))]
        self.levels.append((1, array))
        return durable(functools.reduce(DataFrame.union, found).distinct())

    @staticmethod
    def _scan(suffixes: DataFrame, prefixes: DataFrame) -> DataFrame:
        """The suffixes whose prefix occurs among `prefixes`: a merge of two sorted sides."""
        return suffixes.select("gram", "key", "start").join(prefixes.hint("merge"), "gram", "left_semi")

    def _merge(self) -> None:
        """Merge levels of equal size, which the next batch will be scanned against."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, durable(b.union(a).repartition("gram").sortWithinPartitions("gram", "key", "start"))))


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix by its first `depth` bytes (at least 8), by prefix doubling.

    Suffixes shorter than that rank as if zeros followed; they are not asked for.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    rank = np.zeros(n, np.uint64)
    for j in range(8):
        rank = (rank << np.uint64(8)) | padded[j:n + j]
    width = 8
    _, rank = np.unique(rank, return_inverse=True)
    rank = rank.astype(np.int64)
    while width < depth:
        step = min(width, depth - width)
        later = np.concatenate([rank[step:], np.zeros(min(step, n), np.int64)])[:n]
        _, rank = np.unique(rank * (int(rank.max()) + 2) + later, return_inverse=True)
        rank = rank.astype(np.int64)
        width += step
    return rank


def confirm(table: pa.Table, unit: Bytes) -> pa.Table:
    """Spans of a group of contexts (did, h, start, gram, ctx) that occur more than once."""
    did, h, start, gram = (table.column(k).to_numpy() for k in ("did", "h", "start", "gram"))
    kinds: dict[bytes, int] = {}
    texts = table.column("ctx").to_pylist()
    which = np.array([kinds.setdefault(c, len(kinds)) for c in texts], np.int64)
    times = np.bincount(which, minlength=len(kinds))
    windows = np.array([len(c) - unit.window + 1 for c in kinds], np.int64)
    base = np.cumsum(windows) - windows
    often = np.repeat(times > 1, windows)
    # A context that occurs twice is settled; it is only needed to settle others of its gram.
    of = np.zeros(len(kinds), np.int64)
    of[which] = gram
    open_grams = np.unique(of[times == 1])
    chosen = np.flatnonzero(np.isin(of, open_grams))
    if len(chosen):
        keys = list(kinds)
        parts = [np.frombuffer(keys[k], np.uint8) for k in chosen]
        rank = suffix_ranks(np.concatenate(parts), unit.window)
        sizes = np.array([len(p) for p in parts], np.int64)
        n = windows[chosen]
        spot = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        r = rank[spot]
        seen = np.bincount(r, weights=np.repeat(times[chosen], n))
        flat = np.repeat(base[chosen] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        often[flat] |= seen[r] > 1
    count = windows[which]
    flat = np.arange(int(count.sum())) + np.repeat(base[which] - (np.cumsum(count) - count), count)
    return flagged_spans(did, h, start, count, often[flat], unit.window)


def flagged_spans(did, h, start, count, flags, window) -> pa.Table:
    """Merge flagged windows of each row into spans of symbols [lo, hi).

    `flags` has, one row after the other, a value for each of the row's windows.
    """
    total = int(count.sum())
    owner = np.repeat(np.arange(len(count)), count)
    place = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    edge = np.ones(total, bool)
    edge[1:] = owner[1:] != owner[:-1]
    opens = np.flatnonzero(flags & (edge | ~np.concatenate([[False], flags[:-1]])))
    last = np.ones(total, bool)
    last[:-1] = edge[1:]
    closes = np.flatnonzero(flags & (last | ~np.concatenate([flags[1:], [False]])))
    who = owner[opens]
    return pa.table({"did": pa.array(did[who], pa.int64()), "h": pa.array(h[who], pa.int64()), "lo": pa.array(place[opens], pa.int64()), "hi": pa.array(place[closes] + window, pa.int64())})


def repeated_spans(docs: DataFrame, unit: Bytes = Bytes(), batches: int = BATCHES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(did, h, lo, hi) in bytes, of keyed(docs): what occurs anywhere else too."""
    # Equal texts go whole, and one of them is looked at in the name of all.
    place = F.struct("did", "h")
    twin_spans, known = twins(docs, F.min(place), F.lit(True), place == F.col("best"))
    family, found = Family(), []
    for k in range(batches):
        found.append(family.add(entries(docs.filter(F.pmod("key", F.lit(batches)) == k), unit, alone=True)))
    matches = durable(functools.reduce(DataFrame.union, found).distinct().join(known, "key", "left_anti"))
    size = durable(matches.groupBy("gram").agg((F.count("*") > most_of_one(unit, group_rows)).alias("heavy")))
    hits = durable(located(matches, size))
    total = matches.count()

    def searched(part: DataFrame) -> DataFrame:
        light = grouped_by_gram(part, group_rows, total).select("group", "did", "h", "start", "gram", "ctx")
        return grouped(light.groupBy("group"), lambda t: confirm(t, unit), SPANS, docs.sparkSession)

    # Equal rows share a key, and each of them comes with its contexts.
    found, heavy = apart(searched(contexts(docs, chosen(hits, False), unit)), contexts(docs, chosen(hits, True), unit))
    spans = [twin_spans, found]
    if not heavy.isEmpty():
        # Of equal contexts all are repeats, and one stands for all where others are compared with it.
        place = F.struct("did", "h", "start")
        confirmed, more = extended(heavy, unit, group_rows, F.min(place), F.lit(True), place == F.col("best"))
        spans += [*confirmed, *map(searched, more)]
    return functools.reduce(DataFrame.unionByName, spans)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Bytes = Bytes(), batches: int = BATCHES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(did, n_bytes, spans, kept): removed spans of bytes, and the bytes that remain.

    A byte goes if a string of `window` bytes over it also starts anywhere else, in the
    same document or another; repeated rows are other documents. Null texts count as
    empty, null ids come back as null. Other columns are not read.
    """
    docs = keyed(docs, id_col, text_col)
    joined = with_spans(docs, repeated_spans(docs, unit, batches, group_rows))

    def run(batches_in):
        for batch in (part for whole in batches_in for part in slices(whole, 1)):
            counts, cuts, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, at, left = text.encode(), 0, []
                spans = merged(found, len(raw), unit.window)
                for lo, hi in spans:
                    left.append(raw[at:lo])
                    at = hi
                left.append(raw[at:])
                counts.append(len(raw)), cuts.append([{"lo": a, "hi": b} for a, b in spans]), kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())], ["did", "n_bytes", "spans", "kept"])

    return mapped(joined, run, "did long, n_bytes long, spans array<struct<lo: long, hi: long>>, kept binary")


def op10_suffix_levels(spark, sf_dir):
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        F.when(F.col("did") < LAST_ID, F.col("did")).alias("doc_id"), "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).withColumn(
        "removed_share", F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0))


# Strings are taken from blocks of 1,000 bytes in hexadecimal, as positions in long strings are slow to find.
OP10_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, b * 1000 AS off, substr(h, b * 2000 + 1, 2798) AS part FROM (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 999) // 1000)) AS b FROM t)),
starts AS (SELECT doc_id, off + i AS i, md5(substr(part, 2 * i + 1, 800)) AS g FROM (SELECT doc_id, off, part, unnest(range(0, least(1000, length(part) // 2 - 399))) AS i FROM blocks)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM starts) WHERE k > 1),
runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM again)),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM runs GROUP BY doc_id, run),
pieces AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS k, max(hi) AS last, sum(hi - lo) AS n, count(*) AS spans FROM pieces JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256,
  CASE WHEN length(h) > 0 THEN CAST(coalesce(n, 0) AS DOUBLE) / (length(h) // 2) ELSE 0.0 END AS removed_share
FROM t LEFT JOIN kept USING (doc_id)
"""
