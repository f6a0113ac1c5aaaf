"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are sampled (see `sampling`): a row stands for the run of suffixes whose first
13 words have the same least gram, and the sampled suffix starts at this gram. The gram
is the prefix by which suffixes are dealt out. A prefix that only one document has heads
no repeat and is dropped. The others are packed into groups that fit in memory; a prefix
of five words with too many suffixes for a group is extended to nine words, to eleven,
and to the window's thirteen, where it is a node of the tree by itself.

Each group's subtrees come from the sorted array of the suffixes under its rows: ranks by
prefix doubling, lengths of common prefixes between neighbours, and the intervals where
these lengths stay at or above a depth, which are the internal nodes. A node keeps its
smallest doc_id. For each suffix the deepest node that a smaller document reaches, of at
least a window's depth, is a repeat, and as long as the node is deep; of these the ones
that can't be extended to the left are the maximal repeats, which are to go.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import durable, grouped, mapped, slices
from loomline.llm.sampling import LAST_ID, SPANS, Words, apart, chosen, contexts, entries, extended, grouped_by_gram, keyed, located, merged, most_of_one, twins, with_spans

#: Runs in a group.
GROUP_ROWS = 5_000


def suffix_array(symbols: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes at `starts` sorted by up to `longest` symbols, and how many each shares with the one before it.

    Suffixes are told apart by separators, symbols that occur once.
    """
    n, width = len(symbols), 1
    _, rank = np.unique(symbols, return_inverse=True)
    ranks = [rank.astype(np.int64)]
    while width < longest:
        later = np.full(n, -1, np.int64)
        later[:max(0, n - width)] = ranks[-1][width:]
        _, rank = np.unique(ranks[-1] * (n + 1) + later + 1, return_inverse=True)
        ranks.append(rank.astype(np.int64))
        width *= 2
    order = np.argsort(ranks[-1][starts], kind="stable")
    a, b = starts[order[:-1]].copy(), starts[order[1:]].copy()
    common = np.zeros(len(starts), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = inside & (ranks[k][np.where(inside, a, 0)] == ranks[k][np.where(inside, b, 0)])
        step = same.astype(np.int64) << k
        a, b = a + step, b + step
        common[1:] += step
    return order, common


def repeat_depths(common: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """For suffixes in order, with the smallest doc_id of each: the depth of the deepest node, of at least `depth`, with a smaller one; else 0."""
    out = np.zeros(len(low), np.int64)
    open_ = np.arange(len(low))
    for d in range(depth, int(common.max(initial=0)) + 1):
        # Nodes at this depth are the stretches between shorter common prefixes.
        first = np.flatnonzero(common < d)
        best = np.minimum.reduceat(low, first)
        node = np.searchsorted(first, open_, "right") - 1
        open_ = open_[best[node] < low[open_]]
        if not len(open_):
            break
        out[open_] = d
    return out


def subtrees(table: pa.Table, unit: Words) -> pa.Table:
    """Spans to remove in a group of contexts (did, h, start, ctx)."""
    did, h, start = (table.column(k).to_numpy() for k in ("did", "h", "start"))
    kinds: dict[bytes, int] = {}
    which = np.array([kinds.setdefault(c, len(kinds)) for c in table.column("ctx").to_pylist()], np.int64)
    ids: dict[bytes, int] = {}
    cut = [[ids.setdefault(w, len(ids)) for w in c.split(unit.sep)] for c in kinds]
    sizes = np.array([len(c) for c in cut], np.int64)
    symbols = np.array([w for k, c in enumerate(cut) for w in (*c, len(ids) + k)], np.int64)
    windows = sizes - unit.window + 1
    base = np.cumsum(windows) - windows
    inner = np.arange(int(windows.sum())) - np.repeat(base, windows)
    starts = np.repeat(np.cumsum(sizes + 1) - sizes - 1, windows) + inner
    low = np.full(len(kinds), LAST_ID, np.int64)
    np.minimum.at(low, which, did)
    order, common = suffix_array(symbols, starts, int(sizes.max()))
    deep = np.empty(len(starts), np.int64)
    deep[order] = repeat_depths(common, np.repeat(low, windows)[order], unit.window)
    # A repeat that one word further left is a repeat too is not maximal.
    maximal = deep > 0
    maximal[1:] &= (inner[1:] == 0) | (deep[:-1] <= deep[1:])
    spot = np.flatnonzero(maximal)
    count = np.bincount(np.repeat(np.arange(len(kinds)), windows)[spot], minlength=len(kinds))
    # A context that a smaller document has goes whole, the smallest document's by the nodes.
    late = did > low[which]
    rows = np.flatnonzero(~late)
    n = count[which[rows]]
    at = np.repeat((np.cumsum(count) - count)[which[rows]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    lo = np.concatenate([start[late], np.repeat(start[rows], n) + inner[spot[at]]]).astype(np.int64)
    hi = np.concatenate([(start + sizes[which])[late], lo[int(late.sum()):] + deep[spot[at]]]).astype(np.int64)
    who = np.concatenate([np.flatnonzero(late), np.repeat(rows, n)])
    return pa.table({"did": pa.array(did[who], pa.int64()), "h": pa.array(h[who], pa.int64()), "lo": pa.array(lo), "hi": pa.array(hi)})


def repeated_spans(docs: DataFrame, unit: Words = Words(), group_rows: int = GROUP_ROWS) -> DataFrame:
    """(did, h, lo, hi) in words, of keyed(docs): what a document with a smaller id has too."""
    # Of equal texts the smallest document's is searched, the others go whole.
    whole, known = twins(docs, F.min("did"), F.col("did") > F.col("best"), F.col("did") == F.col("best"))
    rows = entries(docs, unit)
    grams = rows.groupBy("gram").agg(F.min("did").alias("lo"), F.max("did").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
    hits = durable(located(rows, grams.select("gram", (F.col("n") > most_of_one(unit, group_rows)).alias("heavy"))))
    hits = durable(hits.join(known, "key", "left_anti"))
    total = hits.agg(F.sum(F.size("at"))).first()[0] or 0

    def searched(part: DataFrame) -> DataFrame:
        light = grouped_by_gram(part, group_rows, total).select("group", "did", "h", "start", "ctx")
        return grouped(light.groupBy("group"), lambda t: subtrees(t, unit), SPANS, docs.sparkSession)

    found, heavy = apart(searched(contexts(docs, chosen(hits, False), unit)), contexts(docs, chosen(hits, True), unit))
    spans = [whole, found]
    if not heavy.isEmpty():
        # Of equal contexts those of the smallest document stand for all, the others are repeats.
        known, more = extended(heavy, unit, group_rows, F.min("did"), F.col("did") > F.col("best"), F.col("did") == F.col("best"))
        spans += [*known, *map(searched, more)]
    return functools.reduce(DataFrame.unionByName, spans)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: Words = Words(), group_rows: int = GROUP_ROWS) -> DataFrame:
    """(did, n_words, spans, kept): removed spans of words, and the kept words joined by one space.

    A word goes if a window over it also starts in a document with a smaller id. A null
    id is larger than any other and comes back as null; rows that share an id never
    remove each other's words. Null, empty and blank texts have no words. Other columns
    are not read.
    """
    docs = keyed(docs, id_col, text_col)
    joined = with_spans(docs, repeated_spans(docs, unit, group_rows))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1)):
            counts, cuts, kept = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, at, left = text.encode().split(), 0, []
                spans = merged(found, len(words), unit.window)
                for lo, hi in spans:
                    left += words[at:lo]
                    at = hi
                left += words[at:]
                counts.append(len(words)), cuts.append([{"lo": a, "hi": b} for a, b in spans]), kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(cuts, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.string())], ["did", "n_words", "spans", "kept"])

    return mapped(joined, run, "did long, n_words long, spans array<struct<lo: long, hi: long>>, kept string")


def op7_prefix_trees(spark, sf_dir):
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        F.when(F.col("did") < LAST_ID, F.col("did")).alias("doc_id"), "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"]).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS low FROM starts) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM t),
left_over AS (
  SELECT words.doc_id, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY words.p) AS kept, count(gone.p) AS n_removed
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.p = gone.p GROUP BY words.doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN left_over ON t.doc_id = left_over.doc_id
"""
