"""Sampled suffixes, shared by the two operators that look for long repeats.

A window of a fixed number of symbols (words or bytes) is represented by the least hash
of the short grams in it. Equal windows have equal least hashes wherever they stand, so
comparing windows with the same least hash misses no repeat. Consecutive windows mostly
share theirs; such a run is one row: where it starts, how many windows it has, and the
hash. Rows are far fewer than symbols (about 2 in `window - gram + 2`).

The gram is the prefix by which sampled suffixes are dealt out. One that too many rows
share is made longer, step by step, up to the whole window: see `extended`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import durable, mapped, slices

#: Symbols that are hashed at once; longer texts are cut into overlapping pieces.
AT_ONCE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
LAST_ID = (1 << 63) - 1


#: Bytes of text whose words are hashed at once.
CHUNK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS:
        for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
            p = np.full(CHUNK + 2, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def _hash_words(raw: np.ndarray):
    """(hash, start, end) of the words of at most CHUNK + 1 bytes that end in white space.

    A word's hash is a polynomial in its bytes, read off prefix sums.
    """
    up, down = _powers()
    space = _SPACE[raw]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        turn = np.concatenate([[0], turn])
    starts, ends = turn[::2], turn[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h, starts, ends


def _segments(raw: bytes):
    """(position, bytes) of pieces of at most CHUNK bytes, cut at white space; a longer word is a piece of its own."""
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            back = max(raw.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if back < 0:
                found = [k for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (k := raw.find(c, end)) >= 0]
                end = min(found, default=len(raw))
            else:
                end = back + 1
        yield at, raw[at:end]
        at = end


def word_arrays(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index, hash, start, end) of the words of each text, in order."""
    import xxhash

    held: list[int] = []
    size = 0

    def flush():
        if held:
            joined = np.frombuffer(b"\n".join(raws[i] for i in held) + b"\n", np.uint8)
            h, starts, ends = _hash_words(joined)
            at = np.cumsum([0, *(len(raws[i]) + 1 for i in held)])
            cut = np.searchsorted(starts, at)
            for k, i in enumerate(held):
                part = slice(cut[k], cut[k + 1])
                yield i, h[part], starts[part] - at[k], ends[part] - at[k]
            held.clear()

    for i, raw in enumerate(raws):
        if len(raw) > CHUNK:
            yield from flush()
            size = 0
            parts = []
            for at, piece in _segments(raw):
                if len(piece) > CHUNK:
                    parts.append((np.array([xxhash.xxh64_intdigest(piece)], np.uint64), np.array([at]), np.array([at + len(piece)])))
                else:
                    h, starts, ends = _hash_words(np.frombuffer(piece + b"\n", np.uint8))
                    parts.append((h, starts + at, ends + at))
            yield i, *(np.concatenate(x) for x in zip(*parts))
            continue
        if size + len(raw) + 1 > CHUNK:
            yield from flush()
            size = 0
        held.append(i)
        size += len(raw) + 1
    yield from flush()


@dataclass(frozen=True)
class Words:
    """Words between white space, as they are.

    `grams` are the lengths of prefixes, up to the window. A prefix may fill one in `parts`
    of a group before it is made longer.
    """

    window: int = 13
    grams: tuple[int, ...] = (5, 9, 11, 13)
    longest: int = 64
    parts: int = 1
    sep: bytes = b" "

    def symbols(self, raws: list[bytes]):
        """(index, symbols, where each starts, where each ends) of each text."""
        return word_arrays(raws)

    def size(self, part: Column) -> Column:
        return F.regexp_count(part.cast("string"), F.lit(" ")) + 1

    def part(self, raw: bytes, starts, ends, lo: int, hi: int) -> bytes:
        return b" ".join(raw[starts[lo]:ends[hi - 1]].split())


@dataclass(frozen=True)
class Bytes:
    """UTF-8 bytes."""

    window: int = 400
    grams: tuple[int, ...] = (32, 128, 256, 336, 384, 400)
    longest: int = 512
    parts: int = 10
    sep: bytes = b""

    def symbols(self, raws: list[bytes]):
        return ((i, np.frombuffer(raw, np.uint8), None, None) for i, raw in enumerate(raws))

    def size(self, part: Column) -> Column:
        return F.length(part)

    def part(self, raw: bytes, starts, ends, lo: int, hi: int) -> bytes:
        return raw[lo:hi]


_BYTE = (np.arange(1, 257, dtype=np.uint64) * _ODD) ^ ((np.arange(1, 257, dtype=np.uint64) * _MIX) >> np.uint64(17))


def _grams(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k symbols."""
    a = _BYTE[a] if a.dtype == np.uint8 else a
    if k & (k - 1) == 0:
        p, h, w = int(_ODD), a, 1
        while w < k:
            h = h[:-w] * np.uint64(p) + h[w:]
            p, w = p * p % (1 << 64), 2 * w
    else:
        n = len(a) - k + 1
        h = a[:n].copy()
        for j in range(1, k):
            h *= _ODD
            h += a[j:n + j]
    h = h ^ (h >> np.uint64(31))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _sliding(a: np.ndarray, k: int, least=np.minimum) -> np.ndarray:
    """The least of each run of k values."""
    w = 1
    while 2 * w <= k:
        a = least(a[:-w], a[w:])
        w *= 2
    return least(a[:len(a) - (k - w)], a[k - w:]) if w < k else a


def runs(pieces: list[np.ndarray], window: int, gram: int, longest: int, alone: bool = False):
    """(piece, start, windows, hash) of the runs of several symbol sequences, in order.

    With `alone` a fifth array says whether the run's gram stands more than once under
    its windows, so that windows of one run may be equal.
    """
    none = np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in pieces], np.int64)
    total = int(sizes.sum())
    if not len(sizes) or total < window or sizes.max() < window:
        return none, none, none, none.astype(np.uint64), none
    g = _grams(np.concatenate(pieces), gram)
    least = _sliding(g, window - gram + 1)
    # Windows inside one piece: all but the last window - 1 starts of each.
    inside = np.maximum(sizes - window + 1, 0)
    pattern = np.stack([inside, sizes - inside], axis=1).ravel()
    ok = np.repeat(np.tile(np.array([True, False]), len(sizes)), pattern)[:len(least)]
    at = np.flatnonzero(ok)
    v = least[at]
    piece = np.repeat(np.arange(len(sizes)), inside)
    new = np.ones(len(at), bool)
    new[1:] = (v[1:] != v[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(new)
    inner = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(inner % longest == 0)
    count = np.diff(np.append(first, len(at)))
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    value, lo = v[first], at[first]
    more = none
    if alone:
        # A gram is somewhere's least if the largest least of the windows over it is its own hash.
        span = window - gram + 1
        padded = np.concatenate([np.zeros(span - 1, np.uint64), np.where(ok, least, np.uint64(0)), np.zeros(len(g) - len(least), np.uint64)])
        spots = np.flatnonzero(_sliding(padded, span, np.maximum)[:len(g)] == g)
        kinds, ids = np.unique(np.concatenate([g[spots], value]), return_inverse=True)
        del kinds
        key = np.sort(ids[:len(spots)].astype(np.int64) * total + spots)
        own = ids[len(spots):].astype(np.int64) * total
        more = (np.searchsorted(key, own + lo + count - 1 + window - gram, "right") - np.searchsorted(key, own + lo, "left") > 1).astype(np.int64)
    return piece[first], lo - offsets[piece[first]], count, value, more


def text_runs(unit, symbols, alone: bool = False, level: int = 0):
    """(row, start, windows, hash, more) of whole texts from unit.symbols(). A text is cut at multiples of
    AT_ONCE windows, whatever else is in the batch, so a text always has the same runs."""
    gram = unit.grams[level]
    # A prefix of a whole window stands for this window alone.
    longest = unit.longest if gram < unit.window else 1
    pieces, rows, shifts, held = [], [], [], 0
    out = []

    def flush() -> None:
        nonlocal held
        if pieces:
            p, s, n, v, m = runs(pieces, unit.window, gram, longest, alone)
            out.append((np.array(rows, np.int64)[p], s + np.array(shifts, np.int64)[p], n, v, m))
        pieces.clear(), rows.clear(), shifts.clear()
        held = 0

    for i, a, *_ in symbols:
        for lo in range(0, max(1, len(a) - unit.window + 1), AT_ONCE):
            piece = a[lo:lo + AT_ONCE + unit.window - 1]
            if len(piece) < unit.window:
                continue
            if held + len(piece) > AT_ONCE + unit.window:
                flush()
            pieces.append(piece), rows.append(i), shifts.append(lo)
            held += len(piece)
    flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, h, key, text): a null id counts as the largest; id and digest tell texts apart, key is short for both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("did"), F.xxhash64(text).alias("h"), text.alias("text"))
    return rows.select("did", "h", F.xxhash64("did", "h").alias("key"), "text")


def entries(docs: DataFrame, unit, alone: bool = False) -> DataFrame:
    """(did, key, start, gram, more): a row for each run of each text of keyed(docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                raws = [t.encode() for t in batch.column(2).to_pylist()]
                row, start, _, value, more = text_runs(unit, unit.symbols(raws), alone)
                more = more if alone else np.zeros(len(row), np.int64)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(value.view(np.int64)), pa.array(more, pa.int32())], ["did", "key", "start", "gram", "more"])

    return mapped(docs.select("did", "key", "text"), run, "did long, key long, start int, gram long, more int")


def _cut(batch: pa.RecordBatch, unit, raws: list[bytes], wanted=None, level: int = 0, shifts=None) -> pa.RecordBatch:
    """(did, h, start, gram, ctx) of the runs of texts, all or those that start where `wanted` says."""
    cut = list(unit.symbols(raws))
    row, start, n, value, _ = text_runs(unit, cut, level=level)
    triples = enumerate(zip(row.tolist(), start.tolist(), n.tolist()))
    keep = [(k, i, s, m) for k, (i, s, m) in triples if wanted is None or s in wanted[i]]
    index = pa.array([i for _, i, _, _ in keep], pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(index), batch.column(1).take(index), pa.array([s + (shifts[i] if shifts else 0) for _, i, s, _ in keep], pa.int32()),
         pa.array(value[[k for k, _, _, _ in keep]].view(np.int64) if keep else np.zeros(0, np.int64)),
         pa.array([unit.part(raws[i], cut[i][2], cut[i][3], s, s + m + unit.window - 1) for _, i, s, m in keep], pa.binary())],
        ["did", "h", "start", "gram", "ctx"])


CONTEXTS = "did long, h long, start int, gram long, ctx binary"


def contexts(docs: DataFrame, hits: DataFrame, unit) -> DataFrame:
    """(did, h, start, gram, ctx): the symbols under the runs named in hits(key, starts)."""
    found = docs.join(hits, "key").select("did", "h", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                yield _cut(batch, unit, [t.encode() for t in batch.column(2).to_pylist()], [set(s) for s in batch.column(3).to_pylist()])

    return mapped(found, run, CONTEXTS)


def apart(spans: DataFrame, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans (did, h, lo, hi) of light prefixes and the contexts of heavy ones, both durable and made together.

    Both come from the texts, which one execution moves once for the two.
    """
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    left = spans.select("did", "h", "lo", "hi", empty("start", "int"), empty("gram", "long"), empty("ctx", "binary"))
    right = heavy.select("did", "h", empty("lo", "long"), empty("hi", "long"), "start", "gram", "ctx")
    both = durable(left.unionByName(right))
    return both.filter("lo is not null").select("did", "h", "lo", "hi"), both.filter("lo is null").select("did", "h", "start", "gram", "ctx")


def finer(rows: DataFrame, unit, level: int) -> DataFrame:
    """The contexts `rows`, dealt out anew by grams of length unit.grams[level]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 3):
                yield _cut(batch, unit, batch.column(3).to_pylist(), level=level, shifts=batch.column(2).to_pylist())

    return mapped(rows.select("did", "h", "start", "ctx"), run, CONTEXTS)


#: End of a span that covers its whole text, whatever its length.
WHOLE = -1


def twins(docs: DataFrame, own: Column, gone: Column, stay: Column) -> tuple[DataFrame, DataFrame]:
    """Spans (did, h, lo, hi) of whole texts that others repeat, and the (key) of those that need no search.

    Equal texts of keyed(docs) are told by SHA-256. `own` aggregates them to `best`; those
    with `gone` go whole, and only those with `stay` are searched, in the name of all.
    """
    light = durable(docs.select("did", "h", "key", F.unhex(F.sha2("text", 256)).alias("sha")))
    best = durable(light.groupBy("sha").agg(own.alias("best"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("b_sha"), "best"))
    found = durable(light.join(best, F.col("sha") == F.col("b_sha")).select("did", "h", "key", gone.alias("gone"), stay.alias("stay")))
    spans = found.filter("gone").select("did", "h", F.lit(0).cast("long").alias("lo"), F.lit(WHOLE).cast("long").alias("hi"))
    return spans, found.filter("not stay").select("key").distinct()


def most_of_one(unit, group_rows: int) -> int:
    """Most rows of one gram in a group."""
    return max(1, group_rows // unit.parts)


def extended(rows: DataFrame, unit, group_rows: int, own: Column, gone: Column, stay: Column) -> tuple[list[DataFrame], list[DataFrame]]:
    """Deal out contexts whose gram is too frequent for one group by longer and longer prefixes.

    Equal contexts are told by the SHA-256 of their content; `own` aggregates them to
    `best`, and `n` counts them. Of several equal ones those with `gone` are repeats as
    they are, and those with `stay` go on in the name of all. What goes on and has a gram
    that now fits in a group comes back to be compared there, the rest gets longer grams.
    A gram of a whole window is its context, so what is left of it then has no equal.

    All this is decided on places; the contexts themselves are moved once for each level.
    `rows` are durable. Returns spans (did, h, lo, hi) and contexts for groups, both as parts.
    """
    spans, groups = [], []
    for level in range(len(unit.grams)):
        rows = durable(finer(rows, unit, level)) if level else rows
        if rows.isEmpty():
            break
        places = durable(rows.select("did", "h", "start", "gram", F.unhex(F.sha2("ctx", 256)).alias("sha"), unit.size(F.col("ctx")).cast("long").alias("size")))
        # Both sides of the joins are plain shuffles, so a context or gram with very many rows is split at run time.
        best = places.groupBy("gram", "sha").agg(own.alias("best"), F.count("*").alias("n")).filter("n > 1")
        best = durable(best.select(F.col("gram").alias("b_gram"), F.col("sha").alias("b_sha"), "best", "n"))
        told = places.join(best, (F.col("gram") == F.col("b_gram")) & (F.col("sha") == F.col("b_sha")), "left")
        told = durable(told.select("did", "h", "start", "gram", "size", (F.col("n").isNotNull() & gone).alias("gone"), (F.col("n").isNull() | stay).alias("stay")))
        spans.append(told.filter("gone").select("did", "h", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("size")).alias("hi")))
        if level + 1 == len(unit.grams):
            break
        rest = told.filter("stay").select("did", "h", "start", "gram")
        many = durable(rest.groupBy("gram").count().select(F.col("gram").alias("m_gram"), (F.col("count") > most_of_one(unit, group_rows)).alias("heavy")))
        # Rows of one document may be equal in all three; the gram comes along, and each of them once.
        chosen_rows = rest.join(many, F.col("gram") == F.col("m_gram")).select("did", "h", "start", "heavy").distinct()
        dealt = rows.join(chosen_rows, ["did", "h", "start"]).select("did", "h", "start", "gram", "ctx", "heavy")
        groups.append(dealt.filter("not heavy").drop("heavy"))
        rows = dealt.filter("heavy").drop("heavy")
    return spans, groups


def grouped_by_gram(rows: DataFrame, group_rows: int, total: int) -> DataFrame:
    """`rows` with the number of a group: grams are packed into groups of about `group_rows` rows."""
    return rows.withColumn("group", F.pmod(F.xxhash64("gram"), F.lit(max(1, -(-total // group_rows)))))


def located(entry_rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """(key, at): for each text the runs with a gram of repeated(gram, heavy); bounded by the text's length."""
    hits = entry_rows.select("key", "start", "gram").join(repeated, "gram").select("key", F.struct("start", "heavy").alias("at"))
    return hits.groupBy("key").agg(F.collect_set("at").alias("at"))


def chosen(hits: DataFrame, heavy: bool) -> DataFrame:
    """(key, starts) of the hits whose gram is heavy, or not; texts without one are left out."""
    starts = F.transform(F.filter("at", lambda x: x["heavy"] == F.lit(heavy)), lambda x: x["start"])
    return hits.select("key", starts.alias("starts")).filter(F.size("starts") > 0)


SPANS = "did long, h long, lo long, hi long"


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(did, text, spans) of keyed(docs): all spans of a text, bounded by its length; null without any.

    The join goes by key, as the one in `contexts`, so both read one shuffle of the texts;
    id and digest are compared besides.
    """
    found = spans.groupBy("did", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    found = found.select(F.xxhash64("did", "h").alias("s_key"), F.col("did").alias("s_did"), F.col("h").alias("s_h"), "spans")
    same = (F.col("did").bitwiseXOR(F.col("s_did")) == 0) & (F.col("h").bitwiseXOR(F.col("s_h")) == 0)
    return docs.join(found, (F.col("key") == F.col("s_key")) & same, "left").select("did", "text", "spans")


def merged(spans, size: int, window: int) -> list[tuple[int, int]]:
    """Union of a text's spans, in order; touching spans become one. A text below the window loses nothing."""
    if any(s["hi"] == WHOLE for s in spans or ()):
        return [(0, size)] if size >= window else []
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]
