"""Phrases that hold together, from position bitmaps.

Documents of one language are laid end to end into shards: rows of word numbers, with a
gap wherever a piece ends. A shard is read in blocks of `OWNED` positions and three more,
and in a block each word has a bitmap of its positions, one 64-bit number; blocks without
the word hold nothing for it. A phrase's bitmap is that of the phrase without its last word,
shifted by one, AND that of the last word; its popcount is how often the phrase occurs
there. A gap has no bit, so no phrase leaves its piece. A block counts the phrases that
start at a position it owns, so every occurrence is counted once. Blocks are taken in
slices, each from words to its longest phrases before the next one, and popcounts add up
over blocks, slices and shards.

No shard knows what is frequent elsewhere, so there are passes, and after each the counts of
all shards are summed: words; pairs of frequent words; triples both of whose pairs passed;
and at last the phrases themselves, a quadruple if both its triples passed. Pairs and
triples are summed by hash, in buckets of which a shard sends each one row. A hash may let a
phrase too many pass and never one too few, and the last sums are of the phrases' own words.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import grouped, mapped, slices
from loomline.session import shared_folder

#: Words of a phrase, at most; occurrences of one that counts, at least; phrases reported for a language.
WORDS, LEAST, TOP = 4, 30, 2000


class Sizes(NamedTuple):
    """What bounds the memory of a task; no result depends on it."""

    #: Positions of a shard.
    shard: int = 1 << 20
    #: Blocks of a slice.
    blocks: int = 1 << 12
    #: Positions that a task holds for all languages together.
    held: int = 1 << 22
    #: Bytes of a text that are cut into words at once.
    chunk: int = 1 << 20


SIZES = Sizes()
#: Positions of a block that phrases start at; with WORDS - 1 more they fit into 64 bits.
OWNED = 60
#: Phrases of a bucket, about, and the bits that number the buckets, at least and at most.
BUCKET, FEW_BITS, MOST_BITS = 1 << 20, 8, 16
#: Shares of the rule that drops what a longer phrase explains, and the scale of scores.
INSIDE, OUTSIDE, SCALE = 100, 80, 2_000_000
_GAP = b","
_TABLE = bytes(ord(_GAP) if c in b".,;:!?" or 10 <= c <= 13 else c + 32 if 65 <= c <= 90 else 32 if c == 9 else c for c in range(256))


def _stored(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder."""
    at = f"{shared_folder(df.sparkSession)}/collocations-{uuid.uuid4()}"
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


@contextmanager
def _row_by_row(spark: SparkSession) -> Iterator[None]:
    """Jobs in here send Python one row at a time: a shard is megabytes, and a batch of many would be held by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers in few bytes: their bytes by place, of which the high ones are mostly zero."""
    return zlib.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _chunks(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts that end where a word ends."""
    at = 0
    while at < len(raw):
        end = at + size
        while end < len(raw) and raw[end] != 32 and raw[end] != _GAP[0]:
            end += 1
        yield raw[at:end]
        at = end


def shards(docs: DataFrame, sizes: Sizes = SIZES) -> DataFrame:
    """(shard, lang, own, words, counts, seq) of `docs(lang, text)`.

    `seq` numbers the words in `words`, 0 is a gap; phrases may start at the first `own`
    positions and `counts` counts the words there, 0 for words that only the rest has.
    """
    schema = "shard long, lang string, own int, words array<string>, counts array<int>, seq binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[dict[bytes, int], array]] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            known, row = held.pop(lang)
            seq = np.frombuffer(row, np.int32)
            whole = row[-1] == 0 or len(row) < WORDS
            own = len(row) if whole else len(row) - (WORDS - 1)
            if not whole:
                # The shard ends inside a piece: what it only looks at starts the next one.
                names = list(known)
                again = {_GAP: 0}
                held[lang] = again, array("i", [again.setdefault(names[i], len(again)) for i in row[own:]])
            counts = np.bincount(seq[:own], minlength=len(known)).astype(np.int32)
            counts[0] = 0
            made += 1
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_arrays([
                one(task << 32 | made, pa.int64()), one(lang, pa.string()), one(own, pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(list(known), pa.binary()).cast(pa.string())),
                one(counts, pa.list_(pa.int32())), one(_packed(seq), pa.binary())], ["shard", "lang", "own", "words", "counts", "seq"])

        for part in (p for whole in batches for p in slices(whole, 1)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                for raw in _chunks(text.translate(_TABLE), sizes.chunk):
                    known, row = held.get(lang) or held.setdefault(lang, ({_GAP: 0}, array("i")))
                    row.extend([known.setdefault(w, len(known)) for w in raw.replace(_GAP, b" , ").split()])
                    if len(row) >= sizes.shard:
                        yield flush(lang)
                if lang in held:
                    held[lang][1].append(0)
            while sum(len(row) for _, row in held.values()) > sizes.held:
                yield flush(max(held, key=lambda x: len(held[x][1])))
        for lang in list(held):
            if len(held[lang][1]):
                yield flush(lang)

    named = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(named, run, schema)


def frequent_words(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, f, shard, at): every place of the words that occur often enough over all shards."""
    each = parts.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("shard", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").cast("long").alias("n")).filter("at > 0")
    return each.withColumn("f", F.sum("n").over(W.partitionBy("lang", "word"))).filter(F.col("f") >= least).select("lang", "word", "f", "shard", "at")


class _Level(NamedTuple):
    """Phrases of one length in a slice: one entry for each block and phrase."""

    #: Entry at each (block, start), -1 for none.
    at: np.ndarray
    #: Bitmap of the places of the last word.
    bits: np.ndarray
    #: The starts that the block owns.
    own: np.ndarray
    #: Columns of word numbers.
    words: tuple[np.ndarray, ...]
    #: Hash of the phrase.
    key: np.ndarray

    @property
    def n(self) -> np.ndarray:
        """Occurrences that start at a position of the block."""
        return np.bitwise_count(self.bits & self.own << np.uint64(len(self.words) - 1)).astype(np.int64)

    def kept(self, good: np.ndarray) -> _Level:
        """The same level without the entries that are not good."""
        at = np.where((self.at >= 0) & good[self.at], self.at, -1) if len(good) else self.at
        return self._replace(at=at, bits=np.where(good, self.bits, np.uint64(0)))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two hashes, in their order."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (b.view(np.uint64) ^ b.view(np.uint64) >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _words(row: np.ndarray, own: int, hashes: np.ndarray, first: int, last: int) -> _Level:
    """The words of blocks `first` to `last` of a shard that owns its first positions; `row` has -1 where no word counts."""
    width = OWNED + WORDS - 1
    place = np.arange(first, last)[:, None] * OWNED + np.arange(width)
    token = np.where(place < len(row), row[np.minimum(place, len(row) - 1)], -1)
    cells = np.flatnonzero(token >= 0)
    words = token.ravel()[cells].astype(np.int64)
    code = cells // width * len(hashes) + words
    order = np.argsort(code, kind="stable")
    code = code[order]
    starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    at = np.full(token.shape, -1, np.int64)
    at.ravel()[cells[order]] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(code)]))
    bit = np.uint64(1) << (cells[order] % width).astype(np.uint64)
    bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
    # The last block of a shard may own less than others.
    starting = np.minimum(np.maximum(own - (first + cells[order][starts] // width) * OWNED, 0), OWNED).astype(np.uint64)
    kinds = words[order][starts]
    return _Level(at, bits, (np.uint64(1) << starting) - np.uint64(1), (kinds,), hashes[kinds])


def _longer(level: _Level, words: _Level) -> _Level:
    """Phrases one word longer, where the phrase's beginning and its end are entries of `level`."""
    n = len(level.words)
    here = level.at[:, :words.at.shape[1] - n]
    last = words.at[:, n:]
    good = (here >= 0) & (last >= 0)
    if n > 1:
        good &= level.at[:, 1:here.shape[1] + 1] >= 0
    row, col = np.nonzero(good)
    pair = here[row, col] * max(1, len(words.bits)) + last[row, col]
    code, entry = np.unique(pair, return_inverse=True)
    a, b = code // max(1, len(words.bits)), code % max(1, len(words.bits))
    at = np.full((len(words.at), here.shape[1]), -1, np.int64)
    at[row, col] = entry
    return _Level(at, level.bits[a] << np.uint64(1) & words.bits[b], level.own[a], (*(w[a] for w in level.words), words.words[0][b]), _mixed(level.key[a], words.key[b]))


def _slices(seq: bytes, own: int, ats: np.ndarray, hs: np.ndarray, blocks: int) -> Iterator[_Level]:
    """The frequent words of a shard, slice by slice."""
    row = _unpacked(seq).astype(np.int32)
    size = int(max(row.max(initial=0), ats.max(initial=0))) + 1
    local, hashes = np.full(size, -1, np.int32), np.zeros(size, np.int64)
    local[ats], hashes[ats] = ats, hs
    local[0] = -1
    row, count = local[row], -(-own // OWNED)
    for first in range(0, count, blocks):
        yield _words(row, own, hashes, first, min(count, first + blocks))


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


def _short(key: np.ndarray, bits: int) -> np.ndarray:
    """What is left of a hash: the bucket and 32 bits within it."""
    return (key.view(np.uint64) >> np.uint64(32 - bits)).view(np.int64)


def _known(key: np.ndarray, passed: np.ndarray, bits: int) -> np.ndarray:
    """Whether the hashes are among those that passed, which are in order."""
    short = _short(key, bits)
    if not len(passed):
        return np.zeros(len(key), bool)
    return passed[np.minimum(np.searchsorted(passed, short), len(passed) - 1)] == short


def _numbers(blobs: list[bytes] | None) -> np.ndarray:
    """Hashes that passed, in order, from blobs of a bucket's number and the 32 bits of each."""
    parts = [np.frombuffer(b, np.uint32) for b in blobs or ()]
    return np.sort(np.concatenate([p[1:].astype(np.int64) | int(p[0]) << 32 for p in parts])) if parts else np.zeros(0, np.int64)


def _levels(batch: pa.RecordBatch, i: int, bits: int, blocks: int) -> Iterator[tuple[_Level, ...]]:
    """Words, pairs and so on of each slice of a shard in row i, as far as what passed is known: columns own, seq, ats, hs, and pairs and triples if they are there."""
    own, seq = batch.column("own")[i].as_py(), batch.column("seq")[i].as_py()
    passed = [_numbers(batch.column(c)[i].as_py()) for c in ("pairs", "triples") if c in batch.schema.names]
    for words in _slices(seq, own, batch.column("ats")[i].values.to_numpy(), batch.column("hs")[i].values.to_numpy(), blocks):
        out = [words, _longer(words, words)]
        for known in passed:
            out[-1] = out[-1].kept(_known(out[-1].key, known, bits))
            out.append(_longer(out[-1], words))
        yield tuple(out)


def _passing(rows: DataFrame, name: str, least: int, bits: int, blocks: int) -> DataFrame:
    """(shard, name): the hashes of the longest phrases of a shard's levels that are frequent enough over all shards."""
    most, kind = (255, np.uint8) if least <= 255 else (2**31 - 1, np.uint32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sums = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for levels in _levels(batch, i, bits, blocks):
                    n = levels[-1].n
                    sums.append(_summed(_short(levels[-1].key, bits)[n > 0], n[n > 0]))
                key, n = _summed(np.concatenate([k for k, _ in sums]), np.concatenate([n for _, n in sums]))
                # Sums are only compared with the threshold, so larger counts may be cut to fit a byte.
                low, n, bucket = key.astype(np.uint32), np.minimum(n, most).astype(kind), key >> 32
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                ends = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[edges[:-1]], pa.int64()), pa.array(np.full(len(ends), batch.column("shard")[i].as_py())), pa.array([low[a:b].tobytes() for a, b in ends], pa.binary()), pa.array([n[a:b].tobytes() for a, b in ends], pa.binary())],
                    ["bucket", "shard", "low", "n"])

    def decide(table: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
        key, n = _summed(np.concatenate(lows), np.concatenate([np.frombuffer(x, kind) for x in table.column("n").to_pylist()]).astype(np.int64))
        good = key[n >= least]
        hit = np.isin(np.concatenate(lows), good)
        bucket, at, shards_, out = np.array([table.column("bucket")[0].as_py()], np.uint32), 0, [], []
        for shard, low in zip(table.column("shard").to_pylist(), lows):
            if (own := low[hit[at:at + len(low)]]).size:
                shards_.append(shard)
                out.append(np.concatenate([bucket, own]).tobytes())
            at += len(low)
        return pa.table({"shard": pa.array(shards_, pa.int64()), "blob": pa.array(out, pa.binary())})

    sent = mapped(rows, send, "bucket long, shard long, low binary, n binary")
    return grouped(sent.groupBy("bucket"), decide, "shard long, blob binary", rows.sparkSession).groupBy("shard").agg(F.collect_list("blob").alias(name))


def _exact(levels: list[tuple[np.ndarray, ...]], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of word numbers, and the sums of their counts."""
    code = np.zeros(len(n), np.int64)
    for column in levels:
        _, code = np.unique(code * (int(column.max(initial=0)) + 1) + column, return_inverse=True)
    key, first = np.unique(code, return_index=True)
    return [c[first] for c in levels], np.bincount(code, n, len(key)).astype(np.int64)


def _phrases(lang: str, names: pa.Array, columns: list[np.ndarray], bucket: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's phrases of one length, a row for each bucket: the phrases in order, one a line, and their counts."""
    if not len(n):
        return
    phrase = pc.binary_join_element_wise(*(names.take(pa.array(c)) for c in columns), " ")
    order = pc.sort_indices(pa.table({"b": pa.array(bucket), "p": phrase}), [("b", "ascending"), ("p", "ascending")])
    phrase, at = phrase.take(order), order.to_numpy()
    bucket, n = bucket[at], n[at]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist()
    blobs = [zlib.compress("\n".join(phrase[i:j].to_pylist()).encode(), 1) for i, j in zip(edges, edges[1:])]
    counts = [_packed(n[i:j]) for i, j in zip(edges, edges[1:])]
    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(blobs)), pa.array(bucket[edges[:-1]]), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["lang", "bucket", "phrases", "n"])


def phrase_counts(docs: DataFrame, least: int = LEAST, sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of 1 to WORDS words that occur often enough, and (lang, n) with all words."""
    parts = _stored(shards(docs, sizes))
    n = _stored(parts.groupBy("lang").agg(F.sum(F.expr("aggregate(counts, 0L, (x, y) -> x + y)")).alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(FEW_BITS, (total // BUCKET).bit_length()))
    words = _stored(frequent_words(parts, least))
    own = _stored(words.groupBy("shard").agg(F.collect_list(F.struct("at", F.xxhash64("lang", "word").alias("h"))).alias("w")).select("shard", F.col("w.at").alias("ats"), F.col("w.h").alias("hs")))
    plain = parts.select("shard", "own", "seq").join(own, "shard")
    with _row_by_row(docs.sparkSession):
        pairs = _stored(_passing(plain, "pairs", least, bits, sizes.blocks))
    triples = _passing(plain.join(pairs, "shard"), "triples", least, bits, sizes.blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, names = batch.column("lang")[i].as_py(), batch.column("words")[i].values
                found: list[list] = [[], [], []]
                for levels in _levels(batch, i, bits, sizes.blocks):
                    for k, level in enumerate(levels[1:]):
                        some = level.n > 0
                        found[k].append(_exact([*(w[some] for w in level.words), _short(level.key[some], bits) >> 32], level.n[some]))
                for k, some in enumerate(found):
                    if some:
                        (*columns, bucket), n = _exact([np.concatenate([c[j] for c, _ in some]) for j in range(k + 3)], np.concatenate([n for _, n in some]))
                        yield from _phrases(lang, names, columns, bucket, n)

    def total_of(table: pa.Table) -> pa.Table:
        parts_ = [(lang, zlib.decompress(blob).split(b"\n"), _unpacked(n)) for lang, blob, n in zip(table.column("lang").to_pylist(), table.column("phrases").to_pylist(), table.column("n").to_pylist())]
        flat = pa.table({"lang": pa.array([lang for lang, p, _ in parts_ for _ in p]), "phrase": pa.array([x for _, p, _ in parts_ for x in p], pa.binary()).cast(pa.string()), "f": pa.array(np.concatenate([n for *_, n in parts_]).astype(np.int64))})
        sums = flat.group_by(["lang", "phrase"]).aggregate([("f", "sum")]).rename_columns(["lang", "phrase", "f"])
        return sums.filter(pc.greater_equal(sums.column("f"), least)).select(["lang", "phrase", "f"])

    every = parts.join(own, "shard").join(pairs, "shard").join(triples, "shard", "left").select("lang", "own", "seq", "words", "ats", "hs", "pairs", "triples")
    sent = mapped(every, send, "lang string, bucket long, phrases binary, n binary")
    longer = grouped(sent.groupBy("bucket"), total_of, "lang string, phrase string, f long", docs.sparkSession).select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "f")
    single = words.groupBy("lang", F.col("word").alias("phrase")).agg(F.max("f").alias("f")).select("lang", "phrase", F.lit(1).alias("size"), "f")
    with _row_by_row(docs.sparkSession):
        return _stored(longer.unionByName(single)), n


def _joined(words: Column, first: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, sizes: Sizes = SIZES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of `docs(lang, text, ..)`, the best `top` phrases of each language.

    Null languages count as `und`, null and empty texts have no words, repeated rows count
    each time; ties in score go to the more frequent phrase, then by UTF-8 order; languages
    without a phrase that is frequent enough have no rows, and so has an empty table.
    Further columns are not looked at. Texts are read in chunks, however long.
    """
    counts, n = phrase_counts(docs, least, sizes)
    phrases = counts.filter("size > 1").withColumn("w", F.split("phrase", " "))
    size, w, k = F.col("size"), F.col("w"), F.col("k")
    # What stands inside a longer phrase that is nearly as frequent goes.
    inside = phrases.filter("size > 2").select("lang", "w", "size", F.col("f").alias("outer"), F.explode(F.sequence(F.lit(2), size - 1)).alias("k")).select(
        "lang", "w", "outer", "k", F.explode(F.sequence(F.lit(1), size - k + 1)).alias("i")).select("lang", _joined(w, F.col("i"), k).alias("phrase"), "outer").groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").filter(f"outer is null or {INSIDE} * outer < {OUTSIDE} * f")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _joined(w, F.lit(1), k).alias("left"), _joined(w, k + 1, size - k).alias("right"))
    of = counts.select("lang", "phrase", "f")
    scored = cuts.join(of.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(of.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    wide = lambda c: c.cast("decimal(19,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(F.col("a")), wide(F.col("l")) + wide(F.col("r")))
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # The best of a part of the phrases first, so that no task sorts a language.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(512))).orderBy(*order)
    some = best.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
piece as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) p from d),
words as (select lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') w from piece),
total as (select lang, cast(sum(len(w)) as bigint) n from words group by all),
starts as (select lang, w, unnest(range(1, len(w) + 1)) i from words),
grams as (select lang, s.size, array_to_string(w[i:i + s.size - 1], ' ') phrase from starts, (select unnest([1, 2, 3, 4]) size) s where i + s.size - 1 <= len(w)),
f as (select lang, size, phrase, count(*) f from grams group by all having count(*) >= 30),
cand as (select lang, size, phrase, f a, string_split(phrase, ' ') w from f where size > 1),
inner_ as (select lang, size, a, w, unnest(range(2, size)) k from cand where size > 2),
inside as (select lang, array_to_string(w[i:i + k - 1], ' ') phrase, max(a) longest from (select lang, a, w, k, unnest(range(1, size - k + 2)) i from inner_) group by all),
kept as (select c.* from cand c left join inside i using (lang, phrase) where i.longest is null or 100 * i.longest < 80 * c.a),
cuts as (select lang, phrase, a, w, size, unnest(range(1, size)) k from kept),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.f l, y.f r, (2000000::hugeint * c.a) // (x.f + y.f)::hugeint score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from best)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score
from ranked join total using (lang) where rank <= 2000
"""
