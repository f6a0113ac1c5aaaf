"""Byte-level BPE by rounds over padded matrices.

A text is cut into pieces by the vocabulary's pattern, and pieces are bytes. Pieces
that the vocabulary has whole are one token. The others, once each, are laid into
matrices by length, one piece a row, padded at the end. In each round every row looks
up the ranks of its neighbouring pairs, merges the leftmost pair of least rank and moves
up what follows; rows without a pair that merges leave, and so do columns that no row
fills any more. A pair is looked up by two hashed places (a cuckoo table), so a lookup
is two gathers for the whole matrix.

Rows of more than `SHORT` bytes merge all pairs of their least rank in one round, from
the left and without overlap. That is what one merge a round comes to, if no merge makes
a pair of lower rank, which holds where each token's own bytes merge to that token; the
vocabulary is checked for it and else merges one at a time. Long pieces are first cut
between bytes that stand side by side in no token.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomline.llm.common import free_name, mapped, schema_with, slices

#: Rank of a pair that does not merge.
NONE = np.int32(2**31 - 1)
#: Rows up to so many bytes merge one pair a round.
SHORT = 32
#: Cells of a matrix, which bounds what a round works on.
CELLS = 1 << 18
#: Bound of a worker's memory of pieces, in bytes as estimated; past it the worker starts again.
PIECE_BYTES = 48 << 20
#: Pieces of one text that are held at once.
AT_ONCE = 1 << 17
_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """The token that each pair of tokens merges to, at one of two hashed places."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (len(pairs) * 5 // 4).bit_length())
        for first in range(0, len(_ODD), 2):
            self.shift, self.odd = np.uint64(64 - bits), (_ODD[first], _ODD[first + 1])
            self.keys, self.ranks = np.full((2, 1 << bits), 2**64 - 1, np.uint64), np.full((2, 1 << bits), NONE, np.int32)
            if self._fill(pairs, bits):
                return
        raise ValueError("the pairs of the vocabulary find no places")

    def _fill(self, pairs, bits) -> bool:
        at: list[dict[int, tuple[int, int]]] = [{}, {}]
        for (a, b), rank in pairs.items():
            item, side = (a << 32 | b, rank), 0
            for _ in range(200):
                place = (item[0] * self.odd[side] & 2**64 - 1) >> 64 - bits
                item, at[side][place] = at[side].get(place), item
                if item is None:
                    break
                side = 1 - side
            else:
                return False
        for side in (0, 1):
            places = np.fromiter(at[side], np.int64, len(at[side]))
            self.keys[side, places] = np.fromiter((k for k, _ in at[side].values()), np.uint64, len(places))
            self.ranks[side, places] = np.fromiter((r for _, r in at[side].values()), np.int32, len(places))
        return True

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE where they don't merge; a negative token merges with nothing."""
        key = left.astype(np.int64).view(np.uint64) << np.uint64(32) | right.astype(np.uint32)
        out = np.full(key.shape, NONE, np.int32)
        for side in (0, 1):
            place = key * np.uint64(self.odd[side]) >> self.shift
            hit = self.keys[side][place] == key
            out[hit] = self.ranks[side][place[hit]]
        return out


def _merge_one(tok: np.ndarray, rank: np.ndarray, low: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Each row's leftmost pair of least rank becomes one token; the rest moves up."""
    rows, at = np.arange(len(tok)), rank.argmin(axis=1)
    cols = np.arange(tok.shape[1])
    tok[rows, at] = low
    tok = np.take_along_axis(np.pad(tok, ((0, 0), (0, 1)), constant_values=-1), cols + (cols > at[:, None]), axis=1)
    rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE), cols[:-1] + (cols[:-1] > at[:, None]), axis=1)
    right = np.minimum(at + 1, tok.shape[1] - 1)
    ends = at < tok.shape[1] - 1
    rank[rows[ends], at[ends]] = table.look(tok[rows, at], tok[rows, right])[ends]
    some = at > 0
    rank[rows[some], at[some] - 1] = table.look(tok[rows[some], at[some] - 1], tok[rows[some], at[some]])
    return tok, rank


def _merge_all(tok: np.ndarray, rank: np.ndarray, low: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of each row's least rank, from the left and without overlap, become one token each; the rest moves up."""
    hit = rank == low[:, None]
    cols = np.arange(hit.shape[1], dtype=np.int32)
    before = np.maximum.accumulate(np.where(hit, np.int32(-1), cols), axis=1)
    hit &= (cols - before) % 2 == 1
    tok[:, :-1][hit] = np.broadcast_to(low[:, None], hit.shape)[hit]
    stay = tok >= 0
    stay[:, 1:] &= ~hit
    n = stay.sum(axis=1)
    out = np.full((len(tok), int(n.max())), -1, np.int32)
    fill = np.arange(out.shape[1]) < n[:, None]
    out[fill] = tok[stay]
    # Only pairs beside a merged token are looked up; the others keep their ranks.
    made, kept = np.zeros(tok.shape, bool), np.full(tok.shape, NONE, np.int32)
    made[:, :-1], kept[:, :-1] = hit, rank
    new, old = np.zeros(out.shape, bool), np.full(out.shape, NONE, np.int32)
    new[fill], old[fill] = made[stay], kept[stay]
    rank, ask = old[:, :-1], (new[:, :-1] | new[:, 1:])
    rank[ask] = table.look(out[:, :-1][ask], out[:, 1:][ask])
    return out, rank


class ByteBPE:
    """Ranks of byte strings, compiled for matrices. Pickles with its tables; its memory of pieces stays behind."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern, self.ranks = pattern, ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for w, r in ranks.items():
            self.tokens[r] = w
        get = ranks.get
        self.table = PairTable({(a, b): r for w, r in ranks.items() for k in range(1, len(w)) if (a := get(w[:k])) is not None and (b := get(w[k:])) is not None})
        self.byte = np.array([get(bytes([i]), -1) for i in range(256)], np.int32)
        if self.byte.min() < 0:
            raise ValueError("the vocabulary lacks some bytes")
        self.beside = np.zeros((256, 256), bool)
        for w in ranks:
            line = np.frombuffer(w, np.uint8)
            self.beside[line[:-1], line[1:]] = True
        self.whole = False
        own = sorted(ranks, key=len)
        self.whole = all(len(ids) == 1 for ids in self.merge(own))
        self._fresh()

    def _fresh(self) -> None:
        import regex

        self.known: dict[str, bytes] = {}
        self.held = 0
        self.split = regex.compile(self.pattern)
        # The same pattern for plain ASCII, which Python's own engine reads faster.
        plain = self.pattern.replace(r"[^\s\p{L}\p{N}]", "[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]").replace(r"\s", "[\t-\r ]").replace(r"\S", "[^\t-\r ]")
        self.split_ascii = re.compile(plain) if "\\" not in plain else self.split

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "held", "split", "split_ascii")}

    def __setstate__(self, kept):
        self.__dict__.update(kept)
        self._fresh()

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece by merges alone, in buckets of like lengths; an empty piece has none."""
        # Long pieces fall into parts that no token spans.
        parts: list[bytes] = []
        first = [0]
        for p in pieces:
            if len(p) > SHORT:
                line = np.frombuffer(p, np.uint8)
                cuts = [0, *(np.flatnonzero(~self.beside[line[:-1], line[1:]]) + 1).tolist(), len(p)]
                parts += [p[i:j] for i, j in zip(cuts, cuts[1:])]
            else:
                parts.append(p)
            first.append(len(parts))
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        at = 0
        while at < len(order):
            # A bucket: rows of at most a quarter more bytes than its shortest, and at most CELLS cells.
            least = len(parts[order[at]])
            end = at + 1
            while end < len(order) and (n := len(parts[order[end]])) <= least + max(1, least >> 2) and n * (end - at + 1) <= CELLS:
                end += 1
            self._bucket([parts[i] for i in order[at:end]], order[at:end], done)
            at = end
        return [done[i] if j == i + 1 else np.concatenate(done[i:j]) if j > i else done[0][:0] for i, j in zip(first, first[1:])]

    def _bucket(self, rows: list[bytes], place: list[int], done: list[np.ndarray]) -> None:
        sizes = np.array([len(r) for r in rows])
        width = max(1, int(sizes.max()))
        tok = np.full((len(rows), width), -1, np.int32)
        tok[np.arange(width) < sizes[:, None]] = self.byte[np.frombuffer(b"".join(rows), np.uint8)]
        step = _merge_all if self.whole and width > SHORT else _merge_one
        rank, at = self.table.look(tok[:, :-1], tok[:, 1:]), np.array(place)
        while len(tok):
            low = rank.min(axis=1, initial=NONE)
            if (over := low == NONE).any():
                ends = (tok[over] >= 0).sum(axis=1)
                for i, row, n in zip(at[over].tolist(), tok[over], ends.tolist()):
                    done[i] = row[:n].copy()
                tok, rank, at, low = tok[~over], rank[~over], at[~over], low[~over]
                if not len(tok):
                    return
            tok, rank = step(tok, rank, low, self.table)
            # Compaction of columns that no row fills any more.
            while tok.shape[1] > 1 and (tok[:, -1] < 0).all():
                tok, rank = tok[:, :-1], rank[:, :-1]

    def pieces(self, text: str | None) -> Iterator[list[str]]:
        """The pattern's matches in order, in lists of a bounded length."""
        if not text:
            return
        split = self.split_ascii if text.isascii() else self.split
        if len(text) <= AT_ONCE:
            yield split.findall(text)
        else:
            found = (m.group() for m in split.finditer(text))
            while some := list(islice(found, AT_ONCE)):
                yield some

    def learn(self, lists: list[list[str]]) -> None:
        """Have the ids of all these pieces at hand."""
        if self.held > PIECE_BYTES:
            self.known.clear()
            self.held = 0
        new = list(set().union(*lists) - self.known.keys())
        merged, ranks = [], self.ranks
        for p in new:
            raw = p.encode()
            self.held += 170 + 5 * len(raw)
            if (r := ranks.get(raw)) is not None:
                self.known[p] = r.to_bytes(4, "little")
            else:
                merged.append((p, raw))
        for (p, _), ids in zip(merged, self.merge([raw for _, raw in merged])):
            self.known[p] = ids.astype("<u4").tobytes()

    def packed(self, texts: list[str | None]) -> Iterator[Iterator[bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, in parts; read each before the next."""
        short = [next(self.pieces(t), []) if len(t or "") <= AT_ONCE else None for t in texts]
        self.learn([s for s in short if s is not None])
        get = self.known.__getitem__
        ready = [None if s is None else b"".join(map(get, s)) for s in short]
        del short
        for t, done in zip(texts, ready):
            yield iter([done]) if done is not None else self._parts(t)

    def _parts(self, text: str) -> Iterator[bytes]:
        for some in self.pieces(text):
            self.learn([some])
            yield b"".join(map(self.known.__getitem__, some))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty texts have none."""
        return np.frombuffer(b"".join(next(self.packed([text]))), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBPE:
    """A file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}, pattern)


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    """The tables' size follows the vocabulary, not the data."""
    return spark.sparkContext.broadcast(load(path or default_path(), pattern or default_pattern()))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with the token ids of each whole text in `ids_col` (array<int>); underscores follow a name that is taken.

    Null and empty texts have no ids; repeated rows are encoded like any other.
    """
    ids_col, shared, k = free_name(docs, ids_col), _shared(docs.sparkSession, path, pattern), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for part in (p for whole in batches for p in slices(whole, k)):
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in bpe.packed(part.column(k).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, ids_col])

    return mapped(docs, run, schema_with(docs, ids_col, "array<int>"))


def decode(tokens: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`tokens` with the bytes of `ids_col` in `bytes_col` (binary); null ids decode to nothing, underscores follow a name that is taken."""
    bytes_col, shared, k = free_name(tokens, bytes_col), _shared(tokens.sparkSession, path, pattern), tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for part in (p for whole in batches for p in slices(whole, k)):
            out = pa.array([bpe.decode(x or ()) for x in part.column(k).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, out], [*part.schema.names, bytes_col])

    return mapped(tokens, run, schema_with(tokens, bytes_col, "binary"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode each text, decode its ids, and return what identifies both: one pass, nothing shuffled."""
    shared = _shared(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for part in (p for whole in batches for p in slices(whole, 1)):
            counts, of_ids, of_bytes = [], [], []
            for parts in bpe.packed(part.column(1).to_pylist()):
                n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
                for packed in parts:
                    n += len(packed) >> 2
                    ids_sha.update(packed)
                    bytes_sha.update(bpe.decode(np.frombuffer(packed, "<u4").tolist()))
                counts.append(n)
                of_ids.append(ids_sha.hexdigest())
                of_bytes.append(bytes_sha.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of the bytes decoded from them."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
