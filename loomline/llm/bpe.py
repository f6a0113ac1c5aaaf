"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton reads tokens. It starts with one state that accepts any row of base
symbols, and each merge (u, v) -> w, in order of rank, is worked in as a gadget:

* every state that has an arc u gets an arc w;
* the arc u now leads to a copy of its old target without the arc v;
* the arc w leads where the arc v led.

All arcs with one label lead to one state, so a state is named by the token read last
and the automaton is a bit table: arc t leaves state s, or not. A row of tokens is what
BPE makes of a word if and only if the automaton accepts it, and every prefix of a word
has one accepted row. So encoding walks a word from left to right along the tokens for
which the state has an arc, longer ones first, and steps back where the end can't be
reached. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomline.llm.common import free_name, mapped, schema_with, slices

END = "</w>"
#: Bound of a worker's memory of words, in bytes as estimated; past it the worker starts again.
WORD_BYTES = 40 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def gadgets(n_tokens: int, merges: list[tuple[int, int, int]], final: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Work the merges into the automaton, in order.

    Returns `arcs`, bit s of row t set if state s has arc t, and `state` of each token.
    Tokens that end a word lead to a state without arcs, -1, which has no bits.
    """
    state = np.full(n_tokens, -1, np.int32)
    state[~final] = np.arange(int((~final).sum()), dtype=np.int32)
    arcs = np.zeros((n_tokens, (int((~final).sum()) + 7) // 8), np.uint8)
    made = {w for _, _, w in merges}
    base = np.array([t for t in range(n_tokens) if t not in made], np.int64)
    for t in base:
        if not final[t]:
            arcs[base, state[t] >> 3] |= np.uint8(1 << (state[t] & 7))
    known = np.zeros(n_tokens, bool)
    known[base] = True
    top = int(base.max()) + 1
    for u, v, w in merges:
        su, sv, sw = int(state[u]), int(state[v]), int(state[w])
        if not arcs[v, su >> 3] >> (su & 7) & 1:
            continue  # v never follows u: an earlier merge always takes it
        if sw >= 0:
            arcs[:top, sw >> 3] |= (arcs[:top, sv >> 3] >> np.uint8(sv & 7) & np.uint8(1)) << np.uint8(sw & 7)
        arcs[v, su >> 3] &= np.uint8(255 ^ (1 << (su & 7)))
        arcs[w] = arcs[u]
        top = max(top, w + 1)
    return arcs, state


class Automaton:
    """The compiled tokenizer; pickles small, unpacks in a worker.

    Tokens with the same row of bits share it, and so do states with the same column:
    `row` and `col` lead from a token to its row and to the column of the state it leads to.
    """

    def __init__(self, labels: list[str], added: dict[str, int], arcs: np.ndarray, state: np.ndarray):
        self.labels, self.added = labels, added
        rows: dict[bytes, int] = {}
        self.row = [rows.setdefault(r.tobytes(), len(rows)) for r in arcs]
        kinds = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), arcs.shape[1])
        del rows
        columns: dict[bytes, int] = {}
        of = [columns.setdefault(c.tobytes(), len(columns)) for k in range(kinds.shape[1])
              for c in np.packbits(np.unpackbits(kinds[:, k:k + 1], axis=1, bitorder="little"), axis=0).T]
        self.col = [of[q] if q >= 0 else -1 for q in state.tolist()]
        del of
        table = np.zeros(((len(columns) + 7) // 8, len(kinds)), np.uint8)
        for k, c in enumerate(columns):
            table[k >> 3] |= np.unpackbits(np.frombuffer(c, np.uint8))[:len(kinds)] << np.uint8(k & 7)
        self.stride, self.arcs = table.shape[0], np.ascontiguousarray(table.T).tobytes()
        self._unpack()

    def _unpack(self) -> None:
        import regex

        self.words: dict[str, tuple[int, ...]] = {}
        self.held = 0
        # Tokens inside a word, tokens that end one, and the longest label with a first symbol.
        self.at: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.longest: dict[str, int] = {}
        specials = set(self.added.values())
        for i, label in enumerate(self.labels):
            if i in specials:
                continue
            final = label.endswith(END)
            plain = label[:-len(END)] if final else label
            (self.last if final else self.at)[plain] = i
            self.longest[plain[:1]] = max(self.longest.get(plain[:1], 0), len(plain))
        kinds = r"'s|'t|'re|'ve|'m|'ll|'d|"
        self.split = regex.compile(kinds + r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.split_ascii = re.compile(kinds + r"[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
        self.symbols = dict(enumerate(byte_symbols()))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __getstate__(self):
        return self.labels, self.added, self.stride, zlib.compress(self.arcs, 1), np.array(self.row, np.int32), np.array(self.col, np.int32)

    def __setstate__(self, kept):
        self.labels, self.added, self.stride, arcs, row, col = kept
        self.arcs, self.row, self.col = zlib.decompress(arcs), row.tolist(), col.tolist()
        self._unpack()

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The path of one pre-split word; the bytes that no token covers don't occur.

        Longer tokens are tried first. Every beginning of a word has one accepted row, so
        a position from which the end was not reached is never tried again.
        """
        s = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self.symbols)
        n, at, last, arcs, stride, rows, cols, longest = len(s), self.at, self.last, self.arcs, self.stride, self.row, self.col, self.longest
        path: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        i, byte, bit = 0, 0, 0
        j = min(n, longest.get(s[0], 0))
        while True:
            while j > i:
                if j not in dead:
                    t = at.get(s[i:j]) if j < n else last.get(s[i:])
                    if t is not None and (not i or arcs[rows[t] * stride + byte] >> bit & 1):
                        break
                j -= 1
            if j > i:
                path.append(t)
                if j == n:
                    return tuple(path)
                ends.append(j)
                i = j
                j = min(n, i + longest.get(s[i], 0))
            else:
                dead.add(i)
                if not path:
                    return ()
                path.pop()
                j = ends.pop() - 1
                i = ends[-1] if ends else 0
            if i:
                q = cols[path[-1]]
                byte, bit = q >> 3, q & 7

    def split_words(self, text: str) -> list[str]:
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; added tokens are cut out first, null and blank texts have none."""
        if not text:
            return []
        if self.cut and "<|" in text:
            out: list[int] = []
            for k, part in enumerate(self.cut.split(text)):
                out += [self.added[part]] if k % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        words = self.split_words(text)
        known = self.words
        if self.held > WORD_BYTES:
            known.clear()
            self.held = 0
        for w in set(words):
            if w not in known:
                ids = known[w] = self.encode_word(w)
                self.held += 240 + 2 * len(w) + 8 * len(ids)
        return list(chain.from_iterable(map(known.__getitem__, words)))

    def decode(self, ids) -> str:
        """The labels of the arcs; without a decoder the file's labels are joined by spaces."""
        return " ".join(map(self.labels.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def compile_automaton(path: str) -> Automaton:
    """Compile a tokenizer file with BPE over bytes and word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    n = max([*vocab.values(), *added.values()]) + 1
    labels = [""] * n
    for k, i in [*vocab.items(), *added.items()]:
        labels[i] = k
    plain = [i for i in range(n) if labels[i] not in added]
    if plain != list(range(len(plain))):
        raise ValueError("added tokens must follow the vocabulary")
    pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
    rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
    final = np.array([labels[i].endswith(END) for i in plain])
    arcs, state = gadgets(len(plain), rules, final)
    return Automaton(labels, added, arcs, state)


def broadcast_automaton(spark: SparkSession, path: str | None):
    """The automaton's size follows the vocabulary, not the data."""
    return spark.sparkContext.broadcast(compile_automaton(path or default_path()))


def _mapped(docs: DataFrame, schema, k: int, make) -> DataFrame:
    """mapInArrow in slices of a batch that hold about SLICE bytes of column k, so that a worker's memory does not grow with the number of rows in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, k):
                yield make(part)

    return mapped(docs, run, schema)


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`docs` with the token ids of `text_col` in `ids_col` (array<int>); underscores follow a name that is taken.

    Null and blank texts have no ids. Texts are encoded whole, each row by itself.
    """
    ids_col = free_name(docs, ids_col)
    shared = broadcast_automaton(docs.sparkSession, path)
    k = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = shared.value
        ids = [auto.encode(t.as_py()) for t in batch.column(k)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, ids_col])

    return _mapped(docs, schema_with(docs, ids_col, "array<int>"), k, make)


def decode(tokens: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`tokens` with the decoded text of `ids_col` in `text_col`; null ids decode to the empty text."""
    text_col = free_name(tokens, text_col)
    shared = broadcast_automaton(tokens.sparkSession, path)
    k = tokens.columns.index(ids_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = shared.value
        texts = [auto.decode(x.as_py() or ()) for x in batch.column(k)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return _mapped(tokens, schema_with(tokens, text_col, "string"), k, make)


def encode_and_decode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded", path: str | None = None) -> DataFrame:
    """`docs` with ids and the text decoded from them, in one pass with one automaton for each worker; underscores follow names that are taken."""
    ids_col, decoded_col = free_name(docs, ids_col), free_name(docs, decoded_col)
    shared = broadcast_automaton(docs.sparkSession, path)
    k = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = shared.value
        ids = [auto.encode(t.as_py()) for t in batch.column(k)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([auto.decode(x) for x in ids], pa.string())], [*batch.schema.names, ids_col, decoded_col])

    return _mapped(docs, T.StructType([*schema_with(docs, ids_col, "array<int>").fields, T.StructField(decoded_col, T.StringType())]), k, make)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode each text and return what identifies both: one pass, nothing shuffled."""
    shared = broadcast_automaton(docs.sparkSession, path)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        auto = shared.value
        numbers = auto.__dict__.setdefault("numbers", [str(i) for i in range(len(auto.labels))])
        counts, ids_sha, text_sha = [], [], []
        for t in batch.column(1):
            ids = auto.encode(t.as_py())
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(auto.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                          ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"),
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 1, make)


def op1_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
