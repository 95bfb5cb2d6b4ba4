"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts are cut into pieces by the vocabulary's pattern; every distinct piece of an Arrow batch is encoded once. Pieces are
bucketed by byte length into padded numpy matrices of token ids. In every round each row merges its leftmost pair of
minimum rank, and with it the later occurrences of that pair that do not overlap: these would be the next rounds' choices,
as a pair with a merged token always has a higher rank. Pair ranks come from a hashed lookup for the whole matrix at once,
the merged places are compacted away, and rows without a pair leave the matrix. Pieces of every length go this way.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import spread

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: The pattern published with this vocabulary family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.int64(1) << 40
#: Distinct pieces kept between batches by one Python worker.
CACHE_PIECES = 200_000


class Vocabulary:
    """Ranks of a ``.tiktoken`` file as arrays for vectorised pair lookup."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    a, b = line.split()
                    ranks[base64.b64decode(a)] = int(b)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ranks = ranks
        # a merged token can come from any split into two tokens of lower rank
        keys, vals = [], []
        for tok, r in ranks.items():
            for i in range(1, len(tok)):
                a, b = ranks.get(tok[:i]), ranks.get(tok[i:])
                if a is not None and b is not None and a < r and b < r:
                    keys.append((a << 20) | b)
                    vals.append(r)
        keys, vals = np.array(keys, np.int64), np.array(vals, np.int64)
        order = np.argsort(keys, kind="stable")
        self._build(keys[order], vals[order])

    def _build(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Open-addressing hash table with linear probing, filled in vectorised rounds."""
        self.bits = int(np.ceil(np.log2(max(16, len(keys) * 4))))
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_val = np.full(size, NO_RANK, np.int64)
        left, at, self.probes = np.arange(len(keys)), self._hash(keys), 1
        while len(left):
            free = self.slot_key[at] == -1
            _, first = np.unique(at[free], return_index=True)
            win = np.flatnonzero(free)[first]
            self.slot_key[at[win]], self.slot_val[at[win]] = keys[left[win]], vals[left[win]]
            stay = np.ones(len(left), bool)
            stay[win] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)
            self.probes += 1

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = (a << 20) | b
        keys = np.where((a < 0) | (b < 0), np.int64(-2), keys)
        at = self._hash(keys)
        out = np.full(keys.shape, NO_RANK, np.int64)
        live = keys >= 0
        for _ in range(self.probes):
            k = self.slot_key[at]
            hit = live & (k == keys)
            out[hit] = self.slot_val[at[hit]]
            live &= ~hit & (k != -1)
            if not live.any():
                break
            at = (at + 1) & ((1 << self.bits) - 1)
        return out


def encode_pieces(pieces: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Token ids of every piece (a non-empty byte string)."""
    out: list[np.ndarray | None] = [None] * len(pieces)
    size = np.array([len(p) for p in pieces], np.int64)
    bucket = 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    for width in np.unique(bucket):
        members = np.flatnonzero(bucket == width)
        for part in np.array_split(members, max(1, len(members) * int(width) // 2_000_000)):
            for i, ids in zip(part, _encode_matrix([pieces[i] for i in part], int(width), vocab)):
                out[i] = ids
    return out


def _encode_matrix(pieces: list[bytes], width: int, vocab: Vocabulary) -> list[np.ndarray]:
    n = len(pieces)
    lens = np.array([len(p) for p in pieces], np.int64)
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    m = np.full((n, width), -1, np.int64)
    m[np.arange(width)[None, :] < lens[:, None]] = vocab.byte_id[flat]
    out: list[np.ndarray | None] = [None] * n
    rows = np.arange(n)
    # rank[i, j] is that of the pair (j, j + 1); the last column has no pair
    rank = np.full((n, width), NO_RANK)
    if width > 1:
        rank[:, :-1] = vocab.pair_rank(m[:, :-1], m[:, 1:])
    while len(rows):
        w = m.shape[1]
        best = rank.min(axis=1)
        done = best == NO_RANK
        if done.any():
            for i, r, k in zip(rows[done], m[done], lens[done]):
                out[i] = r[:k].copy()
            m, lens, rows, rank, best = m[~done], lens[~done], rows[~done], rank[~done], best[~done]
            if not len(rows):
                break
        take = rank == best[:, None]
        # of occurrences that overlap every second one counts, from the left of each chain
        if (take[:, 1:] & take[:, :-1]).any():
            col = np.arange(w)[None, :]
            before = np.maximum.accumulate(np.where(take, -1, col), axis=1)
            take &= (col - before) % 2 == 1
        keep = np.ones(m.shape, bool)
        keep[:, 1:] = ~take[:, :-1]
        m = np.where(take, best[:, None], m)
        gone = take.sum(axis=1)
        lens, left = lens - gone, w - gone
        to = min(int(left.max()), int(lens.max()))
        m, rank, fresh = (_compact(x, keep, left, to, e) for x, e in ((m, -1), (rank, NO_RANK), (take, False)))
        # the pairs that begin or end with a merged token
        fresh[:, :-1] |= fresh[:, 1:]
        r, c = np.nonzero(fresh)
        inner = c < to - 1
        rank[r[~inner], c[~inner]] = NO_RANK
        r, c = r[inner], c[inner]
        rank[r, c] = vocab.pair_rank(m[r, c], m[r, c + 1])
    return out


def _compact(x: np.ndarray, keep: np.ndarray, left: np.ndarray, to: int, empty) -> np.ndarray:
    """The kept places of every row (``left`` of them) moved together, in ``to`` columns; what is cut off is padding."""
    width = int(left.max())
    if int(left.min()) == width:
        return np.ascontiguousarray(x[keep].reshape(len(x), width)[:, :to])
    out = np.full((len(x), width), empty, x.dtype)
    out[np.arange(width)[None, :] < left[:, None]] = x[keep]
    return np.ascontiguousarray(out[:, :to])


_VOCABS: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABS:
        _VOCABS[path] = Vocabulary(path)
    return _VOCABS[path]


class Encoder:
    """Encodes lists of texts; keeps the ids of pieces it has seen, up to CACHE_PIECES."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.vocab, self.pattern = vocabulary(path), regex.compile(pattern)
        self.number: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece number of every piece of all texts, pieces per text); new pieces are encoded on the way."""
        if len(self.number) > CACHE_PIECES:
            self.number = {}
            self.starts, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        known, fresh, where, count = self.number, [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found = self.pattern.findall(t)
            count[i] = len(found)
            for p in found:
                k = known.get(p)
                if k is None:
                    k = known[p] = len(known)
                    fresh.append(p)
                where.append(k)
        if fresh:
            ids = encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh], self.vocab)
            self.starts = np.r_[self.starts, self.starts[-1] + np.cumsum([len(x) for x in ids])]
            self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        return np.array(where, np.int64), count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.encode_flat(texts)
        return np.split(flat, ends[:-1]) if len(texts) else []

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, where each text ends)."""
        where, count = self.numbers(texts)
        size = (self.starts[1:] - self.starts[:-1])[where] if len(where) else np.zeros(0, np.int64)
        total = int(size.sum())
        begin = np.repeat(self.starts[where] - np.r_[0, np.cumsum(size)[:-1]], size) if total else np.zeros(0, np.int64)
        flat = self.flat[begin + np.arange(total)] if total else np.zeros(0, np.int32)
        piece_end = np.r_[0, np.cumsum(size)]
        return flat, piece_end[np.cumsum(count)]

    def lengths(self, texts: list[str]) -> np.ndarray:
        where, count = self.numbers(texts)
        size = (self.starts[1:] - self.starts[:-1])[where] if len(where) else np.zeros(0, np.int64)
        return np.diff(np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(count)]])


def _chunks(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` characters, so that very long texts do not pile up in memory."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if texts:
        yield start, len(texts)


def _narrow(df: DataFrame, key: str, text: str, path: str | None, pattern: str, result: str, build) -> DataFrame:
    path = path or os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    # the file goes along with the job; a worker that has it under the same path need not fetch it
    df.sparkSession.sparkContext.addFile(path)
    kind = df.schema[key].dataType.simpleString()
    name, sql_type = result.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), pattern)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), build(enc, texts[lo:hi])], names=["k", name])

    slim = spread(df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")))
    return slim.mapInArrow(run, f"k {kind}, {name} {sql_type}").withColumnRenamed("k", key)


def encode_corpus(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``(key, ids)`` of every row: the ids of the whole ``text`` without special tokens.

    Null and empty texts give an empty list, blank texts the ids of their blanks. Rows that repeat are encoded like
    any other; a null key is kept; extra columns are not read. One narrow stage; only a scan with fewer partitions than
    twice the cores is spread first.
    """

    def build(enc: Encoder, texts: list[str]) -> pa.Array:
        flat, ends = enc.encode_flat(texts)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(flat, pa.int32()))

    return _narrow(df, key, text, path, pattern, "ids array<int>", build)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``(key, n_tokens)`` of every row, as :func:`encode_corpus` would give, without building the id lists."""
    return _narrow(df, key, text, path, pattern, "n_tokens bigint", lambda enc, texts: pa.array(enc.lengths(texts), pa.int64()))
