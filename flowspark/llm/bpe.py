"""Byte-level BPE encoding and decoding by a public table of ranks.

Texts are cut by the table's pattern. The distinct pieces of a slice are laid into padded matrices, one for each range
of lengths; every round, each row merges its leftmost pair of least rank, found through a hash table of pairs, and rows
without a pair that merges leave the matrix. Pieces longer than LONG bytes merge through a heap, which gives the same
ids without rounds as long as the piece.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from flowspark.llm.common import as_list, text_of, with_columns
from flowspark.llm.textops import ranges

NONE = np.int32(2**31 - 1)
LONG = 256
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128, LONG)
CACHED_PIECES = 100_000
SLICE_BYTES = 1 << 20  # texts become many small strings here


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of rank, from lines of base64 token and rank."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens = [b""] * (max(int(rank) for _, rank in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PairTable:
    """Open hash table from a pair of token ids to the rank of their concatenation."""

    def __init__(self, tokens: list[bytes]):
        self.rank_of = {token: rank for rank, token in enumerate(tokens) if token}
        pairs = [(self.rank_of[token[:k]], self.rank_of[token[k:]], rank) for rank, token in enumerate(tokens)
                 for k in range(1, len(token)) if token[:k] in self.rank_of and token[k:] in self.rank_of]
        table = np.array(pairs, np.int64).reshape(-1, 3)
        self.bits = max(4, int(4 * len(table)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, ranks = table[:, 0] << 32 | table[:, 1], table[:, 2].astype(np.int32)
        slots, self.probes = self.slot(keys), 0
        while len(keys):  # each round, one of the keys that want a free slot gets it
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            placed = self.keys[slots] == keys
            self.ranks[slots[placed]] = ranks[placed]
            keys, ranks, slots = keys[~placed], ranks[~placed], (slots[~placed] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair doesn't merge or an id is negative (padding)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        slots = self.slot(keys)
        found, open_ = np.full(keys.shape, NONE, np.int32), np.flatnonzero((left >= 0) & (right >= 0))
        keys, slots = keys[open_], slots[open_]
        for _ in range(self.probes):
            held = self.keys[slots]
            hit = held == keys
            found[open_[hit]] = self.ranks[slots[hit]]
            more = ~hit & (held != -1)
            if not more.any():
                break
            open_, keys, slots = open_[more], keys[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return found


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.pairs = PairTable(tokens)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.pairs.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.cache: dict[str, np.ndarray] = {}

    def merge_matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of pieces of at most `width` bytes."""
        lengths = np.array([len(p) for p in pieces])
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        out: list = [None] * len(pieces)
        own = np.arange(len(pieces))
        ranks = self.pairs.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        columns = np.arange(width)
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(at)), at]
            ended = best == NONE
            if ended.any():
                for row, n in zip(np.flatnonzero(ended), (ids[ended] >= 0).sum(axis=1)):
                    out[own[row]] = ids[row, :n].copy()
                ids, ranks, own, at, best = ids[~ended], ranks[~ended], own[~ended], at[~ended], best[~ended]
                if not len(own):
                    return out
                most = int((ids >= 0).sum(axis=1).max())
                ids, ranks, columns = ids[:, :most], ranks[:, : most - 1], columns[:most]
            rows, last = np.arange(len(own)), ids.shape[1] - 1
            take = np.minimum(columns + (columns > at[:, None]), last)
            beyond = columns[None, :] + (columns > at[:, None]) > last
            ids = np.take_along_axis(ids, take, 1)
            ids[beyond] = -1
            ids[rows, at] = best
            if ranks.shape[1] == 1:
                ranks[:] = NONE
                continue
            inner = np.minimum(take[:, :-1], last - 1)
            ranks = np.take_along_axis(ranks, inner, 1)
            ranks[columns[:-1] + (columns[:-1] > at[:, None]) > last - 1] = NONE
            ends = np.minimum(at + 1, last)
            right = self.pairs.lookup(best, np.where(at < last, ids[rows, ends], -1))
            fits = at < last
            ranks[rows[fits], at[fits]] = right[fits]
            fits = at > 0
            ranks[rows[fits], at[fits] - 1] = self.pairs.lookup(ids[rows[fits], at[fits] - 1], best[fits])

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one long piece, by a heap of its pairs."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, rank_of, tokens = len(ids), self.pairs.rank_of, [piece[k: k + 1] for k in range(len(piece))]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, 1, 1) for k in range(n - 1) if (r := rank_of.get(tokens[k] + tokens[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, size, size_next = heapq.heappop(heap)
            m = after[k]
            if tokens[k] is None or m >= n or len(tokens[k]) != size or len(tokens[m]) != size_next:
                continue
            tokens[k] += tokens[m]
            tokens[m], ids[k] = None, rank
            after[k] = after[m]
            if after[m] < n:
                before[after[m]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < n and (r := rank_of.get(tokens[a] + tokens[b])) is not None:
                    heapq.heappush(heap, (r, a, len(tokens[a]), len(tokens[b])))
        return np.array([i for i, t in zip(ids, tokens) if t is not None], np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the cache."""
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        new = [p for p in pieces if p not in self.cache]
        raw = [p.encode() for p in new]
        sizes = np.array([len(r) for r in raw])
        low = 0
        for width in WIDTHS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            step = max(1, (1 << 20) // width)
            for start in range(0, len(chosen), step):
                some = chosen[start: start + step]
                for k, ids in zip(some, self.merge_matrix([raw[k] for k in some], width)):
                    self.cache[new[k]] = ids
        for k in np.flatnonzero(sizes > LONG):
            self.cache[new[k]] = self.merge_long(raw[k])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins."""
        found = [self.pattern.findall(t) if t else [] for t in texts]
        counts = np.array([len(f) for f in found], np.int64)
        coded = pa.array([p for f in found for p in f], pa.string()).dictionary_encode()
        pieces, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        self.learn(pieces)
        lists = [self.cache[p] for p in pieces]
        sizes = np.array([len(x) for x in lists], np.int64)
        pool = np.concatenate(lists)
        lengths = sizes[which]
        ids = pool[ranges((np.cumsum(sizes) - sizes)[which], lengths)]
        ends = np.r_[0, np.cumsum(lengths)][np.cumsum(counts)]
        return ids, np.r_[0, ends]


class Decoder:
    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The bytes of each list of ids."""
        sizes = self.sizes[ids]
        ends = np.r_[0, np.cumsum(sizes)][offsets].astype(np.int32)
        data = self.pool[ranges(self.starts[ids], sizes)]
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
DECODED = T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, ranks_path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Add `ids`, the BPE ids of each whole text, each match of `pattern` merged by itself, without special tokens; with
    `decoded` also the bytes that these ids decode to, in the same pass.

    Needs text; all rows and other columns are kept, columns of these names replaced. A null or empty text has no ids.
    The table of ranks (path readable on the driver) has a fixed size and is broadcast.
    """
    tokens = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    state: list = []

    def compute(batch):
        if not state:
            state.extend([Encoder(tokens.value, pattern), Decoder(tokens.value)])
        ids, offsets = state[0].encode(text_of(batch).to_pylist())
        return [as_list(ids, offsets), *([state[1].decode(ids, offsets)] if decoded else [])]

    return with_columns(docs, T.StructType([IDS, DECODED] if decoded else [IDS]), compute, limit=SLICE_BYTES)


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """Add `decoded`, the bytes that the column `ids` stands for (null and empty lists: no bytes)."""
    tokens = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    state: list[Decoder] = []

    def compute(batch):
        if not state:
            state.append(Decoder(tokens.value))
        lists = batch.column(batch.schema.get_field_index("ids"))
        counts = lists.value_lengths().fill_null(0).to_numpy(False)
        return [state[0].decode(lists.flatten().to_numpy(False), np.r_[0, np.cumsum(counts)])]

    return with_columns(rows, T.StructType([DECODED]), compute, column="ids")
