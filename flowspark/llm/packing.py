"""Best-two-fit packing of tokenised documents into sequences of a fixed size.

How many pieces of each length there are is all that the packing needs: at most `size` counts, whatever the number of
documents. Sequences are planned over these counts one pattern at a time. A pattern is filled greedily with the longest
piece that still fits; then its smallest piece is taken out again if two unpacked pieces fit the wider gap more tightly,
and again until no two do. A pattern is repeated as often as the counts allow. Each piece then finds its sequence by its
number among the pieces of its length, which needs counts per task but no shuffle of the pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import as_list, slices, text_of
from flowspark.session import lookup_join, materialize

SIZE = 2048
LONG = T.LongType()
PIECE_FIELDS = [T.StructField(n, LONG) for n in ("piece", "start", "length", "ids_crc32")]
PLACE_FIELDS = T.StructType([T.StructField("sequence_id", LONG), T.StructField("offset", LONG)])


# ------------------------------------------------------------------------------ the plan


def _largest(counts: np.ndarray) -> np.ndarray:
    """For each x up to the size, the largest length of at most x that is left (0: none)."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def fill(counts: np.ndarray, size: int) -> list[int]:
    """Lengths of one sequence by best-two-fit, the pieces taken out of `counts`."""
    chosen: list[int] = []
    gap, largest = size, _largest(counts)
    while gap and (length := int(largest[gap])):
        times = min(gap // length, int(counts[length]))
        chosen += [length] * times
        counts[length] -= times
        gap -= length * times
        largest = _largest(counts)
    while gap and chosen:
        smallest = min(chosen)
        room = gap + smallest
        first = np.arange(1, room // 2 + 1)
        first = first[counts[first] > 0]
        second = largest[room - first]
        alone = (second == first) & (counts[first] < 2)  # the only piece of its length can't be both
        second = np.where(alone, largest[np.maximum(first - 1, 0)], second)
        total = np.where(second > 0, first + second, 0)
        if not len(total) or total.max() <= smallest:
            break
        best = int(total.argmax())
        pair = [int(first[best]), int(second[best])]
        chosen.remove(smallest)
        counts[smallest] += 1
        for length in pair:
            counts[length] -= 1
        chosen += pair
        gap = room - sum(pair)
        largest = _largest(counts)
    return chosen


def plan(pieces: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """Patterns (pieces of each length) and how many sequences follow each; together they take all pieces.

    A pattern is repeated while the counts allow it and it stays what the first filling chose, so there are at most about
    as many patterns as lengths, each exhausting one.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in pieces.items():
        counts[length] = n
    found = []
    while counts.any():
        before = counts.copy()
        lengths, times = np.unique(fill(counts, size), return_counts=True)
        repeats = int((before[lengths] // times).min())
        counts = before
        counts[lengths] -= times * repeats
        found.append((dict(zip(lengths.tolist(), times.tolist())), repeats))
    return found


class Places:
    """The plan as arrays: for each length, the piece numbers at which its patterns begin and where their pieces go."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]):
        rows, sequence = [], 0
        taken: dict[int, int] = {}
        for pattern, repeats in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                rows.append((length, taken.get(length, 0), pattern[length], sequence, offset))
                taken[length] = taken.get(length, 0) + pattern[length] * repeats
                offset += length * pattern[length]
            sequence += repeats
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.times, self.sequence, self.offset = table.T
        self.bounds = {int(n): (int(np.searchsorted(self.length, n)), int(np.searchsorted(self.length, n, "right"))) for n in taken}

    def find(self, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and number among the pieces of that length."""
        at = np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            a, b = self.bounds[length]
            own = lengths == length
            at[own] = a + np.searchsorted(self.first[a:b], numbers[own], "right") - 1
        within = numbers - self.first[at]
        return self.sequence[at] + within // self.times[at], self.offset[at] + within % self.times[at] * lengths


def numbered(pieces: DataFrame) -> DataFrame:
    """Add _part, the writing task, and _number, the piece's place among those of its length in the task; stored."""
    schema = T.StructType([*pieces.schema.fields, T.StructField("_part", LONG), T.StructField("_number", LONG)])

    def run(batches):
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_numpy(False)
            order = np.argsort(lengths, kind="stable")
            values, first, counts = np.unique(lengths[order], return_index=True, return_counts=True)
            numbers = np.empty(len(lengths), np.int64)
            numbers[order] = np.arange(len(lengths)) - np.repeat(first - [seen.get(v, 0) for v in values.tolist()], counts)
            for value, count in zip(values.tolist(), counts.tolist()):
                seen[value] = seen.get(value, 0) + count
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), part)), pa.array(numbers)], names=schema.names)

    return materialize(pieces.mapInArrow(run, schema), "pieces")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset: a place for every piece in sequences of at most `size` tokens, gapless from offset 0.

    Needs `length` (long, 1 to `size`, not null). All rows and other columns are kept, columns of the two names replaced;
    equal pieces and repeated rows each get a place of their own; without rows there are none. The driver sees one count
    for each length and broadcasts a plan of about as many patterns.
    """
    names = {f.name for f in PLACE_FIELDS} | {"_part", "_number", "_before"}
    kept = pieces.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in names])
    placed = numbered(kept)
    held = materialize(placed.groupBy("length", "_part").agg(F.count("*").alias("_n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    if any(n is None or n < 1 or n > size for n in totals):
        raise ValueError(f"pieces of 1 to {size} tokens only")
    # a length and a task have one row, so what joins to it is bounded by a task's pieces
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(totals, size)))

    def run(batches):
        for batch in batches:
            column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("length", "_number", "_before")}
            lengths, number, start = (c.to_numpy(False) for c in column.values())
            sequence, offset = places.value.find(lengths, number + start)
            own = [batch.column(k) for k, n in enumerate(batch.schema.names) if n not in column or n == "length"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=schema.names)

    schema = T.StructType([*kept.schema.fields, *PLACE_FIELDS.fields])
    return lookup_join(placed, starts, ["length", "_part"]).drop("_part").mapInArrow(run, schema)


# --------------------------------------------------------------------------- tokenising


class Tokenizer:
    """Ids by a byte-level BPE file of the tokenizers library, its special tokens recognised in texts as that library does.

    The file's vocabulary, whose ids are the ranks of its merges, runs in tiktoken's encoder, which gives the same ids in a
    third of the time; texts whose runs of white space are too long for its pattern go through the library itself.
    """

    def __init__(self, content: str, pattern: str):
        found = json.loads(content)
        vocabulary, special = found["model"]["vocab"], {t["content"]: t["id"] for t in found["added_tokens"] if t["special"]}
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in visible]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if token not in special}
        merged = [vocabulary[(m if isinstance(m, str) else " ".join(m)).replace(" ", "")] for m in found["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of the vocabulary do not follow the order of its merges")
        self.special, self.whole = set(special), tokenizers.Tokenizer.from_str(content)
        self.coder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.array(self.coder.encode(text, allowed_special=self.special, disallowed_special=()), np.uint32)
        except ValueError:  # the pattern gave up
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def cut_documents(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SIZE, end_id: int = 0, ids: bool = True) -> DataFrame:
    """The pieces of each document: its text's ids and then `end_id`, cut into pieces of `size` ids if there are more.

    Adds piece (from 0), start (ids before it), length, ids_crc32 (of the ids as unsigned little-endian 32-bit numbers)
    and, with `ids`, ids; the text goes. Only the first piece may be shorter than `size` where a document is cut. A null or
    empty text is the end id alone, so every row has a piece; repeated rows have theirs each. Other columns are kept, those of
    these names replaced. The tokenizer's file (readable on the driver) has a fixed size and is broadcast.
    """
    fields = [*PIECE_FIELDS, *([T.StructField("ids", T.ArrayType(T.LongType()))] if ids else [])]
    names = {f.name for f in fields} | {"text"}
    kept = [c for c in docs.columns if c.lower() not in names]
    with open(tokenizer_path, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(*[F.col(f"`{c}`") for c in kept], "text")
    schema = T.StructType([*source.schema.fields[:-1], *fields])

    def run(batches):
        coder = None
        for batch in batches:
            for part in slices(batch, "text"):
                coder = coder or Tokenizer(content.value, pattern)
                rows, pieces, own = [], [], []
                for row, text in enumerate(text_of(part).to_pylist()):
                    coded = np.append(coder.encode(text or ""), np.uint32(end_id))
                    first = (len(coded) - 1) % size + 1
                    cuts = [0, *range(first, len(coded) + 1, size)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        pieces.append((k, a, b - a, zlib.crc32(coded[a:b].astype("<u4").tobytes())))
                        own.append(coded[a:b])
                table = np.array(pieces, np.int64).reshape(-1, 4)
                columns = [part.column(k).take(pa.array(rows, pa.int64())) for k in range(len(kept))]
                columns += [pa.array(table[:, k]) for k in range(4)]
                if ids:
                    columns.append(as_list(np.concatenate(own).astype(np.int64), np.r_[0, np.cumsum(table[:, 2])]))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Training sequences: sequence_id, ids (at most `size`) and doc_ids with the offset of each, from whole documents."""
    pieces = pack(cut_documents(docs, tokenizer_path, pattern, size, end_id), size)
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))  # at most `size` ids
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("documents"))
