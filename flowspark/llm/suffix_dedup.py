"""Removal of byte strings that occur more than once, by merging Burrows-Wheeler transforms.

Every string of `size` bytes has an anchor: the place of its least-hashed gram of GRAM bytes. Equal strings have equal
anchors at equal offsets, so only strings with the same anchor need comparing, and an anchor that occurs once in the
corpus rules out all its strings. The bytes around the occurrences of a repeated anchor, as far as its strings reach,
are its contexts; equal contexts are one, with a weight.

The contexts of some anchors are the text of one task. They are cut into shards, each shard gets its Burrows-Wheeler
transform over symbols of SYMBOL bytes, and the transforms are merged by refining their interleave: round h sorts the
merged order stably by the next symbol to the left, after which all suffixes stand ordered by their first h symbols,
and marks where neighbours' common prefix ends. After size / SYMBOL rounds (or when nothing changes) the intervals
without a mark inside are the repeated strings: those whose weights exceed one. No suffix is sorted anew across shards.

Anchors with very many different contexts are spread by the strings themselves, so that no task holds such a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import row_key, text_of, utf8, with_columns
from flowspark.llm.textops import BYTE_CODES, OTHER_CODES, mix, power_tables, ranges, span_hashes, spans_where
from flowspark.session import materialize

SIZE = 200
GRAM = 64
SYMBOL = 8
FILTER_BITS = 27
FILTER_PARTS = 64
SHARD_BYTES = 64 << 10
TASK_BYTES = 512 << 10
CROWDED = 4_000
CONTEXT_SLICE = 4 << 20  # a context's bytes go along once a slice

LONG = T.LongType()
ANCHOR_FIELDS = T.StructType([T.StructField("anchors", T.ArrayType(LONG))])
CONTEXT_FIELDS = T.StructType([T.StructField("contexts", T.ArrayType(T.StructType([
    T.StructField("anchor", LONG), T.StructField("context", LONG), T.StructField("at", LONG), T.StructField("strings", LONG),
    T.StructField("bytes", T.BinaryType())])))])
RUNS = T.ArrayType(T.StructType([T.StructField("first", LONG), T.StructField("count", LONG)]))
FOUND_SCHEMA = T.StructType([T.StructField("anchor", LONG), T.StructField("context", LONG), T.StructField("runs", RUNS)])
CUT_FIELDS = T.StructType([*[T.StructField(n, LONG) for n in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("removed", RUNS), T.StructField("kept", T.BinaryType())])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbouring values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(values)] = values
    table = full.reshape(blocks, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1: width - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, size: int):
    """Anchors in order: hash of the gram, first string it serves and how many follow (places in `data`), text."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none.astype(np.uint64), none, none, none
    gram = min(GRAM, size)
    power, inverse = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * power[: len(data)], out=sums[1:])
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_least(packed, size - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(0, np.diff(offsets) - size + 1)
    starts = ranges(offsets[:-1], counts)
    places = least[starts]
    rows = np.repeat(np.arange(len(counts)), counts)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    first = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]) | (rows[1:] != rows[:-1])])
    return grams[places[first]], starts[first], np.diff(np.r_[first, len(starts)]), rows[first]


def repeated_anchor_filter(docs: DataFrame, size: int) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS bits (16 MB) with the hashes of anchors that occur more than once."""

    def compute(batch):
        data, offsets = utf8(text_of(batch))
        hashes, _, _, rows = anchors_of(data, offsets, size)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes.view(np.int64)))]

    hashes = with_columns(docs.select("text"), ANCHOR_FIELDS, compute).select(F.explode("anchors").alias("anchor"))
    repeated = hashes.groupBy("anchor").count().where("count > 1").withColumn(
        "part", F.pmod(F.col("anchor"), F.lit(FILTER_PARTS)).cast("int"))
    width = (1 << FILTER_BITS) // FILTER_PARTS

    def bits(table: pa.Table) -> pa.Table:
        marks = np.zeros(width, bool)
        marks[filter_place(np.asarray(table.column("anchor")).view(np.uint64))[1]] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    out = np.zeros((FILTER_PARTS, width // 8), np.uint8)
    for row in repeated.select("part", "anchor").groupBy("part").applyInArrow(bits, "part int, bits binary").collect():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def filter_place(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part and bit of each hash."""
    width = (1 << FILTER_BITS) // FILTER_PARTS
    part = hashes.view(np.int64) % FILTER_PARTS
    return part, ((mix(hashes)) >> np.uint64(40)).astype(np.int64) % width


def contexts_of(docs: DataFrame, size: int) -> DataFrame:
    """Occurrences of repeated anchors: anchor, context (hash of its bytes), row_key, at (first string, from the text's
    begin), strings, and the bytes (null where the same slice has given them before)."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchor_filter(docs, size))

    def compute(batch):
        data, offsets = utf8(text_of(batch))
        hashes, starts, counts, rows = anchors_of(data, offsets, size)
        part, bit = filter_place(hashes)
        passed = (shared.value[part, bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
        hashes, starts, counts, rows = hashes[passed], starts[passed], counts[passed], rows[passed]
        ends = starts + counts + size - 1
        ids = span_hashes(data, starts, ends, OTHER_CODES)
        order = np.lexsort((ids, hashes))
        new = np.ones(len(ids), bool)
        new[order[1:]] = (ids[order][1:] != ids[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
        values = pa.StructArray.from_arrays([
            pa.array(hashes.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(starts - offsets[rows]), pa.array(counts),
            pa.array([data[a:b].tobytes() if n else None for a, b, n in zip(starts, ends, new)], pa.binary())],
            names=["anchor", "context", "at", "strings", "bytes"])
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(bounds), values)]

    keyed = docs.select(row_key("doc_id", "text").alias("row_key"), "text")
    rows = with_columns(keyed, CONTEXT_FIELDS, compute, limit=CONTEXT_SLICE).select("row_key", F.inline("contexts"))
    return materialize(rows, "contexts", "zstd")


def stable_order(values: np.ndarray) -> np.ndarray:
    """Stable sort order of small unsigned ints, by radix passes."""
    order = np.argsort(values.astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Collection:
    """Contexts as circular texts of SYMBOL-byte symbols, each with an end mark for every residue of places.

    Place j of a context of m bytes (0 <= j <= m) has the symbol of bytes j to j + SYMBOL, or the end mark where these
    are not there; it is followed by place j + SYMBOL, an end mark by the first place of its residue.
    """

    def __init__(self, contexts: list[bytes]):
        sizes = np.array([len(c) for c in contexts], np.int64)
        self.firsts = np.cumsum(sizes + 1) - sizes - 1
        owner = np.repeat(np.arange(len(contexts)), sizes + 1)
        place = np.arange(len(owner)) - self.firsts[owner]
        data = np.zeros(len(owner) + SYMBOL, np.uint8)
        data[np.flatnonzero(place < sizes[owner])] = np.frombuffer(b"".join(contexts), np.uint8)
        words = np.zeros(len(owner), np.uint64)
        for k in range(SYMBOL):
            words = words << np.uint64(8) | data[k: k + len(owner)]
        ended = place > sizes[owner] - SYMBOL
        distinct, ranks = np.unique(words[~ended], return_inverse=True)
        self.symbols = np.zeros(len(owner), np.uint32)
        self.symbols[~ended] = ranks + 1
        follows = np.arange(len(owner)) + SYMBOL
        follows[ended] = self.firsts[owner[ended]] + place[ended] % SYMBOL
        self.follows, self.owner, self.place = follows, owner, place
        self.before = np.empty_like(follows)
        self.before[follows] = np.arange(len(follows))

    def shard_order(self, a: int, b: int, depth: int) -> np.ndarray:
        """Places a to b (whole contexts) sorted by at least `depth` symbols, by prefix doubling."""
        ranks = self.symbols[a:b].astype(np.int64)
        jump = self.follows[a:b] - a
        have = 1
        while have < depth:
            _, ranks = np.unique(ranks * (len(ranks) + int(self.symbols.max()) + 2) + ranks[jump], return_inverse=True)
            jump, have = jump[jump], 2 * have
        return np.argsort(ranks, kind="stable") + a

    def merge(self, depth: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their first `depth` symbols, and the interval of equal ones that each lies in."""
        cuts = [0]
        for first in self.firsts[1:]:
            if first - cuts[-1] >= shard_bytes:
                cuts.append(int(first))
        cuts.append(len(self.symbols))
        orders = [self.shard_order(a, b, depth) for a, b in zip(cuts[:-1], cuts[1:])]
        placed = np.concatenate(orders)
        transform = self.symbols[self.before[placed]]  # the shards' transforms, end to end
        interleave = np.repeat(np.arange(len(orders), dtype=np.uint32), np.diff(cuts))
        interval, count = np.zeros(len(placed), np.int64), 1
        for _ in range(depth):
            symbols = np.empty_like(transform)
            symbols[stable_order(interleave)] = transform
            order = stable_order(symbols)
            interleave, symbols, was = interleave[order], symbols[order], interval[order]
            interval = np.cumsum(np.r_[False, (symbols[1:] != symbols[:-1]) | (was[1:] != was[:-1])])
            if interval[-1] + 1 == count:
                break
            count = interval[-1] + 1
        merged = np.empty_like(placed)
        merged[stable_order(interleave)] = placed
        return merged, interval


def repeated_strings(contexts: list[bytes], weights: np.ndarray, size: int, shard_bytes: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each context, which of its strings of `size` bytes (a multiple of SYMBOL) occur more than once, by weight."""
    collection = Collection(contexts)
    merged, interval = collection.merge(size // SYMBOL, shard_bytes)
    sizes = np.array([len(c) for c in contexts])
    owner, place = collection.owner[merged], collection.place[merged]
    is_string = place + size <= sizes[owner]
    total = np.bincount(interval[is_string], weights=weights[owner[is_string]], minlength=interval[-1] + 1)
    out = [np.zeros(n - size + 1, bool) for n in sizes]
    flat = np.zeros(int((sizes - size + 1).sum()), bool)
    firsts = np.cumsum(sizes - size + 1) - (sizes - size + 1)
    flat[firsts[owner[is_string]] + place[is_string]] = total[interval[is_string]] > 1
    for k, (a, n) in enumerate(zip(firsts, sizes - size + 1)):
        out[k] = flat[a: a + n]
    return out


def runs_array(masks: list[np.ndarray]) -> pa.ListArray:
    """Runs of True in each mask, as lists of (first, count); of whole numbers even where there is no mask."""
    bounds = np.r_[0, np.cumsum([len(m) for m in masks], dtype=np.int64)]
    starts, ends, rows = spans_where(np.concatenate(masks) if masks else np.zeros(0, bool), bounds)
    values = pa.StructArray.from_arrays([pa.array(starts - bounds[rows]), pa.array(ends - starts)], names=["first", "count"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(masks) + 1)).astype(np.int32)), values)


def compare_contexts(size: int):
    """Over a partition sorted by anchor (anchor, context, bytes, weight): the repeated strings of each context."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        anchors, weights = np.asarray(table.column(0)), np.asarray(table.column(3)).astype(np.float64)
        contexts = table.column(2).to_pylist()
        alone = np.r_[True, anchors[1:] != anchors[:-1]] & np.r_[anchors[1:] != anchors[:-1], True]
        # strings of one context have their anchor at different offsets and so differ: alone, only its weight counts
        several = np.flatnonzero(~alone)
        masks = [np.full(len(c) - size + 1, w > 1) for c, w in zip(contexts, weights)]
        if len(several):
            for k, mask in zip(several, repeated_strings([contexts[k] for k in several], weights[several], size)):
                masks[k] = mask
        some = np.flatnonzero([m.any() for m in masks])
        keys = [table.column(k).take(pa.array(some)).combine_chunks() for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*keys, runs_array([masks[k] for k in some])], names=FOUND_SCHEMA.names)

    def run(batches):
        held, held_bytes = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            held_bytes += pc.sum(pc.binary_length(batch.column(2))).as_py()
            if held_bytes >= TASK_BYTES:
                table = pa.concat_tables(held)
                anchors = np.asarray(table.column(0))
                cuts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
                sizes = np.r_[0, np.cumsum(np.asarray(pc.binary_length(table.column(2))))]
                start = 0
                for cut in cuts[1:]:
                    if sizes[cut] - sizes[start] >= TASK_BYTES:
                        yield solve(table.slice(start, cut - start))
                        start = int(cut)
                if cuts[-1] > start and sizes[cuts[-1]] - sizes[start] >= TASK_BYTES // 2:
                    yield solve(table.slice(start, cuts[-1] - start))
                    start = int(cuts[-1])
                rest = table.slice(start).combine_chunks()
                held, held_bytes = [rest], int(sizes[-1] - sizes[start])
        if held:
            yield solve(pa.concat_tables(held))

    return run


def spread_strings(contexts: DataFrame, size: int) -> DataFrame:
    """Repeated strings of contexts by counting every string's 128-bit hash: the same as comparing, one row a string."""
    fields = T.StructType([T.StructField("hashes", T.ArrayType(T.StructType([T.StructField("a", LONG), T.StructField("b", LONG)])))])

    def compute(batch):
        column = batch.column(batch.schema.get_field_index("bytes"))
        contexts = column.to_pylist()
        sizes = np.array([len(c) for c in contexts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        starts = ranges(firsts, sizes - size + 1)
        data = np.frombuffer(b"".join(contexts), np.uint8)
        values = pa.StructArray.from_arrays([pa.array(span_hashes(data, starts, starts + size, codes).view(np.int64))
                                             for codes in (BYTE_CODES, OTHER_CODES)], names=["a", "b"])
        return [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes - size + 1)].astype(np.int32)), values)]

    strings = with_columns(contexts, fields, compute, column="bytes").select(
        "anchor", "context", "weight", F.posexplode("hashes").alias("first", "h")).select("anchor", "context", "weight", "first", "h.*")
    repeated = strings.groupBy("a", "b").agg(F.sum("weight").alias("total")).where("total > 1")
    found = strings.join(repeated, ["a", "b"]).select("anchor", "context", F.struct(
        F.col("first").cast("long").alias("first"), F.lit(1).cast("long").alias("count")).alias("run"))
    return found.groupBy("anchor", "context").agg(F.collect_list("run").alias("runs"))


def repeated_runs(docs: DataFrame, size: int) -> DataFrame:
    """For each row_key the runs of strings that occur elsewhere: lists of (first, count)."""
    occurrences = contexts_of(docs, size)
    contexts = materialize(occurrences.groupBy("anchor", "context").agg(
        F.count("*").alias("weight"), F.first("bytes", ignorenulls=True).alias("bytes")), "weighted", "zstd")
    crowded = contexts.groupBy("anchor").count().where(f"count > {CROWDED}").select("anchor")
    crowded = materialize(crowded, "crowded")
    if crowded.isEmpty():
        usual, busy = contexts, None
    else:
        usual = contexts.join(crowded, "anchor", "left_anti")
        busy = contexts.join(crowded, "anchor", "left_semi")
    cut = usual.select("anchor", "context", "bytes", "weight").repartition("anchor").sortWithinPartitions("anchor", "context")
    found = cut.mapInArrow(compare_contexts(size), FOUND_SCHEMA)
    if busy is not None:
        found = found.unionByName(spread_strings(busy, size))
    placed = occurrences.select("anchor", "context", "row_key", "at").join(materialize(found, "found"), ["anchor", "context"])
    shifted = F.transform("runs", lambda r: F.struct((r["first"] + F.col("at")).alias("first"), r["count"].alias("count")))
    return placed.select("row_key", shifted.alias("runs")).groupBy("row_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Remove from every text each byte that a string of `size` bytes covers which also starts anywhere else.

    Texts are UTF-8 bytes and matches never cross texts; strings are judged on the input. Adds n_bytes, n_removed,
    n_spans (maximal removed runs), removed (these runs, as byte ranges) and kept (the remaining bytes). A null text
    counts as empty. Rows are documents of their own, so repeated rows remove each other. All rows and other columns
    are kept, columns of these names replaced. `size` must be a multiple of SYMBOL, at least GRAM.
    """
    if size % SYMBOL or size < GRAM:
        raise ValueError(f"size must be a multiple of {SYMBOL} and at least {GRAM}")
    marks = repeated_runs(docs, size).withColumnsRenamed({"row_key": "_mark_key", "runs": "_runs"})
    joined = docs.withColumn("_row_key", row_key("doc_id", "text")).join(
        marks, F.col("_row_key") == F.col("_mark_key"), "left").drop("_row_key", "_mark_key")

    def compute(batch):
        data, offsets = utf8(text_of(batch))
        column = batch.column(batch.schema.get_field_index("_runs"))
        counts = column.value_lengths().fill_null(0).to_numpy(False)
        owner, flat = np.repeat(np.arange(batch.num_rows), counts), column.flatten()
        first = offsets[owner] + flat.field("first").to_numpy(False)
        steps = np.zeros(len(data) + 1, np.int64)
        np.add.at(steps, first, 1)
        np.add.at(steps, first + flat.field("count").to_numpy(False) + size - 1, -1)
        gone = np.cumsum(steps[:-1]) > 0
        starts, ends, rows = spans_where(gone, offsets)
        removed = np.bincount(rows, weights=ends - starts, minlength=batch.num_rows).astype(np.int64)
        kept = np.r_[0, np.cumsum(~gone)][offsets].astype(np.int32)
        spans = pa.StructArray.from_arrays([pa.array(starts - offsets[rows]), pa.array(ends - starts)], names=["first", "count"])
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        return [pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(bounds).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(bounds), spans),
                pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(kept), pa.py_buffer(data[~gone])])]

    return with_columns(joined, CUT_FIELDS, compute).drop("_runs")
