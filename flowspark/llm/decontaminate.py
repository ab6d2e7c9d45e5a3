"""Benchmark decontamination: a broadcast set of normalised test windows against every window of the corpus.

Test items are cut into windows of 13 words (an item of fewer words is one window). Their hashes go to the executors in
blocks of bounded size, one pass over the corpus per block; each pass hashes all windows of a slice of documents at
once, looks them up, and confirms every hit on its words. With one block nothing is shuffled. With several, a block's
hits are stored and the block is released before the next one is collected; the last pass adds the stored hits.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import row_key, text_of, utf8, with_columns
from flowspark.llm.textops import ALPHANUMERIC, LOWER, covered, span_hashes, spans_where, window_hashes
from flowspark.session import lookup_join, materialize

WINDOW = 13
BLOCK_WINDOWS = 100_000
TABLE_BITS = 22

ITEM_FIELDS = T.StructType([T.StructField("windows", T.ArrayType(T.BinaryType()))])
HIT_FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(batch: pa.RecordBatch):
    """Lower-cased bytes of a slice and its words: starts, ends, text of each."""
    data, offsets = utf8(text_of(batch))
    data = LOWER[data]
    return data, *spans_where(ALPHANUMERIC[data], offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[a:b].tobytes() for a, b in zip(starts, ends))


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window of the test items: window (words joined by a space), ids (sorted, distinct)."""

    def compute(batch):
        data, starts, ends, rows = words_of(batch)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        found = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            firsts = range(a, max(a + 1, b - size + 1)) if b > a else ()
            found.append([joined(data, starts[k: min(k + size, b)], ends[k: min(k + size, b)]) for k in firsts])
        return [pa.array(found, pa.list_(pa.binary()))]

    rows = with_columns(items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"),
                        ITEM_FIELDS, compute)
    return rows.select("item_id", F.explode("windows").alias("window")).groupBy("window").agg(
        F.sort_array(F.collect_set("item_id")).alias("ids"))


def scan(docs: DataFrame, shared: Broadcast, first: bool) -> DataFrame:
    """Add HIT_FIELDS by one broadcast block of windows; unless it is the first, with the hits in _spans and _items."""
    def prepare():
        windows = shared.value
        by_length: dict[int, list[np.uint64]] = {}
        for window in windows:
            data = np.frombuffer(window, np.uint8)
            starts, ends, rows = spans_where(ALPHANUMERIC[data], np.array([0, len(data)]))
            by_length.setdefault(len(starts), []).append(window_hashes(span_hashes(data, starts, ends), rows, len(starts))[0][0])
        tables = {}
        for length, hashes in by_length.items():
            hashes = np.unique(np.array(hashes, np.uint64))
            marks = np.zeros(1 << TABLE_BITS, bool)
            marks[hashes >> np.uint64(64 - TABLE_BITS)] = True
            tables[length] = marks, hashes
        return windows, tables

    state: list = []

    def compute(batch):
        if not state:
            state.extend(prepare())
        windows, tables = state
        data, starts, ends, rows = words_of(batch)
        n = batch.num_rows
        hashes = span_hashes(data, starts, ends)
        firsts, lengths, ids = [], [], [set() for _ in range(n)]
        for length, (marks, known) in tables.items():
            found, at = window_hashes(hashes, rows, length)
            near = np.flatnonzero(marks[found >> np.uint64(64 - TABLE_BITS)])
            for k in at[near[np.isin(found[near], known)]]:
                items = windows.get(joined(data, starts[k: k + length], ends[k: k + length]))
                if items is not None:
                    firsts.append(k)
                    lengths.append(length)
                    ids[rows[k]].update(items)
        if not first:
            earlier, bounds = batch.column(batch.schema.get_field_index("_spans")).to_pylist(), np.searchsorted(rows, np.arange(n))
            for k, (spans, items) in enumerate(zip(earlier, batch.column(batch.schema.get_field_index("_items")).to_pylist())):
                ids[k].update(items or ())
                for a, b in spans or ():
                    firsts.append(bounds[k] + a)
                    lengths.append(b - a)
        hit = covered(np.array(firsts, np.int64), np.array(lengths, np.int64), len(starts))
        bounds = np.searchsorted(rows, np.arange(n + 1))
        runs = spans_where(hit, bounds)
        spans: list[list] = [[] for _ in range(n)]
        for a, b, row in zip(*runs):
            spans[row].append([int(a - bounds[row]), int(b - bounds[row])])
        counts = np.add.reduceat(np.r_[hit, False].astype(np.int64), bounds[:-1]) * (np.diff(bounds) > 0)
        return [pa.array(np.diff(bounds)), pa.array(counts), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(x) for x in ids], pa.list_(pa.string()))]

    return with_columns(docs, HIT_FIELDS, compute)


def find_overlap(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Add to every document n_words, n_hit, hit_spans (word ranges [from, to) that windows of test items cover) and
    items (ids, as text, of items with a window in the document, sorted).

    Needs text in `docs`, item_id and text in `items`; all rows and other columns of `docs` are kept, columns of the
    four names replaced. A null or wordless text has no words and no hits; a null or wordless item has no window; a
    null item_id shows as ''. Repeated rows and items give equal results. Without items nothing is hit. Test windows
    are sent to the executors about `block_windows` at a time, each block in a pass of its own, so any number is exact.
    """
    windows = item_windows(items, size).persist()
    try:
        blocks = max(1, -(-windows.count() // block_windows))
        part = F.pmod(F.xxhash64("window"), F.lit(blocks))

        def send(k: int) -> Broadcast:
            rows = windows.where(part == k).collect()
            return docs.sparkSession.sparkContext.broadcast({bytes(row["window"]): row["ids"] for row in rows})

        if blocks == 1:
            return scan(docs, send(0), True)
        # equal texts have equal hits, so the text names them
        keyed, stored = docs.withColumn("_hit_key", row_key("text")), []
        for k in range(1, blocks):
            shared = send(k)
            hits = scan(keyed.select("_hit_key", "text"), shared, True).where("n_hit > 0")
            stored.append(materialize(hits.groupBy("_hit_key").agg(F.first("hit_spans").alias("_spans"), F.first("items").alias("_items")), "hits"))
            shared.destroy()
        merged = reduce(DataFrame.union, stored).groupBy("_hit_key").agg(
            F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))
        found = scan(lookup_join(keyed, merged, ["_hit_key"], "left"), send(0), False)
        return found.drop("_hit_key", "_spans", "_items")
    finally:
        windows.unpersist()


def is_contaminated() -> Column:
    """At least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    marked = find_overlap(docs.withColumn("_kept", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), items)
    return marked.where(~is_contaminated()).select("_kept.*")


def remove_spans(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All documents, without the hit words of any test window (what follows a removed word up to the next goes too)."""

    def compute(batch):
        data, offsets = utf8(text_of(batch))
        starts, ends, rows = spans_where(ALPHANUMERIC[LOWER[data]], offsets)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        texts = []
        for k, (spans, known) in enumerate(zip(batch.column(batch.schema.get_field_index("hit_spans")).to_pylist(),
                                               text_of(batch).is_valid().to_pylist())):
            kept, at = [], offsets[k]
            for a, b in spans:
                kept.append(data[at: starts[bounds[k] + a]].tobytes())
                at = starts[bounds[k] + b] if bounds[k] + b < bounds[k + 1] else offsets[k + 1]
            kept.append(data[at: offsets[k + 1]].tobytes())
            texts.append(b"".join(kept).decode() if known else None)
        return [pa.array(texts, pa.string())]

    fields = T.StructType([T.StructField("clean_text", T.StringType())])
    return with_columns(find_overlap(docs, items), fields, compute)


def ids_digest(column: str = "items") -> Column:
    return F.sha2(F.array_join(F.col(column), ",").cast("binary"), 256)
