"""Line dedup by suffix arrays over line ids.

Every line with a word has a 128-bit id. Prefix doubling names the runs of 1, 2, 4, ... lines that begin at each line,
each name made of two of half its length, inside the document and so without a shuffle. One distributed sort of all
suffixes by the name of their prefix, then document and place, gives the suffix array (a long line is a prefix of its
own); where neighbours share the name, their common prefix is at least as long, and the intervals of such neighbours
are the copies of the run. All but the first suffix of an interval are later copies, whose lines are deleted. The sort
cuts a crowded interval anywhere, and the first row of each sorted partition is compared with the last key before it,
so no task needs a whole interval. At the default of two lines the doubling runs once: suffixes are ordered by that window
only, and no longest common prefixes or maximal runs are derived.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import row_key, text_of, utf8, with_columns
from flowspark.llm.textops import SPACED, lines_of, mix, span_ids, spans_where
from flowspark.session import materialize

MIN_LINES = 2
LONG_LINE_WORDS = 20
LONG = T.LongType()
SUFFIX_FIELDS = T.StructType([T.StructField("suffixes", T.ArrayType(T.StructType([
    T.StructField(n, LONG) for n in ("pos", "lines", "name_a", "name_b")])))])
#: kind 0: a later copy; 1: first row of a partition, not judged yet; 2: last row of a partition, for its key only.
MARK_SCHEMA = T.StructType([T.StructField("part", LONG), T.StructField("kind", LONG), T.StructField("row_key", T.StringType())] + [
    T.StructField(n, LONG) for n in ("pos", "lines", "name_a", "name_b")])
KEPT_FIELDS = T.StructType([*[T.StructField(n, LONG) for n in ("n_lines", "n_removed", "n_spans")],
                            T.StructField("kept_text", T.StringType())])


def filled_lines(batch: pa.RecordBatch):
    """Bytes, and starts, ends, text and number of words of the lines that have a word."""
    data, offsets = utf8(text_of(batch))
    starts, ends, rows = lines_of(data, offsets)
    words, _, _ = spans_where(SPACED[data], offsets)
    counts = np.bincount(np.searchsorted(starts, words, "right") - 1, minlength=len(starts)) if len(starts) else np.zeros(0, int)
    filled = counts > 0
    return data, starts[filled], ends[filled], rows[filled], counts[filled]


def run_names(lines: np.ndarray, rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs of `length` lines by prefix doubling, and whether such a run begins at each line."""
    names, have, fits = lines, 1, np.ones(len(lines), bool)

    def shifted(by: int) -> tuple[np.ndarray, np.ndarray]:
        later, inside = np.zeros_like(names), np.zeros(len(names), bool)
        if by < len(names):
            later[: len(names) - by] = names[by:]
            inside[: len(names) - by] = rows[by:] == rows[: len(rows) - by]
            inside[: len(names) - by] &= fits[by:]
        return later, inside

    while have < length:
        step = min(have, length - have)
        later, inside = shifted(step)
        names, fits, have = mix(names * np.uint64(0x9E3779B97F4A7C15) + later + np.uint64(step)), fits & inside, have + step
    return names, fits


def suffixes(docs: DataFrame, min_lines: int, long_line_words: int) -> DataFrame:
    """Prefixes to compare: row_key, doc_id, pos, lines (min_lines, or 1 for a long line) and the prefix's name."""

    def compute(batch):
        data, starts, ends, rows, words = filled_lines(batch)
        long_lines = np.flatnonzero(words >= long_line_words) if min_lines > 1 else np.zeros(0, np.int64)
        names = []
        for ids in span_ids(data, starts, ends):
            runs, fits = run_names(ids, rows, min_lines)
            names.append(np.concatenate([runs[fits], ids[long_lines]]).view(np.int64))
        at = np.concatenate([np.flatnonzero(fits), long_lines])
        lines = np.repeat([min_lines, 1], [len(at) - len(long_lines), len(long_lines)])
        order = np.argsort(at, kind="stable")
        at, lines = at[order], lines[order]
        pos = at - np.searchsorted(rows, rows[at])
        values = pa.StructArray.from_arrays([pa.array(x) for x in (pos, lines, names[0][order], names[1][order])],
                                            names=["pos", "lines", "name_a", "name_b"])
        bounds = np.searchsorted(rows[at], np.arange(batch.num_rows + 1))
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)]

    keyed = docs.select(row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
    return with_columns(keyed, SUFFIX_FIELDS, compute).select("row_key", "doc_id", F.inline("suffixes"))


NAMES = ["row_key", "pos", "lines", "name_a", "name_b"]


def compare_neighbours(batches):
    """Over a sorted partition: the suffixes that continue an interval, and the edges of the partition."""
    part = TaskContext.get().partitionId()

    def marked(table: pa.Table, kinds: np.ndarray):
        table = table.append_column("part", pa.array(np.full(len(kinds), part))).append_column("kind", pa.array(kinds))
        return table.select(MARK_SCHEMA.names).combine_chunks().to_batches()

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).select(NAMES)
        previous = pa.concat_tables([before if before is not None else table.slice(0, 1), table.slice(0, batch.num_rows - 1)])
        kinds, keep = np.zeros(batch.num_rows, np.int64), later_copies(table, previous)
        if before is None:
            kinds[0], keep[0] = 1, True
        yield from marked(table.filter(pa.array(keep)), kinds[keep])
        before = table.slice(batch.num_rows - 1, 1)
    if before is not None:
        yield from marked(before, np.array([2]))


def later_copies(now: pa.Table, before: pa.Table) -> np.ndarray:
    """Whether each suffix continues the interval of the one before it; a repeated row is no copy of itself."""
    same = {n: pc.equal(now.column(n), before.column(n)).to_numpy() for n in NAMES}
    return same["lines"] & same["name_a"] & same["name_b"] & ~(same["row_key"] & same["pos"])


def later_runs(docs: DataFrame, min_lines: int, long_line_words: int) -> DataFrame:
    """Lines to delete: row_key, pos and lines (how many from pos on)."""
    rows = materialize(suffixes(docs, min_lines, long_line_words), "lines")
    order = ["lines", "name_a", "name_b", F.asc_nulls_last("doc_id"), "row_key", "pos"]
    array = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = materialize(array.mapInArrow(compare_neighbours, MARK_SCHEMA), "copies")
    settled, last = [], None
    for row in marks.where("kind > 0").orderBy("part", "kind").collect():  # two rows per partition
        if row["kind"] == 2:
            last = row
        elif last is not None and all(row[n] == last[n] for n in NAMES[2:]) and any(row[n] != last[n] for n in NAMES[:2]):
            settled.append((row["row_key"], row["pos"], row["lines"]))
    found = marks.where("kind = 0").select("row_key", "pos", "lines")
    return found.union(docs.sparkSession.createDataFrame(settled, "row_key string, pos long, lines long")) if settled else found


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line_words: int = LONG_LINE_WORDS) -> DataFrame:
    """Delete from each document the later copies of repeated runs of lines.

    Runs are counted over lines that have a word; lines without one are kept and don't break a run. A line is deleted
    if it lies in a run of `min_lines` lines, or is a line of `long_line_words` words or more, that occurs earlier: in
    a document of smaller id (null last; then by content), or further up in the same one. Longer repeated runs go as a
    whole, since all their parts repeat. Adds n_lines, n_removed, n_spans (maximal deleted runs of lines with words)
    and kept_text (the other lines, joined by newlines; null stays null, with 0 lines). Rows with the same id and text
    count as one document and get the same result. All rows and other columns are kept, columns of these names replaced.
    """
    marks = later_runs(docs, min_lines, long_line_words).groupBy("row_key").agg(
        F.collect_list(F.struct("pos", "lines")).alias("_marks")).withColumnRenamed("row_key", "_mark_key")
    joined = docs.withColumn("_row_key", row_key("doc_id", "text")).join(
        marks, F.col("_row_key") == F.col("_mark_key"), "left").drop("_row_key", "_mark_key")

    def compute(batch):
        data, starts, ends, rows, _ = filled_lines(batch)
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        everything, offsets = utf8(text_of(batch))
        breaks = np.r_[0, np.cumsum(everything == 10)]
        n_lines = breaks[offsets[1:]] - breaks[offsets[:-1]] + 1
        valid = text_of(batch).is_valid().to_numpy(False)
        column = batch.column(batch.schema.get_field_index("_marks"))
        counts = column.value_lengths().fill_null(0).to_numpy(False)
        owner, flat = np.repeat(np.arange(batch.num_rows), counts), column.flatten()
        first = bounds[owner] + flat.field("pos").to_numpy(False)
        steps = np.zeros(len(starts) + 1, np.int64)
        np.add.at(steps, first, 1)
        np.add.at(steps, first + flat.field("lines").to_numpy(False), -1)
        gone = np.cumsum(steps[:-1]) > 0
        n_removed = np.bincount(rows[gone], minlength=batch.num_rows)
        _, _, run_rows = spans_where(gone, bounds)
        texts = text_of(batch).to_pylist()
        for row in np.flatnonzero(n_removed):
            a, b = bounds[row], bounds[row + 1]
            cut, at = [], offsets[row]
            raw = everything[offsets[row]: offsets[row + 1]].tobytes().split(b"\n")
            line_starts = {int(s) for s in starts[a:b][gone[a:b]]}
            for piece in raw:
                if int(at) not in line_starts or not piece.strip(b" \t\n\x0b\x0c\r"):
                    cut.append(piece)
                at += len(piece) + 1
            texts[row] = b"\n".join(cut).decode()
        return [pa.array(np.where(valid, n_lines, 0)), pa.array(n_removed), pa.array(np.bincount(run_rows, minlength=batch.num_rows)),
                pa.array(texts, pa.string())]

    return with_columns(joined, KEPT_FIELDS, compute).drop("_marks")
