"""Exact running totals that never put one whole key into a single task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.session import lookup_join, materialize, null_safe

LONG, DOUBLE = T.LongType(), T.DoubleType()


def _same(now: pa.Array, before: pa.Array) -> np.ndarray:
    """Whether values are equal, with null equal to null and NaN to NaN."""
    equal = pc.fill_null(pc.equal(now, before), False)
    equal = pc.or_(equal, pc.and_(pc.is_null(now), pc.is_null(before)))
    if pa.types.is_floating(now.type):
        equal = pc.or_(equal, pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False))
    return equal.to_numpy(zero_copy_only=False)


FIRST, LAST = 1, 2


def _sum_in_ranges(keys: Sequence[str], sums: Sequence[str], keep: str | None, schema: T.StructType):
    """Over a sorted partition: running sums that begin anew with every key, the partition's number, and marks on its first and
    last row. With `keep` only these two and rows where it is 1 are returned."""
    whole = [schema[f"cum_{c}"].dataType == LONG for c in sums]
    others = [f.name for f in schema][: -len(sums) - 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, [0] * len(sums)
        waiting: pa.RecordBatch | None = None  # a batch is passed on when the next has come, as the last row gets a mark
        marks = np.zeros(0, np.int32)

        def marked() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([*waiting.columns, pa.array(marks)], names=schema.names)
            if keep is None:
                return out
            kept = pc.fill_null(pc.equal(out.column(schema.names.index(keep)), 1), False).to_numpy(zero_copy_only=False)
            return out.filter(pa.array(kept | (marks > 0)))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            same = np.ones(batch.num_rows, bool)
            same[0] = last is not None
            for k, column in enumerate(columns):
                before = pa.concat_arrays([(column if last is None else last[k]).slice(0, 1), column.slice(0, batch.num_rows - 1)])
                same &= _same(column, before)
            begin = np.maximum.accumulate(np.where(same, 0, np.arange(batch.num_rows)))
            totals = []
            for k, name in enumerate(sums):
                kind = (np.int64, pa.int64()) if whole[k] else (np.float64, pa.float64())
                values = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(kind[1]), 0).to_numpy(zero_copy_only=False)
                running = np.r_[np.zeros(1, kind[0]), np.cumsum(values)]
                total = running[1:] - running[begin]
                if same[0]:  # the batch's first key goes on from the batch before
                    total[begin == 0] += held[k]
                held[k] = total[-1]
                totals.append(pa.array(total, kind[1]))
            if waiting is not None:
                yield marked()
            marks = np.zeros(batch.num_rows, np.int32)
            marks[0] = FIRST if last is None else 0
            last = [c.slice(batch.num_rows - 1, 1) for c in columns]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in others]
            waiting = pa.RecordBatch.from_arrays([*rest, *totals, pa.array(np.full(batch.num_rows, part, np.int32))], names=schema.names[:-1])
        if waiting is not None:
            marks[-1] += LAST
            yield marked()

    return run


def running_totals(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], sums: Sequence[str], keep: str | None = None
                   ) -> DataFrame:
    """Add inclusive running sums ``cum_<name>`` along ascending `order` within `keys` (null is a key like any other).

    `order` is unique within `keys` (group by it first); null values count as 0. The rows are cut by sampled ranks of keys and
    order into ranges of equal size, whatever the keys' sizes and however values crowd, and each range is summed in the
    task that sorted it: the rows are shuffled once. Only the key that a cut divides needs the sums of the ranges before, one
    row for each range. The cut rows are stored, so that sums and rows agree on the ranges.

    With `keep`, the name of a number column, all rows are summed but only those where it is 1 are stored and returned,
    without the columns `sums`; rows of equal order then may stand in any order if none of them is kept.
    """
    by, along = list(keys), [order] if isinstance(order, str) else list(order)
    kinds = {c: LONG if isinstance(df.schema[c].dataType, T.IntegralType) else DOUBLE for c in sums}
    fields = [T.StructField(f"cum_{c}", kinds[c]) for c in sums] + [T.StructField(c, T.IntegerType()) for c in ("_part", "_mark")]
    kept = [f for f in df.schema.fields if keep is None or f.name not in sums]
    schema = T.StructType(kept + fields)
    sort = [F.col(f"`{c}`") for c in by + along]
    ranged = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = materialize(ranged.mapInArrow(_sum_in_ranges(by, sums, keep, schema), schema), "ranges")
    marks = placed.where(F.col("_mark") > 0).select("_part", "_mark", *sort[: len(by)], *[F.col(f"cum_{c}") for c in sums])
    starts, before, held = [], None, [0] * len(sums)
    for part, mark, *values in sorted(marks.collect(), key=lambda row: row[:2]):  # two rows a range at most
        key, total = tuple(values[: len(by)]), values[len(by):]
        if mark & FIRST:
            goes_on = before is not None and _equal(before, key)
            first = key
            if goes_on:
                starts.append((part, *key, *held))
        if mark & LAST:
            held = [x + y for x, y in zip(held, total)] if goes_on and _equal(first, key) else total
            before = key
    cum = [F.col(f"cum_{c}") for c in sums]
    if keep is not None:
        placed = placed.where(F.col(f"`{keep}`") == 1)
    if starts:
        carried = T.StructType([T.StructField("_part", T.IntegerType()), *[df.schema[c] for c in by],
                                *[T.StructField(f"_start_{c}", kinds[c]) for c in sums]])
        table = df.sparkSession.createDataFrame(starts, T.StructType([T.StructField(f.name, f.dataType) for f in carried]))
        placed = null_safe(placed, F.broadcast(table), ["_part", *by], "left")
        cum = [c + F.coalesce(F.col(f"_start_{n}"), F.lit(0)) for c, n in zip(cum, sums)]
    return placed.select(*[F.col(f"`{f.name}`") for f in kept], *[c.alias(f"cum_{n}") for c, n in zip(cum, sums)])


def _equal(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def cell_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The rows ``n`` of every distinct cell: columns `by`, ``feature`` (the column's place) and ``value`` (null: missing)."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(columns)
    ])).alias("_c")
    return df.select(*by, cells).select(*by, "_c.*").groupBy(*by, "feature", "value").agg(F.count("*").alias("n"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Linearly interpolated quantiles per key: columns keys, ``prob``, ``quantile``, ``rows``. A row stands for as many as
    its `count`, if named.

    Equal values collapse first, so the shuffle carries distinct values only; the ranks on
    either side of each quantile are then read off exact running counts.
    """
    base, by = (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])
    counted = (
        base.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_v"))
        .agg((F.count("*") if count is None else F.sum(count)).alias("_n"))
    )
    ranked = running_totals(counted, by, "_v", ["_n"])
    rows = counted.groupBy(*by).agg(F.sum("_n").alias("rows"))
    targets = F.transform(
        F.array(*[F.lit(float(p)) for p in probs]),
        lambda p: F.struct(p.alias("prob"), ((F.col("rows") - 1) * p).alias("pos")),
    )
    end, start = F.col("cum__n"), F.col("cum__n") - F.col("_n")

    def holds(rank: Column) -> Column:
        return (start <= rank) & (rank < end)

    met = F.filter(targets, lambda t: holds(F.floor(t["pos"])) | holds(F.ceil(t["pos"])))
    found = (
        lookup_join(ranked, rows, by).select(*by, "rows", "_v", F.explode(met).alias("_t"))
        .groupBy(*by, "rows", "_t").agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    )
    share = F.col("_t.pos") - F.floor("_t.pos")
    return found.select(
        *list(keys), "_t.prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("quantile"), "rows",
    )
