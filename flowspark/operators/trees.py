"""Binned features and tree ensembles, shared by the bagged forest and histogram boosting.

Features are cut into at most BINS bins by the exact quantiles of their counted values; a binned table is stored once, in blocks
of rows as byte matrices. A fitted tree is stored packed, a few bytes a node, and read only where it is used; a batch of
rows is scored by unpacking one tree after the other and stepping all of the rows through it at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.prefix import cell_counts, running_totals
from flowspark.session import lookup_join, materialize

BINS = 256
BLOCK_ROWS = 16_384
POOL_ROWS = 400_000
SEED = 42
BLOCK_SCHEMA = "rows int, bins binary, target binary, weight binary, held binary"
TREE_SCHEMA = "tree int, depth int, feature binary, cut binary, code binary, value binary, gain binary"


def bin_edges(df: DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
    """Upper edges of every column's bins (see counted_edges)."""
    return counted_edges(cell_counts(df, columns), len(columns))


def counted_edges(counts: DataFrame, width: int) -> list[np.ndarray]:
    """Upper edges of the bins of `width` columns from their counted cells: halfway between a column's exact quantiles (the
    values at the ranks ceil(rows x k / (BINS - 1))), of which there are at most BINS.

    A column with fewer distinct values than bins gets a bin for each value that the quantiles meet. Only distinct values
    are sorted, in as many tasks as there are ranges, and only the quantiles come to the driver.
    """
    known = counts.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    sizes = counts.where(F.col("value").isNotNull()).groupBy("feature").agg(F.sum("n").alias("_rows"))
    ranked = lookup_join(running_totals(known, ["feature"], "value", ["n"]), sizes, ["feature"])
    # a value is a quantile if a rank ceil(rows x k / parts) lies in (before, until]: some k has before x parts < rows x k <= until x parts
    # (k = 0 means the first value)
    met = F.expr(f"cum_n = n OR cum_n * {BINS - 1} div _rows > (cum_n - n) * {BINS - 1} div _rows")
    found: dict[int, list[float]] = {}
    for row in ranked.where(met).select("feature", "value").collect():
        found.setdefault(row["feature"], []).append(row["value"])
    edges = []
    for i in range(width):
        values = np.unique(np.array(found.get(i, []), np.float64))
        middle = values[:-1] / 2 + values[1:] / 2
        edges.append(np.where(middle < values[1:], middle, values[:-1]))
    return edges


def to_bins(points: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every cell: the number of edges below the value (a value on an edge belongs to the lower bin)."""
    out = np.empty(points.shape, np.uint8)
    for f, cuts in enumerate(edges):
        out[:, f] = np.searchsorted(cuts, points[:, f], side="left")
    return out


def list_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binned_blocks(df: DataFrame, edges: Sequence[np.ndarray], name: str) -> DataFrame:
    """Stored blocks of rows from columns point (array of doubles), target, weight and held (0 or 1)."""
    width = len(edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def block() -> pa.RecordBatch:
            bins, *others = (np.concatenate(x) for x in zip(*held))
            values = [[len(bins)], [bins.tobytes()], *[[x.tobytes()] for x in others]]
            return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32()), *[pa.array(v, pa.binary()) for v in values[1:]]],
                                              names=["rows", "bins", "target", "weight", "held"])

        for batch in batches:
            if not batch.num_rows:
                continue
            target, weight, watched = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            held.append((to_bins(list_matrix(batch.column(0), width), edges), target.astype(np.int16), weight.astype(np.float64), watched.astype(np.uint8)))
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield block()
                held, rows = [], 0
        if held:
            yield block()

    cells = df.select("point", F.col("target").cast("int"), F.col("weight").cast("double"), F.col("held").cast("int"))
    return materialize(cells.mapInArrow(pack, BLOCK_SCHEMA), name)


def read_block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, target, weight and held of a block."""
    n = row["rows"]
    return (np.frombuffer(row["bins"], np.uint8).reshape(n, -1), np.frombuffer(row["target"], np.int16).astype(np.int64),
            np.frombuffer(row["weight"], np.float64), np.frombuffer(row["held"], np.uint8).astype(bool))


def bounded_pool(df: DataFrame, columns: Sequence[str], target: str, weight: str, held: str, pool_rows: int, name: str,
                 edges: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bin edges over all rows (unless given), and the bins, target, weight and held of at most about `pool_rows` of them, chosen by a hash
    of their content, so that the same rows in any order give the same pool. At most pool rows x columns bytes."""
    rows = df.count()
    if not rows:
        raise ValueError("no rows to train on")
    edges = bin_edges(df, columns) if edges is None else edges
    share = min(1.0, pool_rows / rows)
    chosen = df if share == 1.0 else df.where(F.pmod(F.xxhash64(F.lit(SEED), *columns, target), F.lit(1 << 30)) < int(share * (1 << 30)))
    cells = chosen.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("point"), F.col(target).alias("target"),
                          F.col(weight).alias("weight"), F.col(held).alias("held"))
    blocks = [read_block(r) for r in binned_blocks(cells, edges, name).toLocalIterator()]
    if not blocks:
        raise ValueError("no rows to train on")
    bins, targets, weights, watched = (np.concatenate(x) for x in zip(*blocks))
    order = np.lexsort((*bins.T, weights, watched, targets))
    return edges, (bins[order], targets[order], weights[order], watched[order])


def counted_rows(df: DataFrame, columns: Sequence[str], target: str, weight: str, held: str, classes: int, edges: Sequence[np.ndarray],
                 name: str) -> DataFrame:
    """All rows as bins, equal ones once: stored columns bins (a byte a feature), n and fit (the rows that are not held, and their
    weight by class) and watch (the weight of held rows by class). Fitting on these is fitting on all rows."""
    width = len(edges)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ends = np.arange(batch.num_rows + 1, dtype=np.int32) * width
                bins = to_bins(list_matrix(batch.column(0), width), edges)
                yield pa.RecordBatch.from_arrays(
                    [pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)]), *batch.columns[1:]],
                    names=["bins", "target", "weight", "held"])

    cells = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("point"), F.col(target).cast("int").alias("target"),
                      F.col(weight).cast("double").alias("weight"), F.col(held).cast("boolean").alias("held"))

    def by_class(wanted: str) -> Column:
        return F.array(*[F.sum(F.when(F.expr(f"{wanted} AND target = {k}"), F.col("weight")).otherwise(0.0)) for k in range(classes)])

    counted = cells.mapInArrow(binned, "bins binary, target int, weight double, held boolean").groupBy("bins").agg(
        F.sum(F.when(F.col("held"), 0).otherwise(1)).alias("n"), by_class("NOT held").alias("fit"), by_class("held").alias("watch"))
    return materialize(counted, name)


def read_counted(batches: Iterator[pa.RecordBatch], width: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, n, fit and watch of a task's counted rows, sorted by bins."""
    parts = [(np.zeros((0, width), np.uint8), np.zeros(0, np.int64), np.zeros((0, classes)), np.zeros((0, classes)))]
    for batch in batches:
        if batch.num_rows:
            column = batch.column(0)
            first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            bins = np.frombuffer(column.buffers()[2], np.uint8, batch.num_rows * width, first).reshape(-1, width)
            parts.append((bins.copy(), batch.column(1).to_numpy(zero_copy_only=False).copy(),
                          *[list_matrix(batch.column(k), classes).copy() for k in (2, 3)]))
    found = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort(found[0].T)
    return tuple(x[order] for x in found)


@dataclass
class Tree:
    """A binary tree over bins while it is fitted: bins above `cut` go to left + 1, others to left; a leaf points to itself
    and its cut is the last bin. Nodes stand level by level, so the inner nodes' children follow in the order of the inner nodes."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def leaves(self, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The leaf of every row; `flat` holds the bins of all rows, `base` where each row begins."""
        return step(self.depth, self.feature, self.cut, self.left, flat, base)


def step(depth: int, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
    at = np.zeros(len(base), np.int32)
    for _ in range(depth):
        at = left.take(at) + (flat.take(base + feature.take(at)) > cut.take(at))
    return at


def narrow(numbers: np.ndarray, count: int) -> np.ndarray:
    """Numbers below `count` in as few bytes as hold them."""
    return numbers.astype(np.min_scalar_type(max(count - 1, 0)))


@dataclass
class PackedTree:
    """A fitted tree in few bytes a node: children follow from the order of the nodes, a leaf has the number of its value
    among the tree's distinct values, and the gains are summed up by feature."""

    depth: int
    feature: np.ndarray
    cut: np.ndarray
    code: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def of(tree: Tree, width: int) -> "PackedTree":
        """`width` is the number of features."""
        leaf = tree.cut == BINS - 1
        value, code = np.unique(tree.value[leaf], axis=0, return_inverse=True)
        gain = np.bincount(tree.feature, weights=tree.gain, minlength=width)
        return PackedTree(tree.depth, narrow(tree.feature, width), tree.cut.astype(np.uint8), narrow(code.ravel(), len(value)), value, gain)

    def values(self, flat: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The value of every row's leaf; `flat` holds the bins of all rows, `base` where each row begins."""
        inner = self.cut != BINS - 1
        rank = np.cumsum(inner, dtype=np.int32)
        left = np.where(inner, 2 * rank - 1, np.arange(len(rank), dtype=np.int32))
        at = step(self.depth, self.feature, self.cut, left, flat, base)
        return self.value[self.code.take(at - rank.take(at))]


def row_starts(bins: np.ndarray) -> np.ndarray:
    return np.arange(len(bins), dtype=np.int64) * bins.shape[1]


@dataclass
class Ensemble:
    """Trees, stored as a table in the shared folder, with the edges of their bins. `link` says how a row's trees make class
    probabilities.

    ``mean``: the mean of the leaves' probabilities. ``sum``: the sum of leaf values per class (tree t adds to class
    t mod classes) on the start values, through the logistic function or, for several classes, softmax.
    """

    link: str
    classes: int
    edges: list[np.ndarray]
    stored: DataFrame
    start: list[float] = field(default_factory=list)

    @cached_property
    def trees(self) -> list[PackedTree]:
        return self._read()

    def _read(self) -> list[PackedTree]:
        return read_trees(self.stored, self.classes if self.link == "mean" else 0, len(self.edges))

    def probabilities(self, points: np.ndarray) -> np.ndarray:
        """One row of class probabilities per point."""
        return probabilities(self.link, self.classes, self.edges, self.trees, self.start, points)

    def column(self, spark: SparkSession, point: Column) -> Column:
        """Class probabilities of an array of features; null (and unscored) where the array is null.

        The broadcast trees are bounded by trees x nodes x a few bytes, whatever the table's size; the driver does not keep them.
        """
        width, classes = len(self.edges), self.classes
        shared = spark.sparkContext.broadcast((self.link, classes, self.edges, self._read(), self.start))

        @F.arrow_udf("array<double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                known = batch.is_valid().to_numpy(zero_copy_only=False)
                values = probabilities(*shared.value, list_matrix(batch.drop_null(), width)).ravel() if known.any() else np.zeros(0)
                ends = np.r_[0, np.cumsum(known * classes)].astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=pa.array(~known))

        return scored(point)

    def importance(self) -> np.ndarray:
        """Share of each feature in the summed gains, tree by tree."""
        total = np.zeros(len(self.edges))
        for row in self.stored.select("gain").toLocalIterator():
            gains = np.frombuffer(row["gain"], np.float64)
            total += gains / gains.sum() if gains.sum() > 0 else 0
        return total / total.sum() if total.sum() > 0 else total

    def save(self, spark: SparkSession, path: str) -> None:
        self.stored.write.mode("overwrite").parquet(f"{path}/trees")
        rows = [(self.link, self.classes, [e.tolist() for e in self.edges], list(map(float, self.start)))]
        spark.createDataFrame(rows, "link string, classes int, edges array<array<double>>, start array<double>").write.mode("overwrite").parquet(f"{path}/shape")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Ensemble":
        shape = spark.read.parquet(f"{path}/shape").first()
        edges = [np.array(e, np.float64) for e in shape["edges"]]
        return Ensemble(shape["link"], shape["classes"], edges, spark.read.parquet(f"{path}/trees"), list(shape["start"]))


def probabilities(link: str, classes: int, edges: Sequence[np.ndarray], trees: Sequence[PackedTree], start: Sequence[float],
                  points: np.ndarray) -> np.ndarray:
    """One row of class probabilities per point (see Ensemble)."""
    bins = to_bins(points, edges)
    flat, base = bins.ravel(), row_starts(bins)
    if link == "mean":
        total = np.zeros((len(points), classes))
        for tree in trees:
            total += tree.values(flat, base)
        return total / max(1, len(trees))
    raw = np.tile(np.array(start), (len(points), 1))
    for k, tree in enumerate(trees):
        raw[:, k % raw.shape[1]] += tree.values(flat, base)
    return link_probabilities(raw)


def link_probabilities(raw: np.ndarray) -> np.ndarray:
    """Class probabilities of summed leaf values: one column for two classes, else one a class."""
    if raw.shape[1] == 1:
        p = 1 / (1 + np.exp(-raw[:, 0]))
        return np.stack([1 - p, p], axis=1)
    powers = np.exp(raw - raw.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def tree_batch(number: int, tree: Tree, width: int) -> pa.RecordBatch:
    """A row of the stored table; `width` is the number of features."""
    kinds, packed = [pa.int32(), pa.int32(), *[pa.binary()] * 5], PackedTree.of(tree, width)
    row = (number, packed.depth, *[x.tobytes() for x in (packed.feature, packed.cut, packed.code, packed.value, packed.gain)])
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                      names=["tree", "depth", "feature", "cut", "code", "value", "gain"])


def read_trees(table: DataFrame, classes: int, width: int) -> list[PackedTree]:
    """Trees by number; with `classes`, each leaf has so many values. They come part by part, bounded by trees x nodes, both
    parameters."""
    trees = {}
    for row in table.toLocalIterator():
        value = np.frombuffer(row["value"], np.float64)
        value = value.reshape(-1, classes) if classes else value
        feature, code = np.min_scalar_type(max(width - 1, 0)), np.min_scalar_type(max(len(value) - 1, 0))
        trees[row["tree"]] = PackedTree(row["depth"], np.frombuffer(row["feature"], feature), np.frombuffer(row["cut"], np.uint8),
                                        np.frombuffer(row["code"], code), value, np.frombuffer(row["gain"], np.float64))
    return [trees[k] for k in sorted(trees)]
