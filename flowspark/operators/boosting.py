"""Histogram gradient boosting: leaf-wise trees on binned features, all classes in one round.

The fit works on all rows as bins (a byte a cell), equal ones counted once. Each round grows one
tree a class (one for two classes) on the gradients of the logistic or softmax loss: the gradient, curvature and row
histograms of a node give its best cut, the smaller child's are summed up and the larger one's are the difference from
their parent's, and the tree always cuts the leaf of largest gain next. Up to SHARD_ROWS different rows are fitted by one
task, so that several fits (folds, candidates) run beside each other. More are dealt to as many tasks as they need: each has
its own rows and their scores, and a barrier adds up the tasks' histograms, after which all take the same cuts, at about a
second a level of each round.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.trees import (
    BINS, TREE_SCHEMA, Ensemble, Tree, bin_edges, counted_rows, link_probabilities, read_counted, row_starts, tree_batch,
)
from flowspark.session import materialize

SHARD_ROWS = 4_000_000  # different binned rows a task
JOINED = 8_192  # codes that several features' bins may make together
GATHER_BYTES = 32 << 20  # of all tasks' sums that pass a barrier at once

Exchange = Callable[[list[np.ndarray]], list[np.ndarray]]


@dataclass(frozen=True)
class Boosting:
    """Sizes of the published experiments."""

    iterations: int = 100
    rate: float = 0.08
    leaves: int = 31
    min_rows: int = 20
    min_curvature: float = 1e-3
    l2: float = 1.0
    patience: int = 10
    tolerance: float = 1e-7


@dataclass
class Cut:
    gain: float
    feature: int
    bin: int
    left: tuple[float, float, int]
    right: tuple[float, float, int]


def best_cut(histogram: np.ndarray, settings: Boosting, features: Sequence[int] | None = None) -> Cut | None:
    """The cut of largest gain of a node's histogram (gradient, curvature, rows by feature and bin), None if none helps.

    `features` numbers the histogram's features (ascending). Ties go to the lower feature and then the lower bin.
    """
    left = np.cumsum(histogram, axis=2)
    total = left[:, :1, -1:]
    right = total - left

    def score(sums: np.ndarray) -> np.ndarray:
        return sums[0] ** 2 / (sums[1] + settings.l2)

    fits = np.minimum(left[2], right[2]) >= settings.min_rows
    fits &= np.minimum(left[1], right[1]) >= settings.min_curvature
    gain = np.where(fits, score(left) + score(right) - score(total), -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b] > 1e-12:
        return None
    sides = [(float(s[0, f, b]), float(s[1, f, b]), int(round(s[2, f, b]))) for s in (left, right)]
    return Cut(float(gain[f, b]), int(f if features is None else features[f]), int(b), *sides)


@dataclass
class Growing:
    """A tree while it grows. Children exist as soon as they are measured; `taken` has the cuts that count."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [BINS - 1])
    left: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple[float, float, int]] = field(default_factory=lambda: [(0.0, 0.0, 0)])
    depth: list[int] = field(default_factory=lambda: [0])
    parent: list[int] = field(default_factory=lambda: [-1])
    best: dict[int, Cut | None] = field(default_factory=dict)
    taken: set[int] = field(default_factory=set)

    def divide(self, node: int) -> None:
        """Give a node the children of its best cut."""
        if self.left[node] != node:
            return
        cut = self.best[node]
        self.feature[node], self.cut[node], self.left[node] = cut.feature, cut.bin, len(self.left)
        for sums in (cut.left, cut.right):
            self.left.append(len(self.left))
            self.feature.append(0)
            self.cut.append(BINS - 1)
            self.sums.append(sums)
            self.depth.append(self.depth[node] + 1)
            self.parent.append(node)

    def advance(self, settings: Boosting) -> list[int]:
        """Take cuts best first as far as all leaves are measured; the nodes to measure next (none: the tree is done)."""
        self.taken = set()
        heap = [(-self.best[0].gain, 0)] if self.best.get(0) else []
        while heap and len(self.taken) < settings.leaves - 1:
            wanting = [c for c in self._children(heap[0][1]) if c not in self.best]
            if wanting:
                return self._ahead(heap, settings)
            node = heapq.heappop(heap)[1]
            self.taken.add(node)
            for child in self._children(node):
                if self.best[child]:
                    heapq.heappush(heap, (-self.best[child].gain, child))
        return []

    def _children(self, node: int) -> tuple[int, int]:
        self.divide(node)
        return self.left[node], self.left[node] + 1

    def _ahead(self, heap: list[tuple[float, int]], settings: Boosting) -> list[int]:
        """Unmeasured children of the leaves that may be cut next; the last cut's own children need no measuring."""
        remaining = settings.leaves - 1 - len(self.taken)
        waiting = []
        for _, node in sorted(heap)[:remaining]:
            for child in self._children(node):
                if child in self.best:
                    continue
                if remaining == 1 or self.sums[child][2] < 2 * settings.min_rows:
                    self.best[child] = None
                else:
                    waiting.append(child)
        return waiting or self.advance(settings)

    def value(self, node: int, settings: Boosting) -> float:
        return -settings.rate * self.sums[node][0] / (self.sums[node][1] + settings.l2)

    def leaves(self) -> list[int]:
        return [c for n in self.taken for c in (self.left[n], self.left[n] + 1) if c not in self.taken] or [0]

    def finished(self, settings: Boosting) -> Tree:
        """The tree of the taken cuts, its leaves' values scaled by the learning rate."""
        order, at = [0], 0
        while at < len(order):
            if order[at] in self.taken:
                order += [self.left[order[at]], self.left[order[at]] + 1]
            at += 1
        number = {node: k for k, node in enumerate(order)}
        inner = [node in self.taken for node in order]
        value = [0.0 if x else self.value(n, settings) for n, x in zip(order, inner)]
        return Tree(
            max(self.depth[n] for n in order), np.array([self.feature[n] if x else 0 for n, x in zip(order, inner)], np.int32),
            np.array([self.cut[n] if x else BINS - 1 for n, x in zip(order, inner)], np.uint8),
            np.array([number[self.left[n]] if x else k for k, (n, x) in enumerate(zip(order, inner))], np.int32), np.array(value),
            np.array([self.best[n].gain if x else 0.0 for n, x in zip(order, inner)], np.float32))


def gradients(raw: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by row and column of `raw`, of rows with one class each."""
    return class_gradients(raw, weight[:, None] * (target[:, None] == np.arange(max(2, raw.shape[1]))))


def class_gradients(raw: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by row and column of `raw`; a row has a weight for every class."""
    p, over = link_probabilities(raw), weights.sum(axis=1, keepdims=True)
    if raw.shape[1] == 1:
        p, weights = p[:, 1:], weights[:, 1:]
    return over * p - weights, over * p * (1 - p)


def loss(raw: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted log loss and weight of rows with a weight for every class."""
    return np.array([-(weights * np.log(np.maximum(link_probabilities(raw), 1e-300))).sum(), weights.sum()])


def histogram(columns: Sequence[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums by kind (gradient, curvature, rows), feature and bin over some rows."""
    return Joined(columns, [BINS] * len(columns)).histogram(rows, (g, h, np.ones(len(g))))


class Joined:
    """Columns of bins joined into few codes, of which one histogram has those of all their features."""

    def __init__(self, columns: Sequence[np.ndarray], sizes: Sequence[int]):
        """`sizes` are the numbers of the columns' bins; the largest is joined with the smallest that fit under JOINED codes."""
        self.width, self.parts = len(columns), []
        order = sorted(range(len(columns)), key=lambda f: sizes[f])
        while order:
            features = [order.pop()]
            count = sizes[features[0]]
            while order and count * sizes[order[0]] <= JOINED:
                features.append(order.pop(0))
                count *= sizes[features[-1]]
            code = np.zeros(len(columns[0]), np.intp)
            for f in features:
                code = code * sizes[f] + columns[f]
            self.parts.append((features, [sizes[f] for f in features], code))

    def histogram(self, rows: np.ndarray, weights: Sequence[np.ndarray]) -> np.ndarray:
        """Sums of each of the weights by feature and bin over some rows."""
        out = np.zeros((len(weights), self.width, BINS))
        weights = [w[rows] for w in weights]
        for features, shape, code in self.parts:
            codes, count = code[rows], int(np.prod(shape))
            for kind, w in enumerate(weights):
                sums = np.bincount(codes, weights=w, minlength=count).reshape(shape)
                for axis, f in enumerate(features):
                    out[kind, f, : shape[axis]] = sums.sum(axis=tuple(a for a in range(len(shape)) if a != axis))
        return out


class Measuring:
    """A task's rows in the nodes of a growing tree, and the nodes' histograms over all tasks."""

    def __init__(self, tree: Growing, columns: Sequence[np.ndarray], joined: Joined, rows: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray):
        self.tree, self.columns, self.joined, self.weights = tree, columns, joined, (g, h, n)
        self.rows, self.found = {0: rows}, {}

    def rows_of(self, node: int) -> np.ndarray:
        if node not in self.rows:
            parent = self.tree.parent[node]
            rows, cut = self.rows_of(parent), self.tree.best[parent]
            right = self.columns[cut.feature][rows] > cut.bin
            left = self.tree.left[parent]
            self.rows[left], self.rows[left + 1] = rows[~right], rows[right]
        return self.rows[node]

    def _sides(self, node: int) -> tuple[int, int]:
        """A node and its sibling, the one with fewer rows of all tasks first."""
        left = self.tree.left[self.tree.parent[node]]
        return (left, left + 1) if self.tree.sums[left][2] <= self.tree.sums[left + 1][2] else (left + 1, left)

    def lacking(self, nodes: Sequence[int]) -> list[int]:
        """The nodes to sum up for the histograms of `nodes`: of two children the smaller one."""
        return sorted({node if not node else self._sides(node)[0] for node in nodes if node not in self.found} - set(self.found))

    def own(self, node: int) -> np.ndarray:
        return self.joined.histogram(self.rows_of(node), self.weights)

    def put(self, node: int, sums: np.ndarray) -> None:
        """Take in a node's sums over all tasks; its larger sibling has what they leave of their parent's."""
        self.found[node] = sums
        if node:
            self.found[self._sides(node)[1]] = self.found[self.tree.parent[node]] - sums
        else:
            self.tree.sums[0] = tuple(float(x) for x in sums[:, 0].sum(axis=1))


def train(bins: np.ndarray, target: np.ndarray, weight: np.ndarray, held: np.ndarray, start: Sequence[float], settings: Boosting,
          own: Sequence[int] | None = None) -> list[Tree]:
    """The trees of a fit on rows with one class each, that cut the features `own` (all, unless given)."""
    weights = weight[:, None] * (target[:, None] == np.arange(max(2, len(start))))
    return train_counted(bins, (~held).astype(np.int64), weights * ~held[:, None], weights * held[:, None], start, settings, own=own)


def train_counted(bins: np.ndarray, n: np.ndarray, fit: np.ndarray, watch: np.ndarray, start: Sequence[float], settings: Boosting,
                  exchange: Exchange = lambda sums: sums, own: Sequence[int] | None = None) -> list[Tree]:
    """The trees of a fit, of which this task has some counted rows (see counted_rows). `exchange` adds up the sums of all tasks."""
    columns = [np.ascontiguousarray(c) for c in bins.T]
    joined = Joined(columns, [int(c.max(initial=0)) + 1 for c in columns])
    rows, others = np.flatnonzero(n > 0), np.flatnonzero(n == 0)
    raw, fit = np.asfortranarray(np.tile(np.array(start), (len(bins), 1))), np.asfortranarray(fit)  # a class's values lie together
    watched = np.flatnonzero(watch.any(axis=1))
    flat, base, n, watch = bins[others].ravel(), row_starts(bins[others]), n.astype(np.float64), watch[watched]
    trees: list[Tree] = []
    losses: list[float] = []
    for _ in range(settings.iterations):
        g, h = class_gradients(raw, fit)
        growing = [Growing() for _ in start]
        nodes = [Measuring(t, columns, joined, rows, np.ascontiguousarray(g[:, k]), np.ascontiguousarray(h[:, k]), n) for k, t in enumerate(growing)]
        wanted = [[0] for _ in start]
        told = [loss(raw[watched], watch)]  # passes with the roots' sums
        while any(wanted):
            summed = [(k, node) for k, some in enumerate(wanted) for node in nodes[k].lacking(some)]
            sums = exchange([nodes[k].own(node) for k, node in summed] + told)
            if told:
                total, over = sums.pop()
                told = []
                if over > 0:
                    losses.append(total / over)
                    if _stalled(losses, settings):
                        return trees
            for (k, node), found in zip(summed, sums):
                nodes[k].put(node, found)
            for k, some in enumerate(wanted):
                for node in some:
                    found = nodes[k].found[node]
                    growing[k].best[node] = best_cut(found if own is None else found[:, list(own)], settings, own)
            wanted = [tree.advance(settings) for tree in growing]
        for k, tree in enumerate(growing):
            done = tree.finished(settings)
            trees.append(done)
            for node in tree.leaves():
                raw[nodes[k].rows_of(node), k] += tree.value(node, settings)
            raw[others, k] += done.value[done.leaves(flat, base)]
        if not any(tree.taken for tree in growing):
            break
    return trees


def through_barrier(sums: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays' sums over all tasks, added up in the tasks' order, so that every task has the same."""
    context = BarrierTaskContext.get()
    flat = np.concatenate([x.ravel() for x in sums])
    step = max(1, GATHER_BYTES // 8 // len(context.getTaskInfos()))
    for a in range(0, len(flat), step):
        told = context.allGather(base64.b64encode(flat[a: a + step].tobytes()).decode())
        flat[a: a + step] = sum(np.frombuffer(base64.b64decode(x), np.float64) for x in told)
    cuts = np.cumsum([x.size for x in sums])[:-1]
    return [part.reshape(x.shape) for part, x in zip(np.split(flat, cuts), sums)]


def start_values(counts: Sequence[float]) -> list[float]:
    """Log odds of the second class, or log shares, from the classes' weights (an absent class counts as nearly none)."""
    shares = np.maximum(np.array(counts, np.float64), 1e-12)
    shares /= shares.sum()
    return [float(np.log(shares[1] / shares[0]))] if len(shares) == 2 else np.log(shares).tolist()


def fit_boosting(df: DataFrame, columns: Sequence[str], target: str, weight: str, held: str, classes: int,
                 settings: Boosting = Boosting(), tasks: int | None = None, edges: list[np.ndarray] | None = None) -> Ensemble:
    """Fit on all rows, of columns without nulls. `target` is the class number; rows whose `held` is
    true only watch for early stopping, which ends the rounds once the last `patience` ones lowered their loss by no more
    than the tolerance. `tasks` share the rows, by default one for every SHARD_ROWS different ones, and at most as many as
    run at once; the trees are the same but for the rounding of sums. `edges` are those of the bins, where known."""
    spark = df.sparkSession
    edges = bin_edges(df, columns) if edges is None else edges
    cells = counted_rows(df, columns, target, weight, held, classes, edges, "boosting-rows")
    found = cells.agg(F.count("*").alias("rows"), F.array(*[F.sum(F.col("fit")[k]) for k in range(classes)]).alias("weights")).first()
    if not found["rows"]:
        raise ValueError("no rows to train on")
    start = start_values(found["weights"])
    count = min(-(-found["rows"] // SHARD_ROWS), spark.sparkContext.defaultParallelism) if tasks is None else tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = train_counted(*read_counted(batches, len(columns), classes), start, settings, *([through_barrier] if count > 1 else []))
        if count == 1 or BarrierTaskContext.get().partitionId() == 0:
            yield from (tree_batch(k, tree, len(columns)) for k, tree in enumerate(trees))

    dealt = cells.repartition(count, "bins")
    return Ensemble("sum", classes, edges, materialize(dealt.mapInArrow(run, TREE_SCHEMA, barrier=count > 1), "boosting-trees"), start)


def _stalled(losses: list[float], settings: Boosting) -> bool:
    if len(losses) <= settings.patience:
        return False
    before = losses[-settings.patience - 1]
    return not any(x < before - settings.tolerance for x in losses[-settings.patience:])
