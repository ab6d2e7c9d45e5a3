"""Isolation forest: trees grown in parallel on bounded row samples, scored by Arrow batches."""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.operators.metrics import quantile_threshold
from flowspark.operators.models import feature_medians, imputed_sql, load_facts, save_facts
from flowspark.schema import q
from flowspark.session import materialize, spread

SEED = 42
TREES, MAX_SAMPLES = 200, 10_000
HASH_SPACE = 1 << 40
PASSING = threading.Lock()
TREE_SCHEMA = "tree int, rows int, feature binary, value binary"


def mean_path(rows: np.ndarray) -> np.ndarray:
    """Average depth at which a search in a tree of `rows` points ends."""
    n = np.asarray(rows, dtype=np.float64)
    safe = np.maximum(n, 3)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow_tree(points: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    """Grow one tree, a whole level at a time: random non-constant feature, random cut in its range.

    The children of a node sit next to each other, so the right one is ``left + 1``.
    """
    order = np.arange(len(points))
    sizes = np.array([len(points)])
    levels, first = [], 0
    for depth in range(limit + 1):
        count = len(sizes)
        starts = np.cumsum(sizes) - sizes
        low = np.minimum.reduceat(points[order], starts, axis=0)
        high = np.maximum.reduceat(points[order], starts, axis=0)
        feature = np.where(high > low, rng.random(low.shape), -1.0).argmax(axis=1)
        at = np.arange(count)
        lo, hi = low[at, feature], high[at, feature]
        cut = lo + (hi - lo) * rng.random(count)
        cut = np.where(cut < hi, cut, lo)
        inner = (hi > lo) & (depth < limit)
        ids = first + at
        left = np.where(inner, first + count + 2 * (np.cumsum(inner) - 1), ids)
        levels.append(pd.DataFrame({
            "node": ids, "feature": np.where(inner, feature, -1), "cut": np.where(inner, cut, np.inf),
            "left": left, "path": np.where(inner, 0.0, depth + mean_path(sizes)), "rows": sizes,
        }))
        if not inner.any():
            break
        owner = np.repeat(at, sizes)
        order, owner = order[inner[owner]], owner[inner[owner]]
        goes_right = points[order, feature[owner]] > cut[owner]
        side = left[owner] + goes_right - (first + count)
        order = order[np.argsort(side, kind="stable")]
        sizes = np.bincount(side, minlength=2 * int(inner.sum()))
        first += count
    return pd.concat(levels, ignore_index=True)


def _children(feature: np.ndarray) -> np.ndarray:
    """The left child of every node (a leaf: itself): nodes stand level by level, children in the order of the inner nodes."""
    inner = feature >= 0
    return np.where(inner, 2 * np.cumsum(inner) - 1, np.arange(len(feature)))


@dataclass
class IsolationForest:
    """Trees, stored as a table in the shared folder, with the medians that complete missing features.

    A row has a tree's nodes level by level: the feature (-1: a leaf), and the cut or a leaf's path.
    """

    features: list[str]
    medians: dict[str, float]
    stored: DataFrame
    sample_rows: int
    threshold: float = 0.5
    fit_seconds: float = 0.0
    shared: Broadcast | None = field(default=None, repr=False)

    def _broadcast(self, spark: SparkSession) -> Broadcast:
        """One broadcast for all that this forest scores; forests of folds that run side by side pass the driver in turn."""
        with PASSING:
            if self.shared is None:
                self.shared = spark.sparkContext.broadcast(self._trees())
        return self.shared

    def release(self) -> None:
        """Give the broadcast up, once all that was scored is stored."""
        if self.shared is not None:
            self.shared.destroy()
            self.shared = None

    def _trees(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Feature and value of every tree's nodes, at most 10 bytes a node; they come part by part."""
        rows = {r["tree"]: (np.frombuffer(r["feature"], np.int16), np.frombuffer(r["value"], np.float64)) for r in self.stored.toLocalIterator()}
        return [rows[k] for k in sorted(rows)]

    @property
    def nodes(self) -> pd.DataFrame:
        """The nodes of all trees as rows, to look at."""
        return pd.concat([pd.DataFrame({
            "tree": k, "node": np.arange(len(value)), "feature": feature.astype(np.int32), "cut": np.where(feature >= 0, value, np.inf),
            "left": _children(feature), "path": np.where(feature >= 0, 0.0, value),
        }) for k, (feature, value) in enumerate(self._trees())], ignore_index=True)

    def vector(self) -> Column:
        return F.array(*[F.expr(imputed_sql(f, self.medians[f])) for f in self.features])

    def score(self, df: DataFrame, name: str = "AnomalyScore") -> DataFrame:
        """Add the anomaly score: 2^(-mean path / expected path), higher is more unusual.

        The broadcast trees are bounded by trees x 2 x sample rows x 10 bytes, whatever the table's size; the driver does not
        keep them, and a task unpacks one tree at a time.
        """
        shared = self._broadcast(df.sparkSession)
        expected, width = float(mean_path(self.sample_rows)), len(self.features)
        steps = math.ceil(math.log2(max(self.sample_rows, 2)))

        @F.arrow_udf("double")
        def anomaly(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            forest = shared.value
            for batch in batches:
                cells = batch.flatten().to_numpy(zero_copy_only=False)
                base = np.arange(0, len(cells), width)
                total = np.zeros(len(base))
                for feature, value in forest:
                    # A leaf points to itself and its cut is infinite, so rows may keep stepping.
                    left, cut, tested = _children(feature), np.where(feature >= 0, value, np.inf), np.maximum(feature, 0)
                    at = np.zeros(len(base), dtype=np.int64)
                    for _ in range(steps):
                        at = left.take(at) + (cells.take(base + tested.take(at)) > cut.take(at))
                    total += value.take(at)
                yield pa.array(np.exp2(-total / len(forest) / max(expected, 1e-12)))

        return df.withColumn(name, anomaly(self.vector()))

    def save(self, spark: SparkSession, path: str) -> None:
        self.stored.write.mode("overwrite").parquet(f"{path}/trees")
        save_facts(spark, f"{path}/facts", {
            "features": self.features, "medians": self.medians, "sample_rows": self.sample_rows, "threshold": self.threshold,
        })

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        facts = load_facts(spark, f"{path}/facts")
        return IsolationForest(stored=spark.read.parquet(f"{path}/trees"), **facts)


def tree_samples(df: DataFrame, ids: Sequence[str], trees: int, size: int, rows: int, seed: int = SEED,
                 slack: float = 8.0) -> DataFrame:
    """Exactly `size` rows per tree without replacement, by hash rank.

    A row is first kept for a tree with a probability slightly above size / rows, so the exact
    ranking that follows shuffles little more than the samples themselves.
    """
    share = min(1.0, (size + slack * math.sqrt(size) + slack) / max(rows, 1))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, *ids), F.lit(HASH_SPACE))
    kept = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= int(share * HASH_SPACE))
    spread = df.withColumn("tree", F.explode(kept)).withColumn("_draw", draw(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", *ids))
    return spread.withColumn("_rank", rank).where(F.col("_rank") <= size)


def fit_isolation_forest(train: DataFrame, features: Sequence[str], ids: Sequence[str] = ("Scenario", "RowID"),
                         trees: int = TREES, max_samples: int = MAX_SAMPLES, seed: int = SEED) -> IsolationForest:
    """Grow the forest on benign rows; each task holds one tree's sample, at most `max_samples` rows."""
    started = time.perf_counter()
    source = spread(train.select(*ids, *[q(f) for f in features])).persist()
    medians = feature_medians(source, features)
    rows = source.count()
    size = min(max_samples, rows)
    if size == 0:
        raise ValueError("no rows to train on")
    limit = math.ceil(math.log2(max(size, 2)))
    vector = F.array(*[F.expr(imputed_sql(f, medians[f])) for f in features])
    pool = source.select(*ids, vector.alias("_point"))

    def build(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        points = np.stack(sample.sort_values("_rank")["_point"].to_numpy())
        grown = grow_tree(points, limit, np.random.default_rng([seed, tree]))
        value = np.where(grown["feature"] >= 0, grown["cut"], grown["path"])
        return pd.DataFrame({"tree": [tree], "rows": [len(points)], "feature": [grown["feature"].to_numpy(np.int16).tobytes()],
                             "value": [value.astype(np.float64).tobytes()]})

    def forest(slack: float) -> DataFrame:
        samples = tree_samples(pool, ids, trees, size, rows, seed, slack).select("tree", "_rank", "_point")
        return materialize(samples.groupBy("tree").applyInPandas(build, TREE_SCHEMA), "isolation-trees")

    try:
        grown = forest(8.0)
        found = grown.agg(F.count("*").alias("trees"), F.min("rows").alias("rows")).first()
        if found["trees"] < trees or found["rows"] < size:
            grown = forest(float(rows))
    finally:
        source.unpersist()
    return IsolationForest(list(features), medians, grown, size, fit_seconds=time.perf_counter() - started)


def calibrate(forest: IsolationForest, calibration: DataFrame, max_fpr: float) -> tuple[float, float]:
    """Set the threshold that flags a share of `max_fpr` of benign rows; returns it and the observed share."""
    scored = materialize(forest.score(calibration).select("AnomalyScore"), "calibration")
    row = quantile_threshold(scored, max_fpr, score="AnomalyScore").first()
    forest.threshold = float(row["threshold"])
    return forest.threshold, float(row["observed_rate"])
