"""Training, comparison and persistence of the supervised detectors: MLlib for linear models, own tree ensembles."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.labels import class_name
from flowspark.operators import boosting, forest, metrics
from flowspark.operators.prefix import cell_counts, exact_quantiles
from flowspark.operators.sampling import class_weights
from flowspark.operators.trees import Ensemble, counted_edges
from flowspark.schema import OPERATIONAL_FAMILIES, q
from flowspark.session import beside, lookup_join, materialize, scratch_path, spread

SEED = 42
VECTOR, WEIGHT, TARGET = "_vector", "_weight", "_target"


# ------------------------------------------------------------------------- preparation


def feature_medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact median of every feature over its present values; 0 where none is present.

    Cells become (feature, value) pairs and equal pairs collapse before the shuffle, so this
    scales with distinct values and needs no task that sees a whole column.
    """
    return counted_medians(cell_counts(df, features), features)


def counted_medians(counts: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact medians from the features' counted cells."""
    rows = exact_quantiles(counts, "value", [0.5], ["feature"], "n").collect()
    found = {features[row["feature"]]: row["quantile"] for row in rows}
    return {f: found.get(f, 0.0) for f in features}


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def imputed_sql(feature: str, median: float) -> str:
    return f"coalesce(CAST({q(feature)} AS DOUBLE), {_number(median)})"


def impute(df: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Fill missing features with their training medians."""
    return df.select(*[
        F.expr(imputed_sql(c, medians[c])).alias(c) if c in medians else F.col(q(c)) for c in df.columns
    ])


def feature_moments(df: DataFrame, medians: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of every imputed feature; a constant feature scales by 1."""
    names = list(medians)
    row = df.agg(*[
        agg(F.expr(imputed_sql(f, medians[f]))).alias(f"{kind}{i}")
        for i, f in enumerate(names) for kind, agg in (("m", F.avg), ("s", F.stddev_pop))
    ]).first()
    return {f: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, f in enumerate(names)}


def preparation_stages(medians: dict[str, float], moments: dict[str, tuple[float, float]] | None = None
                       ) -> list[Transformer]:
    """Stages that impute, optionally standardise, and assemble the features."""
    parts = []
    for i, (feature, median) in enumerate(medians.items()):
        value = imputed_sql(feature, median)
        if moments is not None:
            mean, deviation = moments[feature]
            value = f"({value} - {_number(mean)}) / {_number(deviation)}"
        parts.append(f"{value} AS _f{i}")
    names = [f"_f{i}" for i in range(len(medians))]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol=VECTOR),
        SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(names)}) FROM __THIS__"),
    ]


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """Add the balanced weight of each row's class."""
    weights = class_weights(df, label).select(label, F.col("weight").alias(WEIGHT))
    return lookup_join(df, weights, [label])


def _positional(df: DataFrame, features: Sequence[str], *others: Column) -> DataFrame:
    """Features as ``_x0``, ``_x1`` …: some stages cannot handle the dots and spaces of real names."""
    return df.select(*others, *[F.col(q(f)).alias(f"_x{i}") for i, f in enumerate(features)])


# -------------------------------------------------------------------------- candidates


@dataclass(frozen=True)
class Candidate:
    """A model family; sizes default to those of the published experiments."""

    name: str
    kind: str
    scaled: bool = False
    trees: int = 120
    depth: int = 20
    iterations: int = 100

    def linear(self, classes: int) -> LogisticRegression:
        family = "binomial" if classes == 2 else "multinomial"
        return LogisticRegression(featuresCol=VECTOR, labelCol=TARGET, weightCol=WEIGHT, regParam=1e-4, maxIter=self.iterations,
                                  standardization=False, family=family)

    def ensemble(self, rows: DataFrame, columns: Sequence[str], classes: int, edges: list[np.ndarray] | None = None) -> Ensemble:
        """Fit trees on complete columns with TARGET, WEIGHT and _held."""
        if self.kind == "forest":
            return forest.fit_forest(rows, columns, TARGET, classes, self.trees, self.depth, edges=edges)
        settings = boosting.Boosting(iterations=self.iterations)
        return boosting.fit_boosting(rows, columns, TARGET, WEIGHT, "_held", classes, settings, edges=edges)


BINARY_CANDIDATES = [
    Candidate("Prior", "prior"), Candidate("Logistic regression", "linear", scaled=True),
    Candidate("Random forest", "forest"), Candidate("Gradient boosting", "boosting"),
]
FAMILY_CANDIDATES = [
    Candidate("Prior", "prior"), Candidate("Logistic regression", "linear", scaled=True),
    Candidate("Random forest", "forest", trees=150, depth=24), Candidate("Gradient boosting", "boosting", iterations=130),
]


@dataclass
class Detector:
    """A fitted model with everything needed to apply it: features, classes, threshold."""

    name: str
    pipeline: PipelineModel
    features: list[str]
    classes: list[str]
    threshold: float = 0.5
    fit_seconds: float = 0.0
    facts: dict = field(default_factory=dict)
    ensemble: Ensemble | None = None
    medians: dict[str, float] | None = None

    def probabilities(self, df: DataFrame, where: Column | None = None) -> DataFrame:
        """Add ``_probabilities``, an array in class order; null where `where` does not hold, and trees skip those rows."""
        wanted = F.lit(True) if where is None else where
        if self.ensemble is not None:
            point = F.array(*[F.expr(imputed_sql(f, self.medians[f])) for f in self.features])
            return df.withColumn("_probabilities", self.ensemble.column(df.sparkSession, F.when(wanted, point)))
        if where is not None:
            found = self.probabilities(df)
            return found.withColumn("_probabilities", F.when(wanted, F.col("_probabilities")))
        out = self.pipeline.transform(_positional(df, self.features, F.struct("*").alias("_row")))
        if "probability" in out.columns:
            values = vector_to_array("probability")
        else:
            values = F.col("_prior")
        return out.select("_row.*", values.alias("_probabilities"))

    def attack_probability(self, df: DataFrame, name: str = "KnownAttackProbability") -> DataFrame:
        """Add the probability of class 1; 0 for a model that never saw it."""
        scored = self.probabilities(df)
        value = F.coalesce(F.get("_probabilities", F.lit(1)), F.lit(0.0))
        return scored.withColumn(name, value).drop("_probabilities")

    def predict_class(self, df: DataFrame, name: str, confidence: str, details: bool = False, where: Column | None = None) -> DataFrame:
        """Add the most probable class, its probability and, on request, one column per class; null beyond `where`."""
        scored = self.probabilities(df, where)
        best = F.array_max("_probabilities")
        label = F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position("_probabilities", best).cast("int"))
        extra = {
            f"Probability::{c}": F.get("_probabilities", F.lit(i)) for i, c in enumerate(self.classes)
        } if details else {}
        return scored.withColumns({name: label, confidence: best, **extra}).drop("_probabilities")


def _prior_stage(train: DataFrame, classes: int) -> SQLTransformer:
    shares = {int(row[TARGET]): row["probability"] for row in metrics.prior_baseline(train, TARGET).collect()}
    values = ", ".join(_number(shares.get(i, 0.0)) for i in range(classes))
    return SQLTransformer(statement=f"SELECT *, array({values}) AS _prior FROM __THIS__")


def _without_summary(spark: SparkSession, model):
    """The model alone. A training summary drags its session into every task that applies it."""
    if not getattr(model, "hasSummary", False):
        return model
    path = scratch_path(spark, "model")
    model.save(path)
    return type(model).load(path)


def fit_detector(train: DataFrame, candidate: Candidate, features: Sequence[str], label: str,
                 classes: Sequence[str] = ("BENIGN", "ATTACK"), counts: DataFrame | None = None) -> Detector:
    """Fit imputation, scaling and the classifier on the training rows only.

    `label` is 0/1 for two classes, or a class name out of `classes`. Trees read the training rows, which should be stored,
    a few times and keep them only as bins, equal ones once: medians and bins come from the rows' counted cells (`counts`, where
    known).
    """
    started = time.perf_counter()
    if dict(train.dtypes)[label] == "string":
        target = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")
    else:
        target = F.col(label).cast("double")
    # A tenth of the rows, chosen by content, watches boosting for early stopping.
    held = F.pmod(F.xxhash64(*[F.col(q(f)) for f in features]), F.lit(10)) == 0
    rows = _positional(train, features, target.alias(TARGET), held.alias("_held"))
    slots = [f"_x{i}" for i in range(len(features))]
    if candidate.kind in ("forest", "boosting"):
        cells = materialize(cell_counts(rows, slots), "cells") if counts is None else counts
        medians = counted_medians(cells, slots)
        middle = F.element_at(F.array(*[F.lit(float(medians[c])) for c in slots]), F.col("feature") + 1)
        edges = counted_edges(cells.withColumn("value", F.coalesce("value", middle)), len(slots))
        complete = with_class_weights(rows, TARGET).select(
            TARGET, WEIGHT, "_held", *[F.expr(imputed_sql(c, medians[c])).alias(c) for c in slots])
        trees = candidate.ensemble(complete, slots, len(classes), edges)
        return Detector(candidate.name, PipelineModel([]), list(features), list(classes), ensemble=trees,
                        medians=dict(zip(features, medians.values())), fit_seconds=time.perf_counter() - started)
    rows = spread(rows).persist()
    try:
        if candidate.kind == "prior":
            stages: list[Transformer] = [_prior_stage(rows, len(classes))]
        else:
            medians = feature_medians(rows, slots) if counts is None else counted_medians(counts, slots)
            weighted = with_class_weights(rows, TARGET)
            stages = preparation_stages(medians, feature_moments(rows, medians) if candidate.scaled else None)
            ready = reduce(lambda df, stage: stage.transform(df), stages, weighted)
            model = candidate.linear(len(classes)).fit(ready.select(VECTOR, TARGET, WEIGHT))
            stages = stages + [_without_summary(train.sparkSession, model)]
    finally:
        rows.unpersist()
    return Detector(candidate.name, PipelineModel(stages), list(features), list(classes),
                    fit_seconds=time.perf_counter() - started)


def feature_importance(detector: Detector, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Features by importance, for tree models."""
    values = detector.ensemble.importance()
    table = spark.createDataFrame(
        [(f, float(v)) for f, v in zip(detector.features, values)], "feature string, importance double"
    ).orderBy(F.desc("importance"), "feature")
    return table if top is None else table.limit(top)


# ------------------------------------------------------------------ comparison and tests


def _timed(df: DataFrame, name: str) -> tuple[DataFrame, float]:
    started = time.perf_counter()
    kept = materialize(df, name)
    return kept, time.perf_counter() - started


def _with_cost(table: DataFrame, detector: Detector, training_rows: int, seconds: float, rows: str) -> DataFrame:
    return table.select(
        F.lit(detector.name).alias("model"), F.lit(training_rows).alias("training_rows"),
        F.lit(detector.fit_seconds).alias("fit_seconds"), F.lit(seconds).alias("prediction_seconds"),
        metrics.throughput(F.col(rows), F.lit(seconds)).alias("prediction_throughput_flows_per_second"), *table.columns,
    )


def binary_report(scored: DataFrame, threshold: float, undefined: str = "zero") -> DataFrame:
    """Threshold metrics and ranking metrics of one scored table: one row."""
    cells = metrics.binary_confusion(scored, score="AttackProbability", threshold=threshold)
    ranked = metrics.ranking_metrics(scored, score="AttackProbability")
    return beside(metrics.binary_metrics(cells, undefined), ranked)


def family_report(scored: DataFrame, actual: str = "OperationalFamily", predicted: str = "PredictedOperationalFamily"
                  ) -> DataFrame:
    return metrics.multiclass_metrics(metrics.class_pairs(scored, actual, predicted))


def compare_candidates(train: DataFrame, validation: DataFrame, candidates: Sequence[Candidate], features: Sequence[str],
                       label: str, classes: Sequence[str], score: Callable[[Detector, DataFrame], DataFrame],
                       report: Callable[[DataFrame], DataFrame], order: Sequence[str], rows: str
                       ) -> tuple[DataFrame, str]:
    """Fit every candidate, judge it on the validation rows, rank them. Returns (table, winner)."""
    training_rows = train.count()
    parts = []
    for candidate in candidates:
        detector = fit_detector(train, candidate, features, label, classes)
        scored, seconds = _timed(score(detector, validation), "validation")
        parts.append(materialize(_with_cost(report(scored), detector, training_rows, seconds, rows), "candidate"))
    table = metrics.rank_candidates(reduce(lambda a, b: a.unionByName(b), parts), order)
    return table, table.first()["model"]


def score_binary(detector: Detector, df: DataFrame) -> DataFrame:
    return detector.attack_probability(df, "AttackProbability").drop(*detector.features)


def score_family(detector: Detector, df: DataFrame) -> DataFrame:
    return detector.predict_class(df, "PredictedOperationalFamily", "PredictionConfidence", details=True).drop(*detector.features)


def compare_binary(train: DataFrame, validation: DataFrame, features: Sequence[str],
                   candidates: Sequence[Candidate] = tuple(BINARY_CANDIDATES)) -> tuple[DataFrame, str]:
    """Binary candidates ranked by F2, recall, PR-AUC on validation rows."""
    return compare_candidates(
        train, validation, candidates, features, "BinaryLabel", ["BENIGN", "ATTACK"], score_binary,
        lambda scored: binary_report(scored, 0.5), ["f2_attack", "recall_attack", "pr_auc"], "test_rows",
    )


def compare_family(train: DataFrame, validation: DataFrame, features: Sequence[str],
                   candidates: Sequence[Candidate] = tuple(FAMILY_CANDIDATES)) -> tuple[DataFrame, str]:
    """Family candidates ranked by macro F2, macro recall, macro F1 on validation rows."""
    return compare_candidates(
        train, validation, candidates, features, "OperationalFamily", OPERATIONAL_FAMILIES, score_family,
        family_report, ["macro_f2", "macro_recall", "macro_f1"], "evaluation_rows",
    )


def prediction_ledger(scored: DataFrame, threshold: float) -> DataFrame:
    """Binary decisions with their correctness."""
    flagged = (F.col("AttackProbability") >= F.lit(float(threshold))).cast("int")
    return scored.select(
        "*", flagged.alias("PredictedBinaryLabel"), class_name(flagged).alias("PredictedClass"),
        (F.col("BinaryLabel") == flagged).alias("Correct"),
    )


# ------------------------------------------------------------------------- persistence


def save_facts(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def save_detector(spark: SparkSession, detector: Detector, path: str) -> None:
    """Model stages or trees, and a JSON record of features, classes and threshold."""
    if detector.ensemble is None:
        detector.pipeline.write().overwrite().save(f"{path}/pipeline")
    else:
        detector.ensemble.save(spark, f"{path}/ensemble")
    save_facts(spark, f"{path}/facts", {
        "name": detector.name, "features": detector.features, "classes": detector.classes,
        "threshold": detector.threshold, "medians": detector.medians, **detector.facts,
    })


def load_detector(spark: SparkSession, path: str) -> Detector:
    facts = load_facts(spark, f"{path}/facts")
    known = {k: facts.pop(k) for k in ("name", "features", "classes", "threshold", "medians")}
    if known["medians"] is None:
        return Detector(pipeline=PipelineModel.load(f"{path}/pipeline"), facts=facts, **known)
    return Detector(pipeline=PipelineModel([]), facts=facts, ensemble=Ensemble.load(spark, f"{path}/ensemble"), **known)
