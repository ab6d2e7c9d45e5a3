"""The evaluation designs: random split, grouped sessions, whole scenarios held out, novelty."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.labels import operational_family
from flowspark.functions.times import parse_mixed_timestamp, session_group_id, strata_key
from flowspark.operators import iforest, metrics, models, profile, sampling
from flowspark.operators.iforest import IsolationForest
from flowspark.operators.models import Candidate, Detector
from flowspark.operators.prefix import cell_counts
from flowspark.schema import q
from flowspark.session import materialize

IDS = ["Scenario", "RowID"]
#: Folds that fit and score at the same time.
FOLDS_AT_ONCE = 4
ALL_FOLDS = "ALL_SCENARIOS_AGGREGATED"


@dataclass
class Evaluation:
    """A fitted detector, its test metrics, its ledger of test predictions, and other tables."""

    detector: Detector
    metrics: DataFrame
    ledger: DataFrame
    tables: dict[str, DataFrame]


def _part(df: DataFrame, *names: str) -> DataFrame:
    return df.where(F.col("split").isin(*names))


def _fit_sample(split: DataFrame, sample_size: int, name: str) -> DataFrame:
    """A stored split with all test rows, and of the others a proportional sample of four fifths of `sample_size`.

    The sample's ranks have a seed of their own: by the split's ranks it would take all validation rows before any of training.
    """
    fitting = sampling.proportional_sample(_part(split, "train", "validation"), round(sample_size * 0.8), seed=sampling.SEED + 1)
    return materialize(_part(split, "test").unionByName(fitting), name)


def evaluate_binary(flows: DataFrame, features: Sequence[str], sample_size: int = 400_000,
                    candidates: Sequence[Candidate] = tuple(models.BINARY_CANDIDATES)) -> Evaluation:
    """64/16/20 split of all flows, pick the best candidate on a proportional sample of the first two parts, refit, test
    once on the whole third. `sample_size` bounds the rows used for fitting (four fifths of it), never the test rows."""
    wanted = flows.select(*IDS, "Label", "AttackFamily", "BinaryLabel", *[q(f) for f in features])
    split = _fit_sample(sampling.stratified_split(wanted, ["BinaryLabel"], IDS), sample_size, "binary-sample")
    comparison, winner = models.compare_binary(_part(split, "train"), _part(split, "validation"), features, candidates)
    chosen = next(c for c in candidates if c.name == winner)
    detector = models.fit_detector(_part(split, "train", "validation"), chosen, features, "BinaryLabel")
    scored = materialize(models.score_binary(detector, _part(split, "test")), "binary-test")
    return Evaluation(
        detector, models.binary_report(scored, detector.threshold), models.prediction_ledger(scored, detector.threshold),
        {"comparison": comparison, "split": split.groupBy("split", "Scenario", "BinaryLabel").agg(F.count("*").alias("rows"))},
    )


def with_groups(flows: DataFrame, context: DataFrame, minutes: int = 15, check: bool = True) -> DataFrame:
    """Features joined to context, with the session group of every flow.

    The context's port and protocol come along under names of their own.
    """
    side = context.select(
        *IDS, q("Source IP"), q("Destination IP"), F.col(q("Destination Port")).alias("Destination Port Context"),
        F.col("Protocol").alias("Protocol Context"), F.col("Timestamp"),
    )
    joined = profile.align(flows, side, IDS, check)
    group = session_group_id(
        F.col("Scenario"), F.col(q("Source IP")), F.col(q("Destination IP")), F.col(q("Destination Port Context")),
        F.col(q("Protocol Context")), parse_mixed_timestamp(F.col("Timestamp")), minutes,
    )
    return joined.withColumn("GroupID", group).withColumn("Stratum", strata_key(F.col("Scenario"), F.col("BinaryLabel")))


def evaluate_grouped(grouped: DataFrame, features: Sequence[str], candidate: Candidate, sample_size: int = 400_000,
                     max_fpr: float = 0.01) -> Evaluation:
    """Split by session group, choose the threshold on validation rows, refit, test once. `sample_size` bounds the rows
    used for fitting (four fifths of it), never the test rows."""
    split = _fit_sample(sampling.grouped_stratified_split(grouped), sample_size, "grouped-sample")
    overlap = sampling.require_isolation(split)
    first = models.fit_detector(_part(split, "train"), candidate, features, "BinaryLabel")
    validation = materialize(models.score_binary(first, _part(split, "validation")), "grouped-validation")
    sweep = metrics.threshold_sweep(
        validation, metrics.grid_thresholds(validation, "AttackProbability"), score="AttackProbability"
    )
    detector = models.fit_detector(_part(split, "train", "validation"), candidate, features, "BinaryLabel")
    detector.threshold = float(metrics.pick_threshold(sweep, max_fpr).first()["threshold"])
    detector.facts = {"unique_groups": overlap["unique_groups"], "max_validation_fpr": max_fpr}
    scored = materialize(models.score_binary(detector, _part(split, "test")), "grouped-test")
    distribution = sampling.split_distribution(split)
    return Evaluation(
        detector, models.binary_report(scored, detector.threshold, "null"),
        models.prediction_ledger(scored, detector.threshold),
        {"sweep": sweep, "distribution": distribution, "coverage": sampling.label_coverage(distribution),
         "histogram": metrics.score_histogram(scored, score="AttackProbability"),
         "unseen": sampling.unseen_labels(sampling.label_coverage(distribution)),
         "curves": metrics.curve_points(scored, score="AttackProbability")},
    )


def attack_population(grouped: DataFrame) -> DataFrame:
    """Attack flows with their operational family."""
    return grouped.where(F.col("BinaryLabel") == 1).withColumn("OperationalFamily", operational_family(F.col("Label")))


def evaluate_family(attacks: DataFrame, features: Sequence[str], max_per_family: int = 100_000,
                    candidates: Sequence[Candidate] = tuple(models.FAMILY_CANDIDATES)) -> Evaluation:
    """Cap families, split by group with every family everywhere, pick, refit, test once. The attacks are stored first, so
    that capping, which reads them five times, works out their columns once."""
    stored = materialize(attacks, "attacks")
    capped = materialize(sampling.cap_per_class(stored, max_per_family), "family-sample")
    divided, seed = sampling.grouped_split_all_classes(capped)
    split = materialize(divided, "family-split")
    overlap = sampling.require_isolation(split)
    comparison, winner = models.compare_family(_part(split, "train"), _part(split, "validation"), features, candidates)
    chosen = next(c for c in candidates if c.name == winner)
    train = _part(split, "train", "validation")
    detector = models.fit_detector(train, chosen, features, "OperationalFamily", models.OPERATIONAL_FAMILIES)
    detector.facts = {"split_seed": seed, "unique_groups": overlap["unique_groups"]}
    scored = materialize(models.score_family(detector, _part(split, "test")), "family-test")
    pairs = metrics.class_pairs(scored, "OperationalFamily", "PredictedOperationalFamily")
    correct = F.col("OperationalFamily") == F.col("PredictedOperationalFamily")
    return Evaluation(
        detector, metrics.multiclass_metrics(pairs), scored.withColumn("Correct", correct),
        {"comparison": comparison, "report": metrics.classification_report(pairs),
         "confusion": metrics.confusion_matrix(scored, "OperationalFamily", "PredictedOperationalFamily", models.OPERATIONAL_FAMILIES),
         "distribution": sampling.split_distribution(split, ("Scenario", "OperationalFamily", "Label"))},
    )


def scenarios_of(flows: DataFrame) -> list[str]:
    """The scenario names; a data set has one per capture file."""
    return [row[0] for row in flows.select("Scenario").distinct().orderBy("Scenario").collect()]


def _folds(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def each_fold(spark: SparkSession, scenarios: Sequence[str], work: Callable[[str], tuple[DataFrame, tuple]]) -> list[tuple[DataFrame, tuple]]:
    """Run the folds from a thread pool, each in a scheduler pool of its own: where the session schedules fairly, they share
    the cores. Results come in the order of the scenarios."""
    def run(place: int) -> tuple[DataFrame, tuple]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{place % FOLDS_AT_ONCE}")
        return work(scenarios[place])

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        started = [pool.submit(inheritable_thread_target(run), k) for k in range(len(scenarios))]
        return [x.result() for x in started]


def _with_runs(report: DataFrame, facts: list[tuple], schema: str) -> DataFrame:
    """A fold report with each fold's run facts; seconds and throughput of all folds are of their sums."""
    runs = report.sparkSession.createDataFrame(facts, f"Scenario string, {schema}, fit_seconds double, prediction_seconds double")
    total = runs.agg(F.lit(ALL_FOLDS).alias("Scenario"), *[F.sum(c).alias(c) for c in ("fit_seconds", "prediction_seconds")])
    both = runs.unionByName(total, allowMissingColumns=True)
    speed = metrics.throughput(F.col("test_rows"), F.col("prediction_seconds")).alias("prediction_throughput_flows_per_second")
    return report.join(F.broadcast(both), "Scenario", "left").select("Scenario", *both.columns[1:], speed, *report.columns[1:])


def evaluate_holdout(flows: DataFrame, features: Sequence[str], candidate: Candidate, pool_size: int = 300_000,
                     threshold: float = 0.5) -> dict[str, DataFrame]:
    """Hold out every scenario in turn: train on a pool of the others, test on all its rows.

    One model per fold, all folds from one stored pool, whose cells are counted once, and FOLDS_AT_ONCE at a time. The clocks run over fitting and over
    scoring alone; ``wall_seconds`` in the table ``run`` is the time of all folds together.
    """
    spark = flows.sparkSession
    needed = flows.select(*IDS, "Label", "AttackFamily", "BinaryLabel", *[q(f) for f in features])
    pool = materialize(sampling.proportional_sample(needed, pool_size), "holdout-pool")
    cells = materialize(cell_counts(pool, features, ["Scenario"]), "holdout-cells")
    rows = {r["Scenario"]: r["count"] for r in pool.groupBy("Scenario").count().collect()}

    def fold(scenario: str) -> tuple[DataFrame, tuple]:
        others = F.col("Scenario") != scenario
        detector = models.fit_detector(pool.where(others), candidate, features, "BinaryLabel", counts=cells.where(others))
        started = time.perf_counter()
        part = materialize(models.score_binary(detector, needed.where(F.col("Scenario") == scenario)), "holdout-fold")
        return part, (scenario, sum(n for s, n in rows.items() if s != scenario), detector.fit_seconds, time.perf_counter() - started)

    started = time.perf_counter()
    parts, facts = zip(*each_fold(spark, scenarios_of(pool), fold))
    wall = time.perf_counter() - started
    scored = _folds(list(parts)).withColumn("Threshold", F.lit(float(threshold)))
    ledger = models.prediction_ledger(scored, threshold)
    rates = metrics.detection_rates(ledger, ["Scenario", "Label"])
    report = metrics.fold_report(scored, "Scenario", score="AttackProbability", total=ALL_FOLDS)
    return {
        "metrics": _with_runs(report, list(facts), "training_rows long"), "ledger": ledger,
        "run": spark.createDataFrame([(len(facts), wall)], "folds int, wall_seconds double"),
        "label_rates": rates, "family_rates": metrics.detection_rates(ledger, ["Scenario", "AttackFamily"]),
        "label_rollup": metrics.label_rollup(rates, "Label", weighted=False), "errors": ledger.where(~F.col("Correct")),
    }


def fit_anomaly(pool: DataFrame, features: Sequence[str], exclude: str | None = None, fraction: float = 0.2,
                max_fpr: float = 0.01, trees: int = iforest.TREES, max_samples: int = iforest.MAX_SAMPLES
                ) -> tuple[IsolationForest, dict]:
    """Forest on the training part of a benign pool, threshold from its calibration part, and the facts of the fit."""
    split = materialize(sampling.calibration_split(pool, fraction, exclude=exclude), "benign-split")
    rows = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    forest = iforest.fit_isolation_forest(_part(split, "train"), features, IDS, trees, max_samples)
    _, observed = iforest.calibrate(forest, _part(split, "calibration"), max_fpr)
    return forest, {"training_benign_rows": rows.get("train", 0), "calibration_benign_rows": rows.get("calibration", 0),
                    "anomaly_threshold": forest.threshold, "calibration_observed_fpr": observed, "fit_seconds": forest.fit_seconds}


ANOMALY_FACTS = "training_benign_rows long, calibration_benign_rows long, anomaly_threshold double, calibration_observed_fpr double"


def evaluate_anomaly(flows: DataFrame, features: Sequence[str], pool_size: int = 200_000, fraction: float = 0.2,
                     max_fpr: float = 0.01, trees: int = iforest.TREES, max_samples: int = iforest.MAX_SAMPLES
                     ) -> tuple[IsolationForest, dict[str, DataFrame]]:
    """Benign-only detector: every scenario held out in turn, FOLDS_AT_ONCE at a time, then one final model on all."""
    spark = flows.sparkSession
    needed = flows.select(*IDS, "Label", "AttackFamily", "BinaryLabel", *[q(f) for f in features])
    pool = materialize(sampling.benign_pool(needed, pool_size), "benign-pool")

    def fold(scenario: str) -> tuple[DataFrame, tuple]:
        forest, facts = fit_anomaly(pool, features, scenario, fraction, max_fpr, trees, max_samples)
        started = time.perf_counter()
        scored = forest.score(needed.where(F.col("Scenario") == scenario)).drop(*features)
        part = materialize(scored.withColumn("Threshold", F.lit(forest.threshold)), "anomaly-fold")
        forest.release()
        return part, (scenario, *facts.values(), time.perf_counter() - started)

    parts, facts = zip(*each_fold(spark, scenarios_of(needed.select("Scenario")), fold))
    scored = _folds(list(parts))
    flagged = scored.withColumn("PredictedBinaryLabel", (F.col("AnomalyScore") >= F.col("Threshold")).cast("int"))
    rates = metrics.detection_rates(flagged, ["Scenario", "Label"])
    final, told = fit_anomaly(pool, features, None, fraction, max_fpr, trees, max_samples)
    report = metrics.fold_report(scored, "Scenario", score="AnomalyScore", total=ALL_FOLDS)
    return final, {
        "metrics": _with_runs(report, list(facts), ANOMALY_FACTS), "ledger": flagged, "label_rates": rates,
        "final": spark.createDataFrame([tuple(told.values())], f"{ANOMALY_FACTS}, fit_seconds double"),
        "family_rates": metrics.detection_rates(flagged, ["Scenario", "AttackFamily"]),
        "label_rollup": metrics.label_rollup(rates, "Label", weighted=True),
    }
