"""Hybrid scoring: known-attack model, family model and anomaly detector into one ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowspark.operators import models, profile, scoring, soc
from flowspark.operators.iforest import IsolationForest
from flowspark.operators.models import Detector
from flowspark.schema import SEVERITIES
from flowspark.session import beside
from flowspark.sources import csv_flows
from flowspark.sources.lookups import read_technique_map
from flowspark.techniques import default_techniques

# Folder names inside a bundle; the second binary model serves where the first is absent.
BINARY_MODELS = ["binary_grouped", "binary_best"]


@dataclass
class Bundle:
    """The three detectors and the technique map, sharing one feature order."""

    binary: Detector
    family: Detector
    anomaly: IsolationForest
    techniques: DataFrame

    def __post_init__(self) -> None:
        if not self.binary.features:
            raise ValueError("the binary model lists no features")
        if self.family.features != self.binary.features:
            raise ValueError("binary and family models use different features")
        if self.anomaly.features != self.binary.features:
            raise ValueError("binary and anomaly models use different features")

    @property
    def features(self) -> list[str]:
        return self.binary.features


def save_bundle(spark: SparkSession, bundle: Bundle, path: str, binary_name: str = BINARY_MODELS[0]) -> None:
    models.save_detector(spark, bundle.binary, f"{path}/{binary_name}")
    models.save_detector(spark, bundle.family, f"{path}/family")
    bundle.anomaly.save(spark, f"{path}/anomaly")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def load_bundle(spark: SparkSession, path: str, technique_map: str | None = None) -> Bundle:
    """Load a saved bundle; the grouped binary model is preferred over the baseline one."""
    found = [name for name in BINARY_MODELS if _exists(spark, f"{path}/{name}")]
    if not found:
        raise FileNotFoundError(f"no binary model in {path}")
    techniques = default_techniques(spark) if technique_map is None else read_technique_map(spark, technique_map)
    return Bundle(
        models.load_detector(spark, f"{path}/{found[0]}"), models.load_detector(spark, f"{path}/family"),
        IsolationForest.load(spark, f"{path}/anomaly"), techniques,
    )


def analyze(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Prediction ledger of a flow table, in one pass; the family model works on the rows that the binary model flags."""
    ready = profile.prepare_features(df, bundle.features)
    known = bundle.binary.attack_probability(ready, "KnownAttackProbability")
    flagged = F.col("KnownAttackProbability") >= F.lit(float(bundle.binary.threshold))
    family = bundle.family.predict_class(known, "_family", "_confidence", where=flagged)
    scored = bundle.anomaly.score(family)
    return scoring.finish_ledger(scored, bundle.techniques, bundle.binary.threshold, bundle.anomaly.threshold)


def quality_report(df: DataFrame, ledger: DataFrame, bundle: Bundle) -> DataFrame:
    """Input quality, models, thresholds and alert totals: one row."""
    counts = soc.run_summary(ledger).drop("rows")
    return beside(profile.input_quality(df, bundle.features), counts).select(
        "*", F.lit(bundle.binary.name).alias("binary_model"), F.lit(bundle.binary.threshold).alias("binary_threshold"),
        F.lit(bundle.family.name).alias("family_model"), F.lit(bundle.anomaly.threshold).alias("anomaly_threshold"),
    )


def score_files(spark: SparkSession, paths: list[str], out: str, bundle: Bundle) -> dict[str, int]:
    """Score CSV files into CSV ledger parts; the totals are counted while the ledger is written."""
    rows = csv_flows.read_flow_csv(spark, paths)
    ledger = analyze(rows.drop(*csv_flows.FILE_COLUMNS), bundle)
    totals = Observation("scoring")
    watched = ledger.observe(
        totals, F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum((F.col("BinaryPrediction") == "ATTACK").cast("long")), F.lit(0)).alias("known_attack_alerts"),
        F.coalesce(F.sum(F.col("AnomalyFlag").cast("long")), F.lit(0)).alias("anomaly_alerts"),
        F.coalesce(F.sum(F.col("AlertSeverity").isin(SEVERITIES[:2]).cast("long")), F.lit(0)).alias("critical_or_high_alerts"),
    )
    watched.write.mode("overwrite").option("header", True).csv(out)
    return dict(totals.get)


