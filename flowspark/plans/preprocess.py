"""From capture CSV files to the processed feature and context tables, and the audit of both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.labels import attack_family, binary_label, normalize_label
from flowspark.functions.numeric import feature_value
from flowspark.functions.text import scenario_key
from flowspark.operators import profile
from flowspark.schema import CONTEXT_COLUMNS, find_label_column, q
from flowspark.sources import csv_flows, tables

CONTEXT_ONLY = {name for name, _ in CONTEXT_COLUMNS if name != "Destination Port"}


@dataclass
class Collection:
    """A cleaned collection: typed rows, the raw rows behind them, its features and label column."""

    rows: DataFrame
    raw: DataFrame
    features: list[str]
    label: str


def _clean(spark: SparkSession, paths: Sequence[str], bad_lines: str) -> tuple[DataFrame, str]:
    lines = csv_flows.drop_empty_rows(csv_flows.read_flow_csv(spark, paths, bad_lines))
    names = csv_flows.data_columns(lines)
    label = find_label_column(names)
    if label is None:
        raise ValueError("no label column found")
    numbered = csv_flows.with_row_id(lines).withColumnRenamed("_file", "SourceFile")
    return numbered.withColumn("Scenario", scenario_key(F.col("SourceFile"))), label


def _targets(label: str) -> list:
    clean = normalize_label(F.col(q(label)))
    return [
        F.col(q(label)).alias("LabelRaw"), clean.alias("Label"),
        binary_label(clean).cast("byte").alias("BinaryLabel"), attack_family(clean).alias("AttackFamily"),
    ]


def preprocess_features(spark: SparkSession, paths: Sequence[str], expected: Sequence[str] | None = None,
                        bad_lines: str = "error") -> Collection:
    """Clean the feature collection: row ids, scenario, finite float features, targets."""
    raw, label = _clean(spark, paths, bad_lines)
    raw = csv_flows.drop_duplicate_columns(raw)
    features = [c for c in raw.columns if c not in ("RowID", "SourceFile", "Scenario", label)]
    if expected is not None and list(expected) != features:
        raise ValueError("feature order differs from the expected order")
    rows = raw.select(
        "RowID", "SourceFile", "Scenario", *[feature_value(F.col(q(f))).alias(f) for f in features], *_targets(label)
    )
    return Collection(rows, raw, features, label)


def preprocess_context(spark: SparkSession, paths: Sequence[str], bad_lines: str = "error") -> Collection:
    """Clean the context collection: row ids, scenario, context columns, targets."""
    raw, label = _clean(spark, paths, bad_lines)
    with_targets = raw.select(*[F.col(q(c)) for c in raw.columns if c != label], *_targets(label))
    features = [c for c in raw.columns if c in CONTEXT_ONLY or c == "Destination Port"]
    return Collection(tables.context_table(with_targets), raw, features, label)


def check_pairs(features: Collection, context: Collection) -> DataFrame:
    """Do both collections hold the same rows in the same order, scenario by scenario."""
    prints = [profile.fingerprint(profile.alignment_rows(c.raw, c.label)) for c in (features, context)]
    return profile.pair_fingerprints(*prints)


def preprocess(spark: SparkSession, feature_paths: Sequence[str], context_paths: Sequence[str], out: str) -> DataFrame:
    """Write ``out/features`` and ``out/context``; returns the run summary."""
    features, context = preprocess_features(spark, feature_paths), preprocess_context(spark, context_paths)
    tables.write_table(features.rows, f"{out}/features")
    tables.write_table(context.rows, f"{out}/context")
    quality = profile.feature_quality(features.raw, features.features, ["Scenario"])
    return profile.preprocessing_summary(quality, check_pairs(features, context))


def audit(spark: SparkSession, collections: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Inventory, label counts, schema presence, pair comparison and totals of raw collections.

    Lines with surplus cells are skipped here, as an audit must not stop at them.
    """
    inventories, labels, presence, profiles = [], [], [], {}
    for name, paths in collections.items():
        for header, files in csv_flows.by_header(spark, paths).items():
            lines = csv_flows.read_flow_csv(spark, files, bad_lines="skip", same_header=True)
            columns = csv_flows.data_columns(lines)
            label = find_label_column(columns)
            rows = lines.withColumn("scenario_key", scenario_key(F.col("_file")))
            inventories.append(
                profile.profile_files(rows, columns, header, ["_file", "scenario_key"])
                .select(F.lit(name).alias("collection"), "*").withColumnRenamed("_file", "file")
            )
            valid = rows.where(~csv_flows.all_missing(columns)).withColumn("label", normalize_label(F.col(q(label))))
            labels.append(profile.label_counts(valid, ["_file"], "label").select(
                F.lit(name).alias("collection"), F.col("_file").alias("file"), "label", "count", "percentage"))
            presence += [(name, path, c) for path in files for c in columns]
            profiles.setdefault(name, []).append(profile.label_profile(valid, "scenario_key", "label", columns))

    def union(parts: list[DataFrame]) -> DataFrame:
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    inventory, per_file = union(inventories), union(labels)
    found = {
        "inventory": inventory, "label_counts_by_file": per_file,
        "label_distribution": _label_totals(per_file),
        "schema_presence": profile.schema_presence(spark.createDataFrame(presence, "collection string, file string, column string")),
        "collections": profile.collection_summary(inventory),
    }
    if len(profiles) == 2:
        left, right = (union(parts) for parts in profiles.values())
        found["pairs"] = profile.pair_compare(left, right)
    return found


def _label_totals(per_file: DataFrame) -> DataFrame:
    totals = per_file.groupBy("collection", "label").agg(F.sum("count").alias("count"))
    rows = per_file.groupBy("collection").agg(F.sum("count").alias("_all"))
    return totals.join(rows, "collection").select(
        "collection", "label", "count", (F.col("count") * 100 / F.col("_all")).alias("percentage")
    ).orderBy("collection", F.desc("count"), "label")
