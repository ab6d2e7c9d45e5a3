"""Source correlation and preparation of live captures, from files to reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators import correlate, extractor
from flowspark.operators.correlate import ScanRule
from flowspark.session import beside
from flowspark.sources import csv_flows, tables


def correlate_files(spark: SparkSession, paths: Sequence[str], rule: ScanRule = ScanRule()) -> tuple[DataFrame, DataFrame]:
    """Source summaries and scan alerts of flow CSV files."""
    rows = csv_flows.with_row_id(csv_flows.read_flow_csv(spark, paths), "_row")
    if "RowID" not in rows.columns:
        rows = rows.withColumnRenamed("_row", "RowID")
    stem = F.regexp_replace("_file", r"\.[^.]*$", "")
    return correlate.correlate(correlate.prepare_flows(rows, F.col("_file"), stem), rule)


def prepare_capture(spark: SparkSession, path: str, scenario: str, ground_truth: str, out: str) -> DataFrame:
    """Turn extractor output into model-ready CSV; returns its quality record with digests."""
    raw = csv_flows.with_row_id(csv_flows.read_flow_csv(spark, [path]))
    mapped = extractor.map_extractor_schema(raw, scenario, ground_truth)
    target = f"{out}/{scenario}"
    tables.write_report(mapped, target, "csv", single_file=False)
    digests = tables.file_digests(spark, [path]).agg(F.first("sha256").alias("input_sha256"))
    written = tables.file_digests(spark, [f"{target}/*.csv"]).agg(
        F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("outputs"))
    quality = extractor.mapping_quality(raw)
    return beside(quality, digests, written).select(
        F.lit(scenario).alias("scenario"), F.lit(ground_truth).alias("ground_truth"), "*")
