"""Bring live extractor output to the training schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.numeric import cell_is_coerced, cell_is_infinite, parsed_cell
from flowspark.schema import (
    EXTRACTOR_COLUMNS, EXTRACTOR_CONTEXT, FEATURES, SECONDS_TO_MICROSECONDS, TIME_FEATURES, q,
)


def feature_manifest(spark: SparkSession) -> DataFrame:
    """Ordered feature list: position, feature, dtype."""
    return spark.createDataFrame(
        [(i, f, "float32") for i, f in enumerate(FEATURES, 1)], "position int, feature string, dtype string"
    )


def load_manifest(table: DataFrame) -> list[str]:
    """Feature names in order; raises unless they are exactly the trained features."""
    absent = {"position", "feature"} - set(table.columns)
    if absent:
        raise ValueError(f"manifest lacks {', '.join(sorted(absent))}")
    rows = table.select(F.col("position").cast("int").alias("p"), F.trim("feature").alias("f")).orderBy("p").collect()
    names = [row["f"] for row in rows]
    if len(names) != len(FEATURES):
        raise ValueError(f"expected {len(FEATURES)} features, found {len(names)}")
    if len(set(names)) != len(names):
        raise ValueError("manifest repeats a feature")
    if set(names) != set(FEATURES):
        raise ValueError(
            f"manifest differs: missing {sorted(set(FEATURES) - set(names))}, unexpected {sorted(set(names) - set(FEATURES))}"
        )
    return names


def mapping_report(spark: SparkSession) -> DataFrame:
    """How every training feature is obtained from extractor output."""
    rows = [
        (i, f, EXTRACTOR_COLUMNS[f], "seconds_to_microseconds" if f in TIME_FEATURES else "numeric_identity")
        for i, f in enumerate(FEATURES, 1)
    ]
    return spark.createDataFrame(rows, "position int, feature string, raw_column string, transform string")


def _parsed(df: DataFrame, *others: Column) -> DataFrame:
    """Other columns and, read once, the cell of every feature as ``_c0``, ``_c1`` …"""
    return df.select(*others, *[parsed_cell(F.col(q(EXTRACTOR_COLUMNS[f]))).alias(f"_c{k}") for k, f in enumerate(FEATURES)])


def _value(position: int) -> Column:
    cell = F.col(f"_c{position}")
    number = F.when(~cell_is_infinite(cell) & ~cell_is_coerced(cell), cell)
    return (number * SECONDS_TO_MICROSECONDS if FEATURES[position] in TIME_FEATURES else number).cast("float")


def require_extractor_columns(df: DataFrame) -> None:
    absent = sorted((set(EXTRACTOR_COLUMNS.values()) | set(EXTRACTOR_CONTEXT)) - set(df.columns))
    if absent:
        raise ValueError(f"missing extractor columns: {', '.join(absent)}")


def map_extractor_schema(df: DataFrame, scenario: str, ground_truth: str, row_id: str = "RowID") -> DataFrame:
    """Row key, ground truth, five context columns and the 77 training features.

    `df` is extractor output with row numbers in `row_id`. Times go from seconds to
    microseconds; infinite and unreadable cells become null.
    """
    require_extractor_columns(df)
    context = [F.col(q(raw)).alias(name) for raw, name in EXTRACTOR_CONTEXT.items()]
    cells = _parsed(df, F.col(row_id).cast("long").alias("RowID"), *context)
    return cells.select(
        "RowID", F.lit(scenario).alias("Scenario"), F.lit(ground_truth).alias("GroundTruth"), *EXTRACTOR_CONTEXT.values(),
        *[_value(k).alias(f) for k, f in enumerate(FEATURES)],
    )


def mapping_quality(df: DataFrame) -> DataFrame:
    """Rows, unreadable cells and cells without a value: one row."""
    require_extractor_columns(df)
    coerced = sum((cell_is_coerced(F.col(f"_c{k}")).cast("int") for k in range(len(FEATURES))), F.lit(0))
    gaps = sum((_value(k).isNull().cast("int") for k in range(len(FEATURES))), F.lit(0))
    return _parsed(df).agg(
        F.count("*").alias("model_rows"), F.lit(len(FEATURES)).alias("model_features"),
        F.lit(len(TIME_FEATURES)).alias("time_features_scaled"),
        F.coalesce(F.sum(coerced), F.lit(0)).alias("numeric_coercion_failures"),
        F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_model_cells"),
        F.count_if(gaps > 0).alias("rows_with_missing_model_values"),
    )
