"""Data-quality profiles, collection comparison and readiness checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.labels import BENIGN, normalize_label
from flowspark.functions.numeric import (
    cell_is_coerced, cell_is_infinite, cell_value, feature_value, parsed_cell, parsed_double, ratio,
)
from flowspark.functions.times import parse_mixed_timestamp
from flowspark.schema import (
    ALIGNMENT_COLUMNS, CHECK_CONTEXT_USABLE, CHECK_FEATURES_PRESENT, CHECK_IMPUTATION, CHECK_INVALID_CONTEXT, CHECK_NAMES,
    CHECK_NO_DUPLICATES, CHECK_UNUSABLE, INFINITY_TOKENS, clean_header, find_label_column, q, repeated_names, resolve_alias,
)
from flowspark.session import beside

MISSING_FEATURES_SHOWN = 15


def _total(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0)).cast("long")


def missing_cells(df: DataFrame, columns: Sequence[str]) -> Column:
    """Missing cells of a row: null, or NaN in a numeric column."""
    kinds = dict(df.dtypes)
    terms = [F.col(q(c)).isNull() | F.isnan(F.col(q(c))) if kinds[c] in ("float", "double") else F.col(q(c)).isNull() for c in columns]
    return _total([t.cast("int") for t in terms])


def infinite_cells(df: DataFrame, columns: Sequence[str]) -> Column:
    """Infinite numbers and infinity tokens in a row."""
    kinds = dict(df.dtypes)
    terms = [
        F.col(q(c)).isin(INFINITY_TOKENS) if kinds[c] == "string" else F.abs(F.col(q(c)).cast("double")) == float("inf")
        for c in columns
    ]
    return _total([F.coalesce(t, F.lit(False)).cast("int") for t in terms])


def schema_hash(names: Column) -> Column:
    """SHA-256 of an array of column names, one per line."""
    return F.sha2(F.array_join(names, "\n"), 256)


def profile_files(df: DataFrame, columns: Sequence[str], header: Sequence[str], by: Sequence[str] = ("SourceFile",)
                  ) -> DataFrame:
    """Rows, empty rows, missing cells and infinities per file, and facts about its header.

    `header` holds the cleaned names with repeats, `columns` the unique names of the data cells.
    """
    missing = missing_cells(df, columns)
    empty = missing == len(columns)
    label = find_label_column(columns)
    return df.groupBy(*by).agg(
        F.count("*").alias("physical_rows"),
        F.count_if(~empty).alias("valid_rows"),
        F.count_if(empty).alias("empty_rows"),
        F.coalesce(F.sum(F.when(~empty, missing)), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.when(~empty, infinite_cells(df, columns))), F.lit(0)).alias("infinite_values"),
    ).select(
        "*",
        F.lit(len(header)).alias("columns"), F.lit(len(set(header))).alias("unique_columns"),
        F.lit(len(header) - (label is not None)).alias("predictive_columns_before_cleaning"),
        F.lit("; ".join(repeated_names(header))).alias("duplicate_header_names"),
        F.lit(label or "").alias("label_column"),
        schema_hash(F.array(*[F.lit(c) for c in columns])).alias("schema_sha256"), F.lit("OK").alias("status"),
    )


def label_counts(df: DataFrame, by: Sequence[str], label: str = "Label") -> DataFrame:
    """Rows per label, and their share of the enclosing group."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("count"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("percentage", ratio(F.col("count") * 100, F.sum("count").over(group), 0.0))


def schema_presence(columns: DataFrame) -> DataFrame:
    """From (collection, file, column) rows: in how many of the collection's files a column is."""
    totals = columns.groupBy("collection").agg(F.count_distinct("file").alias("total_files"))
    present = columns.groupBy("collection", "column").agg(F.count_distinct("file").alias("files_present"))
    return present.join(totals, "collection").withColumn(
        "present_in_all_files", F.col("files_present") == F.col("total_files")
    )


def collection_summary(profiles: DataFrame, by: str = "collection") -> DataFrame:
    """Totals of file profiles per collection."""
    return profiles.groupBy(by).agg(
        F.count("*").alias("files"), F.count_if(F.col("status") == "OK").alias("successful_files"),
        *[F.sum(c).alias(c) for c in ("physical_rows", "valid_rows", "empty_rows", "missing_cells", "infinite_values")],
    )


def binary_summary(df: DataFrame, label: str = "Label") -> DataFrame:
    """Benign and attack rows and percentages, and the number of labels: one row."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    benign, rows = F.sum(F.when(F.col(label) == BENIGN, F.col("n")).otherwise(0)), F.sum("n")
    return counts.agg(
        benign.alias("BENIGN"), (rows - benign).alias("ATTACK"),
        ratio(benign * 100, rows, 0.0).alias("BENIGN_percentage"),
        ratio((rows - benign) * 100, rows, 0.0).alias("ATTACK_percentage"),
        F.count("*").alias("distinct_labels"),
    )


def feature_quality(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Cells replaced or lost when raw columns become features."""
    cells = df.select(*by, *[parsed_cell(F.col(q(f))).alias(f"_cell{k}") for k, f in enumerate(features)])

    def counted(test) -> Column:
        return F.sum(_total([test(F.col(f"_cell{k}")).cast("int") for k in range(len(features))]))

    return cells.groupBy(*by).agg(
        F.count("*").alias("rows"),
        counted(cell_is_infinite).alias("infinity_values"),
        counted(cell_is_coerced).alias("coerced_values"),
        counted(lambda c: cell_value(c).isNull()).alias("missing_values"),
    )


def preprocessing_summary(quality: DataFrame, pairs: DataFrame) -> DataFrame:
    """Totals over all files and whether every collection pair matches: one row."""
    totals = quality.agg(*[F.sum(c).alias(c) for c in quality.columns if c != "SourceFile" and c != "Scenario"])
    matched = pairs.agg(
        F.coalesce(F.bool_and(F.col("row_counts_match") & F.col("fingerprints_match")), F.lit(False))
        .alias("all_pairs_match")
    )
    return beside(totals, matched)


# --------------------------------------------------------------------------- collection pairs


def _digits(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("%.12e", number))


def alignment_rows(df: DataFrame, label: str, by: Sequence[str] = ("Scenario", "RowID")) -> DataFrame:
    """Row key and a digest over the shared columns, numbers to 13 digits; absent columns count as missing."""
    parts = [
        F.coalesce(_digits(parsed_double(F.col(q(c)))), F.lit("")) if c in df.columns else F.lit("")
        for c in ALIGNMENT_COLUMNS
    ]
    digest = F.md5(F.concat_ws("|", F.col("RowID").cast("string"), *parts, normalize_label(F.col(q(label)))))
    return df.select(*by, digest.alias("digest"))


def fingerprint(rows: DataFrame, by: Sequence[str] = ("Scenario",)) -> DataFrame:
    """Order-aware fingerprint per scenario: the row number is part of every row digest.

    Rows, a xor and a sum of 60-bit digest words are combined map-side, so files of any size
    compare without sorting.
    """
    word = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    tail = F.conv(F.substring("digest", 16, 8), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.bit_xor(word).alias("xor_word"),
        F.sum(tail).cast("string").alias("sum_word"),
    )


def pair_fingerprints(left: DataFrame, right: DataFrame, by: str = "Scenario") -> DataFrame:
    """Per scenario of two collections: do row counts and fingerprints agree."""
    a = left.withColumnsRenamed({c: f"left_{c}" for c in left.columns if c != by})
    b = right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c != by})
    same = reduce(lambda x, y: x & y, [F.col(f"left_{c}") == F.col(f"right_{c}") for c in ("rows", "xor_word", "sum_word")])
    return a.join(b, by, "full_outer").select(
        by, "left_rows", "right_rows",
        F.coalesce(F.col("left_rows") == F.col("right_rows"), F.lit(False)).alias("row_counts_match"),
        F.coalesce(same, F.lit(False)).alias("fingerprints_match"),
    )


def differing_rows(left: DataFrame, right: DataFrame, by: Sequence[str] = ("Scenario", "RowID")) -> DataFrame:
    """Rows whose digest differs or that exist on one side only."""
    a, b = left.withColumnRenamed("digest", "left_digest"), right.withColumnRenamed("digest", "right_digest")
    return a.join(b, list(by), "full_outer").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def pair_compare(left: DataFrame, right: DataFrame, by: str = "scenario_key") -> DataFrame:
    """Compare two collections scenario by scenario.

    Each side has one row per scenario: ``valid_rows``, ``column_list`` and ``label_counts``
    (an array of (label, count) structs sorted by label).
    """
    a = left.withColumnsRenamed({c: f"left_{c}" for c in left.columns if c != by})
    b = right.withColumnsRenamed({c: f"right_{c}" for c in right.columns if c != by})
    none = F.array().cast("array<string>")
    lc = F.coalesce(F.col("left_column_list"), none)
    rc = F.coalesce(F.col("right_column_list"), none)
    return a.join(b, by, "full_outer").select(
        by, "left_valid_rows", "right_valid_rows",
        (F.col("right_valid_rows") - F.col("left_valid_rows")).alias("valid_row_difference"),
        F.size(F.array_intersect(lc, rc)).alias("common_columns"),
        F.array_join(F.array_sort(F.array_except(rc, lc)), "; ").alias("right_extra_columns"),
        F.array_join(F.array_sort(F.array_except(lc, rc)), "; ").alias("left_only_columns"),
        (F.col("left_label_counts") == F.col("right_label_counts")).alias("label_counts_match"),
    )


def label_profile(df: DataFrame, key: str, label: str, columns: Sequence[str]) -> DataFrame:
    """One row per scenario in the form :func:`pair_compare` reads."""
    return df.groupBy(key, label).agg(F.count("*").alias("n")).groupBy(key).agg(
        F.sum("n").alias("valid_rows"),
        F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col("n").alias("count")))).alias("label_counts"),
    ).withColumn("column_list", F.array(*[F.lit(c) for c in columns]))


def align(features: DataFrame, context: DataFrame, on: Sequence[str] = ("Scenario", "RowID"),
          check: bool = True) -> DataFrame:
    """Join features to context one to one; with `check`, rows missing on a side raise.

    Both tables are keyed by (Scenario, RowID), which is unique: no key is hot. Tables stored by `tables.write_bucketed`
    with the same buckets are neither shuffled for the check nor for the join.
    """
    keys = list(on)
    shared = [c for c in context.columns if c in features.columns and c not in keys]
    side = context.drop(*shared)
    if check:
        counts = (
            features.select(*keys, F.lit(1).alias("_f")).join(context.select(*keys, F.lit(1).alias("_c")), keys, "full_outer")
            .agg(F.count("*").alias("all"), F.count("_f").alias("f"), F.count("_c").alias("c")).first()
        )
        if not counts["all"] == counts["f"] == counts["c"]:
            raise ValueError(f"features and context do not align: {counts.asDict()}")
    return features.join(side, keys)


# -------------------------------------------------------------------------------- readiness


def _listing(names: Sequence[str]) -> str:
    more = len(names) - MISSING_FEATURES_SHOWN
    return ", ".join(names[:MISSING_FEATURES_SHOWN]) + (f" (+{more} more)" if more > 0 else "")


def prepare_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Clean the header and turn the required features into finite floats; other columns stay.

    Repeated names or missing features raise.
    """
    names = clean_header(df.columns)
    twice = repeated_names(names)
    if twice:
        raise ValueError(f"repeated column names: {', '.join(sorted(twice))}")
    missing = [f for f in features if f not in names]
    if missing:
        raise ValueError(f"missing required features: {_listing(missing)}")
    renamed = df.toDF(*names)
    wanted = set(features)
    return renamed.select(*[feature_value(F.col(q(c))).alias(c) if c in wanted else F.col(q(c)) for c in names])


def input_quality(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Quality counters of a table before :func:`prepare_features`: one row."""
    names = clean_header(df.columns)
    raw = df.toDF(*names)
    return feature_quality(raw, features).select(
        F.col("rows").alias("rows_received"), F.lit(len(features)).alias("required_feature_count"),
        F.coalesce("missing_values", F.lit(0)).alias("missing_feature_cells_after_coercion"),
        F.coalesce("infinity_values", F.lit(0)).alias("infinity_values_converted_to_missing"),
        F.coalesce("coerced_values", F.lit(0)).alias("non_numeric_values_coerced_to_missing"),
    )


CONTEXT_FIELDS = ["source_ip", "destination_ip", "timestamp", "destination_port", "syn_count"]


def validate_flows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Readiness report of a flow table: one row.

    ``status`` is FAIL if the models cannot run, PASS WITH WARNINGS if they can but cells need
    imputing or the table cannot be correlated, else PASS.
    """
    names = clean_header(df.columns)
    twice = repeated_names(names)
    if twice:
        # Later copies get a private name so that the remaining checks still run.
        seen: dict[str, int] = {}
        unique = []
        for n in names:
            seen[n] = seen.get(n, 0) + 1
            unique.append(n if seen[n] == 1 else f"{n} #{seen[n]}")
        names = unique
    raw = df.toDF(*names)
    present = [f for f in features if f in names]
    absent = [f for f in features if f not in names]
    values = {f: feature_value(F.col(q(f))) for f in present}
    mapping = {logical: resolve_alias(names, logical) for logical in CONTEXT_FIELDS}
    kinds = dict(raw.dtypes)

    def usable(logical: str) -> Column:
        name = mapping[logical]
        column = F.col(q(name))
        if logical == "timestamp":
            return (column if kinds[name].startswith("timestamp") else parse_mixed_timestamp(column)).isNotNull()
        if logical in ("destination_port", "syn_count"):
            return feature_value(column).isNotNull()
        return F.coalesce(F.trim(column.cast("string")) != "", F.lit(False))

    resolved = [l for l in CONTEXT_FIELDS if mapping[l]]
    gaps = _total([v.isNull().cast("int") for v in values.values()])
    counts = raw.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(gaps), F.lit(0)).alias("missing_feature_cells"),
        F.count_if(gaps > 0).alias("rows_with_feature_gaps"),
        *[F.count(v).alias(f"_u{i}") for i, v in enumerate(values.values())],
        *[F.count_if(~usable(l)).alias(f"_bad_{l}") for l in resolved],
    )
    unusable = F.filter(
        F.array(*[F.when(F.col(f"_u{i}") == 0, F.lit(f)) for i, f in enumerate(present)]) if present
        else F.array().cast("array<string>"), lambda name: name.isNotNull(),
    )
    bad = _total([F.col(f"_bad_{l}") for l in resolved])
    missing_context = [l for l in CONTEXT_FIELDS if not mapping[l]]
    model_ready = (F.col("rows") > 0) & F.lit(not twice and not absent) & (F.size("unusable_required_features") == 0)
    cross_ready = (F.col("rows") > 0) & F.lit(not missing_context) & (F.col("invalid_context_values") == 0)
    clean = (F.col("missing_feature_cells") == 0) & F.col("cross_flow_ready")
    strings = lambda values_: F.array(*[F.lit(v) for v in values_]).cast("array<string>")
    return (
        counts.select(
            "rows", F.lit(len(df.columns)).alias("columns"), F.lit(len(features)).alias("required_feature_count"),
            F.lit(len(present)).alias("present_required_features"), strings(twice).alias("duplicate_columns"),
            strings(absent).alias("missing_required_features"), unusable.alias("unusable_required_features"),
            strings([n for n in names if n not in set(features)]).alias("extra_columns"),
            "rows_with_feature_gaps", F.col("missing_feature_cells").alias("missing_feature_cells_after_coercion"),
            "missing_feature_cells", strings(missing_context).alias("missing_cross_flow_context"),
            F.create_map(*[F.lit(x) for l in resolved for x in (l, mapping[l])]).cast("map<string,string>").alias("context_mapping"),
            F.create_map(*[x for l in resolved for x in (F.lit(l), F.col(f"_bad_{l}"))]).cast("map<string,bigint>").alias("invalid_context_counts"),
            bad.alias("invalid_context_values"),
        )
        .withColumn("model_ready", model_ready).withColumn("cross_flow_ready", cross_ready)
        .withColumn("status", F.when(~F.col("model_ready"), "FAIL").when(clean, "PASS").otherwise("PASS WITH WARNINGS"))
        .drop("missing_feature_cells")
    )


def validation_checks(report: DataFrame) -> DataFrame:
    """The five readiness checks of a :func:`validate_flows` report, one row each."""
    def check(position: int, name: str, status: Column, detail: Column) -> Column:
        return F.struct(F.lit(position).alias("position"), F.lit(name).alias("check"), status.alias("status"), detail.alias("detail"))

    def number(column: str | Column) -> Column:
        return F.format_number(F.col(column) if isinstance(column, str) else column, 0)

    missing, unusable = F.size("missing_required_features"), F.size("unusable_required_features")
    schema_detail = F.concat(
        F.concat_ws("/", "present_required_features", "required_feature_count"), F.lit(CHECK_FEATURES_PRESENT),
        F.when(missing > 0, F.concat(F.lit("; "), missing, F.lit(" missing"))).otherwise(""),
        F.when(unusable > 0, F.concat(F.lit("; "), unusable, F.lit(CHECK_UNUSABLE))).otherwise(""),
    )
    context_detail = (
        F.when(F.col("cross_flow_ready"), CHECK_CONTEXT_USABLE)
        .when(F.size("missing_cross_flow_context") > 0, F.concat(F.lit("Missing: "), F.array_join("missing_cross_flow_context", ", ")))
        .otherwise(F.concat(F.lit(CHECK_INVALID_CONTEXT), number("invalid_context_values")))
    )
    duplicated = F.size("duplicate_columns") > 0
    checks = F.array(
        check(1, CHECK_NAMES[0], F.when(F.col("rows") > 0, "PASS").otherwise("FAIL"), F.concat(number("rows"), F.lit(" rows loaded"))),
        check(2, CHECK_NAMES[1], F.when(duplicated, "FAIL").otherwise("PASS"),
              F.when(duplicated, F.concat(F.lit("Duplicates: "), F.array_join("duplicate_columns", ", ")))
              .otherwise(CHECK_NO_DUPLICATES)),
        check(3, CHECK_NAMES[2], F.when((missing > 0) | (unusable > 0), "FAIL").otherwise("PASS"), schema_detail),
        check(4, CHECK_NAMES[3],
              F.when(F.col("missing_feature_cells_after_coercion") == 0, "PASS").otherwise("WARNING"),
              F.concat(number("missing_feature_cells_after_coercion"), F.lit(CHECK_IMPUTATION))),
        check(5, CHECK_NAMES[4], F.when(F.col("cross_flow_ready"), "PASS").otherwise("NOT READY"), context_detail),
    )
    return report.select(F.inline(checks))
