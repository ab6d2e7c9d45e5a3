"""Flow CSV files: header repair, row policy, per-file row numbers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.schema import MISSING_TOKENS, duplicate_pairs, parse_header, q, unique_names
from flowspark.session import lookup_join

CORRUPT = "_corrupt"
FILE_COLUMNS = ["_file", "_path", "_start"]


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Clean column names of one CSV file, repeats still in place."""
    line = spark.read.text(path).first()
    return parse_header(line[0]) if line else []


def _surplus(raw: Column, width: int) -> Column:
    """Whether a raw line has more cells than the header; commas inside quotes do not count."""
    bare = F.regexp_replace(raw, r'"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1 > width


def by_header(spark: SparkSession, paths: Sequence[str], same_header: bool = False) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their clean header; with `same_header` only the first file is looked at."""
    if same_header:
        return {tuple(header_of(spark, paths[0])): list(paths)}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        groups.setdefault(tuple(header_of(spark, path)), []).append(path)
    return groups


def read_flow_csv(spark: SparkSession, paths: Sequence[str], bad_lines: str = "error", same_header: bool = False
                  ) -> DataFrame:
    """Read flow CSV files as text columns, with ``SourceFile`` and hidden position columns.

    Headers may differ between files; columns are matched by cleaned name. Short lines are
    padded with nulls. Lines with surplus cells raise (``bad_lines="error"``) or are left out
    (``"skip"``). Missing-value text becomes null. `same_header` spares a look at every file.
    """
    if bad_lines not in ("error", "skip"):
        raise ValueError("bad_lines is 'error' or 'skip'")
    groups = by_header(spark, paths, same_header)
    parts = [_read_cells(spark, files, unique_names(header), bad_lines, True) for header, files in groups.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _read_cells(spark: SparkSession, files: list[str], names: Sequence[str], bad_lines: str,
                has_header: bool) -> DataFrame:
    width = len(names)
    # Positional names keep case-only duplicates apart while Spark parses.
    slots = [f"_c{i}" for i in range(width)]
    schema = ", ".join(f"{s} string" for s in slots) + f", {CORRUPT} string"
    raw = (
        spark.read.schema(schema)
        .options(header=has_header, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, encoding="UTF-8",
                 quote='"', escape='"', enforceSchema=True)
        .csv(files)
    )
    surplus = F.col(CORRUPT).isNotNull() & _surplus(F.col(CORRUPT), width)
    cells = [F.when(~F.col(s).isin(MISSING_TOKENS), F.col(s)).alias(n) for s, n in zip(slots, names)]
    if bad_lines == "error":
        message = F.concat(F.lit("line has more cells than the header: "), F.col(CORRUPT))
        cells[0] = F.when(surplus, F.raise_error(message)).otherwise(
            F.when(~F.col(slots[0]).isin(MISSING_TOKENS), F.col(slots[0]))).alias(names[0])
    else:
        raw = raw.where(~surplus)
    meta = F.col("_metadata")
    return raw.select(
        meta["file_name"].alias("_file"), meta["file_path"].alias("_path"),
        meta["file_block_start"].alias("_start"),
        *cells,
    )


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in FILE_COLUMNS]


def all_missing(columns: Sequence[str]) -> Column:
    """True for a row whose every named cell is missing."""
    return reduce(lambda a, b: a & b, [F.col(q(c)).isNull() for c in columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(~all_missing(data_columns(df)))


def mismatched_copies(df: DataFrame) -> DataFrame:
    """One row: per X.n column, the number of rows where it differs from X."""
    pairs = duplicate_pairs(df.columns)
    return df.agg(*[F.count_if(~F.col(q(a)).eqNullSafe(F.col(q(b)))).alias(b) for a, b in pairs])


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Drop columns X.n that repeat X on every row; raise if one does not."""
    pairs = duplicate_pairs(df.columns)
    if not pairs:
        return df
    differing = [name for name, n in mismatched_copies(df).first().asDict().items() if n]
    if differing:
        raise ValueError(f"repeated columns differ: {', '.join(differing)}")
    copies = {b for _, b in pairs}
    return df.select(*[F.col(q(c)) for c in df.columns if c not in copies])


def with_row_id(df: DataFrame, name: str = "RowID") -> DataFrame:
    """Number the rows of every file 0, 1, 2 … in file order, without moving the rows.

    `df` comes from a reader of this module, possibly filtered or projected, but not shuffled. A
    task reads a split front to back, so a row's place in its split is its running id less the
    smallest one of the split; the rows of the splits before it are added from a small table.
    """
    split = ["_path", "_start"]
    placed = df.withColumn("_pos", F.monotonically_increasing_id())
    prior = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy(*split).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first")).select(
        *split, "_n", "_first", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_offset")
    )
    place = F.col("_pos") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_offset") + place).otherwise(
        F.raise_error(F.lit("rows moved between reading and numbering")).cast("long")
    )
    kept = [F.col(q(c)) for c in df.columns if c not in split]
    return lookup_join(placed, splits, split, limit=200_000).select(number.alias(name), *kept)


def read_headerless(spark: SparkSession, path: str, header: Sequence[str], bad_lines: str = "error") -> DataFrame:
    """Like :func:`read_flow_csv` for files without a header line; `header` names their cells."""
    return _read_cells(spark, [path], unique_names(header), bad_lines, has_header=False)
