"""Processed tables, report sinks, digests and previews."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.schema import CONTEXT_COLUMNS, q
from flowspark.session import scratch_path

TARGETS = ["LabelRaw", "Label", "BinaryLabel", "AttackFamily"]


def write_table(df: DataFrame, path: str, by: str = "Scenario") -> None:
    """Replace a Parquet data set, one folder per scenario.

    Scenarios differ widely in size, so tasks write the partitions they hold and no scenario
    is pulled into a single writer.
    """
    df.write.mode("overwrite").partitionBy(by).option("compression", "snappy").parquet(path)


def context_table(df: DataFrame) -> DataFrame:
    """Row key, context columns with their types (null where absent) and targets."""
    columns = [
        (F.col(q(name)).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)).alias(name)
        for name, kind in CONTEXT_COLUMNS
    ]
    return df.select("RowID", "SourceFile", "Scenario", *columns, *TARGETS)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               scenarios: Sequence[str] | None = None) -> DataFrame:
    """Read a processed table; columns and scenarios prune files and column chunks."""
    df = spark.read.parquet(path)
    if scenarios is not None:
        df = df.where(F.col("Scenario").isin(list(scenarios)))
    return df if columns is None else df.select(*[q(c) for c in columns])


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str] = ("Scenario", "RowID"), buckets: int = 64) -> DataFrame:
    """Store a table in the shared folder, bucketed and sorted by `keys`, and read it back.

    Two tables with the same number of buckets join on their keys without a shuffle, as often as they are joined. The
    rows are dealt by the buckets' own hash first, so a bucket is one file. The catalog entry lasts as long as the session
    unless its catalog is a stored one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    entry = f"{name.replace('-', '_')}_{path.rsplit('-', 1)[1]}"
    dealt = df.repartition(buckets, *[F.col(q(k)) for k in keys])
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(entry)
    return spark.table(entry)


def write_report(df: DataFrame, path: str, kind: str = "csv", single_file: bool = True) -> None:
    """Write a report as CSV, JSON lines or text.

    `single_file` suits the aggregated reports; a ledger should be written with False.
    """
    out = (df.coalesce(1) if single_file else df).write.mode("overwrite")
    if kind == "csv":
        out.option("header", True).csv(path)
    elif kind == "json":
        out.json(path)
    elif kind == "text":
        out.text(path)
    else:
        raise ValueError(f"unknown report kind {kind}")


#: Name endings that the text reader decompresses; digests are of the bytes as stored.
COMPRESSED = r"(?i)[.](gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def _buffers(size: int):
    """Over the lines of file splits in order: buffers of about `size` bytes, each with its split and place in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, held_bytes, place = None, [], 0, 0

        def buffer() -> pa.RecordBatch:
            values = [[key[0]], [key[1]], [place], [b"".join(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.string(), pa.int64(), pa.int64(), pa.binary()))],
                                              names=["file", "begin", "place", "content"])

        for batch in batches:
            for file, begin, line in zip(*(c.to_pylist() for c in batch.columns)):
                if held and ((file, begin) != key or held_bytes >= size):
                    yield buffer()
                    place, held, held_bytes = (place + 1 if (file, begin) == key else 0), [], 0
                key = (file, begin)
                held += [line, b"\n"]
                held_bytes += len(line) + 1
        if held:
            yield buffer()

    return run


def _hash_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the buffers of files, sorted by file, split and place: the digest of each file, one buffer in memory at a time."""
    file, state, last, total, size = None, None, b"", 0, 0

    def done() -> pa.RecordBatch:
        # the reader leaves out whether the last line had an end
        state.update(last[:-1] if total == size + 1 else last)
        return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([state.hexdigest()])], names=["file", "sha256"])

    for batch in batches:
        for now, bytes_, content in zip(*(batch.column(n).to_pylist() for n in ("file", "bytes", "content"))):
            if now != file:
                if file is not None:
                    yield done()
                file, state, last, total, size = now, hashlib.sha256(), b"", 0, bytes_
            state.update(last)
            last, total = content, total + len(content)
    if file is not None:
        yield done()


def file_digests(spark: SparkSession, paths: Sequence[str], buffer_bytes: int = 4 << 20) -> DataFrame:
    """Size and SHA-256 of files.

    A file is read line by line in splits, packed into buffers, and the buffers of one file pass through one task in
    order, which holds a buffer at a time: memory follows the longest line, not the file. Files whose name says that they
    are compressed are hashed as stored, whole. Empty files have no row, as Spark's readers pass over them.
    """
    listed = spark.read.format("binaryFile").load(list(paths))
    files = listed.select("path", F.col("length").alias("bytes"), F.col("_metadata.file_path").alias("file"))
    whole = listed.where(F.col("path").rlike(COMPRESSED)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("value").cast("binary").alias("line"))
    plain = lines.where(~F.col("file").rlike(COMPRESSED))
    buffers = plain.mapInArrow(_buffers(buffer_bytes), "file string, begin long, place long, content binary")
    sized = buffers.join(files.select("file", "bytes"), "file").repartition("file").sortWithinPartitions("file", "begin", "place")
    digests = sized.mapInArrow(_hash_files, "file string, sha256 string")
    return files.join(digests, "file").select("path", "bytes", "sha256").union(whole)


def preview(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, salts: int = 64) -> DataFrame:
    """First `n` rows per key.

    Spark trims each key to `n` rows before the shuffle for small `n`. Beyond its limit the rows
    are ranked in `salts` slices of every key first, so the last ranking sees salts * n rows.
    """
    def first(table: DataFrame, by: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return table.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")

    trimmed_by_spark = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n <= trimmed_by_spark:
        return first(df, list(keys))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    return first(first(salted, [*keys, "_salt"]), list(keys)).drop("_salt")


def take_positions(df: DataFrame, positions: DataFrame, on: Sequence[str] = ("Scenario", "RowID")) -> DataFrame:
    """Rows whose key is listed in `positions`."""
    return df.join(positions.select(*on).distinct(), list(on), "left_semi")
