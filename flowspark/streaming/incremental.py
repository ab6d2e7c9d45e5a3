"""Scoring in bounded chunks: each new flow file is scored once, then never read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from flowspark.plans.score import Bundle, analyze

BATCH = "_batch"


def score_new_files(spark: SparkSession, folder: str, columns: Sequence[str], bundle: Bundle, out: str, checkpoint: str,
                    files_per_chunk: int = 16) -> int:
    """Score all CSV files of `folder` not scored before, a few files at a time.

    `columns` is the common header of the files. The checkpoint remembers finished files, so a
    restart after a failure continues with the next chunk; a repeated chunk replaces its own
    output. Returns the number of chunks written.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    source = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_chunk).csv(folder)
    chunks = []

    def write(chunk: DataFrame, number: int) -> None:
        analyze(chunk, bundle).write.mode("overwrite").parquet(f"{out}/{BATCH}={number}")
        chunks.append(number)

    query = (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return len(chunks)
