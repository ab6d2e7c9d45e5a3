"""A corpus pipeline out of the text operators: each stage takes what its predecessor kept, written and read again.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, all but the last with
the columns of `docs`. `run` applies them to the documents of a folder of tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import bpe, decontaminate, language, line_dedup, near_dup
from flowspark.llm.common import held_out
from flowspark.session import materialize

LEAST_LANGUAGE_SCORE = 0.3
SIMILARITY = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: not `und`, and scored at least LEAST_LANGUAGE_SCORE.

    Null, empty and letterless texts go, whatever else a row holds; so does every row where nothing could be learnt
    (no labelled text). The columns of `docs` stay as they are; repeated rows are treated alike.
    """
    model = language.fit(docs.where(~held_out("doc_id")).select("text", "lang"))
    # the operator replaces columns of its two names, so the row travels inside a struct
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")
    found = language.identify(row, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select("_row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of repeated line runs from the texts; n_chars follows. A document goes if that leaves it no
    word. Texts without repeats, null and wordless ones included, stay as they are."""
    columns = [c for c in docs.columns if c not in ("text", "n_chars")]
    row = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    cut = line_dedup.dedup_lines(row).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_removed") > 0
    fields = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        fields["n_chars"] = F.when(changed, F.length("kept_text").cast(kind)).otherwise(F.col("_row.n_chars"))
    fields |= {c: F.col(f"_row.`{c}`") for c in columns}
    return cut.select(*[fields[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word shingles at a similarity of 0.8: the one of least id.
    Documents without words are in no group and stay."""
    return near_dup.drop_near_duplicates(docs, SIMILARITY)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which windows of the benchmark cover at least a twentieth of the words; others are unchanged."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 (of the bytes that the ids stand for) of each text; a null
    text has no ids."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", identify_language), ("line dedup", dedup_lines), ("near duplicates", drop_near_duplicates),
          ("decontamination", remove_contaminated), ("encoding", encode)]
#: SQL can express neither the learnt languages nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over `documents`; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
