"""Registered queries of the text operators: each applies its operator, as used in production, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import (
    bpe, decontaminate, language, line_dedup, near_dup, packing, periodic_runs, prefix_trie, quality, sharding, suffix_dedup, toxicity, urls,
)
from flowspark.llm.common import held_out
from flowspark.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id"))
    model = toxicity.fit(docs.where("NOT held_out"), table(spark, sf_dir, "labels").where(~held_out("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", "n_spans",
        F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = r"""
WITH pieces AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
    FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '[^\x09-\x0D\x20]+')) AS words FROM pieces),
filled AS (
    SELECT doc_id, n, line, words, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos,
           lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS following
    FROM counted WHERE words > 0),
copies AS (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AND words >= 20 AS later_line,
           following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, pos) > 1 AS later_run
    FROM filled),
gone AS (
    SELECT doc_id, n, pos, later_line OR later_run OR coalesce(lag(later_run) OVER (PARTITION BY doc_id ORDER BY pos), false) AS cut
    FROM copies),
runs AS (
    SELECT doc_id, n, cut, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM gone),
kept AS (
    SELECT c.doc_id, count(*) AS n_lines, count(*) FILTER (r.cut) AS n_removed, count(*) FILTER (r.begins) AS n_spans,
           string_agg(c.line, chr(10) ORDER BY c.n) FILTER (NOT coalesce(r.cut, false)) AS kept_text
    FROM counted c LEFT JOIN runs r ON c.doc_id = r.doc_id AND c.n = r.n GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, coalesce(k.n_spans, 0) AS n_spans,
       sha256(coalesce(k.kept_text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.rate(docs, chain).drop("text", "content_lines")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    model = language.fit(docs.where("NOT held_out"))
    return language.identify(docs.drop("lang"), model).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.ids_digest().alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


@query
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_components(docs, similarity=0.85).drop("row_key")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op8_decontaminate"] = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
tests AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
cut AS (SELECT item, words, least(len(words), 13) AS size, unnest(range(1, greatest(2, len(words) - 11))) AS k FROM tests WHERE len(words) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(words[k : k + size - 1], ' ') AS win FROM cut),
places AS (SELECT doc_id, words, s.size, unnest(range(1, len(words) - s.size + 2)) AS k FROM docs, (SELECT DISTINCT size FROM windows) s),
hits AS (SELECT p.doc_id, p.k, p.size, w.item FROM places p JOIN windows w
  ON w.size = p.size AND w.win = array_to_string(p.words[p.k : p.k + p.size - 1], ' ')),
hit_words AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(len(i.items), 0) AS n_items,
  sha256(coalesce(array_to_string(i.items, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(d.words) AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items i ON i.doc_id = d.doc_id
"""

SQL["op9_near_duplicates"] = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x09-\x0D\x20]+') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS k FROM docs WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[k : k + 4], ' ') AS shingle FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.seen),
found AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT f.doc_id, coalesce(s.n, 0) AS n_shingles, f.component_id, f.doc_id = f.component_id AS kept
FROM found f LEFT JOIN sizes s ON s.doc_id = f.doc_id
"""


@query
def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).drop("curve")


@query
def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, ids=False))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) of which a tenth repeat a block of their words up to the end, as the contract of op12 says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)))
    n = F.size("w")
    sized = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn(
        "p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    rest = n - F.col("a")
    block = F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int"))
    repeated = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(F.flatten(block), F.lit(1), rest))
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    no_run = F.expr("CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>)")
    # runs come by start and period, so the first of those with equal exponents stays
    best = F.aggregate("runs", no_run, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations (conv_id, seq) as the contract of op13 rebuilds them: the head of every fifth one stands before others."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % 5
    heads = convs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("first"), F.slice("seq", 1, 8).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("seq", 1, 0))
    return convs.withColumn("first", first).join(heads, "first", "left").select(
        "conv_id", F.concat(head, F.slice("seq", h + 1, F.greatest(F.size("seq") - h, F.lit(0)))).alias("seq"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = materialize(prefix_trie.conversations(table(spark, sf_dir, "conversations")), "conversations")
    nodes, members = prefix_trie.trie(rebuilt(convs))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved_bytes").alias("saved_tokens")]
    digests = prefix_trie.ids_digest(members)
    ended = nodes.where("seq_key IS NOT NULL").join(digests, "seq_key").select(*columns, "ends_sha256")
    return ended.union(nodes.where("seq_key IS NULL").select(*columns, F.sha2(F.lit(b""), 256).alias("ends_sha256")))


SQL["op13_prefix_trie"] = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
hashed AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 9 AS h
  FROM ids),
own AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn_of,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, o.pos, o.turn_of FROM hashed c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5 AND o.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1 AS part, o.pos, o.turn_of FROM hashed c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
seqs AS (SELECT i.conv_id, coalesce(list(r.turn_of ORDER BY part, pos) FILTER (r.turn_of IS NOT NULL), []) AS seq FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY 1),
placed AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM seqs),
prefixes AS (SELECT conv_id, depth, sha256(CAST(seq[1:depth] AS VARCHAR)) AS prefix, sha256(CAST(seq[1:depth - 1] AS VARCHAR)) AS up,
  len(seq) = depth AS ends, CASE WHEN depth > 0 THEN strlen(seq[depth].text) ELSE 0 END AS size FROM placed),
nodes AS (SELECT depth, prefix, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY 1, 2),
children AS (SELECT depth - 1 AS depth, up AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
facts AS (SELECT n.*, coalesce(c.n, 0) AS n_children, (n.n_convs - 1) * n.size AS gain FROM nodes n LEFT JOIN children c USING (depth, prefix)),
sums AS (SELECT p.depth, p.prefix, sum(f.gain) AS saved, count(*) FILTER (f.n_children = 0) AS leaves
  FROM facts f JOIN prefixes p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY 1, 2)
SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s USING (depth, prefix) LEFT JOIN nodes u ON u.depth = f.depth - 1 AND u.prefix = f.up
"""
