"""URL filters: the longest fitting host and path rule decides, gradient-boosted trees judge the rest.

The trees see lexical features only (lengths, depths, digit ratio, entropy, parameter counts and how often URLs with the
same suffix are blocked). Suffixes and endings are counted over all URLs that the rules label; the trees are fitted on a
sample of these of bounded size.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import lookup_join, materialize

#: Rule text and verdict; a rule fits its host and all subdomains below its path.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"),
         ("net/fr/", "block")]
FIT_ROWS = 20_000
FEATURES = ["url_chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "entropy", "parameters",
            "hyphens", "has_fragment", "secure", "suffix_blocked", "ending_blocked"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty for null or without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), upper, lower), F.regexp_extract(text, pattern, 2)


def matched_rule(rules: list[tuple[str, str]], host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def lexical(df: DataFrame) -> DataFrame:
    """Features of url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    length = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / length
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "url_chars": F.length(url).cast("double"), "host_chars": F.length("host").cast("double"),
        "path_chars": F.length("path").cast("double"),
        "host_depth": (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double"),
        "path_depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / length,
        "entropy": F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda acc, c: F.when(
            F.length(c) > 0, acc - share(c) * F.log2(share(c))).otherwise(acc)),
        "parameters": F.when(F.length(query) > 0, F.size(F.split(query, "&"))).otherwise(0).cast("double"),
        "hyphens": (F.length(url) - F.length(F.translate(url, "-", ""))).cast("double"),
        "has_fragment": url.contains("#").cast("double"), "secure": url.startswith("https").cast("double"),
        "suffix": F.substring_index(F.col("host"), ".", -1),
        "ending": F.regexp_extract("path", r"(\.[A-Za-z]+|/)?$", 1),
    })


def label_counts(labelled: DataFrame) -> DataFrame:
    """By suffix and ending: labelled URLs (n) and blocked ones, each url once, and the rows of both."""
    urls = labelled.groupBy("url", "suffix", "ending", "label").agg(F.count("*").alias("rows"))
    return urls.groupBy("suffix", "ending").agg(
        F.count("*").alias("n"), F.sum("label").alias("blocked"), F.sum("rows").alias("rows"),
        F.sum(F.col("label") * F.col("rows")).alias("blocked_rows"))


def blocked_share(counts: DataFrame, key: str) -> DataFrame:
    """Smoothed share of blocked URLs by key; a key with fewer than 20 labelled URLs is left to the average."""
    return counts.groupBy(key).agg(F.sum("n").alias("n"), ((F.sum("blocked") + 1) / (F.sum("n") + 2)).alias(
        f"{key}_blocked")).where("n >= 20").drop("n")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Give every page its host, path, rule, verdict (allow or block) and block_score (the trees' probability, null
    where a rule decides).

    Needs url; all rows and columns are kept, columns of the five names replaced. A null url or one without `://` has
    empty host and path, and the trees judge it. The trees learn from at most about `fit_rows` URLs that rules label,
    chosen by a hash of the url, each once; how often a suffix or ending is blocked is counted over all of them; where the rules give one label only, that label is the verdict, without any it is
    allow. Repeated rows get equal verdicts; an empty table gives no rows.
    """
    rules = RULES if rules is None else rules
    kept = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in (
        "host", "path", "rule", "verdict", "block_score")]).alias("_row"), F.col("url").alias("url"))
    host, path = host_and_path(F.col("url"))
    split = kept.withColumns({"host": host, "path": path})
    ruled = lexical(split.withColumn("match", matched_rule(rules, F.col("host"), F.col("path"))))
    labelled = ruled.where("match IS NOT NULL").withColumn("label", (F.col("match.verdict") == "block").cast("double"))
    counts = materialize(label_counts(labelled), "url-counts")
    total, blocked = counts.agg(F.sum("rows"), F.sum("blocked_rows")).first()
    if not total or blocked in (0, total):
        only = "block" if total and blocked else "allow"
        scored = ruled.withColumn("block_score", F.lit(float(only == "block")))
    else:
        buckets = 1 << 20
        sample = labelled.where(F.pmod(F.xxhash64("url"), F.lit(buckets)) < int(buckets * min(1, fit_rows / total)) + 1)
        sample = sample.drop("_row").dropDuplicates(["url"]).persist()  # a repeated url counts once
        average = blocked / total

        def with_statistics(df: DataFrame) -> DataFrame:
            for key in ("suffix", "ending"):
                df = lookup_join(df, blocked_share(counts, key), [key], "left")
            return df.fillna(average, ["suffix_blocked", "ending_blocked"])

        assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
        trees = GBTClassifier(maxIter=20, maxDepth=4, seed=7, featuresCol="features", labelCol="label")
        model = trees.fit(assemble.transform(with_statistics(sample)).select("features", "label"))
        scored = model.transform(assemble.transform(with_statistics(ruled))).withColumn(
            "block_score", vector_to_array("probability")[1])
    by_trees = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("_row.*", "host", "path", F.col("match.rule").alias("rule"),
                         F.coalesce("match.verdict", by_trees).alias("verdict"),
                         F.when(F.col("match").isNull(), F.col("block_score")).alias("block_score"))
