"""Names and keys derived from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scenario_key(filename: Column) -> Column:
    """Stable key of a capture file: no copy counter, no extension, dash-separated words."""
    text = F.regexp_replace(F.lower(filename), r"\(\d+\)", "")
    text = F.replace(F.replace(text, F.lit(".pcap_iscx.csv"), F.lit("")), F.lit(".csv"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_stem(filename: Column) -> Column:
    """Base name without its last extension, unsafe runs replaced by an underscore."""
    return F.regexp_replace(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9._-]+", "_")


def slug(text: Column) -> Column:
    """Lower-case identifier; spaces, dashes and slashes become underscores."""
    return F.translate(F.lower(text), " -/", "___")


def safe_name(text: Column) -> Column:
    """File-name component: unsafe runs become one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def contains_text(column: Column, token: str) -> Column:
    """Case-insensitive substring test, false for null."""
    return F.coalesce(F.lower(column.cast("string")).contains(token.lower()), F.lit(False))


def truthy(column: Column) -> Column:
    """Whether text reads as true."""
    return F.coalesce(F.lower(F.trim(column.cast("string"))).isin("true", "1", "yes"), F.lit(False))
