"""Timestamp parsing and session buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layouts found in the captures, day before month.
DAY_FIRST_LAYOUTS = [
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy h:mm:ss a", "d/M/yyyy h:mm a",
]
ISO_LAYOUTS = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd"]


def parse_mixed_timestamp(raw: Column) -> Column:
    """Read a timestamp in any known layout; unreadable text gives null."""
    text = F.trim(raw.cast("string"))
    tries = [F.try_to_timestamp(text, F.lit(layout)) for layout in DAY_FIRST_LAYOUTS + ISO_LAYOUTS]
    return F.coalesce(*tries, text.try_cast("timestamp"))


def bucket_start(ts: Column, minutes: int) -> Column:
    """Start of the tumbling bucket, kept as null for a null time."""
    size = minutes * 60 * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(size)) * F.lit(size))


def iso_text(ts: Column) -> Column:
    """UTC ISO-8601 text; a fraction appears only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, F.coalesce(fraction, F.lit("")), F.lit("+00:00"))


def session_group_id(scenario: Column, source: Column, target: Column, port: Column,
                     protocol: Column, ts: Column, minutes: int) -> Column:
    """Key of a session-like group: same endpoints, port and protocol in one time bucket."""
    parts = [F.coalesce(F.trim(c.cast("string")), F.lit("MISSING")) for c in (source, target, port, protocol)]
    bucket = F.date_format(bucket_start(ts, minutes), "yyyy-MM-dd HH:mm:ss")
    return F.concat_ws("|", scenario, *parts, F.coalesce(bucket, F.lit("NO_TIME")))


def strata_key(scenario: Column, label: Column) -> Column:
    return F.concat(scenario, F.lit("::"), label.cast("string"))
