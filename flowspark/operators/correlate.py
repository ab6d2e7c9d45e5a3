"""Source correlation: exact rolling windows over the flows of every source.

Each flow enters its source's window at its own time and leaves it just after ``time + W``. The
state of the window at a flow is therefore a running sum of entries and exits.

Exits of one instant are told apart by RowID, so a cut may divide them, and an endpoint or port enters and leaves once per stretch of use,
found from its first and last use in each slice of time. The sums run along (time, phase, RowID)
in ranges cut by sampled ranks (see ``prefix``), so a source may own a third of all flows, or all
flows of one instant, and still spread over as many tasks as its share of rows asks for.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.numeric import finite, ratio
from flowspark.functions.times import iso_text, parse_mixed_timestamp
from flowspark.operators.prefix import running_totals
from flowspark.schema import q, resolve_alias
from flowspark.session import materialize, null_safe

KEY = ["InputFile", "SourceIP"]
COUNTS = ["WindowFlowCount", "WindowUniqueDestinationPorts", "WindowUniqueDestinationEndpoints",
          "WindowSYNFlows", "WindowRSTFlows", "WindowNoResponseFlows"]
ENTERING, LEAVING = 0, 1


@dataclass(frozen=True)
class ScanRule:
    """A scan: enough SYN flows to enough ports from one source within the window."""

    window_seconds: float = 10.0
    minimum_unique_ports: int = 20
    minimum_syn_flows: int = 20
    slice_seconds: float | None = None

    @property
    def window_us(self) -> int:
        return round(self.window_seconds * 1_000_000)

    @property
    def slice_us(self) -> int:
        """Length of a time slice; never longer than the window."""
        wanted = self.window_us if self.slice_seconds is None else round(self.slice_seconds * 1_000_000)
        return max(1, min(wanted, self.window_us))


def prepare_flows(df: DataFrame, input_file: Column, default_scenario: Column, check: bool = True) -> DataFrame:
    """Typed view of a flow table for correlation, whatever names its columns carry.

    With `check` the rows are validated first; unreadable times or ports raise with counts. Without
    a row-id column rows are numbered as read: increasing, but with gaps (see ``with_row_id``).
    """
    names = df.columns

    def required(logical: str) -> Column:
        return F.col(q(resolve_alias(names, logical, required=True)))

    def number(logical: str) -> Column:
        found = resolve_alias(names, logical)
        value = F.lit(None) if found is None else finite(F.col(q(found)).cast("string").try_cast("double"))
        return F.coalesce(value, F.lit(0.0))

    def text(logical: str, default: Column) -> Column:
        found = resolve_alias(names, logical)
        return default if found is None else F.coalesce(F.col(q(found)).cast("string"), default)

    time = required("timestamp")
    typed = dict(df.dtypes)[resolve_alias(names, "timestamp")].startswith("timestamp")
    row_id = resolve_alias(names, "row_id")
    port = required("destination_port").cast("string").try_cast("double")
    view = df.select(
        F.coalesce(required("source_ip").cast("string"), F.lit("MISSING")).alias("SourceIP"),
        F.coalesce(required("destination_ip").cast("string"), F.lit("MISSING")).alias("DestinationIP"),
        (time.cast("timestamp") if typed else parse_mixed_timestamp(time)).alias("Timestamp"),
        port.try_cast("int").alias("DestinationPort"),
        number("syn_count").alias("SYNCount"),
        number("rst_count").alias("RSTCount"),
        number("ack_count").alias("ACKCount"),
        number("backward_packets").alias("BackwardPackets"),
        text("scenario", default_scenario).alias("Scenario"),
        text("ground_truth", F.lit("UNKNOWN")).alias("GroundTruth"),
        (F.monotonically_increasing_id() if row_id is None else F.col(q(row_id)).cast("long")).alias("RowID"),
        input_file.alias("InputFile"),
    )
    if check:
        bad = view.agg(
            F.count_if(F.col("Timestamp").isNull()).alias("times"),
            F.count_if(F.col("DestinationPort").isNull()).alias("ports"),
        ).first()
        if bad["times"]:
            raise ValueError(f"{bad['times']} rows have invalid timestamps")
        if bad["ports"]:
            raise ValueError(f"{bad['ports']} rows have invalid destination ports")
    return view


def _deltas(**given: Column) -> list[Column]:
    return [given.get(name, F.lit(0)).cast("long").alias(name) for name in COUNTS]


def _spans(slices: DataFrame, what: list[str], rule: ScanRule, count: str) -> DataFrame:
    """Entry and exit events of every value of `what`, from its first and last use per slice."""
    order = Window.partitionBy(*KEY, *what).orderBy("_slice")
    seen = slices.select(
        *KEY, *what, "_first", "_last",
        F.lag("_last").over(order).alias("_before"), F.lead("_first._at").over(order).alias("_after"),
    )
    window = F.lit(rule.window_us)
    opens = F.col("_before").isNull() | (F.col("_first._at") - F.col("_before") > window)
    closes = F.col("_after").isNull() | (F.col("_after") - F.col("_last") > window)
    enter = F.when(opens, F.struct(
        F.col("_first._at").alias("_at"), F.lit(ENTERING).alias("_phase"),
        F.col("_first.RowID").alias("_pos"), F.lit(1).cast("long").alias("_d"),
    ))
    leave = F.when(closes, F.struct(
        (F.col("_last") + window).alias("_at"), F.lit(LEAVING).alias("_phase"),
        F.lit(0).cast("long").alias("_pos"), F.lit(-1).cast("long").alias("_d"),
    ))
    events = seen.select(*KEY, F.explode(F.array_compact(F.array(enter, leave))).alias("_e"))
    return events.select(
        *KEY, "_e._at", "_e._phase", "_e._pos", F.lit(0).alias("_own"), *_deltas(**{count: F.col("_e._d")})
    )


def _flags() -> dict[str, Column]:
    return dict(
        WindowFlowCount=F.lit(1), WindowSYNFlows=(F.col("SYNCount") > 0).cast("int"),
        WindowRSTFlows=(F.col("RSTCount") > 0).cast("int"),
        WindowNoResponseFlows=(F.col("BackwardPackets") <= 0).cast("int"),
    )


def rolling_source_counts(flows: DataFrame, rule: ScanRule = ScanRule()) -> DataFrame:
    """State of the source's window at every flow, counting flows up to and including it.

    Flows are ordered by (Timestamp, RowID) within (InputFile, SourceIP); a flow exactly one
    window old still counts. Adds the six ``Window…`` columns to the flow.
    """
    window, length = F.lit(rule.window_us), F.lit(rule.slice_us)
    base = flows.withColumn("_at", F.unix_micros("Timestamp"))
    flags = _flags()
    payload = [c for c in flows.columns if c not in KEY]
    own = base.select(
        *KEY, "_at", F.lit(ENTERING).alias("_phase"), F.col("RowID").alias("_pos"), F.lit(1).alias("_own"),
        *_deltas(**flags), F.struct(*payload).alias("_row"),
    )
    exits = base.select(
        *KEY, (F.col("_at") + window).alias("_at"), F.lit(LEAVING).alias("_phase"), F.col("RowID").alias("_pos"),
        F.lit(0).alias("_own"), *_deltas(**{k: -v for k, v in flags.items()}),
    )
    first, last = F.min(F.struct("_at", "RowID")), F.max("_at")
    endpoints = (
        base.groupBy(*KEY, "DestinationIP", "DestinationPort", F.floor(F.col("_at") / length).alias("_slice"))
        .agg(first.alias("_first"), last.alias("_last"))
    )
    ports = endpoints.groupBy(*KEY, "DestinationPort", "_slice").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    events = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [own, exits,
         _spans(endpoints, ["DestinationIP", "DestinationPort"], rule, "WindowUniqueDestinationEndpoints"),
         _spans(ports, ["DestinationPort"], rule, "WindowUniqueDestinationPorts")],
    )
    # stored, because cutting it into ranges reads it twice
    running = running_totals(materialize(events, "events"), KEY, ["_at", "_phase", "_pos", "_own"], COUNTS, keep="_own")
    return running.select(*KEY, "_row.*", *[F.col(f"cum_{c}").alias(c) for c in COUNTS])


def _crosses(rule: ScanRule) -> Column:
    return (F.col("WindowUniqueDestinationPorts") >= rule.minimum_unique_ports) & (
        F.col("WindowSYNFlows") >= rule.minimum_syn_flows
    )


def source_states(rolled: DataFrame, rule: ScanRule = ScanRule()) -> DataFrame:
    """Everything the reports need about a source, including its first alerting flow, if any.

    Flows stand sorted by source, so a task passes on a row a source; endpoints and ports are counted apart, collapsed per
    endpoint and then per port, so no task holds a source's endpoints.
    """
    flow = F.struct("Timestamp", "RowID", "DestinationIP", "DestinationPort", "Scenario", "GroundTruth", *COUNTS)
    totals = rolled.groupBy(*KEY).agg(
        F.min(F.struct("Timestamp", "RowID", "Scenario", "GroundTruth")).alias("_head"),
        F.min(F.when(_crosses(rule), flow)).alias("_alert"),
        F.max("Timestamp").alias("_last"), F.count("*").alias("_rows"),
        F.count_if(F.col("SYNCount") > 0).alias("_syn"), F.count_if(F.col("RSTCount") > 0).alias("_rst"),
        F.count_if(F.col("BackwardPackets") <= 0).alias("_silent"), *[F.max(c).alias(c) for c in COUNTS],
    )
    per_port = (
        rolled.groupBy(*KEY, "DestinationIP", "DestinationPort").agg(F.lit(1).alias("_one"))
        .groupBy(*KEY, "DestinationPort").agg(F.count("*").alias("_endpoints"))
    )
    used = per_port.groupBy(*KEY).agg(F.count("*").alias("_ports"), F.sum("_endpoints").alias("_endpoints"))
    return null_safe(totals, used, KEY)


def first_alerts(states: DataFrame, rule: ScanRule = ScanRule()) -> DataFrame:
    """One alert per source, at the first flow where both thresholds hold."""
    reason = (
        f"At least {rule.minimum_syn_flows} SYN-bearing flows reached at least "
        f"{rule.minimum_unique_ports} unique destination ports within {rule.window_seconds:g} seconds."
    )
    return states.where(F.col("_alert").isNotNull()).select(
        iso_text(F.col("_alert.Timestamp")).alias("AlertTimestamp"), "SourceIP", "_alert.DestinationIP",
        F.lit(float(rule.window_seconds)).alias("WindowSeconds"),
        *[f"_alert.{c}" for c in COUNTS],
        F.col("_alert.DestinationPort").alias("TriggerDestinationPort"),
        F.col("_alert.RowID").alias("TriggerRowID"),
        F.lit("Cross-flow behavioral correlation").alias("Detector"), F.lit("PORT_SCAN").alias("Detection"),
        F.lit("High").alias("Severity"), F.lit("Reconnaissance").alias("MITRETactic"),
        F.lit("T1595").alias("MITRETechniqueID"), F.lit("Active Scanning").alias("MITRETechniqueName"),
        F.lit(reason).alias("Reason"), "InputFile", "_head.Scenario", "_head.GroundTruth",
    )


def source_summary(states: DataFrame, rule: ScanRule = ScanRule()) -> DataFrame:
    """Totals, window maxima and verdict of every source."""
    first, last = F.col("_head.Timestamp"), F.col("_last")
    seconds = (F.unix_micros(last) - F.unix_micros(first)) / F.lit(1_000_000.0)
    flag = F.col("_alert").isNotNull()
    maxima = dict(zip(COUNTS, [
        "MaxFlowsInWindow", "MaxUniqueDestinationPortsInWindow", "MaxUniqueDestinationEndpointsInWindow",
        "MaxSYNFlowsInWindow", "MaxRSTFlowsInWindow", "MaxNoResponseFlowsInWindow",
    ]))
    rows = F.col("_rows")
    return states.select(
        "InputFile", "_head.Scenario", "_head.GroundTruth", "SourceIP",
        iso_text(first).alias("FirstTimestamp"), iso_text(last).alias("LastTimestamp"),
        seconds.alias("DurationSeconds"), rows.alias("TotalFlows"),
        F.col("_ports").alias("TotalUniqueDestinationPorts"),
        F.col("_endpoints").alias("TotalUniqueDestinationEndpoints"), F.col("_syn").alias("TotalSYNFlows"),
        F.col("_rst").alias("TotalRSTFlows"), F.col("_silent").alias("TotalNoResponseFlows"),
        F.coalesce(ratio(rows, seconds), rows.cast("double")).alias("AverageFlowsPerSecond"),
        F.lit(float(rule.window_seconds)).alias("WindowSeconds"),
        *[F.col(c).alias(name) for c, name in maxima.items()],
        F.lit(rule.minimum_unique_ports).alias("MinimumUniquePortsThreshold"),
        F.lit(rule.minimum_syn_flows).alias("MinimumSYNFlowsThreshold"), flag.alias("CrossFlowScanFlag"),
        F.when(flag, "PORT_SCAN").otherwise("NO_SCAN_PATTERN").alias("Detection"),
        F.when(flag, "T1595 - Active Scanning").otherwise("").alias("MITREGroundTruth"),
    )


def correlate(flows: DataFrame, rule: ScanRule = ScanRule()) -> tuple[DataFrame, DataFrame]:
    """Summaries of all sources and the alerts among them."""
    states = materialize(source_states(rolling_source_counts(flows, rule), rule), "source-states")
    return source_summary(states, rule), first_alerts(states, rule)
