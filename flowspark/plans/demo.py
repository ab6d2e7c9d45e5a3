"""A compact, balanced set of flows with their context, for demonstrations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators import profile, sampling
from flowspark.schema import q
from flowspark.session import materialize
from flowspark.sources.tables import take_positions, write_report

IDS = ["Scenario", "RowID"]
LEAST_ROWS = 20


def demo_set(features: DataFrame, context: DataFrame, per_scenario: int = 250, ids: Sequence[str] = tuple(IDS),
             seed: int = sampling.SEED) -> DataFrame:
    """Half attack, half benign flows of every scenario, joined one to one to their context, in one shuffled order.

    A context column that features have too is called ``Context <name>``. ``DemoPosition`` (from 1) is the place of a row in
    the set, by the hash of its ids: scenarios and classes are mixed, and the order is the same in every run. Only the chosen
    rows, scenarios x `per_scenario`, are joined and ordered; a chosen row without context is an error.
    """
    if per_scenario < LEAST_ROWS:
        raise ValueError(f"at least {LEAST_ROWS} rows per scenario")
    chosen = materialize(sampling.demo_mix(features, per_scenario, ids, seed), "demo")
    twice = {c: f"Context {c}" for c in context.columns if c in features.columns and c not in ids}
    side = materialize(take_positions(context, chosen, ids).withColumnsRenamed(twice), "demo-context")
    place = F.row_number().over(Window.orderBy(sampling.hash_key(seed + 1, ids), *[F.col(q(c)) for c in ids]))
    return profile.align(chosen, side, ids).withColumn("DemoPosition", place)


def write_demo(features: DataFrame, context: DataFrame, out: str, per_scenario: int = 250) -> None:
    """The set as one CSV file with a header, in its order."""
    rows = demo_set(features, context, per_scenario)
    write_report(rows.orderBy("DemoPosition").drop("DemoPosition"), out)
