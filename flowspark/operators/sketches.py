"""Mergeable sketches of quantiles and distinct counts: stored once per group of rows, merged without reading rows again.

An approximate option beside the exact operators. A quantile's rank is off by about RANK_ERROR of the rows, a distinct count
by about DISTINCT_ERROR of itself (a bound that some hundredth of all answers exceeds).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.schema import q
from flowspark.session import materialize

KLL_SIZE, RANK_ERROR = 400, 0.0133
HLL_BITS, DISTINCT_ERROR = 14, 0.03


def sketch_table(df: DataFrame, keys: Sequence[str], quantiles: Sequence[str] = (), distinct: Sequence[str] = ()) -> DataFrame:
    """One stored row per key: ``rows``, a sketch ``quantiles_<column>`` of each column's values and a sketch
    ``distinct_<column>`` of its different ones. Nulls are left out of sketches; a group without values has a null one."""
    values = [F.kll_sketch_agg_double(F.col(q(c)).cast("double"), F.lit(KLL_SIZE)).alias(f"quantiles_{c}") for c in quantiles]
    counts = [F.hll_sketch_agg(F.col(q(c)).cast("string"), F.lit(HLL_BITS)).alias(f"distinct_{c}") for c in distinct]
    return materialize(df.groupBy(*keys).agg(F.count("*").alias("rows"), *values, *counts), "sketches")


def merged_quantiles(sketches: DataFrame, column: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Estimated quantiles of a column over all sketches of a key: keys, prob and quantile; no rows for a key without values."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double(F.col(q(f"quantiles_{column}"))).alias("_s")).where(
        F.kll_sketch_get_n_double("_s") > 0)
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    found = F.arrays_zip(wanted.alias("prob"), F.kll_sketch_get_quantile_double("_s", wanted).alias("quantile"))
    return merged.select(*keys, F.explode(found).alias("_f")).select(*keys, "_f.prob", "_f.quantile")


def merged_distinct(sketches: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Estimated number of different values of a column over all sketches of a key: keys and distinct."""
    return sketches.groupBy(*keys).agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(F.col(q(f"distinct_{column}")))), F.lit(0)).alias("distinct"))
