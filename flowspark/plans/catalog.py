"""All registered queries."""

from __future__ import annotations

from flowspark.plans import (  # noqa: F401
    catalog_clean, catalog_correlate, catalog_files, catalog_metrics, catalog_models, catalog_sampling, catalog_soc,
)
from flowspark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
