"""All registered queries."""

from voxtide.plans import (  # noqa: F401
    rows_queries, stats_queries, series_queries, store_queries, text_queries, metric_queries,
    model_queries, invariant_queries, stream_queries,
)
from voxtide.plans.registry import QUERIES

flagship = QUERIES["flagship"].run

__all__ = ["QUERIES", "flagship"]
