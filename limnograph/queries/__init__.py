"""Every operator as a named query over a data folder."""

from limnograph.queries import (  # noqa: F401  (importing registers the queries)
    aggregates,
    datasets,
    filters,
    joins,
    scalars,
    scans,
    statistics,
    thresholds,
)
from limnograph.queries.base import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
