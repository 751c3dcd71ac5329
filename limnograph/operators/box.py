"""Box-plot statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.operators.joins import join_on
from limnograph.operators.quantiles import group_quantiles, value_cells

# Quartiles and the fence factor.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
FENCE = 1.5
STATS = ["n", "q1", "median", "q3", "lower_fence", "upper_fence"]


def _valued(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).select(*keys, value)


def box_fences(df: DataFrame, keys: Sequence[str], *, value: str = "ValueCen", method: str = "hazen") -> DataFrame:
    """Quartiles and fences of every group that has a value.

    The result is joined back to the rows for whiskers and for outliers; it ends in an exchange that both read.
    """
    stats = group_quantiles(_valued(df, keys, value), keys, value, QUARTILES, method=method,
                            aggs=[F.sum("_w").alias("n")])
    reach = (F.col("q3") - F.col("q1")) * FENCE
    return stats.select(
        *keys, "n", "q1", "median", "q3",
        (F.col("q1") - reach).alias("lower_fence"), (F.col("q3") + reach).alias("upper_fence"),
    ).hint("rebalance")


def box_stats(df: DataFrame, keys: Sequence[str], *, value: str = "ValueCen", method: str = "hazen",
              fences: DataFrame | None = None) -> DataFrame:
    """Quartiles, fences and whiskers: the most extreme values inside the fences.

    Equal values are merged before they meet the fences; the quartiles come from the same cells.
    """
    fences = box_fences(df, keys, value=value, method=method) if fences is None else fences
    cells = value_cells(_valued(df, keys, value), keys, value)
    inside = F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))
    return join_on(cells, fences, keys).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in STATS],
        F.min(F.when(inside, F.col(value))).alias("lower_whisker"),
        F.max(F.when(inside, F.col(value))).alias("upper_whisker"),
        F.sum(F.when(~inside, F.col("_w")).otherwise(0)).alias("n_outliers"),
    )


def beyond_fences(value: str = "ValueCen") -> Column:
    return (F.col(value) < F.col("lower_fence")) | (F.col(value) > F.col("upper_fence"))


def box_outliers(df: DataFrame, fences: DataFrame, keys: Sequence[str], *,
                 value: str = "ValueCen") -> DataFrame:
    """The rows outside their group's fences, with the statistics of their box."""
    return join_on(df.where(F.col(value).isNotNull()), fences, keys).where(beyond_fences(value))
