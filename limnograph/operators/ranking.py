"""First, last, duplicated and ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def duplicated(pairs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Mark the second and later occurrence of ``keys`` in ``order`` (unique within the keys).

    The first occurrence is a minimum, so nothing is sorted within a group.
    """
    first = pairs.groupBy(*keys).agg(F.min(order).alias("_first"))
    marked = pairs.join(first, list(keys))
    return marked.withColumn("is_dup", F.col(order) != F.col("_first")).drop("_first")


def first_match(df: DataFrame, keys: Sequence[str], matches: dict[str, Column],
                index: str) -> DataFrame:
    """Per group and condition: whether a row matches, and the first index that does."""
    aggs = []
    for name, condition in matches.items():
        hit = F.coalesce(condition, F.lit(False))
        aggs.append(F.bool_or(hit).alias(f"has_{name}"))
        aggs.append(F.min(F.when(hit, F.col(index))).alias(f"first_{name}"))
    return df.groupBy(*keys).agg(*aggs)


def line_segments(bands: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each point of a monthly line with the next month's point; at most 12 rows per group."""
    order = W.partitionBy(*keys).orderBy("month_num")
    return bands.withColumns(
        {
            "next_month_num": F.lead("month_num").over(order),
            f"next_{value}": F.lead(value).over(order),
        }
    )


def collapse_rows(table: DataFrame, group: Sequence[str], order: Sequence[str],
                  columns: Sequence[str]) -> DataFrame:
    """Flag the cells that repeat the row above, within ``group`` in ``order``."""
    above = W.partitionBy(*group).orderBy(*order)
    return table.withColumns(
        {
            f"{c}_repeats": (F.row_number().over(above) > 1)
            & F.col(c).eqNullSafe(F.lag(c).over(above))
            for c in columns
        }
    )
