"""Data checks, reported as a status per series instead of stopping the job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions.calendar import in_years
from limnograph.operators.bands import SERIES


def series_status(pairs: DataFrame, meas: DataFrame, *, year_historic: int, year_current: int) -> DataFrame:
    """For every (site, characteristic) pair: its row counts and what is missing, if anything."""
    current = in_years(year_current, year_current)
    history = in_years(year_historic, year_current - 1)
    counts = meas.where(in_years(year_historic, year_current)).groupBy(*SERIES).agg(
        F.count_if(history).alias("n_history"), F.count_if(current).alias("n_current")
    )
    joined = pairs.join(counts, SERIES, "left").fillna(0, ["n_history", "n_current"])
    status = (
        F.when((F.col("n_history") == 0) & (F.col("n_current") == 0), "no_rows")
        .when(F.col("n_current") == 0, "no_current")
        .when(F.col("n_history") == 0, "no_history")
        .otherwise("ok")
    )
    return joined.withColumn("status", status)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Strict mode: fail when there is nothing to report."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_single_year(year: int) -> int:
    if not isinstance(year, int) or isinstance(year, bool) or not 1000 <= year <= 9999:
        raise ValueError("year must be one four-digit number")
    return year
