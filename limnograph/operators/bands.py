"""Historic monthly ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.functions.calendar import month_full, month_label, with_calendar
from limnograph.functions.nulls import strict_agg
from limnograph.operators.quantiles import group_quantiles

SERIES = ["Park", "Site", "Characteristic"]
MONTHLY = [*SERIES, "month_num"]
# Band probabilities and the sample count from which bands are given.
BAND_QUANTILES = {
    "median_val": 0.5,
    "lower_95": 0.025,
    "upper_95": 0.975,
    "lower_50": 0.25,
    "upper_50": 0.75,
}
MIN_SAMPLES = 4


def year_of_min(value: str = "ValueCen", year: str = "year") -> Column:
    """Year of the smallest value; a tie goes to the latest year."""
    return F.expr(f"-min(CASE WHEN {value} IS NOT NULL THEN struct({value} AS v, -{year} AS y) END).y")


def year_of_max(value: str = "ValueCen", year: str = "year") -> Column:
    return F.expr(f"max(CASE WHEN {value} IS NOT NULL THEN struct({value} AS v, {year} AS y) END).y")


def last_by_date(value: str = "ValueCen", date: str = "Date") -> Column:
    """Last value in date order; a tie goes to the larger value."""
    return F.expr(f"max(CASE WHEN {date} IS NOT NULL THEN struct({date} AS d, {value} AS v) END).v")


def monthly_bands(hist: DataFrame, *, value: str = "ValueCen", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Count, median, extremes with their years, and the 100/95/50 % bands of every month.

    ``num_samps`` counts missing values too and decides whether a month is kept; the quantiles
    skip them, and a month without any value is dropped.
    """
    v = F.col(value)
    rows = with_calendar(hist).select(*MONTHLY, "year", value)
    stats = group_quantiles(
        rows, MONTHLY, value, BAND_QUANTILES, extra=[F.max("year").alias("_year")],
        aggs=[
            F.sum("_w").alias("num_samps"),
            F.min(v).alias("min_val"),
            F.max(v).alias("max_val"),
            # One cell per value, with its latest year: there are no ties left.
            F.min_by("_year", v).alias("year_min"),
            F.max_by("_year", v).alias("year_max"),
        ],
    )
    kept = stats.where((F.col("num_samps") >= min_samples) & F.col("lower_50").isNotNull())
    return kept.select(
        *SERIES, month_label(F.col("month_num")).alias("month"), "month_num", "num_samps",
        "median_val", "min_val", "max_val",
        F.col("min_val").alias("lower_100"), F.col("max_val").alias("upper_100"),
        "lower_95", "upper_95", "lower_50", "upper_50", "year_min", "year_max",
    )


def percentile_bands(hist: DataFrame, *, value: str = "ValueCen", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """The bands alone, with full month names and no extremes besides the 100 % band."""
    bands = monthly_bands(hist, value=value, min_samples=min_samples)
    month = month_full(F.make_date(F.lit(2000), F.col("month_num"), F.lit(1)))
    return bands.select(
        *SERIES, month.alias("month"), F.col("month_num").alias("mon_num"), "num_samps",
        "median_val", "lower_100", "upper_100", "lower_95", "upper_95", "lower_50", "upper_50",
    )


def mean_and_95_band(hist: DataFrame, *, value: str = "ValueCen", min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Mean (missing as soon as one value is missing), count and the 95 % band of every month."""
    v = F.col(value)
    rows = with_calendar(hist).select(*MONTHLY, value)
    stats = group_quantiles(
        rows, MONTHLY, value, {"lower_pct": 0.025, "upper_pct": 0.975},
        aggs=[
            strict_agg(F.sum(v * F.col("_w")) / F.sum("_w"), v).alias("mean"),
            F.sum("_w").alias("num_samps"),
        ],
    )
    month = month_full(F.make_date(F.lit(2000), F.col("month_num"), F.lit(1)))
    kept = stats.where((F.col("num_samps") >= min_samples) & F.col("lower_pct").isNotNull())
    return kept.select(*SERIES, month.alias("month"), "month_num", "mean", "num_samps",
                       "lower_pct", "upper_pct")


def site_month_range(hist: DataFrame, *, value: str = "ValueCen",
                     keys: Sequence[str] = ("Park", "Site", "Characteristic")) -> DataFrame:
    """Extremes of every month; missing as soon as one value is missing."""
    v = F.col(value)
    rows = hist.withColumn("month_num", F.month("Date"))
    return rows.groupBy(*keys, "month_num").agg(
        strict_agg(F.max(v), v).alias("max_val"),
        strict_agg(F.min(v), v).alias("min_val"),
    )
