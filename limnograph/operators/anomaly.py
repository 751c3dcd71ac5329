"""Time series and above/below-average months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnograph.functions.calendar import with_calendar
from limnograph.functions.labels import axis_label
from limnograph.operators.bands import SERIES


def series(meas: DataFrame, *, censored: bool = False, deseason: bool = False,
           value: str = "ValueCen", facet: str | None = None, chars: DataFrame | None = None) -> DataFrame:
    """Points of every series.

    ``censored=False`` drops censored samples, ``True`` keeps and marks them. ``deseason`` puts every month in a panel
    of its own; ``facet`` (``Site`` or ``Characteristic``) puts what it names there, in front of the month. With
    ``chars`` every point has the assessment points of its series and the display name and unit of its facet.
    """
    if facet not in (None, "Site", "Characteristic"):
        raise ValueError(f"unknown facet {facet!r}")
    df = meas if censored else meas.where(~F.coalesce(F.col("Censored"), F.lit(False)))
    df = with_calendar(df)
    marker = F.when(F.col("Censored"), "censored").otherwise("measured")
    parts = ([F.col(facet)] if facet else []) + ([F.col("month")] if deseason else [])
    panel = F.concat_ws(" ", *parts) if parts else F.lit("all")
    points = df.select(
        *SERIES, "Date", "month", "month_num", "year", F.col(value).alias("value"),
        marker.alias("marker"), panel.alias("panel"),
    )
    if chars is None:
        return points
    names = chars.select(
        F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"), F.col("CharName").alias("Characteristic"),
        axis_label(F.col("DisplayName"), F.col("Units"), F.col("CharName")).alias("label"), "LowerPoint", "UpperPoint")
    return points.join(names, SERIES, "left")


def heat_anomaly(meas: DataFrame, *, value: str = "ValueCen") -> DataFrame:
    """Monthly mean minus the mean of the whole series.

    Rows are first reduced to one per month, so the window over a series is bounded by the
    calendar.
    """
    v = F.col(value)
    monthly = (
        with_calendar(meas.where(v.isNotNull()))
        .groupBy(*SERIES, "year", "month_num")
        .agg(F.sum(v).alias("_sum"), F.count(v).alias("n"))
    )
    whole = W.partitionBy(*SERIES)
    mean = F.sum("_sum").over(whole) / F.sum("n").over(whole)
    return (
        monthly.withColumn("series_mean", mean)
        .withColumn("month_mean", F.col("_sum") / F.col("n"))
        .withColumn("anomaly", F.col("month_mean") - F.col("series_mean"))
        .drop("_sum")
    )
