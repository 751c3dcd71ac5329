"""Historic boxes against the current year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions.calendar import month_label, with_calendar
from limnograph.operators.aggregates import axis_ends
from limnograph.operators.bands import MONTHLY, SERIES
from limnograph.operators.box import STATS, beyond_fences, box_fences, box_stats
from limnograph.operators.catalog import get_wdata
from limnograph.operators.filters import (
    LAKE_MONTHS,
    LAKE_NUTRIENTS,
    OTHER_MONTHS,
    STREAM_NUTRIENTS,
    historic,
    target_month,
    target_nutrient,
)
from limnograph.operators.thresholds import box_class, with_points

LAYER_COLUMNS = [
    *SERIES, "month", "month_num", "layer", "n", "q1", "median", "q3", "lower_fence", "upper_fence",
    "lower_whisker", "upper_whisker", "n_outliers", "Date", "year", "value", "pcolor", "UpperPoint",
    "line_start", "line_end",
]


def boxplot_rows(meas: DataFrame, sites: DataFrame, *, year_from: int, current_year: int,
                 category: str = "nutrients", lake_months: Sequence[int] = LAKE_MONTHS,
                 other_months: Sequence[int] = OTHER_MONTHS,
                 lake_nutrients: Sequence[str] | None = LAKE_NUTRIENTS,
                 stream_nutrients: Sequence[str] | None = STREAM_NUTRIENTS) -> DataFrame:
    """The samples a box plot is made of: target months and target parameters of a site's type."""
    types = sites.select(F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
                         F.col("type").alias("SiteType"))
    months = sorted({*lake_months, *other_months})
    rows = get_wdata(meas, category=category, years=(year_from, current_year), months=months)
    rows = with_calendar(rows).select(*SERIES, "Date", "month_num", "year", "ValueCen")
    rows = rows.join(types, ["Park", "Site"], "left")
    rows = rows.where(target_month(F.col("SiteType"), F.col("month_num"), lake_months, other_months))
    if lake_nutrients is not None and stream_nutrients is not None:
        rows = rows.where(target_nutrient(F.col("SiteType"), F.col("Characteristic"),
                                          lake_nutrients, stream_nutrients))
    return rows


def boxplot(meas: DataFrame, sites: DataFrame, chars: DataFrame, *, year_from: int, year_to: int,
            current_year: int, method: str = "hazen", **row_options) -> DataFrame:
    """Layers of the plot in one long table.

    ``box``: statistics per month of the years up to ``year_to``. ``outlier``: historic samples
    beyond the fences of their box. ``current``: classified samples of the current year. ``threshold``: the
    upper point with the ends of its line.
    """
    rows = boxplot_rows(meas, sites, year_from=year_from, current_year=current_year, **row_options)
    hist = historic(rows, year_from, year_to + 1)
    fences = box_fences(hist, MONTHLY, method=method)
    boxes = box_stats(hist, MONTHLY, fences=fences).withColumn("layer", F.lit("box"))

    # One pass gives both kinds of points; when the current year is part of the boxes, a sample can be both.
    in_hist, is_now = F.col("year") <= year_to, F.col("year") == current_year
    fenced = rows.join(fences, MONTHLY, "left")
    kinds = F.filter(
        F.array(F.when(in_hist & beyond_fences(), "outlier"), F.when(is_now, "current")), lambda k: k.isNotNull())
    points = with_points(fenced.withColumn("layer", F.explode(kinds)), chars)
    outlier, now = F.col("layer") == "outlier", F.col("layer") == "current"
    points = points.select(
        *MONTHLY, "layer", *[F.when(outlier, F.col(c)).alias(c) for c in STATS], "Date", "year",
        F.col("ValueCen").alias("value"),
        F.when(now, box_class(F.col("ValueCen"), F.col("year"), current_year)).alias("pcolor"),
    )
    series = rows.groupBy(*SERIES).agg(
        F.min("month_num").alias("first_month"), F.max("month_num").alias("last_month"), F.max(is_now).alias("sampled"))
    lines = with_points(axis_ends(series).where("sampled"), chars).where(F.col("UpperPoint").isNotNull()).select(
        *SERIES, F.lit("threshold").alias("layer"), "UpperPoint", "line_start", "line_end")
    layers = boxes
    for layer in (points, lines):
        layers = layers.unionByName(layer, allowMissingColumns=True)
    return layers.withColumn("month", month_label(F.col("month_num"))).select(*LAYER_COLUMNS)
