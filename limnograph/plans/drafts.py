"""Earlier variants of the report datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions.calendar import month_full, with_calendar, year_text
from limnograph.functions.labels import strip_unit
from limnograph.operators.bands import MONTHLY, SERIES, mean_and_95_band, percentile_bands, site_month_range
from limnograph.operators.box import box_fences, box_outliers, box_stats
from limnograph.operators.catalog import get_wdata
from limnograph.operators.filters import historic
from limnograph.operators.joins import full_join
from limnograph.operators.loess import bands_on_grid, loess_bands, with_grid_pad
from limnograph.operators.thresholds import outlier_text, with_rule_points
from limnograph.plans.site_comparison import site_comparison


def all_sites(meas: DataFrame, sites: DataFrame, *, year_from: int, year_to: int, current: int) -> DataFrame:
    """Current samples with the historic extremes of their month and the site's name."""
    ranges = site_month_range(get_wdata(meas, years=(year_from, year_to)))
    now = get_wdata(meas, years=current).withColumns(
        {"month_num": F.month("Date"), "month": month_full(F.col("Date")),
         "year": year_text(F.col("Date"))}
    )
    names = sites.select(F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"), "SiteName")
    return (
        now.select(*MONTHLY, "month", "year", "Date", "ValueCen")
        .join(ranges, MONTHLY, "left")
        .join(names, ["Park", "Site"], "left")
        .withColumn("ptlabel", strip_unit(F.col("Characteristic")))
    )


def monthly_physical(meas: DataFrame, *, current: int, category: str | None = "physical") -> DataFrame:
    """Current samples with the mean and 95 % band of all earlier years, joined on month name."""
    rows = get_wdata(meas, category=category)
    band = mean_and_95_band(historic(rows, None, current))
    band = band.drop("month_num").withColumnRenamed("month", "month_ch")
    now = get_wdata(rows, years=current).withColumn("month_ch", month_full(F.col("Date")))
    return now.select(*SERIES, "Date", "month_ch", "ValueCen").join(band, [*SERIES, "month_ch"], "left")


def bands_with_rules(meas: DataFrame, rules: DataFrame, *, year_from: int, current: int,
                     park_code=None, smooth_span: float | None = None) -> DataFrame:
    """Bands and current samples, points from the rule table, and the outlier text.

    ``park_code`` maps a park to the code the rules use. ``smooth_span`` adds smoothed bands on
    the half-month grid.
    """
    rows = get_wdata(meas, years=(year_from, current)).withColumn("month_num", F.month("Date"))
    bands = percentile_bands(historic(rows, year_from, current))
    now = get_wdata(meas, years=current).select(
        *SERIES, F.month("Date").alias("mon_num"), month_full(F.col("Date")).alias("month"), "Date",
        year_text(F.col("Date")).alias("year"), "SampleDepth", "ValueCen",
    )
    keys = ["mon_num", "Park", "month", "Site", "Characteristic"]
    if smooth_span is not None:
        smooth = with_grid_pad(loess_bands(bands, span=smooth_span))
        grid = bands_on_grid(bands, smooth)
        now = now.withColumn("mon_num", F.col("mon_num").cast("double"))
        rows = full_join(now, grid.drop("half_month"), keys, hot=True)
    else:
        rows = full_join(now, bands, keys, hot=True)
    code = F.col("Park") if park_code is None else park_code(F.col("Park"))
    rows = with_rule_points(rows.withColumn("_code", code), rules, park="_code").drop("_code")
    return rows.withColumn("outlier", outlier_text(F.col("ValueCen")))


def points_by_year(meas: DataFrame, *, year_from: int, current: int) -> DataFrame:
    """Samples as one line per year over the months."""
    rows = with_calendar(get_wdata(meas, years=(year_from, current)))
    return rows.select(*SERIES, "Date", "month", "month_num",
                       F.col("year").cast("string").alias("year"), "ValueCen")


def box_stats_annual(meas: DataFrame, *, method: str = "type7") -> DataFrame:
    """Boxes per park, characteristic and year."""
    rows = meas.withColumn("Year", F.year("Date"))
    return box_stats(rows, ["Park", "Characteristic", "Year"], method=method)


def box_outliers_annual(meas: DataFrame, *, method: str = "type7") -> DataFrame:
    keys = ["Park", "Characteristic", "Year"]
    rows = meas.withColumn("Year", F.year("Date"))
    fences = box_fences(rows, keys, method=method)
    return box_outliers(rows, fences, keys)


def site_comps_nutrient(meas: DataFrame, sites: DataFrame, chars: DataFrame, *, year: int,
                        names: Sequence[str] | None = None) -> DataFrame:
    """Site comparison without assessment points, over all months."""
    return site_comparison(meas, sites, chars, year=year, months=range(1, 13), names=names,
                           assessment="none")
