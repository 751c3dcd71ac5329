"""All sites of a park side by side in the current year."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions import labels
from limnograph.functions.calendar import FIELD_SEASON, with_calendar
from limnograph.operators.catalog import get_wdata
from limnograph.operators.checks import require_single_year
from limnograph.operators.joins import semi_join
from limnograph.operators.thresholds import POINTS, with_points


def site_names(sites: DataFrame) -> DataFrame:
    return sites.select(F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
                        "SiteName", F.col("type").alias("SiteType"))


def join_site_names(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """Names of the sites that occur in ``rows``.

    A full outer join with the names of exactly these sites keeps every row and adds none, so it
    is a left join.
    """
    return rows.join(site_names(sites), ["Park", "Site"], "left")


def site_comparison(meas: DataFrame, sites: DataFrame, chars: DataFrame, *, year: int,
                    months: Iterable[int] = FIELD_SEASON, site_type: str | None = None,
                    names: Sequence[str] | None = None, exclude: Sequence[str] = (),
                    mode: str = "per_site", assessment: str = "metadata") -> DataFrame:
    """Current samples of every site with names, assessment points and labels."""
    require_single_year(year)
    rows = get_wdata(meas, char=names, years=year, months=months)
    if exclude:
        rows = rows.where(~F.col("Characteristic").isin(*exclude))
    rows = with_calendar(rows).select(
        "Park", "Site", "Characteristic", "Date", "month", "month_num", "year", "ValueCen"
    )
    if site_type is not None:
        kept = sites.where(F.col("type") == site_type)
        rows = semi_join(rows, kept, {"Park": "ParkCode", "Site": "SiteCode"})
    rows = join_site_names(rows, sites)
    info = chars.select(
        F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
        F.col("CharName").alias("Characteristic"), F.col("CategoryDisplay").alias("param_name"),
        F.col("Units").alias("unit"), *POINTS,
    )
    if assessment != "metadata" or mode != "per_site":  # else names and points come with one join
        info = info.drop(*POINTS)
        rows = with_points(rows, chars, assessment=assessment, mode=mode)
    rows = rows.join(info, ["Park", "Site", "Characteristic"], "left")
    return rows.withColumns(
        {
            "yname": labels.axis_label(F.col("param_name"), F.col("unit"), F.col("Characteristic")),
            "tip": labels.point_tooltip(F.col("month"), F.col("year"), F.col("ValueCen"),
                                        F.col("param_name"), F.col("unit"), F.col("SiteName")),
        }
    )
