"""Sites on a map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions.labels import photo_link, site_popup
from limnograph.operators.aggregates import bbox_center, years_active
from limnograph.operators.catalog import get_wdata


def site_map(meas: DataFrame, sites: DataFrame, descriptions: DataFrame, boxes: DataFrame, *,
             category: str | None = "physical", photo_url: str = "photos/") -> DataFrame:
    """Every site with its position, sample period, description and popup, and its park's view.

    Descriptions join on park, code and name, since a code can be described twice.
    """
    active = years_active(get_wdata(meas, category=category))
    rows = sites.select("ParkCode", "SiteCode", "SiteName", "lat", "long", "type")
    rows = rows.join(active.withColumnRenamed("Site", "SiteCode"), "SiteCode", "left")
    rows = rows.join(descriptions, ["SiteCode", "ParkCode", "SiteName"], "left")
    rows = rows.join(bbox_center(boxes), "ParkCode", "left")
    rows = rows.join(boxes.select("ParkCode", "LatS", "LongE", "LatN", "LongW"), "ParkCode", "left")
    link = photo_link(F.col("SiteCode"), photo_url)
    rows = rows.withColumn("Link", link)
    return rows.withColumn(
        "popup",
        site_popup(F.col("SiteName"), F.col("type"), F.col("start_date"), F.col("last_date"),
                   F.col("Description"), F.col("Link")),
    )
