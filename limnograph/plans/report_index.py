"""Index of the site tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions import labels
from limnograph.operators.aggregates import multi_site_flag
from limnograph.operators.filters import current, target_nutrient
from limnograph.operators.joins import semi_join
from limnograph.plans.params import ReportParams


def _layout(n):
    return F.when(n > 4, F.lit(3)).otherwise(F.lit(2))


def report_index(meas: DataFrame, sites: DataFrame, chars: DataFrame, params: ReportParams) -> DataFrame:
    """Sites sampled in the current year with their panels, layout, titles and flags."""
    # The same distinct pairs serve the filter and the flag, so the samples are read once.
    sampled = current(meas, params.current).select("Park", "Site")
    active = semi_join(sites, sampled, {"ParkCode": "Park", "SiteCode": "Site"}).select(
        F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"), "SiteName",
        F.col("type").alias("SiteType"),
    )
    pairs = chars.select(F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
                         "CharName", "Category").distinct()
    physical = F.col("Category") == params.category
    nutrient = (F.col("Category") == "nutrients") & target_nutrient(F.col("SiteType"), F.col("CharName"))
    panels = active.join(pairs, ["Park", "Site"], "left").groupBy(
        "Park", "Site", "SiteName", "SiteType"
    ).agg(
        F.count_if(physical).alias("n_physical"),
        F.count_if(nutrient if params.nutrient else F.lit(False)).alias("n_nutrient"),
    )
    flags = multi_site_flag(sampled)
    span = (params.year_from, params.year_to, params.current)
    return panels.join(flags, "Park", "left").withColumns(
        {
            "rows_physical": _layout(F.col("n_physical")),
            "rows_nutrient": _layout(F.col("n_nutrient")),
            "title": labels.history_title(*span),
            "caption_physical": labels.bands_caption(F.col("SiteName"), *span),
            "caption_nutrient": labels.boxplot_caption(F.col("SiteName"), *span),
        }
    )
