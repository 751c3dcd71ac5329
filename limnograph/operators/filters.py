"""Row filters of the reports that are more than one comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from limnograph.functions.calendar import in_years
from limnograph.operators.joins import semi_join

# Months a box plot shows, target nutrients by water type, nutrients compared
# between sites, characteristics left out of panels.
LAKE_MONTHS = [6, 8]
OTHER_MONTHS = [5, 8]
LAKE_NUTRIENTS = ["TP_ugL", "TN_mgL", "ChlA_ugL"]
STREAM_NUTRIENTS = ["TP_ugL", "TN_mgL", "ANC_ueqL"]
COMPARED_NUTRIENTS = ["TN_mgL", "TP_ugL"]
NOT_COMPARED = ["Discharge_cfs"]
NOT_PLOTTED = ["DOsat_pct", "Turbidity_NTU", "SDepth1_m", "PenetrationRatio"]


def target_month(site_type: Column, month_num: Column, lake: Sequence[int] = LAKE_MONTHS,
                 other: Sequence[int] = OTHER_MONTHS) -> Column:
    return F.when(site_type == "Lake", month_num.isin(*lake)).otherwise(month_num.isin(*other))


def target_nutrient(site_type: Column, char: Column, lake: Sequence[str] = LAKE_NUTRIENTS,
                    stream: Sequence[str] = STREAM_NUTRIENTS) -> Column:
    return ((site_type == "Lake") & char.isin(*lake)) | (
        (site_type == "Stream") & char.isin(*stream)
    )


def historic(meas: DataFrame, first: int | None, before: int) -> DataFrame:
    """Years from ``first`` up to, not including, ``before``."""
    return meas.where(in_years(first, before - 1))


def current(meas: DataFrame, year: int) -> DataFrame:
    return meas.where(in_years(year, year))


def current_sites(sites: DataFrame, meas: DataFrame, year: int) -> DataFrame:
    """Sites sampled in ``year``."""
    return semi_join(sites, current(meas, year), {"SiteCode": "Site"})


def shared_characteristics(pairs: DataFrame) -> DataFrame:
    """(Park, Characteristic) measured at two or more sites."""
    return (
        pairs.select("Park", "Site", "Characteristic").distinct()
        .groupBy("Park", "Characteristic")
        .agg(F.count(F.lit(1)).alias("n_sites"))
        .where(F.col("n_sites") > 1)
    )


def drop_position(pairs: DataFrame, n: int) -> DataFrame:
    """Drop the ``n``-th characteristic of every site, in name order."""
    order = W.partitionBy("Park", "Site").orderBy("Characteristic")
    return (
        pairs.withColumn("_position", F.row_number().over(order))
        .where(F.col("_position") != n)
        .drop("_position")
    )


def exclude_chars(df: DataFrame, names: Sequence[str], column: str = "Characteristic") -> DataFrame:
    return df.where(~F.col(column).isin(*names))
