"""Small grouped summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions.calendar import mon_year
from limnograph.functions.tails import t_p_value, t_quantile_975


def years_active(meas: DataFrame) -> DataFrame:
    """First and last sample of every site as ``May 2019``."""
    return (
        meas.groupBy("Site")
        .agg(F.min("Date").alias("_first"), F.max("Date").alias("_last"))
        .select("Site", mon_year(F.col("_first")).alias("start_date"),
                mon_year(F.col("_last")).alias("last_date"))
    )


def month_mean(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.month("Date").alias("month")).agg(F.avg(value).alias("avg_value"))


def bbox_center(boxes: DataFrame) -> DataFrame:
    """Middle of the two longitudes and the two latitudes, whichever is larger."""
    return boxes.select(
        "ParkCode", "Zoom", "minZoom",
        ((F.col("LongE") + F.col("LongW")) / 2).alias("long_cent"),
        ((F.col("LatN") + F.col("LatS")) / 2).alias("lat_cent"),
    )


def multi_site_flag(meas_current: DataFrame) -> DataFrame:
    """Whether a park has more than one site in the given rows."""
    sites = meas_current.select("Park", "Site").distinct()
    return sites.groupBy("Park").agg((F.count(F.lit(1)) > 1).alias("show_comp"))


def all_lake(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(F.col("SiteType") == "Lake").alias("all_lake"))


def panel_count(pairs: DataFrame) -> DataFrame:
    """Panels per site, and the rows they are laid out in."""
    counts = (
        pairs.select("Park", "Site", "Characteristic").distinct()
        .groupBy("Park", "Site").agg(F.count(F.lit(1)).alias("n_panels"))
    )
    return counts.withColumn("layout_rows", F.when(F.col("n_panels") > 4, 3).otherwise(2))


def axis_domain(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First and last month of a box plot and the ends of its threshold line."""
    months = df.groupBy(*keys).agg(
        F.min("month_num").alias("first_month"), F.max("month_num").alias("last_month")
    )
    return axis_ends(months)


def axis_ends(months: DataFrame) -> DataFrame:
    """Ends of the threshold line from the first and the last month."""
    first, last = F.col("first_month"), F.col("last_month")
    pad = F.when(first == 6, F.lit(1.0)).when(first == 5, F.lit(1.5))
    return months.withColumns({"line_start": first - pad, "line_end": last + pad})


def t_test_1samp(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """One-sample t test of the mean against zero."""
    v = F.col(value)
    sums = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")
    )
    se = F.col("sd") / F.sqrt(F.col("n"))
    tested = sums.withColumns({"df": F.col("n") - 1, "t": F.when(se > 0, F.col("mean") / se), "_se": se})
    margin = t_quantile_975(F.col("df").cast("double")) * F.col("_se")
    return tested.withColumns(
        {
            "p_value": t_p_value(F.col("t"), F.col("df").cast("double")),
            "conf_low": F.col("mean") - margin,
            "conf_high": F.col("mean") + margin,
        }
    ).drop("_se")
