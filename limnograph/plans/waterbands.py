"""Historic monthly bands against the current year, for every series at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.functions import labels
from limnograph.functions.calendar import FIELD_SEASON, month_label
from limnograph.functions.nulls import if_else
from limnograph.operators.bands import MIN_SAMPLES, MONTHLY, SERIES, monthly_bands
from limnograph.operators.catalog import get_wdata
from limnograph.operators.filters import historic
from limnograph.operators.joins import full_join
from limnograph.operators.thresholds import band_class, with_given_points, with_points


def current_values(meas: DataFrame, year: int, months: Iterable[int] | None = None) -> DataFrame:
    """The current year's samples, one row each."""
    rows = get_wdata(meas, years=year, months=months)
    return rows.select(
        *SERIES, F.month("Date").alias("month_num"), "Date", F.lit(year).alias("year_curr"),
        F.col("ValueCen").alias("ValueCen_curr"),
    )


def waterbands_from(bands: DataFrame, current_rows: DataFrame) -> DataFrame:
    """Bands and current samples side by side.

    Months with only a history or only current samples stay, and a month with several current
    samples has a row for each. A month may hold any number of these.
    """
    joined = full_join(current_rows, bands.drop("month"), MONTHLY, hot=True)
    return joined.withColumn("month", month_label(F.col("month_num")))


def char_names(chars: DataFrame) -> DataFrame:
    """Display name and unit of every (park, site, characteristic)."""
    return chars.select(
        F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
        F.col("CharName").alias("Characteristic"), F.col("CategoryDisplay").alias("param_name"),
        F.col("Units").alias("unit"), "LowerPoint", "UpperPoint",
    )


def waterbands(meas: DataFrame, chars: DataFrame, *, year_historic: int, year_current: int,
               months: Iterable[int] = FIELD_SEASON, min_samples: int = MIN_SAMPLES,
               assessment: str | Sequence[float] = "metadata", param_name: str | None = None, unit: str | None = None,
               yname: str | None = None) -> DataFrame:
    """Bands, years of the extremes, current values, assessment points, class and labels.

    ``assessment`` is ``metadata``, ``none``, or a list of numbers: every row then comes once for each of them, as
    ``AssessmentPoint``, and a current value above it is orange. ``param_name``, ``unit`` and ``yname`` stand in for the
    names of the metadata.
    """
    months = tuple(months)
    rows = get_wdata(meas, years=(year_historic, year_current), months=months)
    rows = rows.withColumn("month_num", F.month("Date"))
    bands = monthly_bands(historic(rows, year_historic, year_current), min_samples=min_samples)
    joined = waterbands_from(bands, current_values(rows, year_current))
    named = joined.join(char_names(chars), SERIES, "left")
    given = {"param_name": param_name, "unit": unit}
    named = named.withColumns({c: F.lit(text) for c, text in given.items() if text is not None})
    if assessment == "none":
        named = with_points(named.drop("LowerPoint", "UpperPoint"), chars, assessment="none")
    value, pcolor = F.col("ValueCen_curr"), band_class(F.col("ValueCen_curr"))
    if not isinstance(assessment, str):
        named = with_given_points(named.drop("LowerPoint", "UpperPoint"), assessment)
        pcolor = if_else(value > F.col("AssessmentPoint"), F.lit("orange"), F.lit("black"))
    elif assessment not in ("metadata", "none"):
        raise ValueError(f"unknown assessment {assessment!r}")
    label = labels.axis_label(F.col("param_name"), F.col("unit"), F.col("Characteristic")) if yname is None else F.lit(yname)
    return named.withColumns({"pcolor": pcolor, "yname": label})


def waterbands_labels(rows: DataFrame) -> DataFrame:
    """Hover texts of every layer of the band plot."""
    c = F.col
    name, unit, month = c("param_name"), c("unit"), c("month")
    edges = {
        "tip_max": ("Maximum: ", "upper_100", c("year_max")),
        "tip_min": ("Minimum: ", "lower_100", c("year_min")),
        "tip_u95": ("Upper 95%: ", "upper_95", None),
        "tip_l95": ("Lower 95%: ", "lower_95", None),
        "tip_u50": ("Upper 50%: ", "upper_50", None),
        "tip_l50": ("Lower 50%: ", "lower_50", None),
        "tip_median": ("Median ", "median_val", None),
    }
    tips = {
        tip: labels.band_tooltip(what, month, c(column), name, unit, year)
        for tip, (what, column, year) in edges.items()
    }
    tips["tip_current"] = labels.point_tooltip(month, c("year_curr"), c("ValueCen_curr"), name, unit)
    tips["tip_lower"] = labels.threshold_tooltip("Lower", c("LowerPoint"), name, unit)
    tips["tip_upper"] = labels.threshold_tooltip("Upper", c("UpperPoint"), name, unit)
    return rows.withColumns(tips)
