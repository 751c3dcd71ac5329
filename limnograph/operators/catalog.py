"""Getters over the measurement table and its dimensions, for all parks at once."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnograph.functions.calendar import in_months, in_seasons, in_years
from limnograph.operators.joins import join_on

Choice = str | Iterable[str] | None


def _matches(column: str, choice: Choice) -> Column | None:
    if choice is None:
        return None
    if isinstance(choice, str):
        return F.col(column) == choice
    return F.col(column).isin(*list(choice))


def _filtered(df: DataFrame, **choices: Choice) -> DataFrame:
    for column, choice in choices.items():
        condition = _matches(column, choice)
        if condition is not None:
            df = df.where(condition)
    return df


def get_park_info(parks: DataFrame, info: str | Sequence[str], park: Choice = None) -> DataFrame:
    return _filtered(parks, ParkCode=park).select(*([info] if isinstance(info, str) else info))


def get_site_info(sites: DataFrame, info: str | Sequence[str], park: Choice = None,
                  site: Choice = None) -> DataFrame:
    df = _filtered(sites, ParkCode=park, SiteCode=site)
    return df.select(*([info] if isinstance(info, str) else info))


def get_char_info(chars: DataFrame, info: str | Sequence[str], park: Choice = None,
                  site: Choice = None, char: Choice = None, category: Choice = None) -> DataFrame:
    """Distinct attribute values of the characteristics that match."""
    df = _filtered(chars, ParkCode=park, SiteCode=site, CharName=char, Category=category)
    return df.select(*([info] if isinstance(info, str) else info)).distinct()


def get_wdata(meas: DataFrame, park: Choice = None, site: Choice = None, char: Choice = None,
              category: Choice = None, years: tuple[int | None, int | None] | int | None = None,
              months: Iterable[int] | None = None, where: Column | None = None) -> DataFrame:
    """Filtered measurement scan; every filter is optional.

    ``years`` is one year or an inclusive (first, last) pair and becomes a date range, with ``months`` one for each season.
    """
    df = _filtered(meas, Park=park, Site=site, Characteristic=char, Category=category)
    if years is not None:
        first, last = (years, years) if isinstance(years, int) else years
        if months is not None and first is not None and last is not None:
            df, months = df.where(in_seasons(first, last, months)), None
        else:
            df = df.where(in_years(first, last))
    if months is not None:
        df = df.where(in_months(months))
    return df if where is None else df.where(where)


def list_site_chars(chars: DataFrame, category: Choice = None) -> DataFrame:
    """Every (site, characteristic) pair, which stands in for loops over sites."""
    df = _filtered(chars, Category=category)
    return df.select(
        F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
        F.col("CharName").alias("Characteristic"),
    ).distinct()


def nested_catalog(meas: DataFrame) -> DataFrame:
    """One row per site with an array of its characteristics and the extent of their data.

    The samples themselves are in ``nested_pages``: one array of all samples of a characteristic has no bound.
    """
    leaves = meas.groupBy("Park", "Site", "Characteristic").agg(
        F.min("Category").alias("Category"),
        F.count(F.lit(1)).alias("n_samples"),
        F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"),
    )
    leaf = F.struct("Characteristic", "Category", "n_samples", "first_date", "last_date")
    return leaves.groupBy("Park", "Site").agg(
        F.array_sort(F.collect_list(leaf)).alias("characteristics"),
        F.sum("n_samples").alias("n_samples"),
    )


def nested_parks(meas: DataFrame) -> DataFrame:
    """One row per park with its sites, each with its characteristics and the extent of their data."""
    sites = nested_catalog(meas)
    return sites.groupBy("Park").agg(
        F.array_sort(F.collect_list(F.struct("Site", "n_samples", "characteristics"))).alias("sites"),
        F.sum("n_samples").alias("n_samples"))


def nested_pages(meas: DataFrame, page_rows: int = 1_000) -> DataFrame:
    """The samples of every characteristic of a site in pages, in date order: arrays of a bounded size.

    A page takes whole days up to about ``page_rows`` different samples and one day more. A day with over ``page_rows`` has
    parts of its own (``part`` from 1; 0 otherwise). Equal samples are one element with their number (``copies``), so
    neither a long series, nor a busy day, nor a sample that repeats without end makes a long array, and none meets in
    one task: days are counted, and a calendar bounds their number.
    """
    series = ["Park", "Site", "Characteristic"]
    kept = [c for c in ("SampleDepth", "Value", "TextValue", "Censored", "ValueCen") if c in meas.columns]
    rows = meas.groupBy(*series, "Date", *kept).agg(F.count(F.lit(1)).alias("copies"))
    days = rows.groupBy(*series, "Date").agg(F.count(F.lit(1)).alias("_day"))
    before = Window.partitionBy(*series).orderBy("Date").rowsBetween(Window.unboundedPreceding, -1)
    long_day = F.col("_day") > page_rows
    short = F.when(long_day, 0).otherwise(F.col("_day"))
    days = days.withColumn("page", F.floor(F.coalesce(F.sum(short).over(before), F.lit(0)) / page_rows)) \
        .withColumn("_parts", F.when(long_day, F.ceil(F.col("_day") / page_rows)).otherwise(0)).drop("_day")
    placed = join_on(rows, days, [*series, "Date"])
    part = F.when(F.col("_parts") > 0, F.pmod(F.xxhash64("Date", *kept), F.col("_parts")) + 1).otherwise(0)
    day = F.when(F.col("_parts") > 0, F.col("Date"))
    sample = F.struct("Date", *kept, "copies")
    return placed.withColumn("part", part.cast("long")).withColumn("day", day).groupBy(*series, "page", "day", "part").agg(
        F.array_sort(F.collect_list(sample)).alias("samples"), F.sum("copies").alias("n_samples"),
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date"))
