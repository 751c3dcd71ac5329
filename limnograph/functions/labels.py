"""Text columns: axis titles, tooltips, popups, captions.

Fixed values: the wording and markup of tooltips, popups, links and titles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(value: Column) -> Column:
    """One digit, halves to even."""
    return F.bround(value, 1)


def shown(value: Column) -> Column:
    """A measured value as shown: one digit, without the noise of its arithmetic."""
    return number_text(round1(F.round(value, 6)))


def number_text(value: Column) -> Column:
    """A number as printed in a label: no trailing ``.0``, ``NA`` when missing."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"\.0$", ""), F.lit("NA"))


def text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NA"))


def strip_unit(characteristic: Column) -> Column:
    """``DO_mgL`` becomes ``DO``."""
    return F.regexp_replace(characteristic, "_.*", "")


def unit_display(unit: Column) -> Column:
    return F.when(unit == "pct", F.lit("%")).when(unit == "pH units", F.lit("")).otherwise(unit)


def axis_label(name: Column, unit: Column, characteristic: Column | None = None) -> Column:
    """``name (unit)``, or the bare name for pH, which has no unit."""
    key = name if characteristic is None else characteristic
    return F.when(key != "pH", F.concat(name, F.lit(" ("), unit, F.lit(")"))).otherwise(name)


def band_tooltip(what: str, month: Column, value: Column, name: Column, unit: Column,
                 year: Column | None = None) -> Column:
    """Hover text of one band edge; the extremes also name their year."""
    parts = [F.lit("Historic "), text(month), F.lit(f" {what}"), F.lit("<br>"), text(name),
             F.lit(": "), shown(value), F.lit(" "), text(unit)]
    if year is not None:
        parts += [F.lit("<br>Year observed: "), number_text(year)]
    return F.concat(*parts)


def point_tooltip(month: Column, year: Column, value: Column, name: Column, unit: Column,
                  site_name: Column | None = None) -> Column:
    parts = [text(month), F.lit(" "), number_text(year), F.lit("<br>"), text(name), F.lit(": "),
             shown(value), F.lit(" "), text(unit)]
    if site_name is not None:
        parts = [text(site_name), F.lit("<br>")] + parts
    return F.concat(*parts)


def threshold_tooltip(side: str, point: Column, name: Column, unit: Column) -> Column:
    return F.concat_ws(" ", F.lit(side), text(name), F.lit("threshold:"), number_text(point),
                       text(unit))


def photo_link(site: Column, base_url: str) -> Column:
    return F.concat(F.lit(f"<a href='{base_url}"), site,
                    F.lit(".jpg' target='_blank'>Site Photo</a>"))


def site_popup(name: Column, kind: Column, first: Column, last: Column, description: Column,
               link: Column) -> Column:
    return F.concat(
        F.lit("<b>"), text(name), F.lit("</b><br><b>Type: </b>"), text(kind),
        F.lit("<br><b>Sample Period: </b>"), text(first), F.lit("&ndash;"), text(last),
        F.lit("<br>"), text(description), F.lit("<br>"), text(link),
    )


def history_title(first: int, last: int, current: int) -> Column:
    return F.lit(f"Historic ({first}–{last}) vs. Current ({current}) Measurements")


def comparison_title(park: Column, current: int) -> Column:
    return F.concat(F.lit("Monthly Water Quality Measurements ("), park, F.lit(f" {current})"))


def bands_caption(site_name: Column, first: int, last: int, current: int) -> Column:
    return F.concat(
        F.lit("Historic ranges for "), text(site_name),
        F.lit(f", {first} to {last}, by month: full range, 95% range and 50% range. "
              f"Points: measurements of {current}."),
    )


def boxplot_caption(site_name: Column, first: int, last: int, current: int) -> Column:
    return F.concat(
        F.lit("Historic boxes for "), text(site_name),
        F.lit(f", {first} to {last}, by month: Q1, median, Q3; outliers lie beyond "
              f"Q1 - 1.5*IQR or Q3 + 1.5*IQR. Points: measurements of {current}."),
    )
