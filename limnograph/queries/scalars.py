"""Scalar functions over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnograph.functions import calendar, codes, labels
from limnograph.functions.nulls import if_else
from limnograph.operators.catalog import get_wdata
from limnograph.operators.loess import with_grid_pad
from limnograph.plans.site_map import site_map
from limnograph.plans.waterbands import waterbands, waterbands_labels
from limnograph.queries.base import query
from limnograph.queries.filters import PAIRS, pairs
from limnograph.queries.sql import (
    AXIS_LABEL,
    SEASON,
    STATE,
    WATERBANDS,
    if_else as if_else_sql,
    number_text,
    round1_text,
    text,
)
from limnograph.sources.monitoring_view import CURRENT, YEAR_FROM, YEAR_TO, park_code
from limnograph.sources.sinks import output_name

PHOTOS = "photos/"


def _dates(v):
    return v.meas.select("Date").distinct()


def _date_query(name, column, spark, sql):
    @query(name, f"Date:t {column}", f"SELECT DISTINCT Date, {sql} AS {column.split(':')[0]} FROM meas")
    def build(v):
        return _dates(v).withColumn(column.split(":")[0], spark(F.col("Date")))

    return build


_date_query("fn_month_abbr", "month", calendar.month_abbr, "strftime(Date, '%b')")
_date_query("fn_month_full", "month", calendar.month_full, "strftime(Date, '%B')")
_date_query("fn_month_num", "month_num:i", calendar.month_num, "month(Date)")
_date_query("fn_year", "year:i", calendar.year_num, "year(Date)")
_date_query("fn_year_text", "year", calendar.year_text, "strftime(Date, '%Y')")
_date_query("fn_mon_year", "mon_year", calendar.mon_year, "strftime(Date, '%b %Y')")


@query(
    "fn_month_axis",
    "Park month_num:i month",
    f"""SELECT Park, m AS month_num, strftime(make_date(2000, m::INT, 1), '%b') AS month FROM (
          SELECT Park, unnest(range(min(month_num), max(month_num) + 1)) AS m
          FROM sample WHERE {SEASON} GROUP BY Park)""",
)
def fn_month_axis(v):
    span = get_wdata(v.meas, months=calendar.FIELD_SEASON).groupBy("Park").agg(
        F.min(F.month("Date")).alias("a"), F.max(F.month("Date")).alias("b")
    )
    months = span.select("Park", F.explode(F.sequence("a", "b")).alias("month_num"))
    return months.withColumn("month", calendar.month_label(F.col("month_num")))


# Site codes in the positional layout: network, park and number, 14 characters. The number is written
# in four places of base 36, which hold 1,679,616 sites; more are an error, never a code used twice.
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NUMBER_SQL = "regexp_extract(SiteCode, '(\\d+)$', 1)::BIGINT"
_PLACES_SQL = " || ".join(f"substr('{_DIGITS}', 1 + ({_NUMBER_SQL} // {36 ** i}) % 36, 1)" for i in (3, 2, 1, 0))
_CODE_SQL = "'XNET_' || left(replace(ParkCode, ' ', ''), 4) || '_' || " + _PLACES_SQL


def _coded_sites(v):
    number = F.regexp_extract("SiteCode", r"(\d+)$", 1).cast("bigint")
    places = F.when(number < 36 ** 4, F.lpad(F.conv(number.cast("string"), 10, 36), 4, "0")) \
        .otherwise(F.raise_error(F.concat(F.lit("no four-place code for site "), F.col("SiteCode"))))
    park = F.substring(F.replace(F.col("ParkCode"), F.lit(" "), F.lit("")), 1, 4)
    code = F.concat(F.lit("XNET_"), park, F.lit("_"), places)
    return v.sites.select("SiteCode", code.alias("code"))


@query("fn_park_from_site", "SiteCode code park",
       f"SELECT SiteCode, code, substr(code, 6, 4) AS park FROM (SELECT *, {_CODE_SQL} AS code FROM sites)")
def fn_park_from_site(v):
    return _coded_sites(v).withColumn("park", codes.park_from_site(F.col("code")))


@query("fn_site_from_key", "SiteCode key site",
       f"""SELECT SiteCode, code || type AS key, substr(code || type, 1, 14) AS site
           FROM (SELECT *, {_CODE_SQL} AS code FROM sites)""")
def fn_site_from_key(v):
    keyed = _coded_sites(v).join(v.sites.select("SiteCode", "type"), "SiteCode")
    key = F.concat("code", "type")
    return keyed.select("SiteCode", key.alias("key"), codes.site_from_key(key).alias("site"))


@query("fn_strip_unit", "Site Characteristic label",
       f"SELECT Site, Characteristic, regexp_replace(Characteristic, '_.*', '') AS label FROM ({PAIRS})")
def fn_strip_unit(v):
    return pairs(v).withColumn("label", labels.strip_unit(F.col("Characteristic")))


@query(
    "fn_unit_display",
    "SiteCode CharName unit",
    """SELECT SiteCode, CharName, CASE WHEN Units = 'pct' THEN '%' WHEN Units = 'pH units' THEN '' ELSE Units END
         AS unit FROM chars""",
)
def fn_unit_display(v):
    return v.chars.select("SiteCode", "CharName", labels.unit_display(F.col("Units")).alias("unit"))


@query("fn_axis_label", "Site Characteristic yname", f"SELECT Site, Characteristic, {AXIS_LABEL} AS yname FROM points")
def fn_axis_label(v):
    return v.chars.select(
        F.col("SiteCode").alias("Site"), F.col("CharName").alias("Characteristic"),
        labels.axis_label(F.col("CategoryDisplay"), F.col("Units"), F.col("CharName")).alias("yname"),
    )


def _band_tip(what: str, column: str, year: str | None = None) -> str:
    tip = (f"'Historic ' || {text('month')} || ' {what}<br>' || {text('param_name')} || ': ' || "
           f"{round1_text(column)} || ' ' || {text('unit')}")
    return tip if year is None else f"{tip} || '<br>Year observed: ' || {number_text(year)}"


@query(
    "fn_tooltips",
    "Park Site Characteristic month_num:i Date:t tip_max tip_min tip_u95 tip_l95 tip_u50 tip_l50 tip_median "
    "tip_current tip_lower tip_upper",
    f"""SELECT *, {_band_tip('Maximum: ', 'upper_100', 'year_max')} AS tip_max,
          {_band_tip('Minimum: ', 'lower_100', 'year_min')} AS tip_min,
          {_band_tip('Upper 95%: ', 'upper_95')} AS tip_u95, {_band_tip('Lower 95%: ', 'lower_95')} AS tip_l95,
          {_band_tip('Upper 50%: ', 'upper_50')} AS tip_u50, {_band_tip('Lower 50%: ', 'lower_50')} AS tip_l50,
          {_band_tip('Median ', 'median_val')} AS tip_median,
          {text('month')} || ' ' || {number_text('year_curr')} || '<br>' || {text('param_name')} || ': ' ||
            {round1_text('ValueCen_curr')} || ' ' || {text('unit')} AS tip_current,
          'Lower ' || {text('param_name')} || ' threshold: ' || {number_text('LowerPoint')} || ' ' || {text('unit')} AS tip_lower,
          'Upper ' || {text('param_name')} || ' threshold: ' || {number_text('UpperPoint')} || ' ' || {text('unit')} AS tip_upper
        FROM ({WATERBANDS})""",
)
def fn_tooltips(v):
    rows = waterbands(v.meas, v.chars, year_historic=YEAR_FROM, year_current=CURRENT)
    return waterbands_labels(rows)


_LINK = f"'<a href=''{PHOTOS}' || SiteCode || '.jpg'' target=''_blank''>Site Photo</a>'"


@query("fn_site_photo_link", "SiteCode Link", f"SELECT SiteCode, {_LINK} AS Link FROM sites")
def fn_site_photo_link(v):
    return v.sites.select("SiteCode", labels.photo_link(F.col("SiteCode"), PHOTOS).alias("Link"))


POPUP = (
    f"'<b>' || {text('SiteName')} || '</b><br><b>Type: </b>' || {text('type')} || "
    f"'<br><b>Sample Period: </b>' || {text('start_date')} || '&ndash;' || {text('last_date')} || '<br>' || "
    f"{text('Description')} || '<br>' || {_LINK}"
)
ACTIVE = """(SELECT Site AS SiteCode, strftime(min(Date), '%b %Y') AS start_date,
    strftime(max(Date), '%b %Y') AS last_date FROM meas WHERE Category = 'physical' GROUP BY Site)"""
SITE_ROWS = f"""(SELECT * FROM sites LEFT JOIN {ACTIVE} AS a USING (SiteCode)
  LEFT JOIN descriptions USING (SiteCode, ParkCode, SiteName))"""


@query("fn_site_popup", "SiteCode SiteName popup", f"SELECT *, {POPUP} AS popup FROM {SITE_ROWS} AS r")
def fn_site_popup(v):
    return site_map(v.meas, v.sites, v.descriptions, v.boxes, photo_url=PHOTOS)


@query(
    "fn_title_caption",
    "SiteCode title comparison",
    """SELECT SiteCode, 'Historic (1995–2000) vs. Current (2001) Measurements' AS title,
         'Monthly Water Quality Measurements (' || ParkCode || ' 2001)' AS comparison FROM sites""",
)
def fn_title_caption(v):
    return v.sites.select(
        "SiteCode", labels.history_title(YEAR_FROM, YEAR_TO, CURRENT).alias("title"),
        labels.comparison_title(F.col("ParkCode"), CURRENT).alias("comparison"),
    )


@query("fn_round1", "ratio:d rounded:d",
       "SELECT DISTINCT ValueCen / 4 AS ratio, round_even(ValueCen / 4, 1) AS rounded FROM meas")
def fn_round1(v):
    ratio = F.col("ValueCen") / 4
    return v.meas.select(ratio.alias("ratio")).distinct().withColumn("rounded", labels.round1(F.col("ratio")))


@query("fn_ifelse", "Characteristic ValueCen:d size_class",
       f"SELECT DISTINCT Characteristic, ValueCen, {if_else_sql('ValueCen > 25', chr(39)+'large'+chr(39), chr(39)+'small'+chr(39))} AS size_class FROM meas")
def fn_ifelse(v):
    rows = v.meas.select("Characteristic", "ValueCen").distinct()
    return rows.withColumn("size_class", if_else(F.col("ValueCen") > 25, "large", "small"))


@query("fn_case_when", "Characteristic ValueCen:d size_class",
       "SELECT DISTINCT Characteristic, ValueCen, CASE WHEN ValueCen > 40 THEN 'high' WHEN ValueCen > 20 THEN 'middle' ELSE 'low' END AS size_class FROM meas")
def fn_case_when(v):
    value = F.col("ValueCen")
    rows = v.meas.select("Characteristic", "ValueCen").distinct()
    return rows.withColumn("size_class", F.when(value > 40, "high").when(value > 20, "middle").otherwise("low"))


@query("fn_is_na", "Park Characteristic n_missing:i n_rows:i",
       "SELECT Park, Characteristic, count(*) FILTER (WHERE ValueCen IS NULL) AS n_missing, count(*) AS n_rows FROM meas GROUP BY ALL")
def fn_is_na(v):
    return v.meas.groupBy("Park", "Characteristic").agg(
        F.count_if(F.col("ValueCen").isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_rows")
    )


_STATE_SITES = f"(SELECT *, {STATE} AS state FROM (SELECT *, ParkCode AS Park FROM sites))"


@query("fn_state_of_park", "SiteCode state", f"SELECT SiteCode, state FROM {_STATE_SITES} AS s")
def fn_state_of_park(v):
    return v.sites.select("SiteCode", codes.state_of_park(park_code(F.col("ParkCode"))).alias("state"))


_FLAGS = [*codes.STATES, *codes.CATEGORIES]


@query(
    "fn_flag_columns",
    "SiteCode Category" + "".join(f" {f}:b" for f in _FLAGS),
    f"""SELECT DISTINCT SiteCode, Category, {', '.join(f"state = '{s}' AS {s}" for s in codes.STATES)},
          {', '.join(f"Category = '{c}' AS {c}" for c in codes.CATEGORIES)}
        FROM {_STATE_SITES} AS s JOIN (SELECT DISTINCT SiteCode, Category FROM chars) AS c USING (SiteCode)""",
)
def fn_flag_columns(v):
    rows = v.chars.select("ParkCode", "SiteCode", "Category").distinct()
    rows = rows.withColumn("state", codes.state_of_park(park_code(F.col("ParkCode"))))
    flags = {**codes.flag_columns(F.col("state"), codes.STATES),
             **codes.flag_columns(F.col("Category"), codes.CATEGORIES)}
    return rows.withColumns(flags)


@query(
    "fn_grid_pad",
    "Site Characteristic mon_num:d x_axis_pad:d",
    f"""SELECT Site, Characteristic, m / 2 AS mon_num,
          CASE m WHEN 10 THEN 4.9 WHEN 20 THEN 10.1 ELSE m / 2 END AS x_axis_pad
        FROM (SELECT *, unnest(range(10, 21)) AS m FROM ({PAIRS}))""",
)
def fn_grid_pad(v):
    grid = F.explode(F.transform(F.sequence(F.lit(10), F.lit(20)), lambda m: m / 2))
    return with_grid_pad(pairs(v).select("Site", "Characteristic", grid.alias("mon_num")))


@query("fn_cast_text", "TextValue parsed:d month_num:i month_text",
       "SELECT DISTINCT TextValue, TRY_CAST(TextValue AS DOUBLE) AS parsed, month_num, CAST(month_num AS VARCHAR) AS month_text FROM sample")
def fn_cast_text(v):
    rows = v.meas.select("TextValue", F.month("Date").alias("month_num")).distinct()
    return rows.withColumns({"parsed": F.col("TextValue").try_cast("double"),
                             "month_text": F.col("month_num").cast("string")})


@query(
    "fn_output_name",
    "Park report n_rows:i",
    "SELECT Park, 'WQ_parameters_' || Park || '.html' AS report, count(*) AS n_rows FROM meas GROUP BY Park",
)
def fn_output_name(v):
    counts = v.meas.groupBy("Park").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("report", output_name(F.col("Park")))
