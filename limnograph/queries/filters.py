"""Filters, projections, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnograph.functions.calendar import with_calendar
from limnograph.operators import catalog, filters, joins
from limnograph.operators.thresholds import band_class, box_class, with_points
from limnograph.plans.boxplot import boxplot_rows
from limnograph.queries.base import query
from limnograph.queries.sql import BOX_SOURCE, SEASON, TARGET_MONTH, TARGET_NUTRIENT, beyond
from limnograph.sources.monitoring_view import CURRENT, YEAR_FROM, YEAR_TO

ROW = "Park Site Characteristic Date:t ValueCen:d"
PAIR = "Park Site Characteristic"
PAIRS = "SELECT ParkCode AS Park, SiteCode AS Site, CharName AS Characteristic, Category FROM chars"


def pairs(v):
    return v.chars.select(F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
                          F.col("CharName").alias("Characteristic"), "Category")


@query("filter_park", ROW, "SELECT * FROM meas WHERE Park = 'AFRICA'")
def filter_park(v):
    return catalog.get_wdata(v.meas, park="AFRICA")


@query("filter_sites_in", ROW, "SELECT * FROM meas WHERE Site IN (SELECT SiteCode FROM sites WHERE type = 'Lake')")
def filter_sites_in(v):
    return joins.semi_join(v.meas, v.sites.where(F.col("type") == "Lake"), {"Site": "SiteCode"})


@query("filter_char", ROW, "SELECT * FROM meas WHERE Characteristic = 'DO_mgL'")
def filter_char(v):
    return catalog.get_wdata(v.meas, char="DO_mgL")


@query("filter_category", ROW, "SELECT * FROM meas WHERE Category = 'nutrients'")
def filter_category(v):
    return catalog.get_wdata(v.meas, category="nutrients")


@query("filter_years_range", ROW, "SELECT * FROM sample WHERE year BETWEEN 1996 AND 1999")
def filter_years_range(v):
    return catalog.get_wdata(v.meas, years=(1996, 1999))


@query("filter_months", ROW, f"SELECT * FROM sample WHERE {SEASON}")
def filter_months(v):
    return catalog.get_wdata(v.meas, months=range(5, 11))


@query("filter_seasons", ROW, "SELECT * FROM sample WHERE year BETWEEN 1995 AND 1998 AND month_num IN (1, 5, 6, 12)")
def filter_seasons(v):
    return catalog.get_wdata(v.meas, years=(1995, 1998), months=[5, 6, 12, 1])


@query(
    "split_hist_curr",
    "Park Site Characteristic n_hist:i n_curr:i sum_hist:d sum_curr:d",
    """SELECT Park, Site, Characteristic, count(*) FILTER (WHERE year < 2001) AS n_hist,
         count(*) FILTER (WHERE year = 2001) AS n_curr, sum(ValueCen) FILTER (WHERE year < 2001) AS sum_hist,
         sum(ValueCen) FILTER (WHERE year = 2001) AS sum_curr
       FROM sample WHERE year BETWEEN 1995 AND 2001 GROUP BY Park, Site, Characteristic""",
)
def split_hist_curr(v):
    rows = with_calendar(catalog.get_wdata(v.meas, years=(YEAR_FROM, CURRENT)))
    past, now = F.col("year") < CURRENT, F.col("year") == CURRENT
    return rows.groupBy("Park", "Site", "Characteristic").agg(
        F.count_if(past).alias("n_hist"), F.count_if(now).alias("n_curr"),
        F.sum(F.when(past, F.col("ValueCen"))).alias("sum_hist"),
        F.sum(F.when(now, F.col("ValueCen"))).alias("sum_curr"),
    )


@query(
    "split_hist_curr_box",
    ROW + " part",
    """SELECT *, 'historic' AS part FROM sample WHERE year BETWEEN 1995 AND 2000
       UNION ALL SELECT *, 'current' AS part FROM sample WHERE year = 2001""",
)
def split_hist_curr_box(v):
    hist = catalog.get_wdata(v.meas, years=(YEAR_FROM, YEAR_TO)).withColumn("part", F.lit("historic"))
    now = filters.current(v.meas, CURRENT).withColumn("part", F.lit("current"))
    return hist.unionByName(now)


@query(
    "hist_curr_columns",
    ROW + " ValueCen_curr:d ValueCen_hist:d",
    """SELECT *, CASE WHEN year = 2001 THEN ValueCen END AS ValueCen_curr,
         CASE WHEN year <> 2001 THEN ValueCen END AS ValueCen_hist FROM sample""",
)
def hist_curr_columns(v):
    year, value = F.year("Date"), F.col("ValueCen")
    return v.meas.withColumns(
        {"ValueCen_curr": F.when(year == CURRENT, value), "ValueCen_hist": F.when(year != CURRENT, value)}
    )


@query("filter_site_type", "ParkCode SiteCode SiteName", "SELECT * FROM sites WHERE type = 'Stream'")
def filter_site_type(v):
    return v.sites.where(F.col("type") == "Stream")


@query("filter_target_months", ROW + " SiteType", f"SELECT * FROM sample WHERE {TARGET_MONTH}")
def filter_target_months(v):
    return v.meas.where(filters.target_month(F.col("SiteType"), F.month("Date")))


@query(
    "filter_nutrients_by_type",
    PAIR + " SiteType",
    f"""SELECT p.*, type AS SiteType FROM ({PAIRS}) AS p JOIN sites ON SiteCode = Site
        WHERE {TARGET_NUTRIENT.replace('SiteType', 'type')}""",
)
def filter_nutrients_by_type(v):
    types = v.sites.select("SiteCode", F.col("type").alias("SiteType"))
    rows = joins.left_join(pairs(v), types, {"Site": "SiteCode"})
    return rows.where(filters.target_nutrient(F.col("SiteType"), F.col("Characteristic")))


@query("filter_exclude_chars", PAIR, f"SELECT * FROM ({PAIRS}) WHERE Characteristic NOT IN ('Temp_C', 'ChlA_ugL')")
def filter_exclude_chars(v):
    return filters.exclude_chars(pairs(v), ["Temp_C", "ChlA_ugL"])


@query(
    "filter_drop_position",
    PAIR,
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Park, Site ORDER BY Characteristic) AS i
        FROM ({PAIRS})) WHERE i <> 7""",
)
def filter_drop_position(v):
    return filters.drop_position(pairs(v), 7)


@query("filter_compare_nutrients", ROW, "SELECT * FROM now WHERE Characteristic IN ('TN_mgL', 'TP_ugL')")
def filter_compare_nutrients(v):
    return catalog.get_wdata(v.meas, char=filters.COMPARED_NUTRIENTS, years=CURRENT)


@query("filter_not_null", ROW, "SELECT * FROM meas WHERE ValueCen IS NOT NULL")
def filter_not_null(v):
    return v.meas.where(F.col("ValueCen").isNotNull())


@query(
    "filter_current_sites",
    "ParkCode SiteCode SiteName",
    "SELECT * FROM sites WHERE SiteCode IN (SELECT Site FROM now)",
)
def filter_current_sites(v):
    return filters.current_sites(v.sites, v.meas, CURRENT)


@query(
    "filter_shared_chars",
    "Park Characteristic n_sites:i",
    f"""SELECT Park, Characteristic, count(DISTINCT Site) AS n_sites FROM ({PAIRS})
        GROUP BY Park, Characteristic HAVING count(DISTINCT Site) > 1""",
)
def filter_shared_chars(v):
    return filters.shared_characteristics(pairs(v))


def _classed(v):
    rows = boxplot_rows(v.meas, v.sites, year_from=YEAR_FROM, current_year=CURRENT)
    rows = with_points(filters.current(rows, CURRENT), v.chars)
    return rows.withColumn("pcolor", box_class(F.col("ValueCen"), F.col("year"), CURRENT))


_CLASSED = f"""SELECT * FROM (SELECT *, {beyond('ValueCen', 'Poor WQ value', 'Current value', 'year = 2001')} AS pcolor
  FROM {BOX_SOURCE} AS b LEFT JOIN points USING (Park, Site, Characteristic) WHERE year = 2001)"""


@query("filter_poor", ROW + " pcolor", f"{_CLASSED} WHERE pcolor = 'Poor WQ value'")
def filter_poor(v):
    return _classed(v).where(F.col("pcolor") == "Poor WQ value")


@query("filter_current_value", ROW + " pcolor", f"{_CLASSED} WHERE pcolor = 'Current value'")
def filter_current_value(v):
    return _classed(v).where(F.col("pcolor") == "Current value")


@query(
    "project_columns",
    "site_code char_name sampled:t value:d",
    "SELECT Site AS site_code, Characteristic AS char_name, Date AS sampled, ValueCen AS value FROM meas",
)
def project_columns(v):
    names = {"Site": "site_code", "Characteristic": "char_name", "Date": "sampled", "ValueCen": "value"}
    return v.meas.select(*names).withColumnsRenamed(names)


@query("sort_date", ROW, "SELECT * FROM meas")
def sort_date(v):
    return v.meas.orderBy("Date", "Park", "Site", "Characteristic", "ValueCen")


@query("sort_site_char", "SiteName Characteristic Date:t ValueCen:d",
       "SELECT * FROM now JOIN sites ON SiteCode = Site")
def sort_site_char(v):
    rows = joins.left_join(catalog.get_wdata(v.meas, years=CURRENT), v.sites.select("SiteCode", "SiteName"),
                           {"Site": "SiteCode"})
    return rows.orderBy("SiteName", "Characteristic", "Date", "ValueCen")


@query("sort_distinct_months", "month_num:i month", "SELECT DISTINCT month_num, month FROM sample")
def sort_distinct_months(v):
    return with_calendar(v.meas).select("month_num", "month").distinct().orderBy("month_num")


@query(
    "limit_first",
    ROW,
    f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Park, Site ORDER BY Date, Characteristic, ValueCen) AS i
          FROM (SELECT *, {beyond('ValueCen', 'orange', 'black')} AS pcolor
                FROM now LEFT JOIN points USING (Park, Site, Characteristic)) WHERE pcolor = 'orange')
        WHERE i = 1""",
)
def limit_first(v):
    """The first value beyond its points of each site, by partial aggregation."""
    rows = with_points(catalog.get_wdata(v.meas, years=CURRENT), v.chars)
    beyond_ = rows.where(band_class(F.col("ValueCen")) == "orange")
    return beyond_.groupBy("Park", "Site").agg(F.min(F.struct("Date", "Characteristic", "ValueCen")).alias("first")) \
        .select("Park", "Site", "first.*")


@query(
    "head_preview",
    ROW,
    "SELECT * FROM meas ORDER BY Date, Park, Site, Characteristic, ValueCen NULLS FIRST LIMIT 6",
)
def head_preview(v):
    return v.meas.orderBy("Date", "Park", "Site", "Characteristic", "ValueCen").limit(6)


@query("sort_unique_chars", "Characteristic", "SELECT DISTINCT Characteristic FROM meas")
def sort_unique_chars(v):
    return v.meas.select("Characteristic").distinct().orderBy("Characteristic")


@query("set_concat", PAIR + " SiteType",
       f"SELECT p.*, type AS SiteType FROM ({PAIRS}) AS p JOIN sites ON SiteCode = Site")
def set_concat(v):
    rows = pairs(v).join(v.sites.select(F.col("SiteCode").alias("Site"), F.col("type").alias("SiteType")), "Site")
    return rows.where(F.col("SiteType") == "Lake").unionByName(rows.where(F.col("SiteType") == "Stream"))


@query("set_member", PAIR + " Date:t", "SELECT * FROM meas WHERE Site IN (SELECT Site FROM now)")
def set_member(v):
    return joins.semi_join(v.meas, catalog.get_wdata(v.meas, years=CURRENT), ["Site"])


@query(
    "set_minus",
    PAIR,
    f"""SELECT * FROM ({PAIRS}) AS p WHERE NOT EXISTS (
          SELECT 1 FROM now AS n WHERE n.Park = p.Park AND n.Site = p.Site
            AND n.Characteristic = p.Characteristic)""",
)
def set_minus(v):
    return joins.anti_join(pairs(v), catalog.get_wdata(v.meas, years=CURRENT),
                           ["Park", "Site", "Characteristic"])
