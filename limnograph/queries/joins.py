"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnograph.functions.calendar import month_full, with_calendar, year_text
from limnograph.operators import bands, catalog, filters, joins, loess
from limnograph.operators.aggregates import years_active
from limnograph.operators.thresholds import with_points
from limnograph.plans.site_comparison import join_site_names as named_sites
from limnograph.plans.waterbands import current_values, waterbands_from
from limnograph.queries.base import query
from limnograph.queries.filters import PAIRS, pairs
from limnograph.queries.sql import SEASON, bands as bands_sql
from limnograph.sources.monitoring_view import CURRENT, YEAR_FROM

SEASON_MONTHS = range(5, 11)
MONTHLY = ["Park", "Site", "Characteristic", "month_num"]
KEYS = "Park Site Characteristic month_num:i"


def history(v):
    return catalog.get_wdata(filters.historic(v.meas, YEAR_FROM, CURRENT), months=SEASON_MONTHS)


def season_bands(v):
    return bands.monthly_bands(history(v))


@query("join_site_type", "Park Site Characteristic Date:t ValueCen:d type",
       "SELECT n.*, type FROM now AS n LEFT JOIN sites ON SiteCode = Site")
def join_site_type(v):
    types = v.sites.select(F.col("SiteCode").alias("Site"), "type")
    return joins.left_join(catalog.get_wdata(v.meas, years=CURRENT), types, ["Site"])


@query("join_site_type_renamed", "Park sitecode charname SiteType",
       f"SELECT Park, Site AS sitecode, Characteristic AS charname, type AS SiteType FROM ({PAIRS}) LEFT JOIN sites ON SiteCode = Site")
def join_site_type_renamed(v):
    named = pairs(v).withColumnsRenamed({"Site": "sitecode", "Characteristic": "charname"})
    key = v.sites.select(F.col("SiteCode").alias("Site"), F.col("type").alias("SiteType"))
    return joins.left_join(named, key, {"sitecode": "Site"})


_ACTIVE = """(SELECT Site, strftime(min(Date), '%b %Y') AS start_date, strftime(max(Date), '%b %Y') AS last_date
  FROM meas WHERE Category = 'physical' GROUP BY Site)"""


@query("join_years_active", "SiteCode SiteName start_date last_date",
       f"SELECT * FROM sites LEFT JOIN {_ACTIVE} AS a ON a.Site = SiteCode")
def join_years_active(v):
    active = years_active(catalog.get_wdata(v.meas, category="physical"))
    return joins.left_join(v.sites, active, {"SiteCode": "Site"})


@query("join_site_description", "ParkCode SiteCode SiteName Description",
       "SELECT * FROM sites LEFT JOIN descriptions USING (SiteCode, ParkCode, SiteName)")
def join_site_description(v):
    return joins.left_join(v.sites, v.descriptions, ["SiteCode", "ParkCode", "SiteName"])


_YEARS = f"""(SELECT Park, Site, Characteristic, month_num,
    max(CASE WHEN ValueCen = low THEN year END) AS year_min,
    max(CASE WHEN ValueCen = high THEN year END) AS year_max
  FROM (SELECT *, min(ValueCen) OVER w AS low, max(ValueCen) OVER w AS high FROM hist WHERE {SEASON}
        WINDOW w AS (PARTITION BY Park, Site, Characteristic, month_num))
  GROUP BY Park, Site, Characteristic, month_num)"""


@query("join_minmax_years", KEYS + " year_min:i year_max:i", f"SELECT * FROM {_YEARS}")
def join_minmax_years(v):
    rows = with_calendar(history(v))
    low = rows.groupBy(*MONTHLY).agg(bands.year_of_min().alias("year_min"))
    high = rows.groupBy(*MONTHLY).agg(bands.year_of_max().alias("year_max"))
    return joins.full_join(high, low)


@query(
    "join_summary_range",
    KEYS + " num_samps:i median_val:d year_min:i year_max:i",
    f"""SELECT * FROM {bands_sql(keep='TRUE')} AS b""",
)
def join_summary_range(v):
    rows = with_calendar(history(v))
    years = rows.groupBy(*MONTHLY).agg(bands.year_of_min().alias("year_min"),
                                       bands.year_of_max().alias("year_max"))
    counts = bands.group_quantiles(rows, MONTHLY, "ValueCen", {"median_val": 0.5},
                                   aggs=[F.sum("_w").alias("num_samps")])
    return joins.full_join(counts, years)


@query(
    "join_hist_current",
    KEYS + " month num_samps:i median_val:d lower_95:d upper_95:d Date:t year_curr:i ValueCen_curr:d",
    f"""SELECT coalesce(b.Park, c.Park) AS Park, coalesce(b.Site, c.Site) AS Site,
          coalesce(b.Characteristic, c.Characteristic) AS Characteristic,
          coalesce(b.month, c.month) AS month, coalesce(b.month_num, c.month_num) AS month_num,
          num_samps, median_val, lower_95, upper_95, Date, year AS year_curr, ValueCen AS ValueCen_curr
        FROM {bands_sql()} AS b FULL OUTER JOIN (SELECT * FROM now WHERE {SEASON}) AS c
          ON b.Park = c.Park AND b.Site = c.Site AND b.Characteristic = c.Characteristic
            AND b.month_num = c.month_num""",
)
def join_hist_current(v):
    return waterbands_from(season_bands(v), current_values(v.meas, CURRENT, SEASON_MONTHS))


@query("join_site_names", "Park Site SiteName Characteristic Date:t ValueCen:d",
       "SELECT n.*, SiteName FROM now AS n JOIN sites ON SiteCode = Site")
def join_site_names(v):
    return named_sites(catalog.get_wdata(v.meas, years=CURRENT).drop("SiteType"), v.sites)


_RANGE = """(SELECT Park, Site, Characteristic, month_num,
    CASE WHEN count(ValueCen) = count(*) THEN max(ValueCen) END AS max_val,
    CASE WHEN count(ValueCen) = count(*) THEN min(ValueCen) END AS min_val
  FROM hist GROUP BY Park, Site, Characteristic, month_num)"""


@query(
    "join_range_left",
    KEYS + " Date:t ValueCen:d max_val:d min_val:d",
    f"SELECT * FROM now LEFT JOIN {_RANGE} AS r USING (Park, Site, Characteristic, month_num)",
)
def join_range_left(v):
    ranges = bands.site_month_range(filters.historic(v.meas, YEAR_FROM, CURRENT))
    now = with_calendar(catalog.get_wdata(v.meas, years=CURRENT))
    return joins.left_join(now, ranges, MONTHLY)


@query("join_names_left", "Site Characteristic Date:t site_name",
       "SELECT n.*, SiteName AS site_name FROM now AS n LEFT JOIN sites ON SiteCode = Site")
def join_names_left(v):
    key = v.sites.select(F.col("SiteCode").alias("site_list"), F.col("SiteName").alias("site_name"))
    return joins.left_join(catalog.get_wdata(v.meas, years=CURRENT), key, {"Site": "site_list"})


@query(
    "join_month_label",
    "Park Site Characteristic month_ch Date:t ValueCen:d mean:d num_samps:i",
    """SELECT * FROM (SELECT *, strftime(Date, '%B') AS month_ch FROM now) LEFT JOIN (
         SELECT Park, Site, Characteristic, strftime(Date, '%B') AS month_ch, count(*) AS num_samps,
           CASE WHEN count(ValueCen) = count(*) THEN avg(ValueCen) END AS mean
         FROM hist GROUP BY ALL) AS h USING (Park, Site, Characteristic, month_ch)""",
)
def join_month_label(v):
    label = month_full(F.col("Date")).alias("month_ch")
    keys = ["Park", "Site", "Characteristic", "month_ch"]
    hist = filters.historic(v.meas, YEAR_FROM, CURRENT).select("*", label).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_samps"),
        bands.strict_agg(F.avg("ValueCen"), F.col("ValueCen")).alias("mean"),
    )
    return joins.left_join(catalog.get_wdata(v.meas, years=CURRENT).select("*", label), hist, keys)


_FULL = "strftime(make_date(2000, month_num, 1), '%B')"


@query(
    "join_current_bands_full",
    "mon_num:i Park month Site Characteristic Date:t year ValueCen:d num_samps:i median_val:d lower_50:d upper_50:d",
    f"""SELECT month_num AS mon_num, {_FULL} AS month, * EXCLUDE (month_num, year), CAST(year AS VARCHAR) AS year
        FROM (SELECT Park, Site, Characteristic, month_num, Date, year, ValueCen FROM now)
        FULL OUTER JOIN (SELECT Park, Site, Characteristic, month_num, num_samps, median_val, lower_50, upper_50
          FROM {bands_sql(where='TRUE')} AS b) AS b USING (Park, Site, Characteristic, month_num)""",
)
def join_current_bands_full(v):
    band = bands.percentile_bands(filters.historic(v.meas, YEAR_FROM, CURRENT))
    now = catalog.get_wdata(v.meas, years=CURRENT).select(
        "Park", "Site", "Characteristic", "Date", "ValueCen", F.month("Date").alias("mon_num"),
        month_full(F.col("Date")).alias("month"), year_text(F.col("Date")).alias("year"),
    )
    return joins.full_join(now, band, ["mon_num", "Park", "month", "Site", "Characteristic"], hot=True)


@query(
    "join_loess_grid",
    "Park Site Characteristic half_month:i median_val:d on_grid:b",
    f"""WITH b AS (SELECT * FROM {bands_sql()} AS x),
        g AS (SELECT Park, Site, Characteristic, unnest(range(10, 21)) AS half_month
              FROM (SELECT DISTINCT Park, Site, Characteristic FROM b))
        SELECT coalesce(b.Park, g.Park) AS Park, coalesce(b.Site, g.Site) AS Site,
          coalesce(b.Characteristic, g.Characteristic) AS Characteristic,
          coalesce(month_num * 2, half_month) AS half_month, median_val, g.Park IS NOT NULL AS on_grid
        FROM b FULL OUTER JOIN g ON b.Park = g.Park AND b.Site = g.Site
          AND b.Characteristic = g.Characteristic AND b.month_num * 2 = half_month""",
)
def join_loess_grid(v):
    band = bands.percentile_bands(history(v))
    smooth = loess.loess_bands(band, columns={"median_val": "smooth_median"})
    grid = smooth.select("Park", "Site", "Characteristic", "mon_num", F.lit(True).alias("on_grid"))
    joined = loess.bands_on_grid(band, grid)
    return joined.withColumn("on_grid", F.coalesce("on_grid", F.lit(False)))


@query(
    "lookup_threshold",
    "Park Site Characteristic Date:t ValueCen:d LowerPoint:d UpperPoint:d",
    "SELECT * FROM now LEFT JOIN points USING (Park, Site, Characteristic)",
)
def lookup_threshold(v):
    return with_points(catalog.get_wdata(v.meas, years=CURRENT), v.chars)


@query("semi_join", "Park Site Characteristic Date:t",
       "SELECT * FROM hist WHERE Site IN (SELECT Site FROM now)")
def semi_join(v):
    return joins.semi_join(filters.historic(v.meas, YEAR_FROM, CURRENT), filters.current(v.meas, CURRENT), ["Site"])
