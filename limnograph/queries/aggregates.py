"""Aggregates, rankings and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnograph.functions.calendar import with_calendar
from limnograph.operators import aggregates, bands, box, catalog, filters, ranking, reshape
from limnograph.operators.thresholds import band_class, with_points
from limnograph.plans import drafts
from limnograph.plans.boxplot import boxplot_rows
from limnograph.queries.base import query
from limnograph.queries.filters import PAIRS, pairs
from limnograph.queries.joins import KEYS, MONTHLY, history, season_bands
from limnograph.queries.sql import (
    BOX_HISTORY,
    BOX_SOURCE,
    MONTH_KEYS,
    SEASON,
    bands as bands_sql,
    beyond,
    box_stats,
    fences,
)
from limnograph.sources.monitoring_view import CHARACTERISTICS, CURRENT, YEAR_FROM, YEAR_TO

SERIES = ["Park", "Site", "Characteristic"]


@query(
    "agg_monthly_bands",
    KEYS + " month num_samps:i median_val:d min_val:d max_val:d lower_100:d upper_100:d lower_95:d upper_95:d "
    "lower_50:d upper_50:d year_min:i year_max:i",
    f"SELECT * FROM {bands_sql()} AS b",
)
def agg_monthly_bands(v):
    return season_bands(v)


@query(
    "agg_pct_fun_bands",
    "Park Site Characteristic month mon_num:i num_samps:i median_val:d lower_100:d upper_100:d lower_95:d "
    "upper_95:d lower_50:d upper_50:d",
    f"""SELECT * EXCLUDE (month), month_num AS mon_num, strftime(make_date(2000, month_num, 1), '%B') AS month
        FROM {bands_sql(where='TRUE')} AS b""",
)
def agg_pct_fun_bands(v):
    return bands.percentile_bands(filters.historic(v.meas, YEAR_FROM, CURRENT))


_MEAN_BAND = """(SELECT * FROM (
    SELECT Park, Site, Characteristic, month_num, strftime(make_date(2000, month_num, 1), '%B') AS month,
      CASE WHEN count(ValueCen) = count(*) THEN avg(ValueCen) END AS mean, count(*) AS num_samps,
      quantile_cont(ValueCen, 0.025) AS lower_pct, quantile_cont(ValueCen, 0.975) AS upper_pct
    FROM sample WHERE year < 2001 GROUP BY Park, Site, Characteristic, month_num)
  WHERE num_samps >= 4 AND lower_pct IS NOT NULL)"""


@query("agg_pct95_mean", KEYS + " month mean:d num_samps:i lower_pct:d upper_pct:d",
       f"SELECT * FROM {_MEAN_BAND} AS b")
def agg_pct95_mean(v):
    return bands.mean_and_95_band(filters.historic(v.meas, None, CURRENT))


@query(
    "agg_site_month_range",
    KEYS + " max_val:d min_val:d",
    """SELECT Park, Site, Characteristic, month_num,
         CASE WHEN count(ValueCen) = count(*) THEN max(ValueCen) END AS max_val,
         CASE WHEN count(ValueCen) = count(*) THEN min(ValueCen) END AS min_val
       FROM hist GROUP BY Park, Site, Characteristic, month_num""",
)
def agg_site_month_range(v):
    return bands.site_month_range(catalog.get_wdata(v.meas, years=(YEAR_FROM, YEAR_TO)))


@query(
    "agg_years_active",
    "Site start_date last_date",
    """SELECT Site, strftime(min(Date), '%b %Y') AS start_date, strftime(max(Date), '%b %Y') AS last_date
       FROM meas GROUP BY Site""",
)
def agg_years_active(v):
    return aggregates.years_active(v.meas)


@query("agg_month_mean", "Characteristic month:i avg_value:d",
       "SELECT Characteristic, month_num AS month, avg(ValueCen) AS avg_value FROM sample GROUP BY ALL")
def agg_month_mean(v):
    return aggregates.month_mean(v.meas, "ValueCen", ["Characteristic"])


@query("agg_bbox_center", "ParkCode long_cent:d lat_cent:d",
       "SELECT ParkCode, (LongE + LongW) / 2 AS long_cent, (LatN + LatS) / 2 AS lat_cent FROM boxes")
def agg_bbox_center(v):
    return aggregates.bbox_center(v.boxes)


@query("agg_multi_site_flag", "Park show_comp:b",
       "SELECT Park, count(DISTINCT Site) > 1 AS show_comp FROM now GROUP BY Park")
def agg_multi_site_flag(v):
    return aggregates.multi_site_flag(filters.current(v.meas, CURRENT))


@query("agg_all_lake", "Park Site Characteristic all_lake:b",
       "SELECT Park, Site, Characteristic, bool_and(SiteType = 'Lake') AS all_lake FROM meas GROUP BY ALL")
def agg_all_lake(v):
    return aggregates.all_lake(v.meas, SERIES)


@query(
    "agg_panel_count",
    "Park Site n_panels:i layout_rows:i",
    f"""SELECT Park, Site, count(*) AS n_panels, CASE WHEN count(*) > 4 THEN 3 ELSE 2 END AS layout_rows
        FROM ({PAIRS}) GROUP BY Park, Site""",
)
def agg_panel_count(v):
    return aggregates.panel_count(pairs(v))


@query(
    "agg_axis_domain",
    "Park Site Characteristic first_month:i last_month:i line_start:d line_end:d",
    f"""SELECT *, CASE first_month WHEN 6 THEN first_month - 1 WHEN 5 THEN first_month - 1.5 END AS line_start,
          CASE first_month WHEN 6 THEN last_month + 1 WHEN 5 THEN last_month + 1.5 END AS line_end
        FROM (SELECT Park, Site, Characteristic, min(month_num) AS first_month, max(month_num) AS last_month
              FROM {BOX_SOURCE} AS b GROUP BY Park, Site, Characteristic)""",
)
def agg_axis_domain(v):
    rows = boxplot_rows(v.meas, v.sites, year_from=YEAR_FROM, current_year=CURRENT)
    return aggregates.axis_domain(rows, SERIES)


@query("agg_distinct", "Park Site Category", "SELECT DISTINCT Park, Site, Category FROM meas")
def agg_distinct(v):
    return v.meas.select("Park", "Site", "Category").distinct()


BOX = "n:i q1:d median:d q3:d lower_fence:d upper_fence:d lower_whisker:d upper_whisker:d n_outliers:i"


def _box_history(v):
    rows = boxplot_rows(v.meas, v.sites, year_from=YEAR_FROM, current_year=CURRENT)
    return filters.historic(rows, YEAR_FROM, YEAR_TO + 1)


@query("agg_box_stats_monthly", f"{KEYS} {BOX}",
       f"SELECT * FROM {box_stats(BOX_HISTORY, MONTH_KEYS, 'hazen')} AS b")
def agg_box_stats_monthly(v):
    return box.box_stats(_box_history(v), MONTHLY, method="hazen")


@query("agg_box_stats_monthly_type7", f"{KEYS} {BOX}",
       f"SELECT * FROM {box_stats(BOX_HISTORY, MONTH_KEYS, 'type7')} AS b")
def agg_box_stats_monthly_type7(v):
    return box.box_stats(_box_history(v), MONTHLY, method="type7")


@query(
    "agg_box_stats_annual",
    f"Park Characteristic box_year:i {BOX}",
    f"""SELECT *, year AS box_year FROM {box_stats('sample', 'Park, Characteristic, year', 'type7')} AS b""",
)
def agg_box_stats_annual(v):
    return drafts.box_stats_annual(v.meas).withColumnRenamed("Year", "box_year")


# The samples are evenly spread and have no outliers; their sixth power has.
_SKEWED = "(SELECT * REPLACE (ValueCen * ValueCen * ValueCen * ValueCen * ValueCen * ValueCen AS ValueCen) FROM sample)"


@query(
    "agg_box_outliers_annual",
    "Park Site Characteristic box_year:i Date:t ValueCen:d",
    f"""SELECT s.*, year AS box_year FROM {_SKEWED} AS s
        JOIN {fences(_SKEWED, 'Park, Characteristic, year', 'type7')} AS f USING (Park, Characteristic, year)
        WHERE ValueCen < lower_fence OR ValueCen > upper_fence""",
)
def agg_box_outliers_annual(v):
    skewed = v.meas.withColumn("ValueCen", F.expr(" * ".join(["ValueCen"] * 6)))
    return drafts.box_outliers_annual(skewed).withColumnRenamed("Year", "box_year")


_READINGS = "(SELECT event_type, CAST(ts AS DATE) AS day, value AS ValueCen FROM events)"


def _readings(v):
    return v.table("events").select(
        "event_type", F.col("ts").cast("date").alias("day"), F.col("value").alias("ValueCen")
    )


@query("agg_box_stats_daily", f"event_type day:t {BOX}",
       f"SELECT * FROM {box_stats(_READINGS, 'event_type, day', 'hazen')} AS b")
def agg_box_stats_daily(v):
    return box.box_stats(_readings(v), ["event_type", "day"], method="hazen")


@query(
    "agg_box_outliers_daily",
    "event_type day:t ValueCen:d q1:d q3:d",
    f"""SELECT s.*, q1, q3 FROM {_READINGS} AS s JOIN {fences(_READINGS, 'event_type, day', 'hazen')} AS f
          USING (event_type, day)
        WHERE ValueCen < lower_fence OR ValueCen > upper_fence""",
)
def agg_box_outliers_daily(v):
    keys = ["event_type", "day"]
    return box.box_outliers(_readings(v), box.box_fences(_readings(v), keys), keys)


@query(
    "agg_t_test_1samp",
    "Characteristic n:i df:i mean:d sd:d t:d",
    """SELECT Characteristic, count(ValueCen) AS n, count(ValueCen) - 1 AS df, avg(ValueCen) AS mean,
         stddev_samp(ValueCen) AS sd, avg(ValueCen) / (stddev_samp(ValueCen) / sqrt(count(ValueCen))) AS t
       FROM meas GROUP BY Characteristic""",
)
def agg_t_test_1samp(v):
    return aggregates.t_test_1samp(v.meas, "ValueCen", ["Characteristic"])


# Two-sided t tail for whole degrees of freedom: a finite series in cos(atan(t / sqrt(df))), by odd and even df. The
# 97.5 % point is its expansion around the normal one in powers of 1 / df, good to six digits from 30 on.
_T_TAILS = """
WITH s AS (SELECT Park, Characteristic, count(ValueCen) AS n, count(ValueCen) - 1 AS df, avg(ValueCen) AS m,
             stddev_samp(ValueCen) / sqrt(count(ValueCen)) AS se
           FROM meas GROUP BY Park, Characteristic HAVING count(ValueCen) > 0),
a AS (SELECT *, CASE WHEN se > 0 THEN m / se END AS t, atan(abs(m / se) / sqrt(df)) AS th, 1.959963984540054::DOUBLE AS q FROM s),
b AS (SELECT *, list_sum(list_transform(range(0, CAST((df - df % 2) / 2 AS BIGINT)), lambda k: CASE WHEN df % 2 = 0
    THEN exp(2 * k * ln(cos(th)) + lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1))
    ELSE exp((2 * k + 1) * ln(cos(th)) + 2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) END)) AS total,
  q + (q**3 + q) / (4 * df) + (5 * q**5 + 16 * q**3 + 3 * q) / (96 * df**2)
    + (3 * q**7 + 19 * q**5 + 17 * q**3 - 15 * q) / (384 * df**3)
    + (79 * q**9 + 776 * q**7 + 1482 * q**5 - 1920 * q**3 - 945 * q) / (92160 * df**4) AS t975
  FROM a)
SELECT Park, Characteristic, n, t, CASE WHEN t IS NOT NULL THEN 1 - CASE WHEN df % 2 = 0 THEN sin(th) * coalesce(total, 0)
    ELSE 2 / pi() * (th + sin(th) * coalesce(total, 0)) END END AS p_value,
  m - t975 * se AS conf_low, m + t975 * se AS conf_high
FROM b"""


@query("agg_t_test_1samp_tails", "Park Characteristic n:i t:d p_value:d conf_low:d conf_high:d", _T_TAILS)
def agg_t_test_1samp_tails(v):
    return aggregates.t_test_1samp(v.meas, "ValueCen", ["Park", "Characteristic"])


def _extreme_year(side: str) -> str:
    return f"""SELECT Park, Site, Characteristic, month_num, max(year) FILTER (WHERE ValueCen = v) AS year_{side}
      FROM (SELECT *, {side}(ValueCen) OVER (PARTITION BY Park, Site, Characteristic, month_num) AS v
            FROM hist WHERE {SEASON}) GROUP BY Park, Site, Characteristic, month_num"""


@query("win_year_of_min", KEYS + " year_min:i", _extreme_year("min"))
def win_year_of_min(v):
    rows = with_calendar(history(v))
    return rows.groupBy(*MONTHLY).agg(bands.year_of_min().alias("year_min"))


@query("win_year_of_max", KEYS + " year_max:i", _extreme_year("max"))
def win_year_of_max(v):
    rows = with_calendar(history(v))
    return rows.groupBy(*MONTHLY).agg(bands.year_of_max().alias("year_max"))


@query(
    "win_last",
    "Park Site Characteristic last_date:t last_value:d",
    """SELECT Park, Site, Characteristic, Date AS last_date, ValueCen AS last_value FROM (
         SELECT *, row_number() OVER (PARTITION BY Park, Site, Characteristic
                                      ORDER BY Date DESC, ValueCen DESC NULLS LAST) AS i FROM meas)
       WHERE i = 1""",
)
def win_last(v):
    last = bands.last_by_date()
    return v.meas.groupBy(*SERIES).agg(F.max("Date").alias("last_date"), last.alias("last_value"))


@query(
    "win_first_match",
    "Park Site has_poor:b first_poor:t has_threshold:b first_threshold:t",
    f"""SELECT Park, Site, bool_or(coalesce(pcolor = 'orange', FALSE)) AS has_poor,
          min(Date) FILTER (WHERE pcolor = 'orange') AS first_poor,
          bool_or(UpperPoint IS NOT NULL) AS has_threshold,
          min(Date) FILTER (WHERE UpperPoint IS NOT NULL) AS first_threshold
        FROM (SELECT *, {beyond('ValueCen', 'orange', 'black')} AS pcolor
              FROM now LEFT JOIN points USING (Park, Site, Characteristic))
        GROUP BY Park, Site""",
)
def win_first_match(v):
    rows = with_points(catalog.get_wdata(v.meas, years=CURRENT), v.chars)
    matches = {"poor": band_class(F.col("ValueCen")) == "orange", "threshold": F.col("UpperPoint").isNotNull()}
    return ranking.first_match(rows, ["Park", "Site"], matches, "Date")


@query(
    "win_duplicated",
    "Park Site Characteristic is_dup:b",
    f"""SELECT *, row_number() OVER (PARTITION BY Park, Characteristic ORDER BY Site) > 1 AS is_dup
        FROM ({PAIRS})""",
)
def win_duplicated(v):
    return ranking.duplicated(pairs(v), ["Park", "Characteristic"], "Site")


@query(
    "win_line_order",
    KEYS + " median_val:d next_month_num:i next_median_val:d",
    f"""SELECT *, lead(month_num) OVER w AS next_month_num, lead(median_val) OVER w AS next_median_val
        FROM {bands_sql()} AS b
        WINDOW w AS (PARTITION BY Park, Site, Characteristic ORDER BY month_num)""",
)
def win_line_order(v):
    return ranking.line_segments(season_bands(v), SERIES, "median_val")


_NAMES = [row[1] for row in CHARACTERISTICS]
_IDS = ["Park", "Site", "Category", "Date", "SampleDepth", "TextValue", "Censored", "ValueCen"]
_WIDE = "Park Site Category Date:t SampleDepth TextValue Censored:b ValueCen:d occurrence:i"
_NUMBERED = f"""(SELECT *, row_number() OVER (PARTITION BY {', '.join(_IDS)}, Characteristic
    ORDER BY Value NULLS FIRST) AS occurrence FROM meas)"""


@query(
    "pivot_characteristics",
    _WIDE + "".join(f" {n}:d" for n in _NAMES),
    f"""SELECT {', '.join(_IDS)}, occurrence,
          {', '.join(f"min(Value) FILTER (WHERE Characteristic = '{n}') AS {n}" for n in _NAMES)}
        FROM {_NUMBERED} GROUP BY {', '.join(_IDS)}, occurrence""",
)
def pivot_characteristics(v):
    rows = v.meas.select(*_IDS, "Characteristic", "Value")
    return reshape.pivot_characteristics(rows, _NAMES)


@query(
    "pivot_names_from_data",
    _WIDE + "".join(f" {n}:d" for n in _NAMES) + " n_undeclared:i",
    f"""SELECT {', '.join(_IDS)}, occurrence, 0 AS n_undeclared,
          {', '.join(f"min(Value) FILTER (WHERE Characteristic = '{n}') AS {n}" for n in _NAMES)}
        FROM {_NUMBERED} GROUP BY {', '.join(_IDS)}, occurrence""",
)
def pivot_names_from_data(v):
    wide = reshape.pivot_characteristics(v.meas.select(*_IDS, "Characteristic", "Value"))
    return wide.withColumn("n_undeclared", F.size("undeclared"))


@query(
    "pivot_undeclared",
    _WIDE + " pH:d DO_mgL:d undeclared",
    f"""SELECT {', '.join(_IDS)}, occurrence, min(Value) FILTER (WHERE Characteristic = 'pH') AS pH,
          min(Value) FILTER (WHERE Characteristic = 'DO_mgL') AS DO_mgL,
          coalesce(string_agg(Characteristic || '=' || CAST(CAST(Value AS BIGINT) AS VARCHAR), ';' ORDER BY Characteristic)
            FILTER (WHERE Characteristic NOT IN ('pH', 'DO_mgL')), '') AS undeclared
        FROM {_NUMBERED} GROUP BY {', '.join(_IDS)}, occurrence""",
)
def pivot_undeclared(v):
    wide = reshape.pivot_characteristics(v.meas.select(*_IDS, "Characteristic", "Value"), ["pH", "DO_mgL"])
    rest = F.transform("undeclared", lambda u: F.concat_ws("=", u["name"], u["value"].cast("long").cast("string")))
    return wide.withColumn("undeclared", F.array_join(rest, ";"))


@query(
    "pivot_select_char",
    _WIDE + " DO_mgL:d",
    f"""SELECT {', '.join(_IDS)}, occurrence, Value AS DO_mgL FROM {_NUMBERED}
        WHERE Characteristic = 'DO_mgL' AND Value IS NOT NULL""",
)
def pivot_select_char(v):
    rows = v.meas.select(*_IDS, "Characteristic", "Value")
    return reshape.pivot_select(reshape.pivot_characteristics(rows, _NAMES), "DO_mgL", [*_IDS, "occurrence"])


@query(
    "collapse_rows",
    "Park Site Category Characteristic Category_repeats:b",
    f"""SELECT *, coalesce(lag(Category) OVER (PARTITION BY Park, Site ORDER BY Category, Characteristic)
             = Category, FALSE) AS Category_repeats
        FROM ({PAIRS})""",
)
def collapse_rows(v):
    return ranking.collapse_rows(pairs(v), ["Park", "Site"], ["Category", "Characteristic"], ["Category"])
