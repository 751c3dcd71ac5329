"""The composed report datasets."""

from __future__ import annotations

from limnograph.engine import Monitor
from limnograph.operators.filters import COMPARED_NUTRIENTS
from limnograph.plans import batch, drafts
from limnograph.plans.boxplot import boxplot
from limnograph.plans.params import ReportParams
from limnograph.plans.report_index import report_index
from limnograph.plans.site_comparison import site_comparison
from limnograph.plans.site_map import site_map
from limnograph.plans.waterbands import waterbands
from limnograph.queries.base import query
from limnograph.queries.scalars import PHOTOS, POPUP, SITE_ROWS
from limnograph.queries.sql import (
    BOXPLOT,
    BOXPLOT_COLUMNS,
    COMPARISON_COLUMNS,
    ECOREGIONS,
    PARK_CODE,
    RULES,
    SEASON,
    STANDARDS,
    STATE,
    WATERBANDS,
    WATERBANDS_COLUMNS,
    bands as bands_sql,
    comparison,
    smooth,
)
from limnograph.session import scratch_path
from limnograph.sources import tables
from limnograph.sources.monitoring_view import CURRENT, YEAR_FROM, YEAR_TO, park_code

PARAMS = ReportParams(YEAR_FROM, YEAR_TO, CURRENT)


@query("ds_waterbands", WATERBANDS_COLUMNS, WATERBANDS)
def ds_waterbands(v):
    return waterbands(v.meas, v.chars, year_historic=YEAR_FROM, year_current=CURRENT)


@query("ds_site_comparison", COMPARISON_COLUMNS, comparison())
def ds_site_comparison(v):
    return site_comparison(v.meas, v.sites, v.chars, year=CURRENT)


@query("ds_site_comparison_first", COMPARISON_COLUMNS, comparison(points="first"))
def ds_site_comparison_first(v):
    return site_comparison(v.meas, v.sites, v.chars, year=CURRENT, mode="first")


@query(
    "ds_site_comparison_lake",
    COMPARISON_COLUMNS,
    comparison(f"{SEASON} AND SiteType = 'Lake' AND Characteristic <> 'Temp_C'"),
)
def ds_site_comparison_lake(v):
    return site_comparison(v.meas, v.sites, v.chars, year=CURRENT, site_type="Lake", exclude=["Temp_C"])


@query("ds_boxplot", BOXPLOT_COLUMNS, BOXPLOT)
def ds_boxplot(v):
    return boxplot(v.meas, v.sites, v.chars, year_from=YEAR_FROM, year_to=YEAR_TO, current_year=CURRENT)


@query(
    "ds_site_map",
    "ParkCode SiteCode SiteName lat:d long:d type start_date last_date Description long_cent:d lat_cent:d Zoom:i "
    "minZoom:i LatS:d LongE:d LatN:d LongW:d popup",
    f"""SELECT *, {POPUP} AS popup, (LongE + LongW) / 2 AS long_cent, (LatN + LatS) / 2 AS lat_cent
        FROM {SITE_ROWS} AS r LEFT JOIN boxes USING (ParkCode)""",
)
def ds_site_map(v):
    return site_map(v.meas, v.sites, v.descriptions, v.boxes, photo_url=PHOTOS)


@query(
    "ds_site_report_index",
    "Park Site SiteName SiteType n_physical:i n_nutrient:i rows_physical:i rows_nutrient:i show_comp:b title",
    """SELECT *, CASE WHEN n_physical > 4 THEN 3 ELSE 2 END AS rows_physical,
         CASE WHEN n_nutrient > 4 THEN 3 ELSE 2 END AS rows_nutrient,
         'Historic (1995–2000) vs. Current (2001) Measurements' AS title
       FROM (
         SELECT s.ParkCode AS Park, SiteCode AS Site, SiteName, type AS SiteType,
           count(*) FILTER (WHERE Category = 'physical') AS n_physical,
           count(*) FILTER (WHERE Category = 'nutrients' AND (
             (type = 'Lake' AND CharName IN ('TP_ugL', 'TN_mgL', 'ChlA_ugL')) OR
             (type = 'Stream' AND CharName IN ('TP_ugL', 'TN_mgL', 'ANC_ueqL')))) AS n_nutrient
         FROM sites AS s LEFT JOIN chars USING (SiteCode) WHERE SiteCode IN (SELECT Site FROM now)
         GROUP BY ALL)
       LEFT JOIN (SELECT Park, count(DISTINCT Site) > 1 AS show_comp FROM now GROUP BY Park) USING (Park)""",
)
def ds_site_report_index(v):
    return report_index(v.meas, v.sites, v.chars, PARAMS)


_FULL = "strftime(Date, '%B')"


@query(
    "ds_all_sites",
    "Park Site Characteristic month_num:i month year Date:t ValueCen:d max_val:d min_val:d SiteName ptlabel",
    f"""SELECT n.* EXCLUDE (month, year), {_FULL} AS month, strftime(Date, '%Y') AS year, max_val, min_val, SiteName,
          regexp_replace(n.Characteristic, '_.*', '') AS ptlabel
        FROM now AS n LEFT JOIN (
          SELECT Park, Site, Characteristic, month_num,
            CASE WHEN count(ValueCen) = count(*) THEN max(ValueCen) END AS max_val,
            CASE WHEN count(ValueCen) = count(*) THEN min(ValueCen) END AS min_val
          FROM hist GROUP BY ALL) AS r USING (Park, Site, Characteristic, month_num)
        LEFT JOIN sites ON SiteCode = n.Site""",
)
def ds_all_sites(v):
    return drafts.all_sites(v.meas, v.sites, year_from=YEAR_FROM, year_to=YEAR_TO, current=CURRENT)


@query(
    "ds_monthly_physical",
    "Park Site Characteristic Date:t month_ch ValueCen:d mean:d num_samps:i lower_pct:d upper_pct:d",
    f"""SELECT n.*, {_FULL} AS month_ch, mean, num_samps, lower_pct, upper_pct
        FROM (SELECT * FROM now WHERE Category = 'physical') AS n LEFT JOIN (
          SELECT * FROM (
            SELECT Park, Site, Characteristic, month_num, count(*) AS num_samps,
              CASE WHEN count(ValueCen) = count(*) THEN avg(ValueCen) END AS mean,
              quantile_cont(ValueCen, 0.025) AS lower_pct, quantile_cont(ValueCen, 0.975) AS upper_pct
            FROM sample WHERE year < 2001 AND Category = 'physical'
            GROUP BY Park, Site, Characteristic, month_num)
          WHERE num_samps >= 4 AND lower_pct IS NOT NULL) AS b USING (Park, Site, Characteristic, month_num)""",
)
def ds_monthly_physical(v):
    return drafts.monthly_physical(v.meas, current=CURRENT)


def _rule(side: str) -> str:
    return f"""LEFT JOIN (SELECT * FROM {RULES}) AS {side}
      ON {side}.side = '{side}' AND {side}.park = code AND {side}.characteristic = j.Characteristic
        AND ({side}.depth IS NULL OR {side}.depth = SampleDepth)"""


@query(
    "ds_water_plot",
    "Park Site Characteristic mon_num:i month Date:t year SampleDepth ValueCen:d num_samps:i median_val:d lower_100:d "
    "upper_100:d lower_95:d upper_95:d lower_50:d upper_50:d LowerPoint:d UpperPoint:d outlier",
    f"""SELECT j.*, Lower.point AS LowerPoint, Upper.point AS UpperPoint,
          CASE WHEN ValueCen > Upper.point THEN 'TRUE' WHEN ValueCen < Lower.point THEN 'TRUE' ELSE 'FALSE' END AS outlier
        FROM (
          SELECT *, {PARK_CODE} AS code, month_num AS mon_num, strftime(make_date(2000, month_num, 1), '%B') AS month
          FROM (SELECT Park, Site, Characteristic, month_num, Date, CAST(year AS VARCHAR) AS year, SampleDepth, ValueCen FROM now)
          FULL OUTER JOIN (
            SELECT Park, Site, Characteristic, month_num, num_samps, median_val, lower_100, upper_100, lower_95,
              upper_95, lower_50, upper_50 FROM {bands_sql(where='TRUE')} AS b)
            USING (Park, Site, Characteristic, month_num)) AS j
        {_rule('Lower')} {_rule('Upper')}""",
)
def ds_water_plot(v):
    return drafts.bands_with_rules(v.meas, tables.rule_thresholds(v.spark), year_from=YEAR_FROM,
                                   current=CURRENT, park_code=park_code)


@query(
    "ds_water_plot_smooth",
    "Park Site Characteristic mon_num:d month Date:t ValueCen:d median_val:d smooth_median:f x_axis_pad:d "
    "LowerPoint:d UpperPoint:d outlier",
    f"""SELECT j.*, Lower.point AS LowerPoint, Upper.point AS UpperPoint,
          CASE WHEN ValueCen > Upper.point THEN 'TRUE' WHEN ValueCen < Lower.point THEN 'TRUE' ELSE 'FALSE' END AS outlier
        FROM (SELECT *, {PARK_CODE} AS code FROM (
          SELECT * FROM (SELECT Park, Site, Characteristic, month_num::DOUBLE AS mon_num, strftime(Date, '%B') AS month, Date, SampleDepth, ValueCen FROM now)
          FULL OUTER JOIN (
            SELECT Park, Site, Characteristic, mon_num, strftime(make_date(2000, month_num, 1), '%B') AS month, median_val, smooth_median,
              CASE g.mon_num WHEN 5 THEN 4.9 WHEN 10 THEN 10.1 ELSE g.mon_num END AS x_axis_pad
            FROM {smooth(bands_sql(where="TRUE"), 0.6)} AS g
            FULL OUTER JOIN (SELECT Park, Site, Characteristic, month_num::DOUBLE AS mon_num, month_num, median_val
              FROM {bands_sql(where="TRUE")} AS b) AS b USING (Park, Site, Characteristic, mon_num)) AS s
            USING (Park, Site, Characteristic, mon_num, month))) AS j
        {_rule('Lower')} {_rule('Upper')}""",
)
def ds_water_plot_smooth(v):
    return drafts.bands_with_rules(v.meas, tables.rule_thresholds(v.spark), year_from=YEAR_FROM,
                                   current=CURRENT, park_code=park_code, smooth_span=0.6)


@query(
    "ds_points_by_year",
    "Park Site Characteristic Date:t month month_num:i year ValueCen:d",
    "SELECT * EXCLUDE (year), CAST(year AS VARCHAR) AS year FROM sample WHERE year BETWEEN 1995 AND 2001",
)
def ds_points_by_year(v):
    return drafts.points_by_year(v.meas, year_from=YEAR_FROM, current=CURRENT)


@query(
    "ds_site_comps_nutrient",
    COMPARISON_COLUMNS,
    comparison("Characteristic IN ('TN_mgL', 'TP_ugL')", points="none"),
)
def ds_site_comps_nutrient(v):
    return drafts.site_comps_nutrient(v.meas, v.sites, v.chars, year=CURRENT, names=COMPARED_NUTRIENTS)


def _counts(name: str, sql: str) -> str:
    return f"""SELECT Park, 'WQ_parameters_' || Park || '.html' AS report, '{name}' AS dataset,
      count(*) AS n_rows FROM ({sql}) AS q GROUP BY Park"""


_STATED = f"(SELECT *, {STATE} AS site_state FROM (SELECT *, ParkCode AS Park FROM sites))"
_BATCH = " UNION ALL ".join(
    [
        _counts("waterbands", f"SELECT * FROM ({WATERBANDS}) WHERE Characteristic IN ('pH', 'DO_mgL', 'Temp_C')"),
        _counts("site_comparison", comparison()),
        *[_counts(f"site_comparison_{kind.lower()}",
                  comparison(f"{SEASON} AND SiteType = '{kind}' AND Characteristic <> 'Discharge_cfs'"))
          for kind in ("Lake", "Stream")],
        _counts("boxplot", BOXPLOT),
        _counts("report_index", "SELECT ParkCode AS Park FROM sites WHERE SiteCode IN (SELECT Site FROM now)"),
        _counts("site_map", f"SELECT ParkCode AS Park FROM {SITE_ROWS} AS r LEFT JOIN boxes USING (ParkCode)"),
        _counts("standards", f"""SELECT s.Park FROM {_STATED} AS s JOIN (SELECT * FROM {STANDARDS}) AS t ON t.state = s.site_state AND t.water_type = s.type
          UNION ALL SELECT s.ParkCode FROM sites AS s JOIN (SELECT * FROM {ECOREGIONS}) AS e ON e.water_type = s.type"""),
    ]
)


def _written(v, parks=None):
    monitor = Monitor.over(v, PARAMS)
    out = scratch_path(v.spark, "batch")
    monitor.write_batch(out, parks, descriptions=v.descriptions, boxes=v.boxes, park_code=park_code)
    return batch.written_counts(v.spark, batch.current_batch(v.spark, out))


@query("ds_batch_all_parks", "Park report dataset n_rows:i", _BATCH)
def ds_batch_all_parks(v):
    return _written(v)


@query("ds_batch_park_list", "Park report dataset n_rows:i",
       f"SELECT * FROM ({_BATCH}) AS b WHERE Park IN ('AFRICA', 'ASIA')")
def ds_batch_park_list(v):
    return _written(v, ["AFRICA", "ASIA"])


@query(
    "ds_waterbands_given_points",
    "Park Site Characteristic month_num:i year_curr:i ValueCen_curr:d median_val:d AssessmentPoint:d pcolor param_name unit yname",
    f"""SELECT * EXCLUDE (param_name, unit, yname, pcolor), 'Reading' AS param_name, 'units' AS unit, 'Reading, all units' AS yname,
          CASE WHEN ValueCen_curr IS NULL THEN NULL WHEN ValueCen_curr > AssessmentPoint THEN 'orange' ELSE 'black' END AS pcolor
        FROM (SELECT *, unnest([20.0, 30.0]) AS AssessmentPoint FROM ({WATERBANDS}) AS w)""",
)
def ds_waterbands_given_points(v):
    return waterbands(v.meas, v.chars, year_historic=YEAR_FROM, year_current=CURRENT, assessment=[20.0, 30.0],
                      param_name="Reading", unit="units", yname="Reading, all units")
