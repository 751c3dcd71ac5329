"""Threshold classes and lookups, and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnograph.functions.calendar import FIELD_SEASON
from limnograph.functions.codes import state_of_park
from limnograph.operators import checks, thresholds
from limnograph.operators.catalog import get_wdata, list_site_chars
from limnograph.plans.boxplot import boxplot_rows
from limnograph.queries.base import query
from limnograph.queries.joins import season_bands
from limnograph.queries.sql import (
    BOX_SOURCE,
    ECOREGIONS,
    PARK_CODE,
    RULES,
    STANDARDS,
    STATE,
    bands as bands_sql,
    beyond,
)
from limnograph.session import scratch_path
from limnograph.sources import tables
from limnograph.sources.monitoring_view import CURRENT, YEAR_FROM, park_code
from limnograph.streaming import exceedance

FLAGGED = "Park Site Characteristic Date:t ValueCen:d LowerPoint:d UpperPoint:d pcolor"


@query(
    "flag_exceedance_bands",
    FLAGGED,
    f"SELECT *, {beyond('ValueCen', 'orange', 'black')} AS pcolor FROM now LEFT JOIN points USING (Park, Site, Characteristic)",
)
def flag_exceedance_bands(v):
    rows = thresholds.with_points(get_wdata(v.meas, years=CURRENT), v.chars)
    return rows.withColumn("pcolor", thresholds.band_class(F.col("ValueCen")))


@query(
    "flag_exceedance_box",
    FLAGGED,
    f"""SELECT *, {beyond('ValueCen', 'Poor WQ value', 'Current value', 'year = 2001')} AS pcolor
        FROM {BOX_SOURCE} AS b LEFT JOIN points USING (Park, Site, Characteristic)""",
)
def flag_exceedance_box(v):
    rows = boxplot_rows(v.meas, v.sites, year_from=YEAR_FROM, current_year=CURRENT)
    rows = thresholds.with_points(rows, v.chars)
    return rows.withColumn("pcolor", thresholds.box_class(F.col("ValueCen"), F.col("year"), CURRENT))


@query(
    "flag_exceedance_box_v1",
    FLAGGED + " ValueCen_curr:d",
    f"""SELECT *, {beyond('ValueCen_curr', 'Poor WQ value', 'Current value')} AS pcolor FROM (
          SELECT *, CASE WHEN year = 2001 THEN ValueCen END AS ValueCen_curr FROM {BOX_SOURCE} AS b)
        LEFT JOIN points USING (Park, Site, Characteristic)""",
)
def flag_exceedance_box_v1(v):
    rows = boxplot_rows(v.meas, v.sites, year_from=YEAR_FROM, current_year=CURRENT)
    rows = rows.withColumn("ValueCen_curr", F.when(F.col("year") == CURRENT, F.col("ValueCen")))
    rows = thresholds.with_points(rows, v.chars)
    pcolor = thresholds.beyond_points(F.col("ValueCen_curr"), "Poor WQ value", "Current value")
    return rows.withColumn("pcolor", pcolor)


@query(
    "flag_outlier_text",
    "Park Site Characteristic Date:t ValueCen:d outlier",
    """SELECT *, CASE WHEN ValueCen > UpperPoint THEN 'TRUE' WHEN ValueCen < LowerPoint THEN 'TRUE' ELSE 'FALSE' END
         AS outlier FROM now LEFT JOIN points USING (Park, Site, Characteristic)""",
)
def flag_outlier_text(v):
    rows = thresholds.with_points(get_wdata(v.meas, years=CURRENT), v.chars)
    return rows.withColumn("outlier", thresholds.outlier_text(F.col("ValueCen")))


def _rule(side: str) -> str:
    return f"""(SELECT point FROM (SELECT * FROM {RULES}) AS r WHERE r.side = '{side}' AND r.park = code
      AND r.characteristic = m.Characteristic AND (r.depth IS NULL OR r.depth = m.SampleDepth))"""


RULED = f"""SELECT m.*, {_rule('Lower')} AS LowerPoint, {_rule('Upper')} AS UpperPoint
  FROM (SELECT *, {PARK_CODE} AS code FROM now) AS m"""


@query("rule_thresholds", "Park Site Characteristic SampleDepth Date:t LowerPoint:d UpperPoint:d", RULED)
def rule_thresholds(v):
    rows = get_wdata(v.meas, years=CURRENT).withColumn("code", park_code(F.col("Park")))
    return thresholds.with_rule_points(rows, tables.rule_thresholds(v.spark), park="code")


@query(
    "lookup_state_standards",
    "SiteCode type state class max_temp_f min_do ph_range max_tn max_tp max_chla min_secchi turbidity",
    f"""SELECT s.SiteCode, s.type, t.* FROM (SELECT *, {STATE} AS site_state FROM (SELECT *, ParkCode AS Park FROM sites)) AS s
        JOIN (SELECT * FROM {STANDARDS}) AS t ON t.state = s.site_state AND t.water_type = s.type""",
)
def lookup_state_standards(v):
    sites = v.sites.select("SiteCode", F.col("type"), F.col("type").alias("water_type"),
                           state_of_park(park_code(F.col("ParkCode"))).alias("state"))
    return sites.join(F.broadcast(tables.state_standards(v.spark)), ["state", "water_type"])


@query(
    "lookup_epa_thresholds",
    "SiteCode type disturbance tp tn chla turbidity conductivity",
    f"SELECT s.SiteCode, s.type, e.* FROM sites AS s JOIN (SELECT * FROM {ECOREGIONS}) AS e ON e.water_type = s.type",
)
def lookup_epa_thresholds(v):
    sites = v.sites.select("SiteCode", F.col("type"), F.col("type").alias("water_type"))
    return sites.join(F.broadcast(tables.ecoregion_thresholds(v.spark)), "water_type")


@query(
    "assessment_override",
    "Park Site Characteristic month_num:i median_val:d AssessmentPoint:d above:b",
    f"""SELECT *, median_val > AssessmentPoint AS above
        FROM (SELECT *, unnest([20.0, 30.0]) AS AssessmentPoint FROM {bands_sql()} AS b)""",
)
def assessment_override(v):
    rows = thresholds.with_given_points(season_bands(v), [20.0, 30.0])
    return rows.withColumn("above", F.col("median_val") > F.col("AssessmentPoint"))


@query(
    "assessment_first",
    "Park Site Characteristic Date:t ValueCen:d LowerPoint:d UpperPoint:d",
    """SELECT n.*, f.LowerPoint, f.UpperPoint FROM now AS n LEFT JOIN (
         SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Park, Characteristic ORDER BY Site) AS i FROM points)
         WHERE i = 1) AS f ON f.Park = n.Park AND f.Characteristic = n.Characteristic""",
)
def assessment_first(v):
    return thresholds.with_points(get_wdata(v.meas, years=CURRENT), v.chars, mode="first")


def _check(name: str, missing: str):
    @query(
        name,
        "Park Site Characteristic n_history:i n_current:i status ok:b",
        f"""SELECT *, CASE WHEN n_history = 0 AND n_current = 0 THEN 'no_rows' WHEN n_current = 0 THEN 'no_current'
              WHEN n_history = 0 THEN 'no_history' ELSE 'ok' END AS status, {missing} > 0 AS ok
            FROM (SELECT p.Park, p.Site, p.Characteristic, coalesce(n_history, 0) AS n_history,
                    coalesce(n_current, 0) AS n_current
                  FROM points AS p LEFT JOIN (
                    SELECT Park, Site, Characteristic, count(*) FILTER (WHERE year < 2001) AS n_history,
                      count(*) FILTER (WHERE year = 2001) AS n_current
                    FROM sample WHERE year BETWEEN 1995 AND 2001 AND month_num BETWEEN 5 AND 10
                    GROUP BY Park, Site, Characteristic) AS c USING (Park, Site, Characteristic))""",
    )
    def build(v):
        season = get_wdata(v.meas, months=FIELD_SEASON)
        status = checks.series_status(list_site_chars(v.chars), season, year_historic=YEAR_FROM,
                                      year_current=CURRENT)
        return status.withColumn("ok", F.expr(missing) > 0)

    return build


_check("check_has_rows", "n_history + n_current")
_check("check_has_current", "n_current")
_check("check_has_history", "n_history")


@query(
    "stream_flag_exceedance",
    FLAGGED,
    f"SELECT *, {beyond('ValueCen', 'orange', 'black')} AS pcolor FROM meas LEFT JOIN points USING (Park, Site, Characteristic)",
)
def stream_flag_exceedance(v):
    """The whole sample table arrives as a stream and is flagged on the way to a table."""
    schema = v.table("lineitem").schema
    stream = exceedance.stream_parquet(v.spark, v.folder, schema, glob="lineitem.parquet")
    samples = v.samples_of(stream).drop("SiteType")
    out, marks = scratch_path(v.spark, "stream-out"), scratch_path(v.spark, "stream-marks")
    exceedance.write_stream(exceedance.flag_stream(samples, v.chars), out, marks).awaitTermination()
    return v.spark.read.parquet(out)
