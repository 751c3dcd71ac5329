"""Sources, sinks and getters."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnograph.operators import catalog
from limnograph.queries.base import query
from limnograph.queries.sql import PARK_CODE, STANDARDS, STATE, STORE_CODES
from limnograph.functions.codes import state_of_park
from limnograph.schema import MEASUREMENTS, conform
from limnograph.session import scratch_path
from limnograph.sources import readers, sinks, tables
from limnograph.sources.monitoring_view import park_code

MEAS_COLUMNS = ("Park Site Characteristic Category Date:t SampleDepth Value:d TextValue Censored:b "
                "ValueCen:d")


@query("scan_measurements", MEAS_COLUMNS, "SELECT * FROM meas")
def scan_measurements(v):
    path = sinks.write_csv(conform(v.meas, MEASUREMENTS), scratch_path(v.spark, "measurements"))
    return readers.scan_measurements(v.spark, path)


@query(
    "scan_metadata",
    "ParkCode ParkLongName SiteCode SiteName lat:d long:d type CharName DisplayName Category Units "
    "LowerPoint:d UpperPoint:d",
    """SELECT ParkCode, ParkLongName, SiteCode, SiteName, lat, long, type, CharName, DisplayName,
         Category, Units, LowerPoint, UpperPoint
       FROM sites JOIN chars USING (ParkCode, SiteCode) JOIN parks USING (ParkCode, ParkLongName)""",
)
def scan_metadata(v):
    flat = v.sites.join(v.chars, ["ParkCode", "SiteCode"], "left")
    fields = [*v.sites.columns, *[c for c in v.chars.columns if c not in v.sites.columns]]
    path = sinks.write_csv(flat.select(*fields), scratch_path(v.spark, "metadata"))
    parks, sites, chars = readers.scan_metadata(v.spark, path)
    joined = sites.join(chars, ["ParkCode", "SiteCode"])
    return joined.join(parks, ["ParkCode", "ParkShortName", "ParkLongName"], "left_semi")


@query("scan_siteinfo", "ParkCode SiteName SiteCode Description", "SELECT * FROM descriptions")
def scan_siteinfo(v):
    path = sinks.write_csv(v.descriptions, scratch_path(v.spark, "descriptions"))
    return readers.scan_siteinfo(v.spark, path)


@query("scan_boundboxes", "ParkCode LatS:d LongE:d LatN:d LongW:d Zoom:i minZoom:i", "SELECT * FROM boxes")
def scan_boundboxes(v):
    path = sinks.write_csv(v.boxes, scratch_path(v.spark, "boxes"))
    return readers.scan_boundboxes(v.spark, path)


@query(
    "values_table",
    "state water_type class max_temp_f min_do ph_range max_tn max_tp max_chla min_secchi turbidity n_sites:i",
    f"""SELECT t.*, coalesce(n_sites, 0) AS n_sites FROM (SELECT * FROM {STANDARDS}) AS t
        LEFT JOIN (SELECT {STATE} AS state, SiteType AS water_type, count(*) AS n_sites
                   FROM (SELECT r_name AS Park, SiteType FROM located) GROUP BY ALL) AS s
          USING (state, water_type)""",
)
def values_table(v):
    sites = v.sites.groupBy(
        state_of_park(park_code(F.col("ParkCode"))).alias("state"), F.col("type").alias("water_type")
    ).agg(F.count(F.lit(1)).alias("n_sites"))
    return tables.state_standards(v.spark).join(sites, ["state", "water_type"], "left").fillna(0, ["n_sites"])


@query(
    "values_table_lookup",
    "Park SiteCode code",
    f"""SELECT r_name AS Park, s_name AS SiteCode, code FROM (SELECT *, r_name AS Park FROM located)
        JOIN (SELECT * FROM {STORE_CODES}) AS c ON c.park = {PARK_CODE.replace('Park', 'r_name')}""",
)
def values_table_lookup(v):
    codes = F.broadcast(tables.store_codes(v.spark))
    sites = v.sites.select(F.col("ParkCode").alias("Park"), "SiteCode",
                           park_code(F.col("ParkCode")).alias("park_key"))
    return sites.join(codes.withColumnRenamed("park", "park_key"), "park_key")


@query(
    "sink_per_park",
    "Park Category n_rows:i total:d",
    "SELECT Park, Category, count(*) AS n_rows, sum(ValueCen) AS total FROM meas GROUP BY Park, Category",
)
def sink_per_park(v):
    out = scratch_path(v.spark, "reports")
    paths = sinks.write_reports({"measurements": v.meas}, out)
    written = v.spark.read.parquet(paths["measurements"])
    return written.groupBy("Park", "Category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("ValueCen").alias("total")
    )


@query("get_park_info", "ParkLongName", "SELECT ParkLongName FROM parks")
def get_park_info(v):
    return catalog.get_park_info(v.parks, "ParkLongName")


@query("get_site_info", "SiteCode type", "SELECT SiteCode, type FROM sites WHERE ParkCode IN ('ASIA', 'EUROPE')")
def get_site_info(v):
    return catalog.get_site_info(v.sites, ["SiteCode", "type"], park=["ASIA", "EUROPE"])


@query(
    "get_char_info",
    "CharName Units LowerPoint:d UpperPoint:d",
    "SELECT DISTINCT CharName, Units, LowerPoint, UpperPoint FROM chars WHERE Category = 'nutrients'",
)
def get_char_info(v):
    info = ["CharName", "Units", "LowerPoint", "UpperPoint"]
    return catalog.get_char_info(v.chars, info, category="nutrients")


@query(
    "get_wdata",
    MEAS_COLUMNS,
    """SELECT * FROM sample WHERE Park IN ('AFRICA', 'ASIA') AND Category = 'physical'
       AND Characteristic IN ('pH', 'DO_mgL') AND year BETWEEN 1996 AND 2001 AND month_num BETWEEN 5 AND 10""",
)
def get_wdata(v):
    return catalog.get_wdata(v.meas, park=["AFRICA", "ASIA"], category="physical", char=["pH", "DO_mgL"],
                             years=(1996, 2001), months=range(5, 11))


@query(
    "get_nested",
    "Park Site n_chars:i n_samples:i leaves",
    """SELECT Park, Site, count(*) AS n_chars, sum(n) AS n_samples,
         string_agg(Characteristic || ':' || n || ':' || f || ':' || l, ';' ORDER BY Characteristic) AS leaves
       FROM (SELECT Park, Site, Characteristic, count(*) AS n, min(Date) AS f, max(Date) AS l
             FROM meas GROUP BY ALL) GROUP BY Park, Site""",
)
def get_nested(v):
    nested = catalog.nested_catalog(v.meas)
    leaf = F.transform(
        "characteristics",
        lambda c: F.concat_ws(":", c["Characteristic"], c["n_samples"].cast("string"),
                              c["first_date"].cast("string"), c["last_date"].cast("string")),
    )
    return nested.select("Park", "Site", F.size("characteristics").alias("n_chars"), "n_samples",
                         F.array_join(leaf, ";").alias("leaves"))


@query(
    "get_nested_parks",
    "Park n_sites:i n_samples:i sites",
    """SELECT Park, count(*) AS n_sites, sum(n) AS n_samples, string_agg(Site || ':' || k || ':' || n, ';' ORDER BY Site) AS sites
       FROM (SELECT Park, Site, count(*) AS n, count(DISTINCT Characteristic) AS k FROM meas GROUP BY Park, Site) GROUP BY Park""",
)
def get_nested_parks(v):
    site = F.transform("sites", lambda s: F.concat_ws(
        ":", s["Site"], F.size(s["characteristics"]).cast("string"), s["n_samples"].cast("string")))
    return catalog.nested_parks(v.meas).select("Park", F.size("sites").alias("n_sites"), "n_samples", F.array_join(site, ";").alias("sites"))


@query(
    "get_nested_pages",
    "Park Site Characteristic page:i part:i n_samples:i n_elements:i first_date:t last_date:t total:d",
    """WITH s AS (SELECT Park, Site, Characteristic, Date, SampleDepth, Value, TextValue, Censored, ValueCen, count(*) AS copies
                  FROM meas GROUP BY ALL),
       d AS (SELECT Park, Site, Characteristic, Date, count(*) AS n FROM s GROUP BY ALL),
       p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY Park, Site, Characteristic ORDER BY Date
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20 AS page FROM d)
       SELECT Park, Site, Characteristic, page, 0 AS part, sum(copies) AS n_samples, count(*) AS n_elements,
         min(Date) AS first_date, max(Date) AS last_date, sum(ValueCen * copies) AS total
       FROM s JOIN p USING (Park, Site, Characteristic, Date) GROUP BY Park, Site, Characteristic, page""",
)
def get_nested_pages(v):
    total = F.aggregate("samples", F.lit(0.0), lambda a, s: a + F.coalesce(s["ValueCen"] * s["copies"], F.lit(0.0)))
    some = F.exists("samples", lambda s: s["ValueCen"].isNotNull())
    return catalog.nested_pages(v.meas.drop("Category", "SiteType"), page_rows=20) \
        .withColumn("n_elements", F.size("samples")).withColumn("total", F.when(some, total))


@query(
    "list_site_chars",
    "Park Site Characteristic",
    "SELECT ParkCode AS Park, SiteCode AS Site, CharName AS Characteristic FROM chars WHERE Category = 'physical'",
)
def list_site_chars(v):
    return catalog.list_site_chars(v.chars, category="physical")
