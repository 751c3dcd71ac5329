"""The monitoring model on top of an orders/suppliers star schema.

A line item is a sample, its supplier the site, its line number the characteristic, its ship date
the sample date and its region the park.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed values of the mapping: characteristic, display name, unit, lower and upper point per line
# number.
CHARACTERISTICS = [
    (1, "pH", "pH", "pH units", 10.0, 45.0),
    (2, "DO_mgL", "Dissolved oxygen", "mg/L", 7.0, None),
    (3, "Temp_C", "Temperature", "C", None, 40.0),
    (4, "TN_mgL", "Total nitrogen", "mg/L", None, 30.0),
    (5, "TP_ugL", "Total phosphorus", "ug/L", None, 35.0),
    (6, "ChlA_ugL", "Chlorophyll a", "ug/L", None, None),
    (7, "ANC_ueqL", "Acid neutralizing capacity", "ueq/L", None, None),
]
PHYSICAL_LINES = 3
# Park code used in rule and state lookups.
PARK_CODES = {"AFRICA": "ACAD", "AMERICA": "MABI", "ASIA": "MIMA", "EUROPE": "SAGA", "MIDDLE EAST": "WEFA"}

YEAR_FROM, YEAR_TO, CURRENT = 1995, 2000, 2001


def park_code(park: Column) -> Column:
    pairs = [F.lit(x) for kv in PARK_CODES.items() for x in kv]
    return F.create_map(*pairs)[park]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else f"{value}D"


def _by_name(field: int, kind: str) -> str:
    """SQL text of an attribute of the characteristic in ``CharName``."""
    whens = " ".join(f"WHEN '{row[1]}' THEN {_literal(row[field])}" for row in CHARACTERISTICS)
    return f"CAST(CASE CharName {whens} END AS {kind})"


_CHAR_OF_LINE = "CASE l_linenumber {} ELSE '{}' END".format(
    " ".join(f"WHEN {row[0]} THEN '{row[1]}'" for row in CHARACTERISTICS[:-1]), CHARACTERISTICS[-1][1]
)
_CATEGORY_OF_LINE = f"IF(l_linenumber <= {PHYSICAL_LINES}, 'physical', 'nutrients')"


@lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    """The schema of a table; reading its footer is a job of its own, so a session does it once per path."""
    return spark.read.parquet(path).schema


@dataclass(frozen=True)
class MonitoringView:
    """Measurements and dimensions of one data folder."""

    spark: SparkSession
    folder: str

    @cached_property
    def _tables(self) -> dict[str, DataFrame]:
        return {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = f"{self.folder}/{name}.parquet"
            self._tables[name] = self.spark.read.schema(_schema(self.spark, path)).parquet(path)
        return self._tables[name]

    def _with_place(self, suppliers: DataFrame) -> DataFrame:
        """Nation and region of rows that have a supplier.

        One table after the other, so that each is broadcast or shuffled by its own size; the
        size of a join of the three would be overestimated.
        """
        return (
            suppliers.join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .selectExpr("*", "IF(s_suppkey % 2 = 0, 'Lake', 'Stream') AS SiteType")
        )

    @cached_property
    def _located(self) -> DataFrame:
        return self._with_place(self.table("supplier"))

    @cached_property
    def parks(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_name").alias("ParkCode"), F.col("r_name").alias("ParkShortName"),
            F.concat(F.col("r_name"), F.lit(" PARK")).alias("ParkLongName"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        return self._located.selectExpr(
            "r_name AS ParkCode", "r_name AS ParkShortName", "concat(r_name, ' PARK') AS ParkLongName",
            "'network' AS Network", "s_name AS SiteCode", "concat(n_name, ' site ', s_suppkey) AS SiteName",
            "40D + n_nationkey / 8 AS lat", "-70D - s_suppkey % 64 / 16 AS long", "SiteType AS type",
        )

    @cached_property
    def meas(self) -> DataFrame:
        return self.samples_of(self.table("lineitem"))

    def samples_of(self, lines: DataFrame) -> DataFrame:
        """Line items, batch or stream, as measurements."""
        placed = self._with_place(lines.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")))
        return placed.selectExpr(
            "r_name AS Park", "s_name AS Site", "SiteType", f"{_CHAR_OF_LINE} AS Characteristic",
            f"{_CATEGORY_OF_LINE} AS Category", "CAST(l_shipdate AS DATE) AS Date",
            "IF(SiteType = 'Lake', 'epilimnion', 'stream') AS SampleDepth", "l_quantity AS Value",
            "CAST(CAST(l_quantity AS BIGINT) AS STRING) AS TextValue", "l_discount < 0.01 AS Censored",
            "IF(l_orderkey % 13 = 0, NULL, l_quantity) AS ValueCen",
        )

    @cached_property
    def chars(self) -> DataFrame:
        """Characteristics that occur at a site; all attributes follow from the name."""
        pairs = self.table("lineitem").selectExpr(
            "l_suppkey", f"{_CHAR_OF_LINE} AS CharName", f"{_CATEGORY_OF_LINE} AS Category"
        ).distinct()
        placed = self._with_place(pairs.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")))
        return placed.selectExpr(
            "r_name AS ParkCode", "s_name AS SiteCode", "CharName", f"{_by_name(2, 'string')} AS DisplayName",
            f"{_by_name(2, 'string')} AS CategoryDisplay", "Category", f"{_by_name(3, 'string')} AS Units",
            f"{_by_name(4, 'double')} AS LowerPoint", f"{_by_name(5, 'double')} AS UpperPoint",
        )

    @cached_property
    def descriptions(self) -> DataFrame:
        """Descriptions with commas, quotes and markup; some codes are described twice."""
        sites = self._located.select(
            F.col("r_name").alias("ParkCode"),
            F.concat(F.col("n_name"), F.lit(" site "), F.col("s_suppkey")).alias("SiteName"),
            F.col("s_name").alias("SiteCode"), "s_suppkey", "s_acctbal", "n_name",
        )
        text = F.concat(F.lit('Outlet, "near" '), F.col("n_name"), F.lit(", area "),
                        F.floor("s_acctbal").cast("string"), F.lit(" km<sup>2</sup>"))
        own = sites.select("ParkCode", "SiteName", "SiteCode", text.alias("Description"))
        renamed = sites.where(F.col("s_suppkey") % 10 == 0).select(
            "ParkCode", F.concat(F.col("SiteName"), F.lit(" (old)")).alias("SiteName"), "SiteCode",
            F.lit("Discontinued, replaced").alias("Description"),
        )
        return own.unionByName(renamed)

    @cached_property
    def boxes(self) -> DataFrame:
        """A box around the sites of every park; the first park has no zoom."""
        view = self.sites.groupBy("ParkCode").agg(
            F.max("lat").alias("LatS"), F.max("long").alias("LongE"), F.min("lat").alias("LatN"),
            F.min("long").alias("LongW"),
        )
        zoom = F.when(F.col("ParkCode") != "AFRICA", 10 + F.length("ParkCode"))
        return view.withColumns(
            {"Zoom": zoom.cast("int"), "minZoom": F.when(zoom.isNotNull(), 10).cast("int")}
        )
