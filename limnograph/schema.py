"""Fixed schemas of the long measurement table and of its dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MEASUREMENTS = T.StructType(
    [
        T.StructField("Park", T.StringType()),
        T.StructField("Site", T.StringType()),
        T.StructField("Characteristic", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Date", T.DateType()),
        T.StructField("SampleDepth", T.StringType()),
        T.StructField("Value", T.DoubleType()),
        T.StructField("TextValue", T.StringType()),
        T.StructField("Censored", T.BooleanType()),
        T.StructField("ValueCen", T.DoubleType()),
    ]
)

PARKS = T.StructType(
    [
        T.StructField("ParkCode", T.StringType()),
        T.StructField("ParkShortName", T.StringType()),
        T.StructField("ParkLongName", T.StringType()),
    ]
)

SITES = T.StructType(
    [
        T.StructField("ParkCode", T.StringType()),
        T.StructField("ParkShortName", T.StringType()),
        T.StructField("ParkLongName", T.StringType()),
        T.StructField("Network", T.StringType()),
        T.StructField("SiteCode", T.StringType()),
        T.StructField("SiteName", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("type", T.StringType()),
    ]
)

CHARACTERISTICS = T.StructType(
    [
        T.StructField("ParkCode", T.StringType()),
        T.StructField("SiteCode", T.StringType()),
        T.StructField("CharName", T.StringType()),
        T.StructField("DisplayName", T.StringType()),
        T.StructField("CategoryDisplay", T.StringType()),
        T.StructField("Category", T.StringType()),
        T.StructField("Units", T.StringType()),
        T.StructField("LowerPoint", T.DoubleType()),
        T.StructField("UpperPoint", T.DoubleType()),
    ]
)

SITE_DESCRIPTIONS = T.StructType(
    [
        T.StructField("ParkCode", T.StringType()),
        T.StructField("SiteName", T.StringType()),
        T.StructField("SiteCode", T.StringType()),
        T.StructField("Description", T.StringType()),
    ]
)

BOUNDING_BOXES = T.StructType(
    [
        T.StructField("ParkCode", T.StringType()),
        T.StructField("LatS", T.DoubleType()),
        T.StructField("LongE", T.DoubleType()),
        T.StructField("LatN", T.DoubleType()),
        T.StructField("LongW", T.DoubleType()),
        T.StructField("Zoom", T.IntegerType()),
        T.StructField("minZoom", T.IntegerType()),
    ]
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early, with the missing names, when ``df`` lacks a column an operator needs."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; have {df.columns}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order and cast them to its types."""
    require_columns(df, *schema.fieldNames())
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])
