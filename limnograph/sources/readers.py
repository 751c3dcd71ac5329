"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnograph import schema as S

#: Column with the text of a record that does not fit its schema.
BROKEN = "_broken"


def _csv(spark: SparkSession, path: str, schema: T.StructType, one_line: bool, broken: bool) -> DataFrame:
    """CSV records that fit ``schema``, or the ``broken`` ones with their text in ``BROKEN``.

    Quoted fields may hold line breaks, so a file is read from its start by one task, record by record; large tables come
    in many files. ``one_line`` promises that no field holds one, and then large files are split. An empty cell is
    missing, a quoted empty one is an empty text.
    """
    fields = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    reader = spark.read.schema(fields).option("header", True).option("quote", '"').option("escape", '"')
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", False)
    rows = reader.option("multiLine", not one_line).option("lineSep", "\n").option("nullValue", "\0").csv(path)
    kept = [*schema.fieldNames(), BROKEN]
    if broken:
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
        kept = ["file", F.col(BROKEN).alias("record")]
    # The second condition is always true; it keeps all fields in use, without which a record is not parsed.
    parsed = F.xxhash64(*schema.fieldNames()) >= F.lit(-(2**63))
    return rows.where((F.col(BROKEN).isNotNull() if broken else F.col(BROKEN).isNull()) & parsed).select(*kept).drop(BROKEN)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, one_line: bool = False) -> DataFrame:
    if fmt == "csv":
        return _csv(spark, path, schema, one_line, broken=False)
    if fmt == "parquet":
        return S.conform(spark.read.parquet(path), schema)
    raise ValueError(f"unknown format {fmt!r}")


def broken_records(spark: SparkSession, path: str, schema: T.StructType = S.MEASUREMENTS, *, one_line: bool = False) -> DataFrame:
    """(file, record): the records of CSV files that the scans leave out because they do not fit ``schema``."""
    return _csv(spark, path, schema, one_line, broken=True)


def scan_measurements(spark: SparkSession, data: str, *, fmt: str = "csv", one_line: bool = False) -> DataFrame:
    """The long measurement table; CSV records that do not fit are left to ``broken_records``."""
    return _read(spark, data, S.MEASUREMENTS, fmt, one_line)


def scan_metadata(spark: SparkSession, path: str, *, fmt: str = "csv") -> tuple[DataFrame, ...]:
    """Parks, sites and characteristics from one flat metadata table (a row per characteristic)."""
    fields = {f.name: f for s in (S.SITES, S.CHARACTERISTICS) for f in s.fields}
    flat = _read(spark, path, T.StructType(list(fields.values())), fmt)
    parks = flat.select(*S.PARKS.fieldNames()).distinct()
    sites = flat.select(*S.SITES.fieldNames()).distinct()
    chars = flat.where(F.col("CharName").isNotNull()).select(*S.CHARACTERISTICS.fieldNames()).distinct()
    return parks, sites, chars


def scan_siteinfo(spark: SparkSession, path: str, *, fmt: str = "csv") -> DataFrame:
    """Site descriptions: quoted text with commas and markup."""
    return _read(spark, path, S.SITE_DESCRIPTIONS, fmt)


def scan_boundboxes(spark: SparkSession, path: str, *, fmt: str = "csv") -> DataFrame:
    """Park bounding boxes; empty cells are missing."""
    return _read(spark, path, S.BOUNDING_BOXES, fmt)
