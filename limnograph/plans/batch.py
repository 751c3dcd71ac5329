"""All report datasets of all parks in one go.

The samples are staged once, clustered by series and date, and every dataset reads that table. A batch is written below
a name of its own; a manifest, written last, makes it the current one, so readers see a whole batch or the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnograph.functions.codes import state_of_park
from limnograph.operators.catalog import get_wdata
from limnograph.operators.filters import NOT_COMPARED
from limnograph.plans.boxplot import boxplot
from limnograph.plans.params import ReportParams
from limnograph.plans.report_index import report_index
from limnograph.plans.site_comparison import site_comparison
from limnograph.plans.site_map import site_map
from limnograph.plans.waterbands import waterbands
from limnograph.session import written
from limnograph.sources import tables
from limnograph.sources.sinks import output_name, write_reports

# The parks reported together.
BATCH_PARKS = ["MABI", "MIMA", "MORR", "ROVA", "SAGA", "SARA", "WEFA"]


_MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("run", "dataset", "path")]
                         + [T.StructField("finished", T.TimestampType())])


def staged(meas: DataFrame, params: ReportParams, parks: Iterable[str] | None = None) -> tuple[DataFrame, str]:
    """The samples that reports of ``parks`` (default: all) need, written once, each series in the order of its dates; and where.

    Series are spread by hash: ranges would be cut by a sample, for which all rows would be made once more.
    """
    rows = get_wdata(meas, park=None if parks is None else list(parks), years=(None, params.current))
    order = ["Park", "Site", "Characteristic", "Date"]
    return written(rows.repartition(*order[:3]).sortWithinPartitions(*order), "staged-samples")


def standards(sites: DataFrame, park_code=None) -> DataFrame:
    """The state standards and ecoregion values that hold for each site; both tables are fixed and short."""
    code: Column = F.col("ParkCode") if park_code is None else park_code(F.col("ParkCode"))
    rows = sites.select(F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"), F.col("type").alias("water_type"),
                        state_of_park(code).alias("state"))
    spark = sites.sparkSession
    state = rows.join(F.broadcast(tables.state_standards(spark)), ["state", "water_type"]).withColumn("source", F.lit("state"))
    region = rows.join(F.broadcast(tables.ecoregion_thresholds(spark)), "water_type").withColumn("source", F.lit("ecoregion"))
    return state.unionByName(region, allowMissingColumns=True)


def report_datasets(meas: DataFrame, sites: DataFrame, chars: DataFrame, params: ReportParams, *,
                    descriptions: DataFrame | None = None, boxes: DataFrame | None = None, park_code=None) -> dict[str, DataFrame]:
    """The plot-ready tables of a report; sites are compared together and by water type.

    The map is part of it where ``descriptions`` and ``boxes`` are given. ``park_code`` maps a park to the code that the
    tables of standards use.
    """
    out = {
        "waterbands": waterbands(
            meas.where(F.col("Category") == params.category), chars, months=params.months,
            year_historic=params.year_from, year_current=params.current,
        ),
        "site_comparison": site_comparison(meas, sites, chars, year=params.current, months=params.months),
        **{
            f"site_comparison_{kind.lower()}": site_comparison(
                meas, sites, chars, year=params.current, months=params.months, site_type=kind, exclude=NOT_COMPARED)
            for kind in ("Lake", "Stream")
        },
        "report_index": report_index(meas, sites, chars, params),
        "standards": standards(sites, park_code),
    }
    if params.nutrient:
        out["boxplot"] = boxplot(
            meas, sites, chars, year_from=params.year_from, year_to=params.year_to,
            current_year=params.current,
        )
    if descriptions is not None and boxes is not None:
        places = site_map(meas, sites, descriptions, boxes, category=params.category)
        out["site_map"] = places.withColumn("Park", F.col("ParkCode"))
    return out


def write_batch(datasets: dict[str, DataFrame], out: str, parks: Iterable[str] | None = None) -> dict[str, str]:
    """Write all datasets below a name of their own in ``out`` and publish them together; returns their paths."""
    spark = next(iter(datasets.values())).sparkSession
    out, run = out.rstrip("/"), uuid.uuid4().hex
    paths = write_reports(datasets, f"{out}/run={run}", parks=parks)
    rows = spark.createDataFrame([(run, name, path) for name, path in paths.items()], "run string, dataset string, path string")
    rows.coalesce(1).withColumn("finished", F.current_timestamp()).select(*_MANIFEST.fieldNames()) \
        .write.mode("append").parquet(f"{out}/manifest")
    return paths


def current_batch(spark: SparkSession, out: str) -> dict[str, str]:
    """The paths of the batch that was published last; batches that stopped half way have no manifest."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{out.rstrip('/')}/manifest")
    last = rows.agg(F.max(F.struct("finished", "run")).alias("last")).select("last.run")
    return {r.dataset: r.path for r in rows.join(F.broadcast(last), "run").collect()}  # a row per dataset


def written_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows per dataset and park, read back from the written tables."""
    counts = None
    for name, path in sorted(paths.items()):
        one = spark.read.parquet(path).groupBy("Park").agg(F.count(F.lit(1)).alias("n_rows"))
        one = one.select("Park", output_name(F.col("Park")).alias("report"),
                         F.lit(name).alias("dataset"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts
