"""Writers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def output_name(park: Column, prefix: str = "WQ_parameters_", suffix: str = ".html") -> Column:
    """Name of a park's report."""
    return F.concat(F.lit(prefix), park, F.lit(suffix))


def write_reports(datasets: Mapping[str, DataFrame], out: str, *, parks: Iterable[str] | None = None,
                  mode: str = "overwrite") -> dict[str, str]:
    """Write every dataset below ``out``, one folder per park, for all parks in one job each.

    The rebalance hint joins small files of a park and splits the files of a large one.
    """
    paths = {}
    for name, df in datasets.items():
        if parks is not None:
            df = df.where(F.col("Park").isin(*list(parks)))
        paths[name] = f"{out.rstrip('/')}/{name}"
        df.hint("rebalance", "Park").write.mode(mode).partitionBy("Park").parquet(paths[name])
    return paths


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV that ``sources.readers`` reads back unchanged: line breaks, quotes, outer blanks and empty texts included."""
    writer = df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("lineSep", "\n")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path)
    return path
