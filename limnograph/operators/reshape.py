"""Long to wide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many columns at most are made from names found in the data.
MOST_NAMES = 2_000


def names_in(meas: DataFrame, names_from: str = "Characteristic") -> list[str]:
    """The names that occur, sorted; a pass over the name column alone."""
    found = meas.select(names_from).distinct().where(F.col(names_from).isNotNull()).limit(MOST_NAMES + 1).collect()
    if len(found) > MOST_NAMES:
        raise ValueError(f"over {MOST_NAMES} different names; declare those that become columns, the rest stays in 'undeclared'")
    return sorted(r[0] for r in found)


def pivot_characteristics(meas: DataFrame, names: Sequence[str] | None = None, *, names_from: str = "Characteristic",
                          values_from: str = "Value") -> DataFrame:
    """One column per characteristic; every other column and ``occurrence`` identify a row.

    ``names`` are the columns to make; without them all names in the data are, which are looked up first. Samples of any
    other name (or none) are in ``undeclared``, an array of (name, value) ordered by name, so no value is lost. Several
    values for one cell are numbered from 1 by size, missing ones first, so every sample keeps a cell of its own.
    Equal samples are counted before they are numbered; a sample that repeats without end is spread.
    """
    names = names_in(meas, names_from) if names is None else list(names)
    ids = [c for c in meas.columns if c not in (names_from, values_from)]
    parts = int(meas.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = meas.groupBy(*ids, names_from, values_from).agg(F.count("*").alias("_n"))
    # One shuffle by the identifying columns, as one number, serves the numbering and the wide rows.
    counted = counted.withColumn("_g", F.xxhash64(*ids) if ids else F.lit(0).cast("long")).repartition(parts, "_g")
    earlier = Window.partitionBy("_g", *ids, names_from).orderBy(values_from).rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    each = counted.withColumn("occurrence", F.explode(F.sequence(F.col("_before") + 1, F.col("_before") + F.col("_n"))))
    name, value = F.col(names_from), F.col(values_from)
    declared = name.isin(*names) if names else F.lit(False)
    rest = F.when(~F.coalesce(declared, F.lit(False)), F.struct(name.alias("name"), value.alias("value")))
    wide = each.groupBy("_g", *ids, "occurrence").agg(
        *[F.min(F.when(name == n, value)).alias(n) for n in names], F.array_sort(F.collect_list(rest)).alias("undeclared"))
    return wide.drop("_g")


def pivot_select(wide: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """One pivoted column without its missing cells."""
    return wide.select(*keep, name).where(F.col(name).isNotNull())
