"""Assessment points and exceedance classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.functions.nulls import if_else

POINTS = ["LowerPoint", "UpperPoint"]


def with_points(df: DataFrame, chars: DataFrame, *, assessment: str = "metadata",
                mode: str = "per_site") -> DataFrame:
    """Add ``LowerPoint`` and ``UpperPoint`` of each row's (park, site, characteristic).

    ``assessment='none'`` adds empty points. ``mode='first'`` gives every row the points of the
    park's first site that has the characteristic, as a scalar lookup would.
    """
    if assessment == "none":
        empty = F.lit(None).cast("double")
        return df.withColumns({p: empty for p in POINTS})
    if assessment != "metadata":
        raise ValueError(f"unknown assessment {assessment!r}")
    points = chars.select(
        F.col("ParkCode").alias("Park"), F.col("SiteCode").alias("Site"),
        F.col("CharName").alias("Characteristic"), *POINTS,
    )
    if mode == "per_site":
        return df.join(points, ["Park", "Site", "Characteristic"], "left")
    if mode != "first":
        raise ValueError(f"unknown mode {mode!r}")
    first = points.groupBy("Park", "Characteristic").agg(
        F.min(F.struct("Site", *POINTS)).alias("_first")
    )
    first = first.select("Park", "Characteristic", *[F.col("_first")[p].alias(p) for p in POINTS])
    return df.join(first, ["Park", "Characteristic"], "left")


def with_given_points(df: DataFrame, values: Sequence[float]) -> DataFrame:
    """One output row per given assessment value: ``AssessmentPoint``."""
    return df.withColumn("AssessmentPoint", F.explode(F.array(*[F.lit(float(v)) for v in values])))


def beyond_points(value: Column, poor: str, good: str, when: Column | None = None) -> Column:
    """``poor`` above the upper or below the lower point, else ``good``; unknown stays unknown."""
    when = F.lit(True) if when is None else when
    lower, upper = F.col("LowerPoint"), F.col("UpperPoint")
    above = upper.isNotNull() & when & (value > upper)
    below = lower.isNotNull() & when & (value < lower)
    return if_else(above, F.lit(poor), if_else(below, F.lit(poor), F.lit(good)))


def band_class(value: Column) -> Column:
    return beyond_points(value, "orange", "black")


def box_class(value: Column, year: Column, current: int) -> Column:
    """Only values of the current year can be poor."""
    return beyond_points(value, "Poor WQ value", "Current value", year == F.lit(current))


def outlier_text(value: Column) -> Column:
    """The strings TRUE and FALSE; unknown counts as FALSE."""
    return (
        F.when(value > F.col("UpperPoint"), "TRUE")
        .when(value < F.col("LowerPoint"), "TRUE")
        .otherwise("FALSE")
    )


def with_rule_points(df: DataFrame, rules: DataFrame, *, park: str = "Park") -> DataFrame:
    """Points from the rule table; a rule without a depth holds for every depth, and the first that fits counts.

    The rules are a fixed short table: those of a park and characteristic become one row in the order
    of ``rule``, so that a sample never meets two, and the rows are broadcast.
    """
    out = df
    for side in ("Lower", "Upper"):
        options = rules.where(F.col("side") == side).groupBy(F.col("park").alias("_park"), F.col("characteristic").alias("_char")) \
            .agg(F.array_sort(F.collect_list(F.struct("rule", "depth", "point"))).alias("_rules"))
        match = (out[park] == options["_park"]) & (out["Characteristic"] == options["_char"])
        out = out.join(F.broadcast(options), match, "left")
        fits = F.filter("_rules", lambda r: r["depth"].isNull() | F.coalesce(r["depth"] == F.col("SampleDepth"), F.lit(False)))
        out = out.withColumn(f"{side}Point", F.get(fits, 0)["point"]).drop("_park", "_char", "_rules")
    return out
