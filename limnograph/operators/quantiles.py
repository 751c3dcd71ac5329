"""Exact order statistics per group, safe when one group holds much of the data.

Rows are first reduced to one cell per (keys, value), so a group's rows are counted before the shuffle
and spread over its values. Cells are counted per block of neighbouring values; only the blocks that
hold a wanted rank are looked into. No group meets in one task, only its blocks' counts do: 600,000 of
them for every power of ten that its values span. A block's distinct values are sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_position(p: float, method: str, n: str = "_n") -> str:
    """SQL text of the fractional 1-based rank of quantile ``p`` among ``n`` values."""
    if method == "type7":
        return f"(({n} - 1) * {p}D + 1)"
    if method == "hazen":
        return f"least(greatest({n} * {p}D + 0.5D, 1D), {n})"
    raise ValueError(f"unknown quantile method {method!r}")


def _wanted_ranks(quantiles: Mapping[str, float], method: str) -> dict[str, str]:
    """SQL text of the two ranks each quantile lies between."""
    ranks = {}
    for name, p in quantiles.items():
        position = rank_position(p, method)
        ranks[f"_lo_{name}"], ranks[f"_hi_{name}"] = f"floor({position})", f"ceil({position})"
    return ranks


def value_cells(df: DataFrame, keys: Sequence[str], value: str, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (keys, value): its row count ``_w`` and the ``extra`` aggregates.

    The condition is always true. It keeps all columns in use, so that every reader of the cells
    has the same exchange below it and Spark runs that once.
    """
    cells = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_w"), *extra)
    made = [c for c in cells.columns if c not in (*keys, value)]
    return cells.where(F.xxhash64(*made) >= F.lit(-(2**63)))


def _block(value: str) -> str:
    """SQL text of a never falling function of the value: its block, 4 millionths of the value wide."""
    v = f"CAST({value} AS DOUBLE)"
    return f"rint(signum({v}) * log1p(abs({v}) * 1e6D) * 262144D) + 0D"


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float], *,
                    method: str = "type7", extra: Sequence[Column] = (), aggs: Sequence[Column] = ()) -> DataFrame:
    """One row per group: ``aggs`` over its cells and exact quantiles of its non-NULL values.

    ``extra`` are aggregates of the rows of one value, beside their count ``_w``.
    """
    # A number for each group comes first among its keys: sorting compares numbers, and strings only where these tie.
    own, keys = list(keys), ["_g", *keys]
    df = df.withColumn("_g", F.xxhash64(*own))
    cells = value_cells(df, keys, value, extra).selectExpr(
        "*", f"IF({value} IS NULL, 0, _w) AS _k", f"{_block(value)} AS _block")
    ranks = _wanted_ranks(quantiles, method)

    blocks = cells.groupBy(*keys, "_block").agg(F.sum("_k").alias("_block_n"))
    group = W.partitionBy(*keys)
    before = group.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("*", F.coalesce(F.sum("_block_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_block_n").over(group).alias("_n"))
    holds_rank = " OR ".join(f"({r} > _before AND {r} <= _before + _block_n)" for r in dict.fromkeys(ranks.values()))
    wanted = offsets.where(holds_rank).select(*keys, "_block", "_before", "_n")

    # A wanted block's offset goes ahead of its cells and starts their running count, so one sort serves in place
    # of a join. Cells of other blocks go along for the aggregates; their ``_last`` is NULL, so no rank falls on them.
    both = cells.withColumn("_cell", F.lit(True)).unionByName(wanted.withColumn("_cell", F.lit(False)), allowMissingColumns=True)
    within = W.partitionBy(*keys, "_block").orderBy("_cell", value).rowsBetween(W.unboundedPreceding, W.currentRow)
    of = F.max("_n").over(within)
    last = F.when(of.isNotNull(), F.sum(F.coalesce("_before", "_k")).over(within))
    ranked = both.select(*cells.columns, "_cell", last.alias("_last"), of.alias("_n")).where("_cell")
    picks = [
        F.expr(f"max(CASE WHEN {rank} <= _last AND {rank} > _last - _k THEN {value} END) AS {name}")
        for name, rank in ranks.items()
    ]
    grouped = ranked.groupBy(*keys).agg(*aggs, *picks, F.max("_n").alias("_n"))
    return _interpolated(grouped.drop("_g"), quantiles, method)


def _interpolated(grouped: DataFrame, quantiles: Mapping[str, float], method: str) -> DataFrame:
    """Replace the picked neighbours by the quantile between them."""
    kept = [c for c in grouped.columns if not c.startswith(("_lo_", "_hi_")) and c != "_n"]
    between = []
    for name, p in quantiles.items():
        position = rank_position(p, method)
        low, high = f"_lo_{name}", f"_hi_{name}"
        between.append(f"IF({low} = {high}, {low}, {low} + ({high} - {low}) * ({position} - floor({position}))) AS {name}")
    return grouped.selectExpr(*kept, *between)
