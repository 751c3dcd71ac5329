"""Joins on shared columns, written so that a hot key can be split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the keys come from the left."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(other[f"_r_{k}"])
    joined = left.join(other, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"_r_{k}" for k in keys])


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Keep every left row. ``on`` is a list of names, or left name -> right name."""
    if not isinstance(on, Mapping):
        return left.join(right, list(on), "left")
    renamed = right.withColumnsRenamed({r: l for l, r in on.items()})
    return left.join(renamed, list(on), "left")


def full_join(left: DataFrame, right: DataFrame, on: Sequence[str] | None = None, *,
              hot: bool = False) -> DataFrame:
    """Full outer join on the shared columns; NULL keys match each other.

    ``hot`` says that a key may repeat on the left without bound. Adaptive execution cannot split
    such a key in a full outer join, so the left join, where it can, and the right rows without a
    partner are put together instead.
    """
    on = list(on) if on is not None else shared_columns(left, right)
    if not hot:
        other = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
        condition = F.lit(True)
        for k in on:
            condition = condition & left[k].eqNullSafe(other[f"_r_{k}"])
        joined = left.join(other, condition, "full_outer")
        # Only a missing side leaves a key NULL where the other side has one.
        keys = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in on]
        rest = [c for c in (*left.columns, *right.columns) if c not in on]
        return joined.select(*keys, *rest)
    right = right.hint("rebalance")  # ends in an exchange, so that it is worked out once for both reads
    matched = join_on(left, right, on, "left")
    lonely = join_on(right, left.select(*on).distinct(), on, "left_anti")
    rest = [c for c in matched.columns if c not in on]
    return matched.unionByName(lonely, allowMissingColumns=True).select(*on, *rest)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Left rows that have a partner, order of columns and duplicates kept."""
    on = on if isinstance(on, Mapping) else {c: c for c in on}
    keys = right.select(*[F.col(r).alias(l) for l, r in on.items()]).distinct()
    return left.join(keys, list(on), "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")
