"""Series too large for one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnograph.operators.joins import join_on
from limnograph.session import checkpointed

BROADCAST_GROUPS = 20_000


@dataclass(frozen=True)
class HotGroups:
    """Keys of the groups that are too large for one task; None when there are none.

    ``few`` says that their number was checked to be small enough for broadcasts.
    """

    keys: DataFrame | None = None
    few: bool = False

    def __bool__(self) -> bool:
        return self.keys is not None

    def calm(self, df: DataFrame, on: Sequence[str]) -> DataFrame:
        return df if self.keys is None else join_on(df, self.keys, on, "left_anti")

    def rows(self, df: DataFrame, on: Sequence[str]) -> DataFrame:
        return join_on(df, self.keys, on, "left_semi")


HotRule = int | None | HotGroups


def hot_groups(df: DataFrame, keys: Sequence[str], rule: HotRule) -> HotGroups:
    """Find the groups beyond ``rule`` rows; ``None`` trusts that there are none.

    Reads the key columns only. The row count comes first, because a table of at most that many
    rows cannot hold such a group. The keys are written to the checkpoint folder, and broadcast
    in later joins only while they are few.
    """
    if isinstance(rule, HotGroups):
        return rule
    if rule is None or df.count() <= rule:
        return HotGroups()
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rule)
    big = big.select(*keys)
    if big.isEmpty():
        return HotGroups()
    big = checkpointed(big)
    few = big.count() <= BROADCAST_GROUPS
    return HotGroups(F.broadcast(big) if few else big, few)
