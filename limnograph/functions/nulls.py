"""Three-valued conditionals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_else(condition: Column, yes: Column | str, no: Column | str) -> Column:
    """Vectorised if/else where an unknown condition gives an unknown result.

    SQL's CASE sends a NULL condition to ELSE; here it stays NULL.
    """
    yes = F.lit(yes) if isinstance(yes, str) else yes
    no = F.lit(no) if isinstance(no, str) else no
    return F.when(condition, yes).when(~condition, no)


def strict_agg(aggregate: Column, value: Column) -> Column:
    """An aggregate that is NULL as soon as one value of the group is NULL."""
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)
