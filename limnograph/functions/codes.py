"""Positional site codes and park lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State of each park; every other park is 'other'.
PARK_STATE = {
    "MIMA": "MA",
    "SAIR": "MA",
    "ROVA": "NY",
    "SARA": "NY",
    "ACAD": "ME",
    "MABI": "VT",
    "MORR": "NJ",
    "SAGA": "NH",
    "WEFA": "CT",
}
# States with a standards table, and parameter categories.
STATES = ["CT", "MA", "ME", "NH", "NJ", "NY", "VT"]
CATEGORIES = ["physical", "nutrients"]


def park_from_site(site: Column) -> Column:
    """Characters 6-9 of a site code."""
    return F.substring(site, 6, 4)


def site_from_key(key: Column) -> Column:
    """The 14-character site code at the start of a composite key."""
    return F.substring(key, 1, 14)


def state_of_park(park: Column) -> Column:
    pairs = [F.lit(x) for kv in PARK_STATE.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[park], F.lit("other"))


def flag_columns(value: Column, choices: list[str]) -> dict[str, Column]:
    """One boolean column per choice."""
    return {c: F.coalesce(value == F.lit(c), F.lit(False)) for c in choices}
