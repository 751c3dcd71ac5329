"""Report parameters."""

from __future__ import annotations

from dataclasses import dataclass

from limnograph.functions.calendar import FIELD_SEASON


@dataclass(frozen=True)
class ReportParams:
    """History ``year_from``..``year_to``, compared with ``current``."""

    year_from: int = 2006
    year_to: int = 2018
    current: int = 2019
    category: str = "physical"
    nutrient: bool = True
    months: tuple[int, ...] = FIELD_SEASON
