from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from limnograph.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def samples(spark):
    """Build a measurement table from (date, value) pairs or dicts."""
    from limnograph.schema import MEASUREMENTS

    def build(rows, **defaults):
        base = {"Park": "MABI", "Site": "XNET_MABI_SA00", "Characteristic": "pH", "Category": "physical",
                "SampleDepth": "stream", "Value": None, "TextValue": None, "Censored": False, **defaults}
        out = []
        for row in rows:
            row = row if isinstance(row, dict) else {"Date": row[0], "ValueCen": row[1]}
            row = {**base, **row}
            if isinstance(row["Date"], str):
                row["Date"] = dt.date.fromisoformat(row["Date"])
            out.append(tuple(row[f] for f in MEASUREMENTS.fieldNames()))
        return spark.createDataFrame(out, MEASUREMENTS)

    return build
