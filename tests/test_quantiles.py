"""Order statistics: both methods, and groups too large for one task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnograph.operators.hot import HotGroups, hot_groups
from limnograph.operators.quantiles import group_quantiles

PROBS = {"lo": 0.025, "q1": 0.25, "med": 0.5, "q3": 0.75, "hi": 0.975, "first": 0.0, "last": 1.0}
NUMPY = {"type7": "linear", "hazen": "hazen"}


def expected(values, p, method):
    values = np.asarray(values, dtype=float)
    if method == "hazen":
        n = len(values)
        position = min(max(n * p + 0.5, 1), n)
        ordered = np.sort(values)
        low = int(np.floor(position))
        high = int(np.ceil(position))
        return ordered[low - 1] + (ordered[high - 1] - ordered[low - 1]) * (position - low)
    return np.quantile(values, p)


@pytest.fixture(scope="module")
def groups(spark):
    rng = np.random.default_rng(7)
    made = {
        "heavy": rng.normal(size=3000),
        "ties": rng.integers(0, 12, size=1500).astype(float),
        "tail": np.exp(rng.normal(scale=6, size=800)),
        "constant": np.full(500, 3.25),
        "small": rng.normal(size=7),
        "single": np.array([1.5]),
    }
    rows = [(k, float(v)) for k, values in made.items() for v in values]
    rows += [(k, None) for k in ("heavy", "small", "empty", "empty")]
    return made, spark.createDataFrame(rows, "g string, v double").repartition(7).cache()


@pytest.mark.parametrize("method", ["type7", "hazen"])
def test_quantiles_match_brute_force(groups, method):
    made, df = groups
    out = group_quantiles(df, ["g"], "v", PROBS, method=method,
                          aggs=[F.sum("_w").alias("n_all"), F.max("v").alias("top")])
    rows = {r["g"]: r for r in out.collect()}
    assert set(rows) == {*made, "empty"}
    for name, values in made.items():
        for label, p in PROBS.items():
            assert rows[name][label] == pytest.approx(expected(values, p, method), rel=1e-12, abs=1e-12)
        assert rows[name]["top"] == values.max()
    assert rows["heavy"]["n_all"] == 3001
    assert rows["empty"]["n_all"] == 2 and rows["empty"]["med"] is None


def test_one_hot_group_is_spread_and_counted_before_the_shuffle(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([rng.normal(1013, 2, 60_000), rng.integers(-3, 4, 30_000) / 2, [np.inf, -np.inf, -0.0]])
    df = spark.createDataFrame([("hot", float(v)) for v in values] + [("cold", 1.0)], "g string, v double")
    out = group_quantiles(df, ["g"], "v", PROBS)
    got = {r["g"]: r for r in out.collect()}
    for label, p in PROBS.items():
        if label in ("first", "last"):
            assert got["hot"][label] == (-np.inf if label == "first" else np.inf)
        else:
            assert got["hot"][label] == pytest.approx(np.quantile(values, p), rel=1e-12)
    assert got["cold"]["med"] == 1.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(1)" in plan


def test_quantiles_start_no_job_before_they_are_read(spark, groups):
    _, df = groups
    spark.sparkContext.setJobGroup("plan", "plan")
    out = group_quantiles(df, ["g"], "v", PROBS)
    jobs = list(spark.sparkContext.statusTracker().getJobIdsForGroup("plan"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs == [] and out.columns[0] == "g"


def test_hot_groups_are_found_only_beyond_the_limit(groups):
    _, df = groups
    found = hot_groups(df, ["g"], 1000)
    assert {r["g"] for r in found.keys.collect()} == {"heavy", "ties"}
    assert not hot_groups(df, ["g"], 100_000)
    assert not hot_groups(df, ["g"], None)
    assert hot_groups(df, ["g"], HotGroups()) == HotGroups()


def test_null_keys_stay_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    for probs in ({"m": 0.5}, {"m": 0.5, "top": 1.0}):
        rows = {r["g"]: r["m"] for r in group_quantiles(df, ["g"], "v", probs).collect()}
        assert rows == {None: 2.0, "a": 5.0}
