from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from limnograph.operators import aggregates, filters, thresholds
from limnograph.operators.box import box_fences, box_outliers, box_stats
from limnograph.operators.joins import full_join, join_on, left_join
from limnograph.plans.boxplot import boxplot
from limnograph.sources import tables


@pytest.fixture(scope="module")
def classed(spark):
    rows = [("null, threshold", None, None, 8.5), ("null, none", None, None, None), ("high", 9.0, None, 8.5),
            ("low", 1.0, 6.5, 8.5), ("inside", 7.0, 6.5, 8.5), ("only lower", 7.0, 6.5, None),
            ("null, lower", None, 6.5, None)]
    df = spark.createDataFrame(rows, "name string, ValueCen double, LowerPoint double, UpperPoint double")
    return df.withColumns({"band": thresholds.band_class(F.col("ValueCen")),
                           "text": thresholds.outlier_text(F.col("ValueCen"))})


def test_three_valued_class(classed):
    got = {r["name"]: r["band"] for r in classed.collect()}
    assert got == {"null, threshold": None, "null, none": "black", "high": "orange", "low": "orange",
                   "inside": "black", "only lower": "black", "null, lower": None}


def test_outlier_text_of_missing_is_false(classed):
    got = {r["name"]: r["text"] for r in classed.collect()}
    assert got["null, threshold"] == "FALSE" and got["high"] == "TRUE" and got["inside"] == "FALSE"


def test_only_the_current_year_is_poor(spark):
    df = spark.createDataFrame([(9.0, 2018), (9.0, 2019)], "ValueCen double, year int")
    df = df.withColumns({"LowerPoint": F.lit(None).cast("double"), "UpperPoint": F.lit(8.5)})
    df = df.withColumn("c", thresholds.box_class(F.col("ValueCen"), F.col("year"), 2019))
    assert {r.year: r.c for r in df.collect()} == {2018: "Current value", 2019: "Poor WQ value"}


def test_rule_table(spark):
    rules = tables.rule_thresholds(spark)
    assert rules.where("side = 'Lower'").count() == 18 and rules.where("side = 'Upper'").count() == 27
    rows = [("MABI", "stream", "DO_mgL"), ("MABI", "epilimnion", "DO_mgL"), ("WEFA", None, "pH"), ("ACAD", "stream", "pH")]
    df = thresholds.with_rule_points(spark.createDataFrame(rows, "Park string, SampleDepth string, Characteristic string"), rules)
    got = {(r.Park, r.SampleDepth): (r.LowerPoint, r.UpperPoint) for r in df.collect()}
    assert got == {("MABI", "stream"): (7.0, None), ("MABI", "epilimnion"): (None, None), ("WEFA", None): (6.5, 8.0),
                   ("ACAD", "stream"): (None, None)}


def test_the_first_fitting_rule_counts(spark):
    rules = spark.createDataFrame([("Lower", "P", "stream", "pH", 6.0, 1), ("Lower", "P", None, "pH", 5.0, 2), ("Upper", "P", None, "pH", 8.0, 3),
                                   ("Upper", "P", "stream", "pH", 9.0, 4)],
                                  "side string, park string, depth string, characteristic string, point double, rule int")
    df = spark.createDataFrame([("P", "stream", "pH"), ("P", None, "pH"), ("P", "lake", "pH")], "Park string, SampleDepth string, Characteristic string")
    got = {r.SampleDepth: (r.LowerPoint, r.UpperPoint) for r in thresholds.with_rule_points(df, rules).collect()}
    assert got == {"stream": (6.0, 8.0), None: (5.0, 8.0), "lake": (5.0, 8.0)}


@pytest.mark.parametrize("hot", [False, True])
def test_full_join_matches_missing_keys(spark, hot):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, l int")
    right = spark.createDataFrame([(None, 3), ("b", 4)], "k string, r int")
    got = {tuple(r) for r in full_join(left, right, hot=hot).select("k", "l", "r").collect()}
    assert got == {(None, 1, 3), ("a", 2, None), ("b", None, 4)}


def test_rules_never_match_twice(spark):
    rules = tables.rule_thresholds(spark).alias("a")
    other = tables.rule_thresholds(spark).alias("b")
    same = (F.col("a.side") == F.col("b.side")) & (F.col("a.park") == F.col("b.park")) & (
        F.col("a.characteristic") == F.col("b.characteristic"))
    mixed = F.col("a.depth").isNull() & F.col("b.depth").isNotNull()
    assert rules.join(other, same & mixed).count() == 0


@pytest.fixture(scope="module")
def box_rows(spark):
    return spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0, 100.0)] + [("a", None)], "g string, ValueCen double")


@pytest.mark.parametrize("method, q1, q3", [("type7", 2.0, 4.0), ("hazen", 1.75, 28.0)])
def test_box(box_rows, method, q1, q3):
    row = box_stats(box_rows, ["g"], method=method).collect()[0]
    assert (row.n, row.q1, row.median, row.q3) == (5, q1, 3.0, q3)
    assert (row.lower_whisker, row.upper_whisker, row.n_outliers) == (1.0, 4.0, 1)
    fences = box_fences(box_rows, ["g"], method=method)
    assert [r.ValueCen for r in box_outliers(box_rows, fences, ["g"]).collect()] == [100.0]


def test_target_months_by_type(spark):
    df = spark.createDataFrame([(t, m) for t in ("Lake", "Stream", None) for m in (5, 6, 8)], "t string, m int")
    kept = {(r.t, r.m) for r in df.where(filters.target_month(F.col("t"), F.col("m"))).collect()}
    assert kept == {("Lake", 6), ("Lake", 8), ("Stream", 5), ("Stream", 8), (None, 5), (None, 8)}


def test_box_history_includes_current_year_when_asked(spark, samples):
    from limnograph.schema import CHARACTERISTICS, SITES

    rows = [(f"{y}-06-10", float(y)) for y in range(2015, 2020)]
    meas = samples(rows, Characteristic="TP_ugL", Category="nutrients")
    sites = spark.createDataFrame([("MABI", "M", "Marsh", "N", "XNET_MABI_SA00", "Pond", 1.0, 2.0, "Lake")], SITES)
    chars = spark.createDataFrame(
        [("MABI", "XNET_MABI_SA00", "TP_ugL", "TP", "TP", "nutrients", "ug/L", None, 2016.5)], CHARACTERISTICS)

    def layer(name, to):
        out = boxplot(meas, sites, chars, year_from=2015, year_to=to, current_year=2019)
        return [r for r in out.collect() if r.layer == name]

    assert layer("box", 2018)[0].n == 4 and layer("box", 2019)[0].n == 5
    line = layer("threshold", 2018)[0]
    assert (line.UpperPoint, line.line_start, line.line_end) == (2016.5, 5.0, 7.0)
    assert layer("current", 2018)[0].pcolor == "Poor WQ value"


def test_bbox_center_ignores_order(spark):
    from limnograph.schema import BOUNDING_BOXES

    boxes = spark.createDataFrame([("SAGA", 43.503, -72.364, 43.49, -72.381, 14, 10), ("SAIR", 1.0, 2.0, 3.0, 4.0, None, None)],
                                  BOUNDING_BOXES)
    got = {r.ParkCode: r for r in aggregates.bbox_center(boxes).collect()}
    assert got["SAGA"].lat_cent == pytest.approx(43.4965) and got["SAIR"].Zoom is None


def test_three_key_join_does_not_fan_out(spark):
    sites = spark.createDataFrame([("ACAD", "XNET_ACAD_DUCK", "Duck Brook")], "ParkCode string, SiteCode string, SiteName string")
    text = spark.createDataFrame(
        [("ACAD", "Duck Brook", "XNET_ACAD_DUCK", "now"), ("ACAD", "Duck Brook (outlet)", "XNET_ACAD_DUCK", "old")],
        "ParkCode string, SiteName string, SiteCode string, Description string")
    rows = left_join(sites, text, ["SiteCode", "ParkCode", "SiteName"]).collect()
    assert [r.Description for r in rows] == ["now"]


@pytest.mark.parametrize("hot", [False, True])
def test_full_join(spark, hot):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, l string")
    right = spark.createDataFrame([(1, 1.0), (3, 3.0)], "k int, r double")
    got = {tuple(r) for r in full_join(left, right, hot=hot).select("k", "l", "r").collect()}
    assert got == {(1, "a", 1.0), (1, "b", 1.0), (2, "c", None), (None, "n", None), (3, None, 3.0)}


def test_join_on_matches_null_keys(spark):
    left = spark.createDataFrame([(None, "n"), (1, "a")], "k int, l string")
    right = spark.createDataFrame([(None, "x")], "k int, r string")
    assert [tuple(r) for r in join_on(left, right, ["k"]).collect()] == [(None, "n", "x")]
    assert [r.l for r in join_on(left, right, ["k"], "left_anti").collect()] == ["a"]


def test_first_site_points(spark, samples):
    from limnograph.schema import CHARACTERISTICS

    chars = spark.createDataFrame(
        [("MABI", "B", "pH", "pH", "pH", "physical", "", 1.0, None), ("MABI", "A", "pH", "pH", "pH", "physical", "", None, 9.0)],
        CHARACTERISTICS)
    meas = samples([{"Site": s, "Date": "2019-05-01", "ValueCen": 1.0} for s in "AB"])
    per_site = {r.Site: (r.LowerPoint, r.UpperPoint) for r in thresholds.with_points(meas, chars).collect()}
    first = {r.Site: (r.LowerPoint, r.UpperPoint) for r in thresholds.with_points(meas, chars, mode="first").collect()}
    assert per_site == {"A": (None, 9.0), "B": (1.0, None)}
    assert first == {"A": (None, 9.0), "B": (None, 9.0)}
