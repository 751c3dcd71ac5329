"""Gate, ties, missing values and the full join of history and current year."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from limnograph.operators.bands import mean_and_95_band, monthly_bands, percentile_bands, site_month_range
from limnograph.plans.waterbands import waterbands, waterbands_labels


@pytest.fixture(scope="module")
def chars(spark):
    from limnograph.schema import CHARACTERISTICS

    rows = [("MABI", "XNET_MABI_SA00", "pH", "pH", "pH", "physical", "pH units", 6.5, 8.5),
            ("MABI", "XNET_MABI_SA00", "DO_mgL", "DO", "Oxygen", "physical", "mg/L", 7.0, None)]
    return spark.createDataFrame(rows, CHARACTERISTICS)


def years(values, month="05"):
    return [(f"{2006 + i}-{month}-15", v) for i, v in enumerate(values)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_gate_needs_four_samples(samples):
    assert monthly_bands(samples(years([1.0, 2.0, 3.0]))).count() == 0
    assert monthly_bands(samples(years([1.0, 2.0, 3.0, 4.0]))).count() == 1


def test_gate_counts_missing_values_but_quantiles_skip_them(samples):
    row = one(monthly_bands(samples(years([1.0, None, 2.0, 3.0]))))
    assert (row.num_samps, row.median_val, row.min_val, row.max_val) == (4, 2.0, 1.0, 3.0)


def test_month_without_values_is_dropped(samples):
    assert monthly_bands(samples(years([None] * 4))).count() == 0


def test_quantiles(samples):
    row = one(monthly_bands(samples(years([1.0, 2.0, 3.0, 10.0, 1.0]))))
    got = [row.lower_95, row.lower_50, row.median_val, row.upper_50, row.upper_95]
    assert got == pytest.approx([1.0, 1.0, 2.0, 3.0, 9.3])


def test_ties_go_to_the_latest_year(samples):
    rows = [("2010-05-01", 1.0), ("2015-05-01", 1.0), ("2011-05-01", 9.0), ("2008-05-01", 9.0)]
    row = one(monthly_bands(samples(rows)))
    assert (row.year_min, row.year_max) == (2015, 2011)


def test_missing_value_is_not_the_minimum(samples):
    rows = [("2016-05-01", None), ("2010-05-01", 1.0), ("2011-05-01", 2.0), ("2012-05-01", 3.0)]
    assert one(monthly_bands(samples(rows))).year_min == 2010


def test_band_nesting_and_order_invariance(samples):
    values = [7.1, 6.9, 7.4, 8.0, 6.2, 7.7, 7.0]
    first = one(monthly_bands(samples(years(values))))
    second = one(monthly_bands(samples(list(reversed(years(values)))).repartition(3)))
    assert first == second
    edges = [first.lower_100, first.lower_95, first.lower_50, first.median_val, first.upper_50,
             first.upper_95, first.upper_100]
    assert edges == sorted(edges)


def test_percentile_bands_have_full_month_names(samples):
    assert one(percentile_bands(samples(years([1.0, 2.0, 3.0, 4.0])))).month == "May"


def test_mean_band_is_missing_with_a_missing_value(samples):
    row = one(mean_and_95_band(samples(years([1.0, 2.0, None, 4.0]))))
    assert row["mean"] is None and row.num_samps == 4 and row.lower_pct is not None
    assert one(mean_and_95_band(samples(years([1.0, 2.0, 3.0, 6.0]))))["mean"] == 3.0


def test_site_range_propagates_missing(samples):
    row = one(site_month_range(samples(years([1.0, None]))))
    assert (row.min_val, row.max_val) == (None, None)


def test_full_join_keeps_both_sides_and_repeats(samples, chars):
    rows = years([6.0, 7.0, 8.0, 7.5]) + [("2019-05-01", 9.0), ("2019-05-20", 7.0), ("2019-07-01", None)]
    rows += years([6.5, 7.0, 7.2, 7.4], month="06")
    out = waterbands(samples(rows), chars, year_historic=2006, year_current=2019)
    got = {(r.month_num, r.ValueCen_curr): r for r in out.collect()}
    assert set(got) == {(5, 9.0), (5, 7.0), (6, None), (7, None)}
    assert got[(5, 9.0)].pcolor == "orange" and got[(5, 7.0)].pcolor == "black"
    assert got[(5, 9.0)].median_val == got[(5, 7.0)].median_val == 7.25
    assert got[(6, None)].year_curr is None and got[(6, None)].month == "Jun"
    assert got[(7, None)].median_val is None and got[(7, None)].pcolor is None


def test_history_ends_before_the_current_year_and_season_is_kept(samples, chars):
    rows = years([6.0, 7.0, 8.0, 7.5]) + [("2019-05-01", 1.0), ("2005-05-01", 0.0), ("2010-01-01", 99.0)]
    row = one(waterbands(samples(rows), chars, year_historic=2006, year_current=2019))
    assert (row.num_samps, row.min_val, row.max_val) == (4, 6.0, 8.0)


def test_assessment_none(samples, chars):
    rows = years([6.0, 7.0, 8.0, 7.5]) + [("2019-05-01", 99.0)]
    row = one(waterbands(samples(rows), chars, year_historic=2006, year_current=2019, assessment="none"))
    assert row.UpperPoint is None and row.pcolor == "black"


def test_labels(samples, chars):
    rows = years([6.0, 7.0, 8.0, 7.5]) + [("2019-05-01", 9.25)]
    out = waterbands_labels(waterbands(samples(rows), chars, year_historic=2006, year_current=2019))
    row = one(out)
    assert row.tip_max == "Historic May Maximum: <br>pH: 8 pH units<br>Year observed: 2008"
    assert row.tip_current == "May 2019<br>pH: 9.2 pH units"
    assert row.tip_upper == "Upper pH threshold: 8.5 pH units"
    assert row.yname == "pH"


def test_year_filter_reaches_the_scan(spark, samples, tmp_path):
    from limnograph.operators.catalog import get_wdata
    from limnograph.sources.readers import scan_measurements

    path = str(tmp_path / "m")
    samples(years([1.0, 2.0])).write.parquet(path)
    df = get_wdata(scan_measurements(spark, path, fmt="parquet"), years=(2006, 2007)).select("Date", "ValueCen")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(Date,2006-01-01)" in plan and "LessThan(Date,2008-01-01)" in plan
    assert "ReadSchema: struct<Date:date,ValueCen:double>" in plan
    assert df.where(F.col("ValueCen") > 1).count() == 1


def test_rule_bands_keep_both_sides(spark, samples):
    from limnograph.plans.drafts import bands_with_rules
    from limnograph.sources.tables import rule_thresholds

    meas = samples(years([6.0, 7.0, 8.0, 7.5]) + [("2019-05-01", 9.0), ("2019-05-20", 7.0), ("2019-07-01", None)])
    rows = bands_with_rules(meas, rule_thresholds(spark), year_from=2006, current=2019).collect()
    got = sorted((r.mon_num, r.ValueCen or 0.0, r.median_val) for r in rows)
    assert got == [(5, 7.0, 7.25), (5, 9.0, 7.25), (7, 0.0, None)]
