"""Readers, writers, getters, functions, batch and stream."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from limnograph import Monitor, ReportParams
from limnograph.functions import calendar, codes, labels
from limnograph.functions.nulls import if_else
from limnograph.operators import catalog, checks, filters
from limnograph.plans import batch
from limnograph.schema import BOUNDING_BOXES, MEASUREMENTS, SITE_DESCRIPTIONS, conform, require_columns
from limnograph.session import scratch_path
from limnograph.sources import readers, sinks, tables
from limnograph.streaming import exceedance

SITE_TEXT = '''ParkCode,SiteName,SiteCode,Description
QQQQ,First gauge,XNET_QQQQ_G001,"Runs <b>east</b>, below the weir"
QQQQ,First gauge (below),XNET_QQQQ_G001,"A ""second"" row, same code"
RRRR,Basin,XNET_RRRR_B001,No quotes here
'''
BOX_TEXT = '''ParkCode,LatS,LongE,LatN,LongW,Zoom,minZoom
QQQQ,12.5,-3.25,12.25,-3.75,9,7
RRRR,1.0,2.0,1.5,1.75,,
'''


def test_quoted_descriptions(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text(SITE_TEXT)
    rows = readers.scan_siteinfo(spark, str(path)).collect()
    assert [r.Description for r in rows] == ["Runs <b>east</b>, below the weir", 'A "second" row, same code', "No quotes here"]


def test_empty_zoom_is_missing(spark, tmp_path):
    path = tmp_path / "boxes.csv"
    path.write_text(BOX_TEXT)
    rows = {r.ParkCode: r for r in readers.scan_boundboxes(spark, str(path)).collect()}
    assert rows["RRRR"].Zoom is None and rows["QQQQ"].minZoom == 7


@pytest.fixture(scope="module")
def meas(samples):
    rows = []
    for site, shift in (("XNET_MABI_PA00", 0.0), ("XNET_MABI_SA00", 1.0)):
        for year in range(2010, 2016):
            for month in (5, 6, 8):
                for char, category in (("pH", "physical"), ("TP_ugL", "nutrients")):
                    rows.append({"Site": site, "Date": f"{year}-{month:02d}-10", "Characteristic": char,
                                 "Category": category, "ValueCen": 6.0 + shift + (year % 3) / 2})
    return samples(rows).cache()


@pytest.fixture(scope="module")
def flat(spark):
    schema = ("ParkCode string, ParkShortName string, ParkLongName string, Network string, SiteCode string, "
              "SiteName string, lat double, long double, type string, CharName string, DisplayName string, "
              "CategoryDisplay string, Category string, Units string, LowerPoint double, UpperPoint double")
    rows = []
    for site, name, kind in (("XNET_MABI_PA00", "Pond", "Lake"), ("XNET_MABI_SA00", "Brook, upper", "Stream")):
        place = ("MABI", "Marsh", "Marsh Park", "net", site, name, 43.6, -72.5, kind)
        rows.append((*place, "pH", "pH", "pH", "physical", "pH units", 6.5, 7.9))
        rows.append((*place, "TP_ugL", "Phosphorus", "Phosphorus", "nutrients", "ug/L", None, 7.0))
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def monitor(spark, meas, flat):
    data = sinks.write_csv(conform(meas, MEASUREMENTS), scratch_path(spark, "data"))
    metadata = sinks.write_csv(flat, scratch_path(spark, "metadata"))
    return Monitor.open(spark, data, metadata, params=ReportParams(2010, 2014, 2015))


def test_csv_round_trip(monitor, meas):
    assert monitor.meas.exceptAll(conform(meas, MEASUREMENTS)).count() == 0
    assert monitor.meas.count() == meas.count()
    assert monitor.parks.count() == 1 and monitor.sites.count() == 2 and monitor.chars.count() == 4


def test_getters(monitor):
    assert [r[0] for r in monitor.park_info("ParkLongName", park="MABI").collect()] == ["Marsh Park"]
    assert {r[0] for r in monitor.site_info("SiteName", site=["XNET_MABI_SA00"]).collect()} == {"Brook, upper"}
    assert [r[0] for r in monitor.char_info("CharName", category="nutrients").collect()] == ["TP_ugL"]
    assert monitor.wdata(char="pH", years=2015, months=[5]).count() == 2
    nested = {r.Site: r for r in monitor.nested().collect()}
    assert [c.Characteristic for c in nested["XNET_MABI_PA00"].characteristics] == ["TP_ugL", "pH"]


def test_datasets(monitor):
    bands = monitor.waterbands()
    assert bands.count() == 12 and bands.where("num_samps = 5").count() == 12
    box = monitor.boxplot()
    assert {r.layer for r in box.collect()} >= {"box", "current", "threshold"}
    assert {(r.Site, r.month_num) for r in box.where("layer = 'box'").collect()} == {
        ("XNET_MABI_PA00", 6), ("XNET_MABI_PA00", 8), ("XNET_MABI_SA00", 5), ("XNET_MABI_SA00", 8)}
    comparison = monitor.site_comparison(site_type="Lake")
    assert {r.SiteName for r in comparison.collect()} == {"Pond"}
    assert all(r.rows_physical == 2 and r.n_physical == 1 for r in monitor.report_index().collect())
    assert monitor.all_sites().where("min_val IS NOT NULL").count() == 12
    assert monitor.trend_nonpar().count() == 4 and monitor.loess_bands().count() == 44
    assert {r.status for r in monitor.status().collect()} == {"ok"}


def test_batch_is_partitioned_by_park(spark, monitor):
    paths = monitor.write_batch(scratch_path(spark, "batch"), parks=["MABI"])
    assert set(paths) == {"waterbands", "site_comparison", "site_comparison_lake", "site_comparison_stream", "report_index", "boxplot",
                          "standards"}
    for path in paths.values():
        assert {r[0] for r in spark.read.parquet(path).select("Park").distinct().collect()} == {"MABI"}


def test_stream_flags_like_batch(spark, monitor):
    folder, out, marks = (scratch_path(spark, x) for x in ("in", "out", "marks"))
    monitor.meas.repartition(3).write.parquet(folder)
    stream = exceedance.stream_parquet(spark, folder, MEASUREMENTS, files_per_trigger=1)
    exceedance.write_stream(exceedance.flag_stream(stream, monitor.chars), out, marks).awaitTermination()
    got = spark.read.parquet(out).groupBy("pcolor").count().collect()
    batch = exceedance.flag_stream(monitor.meas, monitor.chars).groupBy("pcolor").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in batch} and len(got) == 2


def test_status_codes(spark, samples):
    pairs = spark.createDataFrame([("MABI", s, "pH") for s in "abcd"], "Park string, Site string, Characteristic string")
    meas = samples([{"Site": "a", "Date": "2019-05-01", "ValueCen": 1.0}, {"Site": "b", "Date": "2018-05-01", "ValueCen": 1.0},
                    {"Site": "c", "Date": "2018-05-01", "ValueCen": 1.0}, {"Site": "c", "Date": "2019-05-01", "ValueCen": 1.0}])
    out = checks.series_status(pairs, meas, year_historic=2010, year_current=2019)
    assert {r.Site: r.status for r in out.collect()} == {"a": "no_history", "b": "no_current", "c": "ok", "d": "no_rows"}


def test_strict_checks(samples):
    with pytest.raises(ValueError, match="nothing"):
        checks.require_rows(samples([]), "nothing to report")
    for bad in (19, "2019", None, True, 20190):
        with pytest.raises(ValueError):
            checks.require_single_year(bad)
    with pytest.raises(ValueError, match="missing"):
        require_columns(samples([]), "Nope")


def test_current_and_shared(spark, monitor):
    assert filters.current_sites(monitor.sites, monitor.meas, 2015).count() == 2
    assert filters.current_sites(monitor.sites, monitor.meas, 1999).count() == 0
    pairs = catalog.list_site_chars(monitor.chars)
    assert filters.shared_characteristics(pairs).count() == 2
    assert filters.drop_position(pairs, 2).count() == 2


def test_scalar_functions(spark):
    row = spark.sql("SELECT DATE '2019-05-07' AS d, 'XNET_MABI_SA00pH' AS key, 2.25D AS x, CAST(NULL AS BOOLEAN) AS b").select(
        calendar.month_abbr(F.col("d")).alias("abbr"), calendar.month_full(F.col("d")).alias("full"),
        calendar.mon_year(F.col("d")).alias("my"), calendar.year_text(F.col("d")).alias("yt"),
        codes.site_from_key(F.col("key")).alias("site"), codes.park_from_site(F.col("key")).alias("park"),
        codes.state_of_park(F.lit("ROVA")).alias("ny"), codes.state_of_park(F.lit("ZZZZ")).alias("other"),
        labels.round1(F.col("x")).alias("r"), labels.strip_unit(F.lit("DO_mgL")).alias("strip"),
        labels.unit_display(F.lit("pct")).alias("pct"), labels.unit_display(F.lit("pH units")).alias("ph"),
        labels.axis_label(F.lit("DO"), F.lit("mg/L")).alias("axis"), labels.number_text(F.lit(None).cast("double")).alias("na"),
        if_else(F.col("b"), "yes", "no").alias("unknown"), sinks.output_name(F.lit("MABI")).alias("file"),
        calendar.month_axis([6, 8, 7]).alias("axis_months"),
    ).collect()[0]
    assert (row.abbr, row.full, row.my, row.yt) == ("May", "May", "May 2019", "2019")
    assert (row.site, row.park, row.ny, row.other) == ("XNET_MABI_SA00", "MABI", "NY", "other")
    assert (row.r, row["strip"], row.pct, row.ph, row.axis, row.na) == (2.2, "DO", "%", "", "DO (mg/L)", "NA")
    assert row.unknown is None and row.file == "WQ_parameters_MABI.html"
    assert [(m.month_num, m.month) for m in row.axis_months] == [(6, "Jun"), (7, "Jul"), (8, "Aug")]


def test_flag_columns(spark):
    flags = codes.flag_columns(F.lit("MA"), codes.STATES)
    row = spark.range(1).select(*[c.alias(n) for n, c in flags.items()]).collect()[0]
    assert row.MA is True and row.NY is False


def test_lookup_tables(spark):
    assert tables.state_standards(spark).count() == 14
    assert tables.ecoregion_thresholds(spark).count() == 4
    assert tables.store_codes(spark).count() == 9


def test_csv_keeps_line_breaks_blanks_and_empty_texts(spark):
    rows = [("A", "n", "S1", 'one\ntwo "quoted", x'), ("A", " n ", "S2", "a\r\nb"), ("B", None, "S3", ""), ("B", "\n", "S4", "a\n\nb\n")]
    path = sinks.write_csv(spark.createDataFrame(rows, SITE_DESCRIPTIONS), scratch_path(spark, "breaks"))
    assert sorted(map(tuple, readers.scan_siteinfo(spark, path).collect()), key=str) == sorted(rows, key=str)
    assert readers.broken_records(spark, path, SITE_DESCRIPTIONS).count() == 0


@pytest.mark.parametrize("one_line", [False, True])
def test_broken_records_are_kept_apart(spark, tmp_path, one_line):
    lines = [",".join(MEASUREMENTS.fieldNames()), "A,S,pH,physical,2019-01-01,x,1.5,t,false,1.5", "A,S,pH,physical,soon,x,1.5,t,false,1.5",
             "A,S,pH", "A,S,pH,physical,2019-01-01,x,abc,t,false,1.5", "A,S,pH,physical,2019-01-02,x,,,true,2"]
    path = tmp_path / "data.csv"
    path.write_text("\n".join(lines) + "\n")
    good = readers.scan_measurements(spark, str(path), one_line=one_line)
    bad = readers.broken_records(spark, str(path), one_line=one_line)
    assert sorted(r.record for r in bad.collect()) == sorted(lines[2:5])
    assert good.count() == 2 and bad.count() == 3 and [r.Value for r in good.orderBy("Date").collect()] == [1.5, None]


def test_pages_hold_every_sample_once(spark, samples):
    rows = [{"Site": "busy", "Date": "2019-05-01", "ValueCen": float(i)} for i in range(95)]
    rows += [{"Site": "busy", "Date": f"2019-06-{d:02d}", "ValueCen": float(i)} for d in range(1, 8) for i in range(4)]
    rows += [{"Site": "same", "Date": "2019-05-01", "ValueCen": 3.0}] * 500 + [{"Site": "gap", "Date": None, "ValueCen": None}]
    meas = samples(rows)
    pages = catalog.nested_pages(meas, page_rows=10).collect()
    assert max(len(p.samples) for p in pages) < 30 and sum(p.n_samples for p in pages) == len(rows)
    found = sorted((p.Site, str(s.Date), str(s.ValueCen), s.copies) for p in pages for s in p.samples)
    expected = meas.groupBy("Site", "Date", "ValueCen").count().collect()
    assert found == sorted((r.Site, str(r.Date), str(r.ValueCen), r["count"]) for r in expected)
    assert len({(p.Site, p.page, p.day, p.part) for p in pages}) == len(pages)
    parks = catalog.nested_parks(meas).collect()
    assert [s.Site for s in parks[0].sites] == ["busy", "gap", "same"] and parks[0].n_samples == len(rows)


def test_months_of_years_reach_the_scan(spark, monitor):
    path = scratch_path(spark, "dates")
    monitor.meas.sortWithinPartitions("Date").write.parquet(path)
    table = spark.read.parquet(path)
    for months in ([5, 6], [6, 8], [12, 1], [], range(1, 13)):
        rows = catalog.get_wdata(table, years=(2011, 2013), months=months)
        plain = table.where(F.year("Date").between(2011, 2013) & F.month("Date").isin(*months)) if months else table.limit(0)
        assert rows.exceptAll(plain).count() == 0 == plain.exceptAll(rows).count()
    spark.conf.set("spark.sql.maxMetadataStringLength", 5_000)
    plan = catalog.get_wdata(table, years=(2011, 2012), months=[5, 6])._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters")[1].split("ReadSchema")[0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Or(And(" in pushed and "2012-05-01" in pushed and "2012-07-01" in pushed and "month(" not in plan
    many = catalog.get_wdata(table, years=(1800, 2015), months=[5, 6])
    assert many.count() == table.where("month(Date) IN (5, 6)").count()


def test_a_batch_is_published_whole(spark, monitor, flat):
    out = scratch_path(spark, "published")
    descriptions = spark.createDataFrame([("MABI", "Pond", "XNET_MABI_PA00", "A pond")], SITE_DESCRIPTIONS)
    boxes = spark.createDataFrame([("MABI", 1.0, 2.0, 3.0, 4.0, 9, 7)], BOUNDING_BOXES)
    first = monitor.write_batch(out, descriptions=descriptions, boxes=boxes)
    assert batch.current_batch(spark, out) == first
    assert {(r.Site, r.source) for r in spark.read.parquet(first["standards"]).collect()} >= {("XNET_MABI_PA00", "state"), ("XNET_MABI_SA00", "ecoregion")}
    assert {r.SiteCode: r.Description for r in spark.read.parquet(first["site_map"]).collect()} == {
        "XNET_MABI_PA00": "A pond", "XNET_MABI_SA00": None}
    broken = {"report_index": monitor.report_index(), "failing": monitor.meas.withColumn("x", F.raise_error(F.lit("stop")))}
    with pytest.raises(Exception, match="stop"):
        batch.write_batch(broken, out)
    assert batch.current_batch(spark, out) == first
    second = monitor.write_batch(out)
    assert batch.current_batch(spark, out) == second and set(second.values()).isdisjoint(first.values())


def test_given_points_names_and_facets(monitor):
    rows = monitor.waterbands(assessment=[6.4, 9.0], param_name="Reading", unit="u", yname="y").collect()
    assert len(rows) == 24 and {(r.param_name, r.unit, r.yname) for r in rows} == {("Reading", "u", "y")}
    assert {(r.AssessmentPoint, r.pcolor) for r in rows if r.ValueCen_curr == 7.0 + 2015 % 3 / 2 + 0.0} == {(6.4, "orange"), (9.0, "black")}
    with pytest.raises(ValueError):
        monitor.waterbands(assessment="guess")
    points = monitor.series(assessment=True, facet="Site", deseason=True).collect()
    assert {(r.label, r.LowerPoint, r.UpperPoint) for r in points} == {("pH", 6.5, 7.9), ("Phosphorus (ug/L)", None, 7.0)}
    assert {r.panel for r in points} >= {"XNET_MABI_PA00 May", "XNET_MABI_SA00 Aug"}
    with pytest.raises(ValueError):
        monitor.series(facet="Depth")
    assert monitor.nested("park").count() == 1 and monitor.nested("data", page_rows=5).agg(F.sum("n_samples")).first()[0] == 72


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from limnograph import session

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.sql.warehouse.dir": "file:/here"}.get(key, default))

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_folder(Elsewhere)
    frame, path = session.written(spark.range(3), "kept")
    assert frame.count() == 3
    session.discard(spark, path)
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_limits_of_the_rules_as_listed():
    """Values of the rule tables, apart from the constants that the queries are built from."""
    assert {state for state, *_ in tables.STATE_STANDARDS} == {"CT", "ME", "MA", "NH", "NJ", "NY", "VT"}
    assert [(row[0], row[4]) for row in tables.STATE_STANDARDS if row[0] == "NY"] == [("NY", "7.0 (cold)"), ("NY", "4.0 (warm)")]
    assert [row[2:4] for row in tables.ECOREGION] == [("14.5", "0.4"), ("22", "0.6"), ("17.1", "0.345"), ("32.6", "0.482")]
    assert tables.PARK_STORE_CODE["MABI"] == "1062" and tables.PARK_STORE_CODE["WEFA"] == "1176"


def test_set_minus_looks_at_the_whole_current_year(spark, tmp_path):
    """A pair sampled in any month of the current year goes; only one without a sample in that year stays."""
    from limnograph.queries import REGISTRY

    spark.createDataFrame([(0, "NATION", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, "S1", 0, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double") \
        .write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(1, 1, 1, "2001-03-05"), (2, 1, 2, "2001-07-05"), (3, 1, 3, "2000-07-05")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, d string").selectExpr(
        "l_orderkey", "l_suppkey", "l_linenumber", "CAST(d AS TIMESTAMP) AS l_shipdate", "1D AS l_quantity", "0.05D AS l_discount") \
        .write.parquet(f"{tmp_path}/lineitem.parquet")
    got = REGISTRY["set_minus"].run(spark, str(tmp_path)).collect()
    assert [r.Characteristic for r in got] == ["Temp_C"]


def test_only_the_samples_of_a_batch_are_staged(samples):
    meas = samples([("2019-06-01", 1.0), ("2020-06-01", 2.0)]).unionByName(samples([("2019-06-01", 3.0)], Park="MIMA"))
    params = ReportParams(year_from=2006, year_to=2018, current=2019)
    assert [r.Park for r in batch.staged(meas, params, ["MIMA"])[0].collect()] == ["MIMA"]
    assert sorted(r.ValueCen for r in batch.staged(meas, params)[0].collect()) == [1.0, 3.0]
