"""One object over a measurement table and its dimensions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from limnograph.operators import anomaly, catalog, checks, loess, trend
from limnograph.operators.bands import percentile_bands
from limnograph.operators.filters import historic
from limnograph.plans import batch, boxplot, drafts, report_index, site_comparison, site_map, waterbands
from limnograph.plans.params import ReportParams
from limnograph.session import discard
from limnograph.sources import readers
from limnograph.sources.monitoring_view import MonitoringView


@dataclass(frozen=True)
class Monitor:
    """Reports over all parks, sites and characteristics; every method returns a DataFrame."""

    meas: DataFrame
    parks: DataFrame
    sites: DataFrame
    chars: DataFrame
    params: ReportParams = field(default_factory=ReportParams)

    @classmethod
    def open(cls, spark: SparkSession, data: str, metadata: str, *, fmt: str = "csv",
             params: ReportParams | None = None) -> Monitor:
        parks, sites, chars = readers.scan_metadata(spark, metadata, fmt=fmt)
        meas = readers.scan_measurements(spark, data, fmt=fmt)
        return cls(meas, parks, sites, chars, params or ReportParams())

    @classmethod
    def over(cls, view: MonitoringView, params: ReportParams) -> Monitor:
        return cls(view.meas, view.parks, view.sites, view.chars, params)

    def wdata(self, **filters) -> DataFrame:
        return catalog.get_wdata(self.meas, **filters)

    def park_info(self, info, **filters) -> DataFrame:
        return catalog.get_park_info(self.parks, info, **filters)

    def site_info(self, info, **filters) -> DataFrame:
        return catalog.get_site_info(self.sites, info, **filters)

    def char_info(self, info, **filters) -> DataFrame:
        return catalog.get_char_info(self.chars, info, **filters)

    def nested(self, level: str = "site", **options) -> DataFrame:
        """``level`` is ``park``, ``site`` or ``data`` (pages of samples)."""
        levels = {"park": catalog.nested_parks, "site": catalog.nested_catalog, "data": catalog.nested_pages}
        return levels[level](self.meas, **options)

    def waterbands(self, **options) -> DataFrame:
        p = self.params
        options = {"months": p.months, **options}
        return waterbands.waterbands(self.meas, self.chars, year_historic=p.year_from,
                                     year_current=p.current, **options)

    def boxplot(self, **options) -> DataFrame:
        p = self.params
        return boxplot.boxplot(self.meas, self.sites, self.chars, year_from=p.year_from,
                               year_to=p.year_to, current_year=p.current, **options)

    def site_comparison(self, **options) -> DataFrame:
        options = {"year": self.params.current, "months": self.params.months, **options}
        return site_comparison.site_comparison(self.meas, self.sites, self.chars, **options)

    def site_map(self, descriptions: DataFrame, boxes: DataFrame, **options) -> DataFrame:
        options = {"category": self.params.category, **options}
        return site_map.site_map(self.meas, self.sites, descriptions, boxes, **options)

    def report_index(self) -> DataFrame:
        return report_index.report_index(self.meas, self.sites, self.chars, self.params)

    def all_sites(self) -> DataFrame:
        p = self.params
        return drafts.all_sites(self.meas, self.sites, year_from=p.year_from, year_to=p.year_to,
                                current=p.current)

    def loess_bands(self, *, span: float = 1.0, surface: str = "direct") -> DataFrame:
        bands = percentile_bands(historic(self.meas, self.params.year_from, self.params.current))
        return loess.loess_bands(bands, span=span, surface=surface)

    def series(self, *, assessment: bool = False, **options) -> DataFrame:
        return anomaly.series(self.meas, chars=self.chars if assessment else None, **options)

    def heat_anomaly(self) -> DataFrame:
        return anomaly.heat_anomaly(self.meas)

    def trend_nonpar(self, **options) -> DataFrame:
        return trend.trend_nonpar(self.meas, **options)

    def status(self) -> DataFrame:
        p = self.params
        pairs = catalog.list_site_chars(self.chars)
        return checks.series_status(pairs, self.meas, year_historic=p.year_from, year_current=p.current)

    def write_batch(self, out: str, parks=None, *, descriptions: DataFrame | None = None, boxes: DataFrame | None = None,
                    park_code=None) -> dict[str, str]:
        """Stage the samples, write every dataset from them and publish the batch; ``batch.current_batch`` finds it."""
        spark = self.meas.sparkSession
        parks = None if parks is None else list(parks)
        meas, place = batch.staged(self.meas, self.params, parks)
        datasets = batch.report_datasets(meas, self.sites, self.chars, self.params, descriptions=descriptions, boxes=boxes,
                                         park_code=park_code)
        paths = batch.write_batch(datasets, out, parks)
        discard(spark, place)
        return paths
