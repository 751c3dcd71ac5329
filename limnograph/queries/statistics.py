"""Smoothing, series, anomalies and trends."""

from __future__ import annotations

from limnograph.operators import anomaly, bands, loess, trend
from limnograph.queries.base import query
from limnograph.queries.joins import history
from limnograph.queries.sql import bands as season_sql, smooth, smooth_surface


_SMOOTH = "Park Site Characteristic mon_num:d " + " ".join(f"{c}:f" for c in loess.SMOOTHED.values())


@query("loess_bands", _SMOOTH, f"SELECT * FROM {smooth(season_sql(), 1.0)} AS b")
def loess_bands(v):
    return loess.loess_bands(bands.percentile_bands(history(v)), span=1.0)


@query("loess_bands_span06", _SMOOTH, f"SELECT * FROM {smooth(season_sql(), 0.6)} AS b")
def loess_bands_span06(v):
    return loess.loess_bands(bands.percentile_bands(history(v)), span=0.6)


@query("loess_bands_surface", _SMOOTH, f"SELECT * FROM {smooth_surface(season_sql(), 1.0, loess.MARGIN)} AS b")
def loess_bands_surface(v):
    return loess.loess_bands(bands.percentile_bands(history(v)), span=1.0, surface="interpolate")


@query("loess_median", "Park Site Characteristic mon_num:d smooth_median:f",
       f"SELECT * FROM {smooth(season_sql(), 0.8, {'median_val': 'smooth_median'})} AS b")
def loess_median(v):
    return loess.loess_bands(bands.percentile_bands(history(v)), columns={"median_val": "smooth_median"}, span=0.8)


_SERIES = "Park Site Characteristic Date:t month month_num:i year:i value:d marker panel"


@query(
    "series",
    _SERIES,
    """SELECT * EXCLUDE (Value), ValueCen AS value, CASE WHEN Censored THEN 'censored' ELSE 'measured' END AS marker, month AS panel
       FROM sample""",
)
def series(v):
    return anomaly.series(v.meas, censored=True, deseason=True)


@query("series_uncensored", _SERIES,
       "SELECT * EXCLUDE (Value), ValueCen AS value, 'measured' AS marker, 'all' AS panel FROM sample WHERE NOT Censored")
def series_uncensored(v):
    return anomaly.series(v.meas)


@query(
    "series_facets",
    _SERIES + " label LowerPoint:d UpperPoint:d",
    """SELECT s.* EXCLUDE (Value), ValueCen AS value, CASE WHEN Censored THEN 'censored' ELSE 'measured' END AS marker,
         s.Characteristic || ' ' || month AS panel, LowerPoint, UpperPoint,
         CASE WHEN s.Characteristic <> 'pH' THEN param_name || ' (' || unit || ')' ELSE param_name END AS label
       FROM sample AS s LEFT JOIN points AS p ON p.Park = s.Park AND p.Site = s.Site AND p.Characteristic = s.Characteristic""",
)
def series_facets(v):
    return anomaly.series(v.meas, censored=True, deseason=True, facet="Characteristic", chars=v.chars)


@query(
    "heat_anomaly",
    "Park Site Characteristic year:i month_num:i n:i month_mean:d series_mean:d anomaly:d",
    """SELECT *, month_mean - series_mean AS anomaly FROM (
         SELECT Park, Site, Characteristic, year, month_num, count(ValueCen) AS n, avg(ValueCen) AS month_mean
         FROM sample WHERE ValueCen IS NOT NULL GROUP BY ALL)
       JOIN (SELECT Park, Site, Characteristic, avg(ValueCen) AS series_mean FROM sample GROUP BY ALL)
         USING (Park, Site, Characteristic)""",
)
def heat_anomaly(v):
    return anomaly.heat_anomaly(v.meas)


def trend_sql(keys: str, censored: bool) -> str:
    """The published definitions, by listing all pairs."""
    keep = "" if censored else "AND NOT Censored"
    key_list = ", ".join(keys)
    same = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""
WITH x AS (
  SELECT {key_list}, CAST(Date - DATE '1970-01-01' AS BIGINT) AS t, ValueCen AS y, NOT Censored AS u
  FROM sample WHERE ValueCen IS NOT NULL {keep}),
pairs AS (
  SELECT {', '.join(f'a.{k}' for k in keys)}, (b.y - a.y) / (b.t - a.t) AS slope, a.u AS au, b.u AS bu
  FROM x AS a JOIN x AS b ON {same} AND a.t < b.t WHERE a.u OR b.u),
scored AS (
  SELECT *, CASE WHEN au AND bu THEN sign(slope) WHEN bu THEN CASE WHEN slope >= 0 THEN 1 ELSE 0 END
      ELSE CASE WHEN slope <= 0 THEN -1 ELSE 0 END END AS score,
    CASE WHEN au AND bu THEN 2 ELSE 1 END AS drop, CASE WHEN bu THEN 1 ELSE 0 END AS start
  FROM pairs),
totals AS (
  SELECT {key_list}, CAST(sum(score) AS BIGINT) AS s, sum(start) AS start, sum(drop) AS total
  FROM scored GROUP BY {key_list}),
cumulated AS (
  SELECT {key_list}, slope, sum(drop) OVER (PARTITION BY {key_list} ORDER BY slope) AS reached FROM scored),
ends AS (
  SELECT {key_list}, min(slope) FILTER (WHERE t.start > 0 AND reached >= t.start) AS low,
    min(slope) FILTER (WHERE reached > t.start) AS high
  FROM cumulated JOIN totals AS t USING ({key_list}) GROUP BY {key_list}),
ties AS (
  SELECT * FROM (
    SELECT {key_list}, sum(c) AS n, sum(c * (c - 1)) AS v2, sum(c * (c - 1) * (c - 2)) AS v3,
      sum(c * (c - 1) * (2 * c + 5)) AS v5
    FROM (SELECT {key_list}, y, count(*)::DOUBLE AS c FROM x GROUP BY {key_list}, y) GROUP BY {key_list})
  JOIN (
    SELECT {key_list}, count(*) AS n_days, sum(c * (c - 1)) AS d2, sum(c * (c - 1) * (c - 2)) AS d3,
      sum(c * (c - 1) * (2 * c + 5)) AS d5
    FROM (SELECT {key_list}, t, count(*)::DOUBLE AS c FROM x GROUP BY {key_list}, t) GROUP BY {key_list})
  USING ({key_list})),
joined AS (
  SELECT *, n * (n - 1) AS p, coalesce(totals.s, 0) AS score FROM ties LEFT JOIN totals USING ({key_list})
    LEFT JOIN ends USING ({key_list})),
varied AS (
  SELECT *, (p * (2 * n + 5) - v5 - d5) / 18 + CASE WHEN n > 1 THEN v2 * d2 / (2 * p) ELSE 0 END
      + CASE WHEN n > 2 THEN v3 * d3 / (9 * p * (n - 2)) ELSE 0 END AS var,
    sqrt((p - v2) * (p - d2)) / 2 AS untied
  FROM joined)
SELECT {key_list}, n, n_days, score AS s, CASE WHEN untied > 0 THEN score / untied END AS tau,
  CASE WHEN var > 0 THEN (score - sign(score)) / sqrt(var) END AS z,
  365.25 * (coalesce(low, high) + coalesce(high, low)) / 2 AS slope_per_year
FROM varied"""


TREND = "n:i n_days:i s:i tau:d z:d slope_per_year:d"
_SERIES_KEYS = ["Park", "Site", "Characteristic"]


@query("trend_nonpar", f"Park Site Characteristic {TREND}", trend_sql(_SERIES_KEYS, False))
def trend_nonpar(v):
    return trend.trend_nonpar(v.meas)


@query("trend_nonpar_censored", f"Park Site Characteristic {TREND}", trend_sql(_SERIES_KEYS, True))
def trend_nonpar_censored(v):
    return trend.trend_nonpar(v.meas, censored=True)


@query("trend_nonpar_by_month", f"Park Characteristic month_num:i {TREND}",
       trend_sql(["Park", "Characteristic", "month_num"], False))
def trend_nonpar_by_month(v):
    return trend.trend_nonpar(v.meas, keys=["Park", "Characteristic"], by_month=True)


# Two-sided normal tail 1 - erf(x), x = |z| / sqrt(2): erf as exp(-x^2) 2/sqrt(pi) sum 2^k x^(2k+1) / (2k+1)!!.
# Beyond x = 6 the tail is below 1e-16.
_NORMAL_TAIL = """CASE WHEN z IS NULL THEN NULL WHEN abs(z) / sqrt(2) > 6 THEN 0 WHEN z = 0 THEN 1 ELSE 1 - 2 / sqrt(pi()) *
  list_sum(list_transform(range(0, 200), lambda k: exp((2 * k + 1) * ln(abs(z) / sqrt(2)) - z * z / 2 + 2 * k * ln(2)
    + lgamma(k + 1) - lgamma(2 * k + 2)))) END"""


@query("trend_nonpar_p_value", "Park Site Characteristic n:i z:d p_value:d",
       f"SELECT Park, Site, Characteristic, n, z, {_NORMAL_TAIL} AS p_value FROM ({trend_sql(_SERIES_KEYS, False)})")
def trend_nonpar_p_value(v):
    return trend.trend_nonpar(v.meas)
