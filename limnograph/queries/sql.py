"""The monitoring model and the common steps of the reference SQL."""

from __future__ import annotations

from limnograph.sources.monitoring_view import CHARACTERISTICS, PARK_CODES
from limnograph.sources.tables import (
    ECOREGION,
    ECOREGION_COLUMNS,
    LOWER_RULES,
    PARK_STORE_CODE,
    STANDARD_COLUMNS,
    STATE_STANDARDS,
    UPPER_RULES,
)
from limnograph.functions.codes import PARK_STATE


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return repr(value)


def values(rows, columns) -> str:
    """A literal table usable in FROM."""
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({', '.join(columns)})"


def _case(operand: str, pairs, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {literal(k)} THEN {literal(v)}" for k, v in pairs)
    return f"CASE {operand} {whens} ELSE {default} END"


def _by_name(field: int) -> str:
    return _case("CharName", [(row[1], row[field]) for row in CHARACTERISTICS])


_CHAR = _case("l_linenumber", [(r[0], r[1]) for r in CHARACTERISTICS[:-1]], literal(CHARACTERISTICS[-1][1]))

VIEWS = f"""
located AS (
  SELECT s_suppkey, s_name, s_acctbal, n_name, n_nationkey, r_name,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Lake' ELSE 'Stream' END AS SiteType
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
meas AS (
  SELECT r_name AS Park, s_name AS Site, SiteType, {_CHAR} AS Characteristic,
    CASE WHEN l_linenumber <= 3 THEN 'physical' ELSE 'nutrients' END AS Category,
    CAST(l_shipdate AS DATE) AS Date,
    CASE WHEN SiteType = 'Lake' THEN 'epilimnion' ELSE 'stream' END AS SampleDepth,
    l_quantity AS Value, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS TextValue,
    l_discount < 0.01 AS Censored,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS ValueCen
  FROM lineitem JOIN located ON l_suppkey = s_suppkey),
parks AS (
  SELECT r_name AS ParkCode, r_name AS ParkShortName, r_name || ' PARK' AS ParkLongName FROM region),
sites AS (
  SELECT r_name AS ParkCode, r_name AS ParkShortName, r_name || ' PARK' AS ParkLongName,
    'network' AS Network, s_name AS SiteCode, n_name || ' site ' || s_suppkey AS SiteName,
    40.0::DOUBLE + n_nationkey / 8 AS lat, -70.0::DOUBLE - (s_suppkey % 64) / 16 AS long, SiteType AS type
  FROM located),
chars AS (
  SELECT DISTINCT Park AS ParkCode, Site AS SiteCode, Characteristic AS CharName,
    {_by_name(2)} AS DisplayName, {_by_name(2)} AS CategoryDisplay, Category, {_by_name(3)} AS Units,
    CAST({_by_name(4)} AS DOUBLE) AS LowerPoint, CAST({_by_name(5)} AS DOUBLE) AS UpperPoint
  FROM (SELECT *, Characteristic AS CharName FROM meas)),
points AS (
  SELECT ParkCode AS Park, SiteCode AS Site, CharName AS Characteristic, CategoryDisplay AS param_name,
    Units AS unit, LowerPoint, UpperPoint FROM chars),
descriptions AS (
  SELECT r_name AS ParkCode, n_name || ' site ' || s_suppkey AS SiteName, s_name AS SiteCode,
    'Outlet, "near" ' || n_name || ', area ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR)
      || ' km<sup>2</sup>' AS Description FROM located
  UNION ALL
  SELECT r_name, n_name || ' site ' || s_suppkey || ' (old)', s_name, 'Discontinued, replaced'
  FROM located WHERE s_suppkey % 10 = 0),
boxes AS (
  SELECT ParkCode, max(lat) AS LatS, max(long) AS LongE, min(lat) AS LatN, min(long) AS LongW,
    CASE WHEN ParkCode <> 'AFRICA' THEN 10 + length(ParkCode) END AS Zoom,
    CASE WHEN ParkCode <> 'AFRICA' THEN 10 END AS minZoom
  FROM sites GROUP BY ParkCode),
sample AS (
  SELECT *, strftime(Date, '%b') AS month, month(Date) AS month_num, year(Date) AS year FROM meas),
hist AS (SELECT * FROM sample WHERE year BETWEEN 1995 AND 2000),
now AS (SELECT * FROM sample WHERE year = 2001)
"""

SEASON = "month_num BETWEEN 5 AND 10"

PARK_CODE = _case("Park", PARK_CODES.items())
STATE = _case(PARK_CODE, PARK_STATE.items(), "'other'")

RULES = values(
    [("Lower", *r) for r in LOWER_RULES] + [("Upper", *r) for r in UPPER_RULES],
    ["side", "park", "depth", "characteristic", "point"],
)
STANDARDS = values(STATE_STANDARDS, STANDARD_COLUMNS)
ECOREGIONS = values(ECOREGION, ECOREGION_COLUMNS)
STORE_CODES = values(PARK_STORE_CODE.items(), ["park", "code"])


def bands(source: str = "hist", where: str = SEASON, keep: str = "num_samps >= 4 AND lower_50 IS NOT NULL") -> str:
    """Monthly bands as a subquery."""
    return f"""(
  SELECT * FROM (
    SELECT Park, Site, Characteristic, month, month_num, count(*) AS num_samps,
      quantile_cont(ValueCen, 0.5) AS median_val, min(ValueCen) AS min_val, max(ValueCen) AS max_val,
      min(ValueCen) AS lower_100, max(ValueCen) AS upper_100,
      quantile_cont(ValueCen, 0.025) AS lower_95, quantile_cont(ValueCen, 0.975) AS upper_95,
      quantile_cont(ValueCen, 0.25) AS lower_50, quantile_cont(ValueCen, 0.75) AS upper_50,
      max(CASE WHEN ValueCen = least_val THEN year END) AS year_min,
      max(CASE WHEN ValueCen = greatest_val THEN year END) AS year_max
    FROM (
      SELECT *, min(ValueCen) OVER w AS least_val, max(ValueCen) OVER w AS greatest_val
      FROM {source} WHERE {where}
      WINDOW w AS (PARTITION BY Park, Site, Characteristic, month_num))
    GROUP BY Park, Site, Characteristic, month, month_num)
  WHERE {keep})"""


SMOOTHED = {"median_val": "smooth_median", "lower_100": "smooth_l100", "upper_100": "smooth_u100", "lower_95": "smooth_l95",
            "upper_95": "smooth_u95", "lower_50": "smooth_l50", "upper_50": "smooth_u50"}
_S = "Park, Site, Characteristic"
_GRID = "SELECT unnest(range(10, 21)) / 2.0::DOUBLE AS spot"


def _kernels(points: str, spots: str, span: float) -> str:
    """WITH parts: ``kern`` has the weight of every point's value in the fit (l) and in its slope (k) at every spot."""
    gram = "(1 + {0} * {1} + {0} * {0} * {1} * {1})".format
    return f"""pt AS (SELECT {_S}, month_num::DOUBLE AS x, count(*) OVER (PARTITION BY {_S}) AS n, * EXCLUDE (Park, Site, Characteristic, month_num)
      FROM {points} AS q),
    gap AS (SELECT pt.*, spot, x - spot AS u, row_number() OVER (PARTITION BY {_S}, spot ORDER BY abs(x - spot)) AS near FROM pt JOIN {spots} USING ({_S})),
    reach AS (SELECT *, max(CASE WHEN near <= greatest(1, least(n, floor(n * {span} + 1e-5))) THEN abs(u) END) OVER (PARTITION BY {_S}, spot) AS h FROM gap),
    weighted AS (SELECT *, CASE WHEN h > 0 THEN greatest(1 - (abs(u) / h) ** 3, 0) ** 3 WHEN u = 0 THEN 1 ELSE 0 END AS w FROM reach),
    moments AS (SELECT *, {", ".join(f"sum(w * u ** {k}) OVER s AS s{k}" for k in range(5))}, sum((w > 0)::INT) OVER s AS m,
      min(u) FILTER (WHERE w > 0) OVER s AS lo, max(u) FILTER (WHERE w > 0) OVER s AS hi FROM weighted WINDOW s AS (PARTITION BY {_S}, spot)),
    solved AS (SELECT *, s2 * s4 - s3 * s3 AS c0, s2 * s3 - s1 * s4 AS c1, s1 * s3 - s2 * s2 AS c2, s0 * s4 - s2 * s2 AS e1,
      s1 * s2 - s0 * s3 AS e2, lo + hi - u AS o FROM moments),
    pairs AS (SELECT *, s0 * c0 + s1 * c1 + s2 * c2 AS det, {gram('u', 'u')} AS gu, {gram('o', 'o')} AS go, {gram('u', 'o')} AS guo FROM solved),
    kern AS (SELECT *, CASE WHEN m = 0 THEN NULL WHEN w = 0 THEN 0 WHEN m = 1 THEN 1 / gu WHEN m = 2 THEN (go - guo) / (gu * go - guo * guo)
        ELSE w * (c0 + c1 * u + c2 * u * u) / det END AS l,
      CASE WHEN m = 0 THEN NULL WHEN w = 0 THEN 0 WHEN m = 1 THEN u / gu WHEN m = 2 THEN (go * u - guo * o) / (gu * go - guo * guo)
        ELSE w * (c1 + e1 * u + e2 * u * u) / det END AS k FROM pairs)"""


def smooth(points: str, span: float, columns: dict[str, str] | None = None) -> str:
    """Local quadratics of the monthly ``points`` on the half-month grid, as a subquery."""
    columns = columns or SMOOTHED
    spots = f"(SELECT {_S}, spot FROM (SELECT DISTINCT {_S} FROM pt) CROSS JOIN ({_GRID}))"
    fits = ", ".join(f"CASE WHEN spot BETWEEN min(x) AND max(x) THEN sum(l * {c}) END AS {name}" for c, name in columns.items())
    return f"(WITH {_kernels(points, spots, span)} SELECT {_S}, spot AS mon_num, {fits} FROM kern GROUP BY {_S}, spot)"


def smooth_surface(points: str, span: float, margin: float, columns: dict[str, str] | None = None) -> str:
    """The same, fitted at the vertices of halved cells and blended by cubics between them."""
    columns = columns or SMOOTHED
    spread = f"{margin} * greatest(max(x) - min(x), greatest(abs(min(x)), abs(max(x))) * 1e-3 + 1e-30)"
    spots = f"""(WITH RECURSIVE o AS (SELECT {_S}, x, row_number() OVER (PARTITION BY {_S} ORDER BY x) AS i FROM pt),
      e AS (SELECT {_S}, count(*) AS n, min(x) - {spread} AS lo, max(x) + {spread} AS hi FROM pt GROUP BY {_S}),
      cell AS (SELECT {_S}, n, 1::BIGINT AS a, n::BIGINT AS b FROM e UNION ALL
        SELECT {_S}, n, CASE WHEN side = 0 THEN a ELSE (a + b) // 2 + 1 END, CASE WHEN side = 0 THEN (a + b) // 2 ELSE b END
        FROM cell CROSS JOIN (VALUES (0), (1)) AS t(side) WHERE b - a + 1 > greatest(1, floor(n * {span} * 0.2 + 1e-9)))
      SELECT {_S}, lo AS spot FROM e UNION ALL SELECT {_S}, hi FROM e UNION ALL
      SELECT {_S}, (p.x + q.x) / 2 FROM (SELECT DISTINCT {_S}, b FROM cell WHERE b < n) JOIN o AS p USING ({_S}) JOIN o AS q USING ({_S})
        WHERE p.i = b AND q.i = b + 1)"""
    fits = ", ".join(f"sum(l * {c}) AS f_{c}, sum(k * {c}) AS g_{c}" for c in columns)
    cubic = ", ".join(
        f"""CASE WHEN z BETWEEN first_x AND last_x THEN (1 - p) ** 2 * (1 + 2 * p) * f_{c} + p ** 2 * (3 - 2 * p) * next_f_{c}
        + h * (p * (1 - p) ** 2 * g_{c} - p ** 2 * (1 - p) * next_g_{c}) END AS {name}""" for c, name in columns.items())
    following = ", ".join(f"lead({x}_{c}) OVER v AS next_{x}_{c}" for c in columns for x in "fg")
    return f"""(WITH {_kernels(points, spots, span)},
      fit AS (SELECT {_S}, spot, min(x) AS first_x, max(x) AS last_x, {fits} FROM kern GROUP BY {_S}, spot),
      cells AS (SELECT *, lead(spot) OVER v AS till, row_number() OVER v AS place, {following} FROM fit WINDOW v AS (PARTITION BY {_S} ORDER BY spot)),
      grid AS (SELECT spot AS z FROM ({_GRID})),
      put AS (SELECT *, till - spot AS h, (z - spot) / (till - spot) AS p, row_number() OVER (PARTITION BY {_S}, z ORDER BY CASE WHEN spot <= z THEN -place ELSE 1000 + place END) AS pick
        FROM cells CROSS JOIN grid WHERE till IS NOT NULL)
      SELECT {_S}, z AS mon_num, {cubic} FROM put WHERE pick = 1)"""


def if_else(condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN ({condition}) IS NULL THEN NULL WHEN {condition} THEN {yes} ELSE {no} END"


def beyond(value: str, poor: str, good: str, when: str = "TRUE") -> str:
    above = f"UpperPoint IS NOT NULL AND {when} AND {value} > UpperPoint"
    below = f"LowerPoint IS NOT NULL AND {when} AND {value} < LowerPoint"
    return if_else(above, f"'{poor}'", if_else(below, f"'{poor}'", f"'{good}'"))


AXIS_LABEL = "CASE WHEN Characteristic <> 'pH' THEN param_name || ' (' || unit || ')' ELSE param_name END"

WATERBANDS = f"""
SELECT *, {beyond('ValueCen_curr', 'orange', 'black')} AS pcolor, {AXIS_LABEL} AS yname FROM (
  SELECT coalesce(b.Park, c.Park) AS Park, coalesce(b.Site, c.Site) AS Site,
    coalesce(b.Characteristic, c.Characteristic) AS Characteristic,
    coalesce(b.month, c.month) AS month, coalesce(b.month_num, c.month_num) AS month_num,
    b.* EXCLUDE (Park, Site, Characteristic, month, month_num),
    c.Date, c.year AS year_curr, c.ValueCen AS ValueCen_curr
  FROM {bands()} AS b
  FULL OUTER JOIN (SELECT * FROM now WHERE {SEASON}) AS c
    ON b.Park = c.Park AND b.Site = c.Site AND b.Characteristic = c.Characteristic
      AND b.month_num = c.month_num) AS j
LEFT JOIN points USING (Park, Site, Characteristic)
"""
WATERBANDS_COLUMNS = (
    "Park Site Characteristic month month_num:i num_samps:i median_val:d min_val:d max_val:d lower_100:d "
    "upper_100:d lower_95:d upper_95:d lower_50:d upper_50:d year_min:i year_max:i Date:t year_curr:i "
    "ValueCen_curr:d param_name unit LowerPoint:d UpperPoint:d pcolor yname"
)

TARGET_MONTH = "CASE WHEN SiteType = 'Lake' THEN month_num IN (6, 8) ELSE month_num IN (5, 8) END"
TARGET_NUTRIENT = (
    "((SiteType = 'Lake' AND Characteristic IN ('TP_ugL', 'TN_mgL', 'ChlA_ugL')) OR "
    "(SiteType = 'Stream' AND Characteristic IN ('TP_ugL', 'TN_mgL', 'ANC_ueqL')))"
)


def quantile(p: float, method: str, value: str = "ValueCen") -> str:
    """Interpolated quantile as an aggregate over rows with rank ``i`` of ``n``."""
    if method == "type7":
        return f"quantile_cont({value}, {p})"
    position = f"least(greatest(n * {p} + 0.5, 1), n)"
    return f"sum(greatest(0, 1 - abs(i - {position})) * {value})"


def fences(source: str, keys: str, method: str) -> str:
    """Quartiles and fences per group as a subquery."""
    return f"""(
  SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM (
    SELECT {keys}, max(n) AS n, {quantile(0.25, method)} AS q1, {quantile(0.5, method)} AS median,
      {quantile(0.75, method)} AS q3
    FROM (
      SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ValueCen) AS i,
        count(*) OVER (PARTITION BY {keys}) AS n
      FROM {source} AS s WHERE ValueCen IS NOT NULL)
    GROUP BY {keys}))"""


def box_stats(source: str, keys: str, method: str) -> str:
    return f"""(
  SELECT f.*, w.lower_whisker, w.upper_whisker, w.n_outliers FROM {fences(source, keys, method)} AS f
  JOIN (
    SELECT {keys}, min(CASE WHEN inside THEN ValueCen END) AS lower_whisker,
      max(CASE WHEN inside THEN ValueCen END) AS upper_whisker,
      sum(CASE WHEN inside THEN 0 ELSE 1 END) AS n_outliers
    FROM (
      SELECT s.*, ValueCen BETWEEN lower_fence AND upper_fence AS inside
      FROM {source} AS s JOIN {fences(source, keys, method)} AS g USING ({keys})
      WHERE ValueCen IS NOT NULL)
    GROUP BY {keys}) AS w USING ({keys}))"""


BOX_SOURCE = (
    f"(SELECT * FROM sample WHERE Category = 'nutrients' AND year BETWEEN 1995 AND 2001 "
    f"AND {TARGET_MONTH} AND {TARGET_NUTRIENT})"
)
BOX_HISTORY = f"(SELECT * FROM {BOX_SOURCE} AS b WHERE year <= 2000)"
MONTH_KEYS = "Park, Site, Characteristic, month_num"

BOXPLOT = f"""
WITH points_now AS (
  SELECT s.*, LowerPoint, UpperPoint FROM {BOX_SOURCE} AS s LEFT JOIN points USING (Park, Site, Characteristic)
  WHERE year = 2001),
domain AS (
  SELECT Park, Site, Characteristic, min(month_num) AS first_month, max(month_num) AS last_month
  FROM {BOX_SOURCE} AS d GROUP BY Park, Site, Characteristic)
SELECT Park, Site, Characteristic, strftime(make_date(2000, month_num, 1), '%b') AS month, * EXCLUDE (Park, Site, Characteristic)
FROM (
  SELECT Park, Site, Characteristic, month_num, 'box' AS layer, n, q1, median, q3, lower_fence,
    upper_fence, lower_whisker, upper_whisker, n_outliers, CAST(NULL AS DATE) AS Date,
    CAST(NULL AS BIGINT) AS year, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS pcolor,
    CAST(NULL AS DOUBLE) AS UpperPoint, CAST(NULL AS DOUBLE) AS line_start, CAST(NULL AS DOUBLE) AS line_end
  FROM {box_stats(BOX_HISTORY, MONTH_KEYS, 'hazen')} AS b
  UNION ALL
  SELECT Park, Site, Characteristic, month_num, 'outlier', n, q1, median, q3, lower_fence, upper_fence, NULL,
    NULL, NULL, Date, year, ValueCen, NULL, NULL, NULL, NULL
  FROM {BOX_HISTORY} AS h JOIN {fences(BOX_HISTORY, MONTH_KEYS, 'hazen')} AS f USING ({MONTH_KEYS})
  WHERE ValueCen < lower_fence OR ValueCen > upper_fence
  UNION ALL
  SELECT Park, Site, Characteristic, month_num, 'current', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL, Date, year, ValueCen, {beyond('ValueCen', 'Poor WQ value', 'Current value', 'year = 2001')},
    NULL, NULL, NULL
  FROM points_now
  UNION ALL
  SELECT Park, Site, Characteristic, NULL, 'threshold', NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, NULL, NULL, NULL, NULL, NULL, UpperPoint,
    CASE first_month WHEN 6 THEN first_month - 1 WHEN 5 THEN first_month - 1.5 END,
    CASE first_month WHEN 6 THEN last_month + 1 WHEN 5 THEN last_month + 1.5 END
  FROM (SELECT DISTINCT Park, Site, Characteristic, UpperPoint FROM points_now WHERE UpperPoint IS NOT NULL)
  JOIN domain USING (Park, Site, Characteristic)) AS layers
"""
BOXPLOT_COLUMNS = (
    "Park Site Characteristic month month_num:i layer n:i q1:d median:d q3:d lower_fence:d upper_fence:d "
    "lower_whisker:d upper_whisker:d n_outliers:i Date:t year:i value:d pcolor UpperPoint:d line_start:d "
    "line_end:d"
)

COMPARISON_COLUMNS = (
    "Park Site Characteristic Date:t month month_num:i year:i ValueCen:d SiteName SiteType LowerPoint:d "
    "UpperPoint:d param_name unit yname tip"
)


def number_text(value: str) -> str:
    return f"coalesce(regexp_replace(CAST({value} AS VARCHAR), '\\.0$', ''), 'NA')"


def round1_text(value: str) -> str:
    return number_text(f"round_even(round({value}, 6), 1)")


def text(value: str) -> str:
    return f"coalesce(CAST({value} AS VARCHAR), 'NA')"


POINT_TIP = (
    f"{text('SiteName')} || '<br>' || {text('month')} || ' ' || {number_text('year')} || '<br>' || "
    f"{text('param_name')} || ': ' || {round1_text('ValueCen')} || ' ' || {text('unit')}"
)


def comparison(where: str = SEASON, points: str = "per_site") -> str:
    """Current samples with site names, points and labels."""
    if points == "per_site":
        lower, upper = "p.LowerPoint", "p.UpperPoint"
    elif points == "first":
        lower = upper = None
    else:
        lower = upper = "CAST(NULL AS DOUBLE)"
    first = """
      LEFT JOIN (SELECT Park, Characteristic, LowerPoint, UpperPoint FROM (
        SELECT *, row_number() OVER (PARTITION BY Park, Characteristic ORDER BY Site) AS i FROM points)
        WHERE i = 1) AS f ON f.Park = n.Park AND f.Characteristic = n.Characteristic""" if lower is None else ""
    lower, upper = (lower, upper) if lower else ("f.LowerPoint", "f.UpperPoint")
    return f"""
SELECT *, {AXIS_LABEL} AS yname, {POINT_TIP} AS tip FROM (
  SELECT n.Park, n.Site, n.Characteristic, n.Date, n.month, n.month_num, n.year, n.ValueCen,
    s.SiteName, s.type AS SiteType, {lower} AS LowerPoint, {upper} AS UpperPoint, p.param_name, p.unit
  FROM (SELECT * FROM now WHERE {where}) AS n
  JOIN sites AS s ON s.ParkCode = n.Park AND s.SiteCode = n.Site
  LEFT JOIN points AS p ON p.Park = n.Park AND p.Site = n.Site AND p.Characteristic = n.Characteristic
  {first})
"""
