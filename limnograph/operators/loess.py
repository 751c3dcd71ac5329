"""Local quadratic smoothing of monthly bands, in columns.

A series has at most twelve rows, one per month. Around every point of the grid its rows are weighted by distance, and
the quadratic that fits them best follows from weighted sums of powers of the distance (moments) and a 3 x 3 system.
The fit is a weighted sum of the values whose weights (the kernel) depend on the months alone and serve all columns.
The fit is made at every grid point itself, or at the vertices of a few cells and blended between them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnograph.operators.bands import SERIES

# Half-month grid of the field season, its padded ends, smoothed columns.
GRID = [5.0, 5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 8.5, 9.0, 9.5, 10.0]
GRID_PAD = {5.0: 4.9, 10.0: 10.1}
SMOOTHED = {
    "median_val": "smooth_median",
    "lower_100": "smooth_l100",
    "upper_100": "smooth_u100",
    "lower_95": "smooth_l95",
    "upper_95": "smooth_u95",
    "lower_50": "smooth_l50",
    "upper_50": "smooth_u50",
}
# Fixed values of the blended surface: share of a span that a cell may hold, and how far the outer vertices stand off.
CELL, MARGIN = 0.2, 0.005
#: Cells are halved so many times at most, which is enough for 64 points.
_HALVINGS = 6


def _kernels(spots: DataFrame, span: float) -> DataFrame:
    """``spots`` (_x: sorted months, _at, others) with the kernels ``_l`` of the fit and ``_k`` of its slope at ``_at``.

    Tricube weights reach as far as the nearest ``span`` of the months. Where one or two months have weight, the
    smallest solution is taken (as a pseudo-inverse would); where none has, both are NULL.
    """
    own, n = spots.columns, F.size("_x")
    near = F.greatest(F.lit(1), F.least(n, F.floor(n * F.lit(span) + F.lit(1e-5)))).cast("int")
    out = spots.withColumn("_u", F.transform("_x", lambda x: x - F.col("_at")))
    out = out.withColumn("_reach", F.element_at(F.array_sort(F.transform("_u", F.abs)), near))
    close = "greatest(1 - pow(abs(u) / _reach, 3), 0D)"
    out = out.withColumn("_w", F.expr(f"transform(_u, u -> IF(_reach > 0, pow({close}, 3), IF(u = 0, 1D, 0D)))"))
    start, step = (", ".join(f"'s{k}', {x}" for k, x in enumerate(xs)) for xs in (
        ["0D"] * 5, ["a.s0 + e.w", *[f"a.s{k} + e.w{' * e.u' * k}" for k in range(1, 5)]]))
    both = "zip_with(_w, _u, (w, u) -> named_struct('w', w, 'u', u))"
    sums = f"aggregate({both}, named_struct({start}), (a, e) -> named_struct({step}))"
    out = out.selectExpr("*", f"{sums} AS _s", "filter(_u, (u, i) -> _w[i] > 0) AS _used") \
        .selectExpr("*", *[f"_s.s{k} AS _s{k}" for k in range(5)])
    # Cofactors and determinant of the moment matrix; for two months the Gram matrix of their powers.
    out = out.selectExpr(
        "*", "_s2 * _s4 - _s3 * _s3 AS _c00", "_s2 * _s3 - _s1 * _s4 AS _c01", "_s1 * _s3 - _s2 * _s2 AS _c02",
        "_s0 * _s4 - _s2 * _s2 AS _c11", "_s1 * _s2 - _s0 * _s3 AS _c12").withColumn("_det", F.expr("_s0 * _c00 + _s1 * _c01 + _s2 * _c02"))
    gram = "(1 + {0} * {1} + {0} * {0} * {1} * {1})".format
    other = "(_used[0] + _used[1] - u)"
    pair = f"({gram('u', 'u')} * {gram(other, other)} - {gram('u', other)} * {gram('u', other)})"
    cases = {
        "_l": (f"1 / {gram('u', 'u')}", f"({gram(other, other)} - {gram('u', other)}) / {pair}", "w * (_c00 + _c01 * u + _c02 * u * u) / _det"),
        "_k": (f"u / {gram('u', 'u')}", f"({gram(other, other)} * u - {gram('u', other)} * {other}) / {pair}",
               "w * (_c01 + _c11 * u + _c12 * u * u) / _det"),
    }
    return out.selectExpr(*[f"`{c}`" for c in own], *[
        f"IF(size(_used) > 0, zip_with(_w, _u, (w, u) -> CASE WHEN w = 0 THEN 0D WHEN size(_used) = 1 THEN {one} "
        f"WHEN size(_used) = 2 THEN {two} ELSE {more} END), NULL) AS {name}" for name, (one, two, more) in cases.items()])


def _vertices(span: float, margin: float) -> Column:
    """Where the cells of a set meet: cells with too many months are halved between their middle ones."""
    most = f"greatest(1, floor(size(_x) * {span}D * {CELL}D + 1e-9D))"
    middle = "((c.a + c.b) div 2)"
    halves = f"array(named_struct('a', c.a, 'b', {middle}), named_struct('a', {middle} + 1, 'b', c.b))"
    cells = (f"aggregate(sequence(1, {_HALVINGS}), array(named_struct('a', 1L, 'b', CAST(size(_x) AS BIGINT))), "
             f"(cells, i) -> flatten(transform(cells, c -> IF(c.b - c.a + 1 > {most}, {halves}, array(c)))))")
    x = "element_at(_x, CAST({} AS INT))".format
    first, last = x(1), x(-1)
    off = f"({margin}D * greatest({last} - {first}, greatest(abs({first}), abs({last})) * 1e-3D + 1e-30D))"
    inner = f"transform(filter({cells}, c -> c.b < size(_x)), c -> ({x('c.b')} + {x('c.b + 1')}) / 2)"
    return F.expr(f"concat(array({first} - {off}), {inner}, array({last} + {off}))")


def _blended(kernels: DataFrame, grid: Column) -> DataFrame:
    """Kernels on the grid: cubics between neighbouring vertices that keep their values and slopes."""
    held = kernels.groupBy("_x").agg(F.array_sort(F.collect_list(F.struct("_at", "_l", "_k"))).alias("_v"))
    spots = held.withColumn("_at", F.explode(grid)) \
        .withColumn("_i", F.expr("greatest(1, least(size(_v) - 1, size(filter(_v, v -> v._at <= _at))))")) \
        .selectExpr("*", "element_at(_v, _i) AS _a", "element_at(_v, _i + 1) AS _b") \
        .selectExpr("*", "_b._at - _a._at AS _h", "(_at - _a._at) / (_b._at - _a._at) AS _p")
    part = "transform({}, y -> y * {})".format
    shares = [part("_a._l", "(1 - _p) * (1 - _p) * (1 + 2 * _p)"), part("_b._l", "_p * _p * (3 - 2 * _p)"),
              part("_a._k", "_h * _p * (1 - _p) * (1 - _p)"), part("_b._k", "-_h * _p * _p * (1 - _p)")]
    added = shares[0]
    for share in shares[1:]:
        added = f"zip_with({added}, {share}, (a, b) -> a + b)"
    return spots.withColumn("_l", F.expr(added))


def loess_bands(bands: DataFrame, *, columns: dict[str, str] | None = None, span: float = 1.0,
                grid: Sequence[float] = GRID, keys: Sequence[str] = SERIES,
                month: str = "mon_num", surface: str = "direct", margin: float = MARGIN) -> DataFrame:
    """Smoothed columns on the grid for every series, which has one row per month.

    ``surface="direct"`` fits at every grid point; ``"interpolate"`` fits at the vertices of halved cells and blends between
    them, as smoothers do that avoid a fit per point. Outside the months of a series nothing is smoothed, and a missing
    value makes the fits missing that it has weight in.
    """
    if surface not in ("direct", "interpolate"):
        raise ValueError(f"unknown surface {surface!r}")
    columns = columns or SMOOTHED
    point = F.struct(F.col(month).cast("double").alias("_x"), *[F.col(c).cast("double").alias(f"_y{i}") for i, c in enumerate(columns)])
    # Series have few bytes and much work: their partitions are not left to be merged by size.
    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = bands.repartition(parts, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_points")) \
        .withColumn("_x", F.col("_points._x"))
    spots = F.array(*[F.lit(float(g)) for g in grid])
    # Series with the same months share their kernels, which are made once.
    shapes = series.select("_x").distinct()
    if surface == "direct":
        kernels = _kernels(shapes.withColumn("_at", F.explode(spots)), span)
    else:
        kernels = _blended(_kernels(shapes.withColumn("_at", F.explode(_vertices(span, margin))), span), spots)
    kernels = series.join(kernels.select("_x", "_at", "_l"), "_x")
    inside = F.col("_at").between(F.element_at("_x", 1), F.element_at("_x", -1))
    weighted = kernels.withColumn("_l", F.when(inside, F.col("_l"))).select(
        *keys, "_at", F.explode(F.expr("transform(_points, (p, i) -> named_struct('l', _l[i], 'p', p))")).alias("_e"))
    weighted = weighted.select(*keys, "_at", F.col("_e.l").alias("_w"), *[F.col(f"_e.p._y{i}") for i in range(len(columns))])
    fits = [F.expr(f"IF(count_if(_w <> 0 AND _y{i} IS NULL) = 0, sum(_w * _y{i}), NULL)").alias(name)
            for i, name in enumerate(columns.values())]
    return weighted.groupBy(*keys, F.col("_at").alias("_spot")).agg(*fits).select(
        *keys, F.col("_spot").alias(month), *columns.values())


def with_grid_pad(smooth: DataFrame, month: str = "mon_num") -> DataFrame:
    """Axis position of a grid point: the ends are pushed out a little."""
    pad = F.col(month)
    for at, shown in GRID_PAD.items():
        pad = F.when(F.col(month) == at, F.lit(shown)).otherwise(pad)
    return smooth.withColumn("x_axis_pad", pad)


def bands_on_grid(bands: DataFrame, smooth: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Bands and smoothed grid side by side; joined on whole numbers of half months."""
    left = smooth.withColumn("half_month", F.round(F.col("mon_num") * 2).cast("int")).drop("mon_num")
    right = bands.withColumn("half_month", (F.col("mon_num") * 2).cast("int")).drop("mon_num")
    joined = left.join(right, [*keys, "half_month"], "full_outer")
    return joined.withColumn("mon_num", F.col("half_month") / 2)
