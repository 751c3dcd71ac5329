"""Non-parametric trends: Mann-Kendall score and Theil-Sen slope, with left-censored values.

A pair of samples of different days scores +1 when the later one is larger and -1 when it is
smaller. A left-censored value is only known to lie at or below its limit, so it is smaller than
any measured value at or above the limit; every other pair with it is ambiguous and scores 0. The
slope is the one whose removal brings the score to zero: without censoring, the median of the
pairwise slopes.

Equal samples of a day are one row with their number. Series of up to ``pair_rows`` such rows are scored in Arrow batches, in O(n log n) with a bounded list of pairs. Longer ones
are never brought together: they are cut into as many blocks of neighbouring values as they need, each block is counted
by its own task, and halves of ever larger stretches of blocks are compared through their counts per day, of which a
calendar bounds the number. The slope is narrowed down by counting, and then looked up among the pairs that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnograph.functions.tails import normal_p_value
from limnograph.operators.bands import SERIES
from limnograph.operators.joins import join_on
from limnograph.operators.hot import hot_groups
from limnograph.session import checkpointed

PAIR_ROWS = 500_000
LISTED_PAIRS = 1_000_000
BLOCK_ROWS = 50_000
# Fixed value: days per year, to turn a slope per day into one per year.
DAYS_PER_YEAR = 365.25
_CANDIDATES = 15
_DRAWN, _FEW_DRAWN = 200_000, 64
_ROUNDS = 12
_TIES = ["n", "n_days", "v2", "v3", "v5", "d2", "d3", "d5"]
_SCORED = [T.StructField("s", T.LongType())] + [
    T.StructField(c, T.DoubleType()) for c in ["slope", *_TIES]
]


def _ranked(z: np.ndarray, measured: np.ndarray) -> np.ndarray:
    """Ranks by value; a censored sample comes before a measured one of the same value."""
    order = np.lexsort((measured, z))
    changes = (np.diff(z[order]) != 0) | (np.diff(measured[order].astype(int)) != 0)
    rank = np.empty(len(z), dtype=np.int64)
    rank[order] = np.cumsum(np.r_[True, changes])
    return rank


def _turned(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places whose order by ``before`` turns round by ``after``, found by halving the places again and again."""
    place = np.lexsort((after, before))
    rank, n = after[place], len(place)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for bit in range(max(n - 1, 0).bit_length()):
        at = np.arange(n)
        order = np.lexsort((rank, at >> (bit + 1)))
        group, late, r = at[order] >> (bit + 1), ((at[order] >> bit) & 1).astype(bool), rank[order]
        high, low = order[~late], order[late]
        # Earlier places of the same group with a larger rank end where the next group starts.
        span = int(rank.max()) + 1
        first = np.searchsorted(group[~late] * span + r[~late], group[late] * span + r[late], side="right")
        stop = np.searchsorted(group[~late], group[late], side="right")
        count = np.maximum(stop - first, 0)
        steps = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        left.append(place[high[np.repeat(first, count) + steps]])
        right.append(place[np.repeat(low, count)])
    return np.concatenate(left), np.concatenate(right)


def _side_by_side(before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of neighbours by ``before`` whose order turns round by ``after``; there are some if any pair does so."""
    place = np.lexsort((after, before))
    turned = np.flatnonzero(after[place][1:] < after[place][:-1])
    return place[turned], place[turned + 1]


def _pair_slopes(i: np.ndarray, j: np.ndarray, t: np.ndarray, y: np.ndarray, measured: np.ndarray,
                 weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Slopes of the pairs that count, sorted; what the score loses as each is removed; the score with all in place."""
    used = (t[i] != t[j]) & (measured[i] | measured[j])
    i, j = i[used], j[used]
    i, j = np.where(t[i] < t[j], i, j), np.where(t[i] < t[j], j, i)
    slopes, both = (y[j] - y[i]) / (t[j] - t[i]), measured[i] & measured[j]
    w = np.ones(len(i), np.int64) if weight is None else weight[i] * weight[j]
    sign = np.where(both, np.sign(slopes), np.where(measured[j], slopes >= 0, -1 * (slopes <= 0))).astype(np.int64)
    order = np.argsort(slopes, kind="stable")
    return slopes[order], (w * (1 + both))[order], int((w * sign).sum())


def _drawn_slopes(t: np.ndarray, y: np.ndarray, measured: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sorted slopes of some pairs, drawn with a fixed seed. They say where to count and bear on cost alone."""
    reach = np.cumsum(weight)
    places = np.random.default_rng(0).integers(0, reach[-1], (2, _DRAWN))
    i, j = np.searchsorted(reach, places, side="right")
    return _pair_slopes(i, j, t, y, measured)[0]


def _score_pairs(t: np.ndarray, y: np.ndarray, measured: np.ndarray, listed: int = LISTED_PAIRS,
                 weight: np.ndarray | None = None) -> tuple[int, float | None]:
    """Score and slope of a series that fits into a task; ``weight`` says how many samples each element stands for.

    The score falls as a larger slope is removed. The pair slope at which it stops being positive and the one at
    which it becomes negative are bracketed by counting until a bracket holds at most ``listed`` pairs (or only
    equal slopes, up to rounding); these pairs alone are listed. The slope is the mean of the two. Candidates stand on
    either side of the place among drawn slopes that the counts of the bracket point at, else half way.
    """
    one = np.ones(len(t), np.int64)
    weight = one if weight is None else weight
    if len(t) * (len(t) - 1) // 2 <= listed:
        i, j = np.triu_indices(len(t), 1)
        slopes, drop, s = _pair_slopes(i, j, t, y, measured, weight)
        later = measured[np.where(t[i] < t[j], j, i)] & (t[i] != t[j])
        left = int((later * weight[i] * weight[j]).sum()) - np.cumsum(drop)
        places = [np.searchsorted(-left, 0, side) for side in (("left", "right") if later.any() else ("right",))]
        ends = [slopes[k] for k in places if k < len(slopes)]
        return s, (float(np.mean(ends)) if ends else None)
    t0, ranks, scores, counts = t - t.min(), {}, {}, {}

    def score(beta: float) -> int:
        if beta not in scores:
            ranks[beta] = _ranked(y - beta * t0, measured)
            scores[beta] = pair_score(t, ranks[beta], measured, weight)
        return scores[beta]

    def held(low: float, high: float) -> int:
        """No fewer than the pairs of a bracket, and at most twice as many where they are more than ``listed``."""
        found = score(low) - score(high)
        if found <= listed or weight is one:
            return found
        for beta in (low, high):
            if beta not in counts:
                counts[beta] = pair_score(t, ranks[beta], measured, one)
        return counts[low] - counts[high]

    # Bounds that no pair slope reaches, and odd numbers so that no half way point is a slope that is likely.
    reach = float(np.ptp(y)) + 1.0
    bounds = -1.0377 * reach, 1.1931 * reach
    finest = 16 * np.finfo(float).eps * max(float(np.abs(y).max()), 1e-290)
    drawn = _drawn_slopes(t, y, measured, weight)

    def around(low: float, high: float) -> list[float]:
        inside = drawn[np.searchsorted(drawn, low, side="right"):np.searchsorted(drawn, high, side="left")]
        if len(inside) < _FEW_DRAWN:
            return []
        at = int(len(inside) * (score(low) / (score(low) - score(high))))
        off = 2 * math.isqrt(len(inside))
        return [inside[max(at - off, 0)] - finest / 2, inside[min(at + off, len(inside) - 1)] + finest / 2]

    ends = []
    for above in (lambda s: s > 0, lambda s: s >= 0):
        low, high = bounds
        if not above(score(low)) or above(score(high)):
            continue  # no pair's slope is this end
        for b in sorted(scores):
            low, high = (b, high) if low < b < high and above(scores[b]) else (low, high)
        high = min(b for b in scores if b > low)
        while held(low, high) > listed and high - low > finest:
            before = low, high
            for b in around(low, high):
                if low < b < high:
                    low, high = (b, high) if above(score(b)) else (low, b)
            if (low, high) == before:
                middle = low + (high - low) * 0.5
                low, high = (middle, high) if above(score(middle)) else (low, middle)
        equal = held(low, high) > listed
        # Where all slopes are equal, up to rounding, the pairs that stand side by side have them all.
        i, j = (_side_by_side if equal else _turned)(ranks[low], ranks[high])
        slopes, drop, _ = _pair_slopes(i, j, t, y, measured, weight)
        left = score(low) - np.cumsum(drop)
        if not len(slopes):
            ends.append(low + (high - low) * 0.5)
        else:
            ends.append(float(slopes[len(slopes) // 2 if equal else np.argmin(above(left))]))
    return pair_score(t, _ranked(y, measured), measured, weight), (float(np.mean(ends)) if ends else None)


def _ties(values: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    c = np.bincount(np.unique(values, return_inverse=True)[1], weight)
    return (c * (c - 1)).sum(), (c * (c - 1) * (c - 2)).sum(), (c * (c - 1) * (2 * c + 5)).sum()


def _weighted(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equal samples of a day as one row and their number ``w``."""
    return samples.groupBy(*keys, "t", "y", "u").agg(F.count(F.lit(1)).alias("w"))


def _score_series(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score, slope and tie sums of short series, one Arrow table each."""
    schema = T.StructType([weighted.schema[k] for k in keys] + _SCORED)

    def scored(key: tuple, series: pa.Table) -> pa.Table:
        t, y, u, w = (series.column(c).to_numpy() for c in ("t", "y", "u", "w"))
        s, slope = _score_pairs(t.astype(float), y, u, weight=w)
        row = (s, slope, float(w.sum()), float(len(np.unique(t))), *_ties(y, w), *_ties(t, w))
        columns = {k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key)}
        columns["s"] = pa.array([s], pa.int64())
        for name, value in zip(["slope", *_TIES], row[1:]):
            columns[name] = pa.array([value], pa.float64())
        return pa.table(columns)

    return weighted.groupBy(*keys).applyInArrow(scored, schema)


def _samples(meas: DataFrame, keys: Sequence[str], value: str, censored: bool) -> DataFrame:
    """Day, value and whether it was measured (``censored=False`` leaves censored samples out)."""
    flag = F.coalesce(F.col("Censored"), F.lit(False))
    rows = meas.where(F.col(value).isNotNull())
    if not censored:
        rows = rows.where(~flag)
    return rows.select(*keys, F.unix_date("Date").alias("t"), F.col(value).alias("y"),
                       (~flag).alias("u"))


def _tie_sums(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sample and day count, and the sums over ties of value (v) and day (d) for the variance."""
    out = None
    for column, tag in (("y", "v"), ("t", "d")):
        ties = samples.groupBy(*keys, column).agg(F.count(F.lit(1)).cast("double").alias("c"))
        sums = ties.groupBy(*keys).agg(
            F.expr("sum(c) AS n" if tag == "v" else "CAST(count(c) AS DOUBLE) AS n_days"),
            F.expr(f"sum(c * (c - 1)) AS {tag}2"),
            F.expr(f"sum(c * (c - 1) * (c - 2)) AS {tag}3"),
            F.expr(f"sum(c * (c - 1) * (2 * c + 5)) AS {tag}5"),
        )
        out = sums if out is None else join_on(out, sums, keys)
    return out


def trend_nonpar(meas: DataFrame, *, keys: Sequence[str] = SERIES, value: str = "ValueCen",
                 censored: bool = False, by_month: bool = False, pair_rows: int = PAIR_ROWS,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Trend of every series: n, score, tau-b, z, p, and slope per year."""
    keys = list(keys)
    if by_month:
        meas = meas.withColumn("month_num", F.month("Date"))
        keys.append("month_num")
    samples = _samples(meas, keys, value, censored)
    hot = hot_groups(samples, keys, pair_rows)
    if hot:  # a series is long by its different samples, as these are what a task holds
        hot = hot_groups(_weighted(hot.rows(samples, keys), keys), keys, pair_rows)
    scored = _score_series(_weighted(hot.calm(samples, keys), keys), keys)
    if hot:
        long = hot.rows(samples, keys)
        scores = _long_series(long, keys, block_rows, hot.few)
        scored = scored.unionByName(join_on(_tie_sums(long, keys), scores, keys, "left"))
    return _with_significance(scored, keys)


def _with_significance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Normal approximation with the variance corrected for ties in value and in day."""
    varied = df.selectExpr(
        *keys, "CAST(n AS BIGINT) AS n", "CAST(n_days AS BIGINT) AS n_days", "s", "slope",
        """(n * (n - 1) * (2 * n + 5) - v5 - d5) / 18
           + IF(n > 1, v2 * d2 / (2 * n * (n - 1)), 0)
           + IF(n > 2, v3 * d3 / (9 * n * (n - 1) * (n - 2)), 0) AS variance""",
        "sqrt((n * (n - 1) - v2) * (n * (n - 1) - d2)) / 2 AS untied",
    )
    tested = varied.selectExpr(
        *keys, "n", "n_days", "s", "IF(untied > 0, s / untied, NULL) AS tau",
        "IF(variance > 0, (s - signum(s)) / sqrt(variance), NULL) AS z",
        f"slope * {DAYS_PER_YEAR}D AS slope_per_year",
    )
    return tested.withColumn("p_value", normal_p_value(F.col("z")))


def pair_score(t: np.ndarray, rank: np.ndarray, measured: np.ndarray, weight: np.ndarray) -> int:
    """Weighted score of the samples of one block, without listing pairs.

    Any two different days part ways at one bit of their position; for that bit the samples are
    sorted by value within the bits above, and running sums give the smaller ones on either side.
    """
    day = np.unique(t, return_inverse=True)[1]
    by_rank = np.argsort(rank, kind="stable")
    day, rank, measured = day[by_rank], rank[by_rank], measured[by_rank]
    weight = weight[by_rank].astype(np.int64)
    total = 0
    for bit in range(int(day.max()).bit_length() if len(day) else 0):
        group = day >> (bit + 1)
        order = np.argsort(group, kind="stable")
        g, r, u, w = group[order], rank[order], measured[order], weight[order]
        late = ((day[order] >> bit) & 1).astype(bool)
        new_group = np.r_[True, g[1:] != g[:-1]]
        new_value = new_group | np.r_[True, r[1:] != r[:-1]]
        first_of_value = np.maximum.accumulate(np.where(new_value, np.arange(len(g)), 0))
        first_of_group = np.maximum.accumulate(np.where(new_group, np.arange(len(g)), 0))
        smaller = {}
        for side in (True, False):
            before = np.r_[0, np.cumsum(np.where(late == side, w, 0))[:-1]]
            smaller[side] = before[first_of_value] - before[first_of_group]
        total += int((w * smaller[False])[late & u].sum() - (w * smaller[True])[~late & u].sum())
    return total


def _runs(pdf: pd.DataFrame, keys: Sequence[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each group, which stand together."""
    if not len(pdf):
        return
    new = np.zeros(len(pdf), bool)
    new[0] = True
    for k in keys:
        at, before = pdf[k].to_numpy()[1:], pdf[k].to_numpy()[:-1]
        new[1:] |= (at != before) & ~(pd.isna(at) & pd.isna(before))
    cuts = [*np.flatnonzero(new), len(pdf)]
    for a, b in zip(cuts, cuts[1:]):
        part = pdf.iloc[a:b]
        yield tuple(part[k].iloc[0] for k in keys), part


def _in_order(rows: DataFrame, keys: Sequence[str], n_rows: int, block_rows: int) -> tuple[DataFrame, int]:
    """``rows`` by keys and value in about ``n_rows / block_rows`` partitions, and the number of these."""
    parts = max(1, math.ceil(n_rows / block_rows))
    return rows.repartitionByRange(parts, *keys, "z").sortWithinPartitions(*keys, "z", "u"), parts


def _block_scores(rows: DataFrame, keys: Sequence[str], n_rows: int, block_rows: int) -> DataFrame:
    """Score of every group of (t, z, u, w) rows, of which there are ``n_rows`` in all.

    A partition of neighbouring values is a block. It is scored by itself and hands on its counts per day. Any two
    blocks part ways at one bit of their numbers: for every bit, the blocks that agree on the bits above it are two
    halves, the lower one with the smaller values, and days are summed and compared between the halves.
    """
    ordered, parts = _in_order(rows.select(*keys, "t", "z", "u", "w"), keys, n_rows, block_rows)
    fields = [rows.schema[k] for k in keys]
    schema = T.StructType(fields + [T.StructField("_block", T.LongType()), T.StructField("t", T.LongType()),
                                    T.StructField("w", T.LongType()), T.StructField("wu", T.LongType()), T.StructField("s", T.LongType())])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId()
        held = [b for b in batches if len(b)]  # a block
        for key, part in _runs(pd.concat(held, ignore_index=True), keys) if held else ():
            t, z, u, w = (part[c].to_numpy() for c in ("t", "z", "u", "w"))
            u = u.astype(bool)
            days, day = np.unique(t, return_inverse=True)
            out = {"_block": [block] * len(days) + [None], "t": [*days, None], "s": [0] * len(days) + [pair_score(t, _ranked(z, u), u, w)],
                   "w": [*np.bincount(day, w).astype(np.int64), 0], "wu": [*np.bincount(day, w * u).astype(np.int64), 0]}
            yield pd.DataFrame({**{k: pd.Series([v] * (len(days) + 1), dtype=part[k].dtype) for k, v in zip(keys, key)},
                                **{c: pd.array(out[c], "Int64") for c in ("_block", "t", "w", "wu", "s")}})

    blocks = ordered.mapInPandas(counted, schema)
    bits = max(1, (parts - 1).bit_length())
    level = F.when(F.col("_block").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(bits - 1)))
    stretches = blocks.withColumn("_level", F.explode(level)).selectExpr(
        *[f"`{k}`" for k in keys], "_level", "t", "s", "shiftright(_block, _level + 1) AS _stretch",
        "coalesce(shiftright(_block, _level) % 2 = 1, false) AS _upper", "w", "wu")
    days = stretches.groupBy(*keys, "_level", "_stretch", "t").agg(
        F.sum(F.when(~F.col("_upper"), F.col("w")).otherwise(0)).alias("low"),
        F.sum(F.when(F.col("_upper"), F.col("wu")).otherwise(0)).alias("high"), F.sum("s").alias("s"))
    group = W.partitionBy(*keys, "_level", "_stretch")
    until = F.sum("low").over(group.orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow))
    pairs = F.col("high") * (2 * until - F.col("low") - F.sum("low").over(group))
    return days.withColumn("_pairs", pairs).groupBy(*keys).agg((F.sum("_pairs") + F.sum("s")).alias("s"))


def _long_series(samples: DataFrame, keys: Sequence[str], block_rows: int, few: bool) -> DataFrame:
    """Score and slope of series too long for one task.

    The score falls as a larger slope is removed. Two ends are narrowed down together: where it stops being positive
    and where it becomes negative; the slope lies half way. ``few`` says that the series are few enough to broadcast
    one short row for each.
    """
    small = F.broadcast if few else (lambda df: df)
    weighted = _weighted(samples, keys)
    sizes = weighted.groupBy(*keys).agg(F.min("t").alias("_t0"), (F.max("y") - F.min("y") + 1).alias("_reach"))
    weighted = checkpointed(join_on(weighted, small(sizes), keys))
    n_rows = weighted.count()
    score = _block_scores(weighted.withColumnRenamed("y", "z").drop("_t0", "_reach"), keys, n_rows, block_rows)
    ends = F.explode(F.array(F.lit("positive"), F.lit("negative")))
    state = weighted.select(*keys, "_reach").distinct().select(
        *keys, ends.alias("_end"), (-F.col("_reach")).alias("_low"), F.col("_reach").alias("_high")
    )
    weighted = weighted.drop("_reach")
    for first in [True] + [False] * (_ROUNDS - 1):
        state = checkpointed(_narrowed(weighted, small(state), keys, n_rows, block_rows, first))
    found = _found_slopes(weighted, small(state), keys, n_rows, block_rows)
    both = join_on(state, found, [*keys, "_end"], "left")
    slope = both.groupBy(*keys).agg(F.avg(F.coalesce("_slope", (F.col("_low") + F.col("_high")) / 2)).alias("slope"))
    return join_on(score, slope, keys, "left").select(*keys, "s", "slope")


def _narrowed(weighted: DataFrame, state: DataFrame, keys: Sequence[str], n_rows: int, block_rows: int,
              first: bool) -> DataFrame:
    """Each end between the last slope on its near side and the first on its far side.

    An end that has only one side has no crossing and is dropped in the first round.
    """
    tried = [*keys, "_end", "_low", "_high", "_i"]
    step = F.explode(F.sequence(F.lit(0), F.lit(_CANDIDATES + 1)))
    rows = join_on(weighted, state, keys).select("*", step.alias("_i"))
    beta = f"(_low + (_high - _low) * _i / {_CANDIDATES + 1})"
    rows = rows.selectExpr(*tried, "t", f"y - {beta} * (t - _t0) AS z", "u", "w")
    near = "IF(_end = 'positive', s > 0, s >= 0)"
    low, high = f"max(IF({near}, {beta}, NULL))", f"min(IF({near}, NULL, {beta}))"
    if not first:
        low, high = f"coalesce({low}, min(_low))", f"coalesce({high}, max(_high))"
    scores = _block_scores(rows, tried, 2 * (_CANDIDATES + 2) * n_rows, block_rows)
    narrowed = scores.groupBy(*keys, "_end").agg(F.expr(f"{low} AS _low"), F.expr(f"{high} AS _high"))
    return narrowed.where("_low IS NOT NULL AND _high IS NOT NULL")


def _found_slopes(weighted: DataFrame, state: DataFrame, keys: Sequence[str], n_rows: int, block_rows: int) -> DataFrame:
    """(keys, _end, _slope): a pair's slope inside each end's bracket, which by now holds one slope up to rounding.

    If any pair of samples turns round within the bracket, neighbours do: every block looks at its own.
    """
    ended = [*keys, "_end"]
    rows = join_on(weighted, state, keys).selectExpr(
        *[f"`{k}`" for k in ended], "t", "y", "y - _low * (t - _t0) AS z", "y - _high * (t - _t0) AS z2", "u")
    ordered, _ = _in_order(rows, ended, 2 * n_rows, block_rows)
    schema = T.StructType([rows.schema[k] for k in ended] + [T.StructField("_slope", T.DoubleType()), T.StructField("_n", T.LongType())])

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        for key, part in _runs(pd.concat(held, ignore_index=True), ended) if held else ():
            t, y, z, z2 = (part[c].to_numpy(dtype=float) for c in ("t", "y", "z", "z2"))
            u = part["u"].to_numpy(dtype=bool)
            slopes, _, _ = _pair_slopes(*_side_by_side(_ranked(z, u), _ranked(z2, u)), t, y, u)
            if len(slopes):
                yield pd.DataFrame([(*key, float(slopes[len(slopes) // 2]), len(slopes))], columns=[*ended, "_slope", "_n"])

    return ordered.mapInPandas(turned, schema).groupBy(*ended).agg(F.expr("max_by(_slope, struct(_n, _slope)) AS _slope"))
