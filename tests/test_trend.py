"""Trends: short and long series against all pairs."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import numpy as np
import pytest

from limnograph.operators.trend import _score_pairs, pair_score, trend_nonpar


def by_pairs(rows):
    """Score and slope from the definitions, pair by pair; rows are (day, value, measured)."""
    s, slopes, start = 0, [], 0
    for (t1, y1, u1), (t2, y2, u2) in itertools.combinations(sorted(rows), 2):
        if t1 == t2 or not (u1 or u2):
            continue
        slope = (y2 - y1) / (t2 - t1)
        if u1 and u2:
            s += (slope > 0) - (slope < 0)
            slopes += [slope, slope]
            start += 1
        elif u2:
            s += slope >= 0
            slopes.append(slope)
            start += 1
        else:
            s -= slope <= 0
            slopes.append(slope)
    slopes.sort()
    ends = ([slopes[start - 1]] if start else []) + ([slopes[start]] if len(slopes) > start else [])
    return s, sum(ends) / len(ends) if ends else None


def make(seed, n, censored=0.0, days=4000, digits=1):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, days, size=n)
    y = np.round(rng.normal(size=n) + t / 2000.0, digits)
    return [(int(a), float(b), bool(c)) for a, b, c in zip(t, y, rng.random(n) >= censored)]


@pytest.fixture(scope="module")
def series():
    return {"plain": make(1, 60), "ties": make(3, 60, digits=0, days=40),
            "long": make(4, 140, censored=0.3), "pair": [(0, 1.0, True), (10, 3.0, True)],
            "alone": [(5, 1.0, True)], "same day": [(5, 1.0, True), (5, 2.0, True)]}


@pytest.fixture(scope="module")
def meas(samples, series):
    rows = [{"Site": name, "Date": dt.date(1990, 1, 1) + dt.timedelta(days=t), "ValueCen": y, "Censored": not u}
            for name, points in series.items() for t, y, u in points]
    rows.append({"Site": "plain", "Date": "1995-01-01", "ValueCen": None})
    return samples(rows).repartition(5).cache()


@pytest.mark.parametrize(
    "censored, pair_rows, block_rows", [(False, 1000, 1000), (True, 1000, 1000), (True, 100, 50)]
)
def test_trend_matches_all_pairs(meas, series, censored, pair_rows, block_rows):
    out = trend_nonpar(meas, censored=censored, pair_rows=pair_rows, block_rows=block_rows)
    rows = {r.Site: r for r in out.collect()}
    assert set(rows) == set(series)
    for name, points in series.items():
        kept = points if censored else [p for p in points if p[2]]
        s, slope = by_pairs(kept)
        assert rows[name].s == s and rows[name].n == len(kept), name
        if slope is None:
            assert rows[name].slope_per_year is None
        else:
            assert rows[name].slope_per_year == pytest.approx(slope * 365.25, rel=1e-12, abs=1e-12), name


def test_significance_of_a_monotone_series(samples):
    rows = [(dt.date(2000 + i, 6, 1).isoformat(), float(i)) for i in range(10)]
    row = trend_nonpar(samples(rows)).collect()[0]
    variance = 10 * 9 * 25 / 18
    z = 44 / math.sqrt(variance)
    assert row.s == 45 and row.tau == pytest.approx(1.0) and row.z == pytest.approx(z)
    assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert row.slope_per_year == pytest.approx(1.0, rel=1e-2)


def test_by_month_keeps_months_apart(samples):
    rows = [(f"{2000 + i}-05-01", float(i)) for i in range(5)] + [(f"{2000 + i}-08-01", float(-i)) for i in range(5)]
    got = {r.month_num: r.s for r in trend_nonpar(samples(rows), by_month=True).collect()}
    assert got == {5: 10, 8: -10}


@pytest.mark.parametrize("seed", range(5))
def test_pair_score_kernel(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 80))
    t, rank = rng.integers(0, 15, n), rng.integers(0, 12, n)
    measured, weight = rng.random(n) < 0.7, rng.integers(1, 4, n)
    direct = 0
    for i in range(n):
        for j in range(n):
            if measured[i] and rank[j] < rank[i]:
                direct += int(np.sign(t[i] - t[j])) * int(weight[i] * weight[j])
    assert pair_score(t, rank, measured, weight) == direct


@pytest.mark.parametrize("seed", range(60))
def test_counted_brackets_match_all_pairs(seed):
    """With few listed pairs the slope is bracketed by counting; it is the same pair slope."""
    rng = np.random.default_rng(seed)
    rows = make(seed, int(rng.integers(1, 60)), censored=[0, 0.3, 0.8, 1.0][seed % 4],
                days=int(rng.choice([1, 5, 40, 4000])), digits=int(rng.choice([0, 1, 6])))
    t, y, u = (np.array(x) for x in zip(*rows))
    s, slope = by_pairs(rows)
    for listed in (5, 1_000_000):
        got = _score_pairs(t.astype(float), y, u, listed)
        assert got[0] == s
        assert got[1] == (slope if slope is None else pytest.approx(slope, rel=1e-12, abs=1e-14))


@pytest.mark.parametrize("n", [1_400, 1_600, 3_000])
@pytest.mark.parametrize("digits", [1, 8])
def test_slope_is_exact_at_every_length(n, digits):
    t, y, u = (np.array(x) for x in zip(*make(n, n, digits=digits)))
    i, j = np.triu_indices(n, 1)
    i, j = i[t[i] != t[j]], j[t[i] != t[j]]
    slopes = (y[j] - y[i]) / (t[j] - t[i])
    assert _score_pairs(t.astype(float), y, u) == (int(np.sign(slopes).sum()), pytest.approx(np.median(slopes), rel=1e-14))


@pytest.mark.parametrize("digits", [0, 6])
def test_long_and_short_path_give_the_same_slope(samples, digits):
    points = make(9, 900, digits=digits)
    rows = [{"Date": dt.date(1990, 1, 1) + dt.timedelta(days=t), "ValueCen": y} for t, y, _ in points]
    short, long = (trend_nonpar(samples(rows), pair_rows=limit, block_rows=400).first() for limit in (1_000, 500))
    assert (short.s, short.n) == (long.s, long.n) and long.slope_per_year == pytest.approx(short.slope_per_year, rel=1e-13, abs=1e-13)


def test_equal_slopes_beyond_the_list_come_from_neighbours():
    """A straight line and a constant: all pairs have one slope, and more of them than may be listed."""
    t = np.arange(400.0)
    for y, slope in ((3 + 0.1 * t, 0.1), (np.full(400, 2.5), 0.0), (np.where(t < 397, 1.0, 9.0), 0.0)):
        s, got = _score_pairs(t, y, np.ones(400, bool), listed=50)
        assert got == pytest.approx(slope, abs=1e-14) and s == np.sign(np.subtract.outer(y, y)[np.tril_indices(400, -1)]).sum()


def test_equal_samples_of_a_day_are_counted_once(spark, samples, monkeypatch):
    """A series of many equal samples costs what its different ones cost, and has the same result."""
    import datetime as dt

    from limnograph.operators import trend

    rng = np.random.default_rng(5)
    t, y, u, w = rng.integers(0, 60, 400) * 1.0, rng.integers(1, 9, 400) * 1.0, rng.random(400) < 0.8, rng.integers(1, 6, 400)
    each = [np.repeat(x, w) for x in (t, y, u)]
    for listed in (2_000_000, 10_000):
        whole = _score_pairs(*each, listed=listed)
        assert _score_pairs(t, y, u, listed=listed, weight=w) == (whole[0], pytest.approx(whole[1], abs=1e-12))
    calls = []
    counted = trend.pair_score
    monkeypatch.setattr(trend, "pair_score", lambda *a: calls.append(1) or counted(*a))
    trend._score_pairs(t, y, u, 1_000, weight=w)
    assert len(calls) < 60  # halving the range of slopes alone takes 100 and more
    rows = [(dt.date(2010, 1, 1 + d % 20), float(d % 3)) for d in range(60)] * 20
    plain = trend_nonpar(samples(rows)).first()
    assert trend_nonpar(samples(rows), pair_rows=100, block_rows=40).first() == plain and plain.n == 1_200
