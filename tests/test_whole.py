"""Queries over every label and lag, against brute force on the smallest tables."""

from collections import defaultdict

import numpy as np
import pytest

from tidemark.catalog import proxies as P
from tidemark.catalog import queries, series
from tidemark.operators import features

DIR, EPS = "/root/testdata/sf0.001", 1e-6


@pytest.fixture(scope="module")
def hourly(spark):
    """Rows by stay, in order, and (stay, t, y) of every hourly label."""
    rows = defaultdict(list)
    for r in P.wide(spark, DIR).collect():
        rows[r.SUBJECT_ID, r.ICUSTAY_ID].append(r)
    labels = [((r.SUBJECT_ID, r.ICUSTAY_ID), r.t, r.y) for r in series.labels("LOS")(spark, DIR).collect()]
    assert len({t % 24 for _, t, _ in labels}) == 24
    return {k: sorted(v, key=lambda r: r.hours) for k, v in rows.items()}, labels


def found(spark, name, *more):
    got = queries()[name](spark, DIR).collect()
    out = {((r.SUBJECT_ID, r.ICUSTAY_ID), r.t, *(r[m] for m in more)): r for r in got}
    assert len(out) == len(got)
    return out


def told(v):
    """min, max, mean, std, skew, len."""
    m, constant = v.mean(), v.min() == v.max()
    return [v.min(), v.max(), m, v.std(), None if constant else ((v - m) ** 3).mean() / ((v - m) ** 2).mean() ** 1.5, len(v)]


@pytest.fixture(scope="module")
def statistics(hourly):
    rows, labels = hourly
    out = {}
    for k, t, _ in labels:
        for c in P.CHANNELS:
            own = np.array([(r.hours, r[c]) for r in rows[k] if r[c] is not None and r.hours < t + EPS]).reshape(-1, 2)
            if len(own):
                lo, hi = own[0, 0], own[-1, 0]
                for i, (part, percent) in enumerate(features.SUB_WINDOWS):
                    share = (hi - lo) * (percent / 100)
                    a, b = (lo, lo + share) if part == "first" else (hi - share, hi)
                    out[k, t, c, i] = told(own[(own[:, 0] < b + EPS) & (own[:, 0] > a - EPS), 1])
    return out


def test_statistics_of_every_hourly_label(spark, statistics):
    got = found(spark, "w6_a8_window_statistics", "channel", "window")
    assert got.keys() == statistics.keys()
    for key, want in statistics.items():
        for n, w in zip(features.STATISTICS, want, strict=True):
            assert got[key][n] == (None if w is None else pytest.approx(w, rel=1e-5, abs=2e-6)), (key, n)


def test_vectors_of_every_hourly_label(spark, hourly, statistics):
    got = found(spark, "a9_feature_vector")
    known = defaultdict(int)
    for (k, t, _, _), s in statistics.items():
        known[k, t] += sum(x is not None for x in s)
    assert got.keys() == {(k, t) for k, t, _ in hourly[1]}
    for (k, t), r in got.items():
        first = statistics.get((k, t, P.CHANNELS[0], 0))
        assert (r.n, r.known, r.first_len) == (210, known[k, t], first and first[5])
        assert r.first_min == (first and pytest.approx(first[0], rel=1e-5, abs=1e-3))


def test_prefixes_of_every_hourly_label(spark, hourly):
    rows, labels = hourly
    want = {(k, t): [r.hours for r in rows[k] if r.hours < t + EPS] for k, t, _ in labels}
    got = found(spark, "j13_prefix_rows")
    assert {k: (r.n, r["last"]) for k, r in got.items()} == {k: (len(h), h[-1]) for k, h in want.items() if h}
    got = found(spark, "b1_j14_prefix_samples")
    grid = defaultdict(dict)
    for r in series.grid("previous")(spark, DIR).collect():
        grid[r.SUBJECT_ID, r.ICUSTAY_ID][r.bins] = r.click
    assert got.keys() == {(k, t / 24) for k, t, _ in labels}
    for k, t, y in labels:
        r, held = got[k, t / 24], [b for b in grid[k] if b <= t / 24]
        assert (r.n, r.y) == (len(held), y) and r.click == pytest.approx(grid[k][max(held)], rel=1e-5, abs=1e-3)


def test_every_lag_of_the_autocorrelation(spark):
    values = defaultdict(list)
    for r in P.events(spark, DIR).orderBy("EVENT_ID").collect():
        values[r.SUBJECT_ID].append(r.VALUE)
    want = {}
    for s, v in values.items():
        v = np.array(v)
        want |= {(s, lag): (v[lag:] * v[: len(v) - lag]).sum() / (v * v).sum() for lag in range(min(101, len(v)))}
    got = {(r.SUBJECT_ID, r.lag): r.r for r in queries()["a17_autocorrelation"](spark, DIR).collect()}
    assert got.keys() == want.keys() and max(lag for _, lag in got) > 5
    assert all(r == pytest.approx(want[k], abs=1e-6) for k, r in got.items())
