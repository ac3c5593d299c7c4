"""Correlations over lags and Kendall's tau against plain code."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavework.operators import compare, statistics

SCHEMA = "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int"


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(4)
    make = lambda song, n, p: [(song, 0, 10 * i, 10 * i + 5, p(i), 64) for i in range(n)]
    a = make(1, 101, lambda i: 60 + i % 7) + make(2, 40, lambda i: rng.randrange(50, 60)) + make(3, 9, lambda i: 60 + i) + make(4, 30, lambda i: 60)
    b = make(1, 90, lambda i: 60 + (i + 3) % 7) + make(2, 41, lambda i: rng.randrange(50, 60)) + make(3, 50, lambda i: 60 + i) + make(4, 30, lambda i: 60 + i)
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def pitches(rows, song):
    return np.array([r[4] for r in rows if r[0] == song], float)


def test_peaks_over_all_lags(sides):
    a, b, x, y = sides
    got = {r.song_id: (r.peak, r.lag) for r in statistics.cross_correlation(x, y).collect()}
    assert got.keys() == {1, 2, 4}
    for song in got:
        u, v = pitches(a, song), pitches(b, song)
        n = min(len(u), len(v))
        u, v = ((w[:n] - w[:n].mean()) / (w[:n].std() + 1e-10) for w in (u, v))
        r = np.round(np.correlate(u, v, mode="same") / n, 6)
        at = int(np.argmax(np.abs(r)))
        assert got[song] == (pytest.approx(r[at], abs=1e-6), at - n // 2)
    assert got[1][1] % 7 == 3 and got[4][0] == 0


def test_autocorrelation(sides):
    a, _, x, _ = sides
    got = {}
    for r in statistics.autocorrelation(x, most=20).collect():
        got.setdefault(r.song_id, {})[r.lag] = r.r
    assert {s: len(v) for s, v in got.items()} == {1: 20, 2: 20, 3: 4, 4: 15}
    u = pitches(a, 2)
    assert all(got[2][k] == pytest.approx(np.corrcoef(u[: len(u) - k], u[k:])[0, 1], abs=1e-6) for k in range(20))
    assert set(got[4].values()) == {0.0} and got[1][7] == pytest.approx(1)


def test_tau_equals_all_pairs_and_joins_nothing(spark, sides):
    a, b, x, y = sides
    pairs = compare.paired(x, y)
    found = statistics.kendall(pairs)
    got = {r.song_id: r.tau for r in found.collect()}
    u, v = pitches(a, 2), pitches(b, 2)[:40]
    s = sum(np.sign(u[i] - u[j]) * np.sign(v[i] - v[j]) for i in range(40) for j in range(i))
    ties = lambda w: sum(w[i] == w[j] for i in range(40) for j in range(i))
    assert got[2] == pytest.approx(s / np.sqrt((780 - ties(u)) * (780 - ties(v))), abs=1e-6)
    assert got[4] == 0 and got[3] == 1
    plain = statistics.kendall(spark.createDataFrame([(1, 2, 3)], "song_id long, pitch_a int, pitch_b int"))
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString() and plain.first().tau == 0
    assert statistics.kendall(pairs.where(F.lit(False))).count() == 0
