"""p-values against published table values, and tests against plain code on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stavework.functions import special
from stavework.operators import compare
from stavework.operators import significance as sg

SCHEMA = "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


#: Critical values of published tables (statistic, degrees of freedom) at their level.
CHI = [(3.841, 1, 0.05), (6.635, 1, 0.01), (18.307, 10, 0.05), (124.342, 100, 0.05), (67.505, 50, 0.05), (0.0158, 1, 0.90)]
STUDENT = [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (1.984, 100, 0.05), (1.962, 1000, 0.05)]
FISHER = [(4.96, 1, 10, 0.05), (2.98, 10, 10, 0.05), (1.59, 40, 60, 0.05), (161.4, 1, 1, 0.05)]


def test_published_critical_values(spark):
    lit = lambda x: F.lit(float(x))
    for x, dof, p in CHI:
        assert value(spark, special.chi_square_p(lit(x), lit(dof))) == pytest.approx(p, abs=6e-4)
    for t, dof, p in STUDENT:
        assert value(spark, special.student_p(lit(-t), lit(dof))) == pytest.approx(p, abs=2e-4)
    for f, a, b, upper in FISHER:
        assert value(spark, special.variance_p(lit(f), lit(a), lit(b))) == pytest.approx(2 * upper, abs=4e-3)
    for z, p in ((1.959964, 0.05), (2.575829, 0.01), (0.0, 1.0), (6.0, 1.973e-9)):
        assert value(spark, special.normal_p(lit(z))) == pytest.approx(p, rel=2e-3)
    # the limit law: 1.358 and 1.628 over the root of nm / (n + m)
    for c, p in ((1.358, 0.05), (1.628, 0.01)):
        assert value(spark, special.kolmogorov_p(lit(c / 10), lit(200), lit(200))) == pytest.approx(p, abs=3e-4)
    assert value(spark, special.kolmogorov_p(lit(0), lit(50), lit(50))) == 1.0
    assert value(spark, special.chi_square_p(lit(0), lit(0))) == 1.0
    assert value(spark, special.normal_p(F.lit(None).cast("double"))) is None


def test_shares_add_up():
    rng = np.random.default_rng(0)
    a, b, x = rng.uniform(0.5, 400, 300), rng.uniform(0.5, 400, 300), rng.uniform(0.001, 0.999, 300)
    assert np.allclose(special.lower_beta(a, b, x) + special.lower_beta(b, a, 1 - x), 1)
    assert np.allclose(special.lower_beta(np.ones(300), b, x), 1 - (1 - x) ** b)
    assert np.allclose(special.upper_gamma(np.ones(300), a), np.exp(-a))
    assert np.allclose(special.upper_gamma(np.full(300, 0.5), a / 9), [math.erfc(math.sqrt(v / 9)) for v in a])


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(2)
    ours = [(1, 0, 10 * i, 10 * i + rng.randrange(1, 300), rng.randrange(50, 70), rng.randrange(1, 127)) for i in range(80)]
    theirs = [(s, t, a + 1, b + rng.randrange(3), p + (rng.random() < 0.3), max(1, v - rng.randrange(5))) for s, t, a, b, p, v in ours[:70]]
    few = [(2, 0, 0, 10, 60, 64)]
    return ours, theirs, spark.createDataFrame(ours + few, SCHEMA), spark.createDataFrame(theirs + few, SCHEMA)


def test_rank_tests_equal_plain_code(sides):
    ours, theirs, a, b = sides
    x, y = [r[5] for r in ours], [r[5] for r in theirs]
    u = sum((p > q) + (p == q) / 2 for p in x for q in y)
    n, m = len(x), len(y)
    ties = sum(c**3 - c for c in (len([v for v in x + y if v == k]) for k in set(x + y)))
    z = (max(u, n * m - u) - n * m / 2 - 0.5) / math.sqrt(n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))))
    r = next(r for r in sg.mann_whitney(sg.value_counts(a, b, ("pitch", "velocity"))).collect() if (r.song_id, r.feature) == (1, "velocity"))
    assert (r.u, r.z, r.p) == (u, pytest.approx(z), pytest.approx(math.erfc(z / math.sqrt(2))))

    d = [p - q for p, q in zip(x, y, strict=False) if p != q]
    rank = lambda v: sum(abs(e) < v for e in d) + (sum(abs(e) == v for e in d) + 1) / 2
    up, down = sum(rank(e) for e in d if e > 0), sum(rank(-e) for e in d if e < 0)
    k = len(d)
    spread = k * (k + 1) * (2 * k + 1) / 24 - sum(c**3 - c for c in (sum(abs(e) == v for e in d) for v in {abs(e) for e in d})) / 48
    pairs = sg.paired_values(compare.paired(a, b), ("pitch", "velocity"))
    found = {(r.song_id, r.feature): r for r in sg.wilcoxon(pairs).collect()}
    r = found[1, "velocity"]
    z = (min(up, down) - k * (k + 1) / 4) / math.sqrt(spread)
    assert (r.differing, r.w, r.p) == (k, min(up, down), pytest.approx(math.erfc(abs(z) / math.sqrt(2))))
    assert (found[2, "pitch"].w, found[2, "pitch"].p) == (0.0, 1.0)


def test_distances_need_enough_values(sides):
    ours, theirs, a, b = sides
    got = {(r.song_id, r.feature): r for r in sg.distribution_tests(sg.value_counts(a, b, ("pitch", "velocity", "duration", "interval"))).collect()}
    assert {k[0] for k in got} == {1} and len(got) == 4
    x, y = [r[3] - r[2] for r in ours], [r[3] - r[2] for r in theirs]
    d = max(abs(sum(v <= k for v in x) / len(x) - sum(v <= k for v in y) / len(y)) for k in x + y)
    assert got[1, "duration"].ks == pytest.approx(d) and got[1, "duration"].identical
    assert got[1, "interval"].n == 79 and got[1, "interval"].m == 69


def test_equal_tables_do_not_differ(sides):
    _, _, a, _ = sides
    pairs = sg.paired_values(compare.paired(a, a), ("pitch", "velocity"))
    assert all(not r.differs and r.mean_p > 0.9 for r in sg.significance(sg.mann_whitney(sg.value_counts(a, a, ("pitch", "velocity", "duration"))), sg.wilcoxon(pairs), sg.paired_t(pairs)).collect())
    assert {(r.chi2, r.p) for r in sg.chi_square(sg.value_counts(a, a, ("pitch",))).collect()} == {(0.0, 1.0)}
    assert all(r.similarity == pytest.approx(1) for r in sg.cosines(sg.value_counts(a, a, ("pitch", "octave"))).collect())
    none = a.where("false")
    assert sg.mann_whitney(sg.value_counts(a, none, ("pitch",))).count() == 0 and sg.distribution_tests(sg.value_counts(none, none, ("pitch",))).count() == 0
