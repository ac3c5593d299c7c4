"""Hilbert keys, recall against brute force, exact scores, and defined results for odd tables."""

import itertools
import math

import numpy as np
import pytest

from stavework.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label string, rank string, id string, v string"


def brute(rows, every, k):
    """Exact neighbours of a list of (id, vector)."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, true):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in near}) for q, near in true.items()) / sum(map(len, true.values()))


@pytest.mark.parametrize(("dims", "bits"), [(1, 5), (2, 4), (3, 3), (4, 2)])
def test_neighbouring_keys_are_neighbouring_cells(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = neighbours.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_and_scores(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    got, true = by_query(queries.op13_hilbert_neighbours(spark, f"/root/testdata/{folder}")), brute(rows, 100, 10)
    assert got.keys() == true.keys() and all(len(x) == 10 for x in got.values())
    assert recall(got, true) >= 0.9
    vector = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (x[1], x[0])) and q not in dict(near)
        assert all(math.isclose(far, np.linalg.norm(vector[q] - vector[i]), rel_tol=1e-12) for i, far in near)


def test_windows_narrow_where_vectors_have_few_dimensions(spark, monkeypatch):
    rng = np.random.default_rng(1)
    flat = rng.normal(size=(6000, 2)) @ rng.normal(size=(2, 24))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(flat)]
    chosen = []
    measure = neighbours.measured_ranges
    monkeypatch.setattr(neighbours, "measured_ranges", lambda *a: chosen.append(measure(*a)) or chosen[-1])
    got = by_query(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=50))
    assert recall(got, brute(rows, 50, 10)) >= 0.9
    assert chosen[0] >= 48


def test_pieces_of_a_range_lose_nothing(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = by_query(neighbours.nearest(table, every=10))
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    assert by_query(neighbours.nearest(table, every=10)) == whole


def test_copies_ties_and_odd_rows(spark):
    """300 copies of one vector, a third of them asking; vectors that take no part; repeated rows and ids; clashing columns."""
    rng = np.random.default_rng(2)
    vectors = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(300)] + [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(300, 600)]
    odd = [(900, None), (903, []), (906, [0.0, -0.0, 0.0, 0.0]), (909, [1.0, None, 0.0, 0.0]), (912, [math.nan, 1.0, 0.0, 0.0]), (915, [math.inf, 1.0, 0.0, 0.0]), (918, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    more = [(0, [1.0, -0.0, 0.0, 0.0]), (30, [1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in vectors + odd + more], SCHEMA)
    got, true = by_query(neighbours.nearest(table, every=3)), brute(vectors, 3, 10)
    assert got.keys() == true.keys()
    assert all(got[q] == true[q] for q in range(0, 300, 3))
    assert recall(got, true) >= 0.9
    few = by_query(neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (100, [9.0, 2.0])], "vec_id long, embedding array<double>")))
    assert {q: [i for i, _ in x] for q, x in few.items()} == {0: [1, 100], 100: [0, 1]}
    assert neighbours.nearest(table.limit(0)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<double>")).count() == 0
