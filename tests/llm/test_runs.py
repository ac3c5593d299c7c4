"""Extensions and runs against brute force, and defined results for odd tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from stavework.llm import runs
from stavework.llm.common_extensions import Extensions

SCHEMA = "doc_id long, text string, runs string, n_words string, k string"


def plain_runs(words, least, times):
    """All runs by walking every period."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                out.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def test_extensions_equal_a_plain_walk():
    rng = random.Random(5)
    for _ in range(60):
        values = [rng.choice([1, 2, 3][: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(1, 200))] + [9]
        pairs = [(i, j) for i, j in ((rng.randrange(len(values)), rng.randrange(len(values))) for _ in range(50)) if i != j]
        got = Extensions(np.array(values)).common(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
        for (i, j), n in zip(pairs, got, strict=True):
            same = 0
            while max(i, j) + same < len(values) and values[i + same] == values[j + same]:
                same += 1
            assert same == n


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 2), (6, 2), (10, 4)])
@pytest.mark.parametrize("pairs", [50, 1 << 18])
def test_runs_equal_a_walk_of_every_period(monkeypatch, least, times, pairs):
    monkeypatch.setattr(runs, "PAIRS", pairs)
    rng = random.Random(least * pairs)
    for _ in range(30):
        texts = []
        for _ in range(rng.randrange(1, 12)):
            own = [rng.randrange(1, rng.choice([1, 2, 3, 50]) + 1) for _ in range(rng.randrange(120))]
            if own and rng.random() < 0.6:
                a, p = rng.randrange(len(own)), rng.randrange(1, 12)
                own = own[:a] + [own[a + x % min(p, len(own) - a)] for x in range(rng.randrange(100))] + own[: rng.randrange(20)]
            texts.append(own)
        got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), np.array(list(map(len, texts)), np.int64), least, times)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t, least, times)]


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, None), (None, "a b " * 30), (2, " \t"), (3, "x"), (3, "x"), (4, "one two three " * 20_000), (5, "y" * 300_000)]
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in rows], SCHEMA)
    out = runs.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()))
    assert got == [(0, 60, [(0, 60, 2)], "a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 1, [], "x"), (3, 1, [], "x"), (4, 60_000, [(0, 60_000, 3)], "one two three"), (5, 1, [], "y" * 300_000)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert runs.with_digests(runs.periodic_runs(docs.limit(0))).count() == 0


def test_query_on_a_small_table_equals_plain_code(spark):
    """Tails, runs, the best run and both digests of sf0.001."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in runs.with_digests(runs.periodic_runs(runs.with_repeated_tails(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))).collect()}
    seen = 0
    for d in docs:
        words = d.text.encode().split()
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a, p = h // 10 % n, 1 + (n - h // 10 % n) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        own, r = plain_runs(words, 24, 3), got[d.doc_id]
        seen += bool(own)
        kept = b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in own))
        best = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(own), *best, 1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in own).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
    assert seen > 5
