"""Checksums of spans against zlib, features against a plain count, and defined results for odd tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stavework.llm import importance
from stavework.llm.crc_spans import DEPTH, crc32_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, rank string, score string, k string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_spans_have_the_checksums_of_zlib():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 400_000).astype(np.uint8)
    starts = rng.integers(0, 300_000, 2000)
    ends = starts + rng.choice([0, 1, 2, 7, DEPTH - 1, DEPTH, DEPTH + 1, 2 * DEPTH, 2 * DEPTH + 1, 1000, 4096, 70_001], 2000)
    raw = data.tobytes()
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert len(crc32_spans(data, np.zeros(0, int), np.zeros(0, int))) == 0


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("reach", [37, 1 << 20])
def test_features_of_words_cut_anywhere(monkeypatch, longest, reach):
    monkeypatch.setattr(importance, "REACH", reach)
    rng = random.Random(3)
    texts = [None, "", "a", "A b", "éé Ünï 日本 x", "z" * 500, *("".join(rng.choice("abcXYZ  .,é日\n") for _ in range(rng.choice([0, 1, 5, 37, 38, 100, 300]))) for _ in range(100))]
    found, rows, n = importance.feature_buckets(pa.array(texts), longest, 97)
    for i, text in enumerate(texts):
        own = words(text)
        assert n[i] == len(own)
        assert Counter(found[rows == i].tolist()) == Counter(zlib.crc32(" ".join(own[a : a + k]).encode()) % 97 for k in range(1, longest + 1) for a in range(len(own) - k + 1))


def test_odd_rows_ties_and_clashing_columns(spark):
    long = "word " * 200_000 + "x" * 100_000
    rows = [(1, None), (None, "a b c " * 9), (2, ""), (3, "red rose " * 20), (3, "red rose " * 20), (4, long), (5, "few words")]
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], SCHEMA)
    aims = spark.createDataFrame([(1, "red rose", "", "", ""), (2, None, "", "", "")], SCHEMA)
    out = importance.resample(docs, aims, percent=75, longest=2)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows)
    assert sorted(r["rank"] for r in got if r["rank"] is not None) == [1, 2, 3]  # 75 % of the four texts of 20 words or more
    same = [r for r in got if r.doc_id == 3]
    assert same[0].score == same[1].score and abs(same[0]["rank"] - same[1]["rank"]) == 1
    assert {r.doc_id: r.n_features for r in got if r.doc_id in (1, 2, 4, 5)} == {1: 0, 2: 0, 4: 2 * 200_001 - 1, 5: 3}
    assert {r.doc_id: r.weight for r in got if r.doc_id in (1, 2)} == {1: 0, 2: 0}
    assert importance.resample(docs.limit(0), aims).count() == 0
    assert importance.resample(docs, aims.limit(0)).count() == len(rows)


def test_draw_equals_a_plain_one_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = importance.resample(docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    long = sorted((r for r in got if r.n_features >= 20), key=lambda r: (-r.score, r.doc_id))
    assert {r.doc_id: r["rank"] for r in got if r["rank"]} == {r.doc_id: i for i, r in enumerate(long[: len(long) // 10], 1)}
    assert sorted(importance.resample(docs.repartition(5), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).collect(), key=lambda r: r.doc_id) == got
