"""Runs: stretches of words that repeat with a period, found on a harmonic grid by longest common extensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, let, text_chunks
from .common_extensions import Extensions

#: Pairs of places that are looked at together.
PAIRS = 1 << 18


def _grid(sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, place in it and period of every pair to look at, in batches.

    A run of period q and length L >= max(least, times * q) makes L - q places in a row equal to those q further on. The grid has a
    step of half of the fewest such places, so one of its points has at least a step of them from itself on.
    """
    longest = int(sizes.max(initial=0)) // times
    periods = np.arange(1, longest + 1)
    step = np.maximum((np.maximum(least, times * periods) - periods) // 2, 1)
    fits = np.where(sizes >= least, sizes // times, 0)
    done = np.cumsum(fits)
    text_at, at = 0, 0
    while text_at < len(sizes):
        # rows of the table (text, period), as many as have about PAIRS points
        most = min(int(np.searchsorted(done, at + PAIRS, "left")) + 1, len(sizes))
        row = np.arange(at, min(int(done[most - 1]), at + PAIRS))
        text = np.searchsorted(done, row, "right")
        q = row - (done[text] - fits[text]) + 1
        points = (sizes[text] - q - 1) // step[q - 1] + 1
        total = np.cumsum(points)
        keep = max(int(np.searchsorted(total, PAIRS, "right")), 1)
        text, q, points = text[:keep], q[:keep], points[:keep]
        if len(row):
            first = np.cumsum(points) - points
            place = (np.arange(points.sum()) - np.repeat(first, points)) * np.repeat(step[q - 1], points)
            yield np.repeat(text, points), place, np.repeat(q, points)
        at += len(text)
        text_at = int(np.searchsorted(done, at, "right"))


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in this order, of texts laid end to end.

    words: numbers from 1, equal where words are equal. sizes: words of each text. A run is a stretch with smallest period q of at least
    max(least, times * q) words, times >= 2, that no neighbouring word extends.
    """
    begin = np.cumsum(sizes + 1) - sizes
    walled = np.empty(len(words) + len(sizes) + 1, np.int64)
    walls = np.concatenate([[0], begin + sizes])
    walled[walls] = int(words.max(initial=0)) + 1 + np.arange(len(walls))
    inside = np.ones(len(walled), bool)
    inside[walls] = False
    walled[inside] = words
    probe = max((least - max(least // times, 1)) // 2, 1)  # no step of the grid is shorter
    likely = []
    for text, place, q in _grid(sizes, least, times):
        for t in range(min(probe, 8)):
            x = begin[text] + place + t
            same = np.flatnonzero(walled[np.minimum(x, len(walled) - 1)] == walled[np.minimum(x + q, len(walled) - 1)])
            text, place, q = text[same], place[same], q[same]
        if len(text):
            likely.append(np.stack([text, place, q]))
    if not likely:
        return np.zeros((0, 4), np.int64)
    text, place, q = np.concatenate(likely, axis=1)
    # only texts with a likely pair are indexed
    chosen = np.unique(text)
    moved = np.zeros(len(sizes), np.int64)
    moved[chosen] = np.cumsum(sizes[chosen] + 1) - sizes[chosen]
    part = np.concatenate([walled[:1], *(walled[begin[c] : begin[c] + sizes[c] + 1] for c in chosen)])
    part = np.unique(part, return_inverse=True)[1].astype(np.int64) + 1
    ahead, back = Extensions(part), Extensions(part[::-1])
    found = []
    for a in range(0, len(text), PAIRS):
        i, p = moved[text[a : a + PAIRS]] + place[a : a + PAIRS], q[a : a + PAIRS]
        after = ahead.common(i, i + p)
        before = back.common(len(part) - i, len(part) - i - p)
        length = before + p + after
        good = length >= np.maximum(least, times * p)
        found.append(np.unique(np.stack([text[a : a + PAIRS][good], place[a : a + PAIRS][good] - before[good], length[good], p[good]], axis=1), axis=0))
    rows = np.unique(np.concatenate(found), axis=0)
    # a stretch found at a multiple of its smallest period is the same stretch: the first of its rows has the smallest
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[first]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _numbers(texts: list[list[bytes]]) -> np.ndarray:
    known: dict[bytes, int] = {}
    total = sum(map(len, texts))
    return np.fromiter((known.setdefault(w, len(known) + 1) for t in texts for w in t), np.int64, total)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """Runs of repeating words in every whole text, and the text without the repeats: one row per row of docs.

    Columns: key, n_words, runs (array of start, length, period, by start and then period; words are numbered from 0), collapsed (the
    text's words joined by one space, without those that a run contains after its first period).

    Words are parted by white space of ASCII. Null and empty texts have no words, no runs and an empty collapsed text. Keys may be null
    or repeat. An empty table gives an empty result. Other columns are neither read nor returned, so their names don't matter.

    Rows are worked on where they are read, without a shuffle, about 1.5 MB of text together. Memory grows with the longest
    text (its words and about 200 bytes of index a word).
    """
    key_type = docs.schema[key].dataType.simpleString()
    out_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "t"):
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"").split() for t in b.column("t").cast(pa.binary())]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            rows = find_runs(_numbers(texts), sizes, least, times)
            edges = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
            collapsed = [b" ".join(_without_repeats(t, rows[a:z]) if a < z else t) for t, a, z in zip(texts, edges, edges[1:], strict=False)]
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in (1, 2, 3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(sizes), runs.cast(out_type), pa.array(collapsed, pa.binary()).cast(pa.string())], ["k", "n_words", "runs", "collapsed"])

    out = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"k {key_type}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return out.withColumnRenamed("k", key)


def _without_repeats(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 1] + runs[:, 3], 1)
    np.add.at(depth, runs[:, 1] + runs[:, 2], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def with_repeated_tails(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, where a tenth of the keys (by checksum) get a tail that repeats some of the text's own words, to test with.

    Of h = crc32(key in decimal) the last digit 0 chooses rows with words; g = h // 10 gives the tail's start a = g % n and period
    p = 1 + (n - a) // (3 + g % 8): word i >= a becomes word a + (i - a) % p. A null key changes nothing.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n

        def repeated(bounds: Column) -> Column:
            a, p = bounds["a"], bounds["p"]
            return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.get(words, F.when(i < a, i.cast("long")).otherwise(a + (i - a) % p).cast("int"))))

        return F.when(n == 0, F.col(text)).otherwise(let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), repeated))

    return docs.select(key, F.when(h % 10 == 0, let(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"({WORD_CLASS})")), tail)).otherwise(F.col(text)).alias(text))


def with_digests(found: DataFrame) -> DataFrame:
    """The result of periodic_runs with the number of runs, the run of the greatest exponent (exact; first of ties) and digests."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.reduce("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    digests = [F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    out = found.withColumn("_best", best)
    exponent = F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli")
    keys = [c for c in found.columns if c not in ("n_words", "runs", "collapsed")]
    return out.select(*keys, F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period", exponent, *digests)
