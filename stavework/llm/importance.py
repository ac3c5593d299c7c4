"""Importance resampling towards a target set, from hashed word features.

Features are runs of consecutive words; each falls into a bucket by its CRC-32, which `crc_spans` computes for all features of
many texts at once. A bucket's gain is the logarithm of how much commoner it is in the target than in the documents, a document's
weight the sum of its features' gains, and documents are drawn by the highest weights with Gumbel noise, which is sampling
without replacement in proportion to the exponential of the weight.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, stored, text_chunks
from .crc_spans import crc32_spans
from .grams import FOLDED_ASCII

#: Bytes in which words are looked for at once.
REACH = 1 << 20


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end, where 32 parts words and bounds part texts."""
    starts, ends = [], []
    for at in range(0, len(data), REACH):
        part = data[at : at + REACH + 1] != 32
        own = part[:REACH]
        new, last = own.copy(), own.copy()
        new[1:] &= ~own[:-1]
        if at and data[at - 1] != 32:
            new[0] = False
        last[: len(part) - 1] &= ~part[1:]
        cut = bounds[(bounds >= at) & (bounds < at + len(own))] - at
        new[cut] = own[cut]
        cut = bounds[(bounds > at) & (bounds <= at + len(own))] - at - 1
        last[cut] = own[cut]
        starts.append(np.flatnonzero(new) + at)
        ends.append(np.flatnonzero(last) + at + 1)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *starts]), np.concatenate([empty, *ends])


def _packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words copied next to each other with one space after each, and their new starts and ends."""
    sizes = ends - starts + 1
    until = np.cumsum(sizes)
    out = np.full(int(until[-1]) if len(until) else 0, 32, np.uint8)
    keep = np.ones(len(out), bool)
    keep[until - 1] = False
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    out[keep] = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    return out, until - sizes, until - 1


def feature_buckets(column: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature of a column of texts, the row it is in, and the words of each row. Rows are not in order."""
    raw, bounds = buffers(column)
    data = np.frombuffer(raw.translate(FOLDED_ASCII), np.uint8)
    starts, ends = _words(data, bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(row, minlength=len(column))
    if longest > 1:
        data, starts, ends = _packed(data, starts, ends)
    found, rows = [], []
    for n in range(1, longest + 1):
        whole = row[: len(row) - n + 1] == row[n - 1 :] if n <= len(row) else np.zeros(0, bool)
        first = np.flatnonzero(whole)
        found.append(crc32_spans(data, starts[first], ends[first + n - 1]) % np.uint32(buckets))
        rows.append(row[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows), words


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts. Each task counts its own texts, so at most `buckets` rows a task are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for b in text_chunks(batches, "t"):
            own += np.bincount(feature_buckets(b.column("t"), longest, buckets)[0], minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at])], ["bucket", "n"])

    rows = texts.selectExpr(f"`{text}` AS t").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, source: np.ndarray, buckets: int) -> np.ndarray:
    """floor(1000 * ln(((t + 1) * (S + buckets)) / ((s + 1) * (T + buckets)))) for each bucket."""
    t_all, s_all = int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def numbered_from_top(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place 1, 2, ... in the order, as column name.

    Rows are cut into ranges of the order, which are written once; a range's place is the number of rows in the ranges before
    it (as many numbers as partitions), and rows are numbered inside their range only.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_place", within).join(F.broadcast(offsets), "_range").withColumn(name, F.col("_offset") + F.col("_place")).drop("_range", "_place", "_offset")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000,
    least_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """Draws the documents that look most like the target texts: key, n_features, weight, score and rank, one row per row of docs.

    longest: features are runs of 1 .. longest words, joined by one space. Words are runs of letters and digits of ASCII, A-Z as a-z,
    and of all other characters. percent: of the documents with at least least_words words, so many of a hundred (rounded
    down) are drawn; rank counts them from 1 by falling score, ties to the smaller key. rank is null for all others.

    Null and empty texts have no features and weight 0. Keys may be null (drawn with the noise of an empty key, last among ties) or
    repeat; repeated rows share their score and get ranks of their own. An empty target or empty docs count as no features.
    Other columns are neither read nor returned.

    Texts are read twice, once to count and once to weigh, and never shuffled. The driver holds two counts a bucket. Weights are
    written once to the checkpoint folder, 40 bytes a document, and only rows long enough are ranked.
    """
    gain = gains(bucket_counts(target, target_text, longest, buckets), bucket_counts(docs, text, longest, buckets), buckets)
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    key_type = docs.schema[key].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "t"):
            found, rows, words = feature_buckets(b.column("t"), longest, buckets)
            weight = np.zeros(b.num_rows, np.int64)
            np.add.at(weight, rows, shared.value[found])
            features = np.bincount(rows, minlength=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(weight)], ["k", "n_words", "n_features", "weight"])

    weighed = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(weigh, f"k {key_type}, n_words long, n_features long, weight long")
    scored = stored(weighed.withColumn("score", F.col("weight") + _noise(F.col("k"), seed)).withColumn("r", F.monotonically_increasing_id()))
    enough = scored.where(F.col("n_words") >= least_words)
    drawn = enough.count() * percent // 100
    order = [F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("r").asc()]
    ranked = numbered_from_top(enough, order, "place").withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
    columns = [F.col("k").alias(key), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return ranked.select(*columns).unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None)).select(*columns))


def _noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a SHA-256 of seed and key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
