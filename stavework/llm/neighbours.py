"""Approximate nearest neighbours from several shifted Hilbert orderings of projected vectors.

Each curve projects vectors onto a few random directions (inside the principal components that hold most of a sample's variance), shifts
them on a grid and orders them by Hilbert key. Spark deals the rows by curve and key range; a query goes to the range of its own key and
to the two ranges beside it. Inside a range, queries are compared with vectors in one byte a component; the best of all ranges and
curves are merged and measured again on the original vectors.

How wide ranges are is measured, not given: the nearest neighbours of a bounded number of queries are found among all rows, and the
narrowest ranges are taken whose windows hold the stated share of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Curves; dimensions and bits a dimension of a Hilbert key.
CURVES, DIMS, BITS = 8, 8, 7
#: Vectors that projections are fitted to, and queries that the width of ranges is measured with, at most.
FIT, PROBES = 2048, 128
#: Quantiles of keys that ranges are made of, and the numbers of ranges to choose from.
FINE, RANGES = 1024, (1024, 768, 512, 384, 256, 192, 128, 96, 64, 48, 40, 32, 28, 24, 20, 18, 16, 14, 12, 11, 10, 9, 8, 7, 6, 5, 4, 1)
#: Rows and queries of a range that one task compares; wider ranges are dealt in pieces.
ROWS, QUERIES = 1 << 16, 1 << 13


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid coordinates below 2**bits (by Skilling's transposed form), as int64."""
    x = cells.T.astype(np.uint32)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(len(x)):
            high = (x[i] >> np.uint32(level) & np.uint32(1)).astype(bool)
            swapped = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swapped)
            x[i] ^= swapped if i else np.uint32(0)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> np.uint32(level) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> np.uint32(level) & np.uint32(1)).astype(np.int64)
    return key


@dataclass
class Curves:
    """For each curve: projection, and the offset and factor that bring projected vectors into the grid."""

    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fitted(cls, sample: np.ndarray, curves: int, seed: int) -> Curves:
        rng = np.random.default_rng(seed)
        centred = sample - sample.mean(axis=0)
        largest = np.abs(centred).max(initial=0.0)
        _, s, axes = np.linalg.svd(centred / (largest or 1.0), full_matrices=False)
        held = np.cumsum(s**2) / max((s**2).sum(), 1e-300)
        axes = axes[: max(int(np.searchsorted(held, 0.9)) + 1, min(DIMS, len(axes)))]
        parts = []
        for _ in range(curves):
            turn = np.linalg.qr(rng.normal(size=(len(axes), min(DIMS, len(axes)))))[0]
            projection = axes.T @ turn
            y = sample @ projection
            low, high = np.quantile(y, 0.001, axis=0), np.quantile(y, 0.999, axis=0)
            span = np.where(high > low, high - low, 1.0)
            # the vectors fill half of the grid a side; the shift says which half
            parts.append((projection, low / span - rng.uniform(0, 1, len(low)), 0.5 / span))
        return cls(parts)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        out = np.empty((len(vectors), len(self.parts)), np.int64)
        for c, (projection, offset, factor) in enumerate(self.parts):
            with np.errstate(over="ignore", invalid="ignore"):
                place = np.nan_to_num((vectors @ projection) * factor - 0.5 * offset)
            out[:, c] = hilbert_keys((np.clip(place, 0, 1 - 2.0**-BITS) * (1 << BITS)).astype(np.uint32), BITS)
        return out


def _matrix(column: pa.Array, type_: np.dtype, width: int) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), type_).reshape(len(column), width)


def _squares(queries: np.ndarray, codes: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Squared distances of queries from coded vectors."""
    rows = codes.astype(np.float64) * scales[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        out = (queries**2).sum(axis=1)[:, None] + (rows**2).sum(axis=1)[None] - 2 * (queries @ rows.T)
    return np.where(np.isnan(out), np.inf, np.maximum(out, 0))


class _Best:
    """For each query the few nearest of all rows seen so far, with one number a row."""

    def __init__(self, queries: np.ndarray, few: int) -> None:
        self.queries, self.few = queries, few
        self.far, self.who = np.full((len(queries), few), np.inf), np.full((len(queries), few), -1, np.int64)

    def see(self, codes: np.ndarray, scales: np.ndarray, who: np.ndarray) -> None:
        for r in range(0, len(codes), 4096):
            for q in range(0, len(self.queries), 512):
                own = slice(q, q + 512)
                far = np.concatenate([self.far[own], _squares(self.queries[own], codes[r : r + 4096], scales[r : r + 4096])], axis=1)
                new = np.concatenate([self.who[own], np.broadcast_to(who[r : r + 4096], (len(far), len(who[r : r + 4096])))], axis=1)
                at = np.argpartition(far, self.few - 1, axis=1)[:, : self.few]
                self.far[own], self.who[own] = np.take_along_axis(far, at, 1), np.take_along_axis(new, at, 1)


def _usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (zeros without sign) and a 128-bit hash h1, h2 of v, of all rows that take part."""
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"
    zero = F.lit(0).cast(kind)
    v = F.transform(F.col(vector).cast(f"array<{kind}>"), lambda x: F.when(x == zero, zero).otherwise(x))
    rows = vectors.select(F.col(key).alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast(kind))) & F.exists("v", lambda x: x != zero))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc()).first()
    return rows.where(F.size("v") == F.lit(sizes["n"] if sizes else 0)).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))


def _coded(nodes: DataFrame, curves: Curves) -> DataFrame:
    """node, asks, keys (one a curve), code (a byte a component), scale, and the vector of nodes that ask, in doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(b.num_rows, -1)
            scale = np.abs(x).max(axis=1) / 127
            code = np.rint(x / scale[:, None]).astype(np.int8)
            asks = np.asarray(b.column("asks"))
            keys = curves.keys(x)
            offsets = pa.array(np.arange(b.num_rows + 1) * keys.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("asks"), pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(scale),
                 pa.array([r.tobytes() if a else None for r, a in zip(x, asks, strict=True)], pa.binary())],
                ["node", "asks", "keys", "code", "scale", "query"],
            )

    return nodes.select("node", "asks", "v").mapInArrow(run, "node long, asks boolean, keys array<long>, code binary, scale double, query binary")


def _cuts(coded: DataFrame, curves: int) -> np.ndarray:
    """Quantiles of each curve's keys over all nodes."""
    at = F.lit([i / FINE for i in range(1, FINE)])
    row = coded.agg(*(F.percentile_approx(F.col("keys")[c], at, 20 * FINE).alias(f"c{c}") for c in range(curves))).first()
    return np.array([row[f"c{c}"] for c in range(curves)], np.int64).reshape(curves, FINE - 1)


def _places(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """In which of FINE ranges the keys lie, curve by curve."""
    return np.stack([np.searchsorted(cuts[c], keys[:, c], "right") for c in range(len(cuts))], axis=1)


def measured_ranges(coded: DataFrame, cuts: np.ndarray, nodes: int, k: int, goal: float) -> int:
    """The largest number of ranges whose windows hold `goal` of the k nearest of at most PROBES asking nodes, found among all nodes."""
    probes = coded.where("asks").orderBy(F.xxhash64("query"), "node").limit(PROBES).select("keys", "query").collect()
    if not probes or nodes <= k:
        return 1
    queries = np.array([np.frombuffer(p["query"], np.float64) for p in probes])
    own = _places(np.array([p["keys"] for p in probes]), cuts)
    shared = coded.sparkSession.sparkContext.broadcast(queries)
    width = queries.shape[1]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, keys = _Best(shared.value, k + 1), {}
        for b in batches:
            if b.num_rows:
                who = np.asarray(b.column("node"))
                best.see(_matrix(b.column("code"), np.int8, width), np.asarray(b.column("scale")), who)
                new = np.flatnonzero(np.isin(who, best.who))
                keys.update(zip(who[new].tolist(), b.column("keys").take(pa.array(new)).to_pylist(), strict=True))
                keys = {n: keys[n] for n in best.who.ravel().tolist() if n in keys}
        probe, at = np.nonzero(best.who >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int32)), pa.array(best.far[probe, at]), pa.array([keys[n] for n in best.who[probe, at].tolist()], pa.list_(pa.int64()))], ["probe", "far", "keys"])

    ranked = F.row_number().over(Window.partitionBy("probe").orderBy("far"))
    # the nearest of all is the probe itself
    found = coded.select("node", "keys", "code", "scale").mapInArrow(near, "probe int, far double, keys array<long>").withColumn("n", ranked).where((F.col("n") > 1) & (F.col("n") <= k + 1)).collect()
    theirs, mine = _places(np.array([r["keys"] for r in found]), cuts), own[[r["probe"] for r in found]]
    for ranges in RANGES:
        if ranges * 4 * k <= nodes and (np.abs(theirs * ranges // FINE - mine * ranges // FINE) <= 1).any(axis=1).mean() >= goal:
            return ranges
    return 1


def _dealt(coded: DataFrame, cuts: np.ndarray, ranges: int, row_pieces: int, query_pieces: int) -> DataFrame:
    """Every node in its range of every curve, and every asking node in its own range and the two beside it (kind 0, first in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node = np.asarray(b.column("node"))
            keys = np.asarray(b.column("keys").flatten()).reshape(b.num_rows, -1)
            block = _places(keys, cuts) * ranges // FINE
            asking = np.flatnonzero(np.asarray(b.column("asks")))
            for c in range(keys.shape[1]):
                for p in range(query_pieces):
                    yield _cells(c, block[:, c], node % row_pieces, np.full(len(node), p), 1, node, b.column("scale"), b.column("code"))
                for beside in (-1, 0, 1):
                    own = block[asking, c] + beside
                    at = asking[(own >= 0) & (own < ranges)]
                    if len(at):
                        few = b.take(pa.array(at))
                        for p in range(row_pieces):
                            yield _cells(c, block[at, c] + beside, np.full(len(at), p), node[at] % query_pieces, 0, node[at], few.column("scale"), few.column("query"))

    return coded.mapInArrow(run, "curve int, block int, row_piece int, query_piece int, kind int, node long, scale double, data binary")


def _cells(curve: int, block: np.ndarray, row_piece: np.ndarray, query_piece: np.ndarray, kind: int, node: np.ndarray, scale: pa.Array, data: pa.Array) -> pa.RecordBatch:
    n = len(node)
    numbers = [np.full(n, curve), block, row_piece, query_piece, np.full(n, kind)]
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in numbers), pa.array(node), scale, data], ["curve", "block", "row_piece", "query_piece", "kind", "node", "scale", "data"])


def _scanned(dealt: DataFrame, width: int, few: int) -> DataFrame:
    """The few nearest coded nodes of each query in each cell. Rows stream by; a cell's queries are held."""
    cell = ["curve", "block", "row_piece", "query_piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, who, held, best = None, [], [], None

        def result() -> pa.RecordBatch:
            asked = np.concatenate(who)
            row, at = np.nonzero(best.who >= 0)
            return pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(best.who[row, at]), pa.array(best.far[row, at])], ["asked", "node", "far"])

        for b in batches:
            numbers = np.stack([np.asarray(b.column(c)) for c in [*cell, "kind"]], axis=1)
            edges = np.flatnonzero((numbers[1:] != numbers[:-1]).any(axis=1)) + 1
            for a, z in zip([0, *edges], [*edges, b.num_rows], strict=True):
                if a == z:
                    continue
                part, key = b.slice(a, z - a), tuple(numbers[a, :4])
                if key != now:
                    if best is not None:
                        yield result()
                    now, who, held, best = key, [], [], None
                if numbers[a, 4] == 0:
                    who.append(np.asarray(part.column("node")))
                    held.append(_matrix(part.column("data"), np.float64, width))
                elif who:
                    best = best or _Best(np.concatenate(held), few)
                    best.see(_matrix(part.column("data"), np.int8, width), np.asarray(part.column("scale")), np.asarray(part.column("node")))
        if best is not None:
            yield result()

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *cell).sortWithinPartitions(*cell, "kind").mapInArrow(run, "asked long, node long, far double")


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """h1, h2 and the smallest ids (at most `most`) of vectors that several ids share. A common vector's rows are thinned in 64 parts."""
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("id")
    thinned = rows.select("h1", "h2", "id", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).withColumn("n", F.dense_rank().over(salted)).where(F.col("n") <= most)
    return thinned.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.collect_set("id")), 1, most).alias("ids")).where(F.size("ids") > 1)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, goal: float = 0.96, curves: int = CURVES, seed: int = 13) -> DataFrame:
    """The k nearest rows found for each row whose key is divisible by `every`: query_id, rank (from 1), key, score (distance).

    Nearness is the Euclidean distance in double precision, ties go to the smaller key; score is measured on the original vectors. A
    query's own row is no candidate, copies of it are. Fewer than k candidates give fewer rows.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without a key, nor vectors
    of another length than the commonest (ties: the longest). Rows equal in key and vector count once; rows equal in key only
    are rows of their own, and a query then leaves out itself, by key, among the copies of its vector only. Other columns don't
    matter. An empty table gives an empty result.

    Equal vectors are one node with its k + 1 smallest keys, so a vector on a third of the rows costs no more than another. Nodes are
    written once, their codes and curve keys once, both to the checkpoint folder; each curve shuffles codes of a byte a
    component. The driver holds FIT vectors, PROBES queries with their neighbours' keys, and FINE quantiles a curve.
    """
    rows = _usable(vectors, key, vector)
    grouped = rows.groupBy("v").agg(F.min("id").alias("id"), F.bool_or(F.col("id") % every == 0).alias("asks"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("node"), "id", "asks", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    sample = np.array([r["v"] for r in nodes.orderBy("h1", "h2").limit(FIT).select("v").collect()], np.float64)
    id_type = vectors.schema[key].dataType.simpleString()
    name = "id" if key in ("query_id", "rank", "score") else key
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], f"query_id {id_type}, rank int, {name} {id_type}, score double")
    total, asking = nodes.agg(F.count("*"), F.count_if("asks")).first()
    coded = stored(_coded(nodes, Curves.fitted(sample, curves, seed)))
    cuts = _cuts(coded, curves)
    ranges = measured_ranges(coded, cuts, total, k, goal)
    if ranges == 1:
        coded, cuts = coded.withColumn("keys", F.slice("keys", 1, 1)), cuts[:1]
    dealt = _dealt(coded, cuts, ranges, -(-total // (ranges * ROWS)), -(-3 * asking // (ranges * QUERIES)) or 1)
    few = 2 * k + 1
    scanned = _scanned(dealt, sample.shape[1], few).groupBy("asked", "node").agg(F.min("far").alias("far"))
    merged = scanned.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy("far", "node"))).where(F.col("n") <= few).select("asked", "node")
    asked = nodes.where("asks").select(F.col("node").alias("asked"), F.col("v").alias("w"))
    measured = merged.join(nodes.select("node", "id", "v", "h1", "h2"), "node").join(asked, "asked").select("asked", "id", "h1", "h2", _distance("v", "w").alias("score"))
    ids = F.explode(F.coalesce("ids", F.array("id"))).alias("id")
    spread = measured.join(_copies(rows, k + 1), ["h1", "h2"], "left").select("asked", "score", ids)
    lists = spread.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("near"))
    mine = rows.where(F.col("id") % every == 0).select("id", "h1", "h2").distinct().join(nodes.select("h1", "h2", F.col("node").alias("asked")), ["h1", "h2"])
    others = F.filter("near", lambda x: (x["id"] != F.col("own")) | (x["score"] > 0))
    ranked = mine.withColumnRenamed("id", "own").join(lists, "asked").select("own", F.posexplode(F.slice(others, 1, k)).alias("at", "x"))
    return ranked.select(F.col("own").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(name), F.col("x.score").alias("score"))
