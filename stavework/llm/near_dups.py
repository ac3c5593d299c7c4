"""Near-duplicates by improved consistent weighted sampling of TF-IDF word shingles, banded and verified.

1. A count-min sketch of fixed size holds in how many documents each shingle of SHINGLE words stands, over all documents.
2. A shingle weighs its count in the document times its smoothed inverse document frequency. Weighted samples agree
   for two documents with the probability of their weighted Jaccard similarity; ROWS samples make a band key.
3. Equal texts are one node. In each bucket of nodes with a band key in common, members are compared with the bucket's leader,
   the node with most neighbours.
4. Pairs of a bucket that no link joins yet are found by a prefix filter on what members do not share with their leader, which
   loses none (see `differences`), so a large group of copies of one text is never compared pair by pair.
Links need the exact weighted similarity. Nodes joined by links make a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, fresh, mix64, releasing, stored, text_chunks
from .grams import PLAIN, word_grams

SHINGLE, LEAST, ROWS, BANDS = 5, 0.8, 4, 14
#: Cells in each of the two rows of the sketch, and in a block of it that travels as one value.
CELLS, CELL_BLOCK = 1 << 19, 1 << 14
#: Smoothing of the inverse document frequency, as a share of all documents: log((N + S) / (df + S)) with S = SMOOTH * N, in
#: units of that of a shingle in no document. A shingle in few documents weighs 1, one in all of them nearly nothing.
SMOOTH = 1.0
#: Members compared with one leader in one task.
SALT = 2000
#: Samples that may differ in a pair that is still compared with its leader. Each is kept to 4 bits, so at a similarity of 0.8 one
#: differs with a probability of 0.1875, and more than this many of the 56 do with 0.0001.
DIFFER = 22
_UNLIKE = " + ".join(f"bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & {0x1111111111111111}L)".replace("x", f"(brief[{i}] ^ b_brief[{i}])") for i in range(ROWS * BANDS // 16 + 1))
#: Pairs worth an exact comparison. Two texts are at most as similar as the smaller of their summed weights is to the larger; a
#: little is left for rounding.
BOUND = f"least(weight, b_weight) >= {LEAST - 1e-4} * greatest(weight, b_weight) AND unlike <= {DIFFER}"
#: Samples that may differ between a node and its home; it decides only where pairs meet.
ALIKE = 36
#: Two texts are similar if the sum of their weights' differences is at most this share of the sum of their weights.
GAP = (1 - LEAST) / (1 + LEAST)
#: What turns the key of a shingle into that of its absence.
_ABSENT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 1 << 16


def shingles(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts laid end to end: text, hash, count, ordered by both. A text of 1 to SHINGLE - 1 words has one."""
    _, _, owner, gram = word_grams(data, bounds, PLAIN, SHINGLE)
    keep = gram != 0
    n = np.bincount(owner, minlength=len(bounds) - 1)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    extra = [int.from_bytes(hashlib.blake2b(b" ".join(data[bounds[i] : bounds[i + 1]].translate(PLAIN).split()), digest_size=8).digest(), "little") | 1 for i in short]
    text, h = np.concatenate([owner[keep], short]), np.concatenate([gram[keep], np.array(extra, np.uint64)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    first = np.flatnonzero(np.r_[True, (np.diff(text) != 0) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
    return text[first], h[first], np.diff(np.r_[first, len(h)])


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(CELLS - 1)).astype(np.int64), (h >> np.uint64(40) & np.uint64(CELLS - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The count-min sketch: two rows of CELLS counts. Tasks count apart; blocks of counts are summed by block. 2 * CELLS counts reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS), np.int64)
        for b in text_chunks(batches, "t"):
            for row, at in enumerate(_cells(shingles(*buffers(b.column("t")))[1])):
                total[row] += np.bincount(at, minlength=CELLS)
        flat = total.reshape(-1, CELL_BLOCK)
        some = np.flatnonzero(flat.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([flat[i].tobytes() for i in some], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    blocks = docs.select(F.col(text).alias("t")).mapInArrow(releasing(count), "block int, counts binary")
    # first within each task's neighbours, then by block
    partial = blocks.repartition(F.col("block"), F.pmod(F.spark_partition_id(), F.lit(16))).mapInArrow(add, "block int, counts binary")
    out = np.zeros((2 * CELLS // CELL_BLOCK, CELL_BLOCK), np.int64)
    for row in partial.repartition("block").mapInArrow(add, "block int, counts binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(out.reshape(2, CELLS), np.iinfo(np.int32).max).astype(np.int32)


def frequencies(h: np.ndarray, sketch: np.ndarray, n_docs: int) -> np.ndarray:
    """Documents that have each shingle; never too few."""
    a, b = _cells(h)
    return np.clip(np.minimum(sketch[0][a], sketch[1][b]), 1, max(n_docs, 1))


def weights(h: np.ndarray, tf: np.ndarray, sketch: np.ndarray, n_docs: int) -> np.ndarray:
    smooth = SMOOTH * n_docs
    idf = np.log((n_docs + 1 + smooth) / (frequencies(h, sketch, n_docs) + smooth)) if n_docs else np.ones(len(h))
    return tf * idf / np.log((n_docs + 1 + smooth) / smooth if n_docs else np.e)


class Sampler:
    """Improved consistent weighted sampling with ROWS * BANDS samples. The variables of a (shingle, sample) pair are drawn from tables
    of _TABLE entries by a hash of the pair."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        r = rng.gamma(2, 1, _TABLE)
        self.r, self.inverse = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c, self.beta = np.log(rng.gamma(2, 1, _TABLE)).astype(np.float32), rng.random(_TABLE).astype(np.float32)
        self.odd = [np.uint64(int(x) | 1) for x in rng.integers(1 << 62, size=ROWS * BANDS)]

    def bands(self, text: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that have shingles, the BANDS band keys of each, and 4 bits of each sample, 16 samples to a number."""
        words = ROWS * BANDS // 16 + 1
        if not len(h):
            return np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, words), np.int64)
        starts = np.flatnonzero(np.r_[True, np.diff(text) != 0])
        log_w, mixed = np.log(w).astype(np.float32), mix64(h)
        low = (mixed >> np.uint64(32)).astype(np.uint32)
        keys, brief = np.empty((len(starts), BANDS), np.int64), np.zeros((len(starts), words), np.uint64)
        for band in range(BANDS):
            key = np.full(len(starts), np.uint64(band), np.uint64)
            for sample in range(band * ROWS, (band + 1) * ROWS):
                odd = self.odd[sample]
                at = (mixed * odd >> np.uint64(48)).astype(np.int32)
                beta = self.beta[at]
                t = np.floor(log_w * self.inverse[at] + beta)
                log_a = self.log_c[at] - self.r[at] * (t - beta + 1)
                order = log_a.view(np.int32)
                order = order ^ ((order >> 31) & np.int32(0x7FFFFFFF))
                what = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
                least = np.minimum.reduceat((order.astype(np.int64) << 32) | what.astype(np.int64), starts)
                drawn = (least & 0xFFFFFFFF).astype(np.uint64)
                key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + drawn)
                brief[:, sample // 16] |= (mix64(drawn) & np.uint64(15)) << np.uint64(sample % 16 * 4)
            keys[:, band] = key.view(np.int64)
        return text[starts], keys, brief.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (hashes, weights): sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 1.0


def _signed(docs: DataFrame, model: Broadcast) -> DataFrame:
    """Of rows r, k, t: r, k, digest (of the text), weight (the sum of its shingles'), brief (4 bits of each sample) and bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n_docs = model.value
        sampler = Sampler()
        for b in text_chunks(batches, "t"):
            data, bounds = buffers(b.column("t"))
            text, h, tf = shingles(data, bounds)
            w = weights(h, tf, sketch, n_docs)
            which, keys, short = sampler.bands(text, h, w)
            total = np.bincount(text, w, b.num_rows).astype(np.float32)
            n = np.zeros(b.num_rows, np.int64)
            n[which] = BANDS
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(keys.ravel()))
            briefs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n // BANDS * short.shape[1])].astype(np.int32)), pa.array(short.ravel()))
            digests = [hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("k"), pa.array(digests, pa.binary()), pa.array(total), briefs, lists], ["r", "k", "digest", "weight", "brief", "bands"])

    kind = docs.schema["k"].dataType.simpleString()
    return docs.select("r", "k", "t").mapInArrow(releasing(run), f"r long, k {kind}, digest binary, weight float, brief array<long>, bands array<long>")


def _dealt(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with a's text t, by b and salt, b's own text first (a = b): up to SALT partners of b meet it in a task, one after
    another, and only b's shingles are held meanwhile. texts: r and t."""
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    salted = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("salt"))
    leaders = parts.select(F.col("b").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    rows = salted.unionByName(leaders).hint("merge").join(texts.withColumnRenamed("r", "a"), "a")
    return rows.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a") != F.col("b"), "a").select("a", "b", "t")


Weighed = tuple[np.ndarray, np.ndarray]


def _with_leader(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, int]) -> Iterator[list[tuple[int, int, Weighed, Weighed]]]:
    """From rows of _dealt, lists of (a, b, shingles and weights of a, those of b)."""
    sketch, n_docs = model
    held, leader = None, None
    for batch in text_chunks(batches, "t"):
        text, h, tf = shingles(*buffers(batch.column("t")))
        w = weights(h, tf, sketch, n_docs)
        cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
        met = []
        for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
            own = h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]
            if a == b:
                held, leader = (own[0].copy(), own[1].copy()), b
            elif leader == b:
                met.append((a, b, own, held))
        yield met


def _similar(pairs: DataFrame, texts: DataFrame, model: Broadcast) -> DataFrame:
    """Those of pairs (a, b) whose weighted similarity is LEAST or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for met in _with_leader(batches, model.value):
            found = [(a, b) for a, b, own, held in met if weighted_jaccard(own, held) >= LEAST]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return _dealt(pairs, texts).mapInArrow(releasing(run), "a long, b long")


def differences(own: Weighed, leader: Weighed) -> tuple[np.ndarray, np.ndarray, bool, float, float]:
    """What tells a text from the leader of its group: keys, their amounts, near (similar to the leader), and two bounds.

    Let d(x) be the signed difference of x's weights to the leader's, |d(x)| the sum of its amounts, |x| that of x's weights and
    O(x, y) the sum of the lesser amounts where d(x) and d(y) have one sign. The weights of x and y differ by |d(x)| + |d(y)| -
    2 O(x, y), so they are similar if and only if O(x, y) >= (|d(x)| + |d(y)| - GAP (|x| + |y|)) / 2. Of a pair that the leader does not join,
    one text at least is not near: |d(y)| > GAP (|y| + |leader|). Then O(x, y) is at least half of |d(x)| + GAP (|leader| - |x|), the first
    bound of x, and at least half of |d(y)| - GAP (|leader| + |y|), the second one of y, as |x| <= |leader| + |d(x)|. With keys in one
    order for all texts of the group, two such texts share a key that is in the last part of neither, where a last part is the most keys from
    the end whose amounts add up to less than the bound. It holds with any order; with the keys of most texts last, few texts share one.
    """
    (h, w), (g, v) = own, leader
    _, i, j = np.intersect1d(h, g, assume_unique=True, return_indices=True)
    d = w.copy()
    d[i] -= v[j]
    gone = np.ones(len(g), bool)
    gone[j] = False
    more, less = d > 0, d < 0
    keys, amounts = np.concatenate([h[more], h[less] ^ _ABSENT, g[gone] ^ _ABSENT]), np.concatenate([d[more], -d[less], v[gone]])
    total, sums, top = float(amounts.sum()), float(w.sum()), float(v.sum())
    slack = 1e-5 * (sums + top)
    return keys, amounts, total <= GAP * (sums + top), (total + GAP * (top - sums)) / 2 - slack, (total - GAP * (top + sums)) / 2 - slack


_KEYED = pa.schema([("node", pa.int64()), ("leader", pa.int64()), ("near", pa.bool_()), ("first", pa.float64()), ("second", pa.float64()), ("key", pa.int64()), ("amount", pa.float64())])


def _keyed(pairs: DataFrame, texts: DataFrame, model: Broadcast) -> DataFrame:
    """For pairs (a, b) of a node and its leader a row for each of its differences; a near node has one with a null key as well.
    Shingles of one document only are left out: no other text has the key, and it comes first in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n_docs = model.value
        for met in _with_leader(batches, model.value):
            columns: list[list[np.ndarray]] = [[] for _ in _KEYED]
            close = []
            for a, b, own, held in met:
                rare = own[0][frequencies(own[0], sketch, n_docs) == 1]
                keys, amounts, near, first, second = differences(own, held)
                if near:
                    close.append({"node": a, "leader": b, "near": True})
                seen = ~np.isin(keys, rare)
                n = int(seen.sum())
                for column, x in zip(columns, (a, b, near, first, second), strict=False):
                    column.append(np.repeat(x, n))
                columns[5].append(keys[seen].view(np.int64))
                columns[6].append(amounts[seen])
            if met:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, _KEYED, strict=True)], schema=_KEYED)
            if close:
                yield pa.RecordBatch.from_pylist(close, _KEYED)

    return _dealt(pairs, texts).mapInArrow(releasing(run), "node long, leader long, near boolean, first double, second double, key long, amount double")


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node joined to it) for every node of links (a, b), by rounds of least neighbour and of root's root."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
    roots = stored(roots)
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("next"))
        up = roots.select(F.col("node").alias("next"), F.col("root").alias("over"))
        new = stored(step.join(up, "next", "left").select("node", F.col("root").alias("was"), F.coalesce(F.least("next", "over"), F.col("next")).alias("root")))
        moved = new.where("was <> root").limit(1).count()
        roots = new.select("node", "root")
        if not moved:
            return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """One row per row of docs: r (the column row, or its number in docs as read), key, class_id (least key of its class), class_size, kept
    (true for one row of each class, that of the least key).

    Equal texts are in one class; null and empty texts have no shingles and are alike among themselves only. Texts under
    SHINGLE words have one shingle. Null keys come last when the least is taken. Other columns are dropped. docs is read
    once, its rows numbered and stored, unless row names a column of distinct numbers; then it is read again for each use.
    """
    spark = docs.sparkSession
    numbered = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("r"), F.col(key).alias("k"), F.col(text).alias("t"))
    if row is None:
        numbered = stored(numbered)
    n_docs = numbered.count()
    model = spark.sparkContext.broadcast((document_frequencies(numbered, "t"), n_docs))
    signed = stored(_signed(numbered, model))
    nodes = stored(signed.groupBy("digest").agg(F.min("r").alias("node"), F.first("weight").alias("weight"), F.first("brief").alias("brief"), F.first("bands").alias("bands")))
    members = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(sizes, ["band", "value"]))
    # a bucket's leader is the member with most neighbours in all buckets: the text that others were made from, if it is there
    central = members.groupBy("node").agg((-F.sum("size")).alias("rank"))
    ranked = members.join(central, "node").withColumn("rank", F.struct("rank", F.xxhash64("node"), "node"))
    leaders = ranked.groupBy("band", "value").agg(F.min("rank").alias("rank")).select("band", "value", "rank", F.col("rank.node").alias("leader"))
    members = stored(members.join(leaders, ["band", "value"]))
    # texts are merged, never joined by a broadcast, so that their joins are planned alike at every size
    texts = stored(numbered.hint("merge").join(members.select(F.col("node").alias("r")).distinct(), "r").select("r", F.coalesce("t", F.lit("")).alias("t")))

    facts = nodes.select("node", "weight", "brief")
    led = members.groupBy("node", "leader").agg(F.first("rank").alias("rank"))
    led = led.join(facts, "node").join(facts.select(F.col("node").alias("leader"), F.col("weight").alias("b_weight"), F.col("brief").alias("b_brief")), "leader")
    led = stored(led.select("node", "leader", "rank", "weight", "b_weight", F.expr(_UNLIKE).alias("unlike")))
    links = stored(_similar(led.where("node <> leader").where(BOUND).select(F.col("node").alias("a"), F.col("leader").alias("b")), texts, model))
    roots = components(links)

    # A node's home is the most central of its leaders that looks like it. Pairs with one home meet at their home, the others at
    # the leaders of the buckets that they share. Buckets of two, or of one class, have nothing left to find.
    homes = led.where(f"unlike <= {ALIKE}").groupBy("node").agg(F.min("rank").alias("home")).select("node", F.col("home.node").alias("home"))
    now = members.join(roots, "node", "left").join(homes, "node", "left")
    now = now.select("band", "value", "node", "leader", "size", F.coalesce("root", "node").alias("root"), F.coalesce("home", "node").alias("home"))
    open_ = now.groupBy("band", "value").agg(F.min("root").alias("x"), F.max("root").alias("y"), (F.min("home") != F.max("home")).alias("strangers")).where("x <> y").select("band", "value", "strangers")
    unlike = now.where("size > 2").join(open_, ["band", "value"]).select("node", F.explode(F.array("home", F.when(F.col("strangers"), F.col("leader")))).alias("leader"))
    unlike = unlike.where("leader <> node").distinct().select(F.col("node").alias("a"), F.col("leader").alias("b"))
    known = now.select("node", "root", "home").distinct()
    keyed = stored(_keyed(unlike, texts, model).join(known, "node"))
    # keys of one node come first in the order, so the sums from its end don't need them
    counts = keyed.where("key IS NOT NULL").groupBy("leader", "key").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y"), F.min("home").alias("p"), F.max("home").alias("q")).where("n > 1")
    order = Window.partitionBy("leader", "node").orderBy(F.desc("n"), "key").rowsBetween(Window.unboundedPreceding, 0)
    shown = keyed.join(counts, ["leader", "key"]).withColumn("rest", F.sum("amount").over(order)).withColumn("half", F.expr("rest >= first"))
    shown = stored(shown.where("(half OR (NOT near AND rest >= second)) AND x <> y AND (p <> q OR p = leader)").select("leader", "key", "node", "root", "home", "near", "half", "rest", F.expr("first + second").alias("need")))
    far = shown.where("NOT near").select("leader", "key", *(F.col(c).alias(f"b_{c}") for c in ("node", "root", "home", "half", "rest", "need")))
    # at the first key that a pair shares, what each text has left must be enough for the O(x, y) that the pair needs
    met = shown.where("half").join(far, ["leader", "key"]).where("root <> b_root AND (home <> b_home OR home = leader) AND (near OR b_half AND node < b_node) AND 2 * least(rest, b_rest) >= need + b_need")
    found = _similar(met.select(F.col("node").alias("a"), F.col("b_node").alias("b")).distinct(), texts, model)
    more = stored(found.unionByName(keyed.where("key IS NULL").select(F.col("node").alias("a"), F.col("leader").alias("b"))))
    if more.limit(1).count():
        # classes joined by the new links, then the classes of all nodes
        joined = more.join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        joined = components(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
        roots = known.join(joined.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))

    by_text = nodes.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    rows = signed.select("r", "k", "digest").join(by_text, "digest").select("r", "k", "root")
    first = F.struct(F.col("k").isNull().alias("null"), "k", "r")
    classes = rows.groupBy("root").agg(F.count("*").alias("class_size"), F.min(first).alias("first"))
    out = rows.join(classes, "root")
    return out.select("r", F.col("k").alias(key), F.col("first.k").alias("class_id"), "class_size", (F.col("r") == F.col("first.r")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class of near-duplicates; all columns as they were. docs is read once and stored with row numbers."""
    number = fresh("_r", docs)
    rows = stored(docs.withColumn(number, F.monotonically_increasing_id()))
    gone = near_duplicates(rows, key, text, number).where("NOT kept").select(F.col("r").alias(number))
    return rows.join(gone, number, "left_anti").drop(number)
