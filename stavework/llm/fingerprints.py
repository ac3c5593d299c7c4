"""Document fingerprints from prefix polynomial hashes.

H[i] is the polynomial hash of a text's first i code points modulo a prime. Two primes give two such arrays. A span's hash
is (H[j] - H[i]) times the inverse power at i, so any two spans are compared in constant time, and the longest common
extension of two places is found by binary search. Arrays are built block by block, so memory is bounded by the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, text_chunks

PRIMES = (2147483647, 2147483629)
BASES = (911382323 % PRIMES[0], 972663749 % PRIMES[1])
#: Code points in a window of the sketch, hashes in a sketch, and code points worked on at once.
WINDOW, SKETCH, BLOCK = 8, 32, 1 << 18


class _Powers:
    """Powers of a base modulo a prime and their inverses for exponents under BLOCK + WINDOW."""

    def __init__(self, prime: int, base: int) -> None:
        n = BLOCK + WINDOW + 1
        self.prime, self.base = np.uint64(prime), base
        self.up, self.down = self._table(base, prime, n), self._table(pow(base, -1, prime), prime, n)

    @staticmethod
    def _table(base: int, prime: int, n: int) -> np.ndarray:
        out, size = np.ones(1, np.uint64), 1
        while size < n:
            out = np.concatenate([out, out * np.uint64(pow(base, size, prime)) % np.uint64(prime)])
            size *= 2
        return out[:n]


_powers: list[_Powers] = []


def _tables() -> list[_Powers]:
    if not _powers:
        _powers.extend(_Powers(p, b) for p, b in zip(PRIMES, BASES, strict=True))
    return _powers


class PrefixHash:
    """Prefix hashes of one text of up to BLOCK + WINDOW code points."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = len(points)
        c = points.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for t in _tables():
            h = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * t.up[: self.n] % t.prime, out=h[1:])
            h %= t.prime
            self.sums.append(h)

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of width code points, the two primes packed into 62 bits."""
        n = self.n - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        parts = [(h[width:] + t.prime - h[:n]) % t.prime * t.down[:n] % t.prime for h, t in zip(self.sums, _tables(), strict=True)]
        return parts[0] << np.uint64(31) | parts[1]

    def span(self, i: int, j: int) -> tuple[int, ...]:
        return tuple((int(h[j]) - int(h[i])) * int(t.down[i]) % int(t.prime) for h, t in zip(self.sums, _tables(), strict=True))

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether length code points from i equal those of other from j (by hash)."""
        return self.span(i, i + length) == other.span(j, j + length)

    def common_extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common run that starts at i here and at j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.same(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common extension at the starts of two texts of any length, block by block."""
    at, n = 0, min(len(a), len(b))
    while at < n:
        x, y = PrefixHash(a[at : at + BLOCK]), PrefixHash(b[at : at + BLOCK])
        k = x.common_extension(0, y, 0)
        at += k
        if k < BLOCK:
            break
    return at


def sketch(points: np.ndarray) -> tuple[tuple[int, int], np.ndarray]:
    """The whole text's hash under both primes, and the SKETCH least distinct mixed hashes of its windows.

    A text shorter than a window counts as one window; an empty one has none.
    """
    whole, least, n = [0] * len(PRIMES), np.zeros(0, np.uint64), len(points)
    for at in range(0, n, BLOCK):
        part = PrefixHash(points[at : at + BLOCK + WINDOW - 1])
        own = min(BLOCK, n - at)
        for k, t in enumerate(_tables()):
            whole[k] = (whole[k] + int(part.sums[k][own]) * pow(t.base, at, int(t.prime))) % int(t.prime)
        hashes = mix64(part.windows(min(WINDOW, part.n) if n < WINDOW else WINDOW)) >> np.uint64(16)
        if len(hashes) > 8 * SKETCH:
            few = np.unique(np.partition(hashes, 4 * SKETCH)[: 4 * SKETCH])
            hashes = few if len(few) >= SKETCH else hashes
        least = np.unique(np.concatenate([least, hashes]))[:SKETCH]
    return (whole[0], whole[1]), least


def as_text(n: int, whole: tuple[int, int], least: np.ndarray) -> str:
    """length, whole hash and sketch in hexadecimal: equal texts give equal strings."""
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-" + "".join(f"{int(x):012x}" for x in least)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common windows: of the SKETCH least of both sketches together, those in both. Two empty: 1."""
    both = np.unique(np.concatenate([a, b]))[:SKETCH]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both)) if len(both) else 1.0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars and fingerprint of every text; null counts as empty. Keys may be null or repeat; other columns are dropped."""
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "t"):
            points = [code_points(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([len(p) for p in points], pa.int64()), pa.array([as_text(len(p), *sketch(p)) for p in points])], ["k", "n_chars", "fingerprint"])

    out = docs.selectExpr(f"`{key}` AS k", f"`{text}` AS t").mapInArrow(run, f"k {key_type}, n_chars long, fingerprint string")
    return out.withColumnRenamed("k", key)


def _row(key: object, text: str | None, after: str | None) -> tuple:
    a, b = code_points(text), code_points(after)
    keep = len(a) - len(a) // 4
    edited = np.concatenate([a[:keep], b[: len(a) // 4]])
    (wa, la), (we, le), (_, lb) = sketch(a), sketch(edited), sketch(b)
    sha = hashlib.sha256(edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
    return key, len(a), sha, as_text(len(a), wa, la), as_text(len(edited), we, le), likeness(la, le), likeness(la, lb), common_prefix(a, edited), common_prefix(a, b)


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", part_bytes: int = 64 << 20) -> DataFrame:
    """Every text's fingerprint against those of its edited text and of the next text in ascending key order.

    The edited text has its last floor(n / 4) code points replaced by the first as many (or all) of the next text;
    after the last comes the first. Columns: key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, prefix_edited, prefix_next (common prefixes in code points, by longest common extension).

    Null texts count as empty. Rows with the same key are ordered by text. A row with a null key has no place in
    the order: its next text is its own. A single row is its own next. Other columns are dropped.

    Texts are dealt once, by ranges of the key cut at keys of the table (taken from a sample of about 64 keys a range,
    which decides only how even the ranges are). The first rows of a range are also sent to the range before it, so
    each task reads its rows in order and knows the next text of each.
    """
    spark = docs.sparkSession
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ids = rows.select("k").where("k IS NOT NULL")
    n, first = ids.agg(F.count("*"), F.min("k")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    seen = [r[0] for r in ids.sample(min(1.0, 64 * parts / max(n, 1)), seed=1).distinct().orderBy("k").collect()]
    cuts = sorted({seen[len(seen) * i // parts] for i in range(1, parts)} - {first}) if seen else []
    starts = np.array([first, *cuts] if n else [], np.int64)
    shared = spark.sparkContext.broadcast(starts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        for b in batches:
            k = np.asarray(b.column("k").fill_null(0))
            null = np.asarray(b.column("k").is_null())
            part = np.where(null, mix64(np.arange(len(k)).astype(np.uint64)) % np.uint64(len(starts) + 1), np.searchsorted(starts, k, "right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(k), bool)), b.column("k"), b.column("t")], ["part", "guest", "k", "t"])
            if len(at := np.flatnonzero(~null & np.isin(k, starts))):
                guests = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array((part[at] - 1) % len(starts), pa.int32()), pa.array(np.ones(len(at), bool)), guests.column("k"), guests.column("t")], ["part", "guest", "k", "t"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema]

        def records() -> Iterator[tuple]:
            for b in text_chunks(batches, "t"):
                yield from zip(*(b.column(c).to_pylist() for c in ("part", "guest", "k", "t")), strict=True)

        out: list[tuple] = []
        last: tuple | None = None
        for row in records():
            part, guest, k, t = row
            if last and part == last[0] and not (last[1] or last[2] is None):
                out.append(_row(last[2], last[3], t))
                last = None
            if not guest and k is None:
                out.append(_row(None, t, t))
            last = row
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    schema = pa.schema([("k", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("prefix_edited", pa.int64()), ("prefix_next", pa.int64())])
    dealt = rows.mapInArrow(deal, "part int, guest boolean, k long, t string")
    ordered = dealt.repartitionByRange(parts, "part").sortWithinPartitions("part", "guest", F.col("k").asc_nulls_first(), "t")
    out = ordered.mapInArrow(follow, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, prefix_edited long, prefix_next long")
    return out.withColumn("k", F.col("k").cast(key_type)).withColumnRenamed("k", key)
