"""Statistical comparison of two note tables by song. Values are counted first, so windows run over distinct values where order allows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .compare import ORDER, histograms

#: Fixed value: equal bins between the least and the largest value of both sides.
BINS = 49
#: Pairs of a song that are held before they are counted. It bounds memory, not results.
MOST_PENDING = 1 << 18


def binned_distances(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Jensen-Shannon divergence (nats), Hellinger and total variation distance of the binned values of songs on both sides."""
    h = histograms(a, b, value)
    bounds = h.groupBy("song_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("original").alias("n"), F.sum("reconstructed").alias("m")).where("n > 0 AND m > 0")
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("value") - F.col("lo")) * BINS / (F.col("hi") - F.col("lo"))), F.lit(BINS - 1))).otherwise(0)
    bins = h.join(bounds, "song_id").groupBy("song_id", "n", "m", place.alias("bin")).agg(F.sum("original").alias("x"), F.sum("reconstructed").alias("y"))
    p, q = F.col("x") / F.col("n"), F.col("y") / F.col("m")
    part = lambda c: F.when(c > 0, c * F.log(2 * c / (p + q))).otherwise(0.0)
    return bins.groupBy("song_id").agg(
        F.round(F.sum(part(p) + part(q)) / 2, 6).alias("jensen_shannon"), F.round(F.sqrt(F.sum((F.sqrt(p) - F.sqrt(q)) ** 2) / 2), 6).alias("hellinger"), F.round(F.sum(F.abs(p - q)) / 2, 6).alias("total_variation")
    )


def mean_rank(value: Column | str, *by: str) -> Column:
    """Rank of a value within by, ties at their mean: that of the first and the last of equals, both by one order and so one sort."""
    order = Window.partitionBy(*by).orderBy(value)
    return (F.rank().over(order) + F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2


def spearman(pairs: DataFrame) -> DataFrame:
    ranks = pairs.select("song_id", *(mean_rank(c, "song_id").alias(c) for c in ("pitch_a", "pitch_b", "velocity_a", "velocity_b")))
    return ranks.groupBy("song_id").agg(F.round(F.corr("pitch_a", "pitch_b"), 6).alias("pitch"), F.round(F.corr("velocity_a", "velocity_b"), 6).alias("velocity"))


def _marked(notes: DataFrame) -> DataFrame:
    """Place of each note in its song, and whether its pitch is an outlier by 1.5 interquartile ranges or by more than 3 deviations."""
    limits = notes.groupBy("song_id").agg(F.percentile("pitch", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.avg("pitch").alias("mean"), F.stddev_pop("pitch").alias("sd"))
    low, high = F.col("q")[0], F.col("q")[1]
    n = F.row_number().over(Window.partitionBy("song_id").orderBy(*ORDER))
    out = notes.select("song_id", "pitch", n.alias("n")).join(limits, "song_id")
    return out.select("song_id", "n", ((F.col("pitch") < low - (high - low) * 1.5) | (F.col("pitch") > high + (high - low) * 1.5)).alias("iqr"), (F.abs(F.col("pitch") - F.col("mean")) > F.col("sd") * 3).alias("z"))


def outliers(notes: DataFrame) -> DataFrame:
    return _marked(notes).groupBy("song_id").agg(F.count_if("z").alias("zscore"), F.count_if("iqr").alias("iqr"), F.round(F.avg(F.col("iqr").cast("int")), 6).alias("ratio"))


def outliers_kept(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of a song's outliers whose place holds an outlier on the other side too; songs without outliers are left out."""
    other = _marked(b).select("song_id", "n", F.col("iqr").alias("too"))
    return _marked(a).where("iqr").join(other, ["song_id", "n"], "left").groupBy("song_id").agg(F.round(F.avg(F.coalesce(F.col("too").cast("int"), F.lit(0))), 6).alias("kept"))


def stationary(notes: DataFrame) -> DataFrame:
    """Whether mean and deviation of pitch in the halves of a song differ by less than a fifth of the whole's; true under 20 notes."""
    w = Window.partitionBy("song_id")
    half = notes.select("song_id", "pitch", (F.row_number().over(w.orderBy(*ORDER)) <= F.floor(F.count("*").over(w) / 2)).alias("first"))
    x, y = F.when(F.col("first"), F.col("pitch")), F.when(~F.col("first"), F.col("pitch"))
    s = half.groupBy("song_id").agg(F.count("*").alias("n"), F.abs(F.avg(x) - F.avg(y)).alias("dm"), F.abs(F.stddev_pop(x) - F.stddev_pop(y)).alias("ds"), F.avg("pitch").alias("m"), F.stddev_pop("pitch").alias("s"))
    close = lambda d, whole: F.when(F.col(whole) > 0, F.col(d) / F.col(whole) < 0.2).otherwise(F.col(d) < 1)
    return s.select("song_id", ((F.col("n") < 20) | (close("dm", "m") & close("ds", "s"))).alias("stationary"))


def trend_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Likeness of the slopes of pitch over place; 0.5 where a side has fewer than 10 notes."""
    n = F.row_number().over(Window.partitionBy("song_id").orderBy(*ORDER))
    side = lambda df, s: df.select("song_id", "pitch", n.alias("n")).groupBy("song_id").agg(F.regr_slope("pitch", "n").alias(f"s{s}"), F.count("*").alias(f"n{s}"))
    top = F.greatest(F.abs("s1"), F.abs("s2"))
    like = F.when(top > 0, 1 - F.abs(F.col("s1") - F.col("s2")) / (2 * top)).otherwise(1.0)
    return side(a, 1).join(side(b, 2), "song_id").select("song_id", F.round(F.when((F.col("n1") < 10) | (F.col("n2") < 10), 0.5).otherwise(like), 6).alias("similarity"))


def overlap_interval(notes: DataFrame, bar: int = 1920) -> DataFrame:
    """Pairs of notes of a track that sound together, and their mean pitch distance, by song. A note meets those that start in the
    bars it sounds in, each pair in one bar, so no whole track is paired."""
    k = notes.select("song_id", "track_idx", "start_tick", "end_tick", "pitch", F.row_number().over(Window.partitionBy("song_id", "track_idx").orderBy("start_tick", "pitch", "end_tick", "velocity")).alias("k"))
    first = k.where("end_tick > start_tick").select("*", F.explode(F.sequence(F.floor(F.col("start_tick") / bar), F.floor((F.col("end_tick") - 1) / bar))).alias("bar"))
    later = k.select("song_id", "track_idx", F.floor(F.col("start_tick") / bar).alias("bar"), F.col("k").alias("k2"), F.col("start_tick").alias("start2"), F.col("pitch").alias("pitch2"))
    met = first.join(later, ["song_id", "track_idx", "bar"]).where("k < k2 AND start2 < end_tick")
    return met.groupBy("song_id").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs(F.col("pitch") - F.col("pitch2"))), 6).alias("interval"))


def voicing_kept(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether the mean interval of sounding pairs stays within a fifth; true where a side has none."""
    x, y = (overlap_interval(df).select("song_id", F.col("interval").alias(n)) for df, n in ((a, "x"), (b, "y")))
    both = a.select("song_id").distinct().join(x, "song_id", "left").join(y, "song_id", "left").na.fill(0.0, ["x", "y"])
    return both.select("song_id", ((F.col("x") == 0) | (F.col("y") == 0) | (F.abs(F.col("x") - F.col("y")) / F.col("x") < 0.2)).alias("kept"))


def groove_kept(a: DataFrame, b: DataFrame, top: int = 5, least: int = 3) -> DataFrame:
    """Whether the most frequent gaps between starts of both sides share least or more; among equally frequent gaps the smaller goes first."""

    def gaps(df: DataFrame) -> DataFrame:
        gap = F.col("start_tick") - F.lag("start_tick").over(Window.partitionBy("song_id").orderBy(*ORDER))
        counts = df.select("song_id", gap.alias("gap")).where("gap IS NOT NULL").groupBy("song_id", "gap").count()
        return counts.withColumn("n", F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc("count"), "gap"))).where(F.col("n") <= top).select("song_id", "gap")

    shared = gaps(a).join(gaps(b), ["song_id", "gap"]).groupBy("song_id").agg(F.count("*").alias("shared"))
    return a.select("song_id").distinct().join(shared, "song_id", "left").select("song_id", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("shared", F.lit(0)) >= least).alias("kept"))


def _table_tau(u: np.ndarray, v: np.ndarray, c: np.ndarray) -> float:
    """Tau-b of a contingency table: places u and v, and how often they occur together (a place may come more than once)."""
    (_, i), (_, j) = np.unique(u, return_inverse=True), np.unique(v, return_inverse=True)
    table = np.zeros((i.max() + 1, j.max() + 1))
    np.add.at(table, (i, j), c)
    before = np.zeros((table.shape[0] + 1, table.shape[1] + 1))
    before[1:, 1:] = table.cumsum(axis=0).cumsum(axis=1)
    # of the pairs with a smaller x, those with a smaller y less those with a greater one
    sign = before[:-1, :-1] + before[:-1, 1:] - before[:-1, -1:]
    n, a, b = table.sum(), table.sum(axis=1), table.sum(axis=0)
    whole, tied_x, tied_y = n * (n - 1) / 2, (a * (a - 1)).sum() / 2, (b * (b - 1)).sum() / 2
    return float((table * sign).sum() / np.sqrt((whole - tied_x) * (whole - tied_y))) if whole > tied_x and whole > tied_y else 0.0


def _tau(x: pd.Series, y: pd.Series, count: pd.Series) -> pd.Series:
    return pd.Series([_table_tau(u, v, c) for u, v, c in zip(x, y, count, strict=True)], dtype=float)


def kendall(pairs: DataFrame, x: str = "pitch_a", y: str = "pitch_b") -> DataFrame:
    """Kendall's tau-b by song, 0 where a side doesn't vary. Pairs are counted by (x, y) first, at most 128 squared counts a song for pitches; concordant
    ones are then summed by two-dimensional prefix sums of these counts, so nothing is joined."""
    c = pairs.groupBy("song_id", F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")).agg(F.count("*").alias("c"))
    lists = c.groupBy("song_id").agg(F.collect_list(F.struct("x", "y", "c")).alias("t"))
    return lists.select("song_id", F.round(F.pandas_udf(_tau, DoubleType())("t.x", "t.y", "t.c"), 6).alias("tau"))


def kendall_of_sides(a: DataFrame, b: DataFrame, value: str = "pitch") -> DataFrame:
    """kendall() of the values of compare.paired(a, b), without making the pairs: both sides are shuffled once and lie in one sort, by song, side and note order.

    A task holds one song's values of the first side, 8 bytes a note, and the counts of its pairs."""
    side = lambda df, n: df.where("song_id IS NOT NULL").select(F.col("song_id").cast("long").alias("song_id"), F.lit(n).cast("byte").alias("side"), *ORDER)
    rows = side(a, 0).unionByName(side(b, 1)).repartition("song_id").sortWithinPartitions("song_id", "side", *ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        song, held, met, table, pending = None, [], 0, [], 0
        done: list[tuple[int, float]] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.float64())], ["song_id", "tau"])

        def counted() -> list[np.ndarray]:
            return [np.concatenate(x) for x in zip(*table, strict=True)]

        for batch in batches:
            songs, values = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            second = batch.column(1).to_numpy() == 1
            cuts = np.flatnonzero(np.diff(songs)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(songs)], strict=True) if len(songs) else ():
                if songs[lo] != song:
                    if table:
                        done.append((song, _table_tau(*counted())))
                    song, held, met, table, pending = int(songs[lo]), [], 0, [], 0
                middle = hi - int(second[lo:hi].sum())
                held.append(values[lo:middle])
                if middle < hi:
                    held = [np.concatenate(held)] if len(held) > 1 else held
                    x = held[0][met : met + hi - middle]
                    met += len(x)
                    if len(x):
                        table.append((x, values[middle : middle + len(x)], np.ones(len(x))))
                        pending += len(x)
                    if pending > MOST_PENDING:
                        c = pd.DataFrame(dict(zip("xyc", counted(), strict=True))).groupby(["x", "y"], dropna=False, as_index=False)["c"].sum()
                        table, pending = [tuple(c[k].to_numpy() for k in "xyc")], 0
            if len(done) >= 10_000:
                yield out()
                done = []
        if table:
            done.append((song, _table_tau(*counted())))
        yield out()

    return rows.select("song_id", "side", value).mapInArrow(run, "song_id long, tau double").select("song_id", F.round("tau", 6).alias("tau"))


def mutual_information(pairs: DataFrame, width: int = 5) -> DataFrame:
    """Mutual information of paired pitches in bins, over the greater of both entropies; 0 where that is 0."""
    cell = lambda c: F.floor(F.col(c) / width)
    joint = pairs.groupBy("song_id", cell("pitch_a").alias("x"), cell("pitch_b").alias("y")).agg(F.count("*").alias("c"))
    by = lambda *k: F.sum("c").over(Window.partitionBy("song_id", *k))
    j = joint.select("song_id", "x", "y", "c", by().alias("n"), by("x").alias("cx"), by("y").alias("cy"))
    p = lambda c: F.col(c) / F.col("n")
    # a margin's entropy is summed over the joint cells: each adds its share of the margin's term
    s = j.groupBy("song_id").agg(F.sum(p("c") * F.log(p("c") / (p("cx") * p("cy")))).alias("mi"), (-F.sum(p("c") * F.log(p("cx")))).alias("hx"), (-F.sum(p("c") * F.log(p("cy")))).alias("hy"))
    top = F.greatest("hx", "hy")
    return s.select("song_id", F.round(F.when(top > 1e-12, F.col("mi") / top).otherwise(0.0), 6).alias("information"))


def sequence(notes: DataFrame, value: str = "pitch") -> DataFrame:
    """song_id, x: a song's values in note order, as one array of 8 bytes a note."""
    ordered = F.array_sort(F.collect_list(F.struct(*ORDER, F.col(value).cast("double").alias("x"))))
    return notes.groupBy("song_id").agg(F.transform(ordered, lambda e: e["x"]).alias("x"))


def _peak(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Peak and lag of each row's two arrays, cut to the shorter; null under 10 values."""
    peaks, lags = [], []
    for u, v in zip(x, y, strict=True):
        n = min(len(u), len(v))
        if n < 10:
            peaks.append(None)
            lags.append(None)
            continue
        a, b = ((w[:n] - w[:n].mean()) / (w[:n].std() + 1e-10) for w in (u, v))
        size = 1 << (2 * n - 1).bit_length()
        full = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size) / n
        lag = np.arange(-(n // 2), n - n // 2)
        r = np.round(full[lag], 6)
        best = int(np.argmax(np.abs(r)))
        peaks.append(float(r[best]))
        lags.append(int(lag[best]))
    return pd.DataFrame({"peak": pd.array(peaks, "Float64"), "lag": pd.array(lags, "Int32")})


def cross_correlation(a: DataFrame, b: DataFrame, value: str = "pitch") -> DataFrame:
    """Peak, by amount, of the correlation of both sides' z-scored values over all lags of up to half their number, and its lag (the least among equals
    in six places). Songs with 10 notes or more on both sides; the longer is cut to the shorter. A song's two arrays meet once and are
    correlated by a Fourier transform, so nothing is paired lag by lag."""
    both = sequence(a, value).join(sequence(b, value).withColumnRenamed("x", "y"), "song_id")
    return both.select("song_id", F.pandas_udf(_peak, "peak double, lag int")("x", "y").alias("r")).where("r.lag IS NOT NULL").select("song_id", "r.peak", "r.lag")


def _lagged(x: pd.Series, most: pd.Series) -> pd.Series:
    """Pearson correlation of each array with itself at lags 0, 1, ...; 0 where undefined."""

    def one(u: np.ndarray, top: int) -> list[float]:
        out = []
        for lag in range(max(min(top, len(u) // 2), 1)):
            a, b = u[: len(u) - lag], u[lag:]
            a, b = a - a.mean(), b - b.mean()
            spread = np.sqrt((a * a).sum() * (b * b).sum())
            out.append(float((a * b).sum() / spread) if spread > 0 else 0.0)
        return out

    return pd.Series([one(u, t) for u, t in zip(x, most, strict=True)])


def autocorrelation(notes: DataFrame, value: str = "pitch", most: int = 50) -> DataFrame:
    """Pearson correlation of a song's values with those lag places on, for lags up to most and below half its length; 0 where undefined."""
    lists = sequence(notes, value).select("song_id", F.pandas_udf(_lagged, "array<double>")("x", F.lit(most)).alias("r"))
    return lists.select("song_id", F.posexplode("r").alias("lag", "r")).withColumn("r", F.round("r", 6))


def distribution_score(ks: Column, wasserstein: Column, divergence: Column, hellinger: Column, chi: Column) -> Column:
    """Mean of the sub-scores that there are: p-values times ten, distances from 1; 0.5 without any."""
    one = F.lit(1.0)
    scores = F.array_compact(F.array(F.when(ks > 0, F.least(one, ks * 10)), F.greatest(F.lit(0.0), 1 - wasserstein / 100), F.greatest(F.lit(0.0), 1 - divergence), 1 - hellinger, F.when(chi > 0, F.least(one, chi * 10))))
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)).otherwise(0.5)
