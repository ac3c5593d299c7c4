"""All metrics of a song that a combined score needs, from one reading of its notes on both sides (see songwise).

Each equals what the operator named beside it gives for the song; sums and tests run over one song's arrays, and values are rounded as there.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.parts import met
from ..functions.special import kolmogorov_p, normal_p, student_p
from . import roundtrip, scores
from . import tracks as kinds
from .notes import PPQ
from .significance import ALPHA, FEWEST
from .songwise import Side, each_song
from .statistics import BINS
from .structure import TOGETHER

COMPARED = ("pitch", "velocity", "duration", "interval")
RANKED = ("pitch", "velocity", "duration")
NAN = float("nan")
#: Pairs of notes that are listed at once. It bounds memory, not results.
MOST_PAIRS = 1 << 18
#: How many pitch classes a set of them, a bit each, has.
_BITS = np.array([i.bit_count() for i in range(1 << 12)])
#: What all numbers of pitch classes divide.
_SHARES = math.lcm(*range(1, 13))


def _known(x: np.ndarray) -> np.ndarray:
    lost = np.isnan(x)
    return x[~lost] if lost.any() else x


def _counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of both sides in order, and how often each side has them."""
    values, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    return values, np.bincount(place[: len(x)], minlength=len(values)).astype(float), np.bincount(place[len(x) :], minlength=len(values)).astype(float)


def _distance(values: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov and Wasserstein distance (distribution_tests)."""
    if not x.any() or not y.any():
        return NAN, NAN
    d = np.abs(np.cumsum(x) / x.sum() - np.cumsum(y) / y.sum())
    return float(d.max()), float((d[:-1] * np.diff(values)).sum())


def _rank_z(x: np.ndarray, y: np.ndarray) -> float:
    """Normal score of counts by value (mann_whitney)."""
    n, m = x.sum(), y.sum()
    if not n or not m:
        return NAN
    u, t = float((x * (np.cumsum(y) - y + y / 2)).sum()), x + y
    sd = np.sqrt(n * m / 12 * (n + m + 1 - (t * t * t - t).sum() / max((n + m) * (n + m - 1), 1.0)))
    return float((max(u, n * m - u) - n * m / 2 - 0.5) / sd) if sd > 0 else 0.0


def _signed_z(d: np.ndarray) -> float:
    """Normal score of paired differences (wilcoxon)."""
    d = d[d != 0]
    n = float(len(d))
    if n < 2:
        return NAN
    _, place, c = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    up, c = np.bincount(place[d > 0], minlength=len(c)).astype(float), c.astype(float)
    rank = np.cumsum(c) - c + (c + 1) / 2
    w = min((up * rank).sum(), ((c - up) * rank).sum())
    return float((w - n * (n + 1) / 4) / np.sqrt(n * (n + 1) * (2 * n + 1) / 24 - (c * c * c - c).sum() / 48))


def _paired_t(d: np.ndarray, pairs: int) -> float:
    """Mean difference over its standard error; NaN where differences don't vary (paired_t)."""
    if len(d) < 2 or d.max() == d.min():
        return NAN
    return float(d.mean() / (d.std(ddof=1) / np.sqrt(pairs)))


def _pearson(x: np.ndarray, y: np.ndarray) -> float:
    both = ~(np.isnan(x) | np.isnan(y))
    x, y = x[both], y[both]
    if len(x) < 2:
        return NAN
    x, y = x - x.mean(), y - y.mean()
    spread = (x * x).sum() * (y * y).sum()
    return float((x * y).sum() / np.sqrt(spread)) if spread > 0 else NAN


def _binned(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Jensen-Shannon divergence and Hellinger distance of binned values (binned_distances)."""
    if not len(x) or not len(y):
        return NAN, NAN
    v = np.concatenate([x, y])
    known = _known(v)
    lo, hi = (known.min(), known.max()) if len(known) else (0.0, 0.0)
    place = np.fmin(np.floor((v - lo) * BINS / (hi - lo)), BINS - 1).astype(np.intp) if hi > lo else np.zeros(len(v), np.intp)
    p, q = np.bincount(place[: len(x)], minlength=BINS) / len(x), np.bincount(place[len(x) :], minlength=BINS) / len(y)
    part = lambda c: float((c[c > 0] * np.log(2 * c[c > 0] / (p + q)[c > 0])).sum())
    return (part(p) + part(q)) / 2, float(np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum() / 2))


def _information(x: np.ndarray, y: np.ndarray, width: int = 5) -> float:
    """Mutual information over the greater entropy (mutual_information); null is a value like others."""
    if not len(x):
        return NAN
    (_, i), (_, j) = (np.unique(np.floor(v / width), return_inverse=True) for v in (x, y))
    table = np.bincount(i * (j.max() + 1) + j, minlength=(i.max() + 1) * (j.max() + 1)).reshape(i.max() + 1, -1) / len(x)
    px, py = table.sum(axis=1), table.sum(axis=0)
    at = table > 0
    top = max(-float((px * np.log(px)).sum()), -float((py * np.log(py)).sum()))
    return float((table[at] * np.log(table[at] / np.outer(px, py)[at])).sum()) / top if top > 1e-12 else 0.0


def _quartile(x: np.ndarray, share: float) -> float:
    """Of sorted values, between neighbours in proportion."""
    at = (len(x) - 1) * share
    lo, hi = int(np.floor(at)), int(np.ceil(at))
    return float(x[lo]) if lo == hi else float((hi - at) * x[lo] + (at - lo) * x[hi])


def _outlying(x: np.ndarray) -> np.ndarray:
    """Whether values are outliers by 1.5 interquartile ranges; null isn't."""
    known = np.sort(_known(x))
    if not len(known):
        return np.zeros(len(x), bool)
    low, high = _quartile(known, 0.25), _quartile(known, 0.75)
    return (x < low - (high - low) * 1.5) | (x > high + (high - low) * 1.5)


def _share(flags: np.ndarray, x: np.ndarray) -> float:
    n = len(_known(x))
    return float(flags.sum()) / n if n else NAN


def _stationary(x: np.ndarray) -> bool | None:
    """Whether the halves are like the whole (stationary)."""
    if len(x) < 20:
        return True
    first, second, whole = (_known(v) for v in (x[: len(x) // 2], x[len(x) // 2 :], x))
    if not len(first) or not len(second):
        return None
    close = lambda d, of: d / of < 0.2 if of > 0 else d < 1
    return bool(close(abs(first.mean() - second.mean()), whole.mean()) and close(abs(first.std() - second.std()), whole.std()))


def _slope(y: np.ndarray) -> float:
    """Slope of values over their places, from whole sums."""
    at = np.flatnonzero(~np.isnan(y))
    k, x = len(at), (at + 1).astype(float)
    y = y[at]
    sx, sy, sxx, sxy = (int(v) for v in (x.sum(), y.sum(), (x * x).sum(), (x * y).sum()))
    return (k * sxy - sx * sy) / (k * sxx - sx * sx) if k > 1 else NAN


def _trend(x: np.ndarray, y: np.ndarray) -> float:
    """Likeness of slopes (trend_similarity)."""
    if not len(x) or not len(y):
        return NAN
    if len(x) < 10 or len(y) < 10:
        return 0.5
    s, t = _slope(x), _slope(y)
    top = np.fmax(abs(s), abs(t))
    return float(1 - abs(s - t) / (2 * top)) if top > 0 else 1.0


def _values(s: Side) -> dict[str, np.ndarray]:
    return {"pitch": _known(s.pitch), "velocity": _known(s.velocity), "duration": _known(s.end_tick - s.start_tick), "interval": _known(np.diff(s.pitch))}


def _statistics(cubed: Callable[[np.ndarray], np.ndarray], most: int) -> tuple[str, Callable[[Side, Side], tuple]]:
    schema = ", ".join(f"n_{f} long, m_{f} long, ks_{f} double" for f in COMPARED) + ", wasserstein double, " + ", ".join(f"z_{f} double" for f in RANKED)
    schema += """, divergence double, hellinger double, pitch_r double, velocity_r double, duration_r double, information double, pairs long, signed_z double, t double, outliers_original double,
        outliers_reconstructed double, outliers_kept double, stationary_original boolean, stationary_reconstructed boolean, trend double, x array<double>, y array<double>"""

    def of(a: Side, b: Side) -> tuple:
        x, y = _values(a), _values(b)
        counts = {f: _counts(x[f], y[f]) for f in COMPARED}
        distances = {f: _distance(*c) for f, c in counts.items()}
        pairs = min(len(a), len(b))
        d = _known(a.pitch[:pairs] - b.pitch[:pairs])
        lengths = [s.end_tick[:pairs] - s.start_tick[:pairs] for s in (a, b)]
        (c, e) = (cubed(s.pitch) for s in (a, b))
        out, too = _outlying(c), _outlying(e)
        kept = np.zeros(len(out), bool)
        kept[:pairs] = too[:pairs]
        return (
            *(v for f in COMPARED for v in (len(x[f]), len(y[f]), distances[f][0])), distances["velocity"][1], *(_rank_z(*counts[f][1:]) for f in RANKED), *_binned(a.pitch, b.pitch),
            _pearson(a.pitch[:pairs], b.pitch[:pairs]), _pearson(a.velocity[:pairs], b.velocity[:pairs]), _pearson(*lengths), _information(a.pitch[:pairs], b.pitch[:pairs]), pairs, _signed_z(d), _paired_t(d, pairs),
            _share(out, c), _share(too, e), float(kept[out].mean()) if out.any() else NAN, _stationary(a.pitch) if len(a) else None, _stationary(b.pitch) if len(b) else None, _trend(a.pitch, b.pitch), a.pitch[:most], b.pitch[:most],
        )

    return schema, of


def statistics(a: DataFrame, b: DataFrame, outlying: Callable[[np.ndarray], np.ndarray] = lambda pitch: pitch, most: int = 100) -> DataFrame:
    """What statistical scores need, one row a song with enough values of a feature on both sides for a comparison of distributions: the least p-value of Kolmogorov-Smirnov
    tests, distances, correlations, significance, outliers (of pitches put through outlying), stationarity, trend, and warping of the first `most` pitches."""
    c, six = F.col, lambda x: F.round(x, 6)
    m = each_song(a, b, _statistics(outlying, most))
    # a song without a number is compared by its distributions only
    numbered = lambda x: F.when(c("song_id").isNotNull(), x)
    enough = lambda f: (c(f"n_{f}") >= FEWEST) & (c(f"m_{f}") >= FEWEST)
    ks = F.least(*(F.when(enough(f), six(kolmogorov_p(c(f"ks_{f}"), c(f"n_{f}"), c(f"m_{f}")))) for f in COMPARED))
    m = m.where(" OR ".join(f"(n_{f} >= {FEWEST} AND m_{f} >= {FEWEST})" for f in COMPARED))
    # p-values of 0 are no valid ones for the rank tests and count as 1 for the paired ones (significance)
    valid = lambda p: F.when(p > 0, p)
    one = F.lit(1.0)
    ranks = [valid(F.when(c(f"z_{f}") > 0, c(f"p_{f}")).when(c(f"z_{f}").isNotNull(), one)) for f in RANKED]
    paired = [F.when(c("pairs") > 0, F.coalesce(valid(F.when(c("signed_z").isNotNull(), c("p_signed")).otherwise(one)), one)), F.when(c("pairs") > 1, F.coalesce(valid(F.when(c("t").isNotNull(), c("p_t")).otherwise(one)), one))]
    m = m.withColumns({f"p_{f}": normal_p(c(f"z_{f}")) for f in RANKED} | {"p_signed": normal_p(c("signed_z")), "p_t": student_p(c("t"), c("pairs") - 1), "warped": F.pandas_udf(scores._warped, DoubleType())("x", "y")})
    m = m.withColumns({"ranks": F.array_compact(F.array(*ranks)), "tests": F.array_compact(F.array(*ranks, *paired))})
    plain = ("wasserstein", "divergence", "hellinger", "pitch_r", "velocity_r", "duration_r", "information", "outliers_original", "outliers_reconstructed", "outliers_kept", "trend")
    values = {n: six(c(n)) for n in plain} | {"wasserstein": F.when(enough("velocity"), six(c("wasserstein"))), "stationary_original": c("stationary_original"), "stationary_reconstructed": c("stationary_reconstructed")}
    values["warping"] = F.when((F.size("x") > 0) & (F.size("y") > 0), six(c("warped") / (F.size("x") + F.size("y"))))
    values["p_value"] = F.when(F.size("ranks") > 0, six(F.aggregate("ranks", F.lit(0.0), lambda s, p: s + p) / F.size("ranks")))
    values["significant"] = F.size(F.filter("tests", lambda p: p < ALPHA)) * 2 > F.size("tests")
    return m.select("song_id", ks.alias("ks_p"), *(numbered(v).alias(n) for n, v in values.items()))


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of the histograms of two lists of values; NaN if one is empty."""
    _, p, q = _counts(_known(x), _known(y))
    spread = (p * p).sum() * (q * q).sum()
    return float((p * q).sum() / np.sqrt(spread)) if spread else NAN


def _likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Cosine of histograms, 0 if one is empty, NaN if both are (cosines)."""
    some = len(_known(x)) + len(_known(y))
    return (0.0 if np.isnan(r := _cosine(x, y)) else r) if some else NAN


def _chords(s: Side) -> np.ndarray:
    """The pitch classes of a song's chords in order, a bit each (chords)."""
    known = ~np.isnan(s.start_tick)
    start, pitch = s.start_tick[known], s.pitch[known]
    if not len(start):
        return np.zeros(0, np.int64)
    cut = np.append(True, np.diff(start) > TOGETHER)
    begins = np.flatnonzero(cut)
    ends = np.append(begins[1:], len(start))
    wide = start[ends - 1] - start[begins] > TOGETHER
    for lo, hi in zip(begins[wide], ends[wide], strict=True):
        while lo < hi:
            lo += int(np.searchsorted(start[lo:hi], start[lo] + TOGETHER, side="right"))
            if lo < hi:
                cut[lo] = True
    bits = np.where(np.isnan(pitch), 0, 1 << np.mod(np.nan_to_num(pitch), 12).astype(np.int64))
    return np.bitwise_or.reduceat(bits, np.flatnonzero(cut))


def _chord_likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Mean Jaccard likeness of the i-th chords times the lesser count over the greater (chord_similarity)."""
    n = min(len(x), len(y))
    both, either = _BITS[x[:n] & y[:n]], _BITS[x[:n] | y[:n]]
    both, either = both[either > 0], either[either > 0]
    # a whole sum of shares: its last place doesn't depend on the order of the chords
    return int((both * (_SHARES // either)).sum()) * n / (_SHARES * len(both) * max(len(x), len(y))) if len(both) else 0.0


def _tracks(s: Side) -> list[tuple[float, np.ndarray]]:
    """Tracks in order, null last, and the places of their notes in note order."""
    if not len(s):
        return []
    order = np.argsort(s.track_idx, kind="stable")
    track = np.where(np.isnan(s.track_idx), np.inf, s.track_idx)[order]
    cuts = np.flatnonzero(track[1:] != track[:-1]) + 1
    return [(float(s.track_idx[own[0]]), own) for own in np.split(order, cuts)]


def _overlap(start: np.ndarray, end: np.ndarray, pitch: np.ndarray) -> tuple[int, float]:
    """Pairs of a track's notes that sound together and the sum of their pitch distances (overlap_interval). Few pairs are listed; of many, those with each pitch are counted."""
    known = ~(np.isnan(start) | np.isnan(pitch))
    start, end, pitch = start[known], end[known], pitch[known]
    after = np.arange(1, len(start) + 1)
    until = np.maximum(np.where(np.isnan(end), 0, np.searchsorted(start, end)), after)
    count = until - after
    pairs = int(count.sum())
    if not pairs:
        return 0, 0.0
    if pairs <= MOST_PAIRS:
        i = np.repeat(after - 1, count)
        j = np.arange(pairs) - np.repeat(np.cumsum(count) - count, count) + i + 1
        return pairs, float(np.abs(pitch[i] - pitch[j]).sum())
    total = 0.0
    for p in np.unique(pitch):
        upto = np.append(0, np.cumsum(pitch == p))
        total += float((np.abs(pitch - p) * (upto[until] - upto[after])).sum())
    return pairs, total


def _interval(s: Side, tracks: list[tuple[float, np.ndarray]]) -> float:
    """Mean pitch distance of notes of a track that sound together; NaN without any."""
    found = [_overlap(s.start_tick[at], s.end_tick[at], s.pitch[at]) for track, at in tracks if not np.isnan(track)]
    pairs = sum(n for n, _ in found)
    return sum(d for _, d in found) / pairs if pairs else NAN


def _levels(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many notes of a track sound at once, and for how long, silence left out (polyphony)."""
    t = np.concatenate([start, end])
    at, place = np.unique(np.where(np.isnan(t), -np.inf, t), return_inverse=True)
    level, ticks = np.cumsum(np.bincount(place, np.repeat([1.0, -1.0], len(start)), len(at)))[:-1], np.diff(at)
    sounds = (level > 0) & np.isfinite(ticks)
    return level[sounds], ticks[sounds]


def _mean_polyphony(start: np.ndarray, end: np.ndarray) -> float:
    level, ticks = _levels(start, end)
    return float((level * ticks).sum() / ticks.sum()) if len(ticks) else NAN


def _sampled(start: np.ndarray, end: np.ndarray, every: int = 100) -> float:
    """Mean number of notes at the sample points (sampled_polyphony)."""
    inside, last = _known(np.ceil(end / every) - np.ceil(start / every)), np.ceil(_known(end) / every)
    return float(inside.sum() / last.max()) if len(inside) and last.max() else NAN


HARMONY = (
    "chords double, chords_original long, chords_reconstructed long, intervals double, interval_original double, interval_reconstructed double, in_original boolean, polyphonies_original array<double>, polyphonies_reconstructed array<double>"
)


def _harmony(a: Side, b: Side) -> tuple:
    x, y = _chords(a), _chords(b)
    own, other = _tracks(a), _tracks(b)
    steps = [np.concatenate([np.abs(np.diff(s.pitch[at])) for _, at in tracks]) if tracks else np.zeros(0) for s, tracks in ((a, own), (b, other))]
    polyphony = [_mean_polyphony(a.start_tick[at], a.end_tick[at]) for track, at in own if not np.isnan(track)]
    sampled = [_sampled(b.start_tick[at], b.end_tick[at]) for _, at in other]
    return (_chord_likeness(x, y), len(x), len(y), _cosine(*steps), _interval(a, own), _interval(b, other), len(a) > 0, _known(np.array(polyphony, float)), _known(np.array(sampled, float)))


def _mean(values: str) -> Column:
    """Mean of an array's values, rounded before; null if it has none."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + F.round(x, 6)) / F.size(values))


def _harmony_columns() -> dict[str, Column]:
    c, six = F.col, lambda x: F.round(x, 6)
    x, y = (F.coalesce(six(c(n)), F.lit(0.0)) for n in ("interval_original", "interval_reconstructed"))
    n, m = c("chords_original"), c("chords_reconstructed")
    return {
        "chords": six(c("chords")), "intervals": six(c("intervals")), "voicing": F.when(c("in_original"), (x == 0) | (y == 0) | (F.abs(x - y) / x < 0.2)), "rhythm_kept": F.abs(n - m) <= 0.2 * F.greatest(n, m),
        "polyphony_original": _mean("polyphonies_original"), "polyphony_reconstructed": _mean("polyphonies_reconstructed"),
    }


#: Songs with a number and a chord on one side or the other.
_CHORDED = "song_id IS NOT NULL AND chords_original + chords_reconstructed > 0"


def harmony(a: DataFrame, b: DataFrame) -> DataFrame:
    """What scores.harmony() needs, one row a song that has chords: likeness of chords and intervals, voicing, harmonic rhythm, and mean polyphony of both sides."""
    return each_song(a, b, (HARMONY, _harmony)).where(_CHORDED).select("song_id", *(v.alias(n) for n, v in _harmony_columns().items()))


FEATURES = "noted boolean, pitches double, classes double, octaves double, rhythms double, groove boolean, range_kept boolean, shift double, drift double"


def _frequent_gaps(s: Side, top: int = 5) -> np.ndarray:
    """The most frequent gaps between starts, of equally frequent ones the smaller (groove_kept)."""
    values, n = np.unique(_known(np.diff(s.start_tick)), return_counts=True)
    return values[np.lexsort((values, -n))[:top]]


def _features(a: Side, b: Side, slack: int = 2, least: int = 3) -> tuple:
    pitches = [_known(s.pitch) for s in (a, b)]
    gaps = [np.diff(s.start_tick) for s in (a, b)]
    moved = [g[(g > 0) & ~np.isnan(np.diff(s.pitch))] for g, s in zip(gaps, (a, b), strict=True)]
    x, y = pitches
    both = len(x) > 0 and len(y) > 0
    kept = bool(abs(x.min() - y.min()) <= slack and abs(x.max() - y.max()) <= slack) if both else None
    pairs = min(len(a), len(b))
    late = _known(np.abs(a.start_tick[:pairs] - b.start_tick[:pairs]))
    return (
        len(x) + len(y) + sum(len(_known(g)) for g in gaps) > 0, _likeness(x, y), _likeness(np.mod(x, 12), np.mod(y, 12)), _likeness(np.floor(x / 12), np.floor(y / 12)), _cosine(*moved),
        len(np.intersect1d(_frequent_gaps(a), _frequent_gaps(b))) >= least if len(a) else None, kept, float(y.mean() - x.mean()) if both else NAN, float(late.mean()) if len(late) else NAN,
    )


def _feature_columns() -> dict[str, Column]:
    """Of the rows of _features and _harmony; those of songs without a number are compared by pitch only."""
    numbered = lambda x: F.when(F.col("song_id").isNotNull(), x)
    own = {n: F.round(n, 6) for n in ("pitches", "classes", "octaves")}
    own |= {n: numbered(F.round(n, 6)) for n in ("rhythms", "shift", "drift")} | {n: numbered(F.col(n)) for n in ("groove", "range_kept")}
    h = _harmony_columns()
    none = lambda x: F.coalesce(x, F.lit(0.0))
    h["polyphony"] = scores.polyphony_kept(none(h.pop("polyphony_original")), none(h.pop("polyphony_reconstructed")))
    return own | {n: F.when(F.expr(_CHORDED), F.coalesce(h[n], F.lit(False) if n == "voicing" else F.lit(0.0))) for n in ("chords", "intervals", "polyphony", "voicing")}


def features(a: DataFrame, b: DataFrame, tempo: DataFrame) -> DataFrame:
    """What scores.fidelity() needs, one row a song that has notes on a side: likeness of pitches, rhythm, groove, range and harmony, and the tempo's stability (song_id, stability)."""
    own = each_song(a, b, (FEATURES, _features), (HARMONY, _harmony)).where("noted").select("song_id", *(v.alias(n) for n, v in _feature_columns().items()))
    return met([own, tempo.groupBy("song_id").agg(F.max("stability").alias("tempo"))], ["song_id"])


MATCHED = "original long, reconstructed long, missing long, extra long, timing_errors long, velocity_errors long"


def _matched(a: Side, b: Side) -> tuple:
    """Errors of a song whose tracks are matched by the serial rule (matches, track_errors, song_metrics)."""
    sides = []
    for side, s in enumerate((a, b)):
        notes = np.column_stack([getattr(s, c) for c in ("track_idx", "start_tick", "end_tick", "pitch", "velocity")])
        notes = notes[~np.isnan(notes).any(axis=1)].astype(np.int64)
        due = notes[:, 1] + (0 if side else roundtrip.WINDOW)
        sides.append(np.column_stack([np.full(len(notes), side), due, notes]))
    rows = np.concatenate(sides)
    side, due, track, start, end, pitch, velocity = rows.T
    order = np.lexsort((velocity, end, pitch, start, -side, due, track))
    own = rows[order]
    missing = extra = late = loud = 0
    cuts = np.flatnonzero(np.diff(own[:, 2])) + 1
    for notes in np.split(own, cuts) if len(own) else ():
        free = dict(zip(*(v.tolist() for v in np.unique(notes[notes[:, 0] == 1, 5], return_counts=True)), strict=True))
        for note, partner, start_diff, _, velocity_diff, _ in roundtrip._greedy(map(tuple, notes[:, [0, 3, 4, 5, 6]].tolist()), free):
            if partner is None:
                missing += 1
            elif note is None:
                extra += 1
            else:
                late += start_diff > roundtrip.START
                loud += velocity_diff > roundtrip.VELOCITY
    return len(sides[0]), len(sides[1]), missing, extra, late, loud


#: What track classification looks at, a list of tracks each.
TRACK = ("track", "avg_polyphony", "max_polyphony", "min_pitch", "max_pitch", "avg_pitch", "density", "empty_ratio", "avg_duration", "note_onset_variance")


def _covered(start: np.ndarray, end: np.ndarray) -> float:
    """Ticks in which a note of the track sounds (covered_time); notes in order of start and end."""
    reach = np.fmax.accumulate(end)
    begins = np.flatnonzero(np.append(True, ~(start[1:] <= reach[:-1])))
    spans = _known(np.fmax.reduceat(end, begins) - np.fmin.reduceat(start, begins))
    return float(spans.sum()) if len(spans) else NAN


def _of_tracks(a: Side, _: Side) -> tuple:
    """Statistics of the original tracks (track_statistics)."""
    mean = lambda x: float(x.mean()) if len(x) else NAN
    rows = []
    for track, at in _tracks(a):
        if np.isnan(track):
            continue
        start, end, pitch = a.start_tick[at], a.end_tick[at], _known(a.pitch[at])
        level, ticks = _levels(start, end)
        starts, ends, gaps = _known(start), _known(end), _known(np.diff(start))
        length = (ends.max() - starts.min()) / PPQ if len(starts) and len(ends) else NAN
        order = np.lexsort((np.nan_to_num(end, nan=-np.inf), np.nan_to_num(start, nan=-np.inf)))
        rows.append((
            track, float((level * ticks).sum() / ticks.sum()) if len(ticks) else NAN, level.max() if len(level) else NAN, pitch.min() if len(pitch) else NAN, pitch.max() if len(pitch) else NAN, mean(pitch),
            len(at) / length if length > 0 else 0.0, 1 - _covered(start[order], end[order]) / PPQ / length if length > 0 else 0.0, mean(_known(end - start)) / PPQ, (float(gaps.std()) if len(gaps) else 0.0) / PPQ,
        ))
    return tuple(zip(*rows, strict=True)) if rows else ((),) * len(TRACK)


def quality(a: DataFrame, b: DataFrame, tempo: DataFrame, tracks: DataFrame) -> DataFrame:
    """What corpus.suggestions() needs, one row a song that has whole notes: errors of matching, fidelity, mean polyphony, and whether a track is a drum track (drums, 0 or 1).

    tempo: song_id, stability; tracks: song_id, track_idx, name, is_drum. Notes are shuffled once; only rows a track or song besides.
    """
    own = each_song(a, b, (FEATURES, _features), (HARMONY, _harmony), (MATCHED, _matched), (", ".join(f"{c} array<double>" for c in TRACK), _of_tracks)).where("song_id IS NOT NULL AND original + reconstructed > 0")
    counts = ("original", "reconstructed", "missing", "extra", "timing_errors", "velocity_errors")
    statistics_of = F.map_from_arrays(F.transform("track", lambda t: t.cast("int")), F.arrays_zip(*TRACK[1:]))
    own = own.select("song_id", *(v.alias(n) for n, v in _feature_columns().items()), *counts, _mean("polyphonies_original").alias("mean_polyphony"), F.map_entries(statistics_of).alias("statistics"))
    named = tracks.groupBy("song_id").agg(F.collect_list(F.struct("track_idx", "name", "is_drum")).alias("tracks"))
    m = met([own, tempo.groupBy("song_id").agg(F.max("stability").alias("tempo")), named], ["song_id"])
    m = scores.fidelity(m, *counts, "mean_polyphony", "tracks", "statistics")
    m = m.select("song_id", F.col("overall").alias("musical"), *counts, "mean_polyphony", F.map_from_entries("statistics").alias("statistics"), F.explode_outer("tracks").alias("t"))
    m = m.withColumn("s", F.try_element_at("statistics", F.col("t.track_idx")))
    typed = kinds.typed(m.select("song_id", "musical", *counts, "mean_polyphony", "t.*", *(F.col(f"s.{c}") for c in TRACK[1:])))
    drums = F.max(F.when(F.col("type") == "drums", 1).otherwise(0)).alias("drums")
    songs = typed.groupBy("song_id").agg(drums, *(F.max(c).alias(c) for c in ("musical", *counts, "mean_polyphony")))
    return songs.select("song_id", "musical", F.col("mean_polyphony").alias("polyphony"), "drums", F.col("original").alias("notes"), *(v.alias(n) for n, v in roundtrip.ratios().items() if n != "extra_ratio"))
