"""Scores, warnings and thresholds that combine metrics of a song; each operator takes a table with one row a song and the metrics as columns.

A metric that is missing (null) counts as 0 or false. Labels of warnings and suggestions come in the order of their rules, comma-joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .compare import ORDER
from .verdicts import within

#: Quality and tolerance multipliers of a use case, and of a level of complexity.
USE_CASES = {
    "research": (1.0, 0.5), "production": (0.98, 0.7), "education": (0.95, 1.0), "generation": (0.93, 1.2), "analysis": (0.96, 0.8), "archival": (0.99, 0.6), "real_time": (0.90, 1.5), "demo": (0.85, 2.0),
}
LEVELS = {"minimal": (1.05, 0.5), "simple": (1.02, 0.7), "moderate": (1.0, 1.0), "complex": (0.97, 1.3), "very_complex": (0.94, 1.6)}
#: How strict genres are about timing, pitch and dynamics.
GENRES = {
    "classical": (1.2, 1.1, 1.3), "jazz": (0.8, 1.0, 1.1), "electronic": (1.5, 1.2, 0.9), "folk": (0.9, 0.95, 0.85), "orchestral": (1.1, 1.0, 1.4), "custom": (1.0, 1.0, 0.3),
}
#: The use case that suits a level of complexity.
SUITED = {"minimal": "research", "simple": "archival", "moderate": "production", "complex": "generation", "very_complex": "real_time"}
#: Least target accuracy of a use case, and the accuracy expected of it.
TARGETS = (("research", 0.98, 0.98), ("production", 0.95, 0.95), ("generation", 0.90, 0.92), ("demo", 0.0, 0.85))


def known(m: DataFrame) -> DataFrame:
    return m.fillna(0).fillna(False)


def labels(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold."""
    return F.array_join(F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items()))), ",")


def weighted(*parts: tuple[str | Column, float]) -> Column:
    return sum(((F.col(c) if isinstance(c, str) else c) * w for c, w in parts), F.lit(0.0))


def chosen(condition: str, yes: float, no: float) -> Column:
    return F.when(F.col(condition), yes).otherwise(no)


def _per_token(m: str = "ratio") -> Column:
    return F.least(F.lit(1.0), 1 / F.greatest(F.col(m), F.lit(0.1)))


def sequence_quality(m: DataFrame) -> DataFrame:
    """Overall quality from vocabulary, coherence, compression and patterns (.2, .3, .2, .3), and the two scores that are scaled."""
    entropy = F.least(F.lit(1.0), F.col("entropy") / 5)
    vocabulary = weighted(("coverage", 0.3), ("vocabulary_efficiency", 0.4), (entropy, 0.3))
    coherence = weighted((1 - F.col("repetition"), 0.2), ("coherence", 0.3), ("consistency", 0.2), ("smoothness", 0.3))
    compression = weighted((_per_token(), 0.3), ("efficiency", 0.4), ("density", 0.3))
    patterns = weighted((chosen("structured", 1.0, 0.5), 0.3), ("regularity", 0.2), ("phrase", 0.25), ("motif", 0.25))
    overall = within(weighted((vocabulary, 0.2), (coherence, 0.3), (compression, 0.2), (patterns, 0.3)))
    return known(m).select("song_id", F.round(overall, 6).alias("overall"), F.round(F.least(F.lit(1.0), F.col("entropy") / 7), 6).alias("token_entropy"), F.round(_per_token(), 6).alias("compression_efficiency"), chosen("structured", 1.0, 0.5).alias("musical_structure"))


def sequence_advice(m: DataFrame, strategy: str = "REMI", vocabulary: int = 533) -> DataFrame:
    """Warnings about a token sequence and suggestions for its tokenization."""
    c = F.col
    warnings = {
        "vocabulary barely used": c("coverage") < 0.1, "vocabulary nearly all used": c("coverage") > 0.9, "vocabulary inefficient": c("vocabulary_efficiency") < 0.3, "low entropy": c("entropy") < 2,
        "repetitive": c("repetition") > 0.8, "incoherent": c("coherence") < 0.5, "unpredictable": c("perplexity") > 100, "poor compression": c("ratio") > 3, "inefficient encoding": c("efficiency") < 0.5,
        "no structure": ~c("structured"), "irregular bars": c("regularity") < 0.5, "poor phrases": c("phrase") < 0.3,
    }
    by_strategy = {"REMI": ("try CPWord", c("ratio") > 2), "TSD": ("try REMI or Structured", c("coherence") < 0.6), "CPWord": ("try REMI", c("phrase") < 0.5)}
    suggestions = {
        "smaller vocabulary": c("coverage") < 0.2, "larger vocabulary": c("coverage") > 0.95, "drop unused tokens": vocabulary - c("used") > vocabulary * 0.5, "more compact tokens": c("ratio") > 2.5, "finer tokens": c("ratio") < 0.5,
        "variable-length encoding": c("redundancy") > 0.7, "less repetition": c("repetition") > 0.7, "check nuances": c("complexity") < 0.3, "simpler parameters": c("complexity") > 0.9, "structural tokens": ~c("structured"),
        "other beat resolution": c("regularity") < 0.6, "check motifs": c("patterns") < 3, **dict([by_strategy[strategy]] if strategy in by_strategy else []),
    }
    return known(m).select("song_id", labels(warnings).alias("warnings"), labels(suggestions).alias("suggestions"))


def polyphony_kept(original: Column, reconstructed: Column) -> Column:
    """How much of the mean polyphony is kept, at most 1."""
    return F.round(F.when(original > 0, F.least(F.lit(1.0), reconstructed / original)).otherwise(0.0), 6)


def harmony(m: DataFrame) -> DataFrame:
    """Chord and interval similarity, voicing and harmonic rhythm, and how much of the mean polyphony is kept (at most 1)."""
    return known(m).select("song_id", "chords", "intervals", "voicing", "rhythm_kept", polyphony_kept(F.col("polyphony_original"), F.col("polyphony_reconstructed")).alias("polyphony"))


def fidelity(m: DataFrame, *more: str) -> DataFrame:
    """Overall fidelity, a quarter each of pitch, rhythm, harmony and structure, with these and warnings; more: columns that go along."""
    c = F.col
    parts = {
        "pitch": weighted(("pitches", 0.4), ("classes", 0.4), ("octaves", 0.2)),
        "rhythm": weighted(("rhythms", 0.4), ("tempo", 0.3), (chosen("groove", 1.0, 0.7), 0.3)),
        "harmony": weighted(("chords", 0.4), ("intervals", 0.3), ("polyphony", 0.3)),
        "structure": weighted((chosen("range_kept", 1.0, 0.5), 0.5), (chosen("voicing", 1.0, 0.7), 0.5)),
    }
    rules = {
        "pitch": c("pitches") < 0.8, "tessitura": F.abs("shift") > 3, "range": ~c("range_kept"), "rhythm": c("rhythms") < 0.7, "groove": ~c("groove"), "tempo": c("tempo") < 0.9,
        "drift": c("drift") > 10, "chords": c("chords") < 0.7, "voicing": ~c("voicing"), "polyphony": c("polyphony") < 0.8,
    }
    overall = within(weighted(*((x, 0.25) for x in parts.values())))
    return known(m).select("song_id", *(x.alias(n) for n, x in parts.items()), overall.alias("overall"), labels(rules).alias("warnings"), *more)


def statistical_similarity(m: DataFrame) -> DataFrame:
    """Weighted mean of the distribution score (.2), correlations (.3), significance (.2), outliers (.15) and temporal likeness (.15)."""
    c = F.col
    correlation = weighted((F.abs("pitch_r"), 0.4), (F.abs("velocity_r"), 0.2), (F.abs("duration_r"), 0.2), ("information", 0.2))
    significance = F.when(~c("significant"), 1.0).otherwise(F.least(F.lit(1.0), c("p_value") * 10))
    outliers = F.greatest(F.lit(0.0), 1 - F.abs(c("outliers_original") - c("outliers_reconstructed")) * 5)
    temporal = weighted((F.when(c("stationary_original") == c("stationary_reconstructed"), 1.0).otherwise(0.5), 0.5), ("trend", 0.5))
    return known(m).select("song_id", F.round(within(weighted(("distribution", 0.2), (correlation, 0.3), (significance, 0.2), (outliers, 0.15), (temporal, 0.15))), 6).alias("overall"))


def statistical_scores(m: DataFrame) -> DataFrame:
    """Named sub-scores of a statistical comparison, and warnings."""
    c = F.col
    gap, same = F.abs(c("outliers_original") - c("outliers_reconstructed")), c("stationary_original") == c("stationary_reconstructed")
    rules = {
        "distribution": c("ks_p") < 0.01, "wasserstein": c("wasserstein") > 50, "pitch correlation": F.abs("pitch_r") < 0.5, "velocity correlation": F.abs("velocity_r") < 0.3, "information": c("information") < 0.3,
        "significant": c("significant"), "outliers": gap > 0.1, "outliers lost": c("outliers_kept") < 0.5, "stationarity": ~same, "trend": c("trend") < 0.7, "warping": c("warping") > 10,
    }
    return known(m).select(
        "song_id", F.abs("pitch_r").alias("pitch_correlation"), F.abs("velocity_r").alias("velocity_correlation"), "information", chosen("significant", 0.0, 1.0).alias("significance"),
        F.round(F.greatest(F.lit(0.0), 1 - gap * 10), 6).alias("outlier_consistency"), c("outliers_kept").alias("outlier_preservation"), same.cast("double").alias("stationarity_preservation"), c("trend").alias("trend_similarity"), labels(rules).alias("warnings"),
    )


def _warped(x: pd.Series, y: pd.Series) -> pd.Series:
    """Least sum of distances along a path through each row's two lists. All rows of a batch go together, one diagonal of their tables after the other;
    cells beyond a row's own lists are computed too and read by none of its own."""
    n, m = (np.array([len(u) for u in side], dtype=np.intp) for side in (x, y))
    u, v = (np.zeros((len(k), k.max(initial=0))) for k in (n, m))
    for side, table in ((x, u), (y, v)):
        for row, values in enumerate(side):
            table[row, : len(values)] = values
    rows, height, width = len(u), u.shape[1], v.shape[1]
    out = np.full(rows, np.nan)
    # diagonal d holds the cells (i, d - i), at place i
    older, old = np.full((rows, height + 1), np.inf), np.full((rows, height + 1), np.inf)
    older[:, 0] = 0.0
    for d in range(2, height + width + 1):
        lo, hi = max(1, d - width), min(height, d - 1)
        now = np.full((rows, height + 1), np.inf)
        if lo <= hi:
            i = np.arange(lo, hi + 1)
            now[:, i] = np.abs(u[:, i - 1] - v[:, d - i - 1]) + np.fmin(np.fmin(old[:, i - 1], old[:, i]), older[:, i - 1])
        ends = np.flatnonzero(n + m == d)
        out[ends] = now[ends, n[ends]]
        older, old = old, now
    return pd.Series(out).astype("Float64")


def warping_distance(a: DataFrame, b: DataFrame, most: int = 100) -> DataFrame:
    """Dynamic time warping of the first `most` pitches of both sides by song, over the sum of their numbers; songs on both sides.

    A song's two short lists are the only things held together; the tables of a batch of songs are filled by diagonals.
    """
    place = F.row_number().over(Window.partitionBy("song_id").orderBy(*ORDER))

    def first(notes: DataFrame, name: str) -> DataFrame:
        few = notes.select("song_id", "pitch", place.alias("i")).where(F.col("i") <= most)
        return few.groupBy("song_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "pitch"))), lambda x: x["pitch"].cast("double")).alias(name))

    return first(a, "x").join(first(b, "y"), "song_id").select("song_id", F.round(F.pandas_udf(_warped, DoubleType())("x", "y") / (F.size("x") + F.size("y")), 6).alias("warping"))


def complexity(tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """Complexity of songs from 0 to 1, its parts and its level.

    tracks: song_id, notes, polyphony, duration_cv, velocity_range, pitch_range, is_chord; songs: song_id, seconds, tempo_changes (those
    after the first). Songs without tracks are left out.
    """
    at_most = lambda x, most: F.least(F.lit(1.0), x / most)
    m = tracks.groupBy("song_id").agg(
        F.count("*").alias("tracks"), F.sum("notes").alias("notes"), F.avg(F.when(F.col("polyphony") > 0, F.col("polyphony"))).alias("polyphony"), F.avg("duration_cv").alias("rhythm"),
        (F.avg(F.when(F.col("is_chord"), F.col("polyphony"))) / 10).alias("harmony"), F.avg("velocity_range").alias("dynamics"), F.max("pitch_range").cast("double").alias("range"),
    ).join(songs, "song_id", "left")
    m = known(m.withColumn("density", F.when(F.col("seconds") > 0, F.col("notes") / F.col("seconds")).otherwise(0.0)))
    overall = weighted((at_most(F.col("density"), 10), 0.2), (at_most(F.col("polyphony"), 6), 0.2), (at_most(F.col("rhythm"), 1), 0.15), (at_most(F.col("harmony"), 1), 0.15), (F.col("dynamics") / 127, 0.1), (at_most(F.col("range"), 60), 0.1), (at_most(F.col("tracks"), 8), 0.05), (at_most(F.col("tempo_changes"), 5), 0.05))
    m = m.withColumn("overall", F.round(within(overall), 6))
    level = F.lit("very_complex")
    for name, below in (("complex", 0.8), ("moderate", 0.6), ("simple", 0.4), ("minimal", 0.2)):
        level = F.when(F.col("overall") < below, name).otherwise(level)
    return m.select("song_id", *(F.round(x, 6).alias(x) for x in ("density", "polyphony", "rhythm", "harmony", "dynamics", "range")), "overall", level.alias("level"))


def strategy_advice(tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """The tokenization that suits a song: CPWord beyond ten minutes, Structured for dense harmony, TSD for short songs without drums, else REMI.

    tracks: song_id, type, notes, polyphony; songs: song_id, seconds.
    """
    m = tracks.groupBy("song_id").agg(
        F.sum("notes").alias("notes"), (F.sum(F.col("polyphony") * F.col("notes")) / F.greatest(F.sum("notes"), F.lit(1))).alias("polyphony"),
        F.bool_or(F.col("type") == "drums").alias("drums"), F.bool_or((F.col("type") == "chord") & (F.col("polyphony") > 4)).alias("dense"),
    ).join(songs, "song_id", "left")
    advice = F.when(F.col("seconds") > 600, "CPWord").when(F.col("dense") & (F.col("polyphony") > 3), "Structured").when((F.col("notes") < 500) & ~F.col("drums"), "TSD").otherwise("REMI")
    return known(m).select("song_id", advice.alias("strategy"))


def _by(table: dict[str, tuple[float, ...]], key: Column, i: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for name, pair in table.items() for x in (name, pair[i]))), key)


def adaptive_thresholds(m: DataFrame, use_case: Column, genre: Column | None = None, custom: dict[str, float] | None = None) -> DataFrame:
    """Tolerances and least qualities for songs (columns of complexity()) under a use case: base values times its multipliers and those of the
    level, then those of the genre; tolerances in ticks and bins are cut to whole numbers after each. custom overrides values by name. All
    are held in range at the end.

    genre: in any case; null and unknown ones change nothing. Names in custom that aren't thresholds are passed over.
    """
    q, t = (_by(USE_CASES, use_case, i) for i in (0, 1))
    ql, tl = (_by(LEVELS, F.col("level"), i) for i in (0, 1))
    known_genre = F.lower(F.lit(None).cast("string") if genre is None else genre)
    timing, pitch, dynamics = (F.coalesce(_by(GENRES, known_genre, i), F.lit(1.0)) for i in range(3))
    whole = lambda base, strict: F.floor(F.floor(F.floor(base * t) * tl) * (1.0 / strict)).cast("double")
    one = F.lit(1.0)
    ticks = {
        "note_start_tick": whole(1, timing), "note_duration": F.floor(F.floor(2 * t) * tl) * F.when(F.col("rhythm") > 0.7, 1.5).otherwise(1.0), "velocity_bin": whole(1, dynamics),
    }
    ratios = {"missing_notes_ratio": 0.01 * t * tl, "extra_notes_ratio": 0.01 * t * tl}
    qualities = {
        "overall_quality": 0.95 * q * ql, "timing_accuracy": 0.98 * q * F.when(F.col("overall") > 0.9, 0.95).otherwise(one) * timing,
        "velocity_accuracy": 0.95 * q * F.when(F.col("polyphony") > 5, 0.97).otherwise(one) * dynamics, "pitch_accuracy": 0.99 * q * pitch,
        "musical_fidelity": 0.90 * q, "sequence_quality": 0.85 * q, "statistical_similarity": 0.85 * q,
    }
    asked = {name: F.lit(float(x)) for name, x in (custom or {}).items()}
    held = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    out = {name: F.greatest(one, asked.get(name, x)) for name, x in ticks.items()}
    out |= {name: F.round(held(asked.get(name, x), 0.001, 0.5), 6) for name, x in ratios.items()}
    out["tempo_bpm_diff"] = F.round(asked.get("tempo_bpm_diff", t), 6)
    out |= {name: F.round(held(asked.get(name, x), 0.5, 1.0), 6) for name, x in qualities.items()}
    for name in ("note_start_tick", "velocity_bin"):
        if name not in asked:
            out[name] = out[name].cast("long")
    return m.select("song_id", use_case.alias("use_case"), "level", "overall", *(x.alias(name) for name, x in out.items()))


def recommended_thresholds(m: DataFrame, target: float) -> DataFrame:
    """The use case that suits a target accuracy of 0 to 1, some of its thresholds, how sure that is, and warnings."""
    return _recommended(m, target).select("song_id", "use_case", "note_duration", "overall_quality", "confidence", "warnings")


def _recommended(m: DataFrame, target: float) -> DataFrame:
    name, expected = next((n, e) for n, least, e in TARGETS if target >= least)
    c = F.col("overall")
    sure = F.when(c > 0.8, 0.85).when(c < 0.2, 0.95).otherwise(1.0) * (1 - abs(target - expected)) * F.when((c > 0.6) & F.lit(target > 0.98), 0.8).otherwise(1.0)
    warnings = labels({"high complexity": c > 0.8, "target hard to reach": (c > 0.7) & F.lit(target > 0.98)})
    return adaptive_thresholds(m, F.lit(name)).withColumns({"confidence": F.round(within(sure), 6), "warnings": warnings})


def constrained_thresholds(m: DataFrame, target: float, seconds: Column | None = None, memory_mb: Column | None = None, real_time: Column | None = None) -> DataFrame:
    """recommended_thresholds() under limits on processing, with the reasons: under a second, ticks double and the least overall quality is
    eased; under 100 MB the statistical one; in real time the overall and the sequence one. A limit that is null or not given changes nothing."""
    def no(kind: str) -> Column:
        return F.lit(None).cast(kind)

    quick = F.coalesce((no("double") if seconds is None else seconds) < 1, F.lit(False))
    small = F.coalesce((no("double") if memory_mb is None else memory_mb) < 100, F.lit(False))
    live = F.coalesce(no("boolean") if real_time is None else real_time, F.lit(False))
    limits = m.select("song_id", quick.alias("quick"), small.alias("small"), live.alias("live"))
    times = lambda flag, x: F.when(F.col(flag), x).otherwise(1.0)
    t = _recommended(m, target).join(limits, "song_id")
    return t.select(
        "song_id", "use_case", (F.col("note_start_tick") * F.when(F.col("quick"), 2).otherwise(1)).alias("note_start_tick"), (F.col("note_duration") * times("quick", 2.0)).alias("note_duration"),
        (F.col("overall_quality") * times("quick", 0.95) * times("live", 0.92)).alias("overall_quality"), (F.col("sequence_quality") * times("live", 0.88)).alias("sequence_quality"),
        (F.col("statistical_similarity") * times("small", 0.9)).alias("statistical_similarity"), "confidence", "warnings",
        labels({"fast processing": F.col("quick"), "little memory": F.col("small"), "real time": F.col("live")}).alias("reasons"),
    )


def content_thresholds(m: DataFrame, tracks: DataFrame) -> DataFrame:
    """Thresholds of the use case that suits a song's level, moved for drums, dense chords and fast tracks.

    tracks: song_id, type, polyphony, density (notes a second).
    """
    suited = F.element_at(F.create_map(*(F.lit(x) for pair in SUITED.items() for x in pair)), F.col("level"))
    flags = tracks.groupBy("song_id").agg(
        F.bool_or(F.col("type") == "drums").alias("drums"), F.bool_or((F.col("type") == "chord") & (F.col("polyphony") > 4)).alias("dense"), F.bool_or(F.col("density") > 5).alias("fast"),
    )
    t = known(adaptive_thresholds(m, suited).join(flags, "song_id", "left"))
    start = F.when(F.col("drums"), F.greatest(F.lit(1).cast("long"), F.col("note_start_tick") - 1)).otherwise(F.col("note_start_tick")) + F.col("fast").cast("long")
    return t.select(
        "song_id", "use_case", start.alias("note_start_tick"), (F.col("note_duration") + F.col("dense").cast("int")).alias("note_duration"), (F.col("velocity_bin") + F.col("drums").cast("long")).alias("velocity_bin"),
        F.round(F.col("missing_notes_ratio") * F.when(F.col("dense"), 1.2).otherwise(1.0), 6).alias("missing_notes_ratio"), F.round(F.col("timing_accuracy") * F.when(F.col("fast"), 0.98).otherwise(1.0), 6).alias("timing_accuracy"),
    )
