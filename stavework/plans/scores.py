"""Queries that combine the results of other queries by song, with their SQL, which holds that of the combined queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parts import met
from ..operators import compare, scores, song_metrics, statistics
from ..operators import structure as st
from ..views import view, with_views
from . import catalog, quality, significance, structure, training  # noqa: F401  (the queries combined here)
from . import statistics as combined
from .catalog import HIST, PAIRS
from .registry import Query, _queries, _sql, register

Part = tuple[Query, str]


def known(name: str) -> Part:
    return _queries[name], _sql[name]


def part(needs: str, build: Callable[..., DataFrame], body: str) -> Part:
    return lambda spark, sf_dir: build(*(view(spark, sf_dir, n) for n in needs.split())), with_views(needs, body)


def by_song(parts: list[tuple[Part, dict[str, str]]], derived: dict[str, str] | None = None, flags: str = "") -> Part:
    """One row a song of the first part with the metrics named (an aggregate over the song's rows in each part), missing ones 0 or false, and those derived from them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = met([query(spark, sf_dir).groupBy("song_id").agg(*(F.expr(e).alias(c) for c, e in columns.items())) for (query, _), columns in parts], ["song_id"])
        out = scores.known(out)
        return out.withColumns({c: F.expr(e) for c, e in derived.items()}) if derived else out

    tables = [f"p{i} AS (SELECT song_id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM ({sql}) q GROUP BY song_id)" for i, ((_, sql), columns) in enumerate(parts)]
    every = [c for _, columns in parts for c in columns]
    filled = ", ".join(f"coalesce({c}, {'false' if c in flags.split() else 0}) AS {c}" for c in every)
    joined = "p0" + "".join(f" LEFT JOIN p{i} USING (song_id)" for i in range(1, len(parts)))
    more = f", {', '.join(f'{e} AS {c}' for c, e in derived.items())}" if derived else ""
    return run, f"SELECT *{more} FROM (WITH {', '.join(tables)} SELECT song_id, {filled} FROM {joined}) filled"


def at_once(needs: str, build: Callable[..., DataFrame], whole: Part, derived: dict[str, str] | None = None) -> Part:
    """What build makes of the views named, in place of whole's parts, which read and shuffle them each for itself: the same rows, and whole's SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = scores.known(build(*(view(spark, sf_dir, n) for n in needs.split())))
        return out.withColumns({c: F.expr(e) for c, e in derived.items()}) if derived else out

    return run, whole[1]


def add(name: str, parts: list[Part], build: Callable[..., DataFrame], body: str) -> None:
    """Registers build over the parts, and body with the parts' SQL before it as tables a, b, ..."""
    tables = ", ".join(f"{'abc'[i]} AS ({sql})" for i, (_, sql) in enumerate(parts))
    register(name, lambda spark, sf_dir: build(*(query(spark, sf_dir) for query, _ in parts)), f"WITH {tables} {body}")


def listed(rules: dict[str, str]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()) + "], lambda x: x IS NOT NULL), ',')"


# -- token sequences

SEQUENCE = by_song(
    [
        (known("SEQ01"), {"used": "max(used)", "coverage": "max(coverage)", "entropy": "max(entropy)"}), (known("SEQ02"), {"repetition": "max(repetition)"}), (known("SEQ03"), {"perplexity": "max(perplexity)"}),
        (known("SEQ04"), {"consistency": "max(consistency)"}), (known("SEQ05"), {"coherence": "max(coherence)"}), (known("SEQ06"), {"smoothness": "max(smoothness)"}), (known("SEQ07"), {"complexity": "max(complexity)"}),
        (known("SEQ08"), {"ratio": "max(ratio)", "efficiency": "max(efficiency)", "density": "max(density)", "redundancy": "max(redundancy)"}), (known("SEQ09"), {"patterns": "count(*)"}), (known("SEQ10"), {"structured": "max(structured)"}),
        (known("SEQ11"), {"phrase": "max(coherence)"}), (known("SEQ12"), {"motif": "max(motif)"}), (known("WIN17"), {"regularity": "max(regularity)"}),
    ],
    {"vocabulary_efficiency": "used / CAST(533 AS DOUBLE)"}, "structured",
)
add("SEQ13", [SEQUENCE], scores.sequence_quality, """SELECT song_id, round(least(1, greatest(0, 0.2 * (coverage * 0.3 + vocabulary_efficiency * 0.4 + least(1, entropy / 5) * 0.3) + 0.3 * ((1 - repetition) * 0.2 + coherence * 0.3 + consistency * 0.2 + smoothness * 0.3)
 + 0.2 * (least(1, 1 / greatest(ratio, 0.1)) * 0.3 + efficiency * 0.4 + density * 0.3) + 0.3 * (CASE WHEN structured THEN 0.3 ELSE 0.15 END + regularity * 0.2 + phrase * 0.25 + motif * 0.25))), 6)::DOUBLE AS overall,
 round(least(1, entropy / 7), 6)::DOUBLE AS token_entropy, round(least(1, 1 / greatest(ratio, 0.1)), 6)::DOUBLE AS compression_efficiency, CASE WHEN structured THEN 1.0 ELSE 0.5 END::DOUBLE AS musical_structure FROM a""")  # fmt: skip
WARNED = {
    "vocabulary barely used": "coverage < 0.1", "vocabulary nearly all used": "coverage > 0.9", "vocabulary inefficient": "vocabulary_efficiency < 0.3", "low entropy": "entropy < 2", "repetitive": "repetition > 0.8", "incoherent": "coherence < 0.5",
    "unpredictable": "perplexity > 100", "poor compression": "ratio > 3", "inefficient encoding": "efficiency < 0.5", "no structure": "NOT structured", "irregular bars": "regularity < 0.5", "poor phrases": "phrase < 0.3",
}
SUGGESTED = {
    "smaller vocabulary": "coverage < 0.2", "larger vocabulary": "coverage > 0.95", "drop unused tokens": "533 - used > 266.5", "more compact tokens": "ratio > 2.5", "finer tokens": "ratio < 0.5", "variable-length encoding": "redundancy > 0.7",
    "less repetition": "repetition > 0.7", "check nuances": "complexity < 0.3", "simpler parameters": "complexity > 0.9", "structural tokens": "NOT structured", "other beat resolution": "regularity < 0.6", "check motifs": "patterns < 3", "try CPWord": "ratio > 2",
}
add("SEQ14", [SEQUENCE], scores.sequence_advice, f"SELECT song_id, {listed(WARNED)} AS warnings, {listed(SUGGESTED)} AS suggestions FROM a")

# -- musical features

COSINE = "SELECT song_id, round(sum(original * reconstructed) / sqrt(CAST(sum(original * original) AS DOUBLE) * CAST(sum(reconstructed * reconstructed) AS DOUBLE)), 6) AS similarity FROM hs GROUP BY 1"


STEPS = "SELECT song_id, abs(pitch - lag(pitch) OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, pitch)) AS v FROM {t}"


def _interval_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    original, reconstructed = (compare.interval_histogram(x).withColumnRenamed("count", c) for x, c in ((a, "original"), (b, "reconstructed")))
    return compare.cosine(original.join(reconstructed, ["song_id", "interval"], "full").fillna(0))


INTERVALS = part("notes recon", _interval_similarity,
    f", hs AS (SELECT song_id, v, count_if(s = 0) AS original, count_if(s = 1) AS reconstructed FROM (SELECT *, 0 AS s FROM ({STEPS.format(t='notes')}) x UNION ALL SELECT *, 1 FROM ({STEPS.format(t='recon')}) y) u WHERE v IS NOT NULL GROUP BY 1, 2) {COSINE}")
SAMPLED = part("recon", compare.sampled_polyphony, "SELECT song_id, track_idx, round(sum(ceil(end_tick / 100.0) - ceil(start_tick / 100.0)) / ceil(max(end_tick) / 100.0), 6) AS polyphony FROM recon GROUP BY 1, 2")
HARMONY_APART = by_song(
    [
        (known("SET04"), {"chords": "max(similarity)"}), (INTERVALS, {"intervals": "max(similarity)"}), (known("MUS06"), {"voicing": "max(kept)"}), (known("MUS07"), {"rhythm_kept": "max(kept)"}),
        (known("AGG04"), {"polyphony_original": "avg(avg_polyphony)"}), (SAMPLED, {"polyphony_reconstructed": "avg(polyphony)"}),
    ], flags="voicing rhythm_kept",
)
HARMONY = at_once("notes recon", song_metrics.harmony, HARMONY_APART)
add("MUS08", [HARMONY], scores.harmony, "SELECT song_id, chords, intervals, voicing, rhythm_kept, round(CASE WHEN polyphony_original > 0 THEN least(1, polyphony_reconstructed / polyphony_original) ELSE 0 END, 6)::DOUBLE AS polyphony FROM a")
DRIFT = part("notes recon", lambda a, b: compare.paired(a, b).groupBy("song_id").agg(F.round(F.avg(F.abs(F.col("start_tick_a") - F.col("start_tick_b"))), 6).alias("drift")), f", {PAIRS} SELECT song_id, round(avg(abs(sa - sb)), 6) AS drift FROM pr GROUP BY 1")
FEATURES_APART = by_song(
    [
        (known("MUS01"), {n: f"max(CASE WHEN feature = '{f}' THEN similarity END)" for n, f in (("pitches", "pitch"), ("classes", "pitch_class"), ("octaves", "octave"))}),
        (known("MUS03"), {"rhythms": "max(similarity)"}), (known("MUS05"), {"tempo": "max(stability)"}), (known("SET05"), {"groove": "max(kept)"}), (known("MUS02"), {"range_kept": "max(range_kept)", "shift": "max(shift)"}),
        (known("MUS08"), {"chords": "max(chords)", "intervals": "max(intervals)", "polyphony": "max(polyphony)", "voicing": "max(voicing)"}), (DRIFT, {"drift": "max(drift)"}),
    ], flags="groove range_kept voicing",
)
FEATURES = at_once("notes recon tempo_changes", lambda a, b, c: song_metrics.features(a, b, st.tempo_stability(c, structure.MOVED(c))), FEATURES_APART)
FAITHFUL = {
    "pitch": "pitches < 0.8", "tessitura": "abs(shift) > 3", "range": "NOT range_kept", "rhythm": "rhythms < 0.7", "groove": "NOT groove", "tempo": "tempo < 0.9", "drift": "drift > 10", "chords": "chords < 0.7", "voicing": "NOT voicing", "polyphony": "polyphony < 0.8",
}
add("MUS09", [FEATURES], scores.fidelity, f"""SELECT song_id, p AS pitch, r AS rhythm, h AS harmony, s::DOUBLE AS structure, least(1, greatest(0, (p + r + h + s) / 4))::DOUBLE AS overall, w AS warnings FROM (SELECT song_id, pitches * 0.4 + classes * 0.4 + octaves * 0.2 AS p,
 rhythms * 0.4 + tempo * 0.3 + CASE WHEN groove THEN 0.3 ELSE 0.21 END AS r, chords * 0.4 + intervals * 0.3 + polyphony * 0.3 AS h, CASE WHEN range_kept THEN 0.5 ELSE 0.25 END + CASE WHEN voicing THEN 0.5 ELSE 0.35 END AS s, {listed(FAITHFUL)} AS w FROM a) x""")  # fmt: skip

# -- statistics

FIRST = "SELECT song_id, list(pitch::DOUBLE ORDER BY i) AS l FROM (SELECT song_id, pitch, row_number() OVER (PARTITION BY song_id ORDER BY start_tick, pitch, track_idx, end_tick, velocity) AS i FROM {t}) x WHERE i <= 100 GROUP BY 1"
WARPING = part("notes recon", scores.warping_distance, f""", x AS ({FIRST.format(t='notes')}), y AS ({FIRST.format(t='recon')}), cells AS (SELECT x.song_id, x.l AS x, y.l AS y FROM x JOIN y USING (song_id))
SELECT song_id, round(list_reduce(x, lambda before, v: list_reduce(range(len(y)), lambda now, j: list_append(now, abs(v - y[j + 1]) + least(before[j + 2], before[j + 1], now[j + 1])), ['inf'::DOUBLE]), list_prepend(0::DOUBLE, list_transform(y, lambda e: 'inf'::DOUBLE)))[-1] / (len(x) + len(y)), 6) AS warping FROM cells""")  # fmt: skip
register("STA21", *WARPING)


def _recon(name: str, first: str) -> str:
    """The SQL of a query on notes, on the other side."""
    return with_views("recon", f", {first} AS{re.split(rf',\s*{first} AS', _sql[name], maxsplit=1)[1].replace('FROM notes', 'FROM recon')}")


OUTLIERS = part("recon", lambda n: statistics.outliers(n.withColumn("pitch", F.expr(combined.CUBE))), "")[0], _recon("STA18", "cubed")
STATIONARY = part("recon", statistics.stationary, "")[0], _recon("WIN21", "hf")
DISTRIBUTION = {"distribution": "(greatest(0, 1 - wasserstein / 100) + greatest(0, 1 - divergence) + 1 - hellinger) / 3"}
STATISTICS_APART = by_song(
    [
        (known("STA01"), {"ks_p": "min(p)"}), (known("STA02"), {"wasserstein": "max(CASE WHEN feature = 'velocity' THEN wasserstein END)"}), (known("STA03"), {"divergence": "max(jensen_shannon)"}), (known("STA04"), {"hellinger": "max(hellinger)"}),
        (known("STA08"), {"pitch_r": "max(pitch)", "velocity_r": "max(velocity)", "duration_r": "max(duration)"}), (known("STA11"), {"information": "max(information)"}), (known("STA17"), {"p_value": "max(mean_p)", "significant": "max(differs)"}), (known("STA18"), {"outliers_original": "max(ratio)"}),
        (OUTLIERS, {"outliers_reconstructed": "max(ratio)"}), (known("STA19"), {"outliers_kept": "max(kept)"}), (known("WIN21"), {"stationary_original": "max(stationary)"}), (STATIONARY, {"stationary_reconstructed": "max(stationary)"}),
        (known("STA20"), {"trend": "max(similarity)"}), (known("STA21"), {"warping": "max(warping)"}),
    ],
    DISTRIBUTION, "significant stationary_original stationary_reconstructed",
)
STATISTICS = at_once("notes recon", lambda a, b: song_metrics.statistics(a, b, combined.cubed), STATISTICS_APART, DISTRIBUTION)
GAP = "abs(outliers_original - outliers_reconstructed)"
add("STA22", [STATISTICS], scores.statistical_similarity, f"""SELECT song_id, round(least(1, greatest(0, distribution * 0.2 + 0.3 * (abs(pitch_r) * 0.4 + abs(velocity_r) * 0.2 + abs(duration_r) * 0.2 + information * 0.2) + 0.2 * CASE WHEN significant THEN least(1, p_value * 10) ELSE 1 END
 + 0.15 * greatest(0, 1 - {GAP} * 5) + 0.15 * (CASE WHEN stationary_original = stationary_reconstructed THEN 0.5 ELSE 0.25 END + trend * 0.5))), 6)::DOUBLE AS overall FROM a""")  # fmt: skip
DIFFERENT = {
    "distribution": "ks_p < 0.01", "wasserstein": "wasserstein > 50", "pitch correlation": "abs(pitch_r) < 0.5", "velocity correlation": "abs(velocity_r) < 0.3", "information": "information < 0.3", "significant": "significant", "outliers": f"{GAP} > 0.1",
    "outliers lost": "outliers_kept < 0.5", "stationarity": "stationary_original <> stationary_reconstructed", "trend": "trend < 0.7", "warping": "warping > 10",
}
add("STA23", [STATISTICS], scores.statistical_scores, f"""SELECT song_id, abs(pitch_r) AS pitch_correlation, abs(velocity_r) AS velocity_correlation, information, CASE WHEN significant THEN 0.0 ELSE 1.0 END::DOUBLE AS significance, round(greatest(0, 1 - {GAP} * 10), 6)::DOUBLE AS outlier_consistency,
 outliers_kept AS outlier_preservation, (stationary_original = stationary_reconstructed)::INT::DOUBLE AS stationarity_preservation, trend AS trend_similarity, {listed(DIFFERENT)} AS warnings FROM a""")  # fmt: skip

# -- complexity, and what follows from it

SECONDS = part("notes songs tempo_changes",
    lambda n, s, c: s.join(n.groupBy("song_id").agg(F.max("end_tick").alias("ticks")), "song_id").join(c.groupBy("song_id").agg((F.count("*") - 1).alias("tempo_changes")), "song_id").select("song_id", (F.col("ticks") * 60.0 / (F.col("ppq") * F.col("bpm"))).alias("seconds"), "tempo_changes"),
    "SELECT song_id, max(end_tick) * 60 / any_value(ppq * bpm)::DOUBLE AS seconds, any_value(changes) AS tempo_changes FROM notes JOIN songs USING (song_id) JOIN (SELECT song_id, count(*) - 1 AS changes FROM tempo_changes GROUP BY 1) c USING (song_id) GROUP BY 1")
SPREAD = part("notes", lambda n: n.groupBy("song_id", "track_idx").agg((F.stddev_pop(F.col("end_tick") - F.col("start_tick")) / F.avg(F.col("end_tick") - F.col("start_tick"))).alias("duration_cv"), (F.max("velocity") - F.min("velocity")).alias("velocity_range"), (F.max("pitch") - F.min("pitch")).alias("pitch_range")),
    "SELECT song_id, track_idx, stddev_pop(end_tick - start_tick) / avg(end_tick - start_tick) AS duration_cv, max(velocity) - min(velocity) AS velocity_range, max(pitch) - min(pitch) AS pitch_range FROM notes GROUP BY 1, 2")
(_stats, STATS_SQL), (_types, TYPES_SQL), (_spread, SPREAD_SQL) = known("AGG04"), known("SCA11"), SPREAD


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["song_id", "track_idx"]
    stats = _stats(spark, sf_dir).select(*keys, F.col("total_notes").alias("notes"), F.col("avg_polyphony").alias("polyphony"))
    return stats.join(_types(spark, sf_dir).select(*keys, "type"), keys).join(_spread(spark, sf_dir), keys).withColumn("is_chord", F.col("type") == "chord")


TRACKS = _tracks, f"SELECT song_id, track_idx, total_notes AS notes, avg_polyphony AS polyphony, type, duration_cv, velocity_range, pitch_range, type = 'chord' AS is_chord FROM ({STATS_SQL}) s JOIN ({TYPES_SQL}) t USING (song_id, track_idx) JOIN ({SPREAD_SQL}) v USING (song_id, track_idx)"
add("AGG27", [TRACKS, SECONDS], scores.complexity, """, g AS (SELECT song_id, count(*) AS n, sum(notes) AS notes, avg(polyphony) FILTER (polyphony > 0) AS polyphony, avg(duration_cv) AS rhythm, coalesce(avg(polyphony) FILTER (is_chord), 0) / 10 AS harmony, avg(velocity_range) AS dynamics, max(pitch_range)::DOUBLE AS range FROM a GROUP BY 1),
m AS (SELECT *, notes / seconds AS density FROM g JOIN b USING (song_id)), o AS (SELECT *, round(least(1, density / 10) * 0.2 + least(1, polyphony / 6) * 0.2 + least(1, rhythm) * 0.15 + least(1, harmony) * 0.15 + dynamics / 127 * 0.1 + least(1, range / 60) * 0.1 + least(1, n / 8) * 0.05 + least(1, tempo_changes / 5) * 0.05, 6)::DOUBLE AS overall FROM m)
SELECT song_id, round(density, 6) AS density, round(polyphony, 6) AS polyphony, round(rhythm, 6) AS rhythm, round(harmony, 6) AS harmony, round(dynamics, 6) AS dynamics, range, overall,
 CASE WHEN overall < 0.2 THEN 'minimal' WHEN overall < 0.4 THEN 'simple' WHEN overall < 0.6 THEN 'moderate' WHEN overall < 0.8 THEN 'complex' ELSE 'very_complex' END AS level FROM o""")  # fmt: skip
add("SCA21", [TRACKS, SECONDS], scores.strategy_advice, """, g AS (SELECT song_id, sum(notes) AS notes, sum(polyphony * notes) / sum(notes) AS polyphony, bool_or(type = 'drums') AS drums, bool_or(type = 'chord' AND polyphony > 4) AS dense FROM a GROUP BY 1)
SELECT song_id, CASE WHEN seconds > 600 THEN 'CPWord' WHEN dense AND polyphony > 3 THEN 'Structured' WHEN notes < 500 AND NOT drums THEN 'TSD' ELSE 'REMI' END AS strategy FROM g JOIN b USING (song_id)""")  # fmt: skip


def factors(key: str, table: dict[str, tuple[float, float]], names: tuple[str, str]) -> str:
    rows = ", ".join(f"('{k}', {q}::DOUBLE, {t}::DOUBLE)" for k, (q, t) in table.items())
    return f"JOIN (VALUES {rows}) v{names[0]}({key}, {names[0]}, {names[1]}) USING ({key})"


HELD = "round(least(1, greatest(0.5, {x})), 6)::DOUBLE AS {n}"
RATIO = "round(least(0.5, greatest(0.001, 0.01 * t * tl)), 6)::DOUBLE"
THRESHOLDS = f"""SELECT song_id, use_case, level, overall, greatest(1, floor(floor(t) * tl))::BIGINT AS note_start_tick, greatest(1, floor(floor(2 * t) * tl) * CASE WHEN rhythm > 0.7 THEN 1.5 ELSE 1 END)::DOUBLE AS note_duration, greatest(1, floor(floor(t) * tl))::BIGINT AS velocity_bin,
 {RATIO} AS missing_notes_ratio, {RATIO} AS extra_notes_ratio, t AS tempo_bpm_diff, {HELD.format(x='0.95 * q * ql', n='overall_quality')}, {HELD.format(x='0.98 * q * CASE WHEN overall > 0.9 THEN 0.95 ELSE 1 END', n='timing_accuracy')},
 {HELD.format(x='0.95 * q * CASE WHEN polyphony > 5 THEN 0.97 ELSE 1 END', n='velocity_accuracy')}, {HELD.format(x='0.99 * q', n='pitch_accuracy')}, {HELD.format(x='0.9 * q', n='musical_fidelity')}, {HELD.format(x='0.85 * q', n='sequence_quality')}, {HELD.format(x='0.85 * q', n='statistical_similarity')}
 FROM {{cases}} {factors('use_case', scores.USE_CASES, ('q', 't'))} {factors('level', scores.LEVELS, ('ql', 'tl'))}"""
EVERY = f"(SELECT *, unnest([{', '.join(repr(u) for u in scores.USE_CASES)}]) AS use_case FROM a) u"
add("QUA07", [known("AGG27")], lambda m: scores.adaptive_thresholds(m.withColumn("u", F.explode(F.array(*map(F.lit, scores.USE_CASES)))), F.col("u")), THRESHOLDS.format(cases=EVERY))
add("QUA08", [known("AGG27")], lambda m: scores.recommended_thresholds(m, 0.99), f"""SELECT song_id, use_case, note_duration, overall_quality, round(CASE WHEN overall > 0.8 THEN 0.85 WHEN overall < 0.2 THEN 0.95 ELSE 1 END * 0.99 * CASE WHEN overall > 0.6 THEN 0.8 ELSE 1 END, 6)::DOUBLE AS confidence,
 {listed({'high complexity': 'overall > 0.8', 'target hard to reach': 'overall > 0.7'})} AS warnings FROM ({THRESHOLDS.format(cases="(SELECT *, 'research' AS use_case FROM a) u")}) x""")  # fmt: skip

GENRE_OF = ["classical", "Jazz", "electronic", "folk", "orchestral", "custom", "polka", None]
CUSTOM = {"velocity_accuracy": 0.4, "missing_notes_ratio": 0.7, "extra_notes_ratio": 0.02, "note_duration": 0.5, "no_such_threshold": 3}


def _genres(m: DataFrame) -> DataFrame:
    """Every use case and a genre by song."""
    m = m.withColumn("u", F.explode(F.array(*map(F.lit, scores.USE_CASES))))
    return m.withColumn("genre", F.get(F.array(*map(F.lit, GENRE_OF)), (F.col("song_id") % len(GENRE_OF)).cast("int")))


def _strict() -> str:
    rows = ", ".join(f"({i}, {t}::DOUBLE, {p}::DOUBLE, {d}::DOUBLE)" for i, g in enumerate(GENRE_OF) for t, p, d in [scores.GENRES.get((g or "").lower(), (1.0, 1.0, 1.0))])
    return f"JOIN (VALUES {rows}) w(place, strict_timing, strict_pitch, strict_dynamics) ON place = song_id % {len(GENRE_OF)}"


add("QUA07_genre", [known("AGG27")], lambda m: scores.adaptive_thresholds(_genres(m), F.col("u"), F.col("genre")), f"""SELECT song_id, use_case, level, overall, greatest(1, floor(floor(floor(t) * tl) * (1.0::DOUBLE / strict_timing)))::BIGINT AS note_start_tick,
 greatest(1, floor(floor(2 * t) * tl) * CASE WHEN rhythm > 0.7 THEN 1.5 ELSE 1 END)::DOUBLE AS note_duration, greatest(1, floor(floor(floor(t) * tl) * (1.0::DOUBLE / strict_dynamics)))::BIGINT AS velocity_bin,
 {RATIO} AS missing_notes_ratio, {RATIO} AS extra_notes_ratio, t AS tempo_bpm_diff, {HELD.format(x='0.95 * q * ql', n='overall_quality')},
 {HELD.format(x='0.98::DOUBLE * q * CASE WHEN overall > 0.9 THEN 0.95 ELSE 1 END * strict_timing', n='timing_accuracy')}, {HELD.format(x='0.95::DOUBLE * q * CASE WHEN polyphony > 5 THEN 0.97 ELSE 1 END * strict_dynamics', n='velocity_accuracy')},
 {HELD.format(x='0.99::DOUBLE * q * strict_pitch', n='pitch_accuracy')}, {HELD.format(x='0.9 * q', n='musical_fidelity')}, {HELD.format(x='0.85 * q', n='sequence_quality')}, {HELD.format(x='0.85 * q', n='statistical_similarity')}
 FROM {EVERY} {factors('use_case', scores.USE_CASES, ('q', 't'))} {factors('level', scores.LEVELS, ('ql', 'tl'))} {_strict()}""")  # fmt: skip
add("QUA07_custom", [known("AGG27")], lambda m: scores.adaptive_thresholds(m.withColumn("u", F.explode(F.array(*map(F.lit, scores.USE_CASES)))), F.col("u"), custom=CUSTOM),
 f"SELECT * REPLACE (1.0::DOUBLE AS note_duration, 0.5::DOUBLE AS missing_notes_ratio, 0.02::DOUBLE AS extra_notes_ratio, 0.5::DOUBLE AS velocity_accuracy) FROM ({THRESHOLDS.format(cases=EVERY)}) x")


def _constrained(m: DataFrame) -> DataFrame:
    k = F.col("song_id")
    return scores.constrained_thresholds(m, 0.96, F.when(k % 2 == 0, 0.5).when(k % 3 == 0, 4.0), F.when(k % 3 == 0, 64.0).otherwise(512.0), k % 5 == 0)


QUICK, SMALL, LIVE = "song_id % 2 = 0", "song_id % 3 = 0", "song_id % 5 = 0"
add("QUA08_constraints", [known("AGG27")], _constrained, f"""SELECT song_id, use_case, note_start_tick * CASE WHEN {QUICK} THEN 2 ELSE 1 END AS note_start_tick, note_duration * CASE WHEN {QUICK} THEN 2.0::DOUBLE ELSE 1 END AS note_duration,
 overall_quality * CASE WHEN {QUICK} THEN 0.95::DOUBLE ELSE 1 END * CASE WHEN {LIVE} THEN 0.92::DOUBLE ELSE 1 END AS overall_quality, sequence_quality * CASE WHEN {LIVE} THEN 0.88::DOUBLE ELSE 1 END AS sequence_quality,
 statistical_similarity * CASE WHEN {SMALL} THEN 0.9::DOUBLE ELSE 1 END AS statistical_similarity, round(CASE WHEN overall > 0.8 THEN 0.85::DOUBLE WHEN overall < 0.2 THEN 0.95 ELSE 1 END * 0.99, 6)::DOUBLE AS confidence,
 {listed({'high complexity': 'overall > 0.8'})} AS warnings, {listed({'fast processing': QUICK, 'little memory': SMALL, 'real time': LIVE})} AS reasons
 FROM ({THRESHOLDS.format(cases="(SELECT *, 'production' AS use_case FROM a) u")}) x""")  # fmt: skip


def _content(m: DataFrame, tracks: DataFrame, seconds: DataFrame) -> DataFrame:
    return scores.content_thresholds(m, tracks.join(seconds, "song_id").withColumn("density", F.col("notes") / F.col("seconds")))


SUITED = "CASE level " + " ".join(f"WHEN '{k}' THEN '{u}'" for k, u in scores.SUITED.items()) + " END"
add("QUA10", [known("AGG27"), TRACKS, SECONDS], _content, f""", g AS (SELECT song_id, bool_or(type = 'drums') AS drums, bool_or(type = 'chord' AND polyphony > 4) AS dense, bool_or(notes / seconds > 5) AS fast FROM b JOIN c USING (song_id) GROUP BY 1)
SELECT song_id, use_case, CASE WHEN drums THEN greatest(1, note_start_tick - 1) ELSE note_start_tick END + fast::INT AS note_start_tick, note_duration + dense::INT AS note_duration, velocity_bin + drums::INT AS velocity_bin,
 round(missing_notes_ratio * CASE WHEN dense THEN 1.2 ELSE 1 END, 6)::DOUBLE AS missing_notes_ratio, round(timing_accuracy * CASE WHEN fast THEN 0.98 ELSE 1 END, 6)::DOUBLE AS timing_accuracy FROM ({THRESHOLDS.format(cases=f"(SELECT *, {SUITED} AS use_case FROM a) u")}) x JOIN g USING (song_id)""")  # fmt: skip
