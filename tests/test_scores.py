"""Operators of scores against plain Python, and on rows without metrics."""

import random

from stavework.operators import scores


def test_warping_distance(spark):
    rng = random.Random(5)
    sides = [[(s, 0, i * 10, i * 10 + 5, rng.randrange(40, 80), 64) for s in range(4) for i in range((3, 1, 130, 60)[s] + side)] for side in (0, 2)]
    a, b = (spark.createDataFrame(rows, "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int") for rows in sides)
    found = {r.song_id: r.warping for r in scores.warping_distance(a, b).collect()}
    for s in range(4):
        x, y = ([r[4] for r in side if r[0] == s][:100] for side in sides)
        best = {(-1, -1): 0.0}
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i, j] = abs(p - q) + min(best.get(k, float("inf")) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        assert abs(found[s] - best[len(x) - 1, len(y) - 1] / (len(x) + len(y))) < 1e-5


def test_missing_metrics_count_as_none(spark):
    names = "coverage vocabulary_efficiency entropy repetition coherence consistency smoothness ratio efficiency density regularity phrase motif".split()
    m = spark.createDataFrame([(1, *[None] * len(names), None)], "song_id long, " + ", ".join(f"{n} double" for n in names) + ", structured boolean")
    row = scores.sequence_quality(m).first()
    assert (row.token_entropy, row.compression_efficiency, row.musical_structure) == (0.0, 1.0, 0.5)
    assert row.overall == round(0.3 * 0.2 + 0.2 * 0.3 + 0.3 * 0.15, 6)


def test_levels_and_thresholds(spark):
    tracks = spark.createDataFrame([(1, 10, 1.0, 0.0, 0, 0, False), (2, 90000, 9.0, 2.0, 127, 80, True)], "song_id long, notes long, polyphony double, duration_cv double, velocity_range int, pitch_range int, is_chord boolean")
    songs = spark.createDataFrame([(1, 100.0, 0), (2, 60.0, 9)], "song_id long, seconds double, tempo_changes long")
    m = scores.complexity(tracks, songs)
    levels = {r.song_id: (r.level, r.overall) for r in m.collect()}
    assert levels[1][0] == "minimal" and levels[2] == ("very_complex", round(0.2 + 0.2 + 0.15 + 0.15 * 0.9 + 0.1 + 0.1 + 0.05 / 8 + 0.05, 6))
    strict, loose = scores.recommended_thresholds(m, 0.99).orderBy("song_id").collect(), scores.recommended_thresholds(m, 0.5).orderBy("song_id").collect()
    assert [r.use_case for r in (*strict, *loose)] == ["research"] * 2 + ["demo"] * 2
    assert strict[1].warnings == "high complexity,target hard to reach" and strict[1].note_duration == 1.5
    assert loose[0].note_duration == 2.0 and loose[1].note_duration == 9.0
