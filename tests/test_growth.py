"""Rows that tables grown by many copies have: equal notes of a song, long songs, many equal values."""

import random

import pandas as pd

from stavework.operators import compare, notes, roundtrip, scores, sequences, statistics, structure, training
from stavework.plans import registry
from stavework.plans import scores as plans


def test_equal_notes_keep_their_positions(spark):
    # a melody note three times (position, pitch, velocity, duration each, equal tokens together), then one alone; a chord note twice
    ids = [4, 531, 40, 40, 93, 93, 109, 109, 532, 160, 160, 160, 50, 50, 50, 94, 94, 94, 110, 110, 110, 170, 51, 95, 111, 4, 531, 532, 157, 60, 93, 109]
    t = spark.createDataFrame([(s, i + 1, x) for s in (1, 2) for i, x in enumerate(ids)], "song_id long, pos long, token_id int")
    back = structure.reordered(structure.restored(t))
    assert [tuple(r) for r in back.orderBy("song_id", "pos").collect()] == [tuple(r) for r in t.orderBy("song_id", "pos").collect()]


def brute(ids, least, longest, times, k):
    found = {}
    for length in range(least, longest + 1):
        for i in range(len(ids) - length + 1 if length < len(ids) // 2 else 0):
            found.setdefault(tuple(ids[i : i + length]), []).append(i)
    best = sorted((-len(at) * len(g), len(g), at[0], len(at)) for g, at in found.items() if len(at) >= times)[:k]
    return [(place, length, count, first) for place, (_, length, first, count) in enumerate(best, 1)]


def test_patterns_equal_brute_force_and_are_not_shuffled(spark):
    rng = random.Random(3)
    songs = {1: [rng.randrange(3) for _ in range(300)], 2: [rng.randrange(300) for _ in range(200)], 3: [7] * 90, 4: [1, 2, 3] * 4, 5: [1], 6: list(range(50)) * 2}
    t = spark.createDataFrame([(s, i, x) for s, ids in songs.items() for i, x in enumerate(ids)], "song_id long, pos long, token_id int").repartition(5)
    for args in ((4, 19, 2, 20), (3, 19, 3, 10)):
        p = sequences.repeated_patterns(t, *args)
        assert p.dtypes == [("song_id", "bigint"), ("n", "bigint"), ("place", "int"), ("length", "int"), ("count", "bigint"), ("first", "int")]
        rows = p.orderBy("song_id", "place").collect()
        assert {s: [tuple(r)[2:] for r in rows if r.song_id == s] for s in songs} == {s: brute(ids, *args) for s, ids in songs.items()}
        plan = p._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "xxhash64" not in plan


def test_copies_are_not_shuffled(spark):
    t = spark.createDataFrame([(1, 1, 4), (1, 3, 90), (1, 2, 20)], "song_id long, pos long, token_id int")
    files = spark.createDataFrame([(1, "C", "C-90bpm-remi-a.json")], "song_id long, key string, name string")
    out = training.augmented(t, files, (1, 2))
    assert sorted((r.offset, r.n_tokens, r.moved, r.kept, r.success) for r in out.collect()) == [(1, 3, 1, 1, False), (2, 3, 1, 1, False)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate")[0]
    assert "Generate" in plan and "Aggregate" not in above


def test_warping_of_a_batch_of_songs(spark):
    rng = random.Random(8)
    sides = [[[rng.randrange(40, 80) for _ in range(rng.randrange(1, 9))] for _ in range(50)] for _ in range(2)]
    best = []
    for x, y in zip(*sides, strict=True):
        t = {(-1, -1): 0}
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                t[i, j] = abs(p - q) + min(t.get(k, float("inf")) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
        best.append(t[len(x) - 1, len(y) - 1])
    assert scores._warped(*(pd.Series(s) for s in sides)).tolist() == best
    few = spark.createDataFrame([(1, 0, 0, 5, 60, 64)], NOTE)
    assert "ArrowEvalPython" in scores.warping_distance(few, few)._jdf.queryExecution().optimizedPlan().toString()


def test_parts_of_a_song_meet_without_joins(spark):
    first = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, None), (None, 5.0)], "song_id long, x double")
    other = spark.createDataFrame([(1, True), (3, True), (None, True)], "song_id long, y boolean")
    run, _ = plans.by_song([((lambda *_: first, "a"), {"x": "max(x)"}), ((lambda *_: other, "b"), {"y": "max(y)"})], {"z": "x + 1"}, "y")
    out = run(spark, "")
    assert {(x, y, z) for _, x, y, z in out.collect()} == {(3.0, True, 4.0), (0.0, False, 1.0), (5.0, False, 6.0)} and out.count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Union")[0].count("Exchange") == 1


NOTE = "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int"


def test_ranks_take_one_sort_a_value(spark):
    pairs = spark.createDataFrame([(1, p, q, v, v) for p, q, v in ((60, 70, 1), (60, 65, 2), (62, 65, 2), (None, 70, 2), (64, 71, 5))], "song_id long, pitch_a int, pitch_b int, velocity_a int, velocity_b int")
    ranks = pairs.select("pitch_a", statistics.mean_rank("pitch_a", "song_id").alias("r"))
    assert sorted((r.pitch_a or 0, r.r) for r in ranks.collect()) == [(0, 1.0), (60, 2.5), (60, 2.5), (62, 4.0), (64, 5.0)]
    out = statistics.spearman(pairs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") == 4 and out.first().velocity == 1.0


def test_track_statistics_keep_parts_apart(spark):
    # two notes end where two start, one lasts no time
    rows = [(1, 0, 0, 10, 60, 1), (1, 0, 0, 10, 60, 1), (1, 0, 10, 30, 61, 1), (1, 0, 10, 20, 62, 1), (1, 0, 40, 40, 63, 1), (1, 1, 5, 9, 60, 1)]
    t = spark.createDataFrame(rows, NOTE)
    levels = notes.polyphony(t)
    assert sorted(map(tuple, levels.collect())) == [(1, 0, 1, 10), (1, 0, 2, 20), (1, 1, 1, 4)]
    assert "Aggregate" not in levels._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]
    out = notes.track_statistics(t)
    found = {r.track_idx: r for r in out.collect()}
    assert (found[0].max_polyphony, found[0].total_notes, found[0].unique_pitches, found[0].empty_ratio) == (2, 6 - 1, 4, 0.25) and found[1].max_polyphony == 1
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_round_trip_is_one_pass(spark):
    rng = random.Random(5)
    rows = []
    for song in (1, 2, 3, 4):
        for _ in range(60):
            start = rng.randrange(0, 9000, 7) + (30_000 if rng.random() < 0.1 else 0)
            rows.append((song, rng.randrange(3), start, start + rng.randrange(1, 2500), rng.choice((10, 60, 61, 64, 108, 120)), rng.randrange(1, 128)))
    t = spark.createDataFrame(rows + rows[:20] + [(1, 0, None, 5, 60, 1), (1, 0, 5, 9, None, 1)], NOTE)
    programs = spark.createDataFrame([(s, k, (0, 0, 33)[k]) for s in (1, 2, 3, 4) for k in range(3)], "song_id long, track_idx int, program int")
    # song 3 has no row, song 4 has two
    songs = spark.createDataFrame([(1, 4, 4), (2, 6, 8), (4, 3, 4), (4, 3, 4)], "song_id long, ts_num int, ts_den int")
    out = roundtrip.round_trip(t, programs, songs)
    sides = t.join(programs, ["song_id", "track_idx"]).drop("track_idx").withColumnRenamed("program", "track_idx")
    back = roundtrip.decoded(roundtrip.encoded(t, programs, songs), songs.distinct()).withColumnRenamed("program", "track_idx")
    metrics = roundtrip.song_metrics(roundtrip.track_errors(roundtrip.matches(sides, back)))
    long_way = metrics.join(roundtrip.tolerance_verdict(metrics), "song_id").select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, long_way.collect()))
    assert {r.song_id: r.reconstructed for r in out.collect()}[3] == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Window ") == 3


def test_names_are_made_after_a_song_is_sorted(spark):
    t = spark.createDataFrame([(1, 0, 4000, 4100, 60, 64), (1, 0, 4000, 4100, 60, 64)], NOTE)
    out = roundtrip.encoded(t, spark.createDataFrame([(1, 0, 5)], "song_id long, track_idx int, program int"), spark.createDataFrame([(1, 4, 4)], "song_id long, ts_num int, ts_den int"))
    own = ["Program_5", "Pitch_60", "Velocity_7", "Duration_2"]
    assert [r.token for r in out.orderBy("pos").collect()] == ["Bar_None"] * 3 + ["Position_4", *own, *own]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan.split("Generate")[0] and "Union" not in plan


def test_pairs_are_counted_in_one_sort(spark, monkeypatch):
    rng = random.Random(9)
    make = lambda n, songs: [(s, rng.randrange(2), rng.randrange(40), 50 + rng.randrange(9), rng.randrange(50, 50 + s), rng.randrange(1, 5)) for s in songs for _ in range(n * s)]
    a, b = make(30, (1, 2, 3, 5, 8)), make(25, (1, 2, 3, 5, 9))
    a, b = (spark.createDataFrame(x + [(None, 0, 1, 2, 60, 1), (6, 0, 1, 2, 60, 1)], NOTE) for x in (a, b))
    wanted = sorted(map(tuple, statistics.kendall(compare.paired(a, b)).collect()))
    out = statistics.kendall_of_sides(a, b)
    assert sorted(map(tuple, out.collect())) == wanted and len(wanted) == 5
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan
    monkeypatch.setattr(statistics, "MOST_PENDING", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert sorted(map(tuple, statistics.kendall_of_sides(a, b).collect())) == wanted
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    registered = registry.queries()["STA10"](spark, "/root/testdata/sf0.001")
    assert "Join" not in registered._jdf.queryExecution().optimizedPlan().toString()
