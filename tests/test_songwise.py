"""Scores of songs whose notes are shuffled once: the same rows as from the queries that they combine, each with shuffles of its own, on odd tables too."""

import datetime
import math
import random
import types

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from stavework.operators import scores, song_metrics, songwise
from stavework.operators import tracks as kinds
from stavework.operators.notes import track_statistics
from stavework.plans import corpus, registry
from stavework.plans import scores as plans

LINES = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_suppkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_quantity", pa.float64()), ("l_extendedprice", pa.float64()), ("l_shipdate", pa.date32())])


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Songs of 1 to 400 notes, one on the original side only, one of equal notes, one without a number, and notes that lack a value."""
    rng = random.Random(17)
    rows = []
    for song in (*range(1, 13), None):
        n = {1: 1, 2: 4, 3: 9, 4: 10, 5: 11, 6: 19, 7: 400}.get(song, 60)
        for i in range(n):
            day = datetime.date(1994, 1, 1) + datetime.timedelta(days=0 if song == 9 else rng.randrange(1500))
            row = [97 * rng.randrange(9) if song == 8 else rng.randrange(5000), 5 if song == 9 else rng.randrange(900), song, 1 if song == 9 else rng.randrange(1, 8), 9.0 if song == 9 else rng.randrange(1, 50) + 0.0, 7.0 if song == 9 else rng.random() * 9000, day]
            if song in (10, 11, None) and rng.random() < (0.6 if song == 11 else 0.2):
                row[rng.choice((1, 3, 4, 5, 6) if song != 11 else (1, 5))] = None
            rows.append([*row])
    rng.shuffle(rows)
    out = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), LINES.types, strict=True)], schema=LINES), out / "lineitem.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array(range(1, 13), pa.int64()), "s_name": [f"Supplier#{i}" for i in range(1, 13)]}), out / "supplier.parquet")
    for name in ("events", "embeddings"):
        pq.write_table(pa.table({"unused": [1]}), out / f"{name}.parquet")
    return str(out)


def rows(df):
    names = sorted(df.columns)
    known = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return names, sorted(([known(r[n]) for n in names] for r in df.collect()), key=repr)


def near(x, y):
    return math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y


def check(spark, folder, at_once, apart, reads=2):
    """The same rows, and one shuffle of notes."""
    out = at_once[0](spark, folder)
    names, found = rows(out)
    # apart, a song whose values don't vary ends the job: its correlation is divided by zero
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        same, wanted = rows(scores.known(apart[0](spark, folder)))
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert names == same and len(found) == len(wanted) > 0
    assert [(dict(zip(names, f, strict=True)), [(n, u, v) for n, u, v in zip(names, f, w, strict=True) if not near(u, v)]) for f, w in zip(sorted(found, key=lambda r: repr(r[names.index("song_id")])), sorted(wanted, key=lambda r: repr(r[names.index("song_id")])), strict=True) if not all(map(near, f, w))] == []
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # each side reads the lines once
    assert plan.count("RepartitionByExpression") == 1 and sum("Relation" in line and "l_suppkey" in line for line in plan.splitlines()) == reads


def test_statistics_shuffle_notes_once(spark, odd):
    check(spark, odd, plans.STATISTICS, plans.STATISTICS_APART)


def test_harmony_shuffles_notes_once(spark, odd):
    check(spark, odd, plans.HARMONY, plans.HARMONY_APART)


def test_features_shuffle_notes_once(spark, odd):
    check(spark, odd, plans.FEATURES, plans.FEATURES_APART)


def test_quality_shuffles_notes_once(spark, odd):
    # tracks are the third to read lines, for their numbers only
    check(spark, odd, corpus.METRICS, corpus.METRICS_APART, reads=3)


@pytest.mark.parametrize("name", ["STA22", "STA23", "MUS08", "MUS09", "QUA11"])
def test_scores_are_made_of_one_shuffle(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    # MUS09's and QUA11's tempos are a table of their own, of some rows a song
    assert name in ("MUS09", "QUA11") or not any(x in plan for x in ("Window", "Join", "Aggregate"))


def test_chords_and_pairs_equal_brute_force(monkeypatch):
    rng = random.Random(4)
    notes = sorted((rng.randrange(0, 400, rng.choice((1, 3, 12))), rng.choice((40, 41, 44, 52, 60, 63))) for _ in range(150))
    notes = np.array(notes, float)
    side = types.SimpleNamespace(start_tick=notes[:, 0], pitch=notes[:, 1])
    chords, first = [], None
    for t, p in notes:
        if first is None or t - first > 10:
            first = t
            chords.append(0)
        chords[-1] |= 1 << int(p) % 12
    assert song_metrics._chords(side).tolist() == chords
    ends = notes[:, 0] + np.array([rng.choice((0, -5, 1, 30, 90)) for _ in notes])
    pairs = [abs(notes[i, 1] - notes[j, 1]) for i in range(len(notes)) for j in range(i + 1, len(notes)) if notes[j, 0] < ends[i]]
    for most in (1 << 18, 3):
        monkeypatch.setattr(song_metrics, "MOST_PAIRS", most)
        assert song_metrics._overlap(notes[:, 0], ends, notes[:, 1]) == (len(pairs), sum(pairs))


def test_statistics_of_tracks(spark):
    rng = random.Random(6)
    notes = []
    for song in range(1, 6):
        for _ in range(rng.randrange(1, 60)):
            start = rng.randrange(0, 3000, 20)
            notes.append([song, rng.randrange(3), start, start + rng.choice((0, -40, 20, 90, 400)), rng.randrange(30, 90), rng.randrange(1, 128)])
            if song > 3 and rng.random() < 0.2:
                notes[-1][rng.randrange(1, 5)] = None
    t = spark.createDataFrame([tuple(r) for r in notes], "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int")
    wanted = {(r.song_id, r.track_idx): [r[c] for c in song_metrics.TRACK[1:]] for r in track_statistics(t).collect() if r.track_idx is not None}
    out = songwise.each_song(t, t, (", ".join(f"{c} array<double>" for c in song_metrics.TRACK), song_metrics._of_tracks)).collect()
    found = {(r.song_id, int(track)): values for r in out for track, *values in zip(*(r[c] for c in song_metrics.TRACK), strict=True)}
    assert found.keys() == wanted.keys()
    assert [(k, f, w) for k in found for f, w in zip(found[k], wanted[k], strict=True) if f != w and not (f is not None and w is not None and math.isclose(f, w, rel_tol=1e-9))] == []


def test_drums_follow_from_names_too(spark):
    # an unsure name counts unless statistics are sure: the second song's track is sure to be a melody by them
    kind = "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int"
    rows = [(s, 0, i * 960, i * 960 + 480, 62 + i % 2 * 14 if s == 2 else 50 + i % 2, 64) for s in (1, 2, 3) for i in range(20)]
    t = spark.createDataFrame(rows, kind)
    tempo = spark.createDataFrame([(1, 1.0)], "song_id long, stability double")
    tracks = spark.createDataFrame([(1, 0, "Bater 1", False), (1, 1, "no notes", False), (2, 0, "Bater 2", False), (3, 0, "Synth", True)], "song_id long, track_idx int, name string, is_drum boolean")
    found = {r.song_id: (r.drums, r.notes, r.overall, r.polyphony) for r in song_metrics.quality(t, t, tempo, tracks).collect()}
    wanted = {s: max(r.type == "drums" for r in kinds.classified(tracks, track_statistics(t)).where(f"song_id = {s}").collect()) for s in (1, 2, 3)}
    assert found == {s: (int(w), 20, 1.0, 1.0) for s, w in wanted.items()} and wanted[1] and not wanted[2] and wanted[3]


def test_pieces_give_notes_back():
    rng = random.Random(3)
    values = [-(1 << 40), -129, -128, -1, 0, 127, 128, 32767, 40000, 1 << 33, None]
    for few in (values[2:6], values[:10], values):
        rows = [(rng.choice((None, 0, 5, 1 << 50)), *(rng.choice(few) for _ in songwise.ORDER)) for _ in range(3000)]
        names = ["song_id", *songwise.ORDER]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], names) for part in (rows[:1000], rows[1000:])]
        pieces = songwise._pieces(batches, 1)
        assert max(len(p.as_buffer()) for p in pieces.column("notes")) <= songwise.MOST_NOTES * 40
        found = {}
        for song, empty, side in songwise._songs(iter([pieces.slice(i, 1) for i in range(len(pieces))])):
            assert len(empty) == 0 and song not in found
            found[song] = [tuple(None if np.isnan(v) else int(v) for v in note) for note in zip(*(getattr(side, c) for c in songwise.ORDER), strict=True)]
        low = lambda note: [songwise.NONE if v is None else v for v in note]
        assert found == {s: sorted((r[1:] for r in rows if r[0] == s), key=low) for s in {r[0] for r in rows}}
    small = [(0, 480 + i, 60, 3, 490, 64) for i in range(100)]
    one = songwise._pieces([pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*small, strict=True)], ["song_id", *songwise.ORDER])], 0)
    assert len(one) == 1 and len(one.column("notes")[0].as_buffer()) == 700
