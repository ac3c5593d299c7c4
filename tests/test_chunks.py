"""Cuts and chunks against a serial walk of each song, tick by tick."""

import random

import pytest

from stavework.operators import chunks

SIZE, OVERLAP, LEAST, WINDOW, PPQ = 6.0, 1.0, 2.0, 3.0, 24


def songs_at_random(seed):
    """Songs with tempo changes (not always at tick 0), signatures, long silences, held notes and, at times, hardly any notes."""
    rng = random.Random(seed)
    out = {}
    for song in range(20):
        notes, at = [], rng.choice([0, 0, 400])
        for _ in range(rng.choice([1, 60, 120, 200])):
            at += rng.choice([0, 0, 6, 12, 24, 30, 60] + [700] * (song % 4 == 1))
            notes.append((at, at + rng.choice([0, 1, 12, 24, 200])))
        tempos = {t: rng.choice([60, 90, 133, 240]) for t in rng.sample([0, 10, 100, 333, 700, 1500], rng.randrange(4))}
        meters = {t: rng.choice([(4, 4), (3, 4), (6, 8)]) for t in rng.sample([0, 0, 96, 300, 1000], rng.randrange(3))}
        out[song] = (notes, tempos, meters)
    return out


def times(tempos, last):
    out, now = [0.0], tempos.get(0, 120)
    for tick in range(1, last + 1):
        out.append(out[-1] + 60 / (PPQ * now))
        now = tempos.get(tick, now)
    return out


def first_tick(clock, second):
    return next((i for i, t in enumerate(clock) if t >= second - 1e-7), len(clock) - 1)


def plain_cut(notes, meters, clock, target):
    low, high = first_tick(clock, max(0, target - WINDOW / 2)), first_tick(clock, target + WINDOW / 2)
    meter = max((m for m in {0: (4, 4), **meters}.items() if m[0] <= low))
    step = PPQ * 4 * meter[1][0] // meter[1][1]
    places = [(t, 3) for t in {0: 0, **meters}] + [(t, 3) for t in range(meter[0] + step, high + 1, step)] + [(t, 1) for t in range(PPQ, high + 1, PPQ) if t > low // PPQ * PPQ]
    near = sorted(n for n in notes if low <= n[0] <= high or low <= n[1] <= high)
    places += [(a[1], min(2.5, (b[0] - a[1]) / PPQ * 0.5)) for a, b in zip(near, near[1:], strict=False) if b[0] - a[1] > PPQ]
    inside = [(round(w * (1 - abs(clock[t] - target) / WINDOW), 9), w, -t) for t, w in places if low <= t <= high]
    return clock[-max(inside)[2]] if inside else target


def plain_chunks(notes, meters, clock, musical):
    last, total, start, out = len(clock) - 1, clock[-1], 0.0, []
    while start < total:
        target = cut = min(start + SIZE, total)
        if musical and target < total:
            cut = plain_cut(notes, meters, clock, target)
            if cut - start < LEAST:
                cut = min(start + LEAST, total)
        out.append((0 if start == 0 else first_tick(clock, start), min(first_tick(clock, cut), last)))
        if cut >= total:
            break
        start = cut - OVERLAP if cut - OVERLAP > start else start + LEAST
    return out


@pytest.fixture(scope="module")
def tables(spark):
    songs = songs_at_random(7)
    rows = [(s, 0, a, b, 60 + i % 12, i) for s, (notes, _, _) in songs.items() for i, (a, b) in enumerate(notes)]
    notes = spark.createDataFrame(rows, "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int")
    changes = spark.createDataFrame([(s, t, b) for s, (_, tempos, _) in songs.items() for t, b in tempos.items()], "song_id long, tick long, bpm int")
    meters = spark.createDataFrame([(s, t, *m) for s, (_, _, meters) in songs.items() for t, m in meters.items()], "song_id long, tick long, num int, den int")
    return songs, notes, spark.createDataFrame([(s, PPQ) for s in [*songs, 99]], "song_id long, ppq int"), changes, meters


@pytest.mark.parametrize("musical", [True, False])
def test_cuts_and_notes_equal_a_serial_walk(tables, musical):
    songs, notes, headers, changes, meters = tables
    cuts = chunks.chunk_cuts(chunks.song_arrays(notes, headers, changes, meters), SIZE, OVERLAP, LEAST, musical, WINDOW)
    found = {r.song_id: [(c["low"], c["high"]) for c in r.cuts] for r in cuts.collect()}
    held = {}
    for r in chunks.chunked_notes(notes, cuts).collect():
        held.setdefault((r.song_id, r.chunk), set()).add((r.velocity, r.start_tick, r.end_tick, r.truncated))
    several = 0
    for song, (own, tempos, meter) in songs.items():
        clock = times(tempos, max(b for _, b in own))
        expected = plain_chunks(own, meter, clock, musical) if clock[-1] else [(0, 0)]
        assert found[song] == expected, song
        several += len(expected) > 2
        number = 0
        for low, high in expected:
            inside = {(i, max(a, low) - low, max(min(b, high) - low, max(a, low) - low + 1), a < low or b > high) for i, (a, b) in enumerate(own) if a <= high and b >= low}
            number += bool(inside)
            if inside:
                assert held.pop((song, number)) == inside
    assert not held and several > 3 and 99 not in found


def test_headers_hold_what_is_in_force(tables):
    songs, notes, headers, changes, meters = tables
    cuts = chunks.chunk_cuts(chunks.song_arrays(notes, headers, changes, meters), SIZE, OVERLAP, LEAST, window=WINDOW)
    found = {}
    for r in chunks.chunk_headers(cuts).collect():
        found.setdefault((r.song_id, r.part, r.kind), {})[r.tick] = r.value
    for r in cuts.collect():
        _, tempos, meter = songs[r.song_id]
        for part, c in enumerate(r.cuts):
            for kind, known in (("tempo", {0: 120, **tempos}), ("measure", {0: PPQ * 4, **{t: PPQ * 4 * n // d for t, (n, d) in meter.items()}})):
                expected = {t - c["low"]: v for t, v in known.items() if c["low"] <= t <= c["high"]}
                expected.setdefault(0, known[max(t for t in known if t <= c["low"])])
                assert found[r.song_id, part, kind] == expected


def test_defined_results(spark, tables):
    _, notes, headers, changes, meters = tables
    arrays = chunks.song_arrays(notes, headers, changes, meters)
    assert [len(r.cuts) for r in chunks.chunk_cuts(arrays, 1e6, OVERLAP, LEAST).collect()] == [1] * 20
    assert chunks.chunked_notes(notes.limit(0), chunks.chunk_cuts(arrays.limit(0), SIZE, OVERLAP, LEAST)).count() == 0
    with pytest.raises(ValueError, match="longer than its overlap"):
        chunks.chunk_cuts(arrays, 3.0, 2.0, LEAST)
