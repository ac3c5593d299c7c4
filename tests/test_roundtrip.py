"""Note matching against brute force, and properties of the round trip."""

import random
from collections import Counter

from pyspark.sql import functions as F

from stavework.operators import roundtrip as rt

SCHEMA = "song_id long, track_idx int, start_tick long, end_tick long, pitch int, velocity int"


def brute(ours, theirs):
    """Notes as (start, end, pitch, velocity), in order: each of ours looks among all free ones of its pitch, or if none is left anywhere, of near pitches."""
    free, pairs = set(range(len(theirs))), {}
    for i, (s, e, p, v) in enumerate(ours):
        same = [j for j, y in enumerate(theirs) if y[2] == p and j in free]
        best, least = None, float("inf")
        for j in same or [j for d in (-1, 1, -2, 2) for j, y in enumerate(theirs) if y[2] == p + d and j in free]:
            t, f, q, w = theirs[j]
            score = abs(t - s) + 10 * abs(q - p) + 0.1 * abs(w - v) + 0.5 * abs((f - t) - (e - s))
            if abs(t - s) <= 480 and score < least:
                best, least = j, score
        if best is not None:
            free.discard(best)
            pairs[i] = best
    return pairs, free


def test_matches_equal_brute_force(spark):
    rng = random.Random(3)
    a, b, want = [], [], Counter()
    for song in range(12):
        for track in range(2):
            ours = sorted((rng.randrange(0, 6000, 30), 0, rng.randrange(60, 62 + song), rng.randrange(1, 127)) for _ in range(rng.randrange(0, 60)))
            ours = [(s, s + rng.choice([60, 120, 240]), p, v) for s, _, p, v in ours]
            theirs = [(s + rng.choice([0, 0, 1, 7, 500]), e + rng.choice([0, 3]), p + rng.choice([0, 0, 0, 1, 2]), v) for s, e, p, v in ours if rng.random() < 0.85]
            order = lambda r: (r[0], r[2], r[1], r[3])
            ours, theirs = sorted(ours, key=order), sorted(theirs, key=order)
            pairs, free = brute(ours, theirs)
            want.update((song, track, i + 1, j + 1) for i, j in pairs.items())
            want.update((song, track, None, j + 1) for j in free)
            want.update((song, track, i + 1, None) for i in range(len(ours)) if i not in pairs)
            a += [(song, track, *x) for x in ours]
            b += [(song, track, *x) for x in theirs]
    out = rt.matches(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)).collect()
    assert Counter((r.song_id, r.track_idx, r.note, r.partner) for r in out) == want


def test_serial_order_wins(spark):
    notes = lambda starts: spark.createDataFrame([(1, 0, s, s + 60, 60, 64) for s in starts], SCHEMA)
    pairs = lambda a, b: sorted((r.note, r.partner) for r in rt.matches(notes(a), notes(b)).collect() if r.kind == "pair")
    assert pairs([0, 6], [7, 1]) == [(1, 1), (2, 2)]
    assert pairs([0, 4], [4]) == [(1, 1)]


def test_a_free_note_anywhere_keeps_from_near_pitches(spark):
    """The second original has no free note of its pitch near it, but one far away: it may not take the near pitch. Later, with that one taken, it may."""
    table = lambda rows: spark.createDataFrame([(1, 0, s, s + 60, p, 64) for s, p in rows], SCHEMA)
    pairs = lambda a, b: sorted((r.note, r.partner, r.pitch_diff) for r in rt.matches(table(a), table(b)).collect() if r.kind == "pair")
    assert pairs([(0, 60), (9000, 60)], [(0, 61), (9000, 60)]) == [(2, 2, 0)]
    assert pairs([(0, 60), (10, 60)], [(0, 60), (10, 61)]) == [(1, 1, 0), (2, 2, 1)]
    assert pairs([(0, 60)], [(0, 58), (0, 62), (30, 59)]) == [(1, 1, 2)]
    odd = spark.createDataFrame([(1, 0, None, 5, 60, 64), (1, 0, 0, 5, None, 64)], SCHEMA)
    assert rt.matches(odd, odd).count() == 0


def test_a_song_equals_itself(spark):
    rows = [(1, t, s, s + 100, 60 + s % 7, 64) for t in range(2) for s in range(0, 4000, 50)]
    n = spark.createDataFrame(rows, SCHEMA)
    m = rt.song_metrics(rt.track_errors(rt.matches(n, n))).first()
    assert (m.overall, m.missing, m.extra, m.timing) == (1.0, 0, 0, 1.0)
    assert rt.tolerance_verdict(rt.song_metrics(rt.track_errors(rt.matches(n, n)))).first().valid
    none = n.where(F.lit(False))
    assert rt.song_metrics(rt.track_errors(rt.matches(n, none))).first().missing_ratio == 1.0 and rt.matches(none, none).count() == 0
