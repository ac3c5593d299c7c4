"""Round trip: encoding notes as tokens and back, matching original with reconstructed notes and tracks, and what differs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .notes import PPQ

#: Ticks within which a partner is looked for; weights of the match score; tolerances of starts, velocities and lengths.
WINDOW, W_PITCH, W_VELOCITY, W_LENGTH = 480, 10.0, 0.1, 0.5
START, VELOCITY, LENGTH = 1, 1, 2
#: Fixed value: near pitches in the order in which they are tried.
NEAR = (-1, 1, -2, 2)
#: Least timing accuracy by strategy, and that of others.
TIMING = {"REMI": 0.93, "MIDI-Like": 0.98, "TSD": 0.90, "Structured": 0.95, "CPWord": 0.94, "Octuple": 0.96}
TRACK = ["song_id", "track_idx"]
_NOTE = ["start_tick", "end_tick", "pitch", "velocity"]


def _greedy(rows: Iterator[tuple], free: dict[int, int]) -> Iterator[tuple]:
    """The serial rule on one track. rows: side, start, end, pitch, velocity in order of the time when they are due; an original is due
    WINDOW ticks after its start, when all that it may take have come. free: reconstructed notes of each pitch in the whole track.

    Yields note, partner, and differences of start, length, velocity and pitch. Only notes near the present are held.
    """
    held: dict[int, list[tuple]] = {}
    notes = partners = 0

    def gone(before: float) -> Iterator[tuple]:
        for waiting in held.values():
            while waiting and waiting[0][0] < before:
                yield None, waiting.pop(0)[1], None, None, None, None

    swept = 0
    for side, start, end, pitch, velocity in rows:
        if side:
            partners += 1
            held.setdefault(pitch, []).append((start, partners, end - start, velocity))
            continue
        notes += 1
        if start >= swept + WINDOW:
            yield from gone(start - WINDOW)
            swept = start
        best, least = None, float("inf")
        for p in (pitch,) if free.get(pitch) else [pitch + d for d in NEAR]:
            for place, (s, _, length, v) in enumerate(held.get(p, ())):
                score = abs(s - start) + W_PITCH * abs(p - pitch) + W_VELOCITY * abs(v - velocity) + W_LENGTH * abs(length - (end - start))
                if abs(s - start) <= WINDOW and score < least:
                    best, least = (p, place), score
        if best is None:
            yield notes, None, None, None, None, None
        else:
            p, place = best
            s, partner, length, v = held[p].pop(place)
            free[p] -= 1
            yield notes, partner, abs(s - start), abs(length - (end - start)), abs(v - velocity), abs(p - pitch)
    yield from gone(float("inf"))


def matches(original: DataFrame, reconstructed: DataFrame) -> DataFrame:
    """One row a note: pairs of an original and its partner, originals without one (missing) and reconstructed ones that nobody took (extra), with differences.

    Originals in order of (start, pitch, end, velocity) each take the free note with the lowest score (start difference + 10 pitch + 0.1
    velocity + 0.5 length) within WINDOW ticks: one of their pitch while the track has a free one of it anywhere, else one that is
    one or two semitones away (below first, at equal scores). note and partner number both sides in that order.

    Both sides are shuffled once, by track, and read in order of time; a task holds the notes of a track within WINDOW ticks and its
    number of free notes a pitch. The rule is serial in a track, so a track is one task's work. Null ticks, pitches or
    velocities aren't notes; such rows are left out.
    """
    rows = _side(original, 0).unionByName(_side(reconstructed, 1))
    # how many there are of each pitch comes first, as rows of side 2
    heads = _side(reconstructed, 1).groupBy(*TRACK, "pitch").agg(F.count("*").alias("start_tick"))
    return _matched(rows.unionByName(heads.select(*TRACK, F.lit(2).alias("side"), "start_tick", F.lit(0).cast("long").alias("end_tick"), "pitch", F.lit(0).alias("velocity"))))


def _side(notes: DataFrame, side: int) -> DataFrame:
    return notes.select(F.col("song_id").cast("long").alias("song_id"), F.col("track_idx").cast("int").alias("track_idx"), F.lit(side).alias("side"), *_NOTE).dropna()


def _matched(rows: DataFrame) -> DataFrame:
    """matches() of rows of both sides (0: original, 1: reconstructed) and of side 2, which say how many reconstructed notes (start_tick) of a pitch a track has; they add up."""
    due = F.when(F.col("side") == 0, F.col("start_tick") + WINDOW).when(F.col("side") == 1, F.col("start_tick"))
    order = [*TRACK, due.asc_nulls_first(), F.col("side").desc(), "start_tick", "pitch", "end_tick", "velocity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*(b.column(c).to_numpy(zero_copy_only=False).tolist() for c in (*TRACK, "side", *_NOTE)), strict=True)

        out: list[tuple] = []
        for track, own in groupby(read(), key=lambda r: r[:2]):
            free: dict[int, int] = {}
            first = next(own)
            while first and first[2] == 2:
                free[first[5]] = free.get(first[5], 0) + first[3]
                first = next(own, None)
            for found in _greedy((r[2:] for r in chain([first] if first else [], own)), free):
                out.append((*track, *found))
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
        yield batch(out)

    names = [*TRACK, "note", "partner", "start_diff", "length_diff", "velocity_diff", "pitch_diff"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    dealt = rows.repartition(*TRACK).sortWithinPartitions(*order).select(*TRACK, "side", *_NOTE)
    found = dealt.mapInArrow(run, "song_id long, track_idx int, note int, partner int, start_diff long, length_diff long, velocity_diff int, pitch_diff int")
    kind = F.when(F.col("partner").isNull(), "missing").when(F.col("note").isNull(), "extra").otherwise("pair")
    return found.select(*TRACK, "note", "partner", kind.alias("kind"), "start_diff", "length_diff", "velocity_diff", "pitch_diff")


def match_score() -> Column:
    """The score of a pair from its differences."""
    return F.col("start_diff") + W_PITCH * F.col("pitch_diff") + W_VELOCITY * F.col("velocity_diff") + W_LENGTH * F.col("length_diff")


def track_errors(matched: DataFrame) -> DataFrame:
    """By track: notes on both sides, missing, extra, timing and velocity errors, and pairs of equal pitch over the greater number of notes."""
    pair = F.col("kind") == "pair"
    t = matched.groupBy(*TRACK).agg(
        F.count_if(F.col("kind") != "extra").alias("original"), F.count_if(F.col("kind") != "missing").alias("reconstructed"), F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"),
        F.count_if(F.col("start_diff") > START).alias("timing_errors"), F.count_if(F.col("velocity_diff") > VELOCITY).alias("velocity_errors"), F.count_if(pair & (F.col("pitch_diff") == 0)).alias("_same"),
    )
    return t.withColumn("accuracy", F.col("_same") / F.greatest("original", "reconstructed", F.lit(1))).drop("_same")


def song_metrics(tracks: DataFrame) -> DataFrame:
    """By song from its tracks: ratios and accuracies over its notes; overall is 1 less all errors over four a note."""
    names = ("original", "reconstructed", "missing", "extra", "timing_errors", "velocity_errors")
    s = tracks.groupBy("song_id").agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("tracks"), F.count_if(F.col("accuracy") < 0.9).alias("poor"), F.count_if(F.col("accuracy") < 0.5).alias("failed"), F.count_if((F.col("original") > 0) & (F.col("reconstructed") == 0)).alias("gone"))
    return s.select("*", *(v.alias(k) for k, v in ratios().items()))


def ratios() -> dict[str, Column]:
    """Ratios and accuracies of a song from its numbers of notes and errors."""
    n = F.greatest("original", F.lit(1))
    some = F.col("original") > 0
    errors = F.col("missing") + F.col("extra") + F.col("timing_errors") + F.col("velocity_errors")
    values = {"missing_ratio": F.col("missing") / n, "extra_ratio": F.col("extra") / n, "timing": 1 - F.col("timing_errors") / n, "velocity": 1 - F.col("velocity_errors") / n, "overall": 1 - errors / (4 * n)}
    return {k: F.when(some, v).otherwise(0.0) for k, v in values.items()}


def difference_statistics(matched: DataFrame) -> DataFrame:
    """By song, mean and greatest difference of starts, lengths and velocities over pairs."""
    names = ("start", "length", "velocity")
    return matched.where("kind = 'pair'").groupBy("song_id").agg(*(f(F.col(f"{c}_diff")).alias(f"{n}_{c}") for c in names for n, f in (("mean", lambda x: F.round(F.avg(x), 6)), ("max", F.max))))


def match_summary(matched: DataFrame) -> DataFrame:
    """By song: exact pairs, pairs of the right pitch only, missing and extra notes, timing and velocity issues."""
    pair, same = F.col("kind") == "pair", F.col("pitch_diff") == 0
    exact = pair & same & (F.col("start_diff") <= START) & (F.col("velocity_diff") <= VELOCITY) & (F.col("length_diff") <= LENGTH)
    return matched.groupBy("song_id").agg(
        F.count_if(exact).alias("exact"), F.count_if(pair & same & ~exact).alias("pitch_only"), F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"),
        F.count_if(F.col("start_diff") > START).alias("timing_issues"), F.count_if(F.col("velocity_diff") > VELOCITY).alias("velocity_issues"),
    )


def comparison_summary(tracks: DataFrame) -> DataFrame:
    """By song: tracks, perfect ones, mean accuracy, tracks with missing and with extra notes."""
    return tracks.groupBy("song_id").agg(F.count("*").alias("tracks"), F.count_if(F.col("accuracy") == 1).alias("perfect"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.count_if(F.col("missing") > 0).alias("with_missing"), F.count_if(F.col("extra") > 0).alias("with_extra"))


def tolerance_verdict(metrics: DataFrame, strategy: str = "REMI", quality: float = 0.95, ratio: float = 0.01) -> DataFrame:
    """Of song_metrics the names of what exceeds its tolerance (errors) and of what comes near (warnings); valid without errors."""
    return metrics.select("song_id", *_verdict(strategy, quality, ratio)).withColumn("valid", F.col("errors") == "")


def _verdict(strategy: str, quality: float = 0.95, ratio: float = 0.01) -> tuple[Column, Column]:
    """errors and warnings from the columns of song_metrics."""
    c, timing = F.col, TIMING.get(strategy, 0.95)
    errors = [
        (c("missing_ratio") > ratio, "missing notes"), (c("extra_ratio") > ratio, "extra notes"), (c("timing") < timing, "timing"), (c("velocity") < 0.90, "velocity"), (c("overall") < quality, "quality"), (c("failed") > 0, "failed tracks"), (c("gone") > 0, "missing tracks"),
    ]
    warnings = [
        (c("missing_ratio") > ratio / 2, "missing notes"), (c("extra_ratio") > ratio / 2, "extra notes"), ((c("timing") >= timing) & (c("timing") < timing + 0.02), "timing"), (c("velocity") < 0.95, "velocity"), (c("overall") < quality + 0.02, "quality"), (c("poor") > c("tracks") * 0.2, "poor tracks"),
    ]
    said = lambda rules: F.array_join(F.array_compact(F.array(*(F.when(x, F.lit(t)) for x, t in rules))), ",")
    return said(errors).alias("errors"), said(warnings).alias("warnings")


def track_pairs(original: DataFrame, reconstructed: DataFrame, least: float = 5.0) -> DataFrame:
    """Tracks of both sides of a song paired greedily in order (song_id, track_idx, name, program, is_drum, notes): the likest free track of LEAST likeness or more.

    Likeness: 10 for the same drum flag, 5 for the same program of other tracks, 3 for equal names or 1.5 for one in the other, and twice the ratio of
    notes (1 if both have none). Pairs of a song's tracks are few, so they are folded in one array a song, in order.
    """
    a = original.select("song_id", *(F.col(c).alias(f"{c}_a") for c in ("track_idx", "name", "program", "is_drum", "notes")))
    b = reconstructed.select("song_id", *(F.col(c).alias(f"{c}_b") for c in ("track_idx", "name", "program", "is_drum", "notes")))
    x, y = F.lower("name_a"), F.lower("name_b")
    named = F.when((x == "") | (y == ""), 0.0).when(x == y, 3.0).when(F.contains(x, y) | F.contains(y, x), 1.5).otherwise(0.0)
    most = F.greatest("notes_a", "notes_b")
    score = F.when(F.col("is_drum_a") == F.col("is_drum_b"), 10.0).otherwise(0.0) + F.when(~F.col("is_drum_a") & ~F.col("is_drum_b") & (F.col("program_a") == F.col("program_b")), 5.0).otherwise(0.0) + F.coalesce(named, F.lit(0.0)) + F.when(most > 0, 2.0 * F.least("notes_a", "notes_b") / most).otherwise(1.0)
    options = a.join(b, "song_id").withColumn("score", score).where(F.col("score") >= least)
    ranked = options.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct(F.col("track_idx_a").alias("a"), (-F.col("score")).alias("s"), F.col("track_idx_b").alias("b")))).alias("o"))

    def step(acc: Column, z: Column) -> Column:
        taken = F.exists(acc, lambda p: (p["a"] == z["a"]) | (p["b"] == z["b"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(z)))

    empty = F.array().cast("array<struct<a:int,s:double,b:int>>")
    return ranked.select("song_id", F.explode(F.aggregate("o", empty, step)).alias("p")).select("song_id", F.col("p.a").alias("track_idx"), F.col("p.b").alias("partner"), F.round(-F.col("p.s"), 6).alias("score"))


def encoded(notes: DataFrame, programs: DataFrame, songs: DataFrame, steps: int = 12, velocities: int = 16, low: int = 21, high: int = 108, ppq: int = PPQ) -> DataFrame:
    """Notes as a sequence of token names: per bar Bar, per onset Position, per note Program, Pitch, Velocity (bin) and Duration (steps).

    steps: positions a beat. Positions are rounded half to even and kept in the bar; lengths are 1 to 48 steps; pitches out of low..high are left out.
    Every bar up to a song's last one is there. programs: song_id, track_idx, program. songs: song_id, ts_num, ts_den.
    """
    n = notes.where(F.col("pitch").between(low, high)).join(programs.select(*TRACK, "program"), TRACK).join(songs.select("song_id", "ts_num", "ts_den"), "song_id")
    r = runs(n.withColumn("encodes", F.lit(True)), steps, velocities, ppq).select("song_id", "pos", F.posexplode("tokens").alias("j", "token"))
    return r.select("song_id", (F.col("pos") + F.col("j") + 1).cast("int").alias("pos"), "token")


def runs(notes: DataFrame, steps: int = 12, velocities: int = 16, ppq: int = PPQ) -> DataFrame:
    """The sequence of encoded() cut after each note: notes with tokens, the names up to the end of the note's own (bars since the note before, Position where it is new, its
    four), and pos, the number of names before them. notes: song_id, program, ts_num, ts_den, encodes (whether a row is encoded; others get no tokens) and the note.

    Songs are sorted once, a row a note, and names are made after that, so neither bars nor names are rows that a sort holds.
    """
    per_bar = F.col("ts_num") * 4 * ppq / F.col("ts_den")
    n = notes.withColumn("bar", F.floor(F.col("start_tick") / per_bar)).withColumn("last_step", (per_bar * steps / ppq - 1).cast("int"))
    at = F.least(F.rint((F.col("start_tick") - F.col("bar") * per_bar) * steps / ppq).cast("int"), F.col("last_step"))
    size = F.greatest(F.lit(1), F.least(F.lit(48), F.rint((F.col("end_tick") - F.col("start_tick")) * steps / ppq).cast("int")))
    bin_ = F.floor((F.col("velocity") - 1) * velocities / 127).cast("int")
    n = n.select(*notes.columns, "bar", at.alias("at"), bin_.alias("v"), size.alias("d"))
    order = Window.partitionBy("song_id").orderBy("encodes", "bar", "at", "program", "pitch", "v", "d")
    n = n.withColumn("last", F.lag(F.when(F.col("encodes"), F.struct("bar", "at"))).over(order))
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    # bars are counted from 0, whatever lies before
    bars = (F.greatest("bar", F.lit(-1)) - F.greatest(F.col("last.bar"), F.lit(-1))).cast("int")
    moved = F.col("last").isNull() | ~(F.col("bar").eqNullSafe(F.col("last.bar")) & F.col("at").eqNullSafe(F.col("last.at")))
    own = F.array_compact(F.array(F.when(moved, named("Position_", "at")), named("Program_", "program"), named("Pitch_", "pitch"), named("Velocity_", "v"), named("Duration_", "d")))
    n = n.withColumn("tokens", F.when(F.col("encodes"), F.concat(F.array_repeat(F.lit("Bar_None"), bars), own)).otherwise(F.array().cast("array<string>")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("pos", F.sum(F.size("tokens")).over(upto) - F.size("tokens")).select(*notes.columns, "pos", "tokens")


def decoded(tokens: DataFrame, songs: DataFrame, steps: int = 12, velocities: int = 16, ppq: int = PPQ) -> DataFrame:
    """Notes of a sequence of token names (song_id, pos, token): program, start_tick, end_tick, pitch and velocity (the middle of its bin)."""
    order = Window.partitionBy("song_id").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    kind, number = F.split_part("token", F.lit("_"), F.lit(1)), F.split_part("token", F.lit("_"), F.lit(2)).try_cast("int")
    t = tokens.select("song_id", "pos", kind.alias("kind"), number.alias("x"))
    last = lambda k: F.last(F.when(F.col("kind") == k, F.col("x")), ignorenulls=True).over(upto)
    after = lambda i: F.lead("x", i).over(order)
    t = t.select("song_id", "kind", "x", (F.sum((F.col("kind") == "Bar").cast("int")).over(upto) - 1).alias("bar"), last("Position").alias("at"), last("Program").alias("program"), after(1).alias("v"), after(2).alias("d"))
    n = t.where("kind = 'Pitch'").join(songs.select("song_id", "ts_num", "ts_den"), "song_id")
    start = (F.col("bar") * F.col("ts_num") * 4 * ppq / F.col("ts_den") + F.col("at") * ppq / steps).cast("long")
    velocity = F.floor((F.col("v") + 0.5) * 127 / velocities + 1).cast("int")
    return n.select("song_id", "program", start.alias("start_tick"), (start + F.col("d") * ppq / steps).cast("long").alias("end_tick"), F.col("x").alias("pitch"), velocity.alias("velocity"))


def round_trip(notes: DataFrame, programs: DataFrame, songs: DataFrame, strategy: str = "REMI") -> DataFrame:
    """Encodes and decodes notes, matches both sides by track and gives each song's metrics and verdict. Tracks of a song with one program come back as one, so both sides are compared by program."""
    # a song that stands twice in songs has its notes encoded twice, but they are compared once
    signed = songs.groupBy("song_id").agg(F.collect_list(F.struct("ts_num", "ts_den")).alias("signed"))
    n = notes.join(programs.select(*TRACK, "program"), TRACK).join(signed, "song_id", "left").select("song_id", "program", *_NOTE, F.posexplode_outer("signed").alias("nth", "s"))
    return round_trip_of(n.select("song_id", "program", "s.ts_num", "s.ts_den", *_NOTE, (F.coalesce("nth", F.lit(0)) == 0).alias("compared")), strategy)


def decoded_runs(cut: DataFrame, steps: int = 12, velocities: int = 16, ppq: int = PPQ) -> DataFrame:
    """decoded() for a sequence cut after its notes, as runs() gives it: cut's rows with back, the note that their tokens stand for (null if none). Only pos, tokens and the
    song's ts_num and ts_den are looked at."""
    own = F.array_remove("tokens", "Bar_None")
    t = cut.withColumn("said", F.str_to_map(F.array_join(own, ","), F.lit(","), F.lit("_"))).withColumn("bars", F.size("tokens") - F.size(own))
    said = lambda k: F.try_element_at("said", F.lit(k)).try_cast("int")
    t = t.select(*(c for c in cut.columns if c != "tokens"), "bars", *(said(k).alias(f"_{k}") for k in ("Position", "Program", "Pitch", "Velocity", "Duration")))
    upto = Window.partitionBy("song_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda k: F.last(f"_{k}", ignorenulls=True).over(upto).alias(f"_{k}")
    t = t.select(*cut.drop("tokens").columns, (F.sum("bars").over(upto) - 1).alias("bar"), last("Position"), last("Program"), "_Pitch", "_Velocity", "_Duration")
    start = (F.col("bar") * F.col("ts_num") * 4 * ppq / F.col("ts_den") + F.col("_Position") * ppq / steps).cast("long")
    velocity = F.floor((F.col("_Velocity") + 0.5) * 127 / velocities + 1).cast("int")
    note = F.struct(F.col("_Program").alias("program"), start.alias("start_tick"), (start + F.col("_Duration") * ppq / steps).cast("long").alias("end_tick"), F.col("_Pitch").alias("pitch"), velocity.alias("velocity"))
    return t.select(*cut.drop("tokens").columns, F.when(F.col("_Pitch").isNotNull(), note).alias("back"))


def round_trip_of(notes: DataFrame, strategy: str = "REMI", low: int = 21, high: int = 108) -> DataFrame:
    """round_trip() of notes with their track's program and their song's ts_num and ts_den (song_id, program, ts_num, ts_den, the note, and compared: whether the row is an original).

    A note and what its tokens are decoded to go on from one row as rows of both sides, so songs are encoded once, in one sort.
    """
    encodes = F.coalesce(F.col("pitch").between(low, high) & F.col("ts_num").isNotNull() & F.col("ts_den").isNotNull(), F.lit(False))
    trip = decoded_runs(runs(notes.withColumn("encodes", encodes)))
    b = F.col("back")
    row = lambda side, program, *note: F.struct(program.cast("int").alias("track_idx"), F.lit(side).alias("side"), *(x.cast(t).alias(c) for c, t, x in zip(_NOTE, ("long", "long", "int", "int"), note, strict=True)))
    sides = F.array(row(0, F.when(F.col("compared"), F.col("program")), *map(F.col, _NOTE)), row(1, b["program"], *(b[c] for c in _NOTE)), row(2, F.when(b["start_tick"].isNotNull() & b["end_tick"].isNotNull() & b["velocity"].isNotNull(), b["program"]), F.lit(1), F.lit(0), b["pitch"], F.lit(0)))
    rows = trip.select(F.col("song_id").cast("long").alias("song_id"), F.explode(sides).alias("r")).select("song_id", "r.*").dropna()
    metrics = song_metrics(track_errors(_matched(rows)))
    return metrics.select("*", *_verdict(strategy)).withColumn("valid", F.col("errors") == "")
