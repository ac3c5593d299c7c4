"""Long songs cut into overlapping chunks at musical boundaries.

What a cut depends on is gathered once a song (tempo map, time signatures, note spans) as array columns. The next chunk starts where
the last cut fell, so cuts are a fold over a song's array columns, inside the JVM. Notes then find their chunks by a join on
the song alone and a filter of its few cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tempo import let, seconds_at, tempo_maps, tick_at

#: Worth of a cut at a measure, at most at a silence, and at a beat.
MEASURE, PAUSE, BEAT = 3.0, 2.5, 1.0


def song_arrays(notes: DataFrame, songs: DataFrame, changes: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row a song with notes: song_id, ppq, last (tick), tempos, signatures (tick, measure in ticks) and spans (start, end) in order.

    Songs are the unit: a song's distinct note spans are one array, 16 bytes each. Signatures without one at tick 0 begin with 4/4.
    """
    spans = notes.groupBy("song_id").agg(F.max("end_tick").alias("last"), F.array_sort(F.collect_list(F.struct(F.col("start_tick").alias("start"), F.col("end_tick").alias("end")))).alias("spans"))
    measure = F.floor(F.col("ppq") * 4 * F.col("num") / F.col("den")).alias("measure")
    known = signatures.join(songs.select("song_id", "ppq"), "song_id").groupBy("song_id").agg(F.array_sort(F.collect_set(F.struct("tick", measure))).alias("known"))
    common = F.array(F.struct(F.lit(0).cast("long").alias("tick"), (F.col("ppq") * 4).cast("long").alias("measure")))
    full = F.when(F.col("known").isNull(), common).when(F.col("known")[0]["tick"] > 0, F.concat(common, F.col("known"))).otherwise(F.col("known"))
    rows = songs.select("song_id", "ppq").join(spans, "song_id").join(tempo_maps(changes, songs), "song_id").join(known, "song_id", "left")
    return rows.select("song_id", "ppq", "last", "tempos", full.alias("signatures"), "spans")


def best_cut(song: Column, target: Column, window: float) -> Column:
    """The best time to cut a song near a target second; the target itself where the window holds no boundary.

    song: a struct as of song_arrays. Boundaries are measures and changes of signature (3), silences of more than a quarter between one
    note and the next of the window (half their quarters, at most 2.5) and beats (1). The worth falls with the distance from the target
    to none at `window` seconds; boundaries lie within half of that. Measures count from the last signature at or before the
    window. Equal scores go to the higher kind, then to the earlier place.
    """
    tempos, ppq = song["tempos"], song["ppq"]
    low = tick_at(tempos, F.greatest(F.lit(0.0), target - window / 2))
    high = F.least(tick_at(tempos, target + window / 2), song["last"])

    def place(tick: Column, worth: Column) -> Column:
        time = seconds_at(tempos, tick)
        return let(time, lambda t: F.struct(F.round(worth * (1 - F.abs(t - target) / window), 9).alias("score"), worth.alias("worth"), (-tick).cast("long").alias("back"), t.alias("time")))

    def places(edge: Column) -> Column:
        low, high = edge["low"], edge["high"]
        inside = lambda x: (x >= low) & (x <= high)

        def grid(base: Column, step: Column, first: Column, worth: float) -> Column:
            last = F.floor((high - base) / step)
            numbers = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(numbers, lambda k: place(base + k * step, F.lit(worth)))

        signature = F.coalesce(F.element_at(F.filter(song["signatures"], lambda s: s["tick"] <= low), -1), song["signatures"][0])
        measures = let(signature, lambda s: grid(s["tick"], s["measure"], F.greatest(F.lit(1).cast("long"), F.ceil((low - s["tick"]) / s["measure"])), MEASURE))
        turns = F.transform(F.filter(song["signatures"], lambda s: inside(s["tick"])), lambda s: place(s["tick"], F.lit(MEASURE)))
        beats = grid(F.lit(0).cast("long"), ppq.cast("long"), F.floor(low / ppq) + 1, BEAT)
        near = F.filter(song["spans"], lambda n: inside(n["start"]) | inside(n["end"]))

        def pauses(n: Column) -> Column:
            ends = F.transform(n, lambda x, i: F.struct(x["end"].alias("tick"), (F.get(n, i + 1)["start"] - x["end"]).alias("gap")))
            silent = F.filter(ends, lambda x: (x["gap"] > ppq) & inside(x["tick"]))
            return F.transform(silent, lambda x: place(x["tick"], F.least(F.lit(PAUSE), x["gap"] / ppq * 0.5)))

        return F.concat(measures, turns, beats, let(near, pauses))

    found = let(F.struct(low.alias("low"), high.alias("high")), places)
    return let(found, lambda x: F.when(F.size(x) > 0, F.array_max(x)["time"]).otherwise(target))


def cut_points(notes: DataFrame, songs: DataFrame, changes: DataFrame, signatures: DataFrame, targets: DataFrame, window: float = 4.0) -> DataFrame:
    """song_id, target, cut: the best place to cut each song near each of its target seconds (see best_cut). Songs without notes have none."""
    arrays = song_arrays(notes, songs, changes, signatures)
    song = F.struct(*(c for c in arrays.columns if c != "song_id"))
    rows = targets.select("song_id", "target").join(arrays, "song_id")
    return rows.select("song_id", "target", F.round(let(F.struct(song.alias("song"), "target"), lambda x: best_cut(x["song"], x["target"], window)), 6).alias("cut"))


def chunk_cuts(arrays: DataFrame, size: float, overlap: float = 2.0, least: float = 10.0, musical: bool = True, window: float = 4.0) -> DataFrame:
    """song_id, last, tempos, signatures and cuts: array of (start, cut) in seconds and (low, high) in ticks of every chunk of a song.

    A chunk aims to last `size` seconds; its end moves to the best cut nearby (if musical), but leaves at least `least` seconds. The next
    chunk starts `overlap` before that end, or `least` after its own start where this brings it no further. A song of
    at most `size` seconds is one chunk.
    """
    gain = size - (window / 2 if musical else 0) - overlap
    if min(size, least, gain) <= 0 or overlap < 0:
        raise ValueError("a chunk must be longer than its overlap and half of the search window, and least above 0")
    gain = min(gain, least - overlap if least > overlap else least)

    def folded(x: Column) -> Column:
        song, total = x["song"], x["total"]
        none = F.array().cast("array<struct<start: double, cut: double, low: bigint, high: bigint>>")

        def step(state: Column, _: Column) -> Column:
            start = state["at"]
            target = F.least(start + size, total)
            cut = target
            if musical:
                cut = F.when(target >= total, total).otherwise(let(best_cut(song, target, window), lambda c: F.when(c - start < least, F.least(start + least, total)).otherwise(c)))

            def onward(cut: Column) -> Column:
                after = F.when(cut - overlap <= start, start + least).otherwise(cut - overlap)
                low = F.when(start <= 0, F.lit(0).cast("long")).otherwise(tick_at(song["tempos"], start))
                ends = F.least(tick_at(song["tempos"], cut), song["last"])
                chunk = F.struct(start.alias("start"), cut.alias("cut"), low.cast("long").alias("low"), ends.cast("long").alias("high"))
                return F.struct(after.alias("at"), ((cut >= total) | (after >= total)).alias("done"), F.concat(state["cuts"], F.array(chunk)).alias("cuts"))

            return F.when(state["done"], state).otherwise(let(cut, onward))

        begin = F.struct(F.lit(0.0).alias("at"), F.lit(False).alias("done"), none.alias("cuts"))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(total / gain).cast("int") + 1), begin, step, lambda s: s["cuts"])

    song = F.struct("ppq", "last", "tempos", "signatures", "spans")
    timed = let(song, lambda s: F.struct(s.alias("song"), seconds_at(s["tempos"], s["last"]).alias("total")))
    return arrays.select("song_id", "last", "tempos", "signatures", let(timed, folded).alias("cuts"))


def chunked_notes(notes: DataFrame, cuts: DataFrame, keep_overlapping: bool = True) -> DataFrame:
    """The notes of every chunk: song_id, chunk (from 1), the other columns of notes, ticks from the chunk's start, truncated.

    A note belongs to the chunks it starts in, and with keep_overlapping to those it sounds into; it is clipped to the chunk and lasts a
    tick at least. Chunks without notes are left out and not counted. A note meets its song's cuts by a join on the song.
    """
    holds = lambda n, c: (n[0] <= c["high"]) & ((n[1] if keep_overlapping else n[0]) >= c["low"])
    spread = notes.join(cuts.select("song_id", "cuts"), "song_id")
    indexed = F.transform("cuts", lambda c, i: F.struct(i.alias("part"), c["low"].alias("low"), c["high"].alias("high")))
    rows = spread.withColumn("at", F.explode(F.filter(indexed, lambda c: holds((F.col("start_tick"), F.col("end_tick")), c)))).drop("cuts")
    numbered = rows.select("song_id", "at.part").distinct().withColumn("chunk", F.row_number().over(Window.partitionBy("song_id").orderBy("part")))
    start = F.greatest("start_tick", "at.low") - F.col("at.low")
    end = F.greatest(F.least("end_tick", "at.high") - F.col("at.low"), start + 1)
    truncated = ((F.col("start_tick") < F.col("at.low")) | (F.col("end_tick") > F.col("at.high"))).alias("truncated")
    others = [c for c in notes.columns if c not in ("song_id", "start_tick", "end_tick")]
    cut = rows.select("song_id", F.col("at.part").alias("part"), *others, start.alias("start_tick"), end.alias("end_tick"), truncated)
    return cut.join(numbered, ["song_id", "part"]).drop("part")


def chunk_headers(cuts: DataFrame) -> DataFrame:
    """Tempo and time signature changes inside every chunk, with those in force at its start: song_id, part (from 0), kind, tick, value.

    tick counts from the chunk's start; value is beats a minute, or the measure's length in ticks.
    """
    rows = cuts.select("song_id", "tempos", "signatures", F.posexplode("cuts").alias("part", "c"))

    def kind(name: str, column: str, value: str) -> DataFrame:
        inside = F.filter(column, lambda e: (e["tick"] >= F.col("c.low")) & (e["tick"] <= F.col("c.high")))
        before = F.filter(column, lambda e: e["tick"] < F.col("c.low"))
        begins = F.exists(inside, lambda e: e["tick"] == F.col("c.low"))
        kept = F.concat(F.when(begins, F.slice(before, 1, 0)).otherwise(F.slice(before, F.greatest(F.size(before), F.lit(1)), 1)), inside)
        found = rows.select("song_id", "part", "c", F.explode(kept).alias("e"))
        return found.select("song_id", "part", F.lit(name).alias("kind"), (F.greatest("e.tick", "c.low") - F.col("c.low")).alias("tick"), F.col(f"e.{value}").cast("double").alias("value"))

    return kind("tempo", "tempos", "bpm").unionByName(kind("measure", "signatures", "measure"))
