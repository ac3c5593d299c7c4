"""Cleaning of note tables (song_id, track_idx, start_tick, end_tick, pitch, velocity) and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parts import met

KEY = ["song_id", "track_idx"]
#: Ticks of a quarter note, and of the shortest note kept (1/64).
PPQ = 480
SHORTEST = PPQ // 16
#: What names a bass track, and the pitch under which a note counts as bass.
BASS_TERMS, BASS_BELOW, BASS_SHARE = "bass|bajo|basso|contrabajo|tololoche|upright", 36, 0.35


def valid_notes(notes: DataFrame) -> DataFrame:
    """Notes with pitch and velocity in 0..127 and an end after the start."""
    return notes.where(F.col("pitch").between(0, 127) & F.col("velocity").between(0, 127) & (F.col("end_tick") > F.col("start_tick")))


def drop_fragments(notes: DataFrame, drums: Column, shortest: int = SHORTEST) -> DataFrame:
    """Without notes shorter than shortest or before tick 0; drum notes stay."""
    return notes.where(drums | ((F.col("end_tick") - F.col("start_tick") >= shortest) & (F.col("start_tick") >= 0)))


def non_empty_tracks(tracks: DataFrame, notes: DataFrame) -> DataFrame:
    return tracks.join(notes.select(*KEY).distinct(), KEY, "left_semi")


def without_bass(tracks: DataFrame, notes: DataFrame, below: int = BASS_BELOW, share: float = BASS_SHARE, keep_drums: bool = False) -> DataFrame:
    """Tracks that are not bass: by name, or with more than share of their notes under a pitch. Tracks without notes stay.
    Drum tracks go as well unless keep_drums."""
    low = notes.groupBy(*KEY).agg(F.avg(F.when(F.col("pitch") < below, 1.0).otherwise(0.0)).alias("low"))
    out = tracks.join(low, KEY, "left").where(~F.lower("name").rlike(BASS_TERMS) & (F.coalesce("low", F.lit(0.0)) <= share))
    return (out if keep_drums else out.where(~F.col("is_drum"))).drop("low")


def trim_overlaps(notes: DataFrame, drums: Column, shortest: int = SHORTEST) -> DataFrame:
    """A note that overlaps the next one of its pitch and track ends at that one's start, but lasts shortest at least. Every
    comparison uses the starts as they were."""
    order = Window.partitionBy(*KEY, "pitch").orderBy("start_tick", "end_tick", "velocity")
    after = F.lead("start_tick").over(order)
    cut = F.greatest(F.least("end_tick", after), F.col("start_tick") + shortest)
    return notes.withColumn("end_tick", F.when(~drums & (after < F.col("end_tick")), cut).otherwise(F.col("end_tick")))


def quantized(notes: DataFrame, drums: Column, grid: int = 16, shortest: int = SHORTEST) -> DataFrame:
    """Starts and ends on the grid (halves to even), lengths of shortest at least; drums stay as they are."""
    step = PPQ * 4 / grid
    to = lambda c: (F.rint(F.col(c) / step) * step).cast("long")
    start = F.when(drums, F.col("start_tick")).otherwise(to("start_tick"))
    end = F.when(drums, F.col("end_tick")).otherwise(F.greatest(to("end_tick"), to("start_tick") + shortest))
    return notes.withColumns({"start_tick": start, "end_tick": end})


def preprocessing_stats(notes: DataFrame, drums: Column) -> DataFrame:
    """Per song: melodic notes, drum and melodic tracks, duration, notes per beat, pitch span, nearly too short notes."""
    tracks = lambda flag: F.count_distinct(F.when(flag, F.col("track_idx")))
    melodic = F.when(~drums, F.col("pitch"))
    return notes.groupBy("song_id").agg(
        F.count(melodic).alias("note_count"), tracks(drums).alias("drum_tracks"), tracks(~drums).alias("melodic_tracks"), F.max("end_tick").alias("duration_ticks"),
        (F.count(melodic) / (F.max("end_tick") / PPQ)).alias("notes_per_beat"), F.min(melodic).alias("min_pitch"), F.max(melodic).alias("max_pitch"),
        (F.max(melodic) - F.min(melodic)).alias("pitch_span"), F.count_if(~drums & (F.col("end_tick") - F.col("start_tick") < 1.1 * SHORTEST)).alias("short_notes"),
    )


def stats_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per song, notes and tracks that a cleaning run removed."""
    a = after.select("song_id", F.col("note_count").alias("notes_after"), F.col("melodic_tracks").alias("tracks_after"))
    return before.join(a, "song_id", "left").select(
        "song_id", (F.col("note_count") - F.coalesce("notes_after", F.lit(0))).alias("notes_removed"), (F.col("melodic_tracks") - F.coalesce("tracks_after", F.lit(0))).alias("tracks_removed"),
    )


def preprocessed(notes: DataFrame, tracks: DataFrame, grid: int | None = 16, bass: bool = True) -> DataFrame:
    """The whole cleaning run: fragments, overlaps, grid, bass; notes of tracks that stay."""
    drum = F.col("is_drum")
    flagged = valid_notes(notes).join(tracks.select(*KEY, "is_drum"), KEY)
    out = trim_overlaps(drop_fragments(flagged, drum), drum)
    out = quantized(out, drum, grid) if grid else out
    return out.join(without_bass(tracks, out).select(*KEY), KEY, "left_semi") if bass else out


def polyphony(notes: DataFrame) -> DataFrame:
    """Ticks that each number of notes sounds at once, by track; silence is left out. A sweep over starts and ends: those of one tick count together, and only the last has ticks after it."""
    edges = notes.select(*KEY, F.explode(F.array(F.struct(F.col("start_tick").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_tick").alias("t"), F.lit(-1).alias("d")))).alias("e")).select(*KEY, "e.*")
    order = Window.partitionBy(*KEY).orderBy("t")
    levels = edges.select(*KEY, F.sum("d").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("level"), (F.lead("t").over(order) - F.col("t")).alias("ticks"))
    return levels.where("level > 0 AND ticks > 0").groupBy(*KEY, "level").agg(F.sum("ticks").alias("ticks"))


def covered_time(notes: DataFrame) -> DataFrame:
    """Ticks in which at least one note of a track sounds: islands of notes that overlap or touch."""
    order = Window.partitionBy(*KEY).orderBy("start_tick", "end_tick")
    reach = F.max("end_tick").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = notes.select(*KEY, "start_tick", "end_tick", F.when(F.col("start_tick") <= reach, 0).otherwise(1).alias("new"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*KEY, "island").agg((F.max("end_tick") - F.min("start_tick")).alias("ticks"))
    return spans.groupBy(*KEY).agg(F.sum("ticks").alias("covered"))


def max_polyphony(notes: DataFrame) -> DataFrame:
    """The most notes at once by track, ends before starts at the same tick."""
    edges = notes.select(*KEY, F.explode(F.array(F.struct(F.col("start_tick").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_tick").alias("t"), F.lit(-1).alias("d")))).alias("e"))
    order = Window.partitionBy(*KEY).orderBy("e.t", "e.d").rowsBetween(Window.unboundedPreceding, 0)
    return edges.select(*KEY, F.sum("e.d").over(order).alias("level")).groupBy(*KEY).agg(F.max("level").alias("max_polyphony"))


def track_statistics(notes: DataFrame, ppq: int = PPQ) -> DataFrame:
    """Thirteen values by track: three aggregates (values, levels of polyphony, covered time), each of which reads the notes."""
    notes = notes.repartition(*KEY)
    order = Window.partitionBy(*KEY).orderBy("start_tick")
    length = (F.max("end_tick") - F.min("start_tick")) / ppq
    timed = notes.withColumn("gap", F.col("start_tick") - F.lag("start_tick").over(order)).withColumn("length", F.col("end_tick") - F.col("start_tick"))
    base = timed.groupBy(*KEY).agg(
        F.count("*").alias("total_notes"), F.count_distinct("pitch").alias("unique_pitches"), F.min("pitch").alias("min_pitch"), F.max("pitch").alias("max_pitch"),
        F.avg("pitch").alias("avg_pitch"), F.avg("velocity").alias("avg_velocity"), (F.avg("length") / ppq).alias("avg_duration"), (F.sum("length") / ppq).alias("total_duration"),
        F.when(length > 0, F.count("*") / length).otherwise(0.0).alias("density"), length.alias("track_length"), (F.coalesce(F.stddev_pop("gap"), F.lit(0.0)) / ppq).alias("note_onset_variance"),
    )
    levels = polyphony(notes).groupBy(*KEY).agg(
        F.max("level").alias("max_polyphony"), (F.sum(F.col("level") * F.col("ticks")) / F.sum("ticks")).alias("avg_polyphony"),
        (F.sum(F.when(F.col("level") > 1, F.col("ticks")).otherwise(0)) / F.sum("ticks")).alias("polyphony_ratio"),
    )
    out = met([base, levels, covered_time(notes)], KEY)
    empty = F.when(F.col("track_length") > 0, 1 - F.col("covered") / ppq / F.col("track_length")).otherwise(0.0)
    return out.withColumn("empty_ratio", empty).drop("track_length", "covered")
