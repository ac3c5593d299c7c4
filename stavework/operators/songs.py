"""Facts about songs: metadata, key, tempo."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of keys by pitch class, from C upwards.
MAJOR = "C Db D Eb E F F# G Ab A Bb B".split()
MINOR = "Cm C#m Dm Ebm Em Fm F#m Gm G#m Am Bbm Bm".split()


def metadata(songs: DataFrame, tracks: DataFrame, notes: DataFrame) -> DataFrame:
    """Counts, duration and sorted melodic programs of each song."""
    t = tracks.groupBy("song_id").agg(F.count("*").alias("track_count"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("is_drum"), F.col("program")))), ",").alias("programs"))
    n = notes.groupBy("song_id").agg(F.count("*").alias("note_count"), F.max("end_tick").alias("duration_ticks"))
    return songs.select("song_id", "ppq", "key_signature").join(t, "song_id", "left").join(n, "song_id", "left").na.fill(0, ["track_count", "note_count", "duration_ticks"])


def detected_keys(songs: DataFrame, notes: DataFrame, tracks: DataFrame) -> DataFrame:
    """song_id, key and confidence: the declared key, else the pitch class that sounds longest (the lowest of equals), minor
    if the minor third outweighs the major one by a fifth; C for songs without notes. Notes are summed by pitch class first."""
    melodic = notes.join(tracks.where("NOT is_drum").select("song_id", "track_idx"), ["song_id", "track_idx"], "left_semi")
    classes = melodic.groupBy("song_id", (F.col("pitch") % 12).alias("pc")).agg(F.sum(F.col("end_tick") - F.col("start_tick")).alias("ticks"))
    wide = classes.groupBy("song_id").agg(F.array(*(F.coalesce(F.sum(F.when(F.col("pc") == i, F.col("ticks"))), F.lit(0)) for i in range(12))).alias("h"))
    root = F.array_position("h", F.array_max("h")).cast("int") - 1
    wide = wide.withColumn("root", root)
    at = lambda d: F.element_at("h", F.pmod(F.col("root") + d, F.lit(12)) + 1)
    minor = at(3) > at(4) * 1.2
    names = lambda x: F.element_at(F.array(*map(F.lit, x)), F.col("root") + 1)
    found = wide.where(F.array_max("h") > 0).select("song_id", F.when(minor, names(MINOR)).otherwise(names(MAJOR)).alias("found"), F.when(minor, 0.6).otherwise(0.7).alias("sure"))
    declared = F.col("key_signature").isNotNull()
    return songs.join(found, "song_id", "left").select("song_id", F.when(declared, F.col("key_signature")).otherwise(F.coalesce("found", F.lit("C"))).alias("key"), F.when(declared, 0.9).otherwise(F.coalesce("sure", F.lit(0.2))).alias("confidence"))


def average_tempo(songs: DataFrame, tempo: DataFrame, notes: DataFrame) -> DataFrame:
    """Mean tempo of each song weighted by ticks to the next change or the end, rounded to one place; 120 without changes."""
    ends = notes.groupBy("song_id").agg(F.max("end_tick").alias("last"))
    order = Window.partitionBy("song_id").orderBy("tick")
    spans = tempo.join(ends, "song_id", "left").withColumn("ticks", F.greatest(F.coalesce(F.lead("tick").over(order), F.col("last")) - F.col("tick"), F.lit(0)))
    mean = spans.groupBy("song_id").agg(F.when(F.count("*") == 1, F.first("bpm").cast("double")).otherwise(F.sum(F.col("bpm") * F.col("ticks")) / F.sum("ticks")).alias("mean"))
    return songs.select("song_id").join(mean, "song_id", "left").select("song_id", F.round(F.coalesce("mean", F.lit(120.0)), 1).alias("avg_tempo"))


def tempo_at_notes(notes: DataFrame, tempo: DataFrame) -> DataFrame:
    """notes with the tempo in force at their start (120 before the first change): changes and notes are put in one order and
    the last tempo is carried forward, by song."""
    at = notes.select("song_id", F.col("start_tick").alias("tick"), F.lit(None).cast("int").alias("bpm"), F.struct("track_idx", "end_tick", "pitch", "velocity").alias("note"))
    changes = tempo.select("song_id", "tick", "bpm", F.lit(None).cast("struct<track_idx:int,end_tick:bigint,pitch:int,velocity:int>").alias("note"))
    order = Window.partitionBy("song_id").orderBy("tick", F.col("note").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    out = at.unionByName(changes).withColumn("tempo", F.coalesce(F.last("bpm", ignorenulls=True).over(order), F.lit(120)))
    return out.where("note IS NOT NULL").select("song_id", F.col("tick").alias("start_tick"), "note.*", "tempo")


def verdicts(songs: DataFrame, notes: DataFrame, most_bad: float = 0.1) -> DataFrame:
    """song_id, is_valid and errors: no notes, no duration, bad resolution, more than most_bad of the notes out of range."""
    bad = ~F.col("pitch").between(0, 127) | ~F.col("velocity").between(0, 127) | (F.col("end_tick") <= F.col("start_tick"))
    facts = notes.groupBy("song_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.max("end_tick").alias("last"))
    f = songs.join(facts, "song_id", "left").na.fill(0, ["n", "bad", "last"])
    errors = F.array_compact(F.array(
        F.when(F.col("n") == 0, "no notes"), F.when(F.col("last") == 0, "zero duration"), F.when(F.col("ppq") <= 0, "bad ppq"), F.when(F.col("bad") > F.col("n") * most_bad, "invalid notes"),
    ))
    return f.select("song_id", (F.size(errors) == 0).alias("is_valid"), F.array_join(errors, ",").alias("errors"))
