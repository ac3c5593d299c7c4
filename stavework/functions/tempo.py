"""Tempo maps: a song's tempo changes as one array column, and time and tick from each other by it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The tempo before a song's first change.
DEFAULT_BPM = 120


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tempo_maps(changes: DataFrame, songs: DataFrame) -> DataFrame:
    """song_id, tempos: array of (tick, sec, rate, bpm) by tick, where rate is in ticks a second and sec the time at tick.

    changes: song_id, tick, bpm; of several at one tick the fastest counts. songs: song_id, ppq. Seconds are prefix sums over a
    song's stretches of one tempo. A song without a change at tick 0 begins at DEFAULT_BPM; one without changes has this only.
    """
    known = changes.groupBy("song_id", "tick").agg(F.max("bpm").cast("double").alias("bpm"))
    begun = known.where("tick = 0").select("song_id")
    default = songs.select("song_id").join(begun, "song_id", "left_anti").select("song_id", F.lit(0).cast("long").alias("tick"), F.lit(float(DEFAULT_BPM)).alias("bpm"))
    rows = known.where("tick >= 0").unionByName(default).join(songs.select("song_id", "ppq"), "song_id").withColumn("rate", F.col("ppq") * F.col("bpm") / 60.0)
    order = Window.partitionBy("song_id").orderBy("tick")
    rows = rows.withColumn("lasts", (F.lead("tick").over(order) - F.col("tick")) / F.col("rate"))
    rows = rows.withColumn("sec", F.coalesce(F.sum("lasts").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("tick", "sec", "rate", "bpm"))).alias("tempos"))


def seconds_at(tempos: Column, tick: Column) -> Column:
    """The time at a tick."""
    stretch = F.element_at(F.filter(tempos, lambda m: m["tick"] <= tick), -1)
    return let(stretch, lambda m: m["sec"] + (tick - m["tick"]) / m["rate"])


def tick_at(tempos: Column, seconds: Column) -> Column:
    """The first tick that is not before a time. Differences under a millionth of a tick count as none."""
    stretch = F.element_at(F.filter(tempos, lambda m: m["sec"] <= seconds), -1)
    return let(stretch, lambda m: m["tick"] + F.ceil(F.round((seconds - m["sec"]) * m["rate"], 6)))
