"""Comparison of two note tables, original and reconstructed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["start_tick", "pitch", "track_idx", "end_tick", "velocity"]


def intervals(notes: DataFrame) -> DataFrame:
    """Pitch steps and gaps between starts, in note order by song."""
    order = Window.partitionBy("song_id").orderBy(*ORDER)
    return notes.select("song_id", (F.col("pitch") - F.lag("pitch").over(order)).alias("step"), (F.col("start_tick") - F.lag("start_tick").over(order)).alias("gap")).where("step IS NOT NULL")


def interval_histogram(notes: DataFrame) -> DataFrame:
    order = Window.partitionBy("song_id", "track_idx").orderBy("start_tick", "pitch")
    return notes.select("song_id", "track_idx", F.abs(F.col("pitch") - F.lag("pitch").over(order)).alias("interval")).where("interval IS NOT NULL").groupBy("song_id", "interval").count()


def histograms(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Counts of a value on both sides by song; 0 where a side lacks it."""
    both = a.select("song_id", F.col(value).alias("value"), F.lit(0).alias("side")).unionByName(b.select("song_id", F.col(value).alias("value"), F.lit(1).alias("side")))
    return both.groupBy("song_id", "value").agg(F.count_if(F.col("side") == 0).alias("original"), F.count_if(F.col("side") == 1).alias("reconstructed"))


def cosine(h: DataFrame) -> DataFrame:
    x, y = F.col("original"), F.col("reconstructed")
    return h.groupBy("song_id").agg(F.round(F.sum(x * y) / F.sqrt(F.sum(x * x) * F.sum(y * y).cast("double")), 6).alias("similarity"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """The i-th note of one side with the i-th of the other, by song, cut to the shorter."""
    n = F.row_number().over(Window.partitionBy("song_id").orderBy(*ORDER))
    pick = lambda df, s: df.select("song_id", n.alias("n"), *(F.col(c).alias(f"{c}_{s}") for c in ("start_tick", "end_tick", "pitch", "velocity")))
    return pick(a, "a").join(pick(b, "b"), ["song_id", "n"])


def correlations(pairs: DataFrame) -> DataFrame:
    """Pearson's r of paired pitches, velocities, durations and onsets by song; null where a side doesn't vary."""
    sides = {n: [F.col(f"{c}_{x}") for x in "ab"] for n, c in (("pitch", "pitch"), ("velocity", "velocity"), ("onset", "start_tick"))}
    sides["duration"] = [F.col(f"end_tick_{x}") - F.col(f"start_tick_{x}") for x in "ab"]
    return pairs.groupBy("song_id").agg(*(F.round(F.corr(*sides[n]), 6).alias(n) for n in ("pitch", "velocity", "duration", "onset")))


def pitch_range_kept(a: DataFrame, b: DataFrame, slack: int = 2) -> DataFrame:
    side = lambda df, s: df.groupBy("song_id").agg(F.min("pitch").alias(f"lo_{s}"), F.max("pitch").alias(f"hi_{s}"), F.avg("pitch").alias(f"mean_{s}"))
    j = side(a, "a").join(side(b, "b"), "song_id")
    return j.select("song_id", ((F.abs(F.col("lo_a") - F.col("lo_b")) <= slack) & (F.abs(F.col("hi_a") - F.col("hi_b")) <= slack)).alias("range_kept"), F.round(F.col("mean_b") - F.col("mean_a"), 6).alias("shift"))


def syncopation_kept(a: DataFrame, b: DataFrame, ppq: int = 480) -> DataFrame:
    side = lambda df, s: df.groupBy("song_id").agg(F.avg((F.col("start_tick") % ppq != 0).cast("double")).alias(s))
    return side(a, "x").join(side(b, "y"), "song_id").select("song_id", F.round("x", 6).alias("original"), F.round("y", 6).alias("reconstructed"), (F.abs(F.col("x") - F.col("y")) < 0.2).alias("kept"))


def sampled_polyphony(notes: DataFrame, every: int = 100) -> DataFrame:
    """Mean number of notes at every every-th tick by track: each note counts the sample points inside it."""
    at = lambda c: F.ceil(F.col(c) / every)
    return notes.groupBy("song_id", "track_idx").agg(F.round(F.sum(at("end_tick") - at("start_tick")) / F.ceil(F.max("end_tick") / every), 6).alias("polyphony"))
