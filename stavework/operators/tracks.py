"""Classification and choice of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .notes import KEY

#: What names a track type, in order of precedence, and the words that add confidence.
NAME_PATTERNS = {
    "melody": "(melod|lead|solo|voice|vocal|main|theme|principal|voz|voix|stimme)",
    "chord": "(chord|accord|harmon|armon|accomp|comp|rhythm|ritmo|rythme|pad|begleit)",
    "bass": "(bass|basse|basso|bajo|baixo|base|low|grave|tief|bottom)",
    "drums": "(drum|bater|percussion|perc|tambor|tambour|schlagzeug|trommel|kit)",
}
#: English words first, then Spanish, Portuguese, French, Italian and German ones; a word counts as often as it is listed.
NAME_WORDS = {
    "melody": "melody lead solo voice vocal main theme melodía melodia principal voz tema melodia principal voz tema mélodie melodie principal voix thème melodia principale voce tema melodie haupt stimme thema",
    "chord": "chord chords harmony harmon accomp comp rhythm pad acorde acordes armonía armonia acompañamiento ritmo acorde acordes harmonia acompanhamento ritmo accord accords harmonie accompagnement rythme accordo accordi armonia accompagnamento ritmo akkord akkorde harmonie begleitung rhythmus",
    "bass": "bass base low bottom bajo grave base tololoche baixo grave base basse grave basso grave bass tief",
    "drums": "drum drums percussion perc kit batería bateria percusión percusion tambor bateria percussão percussao tambor batterie percussion tambour batteria percussione tamburo schlagzeug perkussion trommel",
}
#: Fixed values of the statistical classes and the keep rule.
MELODY_POLYPHONY, CHORD_POLYPHONY, BASS_PITCH = 2, 3, 48
LEAST_NOTES, MOST_EMPTY, LEAST_PITCHES, DRUM_INDEX = 10, 0.8, 3, 9
PRIORITY = ("melody", "chord", "bass", "drums", "unknown", "filtered")


def _chain(cases: list[tuple[Column, object]], other: object = None) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(other)


def by_name(name: Column) -> Column:
    """Struct of type, confidence and up to three hints from a track's name; type is null if no pattern fits."""
    fits = {t: name.rlike(f"(?i){p}") for t, p in NAME_PATTERNS.items()}
    found = {t: F.filter(F.array(*map(F.lit, words.split())), lambda w: F.contains(F.lower(name), w)) for t, words in NAME_WORDS.items()}
    kind = _chain([(fits[t], t) for t in fits])
    hints = _chain([(fits[t], found[t]) for t in fits], F.array().cast("array<string>"))
    confidence = F.when(kind.isNull(), 0.0).otherwise(F.least(F.lit(1.0), 0.6 + 0.2 * F.size(hints)))
    return F.struct(kind.alias("type"), confidence.alias("confidence"), F.slice(hints, 1, 3).alias("hints"))


def _points(*rules: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for rule, value in rules:
        out = out + F.when(rule, value).otherwise(0.0)
    return F.round(out, 6)


def by_statistics(stats: DataFrame) -> DataFrame:
    """stats with stat_type, stat_subtype and stat_confidence: the class with most points, melody before bass before chord."""
    c = F.col
    span = c("max_pitch") - c("min_pitch")
    melody = _points((c("avg_polyphony") <= MELODY_POLYPHONY, 0.3), (span.between(12, 24), 0.2), (c("avg_pitch") > 60, 0.2), (c("density").between(1.0, 8.0), 0.15), (c("empty_ratio").between(0.2, 0.6), 0.15))
    bass = _points((c("avg_pitch") < BASS_PITCH, 0.4), (c("avg_polyphony") < 1.5, 0.2), (c("note_onset_variance") < 0.5, 0.2), (c("density") < 6.0, 0.2))
    chord = _points((c("avg_polyphony") >= CHORD_POLYPHONY, 0.4), ((c("avg_polyphony") < CHORD_POLYPHONY) & (c("max_polyphony") >= CHORD_POLYPHONY), 0.2), (span > 24, 0.2), (c("avg_duration") > 1.0, 0.2), (c("empty_ratio") < 0.3, 0.2))
    out = stats.withColumns({"_m": melody, "_b": bass, "_c": chord}).withColumn("_top", F.greatest("_m", "_b", "_c"))
    kind = _chain([(c("_top") < 0.3, "unknown"), (c("_m") == c("_top"), "melody"), (c("_b") == c("_top"), "bass")], "chord")
    out = out.withColumn("stat_type", kind)
    sub = _chain([
        ((c("stat_type") == "melody") & (c("avg_polyphony") < 1.1), "monophonic"), ((c("stat_type") == "melody") & (c("avg_pitch") > 72), "lead"), (c("stat_type") == "melody", "main"),
        ((c("stat_type") == "chord") & (c("avg_duration") > 2.0), "pad"), ((c("stat_type") == "chord") & (c("note_onset_variance") < 0.3), "rhythm"), (c("stat_type") == "chord", "harmony"),
        ((c("stat_type") == "bass") & (c("note_onset_variance") < 0.2), "rhythmic"), (c("stat_type") == "bass", "walking"),
    ])
    confidence = F.when(c("stat_type") == "unknown", 0.3).otherwise(F.least(F.lit(0.9), c("_top")))
    return out.withColumns({"stat_subtype": sub, "stat_confidence": confidence}).drop("_m", "_b", "_c", "_top")


def classified(tracks: DataFrame, stats: DataFrame) -> DataFrame:
    """tracks with type, subtype and confidence: drums by flag or index, else a sure name, name and statistics that agree,
    sure statistics, an unsure name, or unknown. A track without notes has no statistics and stays."""
    return typed(tracks.join(stats, KEY, "left"))


def typed(tracks: DataFrame) -> DataFrame:
    """classified() of tracks that have their statistics as columns, null where there are none."""
    c = F.col
    out = by_statistics(tracks).withColumn("_n", by_name(c("name")))
    drums = c("is_drum") | (c("track_idx") == DRUM_INDEX)
    named, sure = c("_n.type").isNotNull(), c("_n.confidence") > 0.7
    agree, stat = c("_n.type") == c("stat_type"), c("stat_confidence") > 0.6
    kind = _chain([(drums, F.lit("drums")), (named & sure, c("_n.type")), (named & agree, c("_n.type")), (stat, c("stat_type")), (named, c("_n.type"))], F.lit("unknown"))
    confidence = _chain([(drums, F.lit(1.0)), (named & sure, c("_n.confidence")), (named & agree, F.least(F.lit(0.95), c("_n.confidence") + c("stat_confidence")) / 2 + 0.2), (stat, c("stat_confidence")), (named, c("_n.confidence") * 0.8)], F.lit(0.3))
    subtype = F.when(~drums & ((named & (sure | agree)) | stat), c("stat_subtype"))
    return out.withColumns({"type": kind, "confidence": confidence, "subtype": subtype}).drop("_n")


def kept(tracks: DataFrame) -> DataFrame:
    """Classified tracks worth keeping: drums, or enough notes and pitches and not too sparse."""
    enough = (F.col("total_notes") >= LEAST_NOTES) & (F.col("empty_ratio") <= MOST_EMPTY) & (F.col("unique_pitches") >= LEAST_PITCHES)
    return tracks.where(F.col("is_drum") | (F.col("type") == "drums") | enough)


def without_duplicates(tracks: DataFrame) -> DataFrame:
    """The first of tracks of a song alike in program, notes, range, rounded mean pitch and length (halves to even)."""
    alike = Window.partitionBy("song_id", "program", "total_notes", "min_pitch", "max_pitch", F.bround("avg_pitch", 0), F.bround("avg_duration", 1)).orderBy("track_idx")
    return tracks.withColumn("_n", F.row_number().over(alike)).where("_n = 1").drop("_n")


def best_of_type(tracks: DataFrame) -> DataFrame:
    """The track of each type with the greatest confidence in each song, the first of equals."""
    order = Window.partitionBy("song_id", "type").orderBy(F.desc("confidence"), "track_idx")
    return tracks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def in_priority_order(tracks: DataFrame) -> DataFrame:
    """tracks with their place in the song by type, then index."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("type"))
    return tracks.withColumn("place", F.row_number().over(Window.partitionBy("song_id").orderBy(rank, "track_idx")))


def type_counts(tracks: DataFrame) -> DataFrame:
    """Tracks of each type by song, one column a type."""
    return tracks.groupBy("song_id").pivot("type", list(PRIORITY)).count().na.fill(0)
