"""Chords, bars, cycles and gaps: structure of note tables and token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import compare
from . import tokens as T
from .notes import PPQ

#: Ticks that starts of one chord lie apart at most, programs of the sections, and the position that opens a chord section.
TOGETHER, CHORD_PROGRAM, MELODY_PROGRAM = 10, 29, 98


def program_token(program: int) -> int:
    lo, _, first = T.RANGES["Program"]
    return lo + program - first


def chord_onsets(notes: DataFrame, by: list[str], together: int = TOGETHER) -> DataFrame:
    """Every distinct start with the start of its chord: a chord holds the starts up to `together` ticks after its first.

    Starts are distinct first. A gap of more than `together` always begins a chord, so they are cut there by a window;
    only what lies between two gaps is folded in order, with its own first start carried along.
    """
    starts = notes.select(*by, "start_tick").distinct()
    order = Window.partitionBy(*by).orderBy("start_tick")
    cut = (F.col("start_tick") - F.lag("start_tick").over(order) > together).cast("int")
    runs = starts.withColumn("run", F.sum(F.coalesce(cut, F.lit(0))).over(order)).groupBy(*by, "run").agg(F.sort_array(F.collect_list("start_tick")).alias("starts"))
    first = F.element_at("starts", 1)

    def step(acc: Column, x: Column) -> Column:
        anchor = F.when(x - acc["a"] > together, x).otherwise(acc["a"])
        return F.struct(anchor.alias("a"), F.concat(acc["l"], F.array(anchor)).alias("l"))

    folded = F.aggregate("starts", F.struct(first.alias("a"), F.array().cast("array<bigint>").alias("l")), step, lambda acc: acc["l"])
    anchors = F.when(F.element_at("starts", -1) - first <= together, F.transform("starts", lambda _: first)).otherwise(folded)
    return runs.select(*by, F.explode(F.arrays_zip("starts", anchors.alias("anchors"))).alias("z")).select(*by, F.col("z.starts").alias("start_tick"), F.col("z.anchors").alias("chord_start"))


def chords(notes: DataFrame, by: list[str] | None = None, together: int = TOGETHER) -> DataFrame:
    """Chords in order: chord_start, place from 0, and the set of pitch classes."""
    by = by or ["song_id"]
    groups = notes.join(chord_onsets(notes, by, together), [*by, "start_tick"]).groupBy(*by, "chord_start").agg(F.sort_array(F.collect_set(F.pmod(F.col("pitch"), F.lit(12)))).alias("classes"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("chord_start")) - 1)


def sustained(notes: DataFrame, ppq: int = PPQ) -> DataFrame:
    """Notes of chord tracks with ends moved to the next chord's start; the last chord lasts four beats at least. A track of one chord stays."""
    by = ["song_id", "track_idx"]
    onsets = chord_onsets(notes, by)
    order = Window.partitionBy(*by).orderBy("chord_start")
    following = onsets.select(*by, "chord_start").distinct().withColumn("next_start", F.lead("chord_start").over(order)).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    joined = notes.join(onsets, [*by, "start_tick"]).join(following, [*by, "chord_start"])
    end = F.greatest(F.col("end_tick"), F.coalesce("next_start", F.col("start_tick") + 4 * ppq))
    return joined.withColumn("end_tick", F.when(F.col("n") > 1, end).otherwise(F.col("end_tick"))).select(*notes.columns)


def chord_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """By song: chords on both sides, and the mean Jaccard likeness of the i-th ones times the lesser count over the greater."""
    x, y = chords(a), chords(b)
    pairs = x.select("song_id", "place", F.col("classes").alias("x")).join(y.select("song_id", "place", F.col("classes").alias("y")), ["song_id", "place"], "full")
    alike = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")))
    sums = pairs.groupBy("song_id").agg(F.count("x").alias("original"), F.count("y").alias("reconstructed"), F.coalesce(F.avg(alike), F.lit(0.0)).alias("mean"))
    ratio = F.least("original", "reconstructed") / F.greatest("original", "reconstructed")
    return sums.select("song_id", "original", "reconstructed", F.round(F.col("mean") * ratio, 6).alias("similarity"))


def harmonic_rhythm_kept(a: DataFrame, b: DataFrame, within: float = 0.2) -> DataFrame:
    s = chord_similarity(a, b)
    most = F.greatest("original", "reconstructed")
    return s.select("song_id", "original", "reconstructed", (F.abs(F.col("original") - F.col("reconstructed")) <= within * most).alias("kept"))


def rhythm_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of the histograms of gaps between starts."""
    gaps = lambda n: compare.intervals(n).where("gap > 0")
    return compare.cosine(compare.histograms(gaps(a), gaps(b), "gap"))


def change_comparison(a: DataFrame, b: DataFrame, value: str = "bpm", ticks: int = 1, within: float = 1.0) -> DataFrame:
    """Changes of two songs in order. Songs with other numbers of changes are only counted (same_count false); else the
    numbers that differ in time by more than ticks, or in value by more than within."""
    place = F.row_number().over(Window.partitionBy("song_id").orderBy("tick"))
    x, y = (n.select("song_id", place.alias("i"), F.col("tick").alias(f"t{s}"), F.col(value).alias(f"v{s}")) for n, s in ((a, "x"), (b, "y")))
    both = x.join(y, ["song_id", "i"], "full").groupBy("song_id").agg(
        F.count("vx").alias("original"), F.count("vy").alias("reconstructed"), F.count_if(F.abs(F.col("tx") - F.col("ty")) > ticks).alias("late"), F.count_if(F.abs(F.col("vx") - F.col("vy")) > within).alias("changed"),
        F.avg(F.when(F.col("vx") > 0, F.abs(F.col("vx") - F.col("vy")) / F.col("vx"))).alias("drift"),
    )
    same = F.col("original") == F.col("reconstructed")
    return both.select("song_id", same.alias("same_count"), F.when(same, F.col("late")).alias("late"), F.when(same, F.col("changed")).alias("changed"), F.when(same, F.coalesce("drift", F.lit(0.0))).alias("drift"))


def tempo_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 less the mean relative difference of tempos; 0.5 where the numbers of changes differ."""
    return change_comparison(a, b).select("song_id", F.round(F.when(F.col("same_count"), F.greatest(F.lit(0.0), 1 - F.col("drift"))).otherwise(0.5), 6).alias("stability"))


def silent_gaps(notes: DataFrame, ppq: int = PPQ) -> DataFrame:
    """Silence of more than a beat between notes next to each other in order of their starts, and its priority as a cut. A long
    earlier note may sound through it: only neighbours are compared."""
    order = Window.partitionBy("song_id").orderBy(*compare.ORDER)
    gap = F.lead("start_tick").over(order) - F.col("end_tick")
    return notes.select("song_id", F.col("end_tick").alias("tick"), gap.alias("gap")).where(F.col("gap") > ppq).withColumn("priority", F.round(F.least(F.lit(2.5), F.col("gap") * 0.5 / ppq), 6))


def restored(tokens: DataFrame) -> DataFrame:
    """Tokens with programs before pitches and without section markers; a chord section's first pitch gets position 0. Places are numbered anew."""
    marker = F.when(F.col("token_id") == T.CHORD_START, "C").when(F.col("token_id") == T.MELODY_START, "M")
    lo, hi, _ = T.RANGES["Pitch"]
    t = tokens.select("song_id", "pos", "token_id", F.last(marker, ignorenulls=True).over(T.so_far()).alias("section"), F.sum((F.col("token_id") == T.CHORD_START).cast("int")).over(T.so_far()).alias("part"))
    pitch = F.col("token_id").between(lo, hi)
    nth = F.row_number().over(Window.partitionBy("song_id", "part", "section", pitch).orderBy("pos"))
    chord, melody = pitch & (F.col("section") == "C"), pitch & (F.col("section") == "M")
    t = t.withColumn("_new", F.array_compact(F.array(F.when(chord & (nth == 1), T.RANGES["Position"][0]), F.when(chord, program_token(CHORD_PROGRAM)).when(melody, program_token(MELODY_PROGRAM)), F.when(marker.isNull(), F.col("token_id")))))
    out = t.select("song_id", "pos", F.posexplode("_new").alias("k", "token_id"))
    return out.select("song_id", F.row_number().over(Window.partitionBy("song_id").orderBy("pos", "k")).cast("long").alias("pos"), "token_id")


def reordered(tokens: DataFrame) -> DataFrame:
    """Each bar as Bar, other tokens, chord marker and chord notes, melody marker and melody notes, by the program in force in the bar. Programs
    go; a position, with those right before it, stays before the first melody pitch that follows it. Places are numbered anew."""
    b = T.bars(tokens).withColumn("class", T.token_class(F.col("token_id")))
    in_bar = Window.partitionBy("song_id", "bar").orderBy("pos")
    upto, before = in_bar.rowsBetween(Window.unboundedPreceding, 0), in_bar.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("program", F.last(F.when(F.col("class") == "Program", F.col("token_id")), ignorenulls=True).over(upto))
    is_chord = F.coalesce(F.col("program") == program_token(CHORD_PROGRAM), F.lit(False))
    note = F.col("class").isin("Pitch", "Velocity", "Duration")
    sung = F.when((F.col("class") == "Pitch") & ~is_chord, F.col("pos"))
    position = F.col("class") == "Position"
    # equal notes have their positions next to each other: between those, the number of other tokens stays
    b = b.withColumn("_run", F.sum((~position).cast("long")).over(upto))
    near = F.collect_list("token_id").over(Window.partitionBy("song_id", "bar", "_run", position).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("_near", F.when(position, near))
    here = F.when(position, F.struct("pos", F.col("_near").alias("token_ids")))
    b = b.withColumn("_sung", F.max(sung).over(before)).withColumn("_at", F.last(here, ignorenulls=True).over(upto))
    opens = (F.col("class") == "Pitch") & ~is_chord & (F.col("_at.pos") > F.coalesce("_sung", F.lit(-1)))
    rank = F.when(F.col("class") == "Bar", 0).when(note & is_chord, 3).when(note, 5).otherwise(1)
    kept = b.where(~F.col("class").isin("Program", "Position"))
    rows = kept.select("song_id", "bar", rank.alias("rank"), "pos", F.posexplode(F.concat(F.when(opens, F.col("_at.token_ids")).otherwise(F.array().cast("array<int>")), F.array("token_id"))).alias("k", "token_id"))
    marks = b.select("song_id", "bar").distinct().select("song_id", "bar", F.explode(F.array(F.struct(F.lit(2).alias("rank"), F.lit(T.CHORD_START).alias("token_id")), F.struct(F.lit(4).alias("rank"), F.lit(T.MELODY_START).alias("token_id")))).alias("m"))
    rows = rows.unionByName(marks.select("song_id", "bar", "m.rank", F.lit(0).cast("long").alias("pos"), F.lit(0).alias("k"), "m.token_id"))
    return rows.select("song_id", F.row_number().over(Window.partitionBy("song_id").orderBy("bar", "rank", "pos", "k")).cast("long").alias("pos"), "token_id")


def cycles(tokens: DataFrame, longest: int = 8, times: int = 3) -> DataFrame:
    """Stretches in which a pattern of 1 to longest tokens is repeated times or more: length of the cycle, first place, tokens. Special tokens
    and bars may repeat on their own."""
    t = tokens.select("song_id", "token_id", F.row_number().over(T.song()).alias("i"), *(F.lag("token_id", c).over(T.song()).alias(f"old{c}") for c in range(1, longest + 1)))
    lagged = F.explode(F.array(*(F.struct(F.lit(c).alias("cycle"), F.col(f"old{c}").alias("old")) for c in range(1, longest + 1)))).alias("z")
    t = t.select("song_id", "token_id", "i", lagged).select("song_id", "token_id", "i", "z.*")
    same = t.where((F.col("token_id") == F.col("old")) & ((F.col("cycle") > 1) | ~F.col("token_id").isin(T.BOS, T.EOS, T.PAD, T.BAR)))
    island = F.col("i") - F.row_number().over(Window.partitionBy("song_id", "cycle").orderBy("i"))
    runs = same.withColumn("island", island).groupBy("song_id", "cycle", "island").agg(F.min("i").alias("at"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= (times - 1) * F.col("cycle")).select("song_id", "cycle", (F.col("at") - F.col("cycle")).alias("first"), (F.col("n") + F.col("cycle")).alias("tokens"))


def repeated_chords(tokens: DataFrame, least: int = 4) -> DataFrame:
    """Runs of least or more chord sections with one and the same set of pitches, which is not empty."""
    t = T.track_ids(tokens).withColumn("part", F.sum((F.col("token_id") == T.CHORD_START).cast("int")).over(T.so_far()))
    lo, hi, _ = T.RANGES["Pitch"]
    pitch = F.when(F.col("token_id").between(lo, hi), F.col("token_id"))
    sets = t.where("section = 'C'").groupBy("song_id", "part").agg(F.array_join(F.sort_array(F.collect_set(pitch)), ",").alias("chord"))
    island = F.row_number().over(Window.partitionBy("song_id").orderBy("part")) - F.row_number().over(Window.partitionBy("song_id", "chord").orderBy("part"))
    runs = sets.withColumn("island", island).where("chord <> ''").groupBy("song_id", "chord", "island").agg(F.min("part").alias("first_bar"), F.count("*").alias("bars"))
    return runs.where(F.col("bars") >= least).drop("island")


def two_track_structure(stats: DataFrame, solo: float = 1.3, full: float = 2.0) -> DataFrame:
    """Verdict by song on typed track statistics (type, avg_polyphony): two tracks, one a melody with nearly one note at once, one chords."""
    of = lambda kind: F.min_by(F.when(F.col("type") == kind, F.col("avg_polyphony")), F.when(F.col("type") == kind, F.col("track_idx")))
    s = stats.groupBy("song_id").agg(F.count("*").alias("tracks"), of("melody").alias("melody"), of("chord").alias("chord"))
    problem = (
        F.when(F.col("tracks") != 2, "tracks").when(F.col("melody").isNull(), "no melody").when(F.col("chord").isNull(), "no chord").when(F.col("melody") > solo, "melody not monophonic").when(F.col("chord") < full, "chord too thin")
    )
    return s.select("song_id", "tracks", problem.alias("problem"), problem.isNull().alias("valid"))


def chord_track(tracks: DataFrame, polyphony: DataFrame) -> DataFrame:
    """The first track by song that has the chord program, or a chord name and three notes at once."""
    named = F.lower(F.coalesce("name", F.lit(""))).rlike("chord|harmony|accomp|pad")
    fits = tracks.join(polyphony, ["song_id", "track_idx"], "left").where((F.col("program") == CHORD_PROGRAM) | (named & (F.col("max_polyphony") >= 3)))
    return fits.groupBy("song_id").agg(F.min("track_idx").alias("track_idx"))


def vocabulary_differences(entries: DataFrame, reference: str) -> DataFrame:
    """Vocabularies of documents (doc, name, id) against that of one document: missing, extra and renumbered tokens; no row where they agree.

    Each entry meets the reference's entry of its name, in one join by name; what a document misses is the number of names that its
    entries didn't meet, so documents and reference are never crossed.
    """
    ref = entries.where(F.col("doc") == reference).select("name", F.col("id").alias("ref_id"))
    met = entries.where(F.col("doc") != reference).join(ref, "name", "left")
    out = met.groupBy("doc").agg(F.count("ref_id").alias("met"), F.count_if(F.col("ref_id").isNull()).alias("extra"), F.count_if(F.col("id") != F.col("ref_id")).alias("renumbered"))
    out = out.join(F.broadcast(ref.agg(F.count("*").alias("names")))).select("doc", (F.col("names") - F.col("met")).alias("missing"), "extra", "renumbered")
    return out.where("missing + extra + renumbered > 0")


def events_of_chunks(events: DataFrame, length: int, step: int) -> DataFrame:
    """Events copied into every chunk that holds them (chunk k: ticks k * step to k * step + length, both included), ticks counted
    from the chunk's start. Each event finds its chunks by arithmetic, so nothing is joined. Events need a column tick."""
    first = F.greatest(F.lit(0), F.ceil((F.col("tick") - length) / step))
    last = F.floor(F.col("tick") / step)
    return events.withColumn("chunk", F.explode(F.when(first <= last, F.sequence(first, last)))).withColumn("tick", F.col("tick") - F.col("chunk") * step)
