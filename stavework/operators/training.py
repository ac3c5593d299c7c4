"""Training tables from token tables (song_id, pos, token_id): augmentation, samples, batches, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from . import tokens as T

#: Offsets of the modes of augmentation; a whole one gives eleven copies.
OFFSETS = {"all": tuple(x for x in range(-6, 6) if x), "higher": (1, 2, 3, 4, 5), "lower": (-6, -5, -4, -3, -2, -1)}
#: Weights of short durations by section; only the SHORT_DURATIONS shortest count.
SHORT_DURATIONS, MELODY_WEIGHT, CHORD_WEIGHT = 3, 10.0, 5.0


def originals(files: DataFrame, name: str = "name") -> DataFrame:
    """Files that no augmentation has made."""
    return files.where(~F.contains(F.col(name), F.lit("-transpose")))


def augmented(tokens: DataFrame, files: DataFrame, offsets: tuple[int, ...] = OFFSETS["all"], low: int = 36, high: int = 84) -> DataFrame:
    """Every song at every offset but 0: one row a copy with its key, name, number of tokens, hash of its ids, moved and kept pitches.

    A song's ids are gathered once, as one array of 4 bytes a token, and copied in the task that holds them: copies are never shuffled.
    """
    steps = F.explode(F.array(*(F.lit(o) for o in offsets if o))).alias("offset")
    lo, hi, first = T.RANGES["Pitch"]
    is_pitch = lambda x: x.between(lo, hi)
    fits = lambda x: is_pitch(x) & (x + F.col("offset") - lo + first).between(low, high) & (x + F.col("offset")).between(lo, hi)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"])
    moved = tokens.groupBy("song_id").agg(ids.alias("ids")).select("song_id", "ids", steps)
    new = F.transform("ids", lambda x: F.when(fits(x), x + F.col("offset")).otherwise(x).cast("string"))
    count = lambda rule: F.size(F.filter("ids", rule)).cast("long")
    copies = moved.select("song_id", "offset", F.size("ids").cast("long").alias("n_tokens"), count(fits).alias("moved"), count(lambda x: is_pitch(x) & ~fits(x)).alias("kept"), F.md5(F.concat_ws("", new)).alias("hash"))
    names = originals(files).select("song_id", "key", "name")
    new_key = keys.transposed_key(F.col("key"), F.col("offset"))
    base = keys.renamed_key(F.regexp_replace("name", r"\.json$", ""), F.col("key"), F.col("new_key"))
    sign = F.when(F.col("offset") > 0, "+").otherwise("")
    out = copies.join(names, "song_id").withColumn("new_key", new_key)
    return out.select("song_id", "offset", "n_tokens", "moved", "kept", "hash", "key", "new_key", F.concat(base, F.lit("-transpose"), sign, F.col("offset").cast("string"), F.lit(".json")).alias("name"), (F.col("kept") == 0).alias("success"))


def samples(tokens: DataFrame, most: int = 2048, pad: bool = False) -> DataFrame:
    """One row per token of a sample: the song between BOS and EOS, cut at most; section, label (the next token, -100 at the end) and mask.

    The first token's section goes to BOS and the last one's to EOS. With pad each sample is filled up to most.
    """
    t = T.track_ids(tokens).select("song_id", F.row_number().over(T.song()).alias("place"), "token_id", "section")
    facts = t.groupBy("song_id").agg(F.max("place").alias("n"), F.min_by("section", "place").alias("first"), F.max_by("section", "place").alias("last"))
    ends = facts.select("song_id", F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit(T.BOS).alias("token_id"), F.col("first").alias("section")), F.struct((F.col("n") + 1).alias("place"), F.lit(T.EOS).alias("token_id"), F.col("last").alias("section")))).alias("e")).select("song_id", "e.*")
    whole = t.unionByName(ends).where(F.col("place") < most).withColumn("mask", F.lit(1))
    if pad:
        fill = facts.where(F.col("n") + 2 < most).select("song_id", F.explode(F.sequence(F.col("n") + 2, F.lit(most - 1))).alias("place"))
        whole = whole.unionByName(fill.select("song_id", "place", F.lit(T.PAD).alias("token_id"), F.lit("M").alias("section"), F.lit(0).alias("mask")))
    after = F.lead(F.struct("token_id", "mask")).over(Window.partitionBy("song_id").orderBy("place"))
    label = F.when((F.col("mask") == 0) | after.isNull(), F.lit(-100)).otherwise(after["token_id"])
    return whole.select("song_id", "place", "token_id", "section", "mask", label.alias("label"))


def batches(tokens: DataFrame, size: int = 8, shards: int = 16, drop_last: bool = True) -> DataFrame:
    """song_id, shard, batch, length and padded length of every sample. Songs are dealt over shards by a hash and put in order by it,
    so no order over all songs is needed; each shard's last batch goes if it is not full and drop_last is set."""
    lengths = tokens.groupBy("song_id").agg((F.count("*") + 2).alias("length")).withColumn("shard", F.pmod(F.col("song_id"), F.lit(shards)).cast("int"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("song_id")) - 1
    dealt = lengths.withColumn("batch", F.floor(place / size).cast("long"))
    in_batch = Window.partitionBy("shard", "batch")
    out = dealt.withColumn("padded", F.max("length").over(in_batch)).withColumn("_n", F.count("*").over(in_batch))
    return (out.where(F.col("_n") == size) if drop_last else out).drop("_n")


def label_weights(sampled: DataFrame) -> DataFrame:
    """samples() with the weight of each label: short durations weigh more, and more in melody than in chords."""
    lo = T.RANGES["Duration"][0]
    short = F.col("label").between(lo, lo + SHORT_DURATIONS - 1)
    return sampled.withColumn("weight", F.when(short & (F.col("section") == "M"), MELODY_WEIGHT).when(short & (F.col("section") == "C"), CHORD_WEIGHT).otherwise(1.0))


def conditions(songs: DataFrame) -> DataFrame:
    return songs.select("song_id", keys.key_condition(F.col("key_signature")).alias("key_id"), keys.time_condition(F.col("ts_num"), F.col("ts_den")).alias("time_id"))


def conditioning_tempo(changes: DataFrame, seconds: str = "duration_seconds") -> DataFrame:
    """Tempo by song, weighted by the seconds that each tempo lasts; 0 where no seconds are given."""
    w = F.coalesce(F.col(seconds).cast("double"), F.lit(0.0))
    return changes.groupBy("song_id").agg(F.round(F.when(F.sum(w) > 0, F.sum(F.col("bpm") * w) / F.sum(w)).otherwise(0.0), 6).alias("tempo"))


def generated_structure(tokens: DataFrame, least_bars: int = 4) -> DataFrame:
    """Verdict on a generated sequence: begins with BOS, no EOS more than 3 before its end, least_bars bars at least."""
    t = tokens.groupBy("song_id").agg(F.min_by("token_id", "pos").alias("first"), F.max("pos").alias("last"), F.min(F.when(F.col("token_id") == T.EOS, F.col("pos"))).alias("eos"), F.count_if(F.col("token_id") == T.BAR).alias("bars"))
    early = F.coalesce(F.col("eos") < F.col("last") - 3, F.lit(False))
    return t.select("song_id", (F.col("first") == T.BOS).alias("has_bos"), early.alias("early_eos"), "bars", ((F.col("first") == T.BOS) & ~early & (F.col("bars") >= least_bars)).alias("valid"))


def token_metadata(tokens: DataFrame) -> DataFrame:
    """The last tempo bin, time signature bin and program of each song, and whether it has a chord section; null where there is none."""
    def last(kind: str) -> Column:
        lo, hi, first = T.RANGES[kind]
        here = F.col("token_id").between(lo, hi)
        return F.max_by(F.when(here, F.col("token_id") - lo + first), F.when(here, F.col("pos")))

    return tokens.groupBy("song_id").agg(last("Tempo").alias("tempo"), last("TimeSig").alias("time_signature"), last("Program").alias("program"), F.max((F.col("token_id") == T.CHORD_START).cast("int")).cast("boolean").alias("has_chord_start"))


def keyword_category(name: Column) -> Column:
    """Category of a token name by the first keyword that it contains."""
    has = lambda *words: F.lower(name).rlike("|".join(words))
    return (
        F.when(has("note", "pitch"), "note").when(has("vel"), "velocity").when(has("dur"), "duration").when(has("pos"), "position").when(has("bar"), "bar").when(has("chord"), "chord")
        .when(has("rest"), "rest").when(has("tempo"), "tempo").when(has("time") & has("signature"), "time_signature").when(has("program"), "program").otherwise("special")
    )


def extended_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """A vocabulary (name, id) with both section markers after its last id, those that it has kept. One aggregate row is broadcast."""
    end = vocabulary.agg(F.max("id").alias("top"), F.collect_set(F.when(F.col("name").isin("ChordStart_None", "MelodyStart_None"), F.col("name"))).alias("have"))
    new = end.select(F.posexplode(F.array_except(F.array(F.lit("ChordStart_None"), F.lit("MelodyStart_None")), "have")).alias("i", "name"), "top")
    return vocabulary.select("name", "id").unionByName(new.select("name", (F.col("top") + 1 + F.col("i")).cast("int").alias("id")))


def key_adherence(notes: DataFrame, songs: DataFrame) -> DataFrame:
    """By song: notes, those in the scale of its key, and their share; songs without a key are left out."""
    known = songs.where("key_signature IS NOT NULL").select("song_id", "key_signature")
    inside = keys.in_scale(F.col("pitch"), F.col("key_signature"))
    return notes.join(known, "song_id").groupBy("song_id").agg(F.count("*").alias("notes"), F.count_if(inside).alias("in_scale"), F.round(F.avg(inside.cast("double")), 6).alias("adherence"))
