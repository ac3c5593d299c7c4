"""Column helpers for keys, names and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The circle that transposition walks on.
CIRCLE = "C Db D Eb E F F# G Ab A Bb B".split()


def transposed_key(key: Column, semitones: Column) -> Column:
    """key moved on the circle of its mode; spellings that are not on the circle stay as they are."""
    def on(circle: list[str]) -> Column:
        names = F.array(*map(F.lit, circle))
        at = F.array_position(names, key)
        return F.when(at > 0, F.element_at(names, F.pmod(at - 1 + semitones, F.lit(12)).cast("int") + 1))

    return F.coalesce(on(CIRCLE), on([f"{k}m" for k in CIRCLE]), key)


def original_id(name: Column) -> Column:
    """The song that a file was made from: the name up to -transpose, without its first part, tempo parts and remi."""
    base = F.element_at(F.split(F.regexp_replace(name, r"\.json(\.gz)?$", ""), "-transpose"), 1)
    parts = F.split(base, "-")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.rlike(r"bpm$") & (F.lower(p) != "remi"))
    return F.array_join(rest, "-")


def renamed_key(name: Column, old: Column, new: Column) -> Column:
    """A file name with its leading key exchanged once; a name that begins otherwise gets the new key in front."""
    rest = F.when(F.startswith(name, F.concat(old, F.lit("-"))), F.substring(name, F.length(old) + 2, F.length(name))).otherwise(name)
    return F.concat(new, F.lit("-"), rest)


def key_in_names(key: Column) -> Column:
    """A key as file names write it: sharp and flat as words, minor as m; C if there is none."""
    k = F.trim(F.coalesce(key, F.lit("")))
    minor = F.endswith(k, F.lit("m")) | F.contains(F.lower(k), F.lit("minor"))
    bare = F.trim(F.regexp_replace(k, "[Mm](inor|ajor)", ""))
    bare = F.when(minor & F.endswith(bare, F.lit("m")) & (F.length(bare) > 1), F.regexp_replace(bare, "m$", "")).otherwise(bare)
    said = F.regexp_replace(F.regexp_replace(F.replace(bare, F.lit("#"), F.lit("sharp")), "\u266d", "flat"), "(?<=[A-Ga-g])b", "flat")
    said = F.concat(said, F.when(minor, "m").otherwise(""))
    said = F.concat(F.upper(F.substring(said, 1, 1)), F.lower(F.substring(said, 2, 1000)))
    return F.when(said.rlike(r"^\p{L}"), said).otherwise("C")


def output_name(key: Column, bpm: Column, tokenization: Column, title: Column, most: int = 100) -> Column:
    """The name of a song's document: key, tempo (rounded half to even), tokenization and title, whose end gives way to most."""
    head = F.concat(key_in_names(key), F.lit("-"), F.bround(bpm, 0).cast("int").cast("string"), F.lit("bpm-"), F.lower(tokenization), F.lit("-"))
    safe = safe_name(title, 40)
    room = F.lit(most - len(".json")) - F.length(head)
    cut = F.when((F.length(safe) > room) & (room > 0), F.substring(safe, F.lit(1), room)).otherwise(safe)
    return F.concat(head, cut, F.lit(".json"))


#: Roots by name with their pitch class, and the steps of the scales.
ROOTS = {"C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11}
MAJOR_SCALE, MINOR_SCALE = (0, 2, 4, 5, 7, 9, 11), (0, 2, 3, 5, 7, 8, 10)
#: Keys and time signatures in the order of their condition ids, which begin at 1; 0 is none.
CONDITION_KEYS = "C Db D Eb E F F# Gb G Ab A Bb B Am Bbm Bm Cm C#m Dm Ebm Em Fm F#m Gm G#m".split()
CONDITION_TIMES = ((1, 4), (2, 4), (3, 4), (4, 4), (3, 8), (6, 8), (12, 8), (5, 4), (6, 4))


def key_root(key: Column) -> Column:
    """Pitch class of a key's root; null for text that is no key."""
    names = F.create_map(*(F.lit(x) for pair in ROOTS.items() for x in pair))
    return F.try_element_at(names, F.regexp_extract(key, "^([A-G][#b]?)m?$", 1))


def is_minor(key: Column) -> Column:
    return F.endswith(key, F.lit("m"))


def in_scale(pitch: Column, key: Column) -> Column:
    """Whether a pitch belongs to a key's scale (major or natural minor); null for text that is no key."""
    step = F.pmod(pitch - key_root(key), F.lit(12))
    return F.when(is_minor(key), step.isin(*MINOR_SCALE)).otherwise(step.isin(*MAJOR_SCALE))


def key_condition(key: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, CONDITION_KEYS)), key), F.lit(0)).cast("int")


def time_condition(numerator: Column, denominator: Column) -> Column:
    out = F.lit(0)
    for i, (n, d) in enumerate(CONDITION_TIMES):
        out = F.when((numerator == n) & (denominator == d), i + 1).otherwise(out)
    return out


def name_facts(name: Column) -> dict[str, Column]:
    """What a document's name says: bpm and transpose offset, null where it says nothing."""
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("int")
    return {"bpm": number(r"-(\d+)bpm-"), "offset": number(r"-transpose([+-]\d+)")}


def safe_name(name: Column, most: int = 50) -> Column:
    """A file name of letters, digits, - and _, lower case, at most most characters; unnamed if nothing is left."""
    x = F.regexp_replace(name, r'[<>:"/\\|?*\s]', "_")
    x = F.regexp_replace(F.regexp_replace(x, r"[^\w-]", ""), "_+", "_")
    x = F.substring(F.lower(F.regexp_replace(x, "^_+|_+$", "")), 1, most)
    return F.when(x == "", "unnamed").otherwise(x)


def split_by_song(songs: DataFrame, key: str = "song_id", train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Each song's split: whole songs only, so no copy leaks. Songs are put in order by a seeded hash; small corpora give one
    song each to test, then val. One row a song is ranked, in buckets of the hash with running sums over the buckets."""
    ids = songs.select(key).distinct().withColumn("h", F.xxhash64(F.lit(seed), key)).withColumn("bucket", F.pmod(F.col("h"), F.lit(1024)))
    sizes = ids.groupBy("bucket").count()
    run = Window.orderBy("bucket")
    offsets = sizes.select("bucket", (F.sum("count").over(run.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"), F.sum("count").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    ranked = ids.join(F.broadcast(offsets), "bucket").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) - 1)
    n = F.col("n")
    test_n = F.when(n >= 2, F.greatest(F.floor(n * (1 - train - val) + 1e-9), F.lit(1))).otherwise(0)
    val_n = F.when(n >= 3, F.greatest(F.floor(n * val + 1e-9), F.lit(1))).otherwise(0)
    return ranked.select(key, F.when(F.col("place") < test_n, "test").when(F.col("place") < test_n + val_n, "val").otherwise("train").alias("split"))
