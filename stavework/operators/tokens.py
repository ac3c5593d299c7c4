"""Operators on token tables (song_id, pos, token_id). Windows go by song; nothing is ordered over all songs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Special ids, section markers and vocabulary size.
PAD, BOS, EOS, BAR, CHORD_START, MELODY_START, VOCABULARY = 0, 1, 2, 4, 531, 532, 533
#: First id, last id and first number of each numbered class of the vocabulary.
RANGES = {
    "Pitch": (5, 92, 21), "Velocity": (93, 108, 0), "Duration": (109, 156, 0), "Position": (157, 252, 0), "PitchDrum": (253, 314, 27),
    "Chord": (315, 328, 0), "Tempo": (329, 392, 0), "Program": (393, 521, -1), "TimeSig": (522, 530, 0),
}
NAMED = {0: "PAD_None", 1: "BOS_None", 2: "EOS_None", 3: "MASK_None", 4: "Bar_None", 531: "ChordStart_None", 532: "MelodyStart_None"}


def song() -> WindowSpec:
    return Window.partitionBy("song_id").orderBy("pos")


def so_far() -> WindowSpec:
    return song().rowsBetween(Window.unboundedPreceding, 0)


def entries() -> list[tuple[str, int, str]]:
    """Name, id and class of the 533 tokens."""
    numbered = [(f"{k}_{i - lo + first}", i, k) for k, (lo, hi, first) in RANGES.items() for i in range(lo, hi + 1)]
    return [(n, i, n.split("_")[0]) for i, n in NAMED.items()] + numbered


def vocabulary(spark: SparkSession) -> DataFrame:
    """name, id, class of the 533 tokens: fixed in size, so it may be broadcast."""
    return spark.createDataFrame(entries(), "name string, id int, class string")


def token_class(token: Column) -> Column:
    """Class of a token id by its range; markers and specials by name."""
    out = F.when(token < 0, "Unknown")
    for i, n in NAMED.items():
        out = out.when(token == i, n.split("_")[0])
    for k, (lo, hi, _) in RANGES.items():
        out = out.when(token.between(lo, hi), k)
    return out.otherwise("Unknown")


def named(tokens: DataFrame) -> DataFrame:
    """tokens with their names; ids out of the vocabulary are <UNK>."""
    v = vocabulary(tokens.sparkSession).select(F.col("id").alias("token_id"), "name")
    return tokens.join(F.broadcast(v), "token_id", "left").withColumn("name", F.coalesce("name", F.lit("<UNK>")))


def out_of_vocabulary(tokens: DataFrame, size: int = VOCABULARY) -> DataFrame:
    bad = (F.col("token_id") < 0) | (F.col("token_id") >= size)
    return tokens.groupBy("song_id").agg(F.count_if(bad).alias("oov"), F.min(F.when(bad, F.col("pos"))).alias("first_oov"))


def stripped(tokens: DataFrame) -> DataFrame:
    return tokens.where(~F.col("token_id").isin(PAD, BOS, EOS))


def truncated(tokens: DataFrame, most: int = 2048) -> DataFrame:
    return tokens.withColumn("_n", F.row_number().over(song())).where(F.col("_n") <= most).drop("_n")


def context_budget(tokens: DataFrame, most: int = 2048) -> DataFrame:
    """Content tokens against the context less a reserve of a quarter, 64 at least."""
    room = most - max(most // 4, 64)
    n = tokens.groupBy("song_id").agg(F.count_if(~F.col("token_id").isin(PAD, BOS, EOS)).alias("content"))
    return n.select("song_id", "content", F.greatest(F.lit(room) - F.col("content"), F.lit(0)).alias("remaining"), F.round(F.col("content") * 100.0 / room, 6).alias("percent"), (F.col("content") <= room).alias("fits"))


def bars(tokens: DataFrame) -> DataFrame:
    """tokens with their bar: a Bar token opens one; what stands before the first is bar 0."""
    return tokens.withColumn("bar", F.sum((F.col("token_id") == BAR).cast("int")).over(so_far()))


def track_ids(tokens: DataFrame) -> DataFrame:
    """tokens with section M or C: that of the last marker, melody before any."""
    marker = F.when(F.col("token_id") == CHORD_START, "C").when(F.col("token_id") == MELODY_START, "M")
    return tokens.withColumn("section", F.coalesce(F.last(marker, ignorenulls=True).over(so_far()), F.lit("M")))


def labels(tokens: DataFrame) -> DataFrame:
    """tokens with the next token as label, -100 at the end and at padding."""
    return tokens.withColumn("label", F.when(F.col("token_id") == PAD, -100).otherwise(F.coalesce(F.lead("token_id").over(song()), F.lit(-100))))


def ngram_counts(tokens: DataFrame, n: int = 2) -> DataFrame:
    grams = tokens.select("song_id", *(F.lead("token_id", i).over(song()).alias(f"t{i}") for i in range(n))).where(f"t{n - 1} IS NOT NULL")
    return grams.groupBy("song_id", *(f"t{i}" for i in range(n))).count()


def runs(tokens: DataFrame, least: int = 2) -> DataFrame:
    """Runs of least or more equal tokens: first position, token and length, by islands."""
    place = F.row_number().over(song()) - F.row_number().over(Window.partitionBy("song_id", "token_id").orderBy("pos"))
    return tokens.withColumn("island", place).groupBy("song_id", "token_id", "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def absolute_positions(tokens: DataFrame, per_bar: int = 48) -> DataFrame:
    """Position tokens with their place from the start of the song."""
    lo, hi, _ = RANGES["Position"]
    return bars(tokens).where(F.col("token_id").between(lo, hi)).select("song_id", "pos", (F.col("bar") * per_bar + F.col("token_id") - lo).alias("place"))


def grammar_violations(tokens: DataFrame) -> DataFrame:
    """Tokens that break Pitch, Velocity, Duration; Position and markers are passed over."""
    kind = token_class(F.col("token_id"))
    solid = tokens.withColumn("class", kind).where(F.col("class").isin("Pitch", "Velocity", "Duration"))
    before = F.lag("class").over(song())
    wanted = F.when(F.col("class") == "Velocity", "Pitch").when(F.col("class") == "Duration", "Velocity").otherwise("Duration")
    return solid.withColumn("before", before).where((F.col("before").isNotNull() | (F.col("class") != "Pitch")) & ~F.col("before").eqNullSafe(wanted)).select("song_id", "pos", "class", "before")


def polyphonic_melody(tokens: DataFrame) -> DataFrame:
    """Pitches of a melody section while another is open: no duration or marker has closed it."""
    t = track_ids(tokens).withColumn("class", token_class(F.col("token_id")))
    closes = F.col("class").isin("Duration", "ChordStart", "MelodyStart", "Bar").cast("int")
    t = t.withColumn("segment", F.sum(closes).over(so_far())).where("class = 'Pitch' AND section = 'M'")
    order = Window.partitionBy("song_id", "segment").orderBy("pos")
    return t.withColumn("_n", F.row_number().over(order)).where("_n > 1").select("song_id", "pos", "token_id")


def bar_regularity(tokens: DataFrame) -> DataFrame:
    """1 less the variation of bar lengths in tokens; 0.5 with under two bars."""
    gaps = tokens.where(F.col("token_id") == BAR).withColumn("gap", F.lead("pos").over(song()) - F.col("pos"))
    return gaps.groupBy("song_id").agg(F.round(F.when(F.count("gap") < 2, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.stddev_samp("gap") / F.avg("gap"))), 6).alias("regularity"))


def unused(tokens: DataFrame) -> DataFrame:
    """Vocabulary entries that no token of the corpus uses."""
    used = tokens.select(F.col("token_id").alias("id")).distinct()
    return vocabulary(tokens.sparkSession).join(used, "id", "left_anti").select("id", "name")


def dataset_statistics(tokens: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """Sequences, lengths (upper median: the value at place n div 2), tokens used and share of the vocabulary. Ranks
    run over lengths that occur, with their counts, so they are few."""
    lengths = tokens.groupBy("song_id").count().groupBy("count").agg(F.count("*").alias("n"))
    order = Window.orderBy("count").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("count").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = lengths.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(whole))
    facts = ranked.agg(
        F.sum("n").alias("sequences"), F.min("count").alias("min_length"), F.max("count").alias("max_length"), F.round(F.sum(F.col("count") * F.col("n")) / F.sum("n"), 6).alias("avg_length"),
        F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("count"))).alias("median_length"),
    )
    used = tokens.agg(F.count_distinct("token_id").alias("used"))
    return facts.withColumn("_k", F.lit(1)).join(used.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("coverage", F.round(F.col("used") * 100.0 / size, 6))


def class_counts(spark: SparkSession) -> DataFrame:
    return vocabulary(spark).groupBy("class").agg(F.count("*").alias("n"))


def top_tokens(tokens: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent tokens of each song, lower ids first among equals."""
    counts = tokens.groupBy("song_id", "token_id").count()
    order = Window.partitionBy("song_id").orderBy(F.desc("count"), "token_id")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _first(counts: DataFrame, k: int, *by: Column | str) -> DataFrame:
    """The first k rows of each song in the order given, with their place from 1."""
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("song_id").orderBy(*by))).where(F.col("place") <= k)


def least_tokens(tokens: DataFrame, k: int = 20) -> DataFrame:
    """The k rarest tokens of each song that has more than k distinct ones, rarest first, lower ids first among equals."""
    counts = tokens.groupBy("song_id", "token_id").count()
    many = counts.withColumn("distinct", F.count("*").over(Window.partitionBy("song_id"))).where(F.col("distinct") > k)
    return _first(many.drop("distinct"), k, "count", "token_id")


def top_ngrams(tokens: DataFrame, n: int = 2, k: int = 20) -> DataFrame:
    """The k most frequent runs of n tokens of each song, in the order of their ids among equals. Songs of fewer than n tokens have none."""
    ids = [f"t{i}" for i in range(n)]
    return _first(ngram_counts(tokens, n), k, F.desc("count"), *ids)


def top_pitches(notes: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent pitches of each song, lower ones first among equals."""
    return _first(notes.groupBy("song_id", "pitch").count(), k, F.desc("count"), "pitch")


def type_distribution(tokens: DataFrame) -> DataFrame:
    """How many tokens of each class a song has, and their share of its tokens. Ids out of the vocabulary have no class: they count
    in the whole only."""
    counts = tokens.groupBy("song_id", token_class(F.col("token_id")).alias("class")).count()
    share = F.col("count") / F.sum("count").over(Window.partitionBy("song_id"))
    return counts.withColumn("share", share).where("class <> 'Unknown'")


def vocabulary_usage(tokens: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """Distinct tokens, coverage and entropy in bits by song."""
    counts = tokens.groupBy("song_id", "token_id").count()
    p = F.col("count") / F.sum("count").over(Window.partitionBy("song_id"))
    return counts.withColumn("p", p).groupBy("song_id").agg(F.count("*").alias("used"), F.round(F.count("*") / size, 6).alias("coverage"), F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("entropy"))


def perplexity(tokens: DataFrame) -> DataFrame:
    """Two to the mean surprise of a token given the one before, from counts of pairs and of single tokens."""
    pairs = ngram_counts(tokens, 2)
    single = tokens.groupBy("song_id", F.col("token_id").alias("t0")).agg(F.count("*").alias("n"))
    return pairs.join(single, ["song_id", "t0"]).groupBy("song_id").agg(F.round(F.pow(F.lit(2.0), -F.sum(F.col("count") * F.log2(F.col("count") / F.col("n"))) / F.sum("count")), 6).alias("perplexity"))


def smoothness(tokens: DataFrame) -> DataFrame:
    steps = tokens.withColumn("step", F.abs(F.col("token_id") - F.lag("token_id").over(song())))
    return steps.groupBy("song_id").agg(F.round(1 - F.avg("step") / F.max("step"), 6).alias("smoothness"))


def transposed(tokens: DataFrame, semitones: int, low: int = 36, high: int = 84) -> DataFrame:
    """tokens moved by semitones: a pitch whose target is in range and in the vocabulary; others stay."""
    lo, hi, first = RANGES["Pitch"]
    pitch = F.col("token_id") - lo + first
    moves = F.col("token_id").between(lo, hi)
    fits = moves & (pitch + semitones).between(low, high) & (F.col("token_id") + semitones).between(lo, hi)
    return tokens.withColumn("new_id", F.when(fits, F.col("token_id") + semitones).otherwise(F.col("token_id"))).withColumn("moved", fits)


def content_hash(tokens: DataFrame) -> DataFrame:
    """MD5 of each song's ids in order, without separator."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"].cast("string"))
    return tokens.groupBy("song_id").agg(F.md5(F.concat_ws("", ids)).alias("hash"))
