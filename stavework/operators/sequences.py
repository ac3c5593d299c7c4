"""Quality of token sequences (song_id, pos, token_id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import BAR, CHORD_START, VOCABULARY, ngram_counts, song


def _entropy(counts: DataFrame, name: str) -> DataFrame:
    """Entropy in bits, number and number of distinct values of counts by song: log2(n) - sum(c log2 c) / n."""
    n, c = F.sum("count"), F.col("count")
    return counts.groupBy("song_id").agg((F.log2(n) - F.sum(c * F.log2(c.cast("double"))) / n).alias(f"{name}_entropy"), n.alias(f"{name}s"), F.count("*").alias(f"{name}_kinds"))


def _grams(tokens: DataFrame) -> DataFrame:
    one, two, three = (tokens.groupBy("song_id", "token_id").count(), ngram_counts(tokens, 2), ngram_counts(tokens, 3))
    return _entropy(one, "token").join(_entropy(two, "bigram"), "song_id", "left").join(_entropy(three, "trigram"), "song_id", "left")


def coherence(tokens: DataFrame) -> DataFrame:
    return _grams(tokens).select("song_id", F.round(1 - F.col("token_kinds") / F.col("tokens"), 6).alias("repetition"), F.round(F.coalesce("bigram_entropy", F.lit(0.0)), 6).alias("bigram_entropy"), F.round(F.coalesce("trigram_entropy", F.lit(0.0)), 6).alias("trigram_entropy"))


def complexity(tokens: DataFrame) -> DataFrame:
    """0.3 distinct tokens + 0.3 distinct bigrams + 0.4 entropy over its maximum, each a share."""
    even = F.when(F.col("token_kinds") > 1, F.col("token_entropy") / F.log2(F.col("token_kinds").cast("double"))).otherwise(0.0)
    two = F.coalesce(F.col("bigram_kinds") / F.col("bigrams"), F.lit(0.0))
    return _grams(tokens).select("song_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("token_kinds") / F.col("tokens") * 0.3 + two * 0.3 + even * 0.4)), 6).alias("complexity"))


def pattern_consistency(tokens: DataFrame) -> DataFrame:
    """Mean likeness of the numbers of distinct tokens in adjacent tenths (5 tokens at least) of a song; 1 with fewer than two."""
    whole = Window.partitionBy("song_id")
    t = tokens.select("song_id", "token_id", (F.row_number().over(song()) - 1).alias("i"), F.count("*").over(whole).alias("n")).withColumn("size", F.greatest(F.floor(F.col("n") / 10), F.lit(5)))
    t = t.withColumn("part", F.floor(F.col("i") / F.col("size"))).where("part * size < n - size")
    parts = t.groupBy("song_id", "part").agg(F.count_distinct("token_id").alias("kinds"))
    last = F.lag("kinds").over(whole.orderBy("part"))
    like = parts.select("song_id", (1 - F.abs(F.col("kinds") - last) / F.greatest("kinds", last)).alias("like"))
    mean = like.groupBy("song_id").agg(F.avg("like").alias("like"))
    return tokens.groupBy("song_id").agg(F.count("*").alias("n")).join(mean, "song_id", "left").select("song_id", F.round(F.when(F.col("n") < 10, 1.0).otherwise(F.coalesce("like", F.lit(1.0))), 6).alias("consistency"))


def chord_check(tokens: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """Number of ids past the vocabulary, and whether a song has a bar and a chord marker; valid when all hold."""
    s = tokens.groupBy("song_id").agg(F.count_if(F.col("token_id") >= size).alias("beyond"), F.bool_or(F.col("token_id") == BAR).alias("has_bar"), F.bool_or(F.col("token_id") == CHORD_START).alias("has_chord"))
    return s.withColumn("valid", (F.col("beyond") == 0) & F.col("has_bar") & F.col("has_chord"))


def penalized(scores: DataFrame, history: DataFrame, penalty: float = 1.1) -> DataFrame:
    """scores (row_id, token_id, score), those of tokens in the row's history lowered: divided if above 0, else multiplied."""
    seen = history.select("row_id", "token_id").distinct().withColumn("seen", F.lit(True))
    low = F.when(F.col("score") > 0, F.col("score") / penalty).otherwise(F.col("score") * penalty)
    return scores.join(seen, ["row_id", "token_id"], "left").select("row_id", "token_id", F.when(F.col("seen"), low).otherwise(F.col("score")).alias("score"))


def structural_coherence(tokens: DataFrame) -> DataFrame:
    """Mean cosine of the token counts of up to ten equal segments of 20 tokens or more with those of the whole song; 1 with fewer than two."""
    whole = Window.partitionBy("song_id")
    t = tokens.select("song_id", "token_id", (F.row_number().over(song()) - 1).alias("i"), F.count("*").over(whole).alias("n"))
    t = t.withColumn("k", F.least(F.lit(10), F.floor(F.col("n") / 20))).withColumn("part", F.when(F.col("k") > 1, F.least(F.floor(F.col("i") / F.floor(F.col("n") / F.col("k"))), F.col("k") - 1)).otherwise(0))
    local = t.groupBy("song_id", "k", "part", "token_id").agg(F.count("*").alias("c"))
    both = local.withColumn("g", F.sum("c").over(Window.partitionBy("song_id", "token_id")))
    norm = local.groupBy("song_id", "token_id").agg(F.sum("c").alias("g")).groupBy("song_id").agg(F.sum(F.col("g") * F.col("g")).alias("gg"))
    parts = both.groupBy("song_id", "k", "part").agg(F.sum(F.col("c") * F.col("g")).alias("cg"), F.sum(F.col("c") * F.col("c")).alias("cc")).join(norm, "song_id")
    return parts.groupBy("song_id").agg(F.round(F.when(F.first("k") < 2, 1.0).otherwise(F.avg(F.col("cg") / F.sqrt(F.col("cc") * F.col("gg").cast("double")))), 6).alias("coherence"))


def compression(tokens: DataFrame, notes: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """Tokens and bits a note, share saved against 24 bits a note, distinct tokens a token, and entropy over its maximum."""
    s = _entropy(tokens.groupBy("song_id", "token_id").count(), "token").join(notes.groupBy("song_id").agg(F.count("*").alias("notes")), "song_id")
    ratio = F.col("tokens") / F.col("notes")
    bits = ratio * F.log2(F.lit(float(size)))
    dense = F.col("token_kinds") / F.col("tokens")
    values = {"ratio": ratio, "bits_per_note": bits, "effective": 1 - bits / 24, "density": dense, "redundancy": 1 - dense, "efficiency": F.col("token_entropy") / F.log2(F.lit(float(size)))}
    return s.select("song_id", *(F.round(v, 6).alias(k) for k, v in values.items()))


def _best_patterns(ids: np.ndarray, least: int, longest: int, times: int, k: int) -> list[tuple[int, int, int]]:
    """(length, count, first) of the k best patterns of one song, best first.

    Patterns are numbered exactly, length by length: a pattern is that of one token less and its last token. One that stands too
    seldom has no longer one that stands often enough, so its places are left.
    """
    n = len(ids)
    at, code = np.arange(n), np.unique(ids, return_inverse=True)[1].astype(np.int64)
    kinds = code.max(initial=0) + 1
    token, best = code, []
    for length in range(1, min(longest, n // 2 - 1) + 1):
        if length > 1:
            at, code = at[: np.searchsorted(at, n - length, "right")], code[: np.searchsorted(at, n - length, "right")]
            code = code * kinds + token[at + length - 1]
        _, first, code, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        if length >= least:
            order = np.lexsort((first, -count))[:k]
            best += [(length, int(count[i]), int(at[first[i]])) for i in order if count[i] >= times]
        often = count[code] >= times
        at, code = at[often], code[often]
        if not len(at):
            break
    return sorted(best, key=lambda p: (-p[0] * p[1], p[0], p[2]))[:k]


def repeated_patterns(tokens: DataFrame, least: int = 4, longest: int = 19, times: int = 2, k: int = 20) -> DataFrame:
    """The k patterns of least to longest tokens of each song with the greatest count times length that stand times or more; earlier first places first among equals.

    A song's tokens are one array, so only tokens are shuffled and never patterns; a task holds one song at a time, some 60 bytes a token. Lengths stop below half the song.
    """
    songs = tokens.groupBy("song_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token_id"))), lambda x: x["token_id"]).alias("ids"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for song, ids in zip(batch["song_id"], batch["ids"], strict=True):
                found = _best_patterns(ids.values.to_numpy(zero_copy_only=False), least, longest, times, k)
                if found:
                    rows = [(song.as_py(), len(ids), i + 1, *p) for i, p in enumerate(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (batch["song_id"].type, pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["song_id", "n", "place", "length", "count", "first"])

    return songs.mapInArrow(search, f"song_id {dict(tokens.dtypes)['song_id']}, n long, place int, length int, count long, first int")


def has_structure(tokens: DataFrame, patterns: int = 5, times: int = 4) -> DataFrame:
    """Whether more than `patterns` of a song's twenty best patterns stand `times` or more."""
    p = repeated_patterns(tokens).groupBy("song_id").agg(F.count_if(F.col("count") >= times).alias("strong"))
    return tokens.select("song_id").distinct().join(p, "song_id", "left").select("song_id", F.coalesce(F.col("strong") > patterns, F.lit(False)).alias("structured"))


def phrase_coherence(tokens: DataFrame) -> DataFrame:
    """Mean over phrase lengths of the share of the commonest 8 tokens at phrase beginnings; 0.5 where no length has two phrases."""
    whole = Window.partitionBy("song_id")
    opening = F.collect_list("token_id").over(song().rowsBetween(0, 7))
    t = tokens.select("song_id", (F.row_number().over(song()) - 1).alias("i"), F.count("*").over(whole).alias("n"), opening.alias("o"))
    t = t.withColumn("length", F.explode(F.array(*map(F.lit, (16, 32, 64, 128))))).where("n >= 2 * length AND i % length = 0 AND i < n - length")
    shares = t.groupBy("song_id", "length", "o").count().groupBy("song_id", "length").agg((F.max("count") / F.sum("count")).alias("share"), F.sum("count").alias("phrases")).where("phrases > 1")
    mean = shares.groupBy("song_id").agg(F.avg("share").alias("share"))
    return tokens.select("song_id").distinct().join(mean, "song_id", "left").select("song_id", F.round(F.coalesce("share", F.lit(0.5)), 6).alias("coherence"))


def motif_score(tokens: DataFrame) -> DataFrame:
    """Score of what the ten best patterns of three tokens or more that stand three times or more cover; 0.5 without any, 1 for songs under 20 tokens."""
    top = repeated_patterns(tokens, 3, 19, 3, 10).groupBy("song_id").agg((F.sum(F.col("count") * F.col("length")) / F.first("n")).alias("cover"))
    n = tokens.groupBy("song_id").agg(F.count("*").alias("n")).join(top, "song_id", "left")
    c = F.col("cover")
    score = F.when(F.col("n") < 20, 1.0).when(c.isNull(), 0.5).when(c < 0.1, c * 5).when(c > 0.7, F.greatest(F.lit(0.0), 1.7 - c)).otherwise(1.0)
    return n.select("song_id", F.round(score, 6).alias("motif"))
