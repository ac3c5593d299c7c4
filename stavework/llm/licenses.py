"""License scan by diagonal voting.

Every rolling k-gram of words of every document is joined, by its hash, to the places where the same k-gram stands in a template. A hit
votes for the diagonal (place in the document less place in the template). Votes are checked word for word and gathered by
document, template and diagonal. Neighbouring diagonals, at most DRIFT apart in all, are merged, which bridges inserted or missing
words, and a merged span is verified: what counts is the words that stand in the template's order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import buffers, text_chunks
from .grams import FOLDED_ASCII, word_grams

#: Words in a k-gram. The shortest template has two.
GRAM = 2
#: Diagonals of a place are at most this far apart, all together, in templates of LONG words or more (in shorter ones, one word more or less is another
#: license); the share of a notice's words that must be found.
DRIFT, LONG, LEAST_SHARE = 3, 10, 0.9
#: The phrases of the base rule and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices of well-known licenses, as lower-case words, with more exact labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "licensed under the gnu general public license version 2": "gpl-2.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
}

def _templates(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """One row per k-gram of every template: hash, template, place, words of the k-gram, length, label, whether base.

    Its size is fixed by the phrases given, so it can be broadcast. Template -1 has one row at hash 0, which each document
    holds once, so that documents without a hit stay in the result.
    """
    rows = [(0, -1, 0, "", 0, "", False)]
    for t, (phrase, label) in enumerate([*phrases.items(), *notices.items()]):
        words = phrase.split()
        data = phrase.encode()
        gram = word_grams(data, np.array([0, len(data)]), FOLDED_ASCII, GRAM)[3]
        rows += [(int(g.astype(np.int64)), t, i, " ".join(words[i : i + GRAM]), len(words), label, t < len(phrases)) for i, g in enumerate(gram[: len(words) - GRAM + 1])]
    return spark.createDataFrame(rows, "gram long, template int, place int, words string, size int, label string, base boolean")


def _in_order(merged: str) -> Column:
    """How many of a template's words stand in their order in a span: the longest chain of matched words that rises both in template and document.

    Words by template place (the last in the document first) are folded into the least ends of chains of each length.
    """
    words = F.flatten(F.transform(merged, lambda d: F.flatten(F.transform(d["places"], lambda p: F.transform(F.sequence(p, p + GRAM - 1), lambda w: F.struct(w.alias("word"), (-(d["diagonal"] + w)).alias("at")))))))

    def longer(ends: Column, word: Column) -> Column:
        at = -word["at"]
        below = F.filter(ends, lambda e: e < at)
        return F.concat(below, F.array(at), F.slice(ends, F.size(below) + 2, F.size(ends)))

    return F.size(F.aggregate(F.array_sort(F.array_distinct(words)), F.array().cast("array<bigint>"), longer))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places where a base phrase's words stand one after another; first_word and last_word are the
    least and greatest of their starts (null if none). labels adds those of notices of which LEAST_SHARE of the words or
    more are found in order on neighbouring diagonals. score is the best share found of any template. Phrases have GRAM words
    or more. Null and empty texts have no words. Null and repeated keys stay rows of their own; other columns are dropped.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, "t"):
            data, bounds = buffers(b.column("t"))
            start, size, owner, gram = word_grams(data, bounds, FOLDED_ASCII, GRAM)
            n = np.bincount(owner, minlength=b.num_rows)
            offsets = np.r_[0, np.cumsum(n + 1)].astype(np.int32)
            # each document's list begins with hash 0 at place -1
            where = np.delete(np.arange(offsets[-1]), offsets[:-1]) if len(gram) else np.zeros(0, np.int64)
            lists = []
            for values, kind in ((gram.view(np.int64), np.int64), (start - bounds[owner], np.int32), (size, np.int32)):
                flat = np.zeros(offsets[-1], kind)
                flat[where] = values
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([b.column("r"), b.column("k"), b.column("t").cast(pa.binary()), pa.array(n, pa.int64()), *lists], ["r", "k", "t", "n_words", "grams", "starts", "sizes"])

    spark = docs.sparkSession
    words = docs.select(F.monotonically_increasing_id().alias("r"), F.col(key).alias("k"), F.col(text).alias("t"))
    words = words.mapInArrow(run, f"r long, k {key_type}, t binary, n_words long, grams array<long>, starts array<int>, sizes array<int>")
    grams = words.select("r", "k", "t", "n_words", "starts", "sizes", F.posexplode("grams").alias("at", "gram"))
    grams = grams.where("gram <> 0 OR at = 0")
    hits = grams.join(F.broadcast(_templates(spark, phrases, notices)), "gram")
    said = F.expr(f"substring(t, starts[at] + 1, starts[at + {GRAM - 1}] + sizes[at + {GRAM - 1}] - starts[at])").cast("string")
    said = F.trim(F.regexp_replace(F.translate(said, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    hits = hits.select("r", "k", "n_words", "template", "place", "size", "label", "base", (F.col("at") - 1 - F.col("place")).cast("long").alias("diagonal"), F.when(F.col("template") < 0, F.lit(True)).otherwise(said == F.col("words")).alias("same"))
    votes = hits.where("same").drop("same").repartition("r")

    # votes by diagonal, and for long templates those of the diagonals within DRIFT after it
    by = ["r", "template", "k", "n_words", "size", "label", "base"]
    lines = votes.groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"))
    near = Window.partitionBy("r", "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    own = F.struct("diagonal", "places")
    spans = lines.withColumn("merged", F.when(F.col("size") < LONG, F.array(own)).otherwise(F.collect_list(own).over(near)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten("merged.places"), lambda p: F.sequence(p, p + GRAM - 1)))))
    spans = spans.withColumn("found", F.when(covered >= F.col("size") * LEAST_SHARE, _in_order("merged")).otherwise(0))
    spans = spans.withColumn("share", F.when(F.col("size") > 0, F.col("found") / F.col("size")).otherwise(0.0))
    is_base = F.col("base") & (F.col("share") == 1)
    labelled = (F.col("share") >= LEAST_SHARE) & (F.col("template") >= 0) & (~F.col("base") | is_base)
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")
    out = spans.groupBy("r", "k", "n_words").agg(
        F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(is_base, F.col("diagonal"))).alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"),
        joined(F.when(labelled, F.col("label"))).alias("labels"),
        F.max(F.when(labelled | (F.col("template") < 0), F.col("share"))).cast("double").alias("score"),
    )
    return out.select(F.col("k").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
