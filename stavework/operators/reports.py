"""Batch, corpus and trend reports over file results, and operators on score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def batch_statistics(results: DataFrame) -> DataFrame:
    """By batch: files, successes, quality of successes, and buckets of quality."""
    ok, q = F.col("success"), F.when(F.col("success"), F.col("overall_score"))
    return results.groupBy("batch_id").agg(
        F.count("*").alias("files"), F.count_if(ok).alias("successful"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"), F.round(F.avg(q), 6).alias("avg_quality"), F.round(F.min(q), 6).alias("min_quality"), F.round(F.max(q), 6).alias("max_quality"),
        F.count_if(q >= 0.95).alias("excellent"), F.count_if((q >= 0.9) & (q < 0.95)).alias("good"), F.count_if((q >= 0.8) & (q < 0.9)).alias("fair"), F.count_if(q < 0.8).alias("poor"), F.sum("seconds").alias("total_seconds"),
    )


#: What a word in an error message says about its kind, in this order.
ERRORS = {"corrupt": "corrupted_file", "memory": "memory_error", "token": "tokenization_error"}


def coordinator_statistics(results: DataFrame, most: int = 10) -> DataFrame:
    """By batch, over results of files (status, overall_score, tokens, strategy, issues, error_message, seconds): counts by status, quality of completed
    files and its buckets, tokens, times, and as text in order: error kinds of failed files, success rate by strategy, and the most frequent issues.

    A score of 0 is no quality. Of each completed file the first two issues count. Kinds, strategies and issues are counted in long form, one
    row each, and only these counts come together by batch. Issues as frequent as others go by name.
    """
    done, bad = F.col("status") == "completed", F.col("status") == "failed"
    q = F.when(done & (F.col("overall_score") > 0), F.col("overall_score"))
    counts = results.groupBy("batch_id").agg(
        F.count("*").alias("files"), F.count_if(done).alias("completed"), F.count_if(bad).alias("failed"), F.count_if(~F.coalesce(done | bad, F.lit(False))).alias("skipped"),
        F.round(F.avg(q), 6).alias("avg_quality"), F.min(q).alias("min_quality"), F.max(q).alias("max_quality"),
        F.count_if(q >= 0.95).alias("excellent"), F.count_if((q >= 0.9) & (q < 0.95)).alias("good"), F.count_if((q >= 0.8) & (q < 0.9)).alias("fair"), F.count_if(q < 0.8).alias("poor"),
        F.sum(F.when(done, F.col("tokens"))).alias("tokens"), F.avg(F.when(done, F.col("tokens"))).alias("avg_tokens"), F.sum("seconds").alias("seconds"), F.avg("seconds").alias("avg_seconds"),
    )
    kind = F.lit("other")
    for word, name in reversed(ERRORS.items()):
        kind = F.when(F.lower("error_message").contains(word), name).otherwise(kind)
    none = F.lit(None).cast("string")
    said = F.array_compact(F.concat(
        F.array(F.when(bad & F.col("error_message").isNotNull(), F.struct(F.lit("error").alias("what"), kind.alias("name"), F.lit(1).alias("good")))),
        F.array(F.when(done, F.struct(F.lit("strategy").alias("what"), F.coalesce("strategy", F.lit("unknown")).alias("name"), F.col("success").cast("int").alias("good")))),
        F.transform(F.when(done, F.slice("issues", 1, 2)).otherwise(F.array(none)), lambda x: F.when(x.isNotNull(), F.struct(F.lit("issue").alias("what"), x.alias("name"), F.lit(1).alias("good")))),
    ))
    long = results.select("batch_id", F.explode(said).alias("s")).groupBy("batch_id", "s.what", "s.name").agg(F.count("*").alias("n"), F.avg("s.good").alias("rate"))
    place = F.row_number().over(Window.partitionBy("batch_id", "what").orderBy(F.desc("n"), "name"))
    line = F.concat("name", F.lit("="), F.when(F.col("what") == "strategy", F.format_number("rate", 4)).otherwise(F.col("n").cast("string")))
    kept = long.withColumn("place", place).where((F.col("what") != "issue") | (F.col("place") <= most)).withColumn("key", F.when(F.col("what") == "issue", F.lpad(F.col("place").cast("string"), 6, "0")).otherwise(F.col("name")))
    of = lambda what: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("what") == what, F.struct("key", line.alias("line"))))), lambda x: x["line"]), ",")
    texts = kept.groupBy("batch_id").agg(of("error").alias("error_kinds"), of("strategy").alias("strategies"), of("issue").alias("top_issues"))
    return counts.join(texts, "batch_id", "left").na.fill("", ["error_kinds", "strategies", "top_issues"])


def merged(batches: DataFrame) -> DataFrame:
    """Statistics of all batches from their partial ones: sums, and quality weighted by successes."""
    n = F.col("successful")
    return batches.agg(F.sum("files").alias("files"), F.sum(n).alias("successful"), F.round(F.sum(F.col("avg_quality") * n) / F.sum(n), 4).alias("avg_quality"), F.min("min_quality").alias("min_quality"), F.max("max_quality").alias("max_quality"))


def dashboard(results: DataFrame) -> DataFrame:
    """Health of a corpus: 40 for mean quality, 40 for the share that passes, 20 for steadiness; and its band."""
    q = F.when(F.col("success"), F.col("overall_score"))
    f = results.agg(F.avg(q).alias("q"), F.avg(F.col("success").cast("double")).alias("p"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("s"))
    health = 40 * F.col("q") + 40 * F.col("p") + 20 * (1 - F.least(F.col("s"), F.lit(0.3)) / 0.3)
    f = f.withColumn("health", health)
    return f.select(F.round("health", 4).alias("health"), F.when(F.col("health") >= 90, "excellent").when(F.col("health") >= 75, "good").when(F.col("health") >= 60, "fair").otherwise("poor").alias("status"))


def quality_trend(batches: DataFrame) -> DataFrame:
    """Mean quality of the later half of batches against the earlier; more than 5 % either way is a trend. One row a batch is ordered."""
    scored = batches.where("avg_quality > 0")
    ranked = scored.select("avg_quality", F.row_number().over(Window.orderBy("batch_id")).alias("n"), F.count("*").over(Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    early = F.col("n") <= F.floor(F.col("all") / 2)
    f = ranked.agg(F.avg(F.when(early, F.col("avg_quality"))).alias("a"), F.avg(F.when(~early, F.col("avg_quality"))).alias("b"))
    change = (F.col("b") - F.col("a")) / F.col("a") * 100
    return f.select(F.round(change, 4).alias("change_rate"), F.when(change > 5, "improving").when(change < -5, "declining").otherwise("stable").alias("direction"))


def frequent_errors(results: DataFrame, k: int = 3) -> DataFrame:
    return results.where("error_message IS NOT NULL").groupBy("error_message").count().orderBy(F.desc("count"), "error_message").limit(k)


def gated(results: DataFrame) -> DataFrame:
    """Files with the strictest gate that their score passes."""
    s = F.col("overall_score")
    return results.select("file_id", F.when(s >= 0.95, "production").when(s >= 0.9, "standard").when(s >= 0.8, "permissive").when(s >= 0.6, "experimental").otherwise("none").alias("gate"))


def error_kinds(results: DataFrame) -> DataFrame:
    """Errors by kind, from keywords of their text."""
    m = F.lower("error_message")
    kind = F.when(m.contains("memory"), "memory").when(m.contains("token"), "tokenization").when(m.contains("corrupt"), "corrupt_file").when(m.contains("metadata"), "metadata").otherwise("unknown")
    return results.where("error_message IS NOT NULL").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def top_k(scores: DataFrame, k: int = 5) -> DataFrame:
    """Scores of the k best by row; scores equal to the last of them stay."""
    return scores.withColumn("place", F.rank().over(Window.partitionBy("row_id").orderBy(F.desc("score")))).where(F.col("place") <= k)


def _softmax(scores: DataFrame) -> DataFrame:
    row = Window.partitionBy("row_id")
    e = F.exp(F.col("score") - F.max("score").over(row))
    return scores.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(row)).drop("e")


def top_p(scores: DataFrame, p: float = 0.9) -> DataFrame:
    """The fewest best scores of each row whose softmax reaches p, one at least."""
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "token_id").rowsBetween(Window.unboundedPreceding, 0)
    return _softmax(scores).withColumn("before", F.sum("p").over(order) - F.col("p")).where(F.col("before") <= p - 1e-12).select("row_id", "token_id")


def entropy(scores: DataFrame) -> DataFrame:
    """Entropy in nats of each row's softmax, and its exponential."""
    h = -F.sum(F.col("p") * F.ln(F.col("p") + 1e-10))
    return _softmax(scores).groupBy("row_id").agg(F.round(h, 5).alias("entropy"), F.round(F.exp(h), 4).alias("perplexity"))
