"""Scores, verdicts and advice over tables of file results and component scores; one row a file or song unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPONENTS = ("round_trip", "musical", "sequence", "statistical")
#: Weights of the components by use case.
USE_CASES = {
    "research": (0.35, 0.25, 0.20, 0.20), "production": (0.30, 0.30, 0.20, 0.20), "generation": (0.25, 0.35, 0.25, 0.15), "archival": (0.40, 0.20, 0.15, 0.25),
}


def within(x: Column) -> Column:
    """x held between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def overall(weights: tuple[float, ...] = USE_CASES["production"], completeness: str = "completeness") -> Column:
    """Weighted mean of the components above 0, times 0.95 to 1 by completeness; 0 without any."""
    used = [(F.col(c), w) for c, w in zip(COMPONENTS, weights, strict=True)]
    total = sum((F.when(c > 0, c * w).otherwise(0.0) for c, w in used), F.lit(0.0))
    weight = sum((F.when(c > 0, w).otherwise(0.0) for c, w in used), F.lit(0.0))
    return F.when(weight > 0, within(total / weight * (0.95 + 0.05 * F.col(completeness)))).otherwise(0.0)


def categories() -> dict[str, Column]:
    r, m, s, t = map(F.col, COMPONENTS)
    return {"accuracy": r * 0.6 + t * 0.4, "musicality": m * 0.7 + s * 0.3, "technical": s * 0.5 + t * 0.5, "preservation": r * 0.5 + m * 0.5}


def confidence(completeness: str = "completeness", level: str = "level") -> Column:
    """Completeness, less for the simplest and the most complex songs, and less where components disagree (a deviation over 0.2)."""
    valid = F.filter(F.array(*map(F.col, COMPONENTS)), lambda x: x > 0)
    n, mean = F.size(valid), F.aggregate(valid, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(valid), F.lit(1))
    spread = F.sqrt(F.aggregate(valid, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.greatest(n - 1, F.lit(1)))
    factor = F.when(F.col(level) == "very_complex", 0.9).when(F.col(level) == "minimal", 0.95).otherwise(1.0)
    return within(F.col(completeness) * factor * F.when((n > 1) & (spread > 0.2), 1 - spread).otherwise(1.0))


def critical_issues() -> Column:
    """Names of what fails badly, in a fixed order."""
    low = lambda c, least: (F.col(c) > 0) & (F.col(c) < least)
    rules = [
        (low("round_trip", 0.80), "round trip"), (low("musical", 0.70), "musical fidelity"), (low("sequence", 0.60), "sequence quality"), (low("statistical", 0.70), "statistics"),
        (F.col("missing_ratio") > 0.10, "missing notes"), (F.col("timing") < 0.90, "timing"), (F.col("completeness") < 0.5, "incomplete"),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules)))


def quick_score() -> Column:
    """Accuracy times the mean of what lowers or raises it."""
    marks = F.array_compact(F.array(
        F.when(F.col("missing_ratio") > 0.01, 1 - F.col("missing_ratio") * 2), F.when(F.col("timing") < 0.98, F.col("timing")), F.when(F.col("velocity") < 0.95, F.col("velocity") * 1.05),
        F.when(F.col("tokens") > 2000, 0.95).when(F.col("tokens") < 500, 1.02),
    ))
    mean = F.when(F.size(marks) > 0, F.aggregate(marks, F.lit(0.0), lambda a, x: a + x) / F.size(marks)).otherwise(1.0)
    return within(F.col("round_trip") * mean)


def file_result(gate: float = 0.9) -> dict[str, Column]:
    """Mean of the round trip's accuracy and the quality score, and which of both pass."""
    return {"validation_passed": F.col("round_trip") >= 0.95, "quality_passed": overall() >= gate, "overall_score": (F.col("round_trip") + overall()) / 2}


def first_valid(rows: DataFrame, order: tuple[str, ...] = ("REMI", "TSD", "Structured")) -> DataFrame:
    """By song the first strategy in order whose run was valid; null and false where none was."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    best = F.min_by(F.when(F.col("valid"), F.col("strategy")), F.when(F.col("valid"), rank))
    return rows.groupBy("song_id").agg(best.alias("strategy")).withColumn("valid", F.col("strategy").isNotNull())


def similar_history(songs: DataFrame, history: DataFrame, near: float = 0.2) -> DataFrame:
    """songs (song_id, complexity) against past runs (complexity, accuracy) less than near away: their number, mean accuracy and the factor on thresholds.

    Past runs are first summed by distinct complexity; both sides are dealt by cells of width near, so a song meets three cells.
    """
    cell = lambda c: F.floor(F.col(c) / near)
    past = history.groupBy(F.col("complexity").alias("past")).agg(F.count("*").alias("n"), F.sum("accuracy").alias("sum")).withColumn("cell", cell("past"))
    cells = songs.withColumn("cell", F.explode(F.array(cell("complexity") - 1, cell("complexity"), cell("complexity") + 1)))
    met = cells.join(past, "cell").where(F.abs(F.col("past") - F.col("complexity")) < near).groupBy("song_id").agg(F.sum("n").alias("runs"), (F.sum("sum") / F.sum("n")).alias("mean"))
    factor = F.when(F.col("mean") < 0.9, 1.9 - F.col("mean")).when(F.col("mean") > 0.98, 0.9).otherwise(1.0)
    return songs.select("song_id").join(met, "song_id", "left").select("song_id", F.coalesce("runs", F.lit(0)).alias("runs"), F.round("mean", 6).alias("mean"), F.round(F.coalesce(factor, F.lit(1.0)), 6).alias("factor"))


def error_type(message: Column) -> Column:
    m = F.lower(message)
    return F.when(F.contains(m, F.lit("memory")), "memory").when(F.contains(m, F.lit("token")), "tokenization").when(F.contains(m, F.lit("corrupt")), "corrupt").when(F.contains(m, F.lit("duration")), "duration").when(m.isNotNull(), "other")


def history_advice(results: DataFrame, by: str = "batch_id") -> DataFrame:
    """Settings to change by the number of errors of each kind: one row a piece of advice."""
    kind = error_type(F.col("error_message"))
    n = results.groupBy(by).agg(*(F.count_if(kind == k).alias(k) for k in ("memory", "tokenization", "duration", "corrupt")))
    rules = [("memory", 2, ("max_seq_length=1024", "chunk_size_seconds=20", "enable_chunking=true")), ("tokenization", 3, ("tokenization=REMI", "simplify_vocabulary=true")), ("duration", 1, ("max_duration_seconds=300", "auto_truncate=true")), ("corrupt", 5, ("strict_validation=false", "skip_corrupted=true"))]
    advice = F.explode(F.flatten(F.array(*(F.when(F.col(k) > most, F.array(*map(F.lit, what))).otherwise(F.array().cast("array<string>")) for k, most, what in rules))))
    return n.select(by, advice.alias("advice"))


def recommendations(results: DataFrame) -> DataFrame:
    """Advice on a corpus from its quality, its spread, the last batch's errors and the time a file takes: parameter, value, impact and confidence."""
    q = F.when(F.col("success"), F.col("overall_score"))
    whole = results.agg(F.avg(q).alias("q"), F.coalesce(F.stddev_samp(q), F.lit(0.0)).alias("s"), F.avg("seconds").alias("t"), F.max("batch_id").alias("last"))
    kind = error_type(F.col("error_message"))
    by_batch = results.groupBy("batch_id").agg(F.count_if(kind == "memory").alias("memory"), F.count_if(kind == "tokenization").alias("tokens"))
    facts = by_batch.join(F.broadcast(whole), F.col("batch_id") == F.col("last"))
    rows = [
        (F.col("q") < 0.9, "validation.quality_threshold", "0.85", "medium", 0.8), (F.col("s") > 0.2, "validation.enable_round_trip_test", "true", "high", 0.7), (F.col("memory") > 0, "processing.max_file_size_mb", "5", "high", 0.9),
        (F.col("memory") > 0, "tokenizer.max_seq_length", "1024", "high", 0.85), (F.col("tokens") > 2, "tokenization", "REMI", "high", 0.8), (F.col("t") > 30, "processing.parallel_processing", "true", "high", 0.9),
    ]
    items = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(p).alias("parameter"), F.lit(v).alias("value"), F.lit(i).alias("impact"), F.lit(x).alias("confidence"))) for c, p, v, i, x in rows)))
    return facts.select(F.explode(items).alias("r")).select("r.*")


def by_impact(advice: DataFrame, k: int = 10) -> DataFrame:
    """The k pieces of advice with the greatest impact times confidence."""
    weight = F.when(F.col("impact") == "high", 3).when(F.col("impact") == "medium", 2).otherwise(1) * F.col("confidence")
    return advice.withColumn("weight", F.round(weight, 6)).orderBy(F.desc("weight"), "parameter").limit(k)


def batch_results(results: DataFrame) -> DataFrame:
    """By batch: files, times and accuracies of those that are valid, and how often each error occurs (message:count, in order of messages)."""
    ok = F.col("success")
    stats = results.groupBy("batch_id").agg(
        F.count("*").alias("files"), F.count_if(ok).alias("valid"), F.round(F.avg(ok.cast("double")), 6).alias("success_rate"), F.sum(F.when(ok, F.col("seconds")).otherwise(0)).alias("seconds"),
        F.round(F.coalesce(F.avg(F.when(ok, F.col("overall_score"))), F.lit(0.0)), 6).alias("avg_accuracy"), F.round(F.min(F.when(ok, F.col("overall_score"))), 6).alias("min_accuracy"), F.round(F.max(F.when(ok, F.col("overall_score"))), 6).alias("max_accuracy"),
    )
    errors = results.where("error_message IS NOT NULL").groupBy("batch_id", "error_message").count()
    joined = errors.groupBy("batch_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "error_message", F.col("count").cast("string")))), ";").alias("errors"))
    return stats.join(joined, "batch_id", "left").withColumn("errors", F.coalesce("errors", F.lit("")))


def chunk_rollup(chunks: DataFrame, songs: DataFrame) -> DataFrame:
    """Songs from their chunks (song_id, accuracy, notes) and notes of the whole: invalid with over a fifth of chunks under 0.95; the shares that miss, empty chunks."""
    s = chunks.groupBy("song_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("accuracy") < 0.95).alias("failed"), F.sum("notes").alias("notes"), F.count_if(F.col("notes") == 0).alias("empty"))
    s = s.join(songs.select("song_id", F.col("notes").alias("whole")), "song_id")
    off = F.abs(F.col("notes") - F.col("whole")) / F.greatest(F.col("whole"), F.lit(1))
    return s.select("song_id", "chunks", "failed", "empty", (F.col("failed") <= F.col("chunks") * 0.2).alias("valid"), (off > 0.02).alias("incomplete"))


def campaign(batches: DataFrame) -> DataFrame:
    """One row over batches (files, seconds, memory_errors): hours, files a day (of one day at least) and three efficiencies."""
    f = batches.agg(F.sum("seconds").alias("seconds"), F.sum("files").alias("files"), F.sum("memory_errors").alias("memory"), F.avg(F.col("seconds") / F.col("files")).alias("mean"))
    hours = F.col("seconds") / 3600
    daily = F.when(hours > 0, F.col("files") / F.greatest(hours / 24, F.lit(1.0))).otherwise(0.0)
    return f.select(
        F.round(hours, 6).alias("hours"), F.round(daily, 6).alias("files_per_day"), F.round(F.least(F.lit(1.0), 10.0 / F.greatest("mean", F.lit(1.0))), 6).alias("cpu"),
        F.round(1 - F.col("memory") / F.greatest("files", F.lit(1)), 6).alias("memory"), F.round(F.least(F.lit(1.0), daily / 1000), 6).alias("throughput"),
    )


def file_report(results: DataFrame) -> DataFrame:
    """Every file with its number of errors beside the corpus's success rate (one row, broadcast)."""
    rate = results.agg(F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"))
    return results.select("file_id", "success", "overall_score", "seconds", F.when(F.col("error_message").isNotNull(), 1).otherwise(0).alias("errors")).join(F.broadcast(rate))


def generation_statistics(runs: DataFrame) -> DataFrame:
    return runs.groupBy("batch_id").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.round(F.avg("seconds"), 6).alias("avg_seconds"), F.sum("violations").alias("violations"))


def most_frequent(rows: DataFrame, items: str, k: int = 5) -> DataFrame:
    """The k values that occur most often in a column of arrays, over all rows; lower values first among equals."""
    return rows.select(F.explode(items).alias("item")).groupBy("item").count().orderBy(F.desc("count"), "item").limit(k)


def collected(*lists: Column, most: int = 3) -> Column:
    """Up to most of each list, in order, each value once."""
    return F.array_distinct(F.concat(*(F.slice(x, 1, most) for x in lists)))
