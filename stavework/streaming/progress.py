"""Running progress over file results as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def counted(results: DataFrame) -> DataFrame:
    """By batch: files done, of these completed, failed and skipped (any other status), and their seconds. Works on a batch or on a stream.

    results: batch_id, status, seconds. On a stream the state is one row a batch; no event time is involved, so there is no watermark.
    """
    done, bad = F.col("status") == "completed", F.col("status") == "failed"
    return results.groupBy("batch_id").agg(
        F.count("*").alias("done"), F.count_if(done).alias("successful"), F.count_if(bad).alias("failed"),
        F.count_if(~F.coalesce(done | bad, F.lit(False))).alias("skipped"), F.sum("seconds").cast("double").alias("seconds"),
    )


def progress(counts: DataFrame, totals: DataFrame, workers: int = 1) -> DataFrame:
    """Counts with the percentage done, success rate, mean seconds a file and seconds left at that pace, shared by workers.

    totals: batch_id, total (files expected). A batch that isn't in totals counts what it has as expected; one without
    results isn't reported. More results than expected leave no time.
    """
    joined = counts.join(totals.select("batch_id", "total"), "batch_id", "left").withColumn("total", F.coalesce("total", "done"))
    mean = F.col("seconds") / F.col("done")
    left = F.greatest(F.col("total") - F.col("done"), F.lit(0))
    return joined.select(
        "batch_id", "total", "done", "successful", "failed", "skipped", F.round(F.col("successful") / F.col("done"), 6).alias("success_rate"),
        F.round(F.when(F.col("total") > 0, 100 * F.col("done") / F.col("total")).otherwise(0.0), 6).alias("percent"),
        F.round(mean, 6).alias("avg_seconds"), F.round(F.col("seconds") / workers, 6).alias("elapsed"), F.round(mean * left / workers, 6).alias("remaining"),
    )


def follow(spark: SparkSession, incoming: str, schema: StructType, totals: DataFrame, target: str, checkpoint: str, files_at_once: int | None = None) -> DataFrame:
    """The progress of all batches after everything that has arrived in the folder `incoming` so far, as a stream that ends.

    Files are taken once each, files_at_once in a micro-batch (all at once if None); counts are kept in the state under `checkpoint`, so a
    later call with the same folders takes only what came since. Each micro-batch writes the rows that it changed to its own
    folder under `target`, whole and anew if it is repeated after a failure. The result is each batch's latest row.
    """
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)

    def report(changed: DataFrame, number: int) -> None:
        progress(changed, totals).write.mode("overwrite").parquet(f"{target}/micro={number}")

    report(counted(spark.createDataFrame([], schema)), -1)
    stream = counted(reader.parquet(incoming)).writeStream.outputMode("update").foreachBatch(report)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    reports = spark.read.parquet(target)
    columns = [c for c in reports.columns if c != "micro"]
    return reports.groupBy("batch_id").agg(F.max_by(F.struct(*columns), "micro").alias("r")).select("r.*")
