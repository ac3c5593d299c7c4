"""Queries that write files to the shared folder and read them back, with SQL for what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports
from ..sources import documents as d
from ..streaming.progress import follow
from ..views import view, with_views
from .catalog import add
from .registry import register


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share: spark.checkpoint.dir, else (on one machine only) the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/stavework-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.assembled(*(view(spark, sf_dir, n) for n in ("songs", "tracks", "tempo_changes", "notes", "tokens")))


def flat(docs: DataFrame) -> DataFrame:
    ids = F.md5(F.concat_ws(",", F.transform("global_tokens", lambda x: x.cast("string"))))
    return docs.select("source_file", "metadata.key_signature", "metadata.note_count", "metadata.track_count", F.size("metadata.tempo_changes").alias("tempos"), F.array_join("tracks.program", ",").alias("programs"), "sequence_length", ids.alias("hash"))


FLAT = """, t AS (SELECT song_id, count(*) AS c, string_agg(program, ',' ORDER BY track_idx) AS p FROM tracks GROUP BY 1), m AS (SELECT song_id, count(*) AS c FROM tempo_changes GROUP BY 1), n AS (SELECT song_id, count(*) AS c FROM notes GROUP BY 1), k AS (SELECT song_id, count(*) AS c, md5(string_agg(token_id, ',' ORDER BY pos)) AS h FROM tokens GROUP BY 1)
SELECT concat(s.song_id, '.mid') AS source_file, key_signature, n.c AS note_count, CAST(t.c AS INT) AS track_count, CAST(m.c AS INT) AS tempos, p AS programs, CAST(k.c AS INT) AS sequence_length, h AS hash FROM songs s JOIN t ON t.song_id = s.song_id JOIN m ON m.song_id = s.song_id JOIN n ON n.song_id = s.song_id JOIN k ON k.song_id = s.song_id"""


def written(spark: SparkSession, sf_dir: str, compress: bool = True) -> str:
    path = scratch(spark)
    d.write_documents(documents(spark, sf_dir), path, compress)
    return path


NEEDS = "songs tracks tempo_changes notes tokens"
register("SCA26", lambda spark, sf: flat(documents(spark, sf)), with_views(NEEDS, FLAT))
register("SNK01", lambda spark, sf: flat(d.read_documents(spark, written(spark, sf))), with_views(NEEDS, FLAT))
register("SRC01", lambda spark, sf: flat(d.read_documents(spark, written(spark, sf, False))), with_views(NEEDS, FLAT))
register("FIL01", lambda spark, sf: d.schema_issues(documents(spark, sf)).select("source_file", F.array_join("issues", ",").alias("issues"), "valid"), with_views("songs", "SELECT concat(song_id, '.mid') AS source_file, CASE WHEN key_signature IS NULL THEN 'missing metadata.key_signature' ELSE '' END AS issues, key_signature IS NOT NULL AS valid FROM songs"))


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with vocabulary and processing; every fourth song has no processing."""
    runs = view(spark, sf_dir, "songs").where("song_id % 4 <> 0").select(
        F.concat("song_id", F.lit(".mid")).alias("source_file"), F.lit("2024-05-01T10:00:00").alias("timestamp"), (F.col("song_id") / 7).alias("seconds"), F.col("key_signature").isNotNull().alias("passed"),
        (F.col("song_id") % 11 / 11).alias("quality"), F.when(F.col("key_signature").isNull(), F.array(F.lit("no key"))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
    return d.with_processing(d.with_vocabulary(documents(spark, sf_dir)), runs)


def reread(spark: SparkSession, sf_dir: str, indent: bool) -> DataFrame:
    """The documents as they come back from a file each, with their vocabularies' size and sum of ids."""
    path = scratch(spark)
    d.write_each_document(explained(spark, sf_dir), path, indent=indent, compress=not indent)
    back = d.read_documents(spark, path, multi_line=True)
    ids = F.aggregate(F.map_values("vocabulary"), F.lit(0), lambda s, x: s + x)
    extra = back.select("source_file", "vocabulary_size", F.size("vocabulary").alias("entries"), ids.alias("id_sum"), F.element_at("vocabulary", "Pitch_60").alias("middle_c"), F.col("processing.timestamp").alias("made"), "processing.processing_time_seconds", "processing.validation_passed", "processing.quality_score", F.array_join("processing.warnings", ",").alias("warnings"))
    return flat(back).join(extra, "source_file")


RUN = "CASE WHEN s.song_id % 4 <> 0 THEN {} END AS {}"
EXPLAINED = FLAT.replace("SELECT concat(s.song_id", f"""SELECT 533 AS vocabulary_size, 533 AS entries, 141778 AS id_sum, 44 AS middle_c, {RUN.format("'2024-05-01T10:00:00'", 'made')}, {RUN.format('round(s.song_id / 7.0::DOUBLE, 3)', 'processing_time_seconds')},
 {RUN.format('key_signature IS NOT NULL', 'validation_passed')}, {RUN.format('round(s.song_id % 11 / 11.0::DOUBLE, 4)', 'quality_score')}, {RUN.format("CASE WHEN key_signature IS NULL THEN 'no key' END", 'warnings')}, concat(s.song_id""")
register("SNK01_each", lambda spark, sf: reread(spark, sf, False), with_views(NEEDS, EXPLAINED))
register("SRC01_each", lambda spark, sf: reread(spark, sf, True), with_views(NEEDS, EXPLAINED))


def each(spark: SparkSession, sf_dir: str) -> str:
    """Every song's title in a file of its own."""
    path = scratch(spark)
    d.write_each(view(spark, sf_dir, "songs").select(F.concat(F.lit("song-"), "song_id", F.lit(".json")).alias("name"), F.expr(CONTENT).alias("text")), path)
    return path


CONTENT = """'{"song_id":' || song_id || ',"title":"' || title || '"}'"""
FILES = f"(SELECT concat('song-', song_id, '.json') AS name, {CONTENT} || chr(10) AS content FROM songs) f"
register("SRC02", lambda spark, sf: d.files(spark, each(spark, sf), "part-*").select("name", "bytes"), with_views("songs", f"SELECT name, strlen(content) AS bytes FROM {FILES}"))
register("SRC03", lambda spark, sf: d.file_facts(spark, each(spark, sf), "part-*", 36e-6).drop("path"), with_views("songs", f"SELECT name, strlen(content) / 1048576 AS mb, md5(content) AS md5, CASE WHEN strlen(content) / 1048576 > 36e-6 THEN 'chunk' ELSE 'whole' END AS verdict FROM {FILES}"))
add("SRC05", "files", lambda f: d.corpus_listing(f, F.col("name"), F.length("name") * 1000), "SELECT count_if(song_id % 3 = 0) AS originals, count_if(song_id % 3 <> 0) AS copies, round(sum(length(name) * 1000) / 1048576.0, 6)::DOUBLE AS mb, count_if(song_id % 3 = 0) * 12 AS potential FROM files")
add("SNK05", "files", lambda f: d.without_augmented(f).select("song_id", "name"), "SELECT song_id, name FROM files WHERE name NOT LIKE '%-transpose%'")
add("SNK04", "files", lambda f: d.not_yet_written(f.select("song_id", F.explode(F.array(F.lit(-1), F.lit(1), F.lit(2))).alias("offset")), f.where("song_id % 3 = 1").select("song_id", F.lit(2).alias("offset")), ["song_id", "offset"]), 'SELECT song_id, o AS "offset" FROM files, (SELECT unnest([-1, 1, 2]) AS o) x WHERE NOT (song_id % 3 = 1 AND o = 2)')


def manifest(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark)
    splits = view(spark, sf_dir, "files").select("name", F.when(F.col("song_id") % 10 == 0, "test").when(F.col("song_id") % 10 == 1, "val").otherwise("train").alias("split"))
    d.write_manifest(splits, path)
    return path


SPLITS = with_views("files", "SELECT CASE song_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, name FROM files")
register("SRC04", lambda spark, sf: d.read_manifest(spark, manifest(spark, sf)), SPLITS)
register("SNK02", lambda spark, sf: spark.read.schema("value string, split string").text(f"{manifest(spark, sf)}/lists").select("split", F.col("value").alias("name")), SPLITS)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written as CSV and as markdown, and both read back."""
    report, path = reports.batch_statistics(view(spark, sf_dir, "results")).select("batch_id", "files", "successful"), scratch(spark)
    d.export_report(report, f"{path}/csv", "csv")
    d.export_report(report, f"{path}/markdown", "markdown")
    rows = spark.read.schema("batch_id int, files long, successful long").option("header", True).csv(f"{path}/csv")
    lines = spark.read.text(f"{path}/markdown").select(F.col("value").alias("line"))
    return rows.select(F.concat_ws(" | ", *(F.col(c).cast("string") for c in rows.columns)).alias("line")).withColumn("line", F.concat(F.lit("| "), "line", F.lit(" |"))).join(lines, "line")


register("SNK03", exported, with_views("results", "SELECT concat('| ', batch_id, ' | ', count(*), ' | ', count_if(success), ' |') AS line FROM results GROUP BY batch_id"))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    line = F.to_json(F.struct("song_id", "name"))
    view(spark, sf_dir, "files").select(F.when(F.col("song_id") % 4 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    good, bad = d.read_or_quarantine(spark, path, "song_id long, name string")
    return good.select(F.lit("row").alias("kind"), "name").unionByName(bad.select(F.col("error_type").alias("kind"), F.regexp_extract("message", '"name":"(.*)', 1).alias("name")))


register("SNK06", quarantined, with_views("files", "SELECT CASE WHEN song_id % 4 = 0 THEN 'processing_error' ELSE 'row' END AS kind, CASE WHEN song_id % 4 = 0 THEN substr(name, 1, length(name) - 1) ELSE name END AS name FROM files"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    d.write_sequences(view(spark, sf_dir, "tokens"), path)
    s = d.read_sequences(spark, path)
    return s.select("song_id", "sequence_length", F.md5(F.concat_ws(",", F.transform("token_ids", lambda x: x.cast("string")))).alias("ids"), F.size(F.filter("token_names", lambda x: x.startswith("Pitch_"))).alias("pitches"))


register("SNK07", sequences, with_views("tokens", "SELECT song_id, CAST(count(*) AS INT) AS sequence_length, md5(string_agg(token_id, ',' ORDER BY pos)) AS ids, CAST(count_if(token_id BETWEEN 5 AND 92) AS INT) AS pitches FROM tokens GROUP BY 1"))


#: A result's status, and how many files a batch expects: some never arrive.
STATUS = "CASE WHEN file_id % 11 = 0 THEN 'skipped' WHEN success THEN 'completed' ELSE 'failed' END"
TOTAL = "count(*) + batch_id % 3"


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results arrive as files in a folder and are taken by a stream, two files a micro-batch."""
    results = view(spark, sf_dir, "results").select("batch_id", F.expr(STATUS).alias("status"), "seconds")
    base = scratch(spark)
    results.repartition(4).write.parquet(f"{base}/incoming")
    totals = results.groupBy("batch_id").agg(F.count("*").alias("n")).select("batch_id", (F.col("n") + F.col("batch_id") % 3).alias("total"))
    return follow(spark, f"{base}/incoming", results.schema, totals, f"{base}/reports", f"{base}/state", 2)


register("STR01", followed, with_views("results", f""", c AS (
  SELECT batch_id, {TOTAL} AS total, count(*) AS done, count_if(status = 'completed') AS successful, count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped, sum(seconds)::DOUBLE AS seconds
  FROM (SELECT *, {STATUS} AS status FROM results) r GROUP BY batch_id)
SELECT batch_id, total, done, successful, failed, skipped, round(successful / done, 6) AS success_rate, round(100 * done / total, 6) AS percent, round(seconds / done, 6) AS avg_seconds, seconds AS elapsed, round(seconds / done * (total - done), 6) AS remaining FROM c"""))
