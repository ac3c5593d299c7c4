"""Files of a corpus: token documents, split manifests, reports, token sequences, and facts about files. Read and written by Spark; files of one document each are written by its tasks through Arrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote

from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import tokens as T
from ..operators.training import originals

#: Copies that augmentation makes of a song, the song included, and the size in MB above which a file is cut up.
FACTOR, LARGE_MB = 12, 10.0
#: The folder of documents without a name, as Spark calls it.
NO_NAME = "__HIVE_DEFAULT_PARTITION__"
#: Schema of a token document. Schemas are given, never inferred.
DOCUMENT = """version string, source_file string, tokenization string, metadata struct<ppq: int, key_signature: string, note_count: bigint, track_count: int, tempo_changes: array<struct<tick: bigint, bpm: double>>>,
tracks array<struct<index: int, name: string, program: int, is_drum: boolean>>, global_tokens array<int>, sequence_length int, vocabulary map<string, int>, vocabulary_size int,
processing struct<timestamp: string, processing_time_seconds: double, validation_passed: boolean, quality_score: double, warnings: array<string>>"""
MANIFEST = "train array<string>, val array<string>, test array<string>"
#: Fields that a document must have, and those of its metadata.
REQUIRED, REQUIRED_METADATA = ("version", "source_file", "tokenization", "metadata", "global_tokens"), ("ppq", "key_signature", "note_count", "track_count")


def assembled(songs: DataFrame, tracks: DataFrame, tempo_changes: DataFrame, notes: DataFrame, tokens: DataFrame, tokenization: str = "REMI") -> DataFrame:
    """One document a song: nested metadata, tracks in order and tokens in order. Children are gathered by song before they are joined."""
    order = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    t = tracks.groupBy("song_id").agg(order(F.col("track_idx").alias("index"), "name", "program", "is_drum").alias("tracks"))
    m = tempo_changes.groupBy("song_id").agg(order("tick", F.col("bpm").cast("double").alias("bpm")).alias("tempo_changes"))
    n = notes.groupBy("song_id").agg(F.count("*").alias("note_count"))
    k = tokens.groupBy("song_id").agg(F.transform(order("pos", "token_id"), lambda x: x["token_id"]).alias("global_tokens"))
    d = songs.join(t, "song_id", "left").join(m, "song_id", "left").join(n, "song_id", "left").join(k, "song_id", "left")
    metadata = F.struct("ppq", "key_signature", F.coalesce("note_count", F.lit(0)).alias("note_count"), F.size(F.coalesce("tracks", F.array())).alias("track_count"), "tempo_changes")
    return d.select(F.lit("1.0").alias("version"), F.concat(F.col("song_id").cast("string"), F.lit(".mid")).alias("source_file"), F.lit(tokenization).alias("tokenization"), metadata.alias("metadata"), "tracks", "global_tokens", F.size(F.coalesce("global_tokens", F.array())).alias("sequence_length"))


def with_vocabulary(docs: DataFrame) -> DataFrame:
    """Documents with the vocabulary, names to ids, and its size. It is the same in all, and each carries it, so that a file explains itself."""
    names, ids, _ = zip(*T.entries(), strict=True)
    return docs.withColumns({"vocabulary": F.map_from_arrays(F.lit(list(names)), F.lit(list(ids))), "vocabulary_size": F.lit(len(ids))})


def with_processing(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents with how they were made; null where runs has none.

    runs: source_file, timestamp, seconds, passed, quality, warnings; of several for a file the last by timestamp is taken. Seconds are
    rounded to three places, quality to four; without warnings the field is null.
    """
    run = F.struct(
        F.col("timestamp").cast("string").alias("timestamp"), F.round(F.col("seconds").cast("double"), 3).alias("processing_time_seconds"), F.col("passed").alias("validation_passed"),
        F.round(F.col("quality").cast("double"), 4).alias("quality_score"), F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"),
    )
    last = runs.select("source_file", run.alias("processing")).groupBy("source_file").agg(F.max("processing").alias("processing"))
    return docs.join(last, "source_file", "left")


def write_each_document(docs: DataFrame, path: str, indent: bool = False, compress: bool = True) -> None:
    """One JSON file a document, in a folder of its source file's name, its fields in the order of their names; indented or on one line."""
    text = F.to_json(F.struct(*sorted(docs.columns)), {"pretty": str(indent).lower(), "ignoreNullFields": "false"})
    write_each(docs.select(F.col("source_file").alias("name"), text.alias("text")), path, compress=compress)


def write_documents(docs: DataFrame, path: str, compress: bool = True) -> None:
    """Documents as JSON, one a line; gzip unless compress is off. What is there is replaced."""
    docs.write.mode("overwrite").option("compression", "gzip" if compress else "none").option("ignoreNullFields", "false").json(path)


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Documents of a folder, plain or gzip; multi_line for one indented document a file."""
    return spark.read.schema(DOCUMENT).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def read_or_quarantine(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and error records (error_type, message, file) for lines that can't be read. A bad line fails nothing."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.withColumn("row", F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    return rows.where(~broken).select("row.*").drop("_corrupt_record"), rows.where(broken).select(F.lit("processing_error").alias("error_type"), F.col("value").alias("message"), "file")


def schema_issues(docs: DataFrame) -> DataFrame:
    """Issues of each document: required fields and metadata that are missing, tracks without a program; valid without any."""
    rules = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in REQUIRED] + [F.when(F.col("metadata").isNotNull() & F.col(f"metadata.{c}").isNull(), F.lit(f"missing metadata.{c}")) for c in REQUIRED_METADATA]
    rules.append(F.when(F.exists(F.coalesce("tracks", F.array()), lambda t: t["program"].isNull()), F.lit("track without program")))
    return docs.select("source_file", F.array_compact(F.array(*rules)).alias("issues")).withColumn("valid", F.size("issues") == 0)


def write_each(docs: DataFrame, path: str, name: str = "name", text: str = "text", compress: bool = False) -> None:
    """One text file a document, in a folder of its name (name=..., odd characters as %XX): its content is the text and a newline. What is there is replaced.

    Documents are dealt by name over a fixed number of tasks (few bytes would otherwise land in one), so a task writes whole files, and
    each appears under its name when it is complete; repeated names share a file, one line each.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(name).alias("name"), F.col(text).alias("value")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "name").sortWithinPartitions("name")
    fs, base = FileSystem.from_uri(path)
    fs.create_dir(base)
    fs.delete_dir_contents(base)
    own = f"part-00000-{uuid.uuid4().hex}.txt{'.gz' if compress else ''}"

    def write(part: Iterator[Row]) -> None:
        fs, base = FileSystem.from_uri(path)
        for key, lines in groupby(part, lambda r: r["name"]):
            folder = f"{base}/name={quote(key, safe=' ') if key else NO_NAME}"
            fs.create_dir(folder)
            unfinished = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(unfinished, compression="gzip" if compress else None) as out:
                for r in lines:
                    out.write(f"{'' if r['value'] is None else r['value']}\n".encode())
            fs.move(unfinished, f"{folder}/{own}")

    rows.foreachPartition(write)


def _named(found: DataFrame) -> DataFrame:
    """name: that of the folder that write_each made, else the file's own."""
    folder = F.regexp_extract("path", "/name=([^/]*)/[^/]*$", 1)
    return found.withColumn("name", F.when(folder != "", F.url_decode(folder)).otherwise(F.element_at(F.split("path", "/"), -1)))


def files(spark: SparkSession, path: str, pattern: str = "*.json*", recursive: bool = True) -> DataFrame:
    """Files below a folder whose own names fit a pattern: path, size and name. Contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return _named(found).select("path", F.col("length").alias("bytes"), "name")


def file_facts(spark: SparkSession, path: str, pattern: str = "*", large_mb: float = LARGE_MB) -> DataFrame:
    """Size in MB, MD5 of the bytes and what to do with each file."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    mb = F.col("length") / (1024 * 1024)
    return _named(found).select("path", "name", mb.alias("mb"), F.md5("content").alias("md5"), F.when(mb > large_mb, "chunk").otherwise("whole").alias("verdict"))


def corpus_listing(listing: DataFrame, name: Column, size: Column) -> DataFrame:
    """Originals, augmented copies, MB in all, and how many files the originals can become."""
    copy = F.contains(name, F.lit("-transpose"))
    return listing.agg(F.count_if(~copy).alias("originals"), F.count_if(copy).alias("copies"), F.round(F.sum(size) / (1024 * 1024), 6).alias("mb"), (F.count_if(~copy) * FACTOR).alias("potential"))


def write_manifest(splits: DataFrame, path: str, name: str = "name", single: bool = False) -> None:
    """The manifest (JSON rows of split and name) and one list a split (split=.../). With single, also one JSON row of three sorted
    lists, as small corpora are exchanged: it holds every name in one task, about 50 bytes each, so up to some ten million."""
    rows = splits.select("split", F.col(name).alias("name"))
    rows.write.mode("overwrite").json(f"{path}/manifest")
    splits.select(name, "split").write.mode("overwrite").partitionBy("split").text(f"{path}/lists")
    if single:
        lists = {s: F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("name")))).alias(s) for s in ("train", "val", "test")}
        rows.agg(*lists.values()).write.mode("overwrite").json(f"{path}/single")


def read_manifest(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """split and name of every file of a manifest, from its rows or from its single one."""
    if not single:
        return spark.read.schema("split string, name string").json(f"{path}/manifest")
    m = spark.read.schema(MANIFEST).json(f"{path}/single")
    return m.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, ("train", "val", "test"))), F.array("train", "val", "test"))).alias("split", "names")).select("split", F.explode("names").alias("name"))


def markdown(report: DataFrame) -> DataFrame:
    """A report's rows as lines of a markdown table, heading first; place orders them. Reports are few rows."""
    cells = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    rows = report.select(F.lit(2).alias("place"), cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]).alias("line"))
    head = report.sparkSession.range(2).select(F.col("id").cast("int").alias("place"), F.when(F.col("id") == 0, cells([F.lit(c) for c in report.columns])).otherwise(cells([F.lit("---") for _ in report.columns])).alias("line"))
    return head.unionByName(rows)


def export_report(report: DataFrame, path: str, kind: str = "json") -> None:
    if kind == "markdown":
        markdown(report).orderBy("place", "line").select("line").coalesce(1).write.mode("overwrite").text(path)
    else:
        report.write.mode("overwrite").option("header", True).format(kind).save(path)


def not_yet_written(planned: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Planned outputs whose keys are not there yet."""
    return planned.join(existing.select(*keys).distinct(), keys, "left_anti")


def without_augmented(corpus: DataFrame, name: str = "name") -> DataFrame:
    return originals(corpus, name)


def write_sequences(tokens: DataFrame, path: str) -> None:
    """Token sequences with the names beside the ids; a song without tokens has no row and so no sequence. Names come by a broadcast of the vocabulary, which is fixed in size."""
    both = F.sort_array(F.collect_list(F.struct("pos", "token_id", "name")))
    rows = T.named(tokens).groupBy("song_id").agg(both.alias("t"))
    rows.select("song_id", F.col("t.token_id").alias("token_ids"), F.col("t.name").alias("token_names"), F.size("t").alias("sequence_length")).write.mode("overwrite").json(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("song_id long, token_ids array<int>, token_names array<string>, sequence_length int").json(path)
