"""Validation of a whole corpus in one job: broken documents become error rows, all others go through the round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .roundtrip import round_trip_of

#: A document of one song as JSON.
DOCUMENT = (
    "song_id long, ppq int, ts_num int, ts_den int, "
    "tracks array<struct<track_idx: int, program: int, notes: array<struct<start_tick: long, end_tick: long, pitch: int, velocity: int>>>>"
)
REQUIRED = ("song_id", "ppq", "ts_num", "ts_den", "tracks")
#: Least overall score of each gate.
GATES = {"production": 0.95, "standard": 0.90, "permissive": 0.80}


def isolated(raw: DataFrame, text: str = "text") -> DataFrame:
    """raw's rows (path and JSON text) with the parsed document as doc, and kind and message of the first thing that is wrong with it (else null).

    Kinds in order: malformed (no JSON object), schema (fields missing or of another type), metadata (resolution or time signature not
    positive), empty (no notes), notes (a pitch or velocity out of range, or an end that isn't after its start). Nothing in a
    row can fail the job: texts are parsed permissively and no check divides or indexes.
    """
    doc = F.from_json(F.col(text), f"{DOCUMENT}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    d = F.col("doc")
    missing = F.array_compact(F.array(*(F.when(d[c].isNull(), F.lit(c)) for c in REQUIRED)))
    notes = F.flatten(F.transform(d["tracks"], lambda t: F.coalesce(t["notes"], F.array().cast("array<struct<start_tick:bigint,end_tick:bigint,pitch:int,velocity:int>>"))))

    def wrong(n: Column) -> Column:
        fits = n["pitch"].between(0, 127) & n["velocity"].between(0, 127) & (n["start_tick"] >= 0) & (n["end_tick"] > n["start_tick"])
        return ~F.coalesce(fits, F.lit(False))

    bad = F.size(F.filter(notes, wrong))
    checks = [
        ("malformed", d.isNull() | d["_broken"].isNotNull() & (F.size(missing) == len(REQUIRED)), F.lit("not a JSON object")),
        ("schema", d["_broken"].isNotNull() | (F.size(missing) > 0), F.concat(F.lit("missing or of another type: "), F.array_join(missing, ","))),
        ("metadata", (d["ppq"] <= 0) | (d["ts_num"] <= 0) | (d["ts_den"] <= 0), F.lit("resolution or time signature not positive")),
        ("empty", F.size(notes) == 0, F.lit("no notes")),
        ("notes", bad > 0, F.concat(bad.cast("string"), F.lit(" notes out of range"))),
    ]
    kind, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, holds, says in reversed(checks):
        kind, message = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(kind), F.when(F.coalesce(holds, F.lit(False)), says).otherwise(message)
    return raw.withColumn("doc", doc).select("path", "doc", kind.alias("kind"), message.alias("message"))


def validated(raw: DataFrame, gate: str = "standard", strategy: str = "REMI", observation: Observation | None = None) -> DataFrame:
    """One row a document: path, status (passed, failed or error), kind and message of an error, and the round trip's notes, overall score, errors and warnings.

    A document passes if it reaches the gate. Documents of one path or song number are told apart by both; a repeated pair is one
    song too many and counts as an error of kind repeated. observation: counts of documents and errors, gathered in the same job.
    """
    docs = isolated(raw)
    number = F.when(F.col("kind").isNull(), F.col("doc.song_id"))
    # a song number stands once among good documents; those without one are dealt by path
    many = F.count("song_id").over(Window.partitionBy("song_id", F.when(F.col("song_id").isNull(), F.col("path"))))
    slim = docs.select("path", number.alias("song_id"), "kind", "message").withColumn("again", many > 1)
    kind, message = F.when(F.col("again"), "repeated").otherwise(F.col("kind")), F.when(F.col("again"), "song number of several documents").otherwise(F.col("message"))
    counted = slim.select("path", F.when(~F.col("again"), F.col("song_id")).alias("song_id"), kind.alias("kind"), message.alias("message"))
    if observation is not None:
        counted = counted.observe(observation, F.count(F.lit(1)).alias("documents"), F.count_if(F.col("kind").isNotNull()).alias("errors"))
    good = docs.where("kind IS NULL").select("doc.song_id", "doc.ts_num", "doc.ts_den", "doc.tracks")
    good = good.withColumn("many", F.count("*").over(Window.partitionBy("song_id"))).where("many = 1")
    notes = good.select("song_id", "ts_num", "ts_den", F.explode("tracks").alias("t")).select("song_id", "t.program", "ts_num", "ts_den", F.explode("t.notes").alias("n"))
    metrics = round_trip_of(notes.select("song_id", "program", "ts_num", "ts_den", "n.*", F.lit(True).alias("compared")), strategy)
    metrics = metrics.select(F.col("song_id").alias("_id"), F.col("original").alias("notes"), "overall", "errors", "warnings")
    joined = counted.join(metrics, F.col("song_id") == F.col("_id"), "left")
    status = F.when(F.col("kind").isNotNull(), "error").when(F.col("overall") >= GATES[gate], "passed").otherwise("failed")
    return joined.select("path", "song_id", status.alias("status"), "kind", "message", "notes", "overall", "errors", "warnings")


def summary(results: DataFrame) -> DataFrame:
    """By status and kind of error: documents, and mean overall score of those that have one."""
    return results.groupBy("status", F.coalesce("kind", F.lit("")).alias("kind")).agg(F.count("*").alias("documents"), F.avg("overall").alias("overall"))


#: What a metric above or below a bound suggests: the parameter, its new value (the current one times, plus, at most), priority and gain.
RULES = [
    ("missing notes", "missing_ratio", 0.02, None, "beat_resolution", 2.0, 0.0, 8.0, "high", 0.15),
    ("timing", "timing", None, 0.95, "beat_resolution", 1.0, 1.0, 8.0, "medium", 0.10),
    ("velocity", "velocity", None, 0.90, "num_velocities", 2.0, 0.0, 32.0, "medium", 0.12),
    ("quality", "overall", None, 0.85, "quality_threshold", 0.0, 0.80, 1.0, "low", 0.05),
    ("fidelity", "musical", None, 0.85, "chord_and_tempo_tokens", 0.0, 1.0, 1.0, "high", 0.15),
    ("complexity", "notes", 5000.0, None, "max_seq_length", 0.0, 4096.0, 4096.0, "medium", 0.10),
    ("complexity", "polyphony", 4.0, None, "max_seq_length", 0.0, 4096.0, 4096.0, "medium", 0.10),
    ("drums", "drum_polyphony", 3.0, None, "beat_resolution", 1.0, 2.0, 8.0, "medium", 0.12),
]
#: Parameters before any suggestion.
CONFIGURATION = {"beat_resolution": 4.0, "num_velocities": 16.0, "quality_threshold": 0.85, "chord_and_tempo_tokens": 0.0, "max_seq_length": 2048.0}


def suggestions(metrics: DataFrame, configuration: dict[str, float] | None = None, rules: list[tuple] = RULES) -> DataFrame:
    """Suggested settings by song: rule, parameter, current and suggested value, priority (1 high, 2 medium, 3 low) and expected gain.

    metrics: song_id and one column a metric (those that no rule names, and null ones, suggest nothing). They are brought into long form and meet
    the rules, a table of a few rows, on the metric's name and the bounds; a rule met on two metrics suggests once.
    """
    spark = metrics.sparkSession
    table = spark.createDataFrame(rules, "rule string, metric string, above double, below double, parameter string, times double, plus double, most double, level string, gain double")
    current = spark.createDataFrame(list({**CONFIGURATION, **(configuration or {})}.items()), "parameter string, current double")
    named = [c for c in metrics.columns if c in {r[1] for r in rules}]
    values = metrics.select("song_id", F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in named))).alias("m")).select("song_id", "m.*")
    met = values.join(F.broadcast(table.join(current, "parameter")), "metric").where((F.col("above").isNull() | (F.col("value") > F.col("above"))) & (F.col("below").isNull() | (F.col("value") < F.col("below"))))
    priority = F.when(F.col("level") == "high", 1).when(F.col("level") == "medium", 2).otherwise(3)
    return met.select("song_id", "rule", "parameter", "current", F.least("most", F.col("current") * F.col("times") + F.col("plus")).alias("suggested"), priority.alias("priority"), "gain").distinct()
