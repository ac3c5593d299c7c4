"""Small cases of rows that the derived tables hardly show: few tokens, limits and overrides, documents of their own files."""

from pyspark.sql import functions as F

from stavework.operators import scores, tokens
from stavework.sources import documents as d

COMPLEX = "song_id long, density double, polyphony double, rhythm double, harmony double, dynamics double, range double, overall double, level string"


def songs(spark):
    return spark.createDataFrame([(1, 2.0, 6.0, 0.8, 0.1, 50.0, 30.0, 0.95, "very_complex"), (2, 1.0, 1.0, 0.1, 0.0, 10.0, 12.0, 0.5, "moderate")], COMPLEX)


def test_rarest_tokens_need_more_than_k_kinds(spark):
    rows = [(1, i, i // 2) for i in range(12)] + [(1, 12, 9)] + [(2, i, i % 3) for i in range(9)]
    t = spark.createDataFrame(rows, "song_id long, pos long, token_id int")
    found = [tuple(r) for r in tokens.least_tokens(t, 3).select("song_id", "place", "token_id", "count").orderBy("place").collect()]
    assert found == [(1, 1, 9, 1), (1, 2, 0, 2), (1, 3, 1, 2)]
    assert tokens.least_tokens(t.where("false")).count() == 0
    grams = [tuple(r) for r in tokens.top_ngrams(t.where("song_id = 2"), 3, 2).select("t0", "t1", "t2", "count", "place").orderBy("place").collect()]
    assert grams == [(0, 1, 2, 3, 1), (1, 2, 0, 2, 2)]
    assert tokens.top_ngrams(t.where("pos < 2"), 3).count() == 0


def test_types_leave_out_unknown_ids(spark):
    t = spark.createDataFrame([(1, 0, 4), (1, 1, 20), (1, 2, 21), (1, 3, 9999)], "song_id long, pos long, token_id int")
    assert {(r["class"], r["count"], r.share) for r in tokens.type_distribution(t).collect()} == {("Bar", 1, 0.25), ("Pitch", 2, 0.5)}


def test_genres_and_overrides(spark):
    m = songs(spark)
    plain = {r.song_id: r for r in scores.adaptive_thresholds(m, F.lit("demo")).collect()}
    for genre in (F.lit("polka"), F.lit(None).cast("string")):
        assert {r.song_id: r for r in scores.adaptive_thresholds(m, F.lit("demo"), genre).collect()} == plain
    jazz = {r.song_id: r for r in scores.adaptive_thresholds(m, F.lit("demo"), F.lit("JAZZ")).collect()}
    # 2 ticks at the moderate level, over a strictness of 0.8: 2.5, cut to 2; 3 at the most complex one: 3.75
    assert (jazz[2].note_start_tick, jazz[1].note_start_tick) == (2, 3)
    assert jazz[2].timing_accuracy == round(0.98 * 0.85 * 0.8, 6) and jazz[2].pitch_accuracy == plain[2].pitch_accuracy
    own = scores.adaptive_thresholds(m, F.lit("demo"), custom={"velocity_bin": 0.2, "extra_notes_ratio": 0.9, "pitch_accuracy": 0.1, "nothing": 1}).where("song_id = 2").first()
    assert (own.velocity_bin, own.extra_notes_ratio, own.pitch_accuracy) == (1.0, 0.5, 0.5) and "nothing" not in own


def test_limits_on_processing(spark):
    m = songs(spark)
    free = scores.constrained_thresholds(m, 0.9).where("song_id = 2").first()
    tight = scores.constrained_thresholds(m, 0.9, F.lit(0.2), F.lit(50), F.lit(True)).where("song_id = 2").first()
    assert free.reasons == "" and tight.reasons == "fast processing,little memory,real time"
    assert (tight.note_start_tick, tight.note_duration) == (2 * free.note_start_tick, 2 * free.note_duration)
    assert abs(tight.overall_quality - free.overall_quality * 0.95 * 0.92) < 1e-12 and abs(tight.sequence_quality - free.sequence_quality * 0.88) < 1e-12
    assert abs(tight.statistical_similarity - free.statistical_similarity * 0.9) < 1e-12
    assert scores.constrained_thresholds(m, 0.9, F.lit(1.0), F.lit(None).cast("int"), F.lit(None).cast("boolean")).where("song_id = 2").first() == free


def test_a_file_each_with_vocabulary(spark, tmp_path):
    docs = d.with_vocabulary(spark.createDataFrame([("a.mid", [4, 20], None), ("b c.mid", None, 3)], "source_file string, global_tokens array<int>, sequence_length int"))
    runs = spark.createDataFrame([("a.mid", "2", 1.23456, False, 0.98765, ["w"]), ("a.mid", "1", 9.0, True, 1.0, [])], "source_file string, timestamp string, seconds double, passed boolean, quality double, warnings array<string>")
    docs = d.with_processing(docs, runs)
    for indent, compress in ((True, False), (False, True)):
        path = str(tmp_path / f"docs-{indent}")
        d.write_each_document(docs, path, indent, compress)
        files = list((tmp_path / f"docs-{indent}").glob("name=*/part-*"))
        assert len(files) == 2 and all((f.suffix == ".gz") == compress for f in files)
        if indent:
            lines = next(f for f in files if "a.mid" in str(f)).read_text().splitlines()
            keys = [x.split('"')[1] for x in lines if x.startswith('  "')]
            assert keys == sorted(keys)
        back = {r.source_file: r for r in d.read_documents(spark, path, multi_line=True).collect()}
        assert back["a.mid"].vocabulary["Pitch_60"] == 44 and back["a.mid"].vocabulary_size == len(back["b c.mid"].vocabulary) == 533
        p = back["a.mid"].processing
        assert (p.timestamp, p.processing_time_seconds, p.validation_passed, p.quality_score, p.warnings) == ("2", 1.235, False, 0.9877, ["w"])
        assert back["b c.mid"].processing is None and back["b c.mid"].global_tokens is None and back["a.mid"].global_tokens == [4, 20]


def test_small_documents_are_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "each")
    docs = spark.createDataFrame([("a:b.json", "x"), ("a:b.json", None), ("_c=100%+.json", "y"), (None, "z")] + [(f"{i}.json", "w") for i in range(60)], "name string, text string")
    before = {j for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None)}
    d.write_each(docs, path)
    d.write_each(docs, path)  # what is there is replaced
    jobs = [spark.sparkContext.statusTracker().getJobInfo(j) for j in set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before]
    assert max(spark.sparkContext.statusTracker().getStageInfo(s).numTasks for j in jobs for s in j.stageIds if spark.sparkContext.statusTracker().getStageInfo(s)) == 8
    assert {r.name: r.bytes for r in d.files(spark, path, "part-*").collect()} == {"a:b.json": 3, "_c=100%+.json": 2, d.NO_NAME: 2} | {f"{i}.json": 2 for i in range(60)}
