"""A corpus with broken documents: they become error rows and leave all others as they are. Settings: each rule is met alone."""

import json

import pytest
from pyspark.sql import Observation

from stavework.operators import corpus


def document(song, **changes):
    notes = [{"start_tick": 40 * i, "end_tick": 40 * i + 40, "pitch": 60 + i % 5, "velocity": 64} for i in range(30)]
    return {"song_id": song, "ppq": 480, "ts_num": 4, "ts_den": 4, "tracks": [{"track_idx": 0, "program": 1, "notes": notes}], **changes}


def note(**changes):
    return [{"track_idx": 0, "program": 1, "notes": [{"start_tick": 0, "end_tick": 40, "pitch": 60, "velocity": 64, **changes}]}]


BROKEN = {
    "a": ('{"song_id": 1, "ppq"', "malformed"), "b": ("[]", "schema"), "c": (None, "malformed"), "d": ("", "malformed"), "e": ("plain words", "malformed"), "f": (json.dumps(document(2, ppq=None)), "schema"),
    "g": (json.dumps(document(3, ppq="many")), "schema"), "h": (json.dumps(document(4, ts_den=0)), "metadata"), "i": (json.dumps(document(5, tracks=[])), "empty"),
    "j": (json.dumps(document(6, tracks=note(pitch=200))), "notes"), "k": (json.dumps(document(7, tracks=note(end_tick=0))), "notes"), "l": (json.dumps(document(8, tracks=note(velocity=None))), "notes"), "m": (json.dumps(document(9, tracks=[{"track_idx": 0}])), "empty"),
}


def test_broken_documents_leave_the_others_as_they_are(spark):
    good = [(f"good-{s}", json.dumps(document(s))) for s in range(20, 24)]
    clean = {r.path: r for r in corpus.validated(spark.createDataFrame(good, "path string, text string")).collect()}
    assert all(r.status == "failed" or r.status == "passed" for r in clean.values()) and {r.notes for r in clean.values()} == {30}
    seen = Observation()
    both = corpus.validated(spark.createDataFrame(good + [(p, t) for p, (t, _) in BROKEN.items()], "path string, text string"), observation=seen)
    got = {r.path: r for r in both.collect()}
    assert {p: got[p] for p in clean} == clean
    assert {p: (got[p].status, got[p].kind) for p in BROKEN if p != "b"} == {p: ("error", k) for p, (_, k) in BROKEN.items() if p != "b"}
    assert got["b"].status == "error" and all(got[p].overall is None and got[p].message for p in BROKEN)
    assert seen.get == {"documents": len(got), "errors": len(BROKEN)}
    counts = {(r.status, r.kind): r.documents for r in corpus.summary(both).collect()}
    assert counts["error", "notes"] == 3 and sum(counts.values()) == len(got)


def test_a_song_twice_is_an_error_of_both(spark):
    rows = [("x", json.dumps(document(1))), ("y", json.dumps(document(1))), ("z", json.dumps(document(2)))]
    got = {r.path: r.kind for r in corpus.validated(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"x": "repeated", "y": "repeated", "z": None}
    assert corpus.validated(spark.createDataFrame([], "path string, text string")).count() == 0


CALM = {"missing_ratio": 0.0, "timing": 1.0, "velocity": 1.0, "overall": 1.0, "musical": 1.0, "notes": 10.0, "polyphony": 1.0, "drum_polyphony": 0.0}
HITS = [
    ("missing_ratio", 0.03, ("missing notes", "beat_resolution", 8.0)), ("timing", 0.94, ("timing", "beat_resolution", 5.0)), ("velocity", 0.5, ("velocity", "num_velocities", 32.0)), ("overall", 0.8, ("quality", "quality_threshold", 0.8)),
    ("musical", 0.1, ("fidelity", "chord_and_tempo_tokens", 1.0)), ("notes", 5001, ("complexity", "max_seq_length", 4096.0)), ("polyphony", 4.5, ("complexity", "max_seq_length", 4096.0)), ("drum_polyphony", 3.5, ("drums", "beat_resolution", 6.0)),
]


@pytest.mark.parametrize(("metric", "value", "expected"), HITS)
def test_each_rule(spark, metric, value, expected):
    schema = "song_id long, " + ", ".join(f"{c} double" for c in CALM)
    rows = [(1, *CALM.values()), (2, *({**CALM, metric: float(value)}).values()), (3, *[None] * len(CALM))]
    got = [(r.song_id, r.rule, r.parameter, r.suggested) for r in corpus.suggestions(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(2, *expected)]


def test_a_rule_met_twice_and_other_settings(spark):
    schema = "song_id long, " + ", ".join(f"{c} double" for c in CALM)
    rows = [(1, *({**CALM, "notes": 6000.0, "polyphony": 9.0, "timing": 0.5}).values())]
    got = {(r.rule, r.suggested) for r in corpus.suggestions(spark.createDataFrame(rows, schema), {"beat_resolution": 8.0}).collect()}
    assert got == {("complexity", 4096.0), ("timing", 8.0)}


def test_documents_are_read_twice_and_compared_once(spark):
    plan = corpus.validated(spark.createDataFrame([("x", json.dumps(document(1)))], "path string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("LogicalRDD") == 2
