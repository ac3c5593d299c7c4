"""Queries on the round trip, with their SQL; greedy matching is serial, so its SQL is a recursion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import roundtrip as rt
from ..views import view
from .catalog import add, recursive
from .registry import register

#: Notes of both sides with their numbers, and the serial rule as one recursion a note, for all tracks together. A step carries the partners taken
#: so far. Where one of the note's pitch is free anywhere, only those count.
MATCHED = """,
ours AS (SELECT *, row_number() OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, pitch, end_tick, velocity)::INT AS note FROM {a}),
theirs AS (SELECT *, row_number() OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, pitch, end_tick, velocity)::INT AS partner FROM {b}),
near AS (
  SELECT o.song_id, o.track_idx, o.note, t.partner, t.pitch = o.pitch AS same, abs(t.start_tick - o.start_tick) <= 480 AS inside, {{
    'score': abs(t.start_tick - o.start_tick)::DOUBLE + 10.0::DOUBLE * abs(t.pitch - o.pitch) + 0.1::DOUBLE * abs(t.velocity - o.velocity) + 0.5::DOUBLE * abs((t.end_tick - t.start_tick) - (o.end_tick - o.start_tick)),
    'try': CASE t.pitch - o.pitch WHEN -1 THEN 1 WHEN 1 THEN 2 WHEN -2 THEN 3 WHEN 2 THEN 4 ELSE 0 END, 'place': t.partner}} AS worth
  FROM ours o JOIN theirs t ON t.song_id = o.song_id AND t.track_idx = o.track_idx AND t.pitch BETWEEN o.pitch - 2 AND o.pitch + 2),
steps AS (
  SELECT song_id, track_idx, 0 AS note, []::INT[] AS taken, NULL::INT AS partner FROM (SELECT DISTINCT song_id, track_idx FROM ours) t
  UNION ALL
  SELECT song_id, track_idx, note, CASE WHEN found IS NULL THEN taken ELSE list_append(taken, found) END, found FROM (
    SELECT s.song_id, s.track_idx, o.note, any_value(s.taken) AS taken,
      CASE WHEN bool_or(same) FILTER (NOT list_contains(s.taken, n.partner)) THEN arg_min(n.partner, worth) FILTER (same AND inside AND NOT list_contains(s.taken, n.partner))
        ELSE arg_min(n.partner, worth) FILTER (NOT same AND inside AND NOT list_contains(s.taken, n.partner)) END AS found
    FROM steps s JOIN ours o ON o.song_id = s.song_id AND o.track_idx = s.track_idx AND o.note = s.note + 1
    LEFT JOIN near n ON n.song_id = o.song_id AND n.track_idx = o.track_idx AND n.note = o.note GROUP BY s.song_id, s.track_idx, o.note) f),
pairs AS (SELECT song_id, track_idx, note, partner FROM steps WHERE partner IS NOT NULL),
matched AS (
  SELECT coalesce(o.song_id, t.song_id) AS song_id, coalesce(o.track_idx, t.track_idx) AS track_idx, o.note, t.partner, CASE WHEN t.partner IS NULL THEN 'missing' WHEN o.note IS NULL THEN 'extra' ELSE 'pair' END AS kind,
    abs(t.start_tick - o.start_tick) AS start_diff, abs((t.end_tick - t.start_tick) - (o.end_tick - o.start_tick)) AS length_diff, abs(t.velocity - o.velocity) AS velocity_diff, abs(t.pitch - o.pitch) AS pitch_diff
  FROM (SELECT o.*, p.partner FROM ours o LEFT JOIN pairs p ON p.song_id = o.song_id AND p.track_idx = o.track_idx AND p.note = o.note) o
  FULL JOIN theirs t ON t.song_id = o.song_id AND t.track_idx = o.track_idx AND t.partner = o.partner)"""
ERRORS = """,
errors AS (
  SELECT song_id, track_idx, count_if(kind <> 'extra') AS original, count_if(kind <> 'missing') AS reconstructed, count_if(kind = 'missing') AS missing, count_if(kind = 'extra') AS extra, count_if(start_diff > 1) AS timing_errors,
    count_if(velocity_diff > 1) AS velocity_errors, count_if(kind = 'pair' AND pitch_diff = 0) / greatest(count_if(kind <> 'extra'), count_if(kind <> 'missing'), 1) AS accuracy FROM matched GROUP BY 1, 2)"""
METRICS = f"""{ERRORS},
sums AS (
  SELECT song_id, sum(original)::BIGINT AS original, sum(reconstructed)::BIGINT AS reconstructed, sum(missing)::BIGINT AS missing, sum(extra)::BIGINT AS extra, sum(timing_errors)::BIGINT AS timing_errors, sum(velocity_errors)::BIGINT AS velocity_errors,
    count(*) AS tracks, count_if(accuracy < 0.9)::BIGINT AS poor, count_if(accuracy < 0.5)::BIGINT AS failed, count_if(original > 0 AND reconstructed = 0)::BIGINT AS gone FROM errors GROUP BY 1),
metrics AS (
  SELECT *, (CASE WHEN original > 0 THEN missing / original ELSE 0 END)::DOUBLE AS missing_ratio, (CASE WHEN original > 0 THEN extra / original ELSE 0 END)::DOUBLE AS extra_ratio,
    (CASE WHEN original > 0 THEN 1 - timing_errors / original ELSE 0 END)::DOUBLE AS timing, (CASE WHEN original > 0 THEN 1 - velocity_errors / original ELSE 0 END)::DOUBLE AS velocity,
    (CASE WHEN original > 0 THEN 1 - (missing + extra + timing_errors + velocity_errors) / (4 * original) ELSE 0 END)::DOUBLE AS overall FROM sums)"""
VERDICT = f"""{METRICS},
verdicts AS (
  SELECT song_id,
    concat_ws(',', CASE WHEN missing_ratio > 0.01 THEN 'missing notes' END, CASE WHEN extra_ratio > 0.01 THEN 'extra notes' END, CASE WHEN timing < 0.93 THEN 'timing' END, CASE WHEN velocity < 0.9 THEN 'velocity' END, CASE WHEN overall < 0.95 THEN 'quality' END,
      CASE WHEN failed > 0 THEN 'failed tracks' END, CASE WHEN gone > 0 THEN 'missing tracks' END) AS errors,
    concat_ws(',', CASE WHEN missing_ratio > 0.005 THEN 'missing notes' END, CASE WHEN extra_ratio > 0.005 THEN 'extra notes' END, CASE WHEN timing >= 0.93 AND timing < 0.95 THEN 'timing' END, CASE WHEN velocity < 0.95 THEN 'velocity' END,
      CASE WHEN overall < 0.97 THEN 'quality' END, CASE WHEN poor > tracks * 0.2 THEN 'poor tracks' END) AS warnings FROM metrics)"""


def add_matched(name: str, build: Callable[[DataFrame], DataFrame], body: str) -> None:
    """A query on the matching of the notes with the reconstructed ones, and its SQL after the recursion's tables."""
    register(name, lambda spark, sf_dir: build(rt.matches(view(spark, sf_dir, "notes"), view(spark, sf_dir, "recon"))), recursive("notes recon", MATCHED.format(a="notes", b="recon") + body))


add_matched("JOI01", lambda m: m, " SELECT * FROM matched")
add_matched("JOI02", lambda m: m.where("pitch_diff > 0"), " SELECT * FROM matched WHERE pitch_diff > 0")
add_matched("JOI03", lambda m: m.where("kind = 'pair'").select("song_id", "track_idx", "note", "partner", F.round(rt.match_score(), 6).alias("score")),
    " SELECT song_id, track_idx, note, partner, round(start_diff + 10 * pitch_diff + 0.1 * velocity_diff + 0.5 * length_diff, 6)::DOUBLE AS score FROM matched WHERE kind = 'pair'")
add_matched("JOI04", lambda m: m.where("kind <> 'pair'"), " SELECT * FROM matched WHERE kind <> 'pair'")
add_matched("AGG08", rt.track_errors, f"{ERRORS} SELECT * FROM errors")
add_matched("AGG09", lambda m: rt.song_metrics(rt.track_errors(m)), f"{METRICS} SELECT * FROM metrics")
add_matched("AGG10", rt.difference_statistics, " SELECT song_id, " + ", ".join(f"round(avg({c}_diff), 6) AS mean_{c}, max({c}_diff) AS max_{c}" for c in ("start", "length", "velocity")) + " FROM matched WHERE kind = 'pair' GROUP BY 1")
EXACT = "start_diff <= 1 AND velocity_diff <= 1 AND length_diff <= 2"
add_matched("AGG11", rt.match_summary, f""" SELECT song_id, count_if(pitch_diff = 0 AND {EXACT}) AS exact, count_if(pitch_diff = 0 AND NOT ({EXACT})) AS pitch_only, count_if(kind = 'missing') AS missing, count_if(kind = 'extra') AS extra,
  count_if(start_diff > 1) AS timing_issues, count_if(velocity_diff > 1) AS velocity_issues FROM matched GROUP BY 1""")  # fmt: skip
add_matched("AGG12", lambda m: rt.comparison_summary(rt.track_errors(m)), f"{ERRORS} SELECT song_id, count(*) AS tracks, count_if(accuracy = 1) AS perfect, round(avg(accuracy), 6) AS accuracy, count_if(missing > 0) AS with_missing, count_if(extra > 0) AS with_extra FROM errors GROUP BY 1")
add_matched("QUA01", lambda m: rt.tolerance_verdict(rt.song_metrics(rt.track_errors(m))), f"{VERDICT} SELECT *, errors = '' AS valid FROM verdicts")
COUNTS = lambda n: n.groupBy("song_id", "track_idx").agg(F.count("*").alias("notes"))
add("JOI05", "tracks notes recon", lambda t, a, b: rt.track_pairs(t.join(COUNTS(a), rt.TRACK), t.join(COUNTS(b), rt.TRACK).withColumn("track_idx", (6 - F.col("track_idx")).cast("int"))),
    """, x AS (SELECT song_id, track_idx, count(*) AS n FROM notes GROUP BY 1, 2), y AS (SELECT song_id, track_idx, count(*) AS n FROM recon GROUP BY 1, 2)
SELECT x.song_id, x.track_idx, CAST(6 - y.track_idx AS INT) AS partner, round(10 + CASE WHEN x.track_idx <> 4 THEN 5 ELSE 0 END + CASE WHEN x.track_idx = 3 THEN 0 ELSE 3 END + 2.0 * least(x.n, y.n) / greatest(x.n, y.n), 6)::DOUBLE AS score FROM x JOIN y ON x.song_id = y.song_id AND x.track_idx = y.track_idx""")  # fmt: skip
NOTES = """, n AS (SELECT n.song_id, program, CAST(floor(start_tick / (ts_num * 1920.0 / ts_den)) AS BIGINT) AS bar, start_tick, end_tick, pitch, velocity, ts_num * 1920.0 / ts_den AS tpb FROM notes n JOIN tracks t ON t.song_id = n.song_id AND t.track_idx = n.track_idx JOIN songs s ON s.song_id = n.song_id WHERE pitch BETWEEN 21 AND 108),
q AS (SELECT song_id, program, bar, tpb, CAST(least(round_even((start_tick - bar * tpb) / 40.0, 0), tpb / 40 - 1) AS INT) AS st, pitch, CAST(floor((velocity - 1) * 16 / 127.0) AS INT) AS v, CAST(greatest(1, least(48, round_even((end_tick - start_tick) / 40.0, 0))) AS INT) AS d FROM n)"""
add("DAT09", "notes tracks songs", lambda n, t, s: rt.encoded(n, t, s), NOTES + """, k AS (SELECT *, row_number() OVER (PARTITION BY song_id, bar, st ORDER BY program, pitch, v, d) AS k FROM q),
e AS (SELECT song_id, bar, st, k, 0 AS j, concat('Position_', st) AS token FROM k WHERE k = 1 UNION ALL SELECT song_id, bar, st, k, 1, concat('Program_', program) FROM k UNION ALL SELECT song_id, bar, st, k, 2, concat('Pitch_', pitch) FROM k UNION ALL SELECT song_id, bar, st, k, 3, concat('Velocity_', v) FROM k
UNION ALL SELECT song_id, bar, st, k, 4, concat('Duration_', d) FROM k UNION ALL SELECT song_id, unnest(range(0, max(bar) + 1)), -1, 0, 0, 'Bar_None' FROM k GROUP BY song_id)
SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar, st, k, j) AS INT) AS pos, token FROM e""")  # fmt: skip
add("DAT10", "notes tracks songs", lambda n, t, s: rt.decoded(rt.encoded(n, t, s), s), NOTES + " SELECT song_id, program, CAST(bar * tpb + st * 40 AS BIGINT) AS start_tick, CAST(bar * tpb + st * 40 + d * 40 AS BIGINT) AS end_tick, pitch, CAST(floor((v + 0.5) * 127 / 16 + 1) AS INT) AS velocity FROM q")
SIDES = """, back AS (SELECT song_id, program AS track_idx, CAST(bar * tpb + st * 40 AS BIGINT) AS start_tick, CAST(bar * tpb + st * 40 + d * 40 AS BIGINT) AS end_tick, pitch, CAST(floor((v + 0.5) * 127 / 16 + 1) AS INT) AS velocity FROM q),
sides AS (SELECT n.song_id, program AS track_idx, start_tick, end_tick, pitch, velocity FROM notes n JOIN tracks t ON t.song_id = n.song_id AND t.track_idx = n.track_idx)"""
register("DAT12", lambda spark, sf_dir: rt.round_trip(*(view(spark, sf_dir, n) for n in ("notes", "tracks", "songs"))),
    recursive("notes tracks songs", NOTES + SIDES + MATCHED.format(a="sides", b="back") + f"{VERDICT} SELECT m.*, errors, warnings, errors = '' AS valid FROM metrics m JOIN verdicts v ON v.song_id = m.song_id"))
