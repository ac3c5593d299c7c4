"""Every registered query of the library with its SQL for another engine. Names are the IDs of the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import compare, notes, reports, songs, tokens, tracks
from ..views import view, with_views
from .registry import register

#: SQL fragments that several queries share.
SWEEP = """lv AS (SELECT song_id, track_idx, level, ticks FROM (SELECT song_id, track_idx, sum(d) OVER (PARTITION BY song_id, track_idx ORDER BY t) AS level,
  lead(t) OVER (PARTITION BY song_id, track_idx ORDER BY t) - t AS ticks FROM (SELECT song_id, track_idx, t, sum(d) AS d FROM (
  SELECT song_id, track_idx, start_tick AS t, 1 AS d FROM notes UNION ALL SELECT song_id, track_idx, end_tick, -1 FROM notes) e GROUP BY 1, 2, 3) g) s WHERE level > 0 AND ticks > 0),
poly AS (SELECT song_id, track_idx, level, sum(ticks) AS ticks FROM lv GROUP BY 1, 2, 3)"""
COVER = """isl AS (SELECT song_id, track_idx, start_tick, end_tick, sum(nw) OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, end_tick ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start_tick <= max(end_tick) OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, end_tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM notes) m),
cov AS (SELECT song_id, track_idx, sum(k) AS covered FROM (SELECT song_id, track_idx, island, max(end_tick) - min(start_tick) AS k FROM isl GROUP BY 1, 2, 3) i GROUP BY 1, 2)"""
STATS = f"""{SWEEP}, {COVER}, base AS (SELECT song_id, track_idx, count(*) AS total_notes, count(DISTINCT pitch) AS unique_pitches, min(pitch) AS min_pitch, max(pitch) AS max_pitch, avg(pitch) AS avg_pitch,
  avg(velocity) AS avg_velocity, avg(len) / 480.0 AS avg_duration, sum(len) / 480.0 AS total_duration, (max(end_tick) - min(start_tick)) / 480.0 AS track_length, coalesce(stddev_pop(gap), 0) / 480.0 AS note_onset_variance
  FROM (SELECT *, end_tick - start_tick AS len, start_tick - lag(start_tick) OVER (PARTITION BY song_id, track_idx ORDER BY start_tick) AS gap FROM notes) x GROUP BY 1, 2),
pl AS (SELECT song_id, track_idx, max(level) AS max_polyphony, sum(level * ticks) * 1.0 / sum(ticks) AS avg_polyphony, sum(CASE WHEN level > 1 THEN ticks ELSE 0 END) * 1.0 / sum(ticks) AS polyphony_ratio FROM poly GROUP BY 1, 2),
st AS (SELECT base.*, max_polyphony, avg_polyphony, polyphony_ratio, CASE WHEN track_length > 0 THEN total_notes / track_length ELSE 0 END AS density,
  CASE WHEN track_length > 0 THEN 1 - covered / 480.0 / track_length ELSE 0 END AS empty_ratio FROM base JOIN pl USING (song_id, track_idx) JOIN cov USING (song_id, track_idx))"""
POINTS = """sc AS (SELECT *, round(CASE WHEN avg_polyphony <= 2 THEN 0.3 ELSE 0 END + CASE WHEN max_pitch - min_pitch BETWEEN 12 AND 24 THEN 0.2 ELSE 0 END + CASE WHEN avg_pitch > 60 THEN 0.2 ELSE 0 END
  + CASE WHEN density BETWEEN 1 AND 8 THEN 0.15 ELSE 0 END + CASE WHEN empty_ratio BETWEEN 0.2 AND 0.6 THEN 0.15 ELSE 0 END, 6) AS m,
  round(CASE WHEN avg_pitch < 48 THEN 0.4 ELSE 0 END + CASE WHEN avg_polyphony < 1.5 THEN 0.2 ELSE 0 END + CASE WHEN note_onset_variance < 0.5 THEN 0.2 ELSE 0 END + CASE WHEN density < 6 THEN 0.2 ELSE 0 END, 6) AS b,
  round(CASE WHEN avg_polyphony >= 3 THEN 0.4 WHEN max_polyphony >= 3 THEN 0.2 ELSE 0 END + CASE WHEN max_pitch - min_pitch > 24 THEN 0.2 ELSE 0 END + CASE WHEN avg_duration > 1 THEN 0.2 ELSE 0 END
  + CASE WHEN empty_ratio < 0.3 THEN 0.2 ELSE 0 END, 6) AS c FROM st),
ty AS (SELECT *, CASE WHEN greatest(m, b, c) < 0.3 THEN 'unknown' WHEN m = greatest(m, b, c) THEN 'melody' WHEN b = greatest(m, b, c) THEN 'bass' ELSE 'chord' END AS stat_type,
  CASE WHEN greatest(m, b, c) < 0.3 THEN 0.3 ELSE least(0.9, greatest(m, b, c)) END AS stat_confidence FROM sc)"""
SECTIONS = """sec AS (SELECT *, coalesce(last_value(CASE token_id WHEN 531 THEN 'C' WHEN 532 THEN 'M' END IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'M') AS section FROM tokens)"""
CLASS = """CASE WHEN token_id BETWEEN 5 AND 92 THEN 'Pitch' WHEN token_id BETWEEN 93 AND 108 THEN 'Velocity' WHEN token_id BETWEEN 109 AND 156 THEN 'Duration' WHEN token_id BETWEEN 157 AND 252 THEN 'Position'
  WHEN token_id = 4 THEN 'Bar' WHEN token_id = 531 THEN 'ChordStart' WHEN token_id = 532 THEN 'MelodyStart' ELSE 'Other' END"""
NOTE_COLUMNS = ["song_id", "track_idx", "start_tick", "end_tick", "pitch", "velocity"]
NC = ", ".join(NOTE_COLUMNS)


def drum() -> Column:
    """The drum track of the derived tables."""
    return F.col("track_idx") == 4


def add(name: str, needs: str, build: Callable[..., DataFrame], body: str | None) -> None:
    """Registers build(views...) under name, and body with the views before it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(view(spark, sf_dir, n) for n in needs.split()))

    register(name, run, with_views(needs, body) if body else None)


def recursive(needs: str, body: str) -> str:
    """SQL as of add, where tables of body may refer to themselves."""
    return with_views(needs, body).replace("WITH", "WITH RECURSIVE", 1)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if not columns or c in columns))


def flagged(n: DataFrame) -> DataFrame:
    return n.select(*NOTE_COLUMNS)


# notes
add("FIL02", "notes", lambda n: notes.valid_notes(flagged(n)), f"SELECT {NC} FROM notes WHERE pitch BETWEEN 0 AND 127 AND velocity BETWEEN 0 AND 127 AND end_tick > start_tick")
add("FIL04", "notes", lambda n: notes.drop_fragments(flagged(n), drum()), f"SELECT {NC} FROM notes WHERE track_idx = 4 OR (end_tick - start_tick >= 30 AND start_tick >= 0)")
add("FIL05", "tracks notes", lambda t, n: notes.non_empty_tracks(t.unionByName(t.withColumn("track_idx", (F.col("track_idx") + 7).cast("int"))), n), "SELECT * FROM tracks")
add("FIL06", "tracks notes", lambda t, n: notes.without_bass(t, n), "SELECT t.* FROM tracks t LEFT JOIN (SELECT song_id, track_idx, avg(CASE WHEN pitch < 36 THEN 1.0 ELSE 0 END) AS low FROM notes GROUP BY 1, 2) l USING (song_id, track_idx) WHERE NOT regexp_matches(lower(name), 'bass|bajo|basso|contrabajo|tololoche|upright') AND coalesce(low, 0) <= 0.35 AND NOT is_drum")
TRIM = "tr AS (SELECT song_id, track_idx, start_tick, pitch, velocity, CASE WHEN track_idx <> 4 AND nx < end_tick THEN greatest(least(end_tick, nx), start_tick + 30) ELSE end_tick END AS end_tick FROM (SELECT *, lead(start_tick) OVER (PARTITION BY song_id, track_idx, pitch ORDER BY start_tick, end_tick, velocity) AS nx FROM {src}) x)"
add("WIN01", "notes", lambda n: notes.trim_overlaps(flagged(n), drum()), f", {TRIM.format(src='notes')} SELECT {NC} FROM tr")
QUANT = "CASE WHEN track_idx = 4 THEN start_tick ELSE CAST(round_even(start_tick / 120.0, 0) * 120 AS BIGINT) END AS start_tick, CASE WHEN track_idx = 4 THEN end_tick ELSE greatest(CAST(round_even(end_tick / 120.0, 0) * 120 AS BIGINT), CAST(round_even(start_tick / 120.0, 0) * 120 AS BIGINT) + 30) END AS end_tick"
add("SCA01", "notes", lambda n: notes.quantized(flagged(n), drum()), f"SELECT song_id, track_idx, pitch, velocity, {QUANT} FROM notes")
STATS_SQL = "SELECT song_id, count(CASE WHEN track_idx <> 4 THEN 1 END) AS note_count, count(DISTINCT CASE WHEN track_idx = 4 THEN track_idx END) AS drum_tracks, count(DISTINCT CASE WHEN track_idx <> 4 THEN track_idx END) AS melodic_tracks, max(end_tick) AS duration_ticks, round(count(CASE WHEN track_idx <> 4 THEN 1 END) / (max(end_tick) / 480.0), 6) AS notes_per_beat, min(CASE WHEN track_idx <> 4 THEN pitch END) AS min_pitch, max(CASE WHEN track_idx <> 4 THEN pitch END) AS max_pitch, max(CASE WHEN track_idx <> 4 THEN pitch END) - min(CASE WHEN track_idx <> 4 THEN pitch END) AS pitch_span, count(CASE WHEN track_idx <> 4 AND end_tick - start_tick < 33 THEN 1 END) AS short_notes FROM {src} GROUP BY 1"
add("AGG02", "notes", lambda n: rounded(notes.preprocessing_stats(n, drum())), STATS_SQL.format(src="notes"))
add("AGG03", "notes", lambda n: notes.stats_delta(notes.preprocessing_stats(n, drum()), notes.preprocessing_stats(notes.drop_fragments(n, drum()), drum())), f", b AS ({STATS_SQL.format(src='notes')}), f AS (SELECT * FROM notes WHERE track_idx = 4 OR end_tick - start_tick >= 30), a AS ({STATS_SQL.format(src='f')}) SELECT b.song_id, b.note_count - coalesce(a.note_count, 0) AS notes_removed, b.melodic_tracks - coalesce(a.melodic_tracks, 0) AS tracks_removed FROM b LEFT JOIN a USING (song_id)")
add("DAT11", "notes tracks", lambda n, t: notes.preprocessed(flagged(n), t, 16, True).drop("is_drum"), f", v AS (SELECT * FROM notes WHERE end_tick > start_tick AND (track_idx = 4 OR end_tick - start_tick >= 30)), {TRIM.format(src='v')} SELECT song_id, track_idx, pitch, velocity, {QUANT} FROM tr WHERE track_idx NOT IN (2, 4) AND (song_id, track_idx) NOT IN (SELECT (song_id, track_idx) FROM v GROUP BY song_id, track_idx HAVING avg(CASE WHEN pitch < 36 THEN 1.0 ELSE 0 END) > 0.35)")
add("FIL13", "songs", lambda s: s.select("song_id", F.when((F.col("bpm") * 3 <= 0) | (F.col("bpm") * 3 >= 360), 120).otherwise(F.col("bpm") * 3).alias("bpm")), "SELECT song_id, CASE WHEN bpm * 3 <= 0 OR bpm * 3 >= 360 THEN 120 ELSE bpm * 3 END AS bpm FROM songs")
add("AGG04", "notes", lambda n: rounded(notes.track_statistics(n)), f", {STATS} SELECT song_id, track_idx, total_notes, unique_pitches, min_pitch, max_pitch, round(avg_pitch, 6) AS avg_pitch, round(avg_velocity, 6) AS avg_velocity, round(avg_duration, 6) AS avg_duration, round(total_duration, 6) AS total_duration, round(density, 6) AS density, round(note_onset_variance, 6) AS note_onset_variance, max_polyphony, round(avg_polyphony, 6) AS avg_polyphony, round(polyphony_ratio, 6) AS polyphony_ratio, round(empty_ratio, 6) AS empty_ratio FROM st")
add("AGG05", "notes", notes.polyphony, f", {SWEEP} SELECT * FROM poly")
add("AGG06", "notes", notes.covered_time, f", {COVER} SELECT * FROM cov")
add("AGG07", "notes", notes.max_polyphony, "SELECT song_id, track_idx, max(level) AS max_polyphony FROM (SELECT song_id, track_idx, sum(d) OVER (PARTITION BY song_id, track_idx ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS level FROM (SELECT song_id, track_idx, start_tick AS t, 1 AS d FROM notes UNION ALL SELECT song_id, track_idx, end_tick, -1 FROM notes) e) x GROUP BY 1, 2")
add("JOI09", "notes", compare.sampled_polyphony, "SELECT song_id, track_idx, round(sum(ceil(end_tick / 100.0) - ceil(start_tick / 100.0)) / ceil(max(end_tick) / 100.0), 6) AS polyphony FROM notes GROUP BY 1, 2")

# tracks
BY_NAME = "CASE track_idx WHEN 0 THEN 'melody' WHEN 1 THEN 'chord' WHEN 2 THEN 'bass' WHEN 4 THEN 'drums' WHEN 5 THEN 'chord' END"
add("SCA09", "tracks", lambda t: t.select("song_id", "track_idx", tracks.by_name(F.col("name")).alias("x")).select("song_id", "track_idx", "x.type", F.round("x.confidence", 6).alias("confidence"), F.array_join("x.hints", ",").alias("hints")),
    f"SELECT song_id, track_idx, {BY_NAME} AS type, CASE WHEN track_idx IN (0, 1, 2, 4) THEN 1.0 WHEN track_idx = 5 THEN 1.0 ELSE 0.0 END AS confidence, CASE track_idx WHEN 0 THEN 'melodia,principal,melodia' WHEN 1 THEN 'chord,chords,pad' WHEN 2 THEN 'bajo' WHEN 4 THEN 'drum,kit' WHEN 5 THEN 'harmony,harmon' ELSE '' END AS hints FROM tracks WHERE track_idx NOT IN (2)\n  UNION ALL SELECT song_id, track_idx, 'bass', 0.8, 'bajo' FROM tracks WHERE track_idx = 2")
add("SCA10", "notes", lambda n: tracks.by_statistics(notes.track_statistics(n)).select("song_id", "track_idx", "stat_type", "stat_confidence"), f", {STATS}, {POINTS} SELECT song_id, track_idx, stat_type, CAST(stat_confidence AS DOUBLE) AS stat_confidence FROM ty")
CLASSIFIED = f"""{STATS}, {POINTS}, cl AS (SELECT t.song_id, t.track_idx, t.program, t.is_drum, total_notes, unique_pitches, min_pitch, max_pitch, avg_pitch, avg_duration, empty_ratio,
  CASE WHEN t.is_drum THEN 'drums' WHEN {BY_NAME.replace('track_idx', 't.track_idx')} IS NOT NULL THEN {BY_NAME.replace('track_idx', 't.track_idx')} WHEN stat_confidence > 0.6 THEN stat_type ELSE 'unknown' END AS type,
  CASE WHEN t.is_drum THEN 1.0 WHEN t.track_idx = 2 THEN 0.8 WHEN {BY_NAME.replace('track_idx', 't.track_idx')} IS NOT NULL THEN 1.0 WHEN stat_confidence > 0.6 THEN stat_confidence ELSE 0.3 END AS confidence
  FROM tracks t JOIN ty ON t.song_id = ty.song_id AND t.track_idx = ty.track_idx)"""
whole = lambda t, n: tracks.classified(t, notes.track_statistics(n))
add("SCA11", "tracks notes", lambda t, n: whole(t, n).select("song_id", "track_idx", "type", F.round("confidence", 6).alias("confidence")), f", {CLASSIFIED} SELECT song_id, track_idx, type, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM cl")
add("FIL07", "tracks notes", lambda t, n: tracks.kept(whole(t, n)).select("song_id", "track_idx", "type"), f", {CLASSIFIED} SELECT song_id, track_idx, type FROM cl WHERE is_drum OR type = 'drums' OR (total_notes >= 10 AND empty_ratio <= 0.8 AND unique_pitches >= 3)")
add("FIL16", "tracks notes", lambda t, n: whole(t, n).where(F.col("type").isin("melody", "chord")).select("song_id", "track_idx", "type"), f", {CLASSIFIED} SELECT song_id, track_idx, type FROM cl WHERE type IN ('melody', 'chord')")
add("SET01", "tracks notes", lambda t, n: tracks.without_duplicates(whole(t, n)).select("song_id", "track_idx"), f", {CLASSIFIED} SELECT song_id, min(track_idx) AS track_idx FROM cl GROUP BY song_id, program, total_notes, min_pitch, max_pitch, round_even(avg_pitch, 0), round_even(avg_duration, 1)")
add("TOP02", "tracks notes", lambda t, n: tracks.in_priority_order(whole(t, n)).select("song_id", "track_idx", "type", "place"), f", {CLASSIFIED} SELECT song_id, track_idx, type, CAST(row_number() OVER (PARTITION BY song_id ORDER BY CASE type WHEN 'melody' THEN 1 WHEN 'chord' THEN 2 WHEN 'bass' THEN 3 WHEN 'drums' THEN 4 ELSE 5 END, track_idx) AS INT) AS place FROM cl")
add("TOP03", "tracks notes", lambda t, n: tracks.best_of_type(whole(t, n)).select("song_id", "type", "track_idx"), f", {CLASSIFIED} SELECT song_id, type, track_idx FROM (SELECT *, row_number() OVER (PARTITION BY song_id, type ORDER BY round(CAST(confidence AS DOUBLE), 6) DESC, track_idx) AS k FROM cl) x WHERE k = 1")
add("AGG32", "tracks notes", lambda t, n: tracks.type_counts(whole(t, n)), f", {CLASSIFIED} SELECT song_id, " + ", ".join(f"count(CASE WHEN type = '{t}' THEN 1 END) AS {t}" for t in tracks.PRIORITY) + " FROM cl GROUP BY 1")
add("FIL17", "tracks", lambda t: t.groupBy("song_id").agg((F.count_if(~F.col("is_drum")) == 1).alias("single")), "SELECT song_id, count(CASE WHEN NOT is_drum THEN 1 END) = 1 AS single FROM tracks GROUP BY 1")

# songs
add("AGG01", "songs tracks notes", songs.metadata, "SELECT song_id, ppq, key_signature, track_count, programs, coalesce(note_count, 0) AS note_count, coalesce(duration_ticks, 0) AS duration_ticks FROM songs LEFT JOIN (SELECT song_id, count(*) AS track_count, array_to_string(list_sort(list(DISTINCT program) FILTER (NOT is_drum)), ',') AS programs FROM tracks GROUP BY 1) t USING (song_id) LEFT JOIN (SELECT song_id, count(*) AS note_count, max(end_tick) AS duration_ticks FROM notes GROUP BY 1) n USING (song_id)")
KEYS = ", ".join(f"coalesce(sum(CASE WHEN pitch % 12 = {i} THEN end_tick - start_tick END), 0)" for i in range(12))
add("AGG24", "songs notes tracks", songs.detected_keys, f""", h AS (SELECT song_id, [{KEYS}] AS h FROM notes WHERE track_idx <> 4 GROUP BY 1), r AS (SELECT song_id, h, list_position(h, list_max(h)) - 1 AS root FROM h),
k AS (SELECT song_id, CASE WHEN h[(root + 3) % 12 + 1] > h[(root + 4) % 12 + 1] * 1.2 THEN {songs.MINOR!r}[root + 1] ELSE {songs.MAJOR!r}[root + 1] END AS found, CASE WHEN h[(root + 3) % 12 + 1] > h[(root + 4) % 12 + 1] * 1.2 THEN 0.6 ELSE 0.7 END AS sure FROM r)
SELECT song_id, coalesce(key_signature, found, 'C') AS key, CAST(CASE WHEN key_signature IS NOT NULL THEN 0.9 ELSE coalesce(sure, 0.2) END AS DOUBLE) AS confidence FROM songs LEFT JOIN k USING (song_id)""")  # fmt: skip
add("AGG25", "songs tempo_changes notes", songs.average_tempo, "SELECT song_id, round(coalesce(mean, 120.0), 1) AS avg_tempo FROM songs LEFT JOIN (SELECT song_id, CASE WHEN count(*) = 1 THEN CAST(min(bpm) AS DOUBLE) ELSE sum(bpm * k) * 1.0 / sum(k) END AS mean FROM (SELECT song_id, bpm, greatest(coalesce(lead(tick) OVER (PARTITION BY song_id ORDER BY tick), last) - tick, 0) AS k FROM tempo_changes JOIN (SELECT song_id, max(end_tick) AS last FROM notes GROUP BY 1) e USING (song_id)) s GROUP BY 1) m USING (song_id)")
add("JOI12", "notes tempo_changes", songs.tempo_at_notes, f"SELECT {NC}, coalesce((SELECT max_by(bpm, tick) FROM tempo_changes c WHERE c.song_id = n.song_id AND c.tick <= n.start_tick), 120) AS tempo FROM notes n")
add("FIL03", "songs notes", songs.verdicts, "SELECT song_id, n > 0 AND last > 0 AND bad <= n * 0.1 AS is_valid, concat_ws(',', CASE WHEN n = 0 THEN 'no notes' END, CASE WHEN last = 0 THEN 'zero duration' END, CASE WHEN bad > n * 0.1 THEN 'invalid notes' END) AS errors FROM (SELECT song_id, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(last, 0) AS last FROM songs LEFT JOIN (SELECT song_id, count(*) AS n, count(CASE WHEN NOT pitch BETWEEN 0 AND 127 OR NOT velocity BETWEEN 0 AND 127 OR end_tick <= start_tick THEN 1 END) AS bad, max(end_tick) AS last FROM notes GROUP BY 1) f USING (song_id)) x")

# tokens
add("FIL08", "tokens", lambda t: tokens.out_of_vocabulary(t, 500), "SELECT song_id, count(CASE WHEN token_id < 0 OR token_id >= 500 THEN 1 END) AS oov, min(CASE WHEN token_id < 0 OR token_id >= 500 THEN pos END) AS first_oov FROM tokens GROUP BY 1")
add("FIL09", "tokens", tokens.stripped, "SELECT * FROM tokens WHERE token_id NOT IN (0, 1, 2)")
add("FIL10", "tokens", lambda t: tokens.truncated(t, 256), "SELECT * FROM tokens WHERE pos <= 256")
add("FIL11", "tokens", tokens.context_budget, "SELECT song_id, n AS content, greatest(1536 - n, 0) AS remaining, round(n * 100.0 / 1536, 6) AS percent, n <= 1536 AS fits FROM (SELECT song_id, count(CASE WHEN token_id NOT IN (0, 1, 2) THEN 1 END) AS n FROM tokens GROUP BY 1) x")
add("WIN06", "tokens", tokens.bars, "SELECT *, CAST(sum(CASE WHEN token_id = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bar FROM tokens")
add("WIN07", "tokens", tokens.track_ids, f", {SECTIONS} SELECT * FROM sec")
add("WIN10", "tokens", tokens.labels, "SELECT *, CASE WHEN token_id = 0 THEN -100 ELSE coalesce(lead(token_id) OVER (PARTITION BY song_id ORDER BY pos), -100) END AS label FROM tokens")
add("WIN11", "tokens", lambda t: tokens.ngram_counts(t, 3), "SELECT song_id, t0, t1, t2, count(*) AS count FROM (SELECT song_id, token_id AS t0, lead(token_id, 1) OVER w AS t1, lead(token_id, 2) OVER w AS t2 FROM tokens WINDOW w AS (PARTITION BY song_id ORDER BY pos)) x WHERE t2 IS NOT NULL GROUP BY 1, 2, 3, 4")
add("WIN12", "broken", tokens.runs, "SELECT song_id, token_id, min(pos) AS first_pos, count(*) AS length FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY pos) - row_number() OVER (PARTITION BY song_id, token_id ORDER BY pos) AS i FROM broken) x GROUP BY song_id, token_id, i HAVING count(*) >= 2")
add("WIN15", "broken", tokens.grammar_violations, f"SELECT song_id, pos, class, before FROM (SELECT *, lag(class) OVER (PARTITION BY song_id ORDER BY pos) AS before FROM (SELECT song_id, pos, {CLASS} AS class FROM broken) c WHERE class IN ('Pitch', 'Velocity', 'Duration')) x WHERE (before IS NOT NULL OR class <> 'Pitch') AND before IS DISTINCT FROM (CASE class WHEN 'Velocity' THEN 'Pitch' WHEN 'Duration' THEN 'Velocity' ELSE 'Duration' END)")
add("WIN16", "broken", tokens.polyphonic_melody, f", {SECTIONS.replace("FROM tokens", "FROM broken")} SELECT song_id, pos, token_id FROM (SELECT *, row_number() OVER (PARTITION BY song_id, segment ORDER BY pos) AS k FROM (SELECT *, {CLASS} AS class, sum(CASE WHEN {CLASS} IN ('Duration', 'ChordStart', 'MelodyStart', 'Bar') THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS segment FROM sec) s WHERE class = 'Pitch' AND section = 'M') x WHERE k > 1")
add("WIN17", "tokens", tokens.bar_regularity, "SELECT song_id, round(CASE WHEN count(gap) < 2 THEN 0.5 ELSE greatest(0, 1 - stddev_samp(gap) / avg(gap)) END, 6) AS regularity FROM (SELECT song_id, lead(pos) OVER (PARTITION BY song_id ORDER BY pos) - pos AS gap FROM tokens WHERE token_id = 4) x GROUP BY 1")
add("WIN20", "tokens", tokens.absolute_positions, "SELECT song_id, pos, bar * 48 + token_id - 157 AS place FROM (SELECT *, CAST(sum(CASE WHEN token_id = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY song_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bar FROM tokens) x WHERE token_id BETWEEN 157 AND 252")
NAMES = "CASE WHEN token_id BETWEEN 5 AND 92 THEN 'Pitch_' || (token_id + 16) WHEN token_id BETWEEN 93 AND 108 THEN 'Velocity_' || (token_id - 93) WHEN token_id BETWEEN 109 AND 156 THEN 'Duration_' || (token_id - 109) WHEN token_id BETWEEN 157 AND 252 THEN 'Position_' || (token_id - 157) WHEN token_id = 4 THEN 'Bar_None' WHEN token_id = 531 THEN 'ChordStart_None' WHEN token_id = 532 THEN 'MelodyStart_None' ELSE '<UNK>' END"
add("JOI06", "tokens", tokens.named, f"SELECT *, {NAMES} AS name FROM tokens")
add("JOI07", "tokens", lambda t: tokens.transposed(t, 3), "SELECT *, CASE WHEN token_id BETWEEN 5 AND 92 AND token_id + 19 BETWEEN 36 AND 84 AND token_id + 3 <= 92 THEN token_id + 3 ELSE token_id END AS new_id, token_id BETWEEN 5 AND 92 AND token_id + 19 BETWEEN 36 AND 84 AND token_id + 3 <= 92 AS moved FROM tokens")
add("SCA03", "tokens", tokens.content_hash, "SELECT song_id, md5(string_agg(CAST(token_id AS VARCHAR), '' ORDER BY pos)) AS hash FROM tokens GROUP BY 1")
add("SET07", "tokens", lambda t: t.select("token_id").distinct(), "SELECT DISTINCT token_id FROM tokens")
add("SET03", "tokens", lambda t: tokens.unused(t).select("id"), "SELECT CAST(i AS INT) AS id FROM range(533) r(i) WHERE i NOT IN (SELECT token_id FROM tokens)")
add("AGG22", "tokens", tokens.dataset_statistics, ", l AS (SELECT song_id, count(*) AS n FROM tokens GROUP BY 1) SELECT count(*) AS sequences, min(n) AS min_length, max(n) AS max_length, round(avg(n), 6) AS avg_length, list_sort(list(n))[CAST(floor(count(*) / 2) AS INT) + 1] AS median_length, (SELECT count(DISTINCT token_id) FROM tokens) AS used, round((SELECT count(DISTINCT token_id) FROM tokens) * 100.0 / 533, 6) AS coverage FROM l")
add("TOP04", "tokens", tokens.top_tokens, "SELECT * FROM (SELECT song_id, token_id, count(*) AS count, CAST(row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, token_id) AS INT) AS place FROM tokens GROUP BY 1, 2) x WHERE place <= 20")
add("TOP04_least", "tokens", tokens.least_tokens, """, c AS (SELECT song_id, token_id, count(*) AS count FROM tokens GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY song_id) AS n, CAST(row_number() OVER (PARTITION BY song_id ORDER BY count, token_id) AS INT) AS place FROM c)
SELECT song_id, token_id, count, place FROM r WHERE n > 20 AND place <= 20""")
GRAMS = """, g AS (SELECT song_id, token_id AS t0, lead(token_id) OVER w AS t1, lead(token_id, 2) OVER w AS t2 FROM tokens WINDOW w AS (PARTITION BY song_id ORDER BY pos)),
c AS (SELECT song_id, {ids}, count(*) AS count FROM g WHERE {last} IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY song_id ORDER BY count DESC, {ids}) AS INT) AS place FROM c) x WHERE place <= 20"""
add("TOP04_bigrams", "tokens", tokens.top_ngrams, GRAMS.format(ids="t0, t1", last="t1"))
add("TOP04_trigrams", "tokens", lambda t: tokens.top_ngrams(t, 3), GRAMS.format(ids="t0, t1, t2", last="t2"))
add("TOP04_pitches", "notes", tokens.top_pitches, """SELECT * FROM (SELECT song_id, pitch, count(*) AS count, CAST(row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, pitch) AS INT) AS place
FROM notes GROUP BY 1, 2) x WHERE place <= 10""")
add("SEQ01_types", "tokens", tokens.type_distribution, f"""SELECT song_id, class, count(*) AS count, count(*) / sum(count(*)) OVER (PARTITION BY song_id) AS share
FROM (SELECT song_id, {CLASS} AS class FROM tokens) x GROUP BY 1, 2""")
add("SEQ01", "tokens", tokens.vocabulary_usage, "SELECT song_id, count(*) AS used, round(count(*) / 533.0, 6) AS coverage, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT song_id, n * 1.0 / sum(n) OVER (PARTITION BY song_id) AS p FROM (SELECT song_id, token_id, count(*) AS n FROM tokens GROUP BY 1, 2) c) x GROUP BY 1")
add("SEQ03", "tokens", tokens.perplexity, ", b AS (SELECT song_id, a, b, count(*) AS c FROM (SELECT song_id, token_id AS a, lead(token_id) OVER (PARTITION BY song_id ORDER BY pos) AS b FROM tokens) x WHERE b IS NOT NULL GROUP BY 1, 2, 3), u AS (SELECT song_id, token_id AS a, count(*) AS n FROM tokens GROUP BY 1, 2) SELECT song_id, round(pow(2.0, -sum(c * log2(c * 1.0 / n)) / sum(c)), 6) AS perplexity FROM b JOIN u USING (song_id, a) GROUP BY 1")
add("SEQ06", "tokens", tokens.smoothness, "SELECT song_id, round(1 - avg(s) / max(s), 6) AS smoothness FROM (SELECT song_id, abs(token_id - lag(token_id) OVER (PARTITION BY song_id ORDER BY pos)) AS s FROM tokens) x GROUP BY 1")

# comparison
add("WIN02", "notes", compare.intervals, "SELECT song_id, step, gap FROM (SELECT song_id, pitch - lag(pitch) OVER w AS step, start_tick - lag(start_tick) OVER w AS gap FROM notes WINDOW w AS (PARTITION BY song_id ORDER BY start_tick, pitch, track_idx, end_tick, velocity)) x WHERE step IS NOT NULL")
add("WIN03", "notes", compare.interval_histogram, "SELECT song_id, interval, count(*) AS count FROM (SELECT song_id, abs(pitch - lag(pitch) OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, pitch)) AS interval FROM notes) x WHERE interval IS NOT NULL GROUP BY 1, 2")
HIST = "hs AS (SELECT song_id, v AS value, count(CASE WHEN s = 0 THEN 1 END) AS original, count(CASE WHEN s = 1 THEN 1 END) AS reconstructed FROM (SELECT song_id, {v} AS v, 0 AS s FROM notes UNION ALL SELECT song_id, {v}, 1 FROM recon) u GROUP BY 1, 2)"
PAIRS = "pr AS (SELECT a.song_id, a.pitch AS pa, b.pitch AS pb, a.velocity AS va, b.velocity AS vb, a.start_tick AS sa, b.start_tick AS sb, a.end_tick - a.start_tick AS da, b.end_tick - b.start_tick AS db FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_tick, pitch, track_idx, end_tick, velocity) AS k FROM notes) a JOIN (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY start_tick, pitch, track_idx, end_tick, velocity) AS k FROM recon) b ON a.song_id = b.song_id AND a.k = b.k)"
add("JOI10", "notes recon", compare.paired, f", {PAIRS.replace('SELECT a.song_id', 'SELECT a.song_id, a.k')} SELECT song_id, CAST(k AS INT) AS n, sa AS start_tick_a, sa + da AS end_tick_a, pa AS pitch_a, va AS velocity_a, sb AS start_tick_b, sb + db AS end_tick_b, pb AS pitch_b, vb AS velocity_b FROM pr")
SIDES = "FROM (SELECT song_id, {f} FROM notes GROUP BY 1) a JOIN (SELECT song_id, {f} FROM recon GROUP BY 1) b USING (song_id)"
add("MUS02", "notes recon", compare.pitch_range_kept, "SELECT song_id, abs(a.lo - b.lo) <= 2 AND abs(a.hi - b.hi) <= 2 AS range_kept, round(b.mn - a.mn, 6) AS shift " + SIDES.format(f="min(pitch) AS lo, max(pitch) AS hi, avg(pitch) AS mn"))
add("MUS04", "notes recon", compare.syncopation_kept, "SELECT song_id, round(a.x, 6) AS original, round(b.x, 6) AS reconstructed, abs(a.x - b.x) < 0.2 AS kept " + SIDES.format(f="avg(CASE WHEN start_tick % 480 <> 0 THEN 1.0 ELSE 0 END) AS x"))

# reports and score tables
BATCH = "bt AS (SELECT batch_id, count(*) AS files, count(CASE WHEN success THEN 1 END) AS successful, round(avg(CASE WHEN success THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(q), 6) AS avg_quality, round(min(q), 6) AS min_quality, round(max(q), 6) AS max_quality, count(CASE WHEN q >= 0.95 THEN 1 END) AS excellent, count(CASE WHEN q >= 0.9 AND q < 0.95 THEN 1 END) AS good, count(CASE WHEN q >= 0.8 AND q < 0.9 THEN 1 END) AS fair, count(CASE WHEN q < 0.8 THEN 1 END) AS poor, CAST(sum(seconds) AS BIGINT) AS total_seconds FROM (SELECT *, CASE WHEN success THEN overall_score END AS q FROM results) r GROUP BY 1)"
#: What the results table lacks, by file number, in text that both engines read.
RESULT = [
    "*", "CASE WHEN file_id % 11 = 0 THEN 'skipped' WHEN success THEN 'completed' ELSE 'failed' END AS status", "CAST(100 + file_id % 900 AS BIGINT) AS tokens", "CASE file_id % 3 WHEN 0 THEN 'REMI' WHEN 1 THEN 'TSD' END AS strategy",
    "CASE WHEN file_id % 5 > 0 THEN concat('issue ', file_id % 13) END AS first_issue", "CASE WHEN file_id % 5 > 1 THEN concat('issue ', file_id % 7) END AS second_issue",
]
COORDINATOR = f""", r AS (SELECT {", ".join(RESULT)} FROM results), x AS (SELECT *, CASE WHEN status = 'completed' AND overall_score > 0 THEN overall_score END AS q FROM r),
c AS (
  SELECT batch_id, count(*) AS files, count_if(status = 'completed') AS completed, count_if(status = 'failed') AS failed, count_if(status = 'skipped') AS skipped, round(avg(q), 6) AS avg_quality, min(q) AS min_quality, max(q) AS max_quality,
    count_if(q >= 0.95) AS excellent, count_if(q >= 0.9 AND q < 0.95) AS good, count_if(q >= 0.8 AND q < 0.9) AS fair, count_if(q < 0.8) AS poor, sum(tokens) FILTER (status = 'completed') AS tokens, avg(tokens) FILTER (status = 'completed') AS avg_tokens,
    sum(seconds) AS seconds, avg(seconds) AS avg_seconds FROM x GROUP BY 1),
e AS (SELECT batch_id, string_agg(k || '=' || n, ',' ORDER BY k) AS error_kinds FROM (
  SELECT batch_id, CASE WHEN contains(lower(error_message), 'corrupt') THEN 'corrupted_file' WHEN contains(lower(error_message), 'memory') THEN 'memory_error' WHEN contains(lower(error_message), 'token') THEN 'tokenization_error' ELSE 'other' END AS k, count(*) AS n
  FROM r WHERE status = 'failed' AND error_message IS NOT NULL GROUP BY 1, 2) k GROUP BY 1),
s AS (SELECT batch_id, string_agg(k || '=' || format('{{:.4f}}', v), ',' ORDER BY k) AS strategies FROM (SELECT batch_id, coalesce(strategy, 'unknown') AS k, avg(success::INT) AS v FROM r WHERE status = 'completed' GROUP BY 1, 2) k GROUP BY 1),
i AS (SELECT batch_id, string_agg(k || '=' || n, ',' ORDER BY p) AS top_issues FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY n DESC, k) AS p FROM (
    SELECT batch_id, k, count(*) AS n FROM (SELECT batch_id, unnest([first_issue, second_issue]) AS k FROM r WHERE status = 'completed') u WHERE k IS NOT NULL GROUP BY 1, 2) g) k WHERE p <= 10 GROUP BY 1)
SELECT c.*, coalesce(error_kinds, '') AS error_kinds, coalesce(strategies, '') AS strategies, coalesce(top_issues, '') AS top_issues FROM c LEFT JOIN e USING (batch_id) LEFT JOIN s USING (batch_id) LEFT JOIN i USING (batch_id)"""
add("AGG14", "results", lambda r: reports.coordinator_statistics(r.selectExpr(*RESULT).withColumn("issues", F.array_compact(F.array("first_issue", "second_issue")))), COORDINATOR)
add("AGG15", "results", lambda r: reports.merged(reports.batch_statistics(r)), f", {BATCH} SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(successful) AS BIGINT) AS successful, round(sum(avg_quality * successful) / sum(successful), 4) AS avg_quality, min(min_quality) AS min_quality, max(max_quality) AS max_quality FROM bt")
add("AGG17", "results", reports.dashboard, "SELECT round(h, 4) AS health, CASE WHEN h >= 90 THEN 'excellent' WHEN h >= 75 THEN 'good' WHEN h >= 60 THEN 'fair' ELSE 'poor' END AS status FROM (SELECT 40 * avg(q) + 40 * avg(CASE WHEN success THEN 1.0 ELSE 0 END) + 20 * (1 - least(coalesce(stddev_samp(q), 0), 0.3) / 0.3) AS h FROM (SELECT *, CASE WHEN success THEN overall_score END AS q FROM results) r) x")
add("AGG18", "results", lambda r: reports.quality_trend(reports.batch_statistics(r)), f", {BATCH} SELECT round((b - a) / a * 100, 4) AS change_rate, CASE WHEN (b - a) / a * 100 > 5 THEN 'improving' WHEN (b - a) / a * 100 < -5 THEN 'declining' ELSE 'stable' END AS direction FROM (SELECT avg(CASE WHEN k <= floor(al / 2) THEN avg_quality END) AS a, avg(CASE WHEN k > floor(al / 2) THEN avg_quality END) AS b FROM (SELECT avg_quality, row_number() OVER (ORDER BY batch_id) AS k, count(*) OVER () AS al FROM bt WHERE avg_quality > 0) o) x")
add("AGG21", "results", reports.frequent_errors, "SELECT error_message, count(*) AS count FROM results WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
add("QUA04", "results", reports.gated, "SELECT file_id, CASE WHEN overall_score >= 0.95 THEN 'production' WHEN overall_score >= 0.9 THEN 'standard' WHEN overall_score >= 0.8 THEN 'permissive' WHEN overall_score >= 0.6 THEN 'experimental' ELSE 'none' END AS gate FROM results")
add("SCA20", "results", reports.error_kinds, "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN error_message LIKE '%memory%' THEN 'memory' WHEN error_message LIKE '%token%' THEN 'tokenization' WHEN error_message LIKE '%corrupt%' THEN 'corrupt_file' WHEN error_message LIKE '%metadata%' THEN 'metadata' ELSE 'unknown' END AS kind FROM results WHERE error_message IS NOT NULL) x GROUP BY 1")
add("TOP08", "scores", reports.top_k, "SELECT * FROM (SELECT *, CAST(rank() OVER (PARTITION BY row_id ORDER BY score DESC) AS INT) AS place FROM scores) x WHERE place <= 5")
SOFT = "sm AS (SELECT row_id, token_id, score, e / sum(e) OVER (PARTITION BY row_id) AS p FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY row_id)) AS e FROM scores) x)"
add("TOP09", "scores", reports.top_p, f", {SOFT} SELECT row_id, token_id FROM (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY score DESC, token_id ROWS UNBOUNDED PRECEDING) - p AS before FROM sm) x WHERE before <= 0.9 - 1e-12")
add("SCA23", "scores", reports.entropy, f", {SOFT} SELECT row_id, round(-sum(p * ln(p + 1e-10)), 5) AS entropy, round(exp(-sum(p * ln(p + 1e-10))), 4) AS perplexity FROM sm GROUP BY 1")

# keys and splits
CIRCLE = repr(keys.CIRCLE)
MINOR_CIRCLE = repr([f"{k}m" for k in keys.CIRCLE])
add("SCA02", "songs", lambda s: s.select("song_id", keys.transposed_key(F.col("key_signature"), F.col("song_id") % 12 - 6).alias("key")), f"SELECT song_id, coalesce({CIRCLE}[(list_position({CIRCLE}, key_signature) - 1 + song_id % 12 + 6) % 12 + 1], {MINOR_CIRCLE}[(list_position({MINOR_CIRCLE}, key_signature) - 1 + song_id % 12 + 6) % 12 + 1], key_signature) AS key FROM songs")
add("DAT03", "songs", lambda s: keys.split_by_song(s.where("song_id IS NOT NULL")).groupBy("split").agg(F.count("*").alias("n")), "SELECT * FROM (SELECT 'train' AS split, n - greatest(floor(n * 0.1 + 1e-9), 1) * 2 AS n FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM songs) c UNION ALL SELECT 'val', greatest(floor(n * 0.1 + 1e-9), 1) FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM songs) c UNION ALL SELECT 'test', greatest(floor(n * 0.1 + 1e-9), 1) FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM songs) c) x")
add("SCA06", "songs", lambda s: s.select("song_id", keys.safe_name(F.col("title")).alias("name")), "SELECT song_id, lower(replace(title, '#', '')) AS name FROM songs")
