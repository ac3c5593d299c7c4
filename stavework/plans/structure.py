"""Queries on chords, bars, cycles and gaps, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import statistics
from ..operators import structure as st
from ..operators import tokens as T
from ..operators.notes import max_polyphony, track_statistics
from .catalog import NC, NOTE_COLUMNS, SECTIONS, STATS, add

ORDER = "start_tick, pitch, track_idx, end_tick, velocity"
#: In these tables starts of one chord share a cell of 60 ticks, which the operator does not know.
CELL = "CAST(floor(start_tick / 60.0) AS BIGINT)"
CHORDS = "SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY c) - 1 AS place, chord_start, classes FROM (SELECT song_id, {cell} AS c, min(start_tick) AS chord_start, list_sort(list_distinct(list(pitch % 12))) AS classes FROM {t} GROUP BY 1, 2) x"

add("TOP01", "notes", lambda n: n.select(*NOTE_COLUMNS).sortWithinPartitions("start_tick", "pitch"), f"SELECT {NC} FROM notes")
add("WIN04", "recon", lambda n: st.chords(n).select("song_id", F.col("place").cast("long").alias("place"), "chord_start", F.array_join("classes", ",").alias("classes")),
    f"SELECT song_id, place, chord_start, array_to_string(classes, ',') AS classes FROM ({CHORDS.format(cell=CELL, t='recon')}) y")
add("WIN05", "recon", lambda n: st.sustained(n.where("track_idx = 1").select(*NOTE_COLUMNS)),
    f""", c AS (SELECT *, {CELL} AS c FROM recon WHERE track_idx = 1), g AS (SELECT song_id, c, lead(min(start_tick)) OVER (PARTITION BY song_id ORDER BY c) AS nx, count(*) OVER (PARTITION BY song_id) AS n FROM c GROUP BY 1, 2)
SELECT c.song_id, track_idx, start_tick, CASE WHEN n > 1 THEN greatest(end_tick, coalesce(nx, start_tick + 1920)) ELSE end_tick END AS end_tick, pitch, velocity FROM c JOIN g ON c.song_id = g.song_id AND c.c = g.c""")  # fmt: skip
SIMILAR = f""", x AS ({CHORDS.format(cell=CELL, t='notes')}), y AS ({CHORDS.format(cell=CELL, t='recon')}),
s AS (SELECT coalesce(x.song_id, y.song_id) AS song_id, count(x.place) AS original, count(y.place) AS reconstructed, coalesce(avg(len(list_intersect(x.classes, y.classes)) * 1.0 / len(list_distinct(list_concat(x.classes, y.classes)))) FILTER (WHERE x.place IS NOT NULL AND y.place IS NOT NULL), 0) AS m
FROM x FULL JOIN y ON x.song_id = y.song_id AND x.place = y.place GROUP BY 1)"""
add("SET04", "notes recon", st.chord_similarity, f"{SIMILAR} SELECT song_id, original, reconstructed, round(m * least(original, reconstructed) / greatest(original, reconstructed), 6) AS similarity FROM s")
add("MUS07", "notes recon", st.harmonic_rhythm_kept, f"{SIMILAR} SELECT song_id, original, reconstructed, abs(original - reconstructed) <= 0.2 * greatest(original, reconstructed) AS kept FROM s")
GAPS = "SELECT song_id, {s} AS side, start_tick - lag(start_tick) OVER (PARTITION BY song_id ORDER BY " + ORDER + ") AS g FROM {t}"
add("MUS03", "notes recon", st.rhythm_similarity, f""", u AS ({GAPS.format(s=0, t='notes')} UNION ALL {GAPS.format(s=1, t='recon')}), h AS (SELECT song_id, g, count_if(side = 0) AS a, count_if(side = 1) AS b FROM u WHERE g > 0 GROUP BY 1, 2)
SELECT song_id, round(sum(a * b) / sqrt(sum(a * a) * CAST(sum(b * b) AS DOUBLE)), 6) AS similarity FROM h GROUP BY 1""")  # fmt: skip
MOVED = lambda c: c.where("NOT (song_id % 5 = 0 AND tick > 0)").select("song_id", (F.col("tick") + F.col("song_id") % 3).alias("tick"), (F.col("bpm") + F.col("song_id") % 4).alias("bpm"))
CHANGED = """, p AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY tick) AS i, count(*) OVER (PARTITION BY song_id) AS n FROM tempo_changes),
q AS (SELECT song_id, count_if(song_id % 5 <> 0 OR tick = 0) = any_value(n) AS same_count, CASE WHEN song_id % 3 > 1 THEN any_value(n) ELSE 0 END AS late, CASE WHEN song_id % 4 > 1 THEN any_value(n) ELSE 0 END AS changed, avg((song_id % 4) * 1.0 / bpm) AS drift FROM p GROUP BY song_id)"""
add("JOI11", "tempo_changes", lambda c: st.change_comparison(c, MOVED(c)).withColumn("drift", F.round("drift", 6)), f"{CHANGED} SELECT song_id, same_count, CASE WHEN same_count THEN late END AS late, CASE WHEN same_count THEN changed END AS changed, CASE WHEN same_count THEN round(drift, 6) END AS drift FROM q")
add("MUS05", "tempo_changes", lambda c: st.tempo_stability(c, MOVED(c)), f"{CHANGED} SELECT song_id, round(CASE WHEN same_count THEN greatest(0, 1 - drift) ELSE 0.5 END, 6)::DOUBLE AS stability FROM q")
add("WIN19", "notes", st.silent_gaps, f"SELECT song_id, end_tick AS tick, gap, round(least(2.5, gap * 0.5 / 480), 6)::DOUBLE AS priority FROM (SELECT song_id, end_tick, lead(start_tick) OVER (PARTITION BY song_id ORDER BY {ORDER}) - end_tick AS gap FROM notes) x WHERE gap > 480")
add("WIN18", "notes", statistics.autocorrelation, f""", x AS (SELECT song_id, pitch, row_number() OVER w AS i, count(*) OVER (PARTITION BY song_id) AS n FROM notes WINDOW w AS (PARTITION BY song_id ORDER BY {ORDER}))
SELECT a.song_id, CAST(l.lag AS INT) AS lag, round(CASE WHEN isnan(coalesce(corr(a.pitch, b.pitch), 'nan'::DOUBLE)) THEN 0 ELSE corr(a.pitch, b.pitch) END, 6) AS r FROM x a JOIN (SELECT unnest(range(50)) AS lag) l ON l.lag < least(50, a.n // 2) JOIN x b ON b.song_id = a.song_id AND b.i = a.i + l.lag GROUP BY 1, 2""")  # fmt: skip
add("WIN09", "tokens", st.restored, """, m AS (SELECT *, last_value(CASE token_id WHEN 531 THEN 'C' WHEN 532 THEN 'M' END IGNORE NULLS) OVER w AS s, count_if(token_id = 531) OVER w AS part FROM tokens WINDOW w AS (PARTITION BY song_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
n AS (SELECT *, row_number() OVER (PARTITION BY song_id, part, s, token_id BETWEEN 5 AND 92 ORDER BY pos) AS k FROM m),
e AS (SELECT song_id, pos, 0 AS o, 157 AS t FROM n WHERE s = 'C' AND token_id BETWEEN 5 AND 92 AND k = 1 UNION ALL SELECT song_id, pos, 1, CASE s WHEN 'C' THEN 423 ELSE 492 END FROM n WHERE s IS NOT NULL AND token_id BETWEEN 5 AND 92 UNION ALL SELECT song_id, pos, 2, token_id FROM n WHERE token_id NOT IN (531, 532))
SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY pos, o) AS pos, t AS token_id FROM e""")  # fmt: skip
# what is restored and put in order again is what it was
add("WIN08", "tokens", lambda t: st.reordered(st.restored(t)), "SELECT song_id, pos, token_id FROM tokens")
LOOPED = "SELECT song_id, pos, CASE WHEN pos BETWEEN 20 AND 60 AND song_id % 3 = 0 THEN CAST(5 + pos % (1 + song_id % 7) AS INT) ELSE token_id END AS token_id FROM tokens"
add("WIN13", "tokens", lambda t: st.cycles(t.withColumn("token_id", F.when(F.col("pos").between(20, 60) & (F.col("song_id") % 3 == 0), (5 + F.col("pos") % (1 + F.col("song_id") % 7)).cast("int")).otherwise(F.col("token_id")))),
    f""", lo AS ({LOOPED}), l AS (SELECT a.song_id, c.c, a.token_id, a.pos, b.token_id AS o FROM lo a JOIN (SELECT unnest(range(1, 9)) AS c) c ON true JOIN lo b ON b.song_id = a.song_id AND b.pos = a.pos - c.c),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY song_id, c ORDER BY pos) AS i FROM l WHERE token_id = o AND (c > 1 OR token_id NOT IN (0, 1, 2, 4)))
SELECT song_id, CAST(c AS INT) AS cycle, min(pos) - c AS first, count(*) + c AS tokens FROM r GROUP BY song_id, c, i HAVING count(*) >= 2 * c""")  # fmt: skip
add("WIN14", "tokens", lambda t: st.repeated_chords(T.track_ids(t).withColumn("token_id", F.when((F.col("section") == "C") & F.col("token_id").between(5, 92) & (F.col("song_id") % 2 == 0) & (F.col("pos") < 400), 40).otherwise(F.col("token_id"))).drop("section")),
    f""", {SECTIONS}, x AS (SELECT song_id, pos, section, CASE WHEN section = 'C' AND token_id BETWEEN 5 AND 92 AND song_id % 2 = 0 AND pos < 400 THEN 40 ELSE token_id END AS t FROM sec), p AS (SELECT *, count_if(t = 531) OVER (PARTITION BY song_id ORDER BY pos) AS part FROM x),
s AS (SELECT song_id, part, coalesce(string_agg(DISTINCT CASE WHEN t BETWEEN 5 AND 92 THEN t END, ',' ORDER BY CASE WHEN t BETWEEN 5 AND 92 THEN t END), '') AS chord FROM p WHERE section = 'C' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY part) - row_number() OVER (PARTITION BY song_id, chord ORDER BY part) AS i FROM s)
SELECT song_id, chord, min(part) AS first_bar, count(*) AS bars FROM r WHERE chord <> '' GROUP BY song_id, chord, i HAVING count(*) >= 4""")  # fmt: skip
KINDS = "CASE track_idx WHEN 0 THEN 'melody' ELSE 'chord' END"
add("FIL12", "notes", lambda n: st.two_track_structure(track_statistics(n.where("track_idx < 2 OR (track_idx = 2 AND song_id % 3 = 0)").where("NOT (track_idx = 1 AND song_id % 4 = 0)")).withColumn("type", F.when(F.col("track_idx") == 0, "melody").otherwise("chord"))),
    f""", {STATS.replace('FROM notes', "FROM (SELECT * FROM notes WHERE (track_idx < 2 OR (track_idx = 2 AND song_id % 3 = 0)) AND NOT (track_idx = 1 AND song_id % 4 = 0))")},
v AS (SELECT song_id, count(*) AS tracks, min(CASE WHEN track_idx = 0 THEN avg_polyphony END) AS m, arg_min(avg_polyphony, track_idx) FILTER (WHERE track_idx > 0) AS c FROM st GROUP BY 1),
w AS (SELECT *, CASE WHEN tracks <> 2 THEN 'tracks' WHEN m IS NULL THEN 'no melody' WHEN c IS NULL THEN 'no chord' WHEN m > 1.3 THEN 'melody not monophonic' WHEN c < 2 THEN 'chord too thin' END AS problem FROM v)
SELECT song_id, tracks, problem, problem IS NULL AS valid FROM w""")  # fmt: skip
add("SCA12", "tracks notes", lambda t, n: st.chord_track(t.where("NOT (track_idx = 1 AND song_id % 2 = 0)"), max_polyphony(n)),
    """, d AS (SELECT song_id, track_idx, start_tick AS t, 1 AS d FROM notes UNION ALL SELECT song_id, track_idx, end_tick, -1 FROM notes), l AS (SELECT song_id, track_idx, sum(d) OVER (PARTITION BY song_id, track_idx ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS v FROM d),
p AS (SELECT song_id, track_idx, max(v) AS p FROM l GROUP BY 1, 2)
SELECT t.song_id, min(t.track_idx) AS track_idx FROM tracks t JOIN p ON p.song_id = t.song_id AND p.track_idx = t.track_idx WHERE NOT (t.track_idx = 1 AND t.song_id % 2 = 0) AND (program = 29 OR (regexp_matches(lower(name), 'chord|harmony|accomp|pad') AND p >= 3)) GROUP BY 1""")  # fmt: skip
add("JOI13", "tokens", lambda t: st.vocabulary_differences(
    t.select(F.col("song_id").cast("string").alias("doc"), F.col("token_id").cast("string").alias("name"), (F.col("token_id") + F.when((F.col("song_id") % 5 == 0) & (F.col("token_id") == 4), 1).otherwise(0)).alias("id")).distinct(), "1"),
    """, v AS (SELECT DISTINCT song_id, token_id FROM tokens), r AS (SELECT token_id FROM v WHERE song_id = 1), d AS (SELECT DISTINCT song_id FROM v WHERE song_id <> 1), w AS (SELECT song_id, token_id FROM d, r),
f AS (SELECT coalesce(w.song_id, v.song_id) AS s, w.token_id AS a, v.token_id AS b FROM w FULL JOIN (SELECT * FROM v WHERE song_id <> 1) v ON v.song_id = w.song_id AND v.token_id = w.token_id)
SELECT CAST(s AS VARCHAR) AS doc, count_if(b IS NULL) AS missing, count_if(a IS NULL) AS extra, count_if(a = 4 AND b = 4 AND s % 5 = 0) AS renumbered FROM f GROUP BY s HAVING count_if(b IS NULL) + count_if(a IS NULL) + count_if(a = 4 AND b = 4 AND s % 5 = 0) > 0""")  # fmt: skip
EVENTS = lambda c, s: c.select("song_id", "tick", F.lit("tempo").alias("kind"), F.col("bpm").cast("string").alias("value")).unionByName(s.select("song_id", F.lit(0).cast("long").alias("tick"), F.lit("time signature").alias("kind"), F.concat_ws("/", "ts_num", "ts_den").alias("value"))).unionByName(s.where("key_signature IS NOT NULL").select("song_id", F.lit(0).cast("long").alias("tick"), F.lit("key").alias("kind"), F.col("key_signature").alias("value")))
add("DAT08", "tempo_changes songs", lambda c, s: st.events_of_chunks(EVENTS(c, s), 5760, 3840),
    """, ev AS (SELECT song_id, tick, 'tempo' AS kind, bpm::VARCHAR AS value FROM tempo_changes UNION ALL SELECT song_id, 0, 'time signature', concat(ts_num, '/', ts_den) FROM songs UNION ALL SELECT song_id, 0, 'key', key_signature FROM songs WHERE key_signature IS NOT NULL)
SELECT song_id, tick - k * 3840 AS tick, kind, value, k AS chunk FROM ev JOIN (SELECT unnest(range(100)) AS k) c ON tick BETWEEN k * 3840 AND k * 3840 + 5760""")  # fmt: skip
