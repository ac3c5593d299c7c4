"""Queries on names, augmentation and training tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import tokens as T
from ..operators import training as tr
from ..views import with_views
from .catalog import SECTIONS, add
from .registry import register

FLAT = "CASE WHEN k LIKE '%m' THEN concat(b, 'm') ELSE b END"
KEYNAME = "SELECT song_id, k, CASE WHEN length(b) = 0 THEN 'C' ELSE {f} END AS kn FROM (SELECT *, replace(replace(CASE WHEN k LIKE '%m' THEN substr(k, 1, length(k) - 1) ELSE k END, '#', 'sharp'), 'b', 'flat') AS b FROM (SELECT song_id, coalesce(key_signature, '') AS k FROM songs) x) y".format(f=FLAT)

add("SCA05", "files", lambda f: f.select("song_id", keys.original_id(F.col("name")).alias("original")), "SELECT song_id, lower(replace(title, '#', '-')) AS original FROM files")
add("DAT02", "files", lambda f: tr.originals(f).select("song_id", "name"), "SELECT song_id, name FROM files WHERE song_id % 3 NOT IN (1, 2)")
add("SCA04", "files", lambda f: f.select("song_id", keys.renamed_key(F.col("name"), F.col("key"), F.lit("Gm")).alias("same"), keys.renamed_key(F.col("name"), F.lit("Q"), F.lit("Gm")).alias("other")), "SELECT song_id, concat('Gm', substr(name, length(key) + 1)) AS same, concat('Gm-', name) AS other FROM files")
add("SCA07", "songs", lambda s: s.select("song_id", keys.key_in_names(F.col("key_signature")).alias("key_name")), f"SELECT song_id, kn AS key_name FROM ({KEYNAME}) z")
add("SCA08", "songs", lambda s: s.select("song_id", keys.output_name(F.col("key_signature"), F.col("bpm") + 0.5, F.lit("REMI"), F.col("title")).alias("name")),
    f"SELECT s.song_id, concat(kn, '-', CAST(round_even(bpm + 0.5, 0) AS INT), 'bpm-remi-', lower(replace(title, '#', '')), '.json') AS name FROM songs s JOIN ({KEYNAME}) z ON s.song_id = z.song_id")
add("SCA15", "songs", tr.conditions, "SELECT song_id, CASE key_signature WHEN 'C' THEN 1 WHEN 'Bb' THEN 12 WHEN 'Am' THEN 14 WHEN 'F#m' THEN 23 ELSE 0 END AS key_id, CASE ts_num WHEN 4 THEN 4 WHEN 3 THEN 3 WHEN 6 THEN 6 ELSE 2 END AS time_id FROM songs")
add("SCA16", "tokens", tr.token_metadata, "SELECT song_id, CAST(NULL AS INT) AS tempo, CAST(NULL AS INT) AS time_signature, CAST(NULL AS INT) AS program, max(CASE WHEN token_id = 531 THEN 1 ELSE 0 END) = 1 AS has_chord_start FROM tokens GROUP BY 1")
add("SCA17", "files", lambda f: f.select("song_id", keys.key_root(F.col("key")).alias("root"), keys.is_minor(F.col("key")).alias("minor"), *(c.alias(n) for n, c in keys.name_facts(F.col("name")).items())),
    "SELECT song_id, CASE key WHEN 'C' THEN 0 WHEN 'Am' THEN 9 WHEN 'F#m' THEN 6 ELSE 10 END AS root, key IN ('Am', 'F#m') AS minor, bpm, CASE song_id % 3 WHEN 1 THEN 2 WHEN 2 THEN -3 END AS \"offset\" FROM files")
add("DAT01", "tokens files", tr.augmented,
    """, mv AS (SELECT t.song_id, o.o AS "offset", pos, token_id, token_id BETWEEN 5 AND 92 AS p, token_id BETWEEN 5 AND 92 AND token_id + 16 + o.o BETWEEN 36 AND 84 AS f FROM tokens t, (SELECT unnest([-6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS o) o),
g AS (SELECT song_id, "offset", count(*) AS n_tokens, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS moved, CAST(sum(CASE WHEN p AND NOT f THEN 1 ELSE 0 END) AS BIGINT) AS kept, md5(string_agg(CASE WHEN f THEN token_id + "offset" ELSE token_id END, '' ORDER BY pos)) AS hash FROM mv GROUP BY 1, 2),
h AS (SELECT g.*, key, name, ['C', 'Db', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B'][1 + (CASE key WHEN 'C' THEN 0 WHEN 'Am' THEN 9 WHEN 'F#m' THEN 6 ELSE 10 END + "offset" + 12) % 12] || CASE WHEN key LIKE '%m' THEN 'm' ELSE '' END AS new_key FROM g JOIN files f ON f.song_id = g.song_id WHERE name NOT LIKE '%-transpose%')
SELECT song_id, "offset", n_tokens, moved, kept, hash, key, new_key, concat(new_key, substr(replace(name, '.json', ''), length(key) + 1), '-transpose', CASE WHEN "offset" > 0 THEN '+' ELSE '' END, "offset", '.json') AS name, kept = 0 AS success FROM h""")  # fmt: skip
SAMPLES = f"""{SECTIONS}, e AS (SELECT song_id, pos AS place, token_id, section FROM sec UNION ALL SELECT song_id, 0, 1, arg_min(section, pos) FROM sec GROUP BY 1 UNION ALL SELECT song_id, max(pos) + 1, 2, arg_max(section, pos) FROM sec GROUP BY 1),
sm AS (SELECT song_id, CAST(place AS INT) AS place, token_id, section, 1 AS mask, coalesce(lead(token_id) OVER (PARTITION BY song_id ORDER BY place), -100) AS label FROM e WHERE place < 512)"""
add("DAT04", "tokens", lambda t: tr.samples(t, 512), f", {SAMPLES} SELECT * FROM sm")
add("DAT06", "tokens", lambda t: tr.label_weights(tr.samples(t, 512)).groupBy("song_id", "section", "weight").count(), f", {SAMPLES} SELECT song_id, section, CASE WHEN label BETWEEN 109 AND 111 THEN CASE section WHEN 'M' THEN 10.0 ELSE 5.0 END ELSE 1.0 END::DOUBLE AS weight, count(*) AS count FROM sm GROUP BY 1, 2, 3")
add("DAT05", "tokens", lambda t: tr.batches(t, 3, 4), """, l AS (SELECT song_id, count(*) + 2 AS length, CAST(song_id % 4 AS INT) AS shard FROM tokens GROUP BY 1),
b AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY shard ORDER BY song_id) - 1) / 3) AS BIGINT) AS batch FROM l)
SELECT song_id, shard, batch, length, padded FROM (SELECT *, max(length) OVER w AS padded, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY shard, batch)) x WHERE n = 3""")  # fmt: skip
add("AGG26", "tempo_changes", lambda c: tr.conditioning_tempo(c.withColumn("duration_seconds", F.when(F.col("song_id") % 2 == 0, F.col("tick") / 480 + 1))),
    "SELECT song_id, round(CASE WHEN song_id % 2 = 0 THEN sum(bpm * (tick / 480.0 + 1)) / sum(tick / 480.0 + 1) ELSE 0 END, 6)::DOUBLE AS tempo FROM tempo_changes GROUP BY song_id")
add("FIL15", "tokens", lambda t: tr.generated_structure(t.withColumn("token_id", F.when((F.col("pos") == 1) & (F.col("song_id") % 2 == 0), 1).when((F.col("pos") == 50) & (F.col("song_id") % 3 == 0), 2).otherwise(F.col("token_id")))),
    """, x AS (SELECT song_id, pos, CASE WHEN pos = 1 AND song_id % 2 = 0 THEN 1 WHEN pos = 50 AND song_id % 3 = 0 THEN 2 ELSE token_id END AS token_id FROM tokens)
SELECT song_id, song_id % 2 = 0 AS has_bos, bool_or(token_id = 2 AND pos < n - 3) AS early_eos, count_if(token_id = 4) AS bars, song_id % 2 = 0 AND NOT bool_or(token_id = 2 AND pos < n - 3) AND count_if(token_id = 4) >= 4 AS valid FROM (SELECT *, max(pos) OVER (PARTITION BY song_id) AS n FROM x) y GROUP BY song_id""")  # fmt: skip
add("SET08", "notes songs", tr.key_adherence, """SELECT song_id, count(*) AS notes, count_if(i) AS in_scale, round(avg(CASE WHEN i THEN 1.0 ELSE 0 END), 6) AS adherence FROM (SELECT n.song_id,
  CASE key_signature WHEN 'C' THEN pitch % 12 IN (0, 2, 4, 5, 7, 9, 11) WHEN 'Am' THEN pitch % 12 IN (9, 11, 0, 2, 4, 5, 7) WHEN 'F#m' THEN pitch % 12 IN (6, 8, 9, 11, 1, 2, 4) ELSE pitch % 12 IN (10, 0, 2, 3, 5, 7, 9) END AS i FROM notes n JOIN songs s ON n.song_id = s.song_id WHERE key_signature IS NOT NULL) x GROUP BY 1""")  # fmt: skip

USED = "SELECT DISTINCT token_id FROM tokens"
add("AGG23", "tokens", lambda t: T.named(t.select("token_id").distinct()).groupBy(tr.keyword_category(F.col("name")).alias("category")).count(),
    f"""SELECT CASE WHEN token_id BETWEEN 5 AND 92 OR token_id BETWEEN 253 AND 314 THEN 'note' WHEN token_id BETWEEN 93 AND 108 THEN 'velocity' WHEN token_id BETWEEN 109 AND 156 THEN 'duration' WHEN token_id BETWEEN 157 AND 252 THEN 'position'
  WHEN token_id = 4 THEN 'bar' WHEN token_id = 531 THEN 'chord' ELSE 'special' END AS category, count(*) AS count FROM ({USED}) u GROUP BY 1""")  # fmt: skip
add("SET02", "tokens", lambda t: tr.extended_vocabulary(T.named(t.select("token_id").distinct()).where("token_id < 531").select("name", F.col("token_id").alias("id"))).select("id"),
    f"SELECT token_id AS id FROM ({USED}) u WHERE token_id < 531 UNION ALL SELECT max(token_id) + 1 + k FROM ({USED}) u, (SELECT unnest([0, 1]) AS k) x WHERE token_id < 531 GROUP BY k")
add("SET09", "tokens", lambda t: T.named(t.select("token_id").distinct()).groupBy(F.split_part("name", F.lit("_"), F.lit(1)).alias("class")).agg(F.count("*").alias("n"), F.min("token_id").alias("first_id")),
    f"""SELECT CASE WHEN token_id BETWEEN 5 AND 92 THEN 'Pitch' WHEN token_id BETWEEN 93 AND 108 THEN 'Velocity' WHEN token_id BETWEEN 109 AND 156 THEN 'Duration' WHEN token_id BETWEEN 157 AND 252 THEN 'Position'
  WHEN token_id = 4 THEN 'Bar' WHEN token_id = 531 THEN 'ChordStart' ELSE 'MelodyStart' END AS class, count(*) AS n, min(token_id) AS first_id FROM ({USED}) u GROUP BY 1""")  # fmt: skip
