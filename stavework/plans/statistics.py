"""Registered queries of statistical comparison and sequence quality, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, sequences, statistics, tokens
from .catalog import CLASS, HIST, PAIRS, add

ORDER = ", ".join(compare.ORDER)
NUMBERED = f"row_number() OVER (PARTITION BY song_id ORDER BY {ORDER}) AS k"

BINNED = f""", {HIST.format(v='pitch')}, bd AS (SELECT song_id, min(value) AS lo, max(value) AS hi, sum(original) AS n, sum(reconstructed) AS m FROM hs GROUP BY 1 HAVING sum(original) > 0 AND sum(reconstructed) > 0),
bn AS (SELECT song_id, CASE WHEN hi > lo THEN least(floor((value - lo) * 49 * 1.0 / (hi - lo)), 48) ELSE 0 END AS bin, sum(original) * 1.0 / max(n) AS p, sum(reconstructed) * 1.0 / max(m) AS q FROM hs JOIN bd USING (song_id) GROUP BY 1, 2)"""
for name, column, body in (
    ("STA03", "jensen_shannon", "sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2"),
    ("STA04", "hellinger", "sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2)"),
    ("STA05", "total_variation", "sum(abs(p - q)) / 2"),
):
    add(name, "notes recon", lambda a, b, c=column: statistics.binned_distances(a, b, "pitch").select("song_id", c), f"{BINNED} SELECT song_id, round({body}, 6) AS {column} FROM bn GROUP BY 1")

RANK = "rank() OVER (PARTITION BY song_id ORDER BY {c}) + (count(*) OVER (PARTITION BY song_id, {c}) - 1) / 2.0 AS {c}"
add("STA09", "notes recon", lambda a, b: statistics.spearman(compare.paired(a, b)), f", {PAIRS} SELECT song_id, round(corr(pa, pb), 6) AS pitch, round(corr(va, vb), 6) AS velocity FROM (SELECT song_id, {', '.join(RANK.format(c=c) for c in ('pa', 'pb', 'va', 'vb'))} FROM pr) r GROUP BY 1")
MARK = "mk_{t} AS (SELECT song_id, k, pitch < lo - 1.5 * (hi - lo) OR pitch > hi + 1.5 * (hi - lo) AS iqr, abs(pitch - mean) > 3 * sd AS z FROM (SELECT *, " + NUMBERED + " FROM {t}) x JOIN (SELECT song_id, quantile_cont(pitch, 0.25) AS lo, quantile_cont(pitch, 0.75) AS hi, avg(pitch) AS mean, stddev_pop(pitch) AS sd FROM {t} GROUP BY 1) l USING (song_id))"
# pitches are evenly spread and have no outliers; cubed distances from the middle have
CUBE = "(pitch - 60) * (pitch - 60) * (pitch - 60)"
cubed = lambda pitch: (pitch - 60) * (pitch - 60) * (pitch - 60)
add("STA18", "notes", lambda n: statistics.outliers(n.withColumn("pitch", F.expr(CUBE))), f", cubed AS (SELECT * REPLACE ({CUBE} AS pitch) FROM notes), {MARK.format(t='cubed')} SELECT song_id, count(CASE WHEN z THEN 1 END) AS zscore, count(CASE WHEN iqr THEN 1 END) AS iqr, round(avg(CASE WHEN iqr THEN 1.0 ELSE 0 END), 6) AS ratio FROM mk_cubed GROUP BY 1")
add("STA19", "notes recon", lambda a, b: statistics.outliers_kept(*(df.withColumn("pitch", F.expr(CUBE)) for df in (a, b))), f", ca AS (SELECT * REPLACE ({CUBE} AS pitch) FROM notes), cb AS (SELECT * REPLACE ({CUBE} AS pitch) FROM recon), {MARK.format(t='ca')}, {MARK.format(t='cb')} SELECT song_id, round(avg(CASE WHEN coalesce(b.iqr, false) THEN 1.0 ELSE 0 END), 6) AS kept FROM mk_ca a LEFT JOIN mk_cb b USING (song_id, k) WHERE a.iqr GROUP BY 1")
add("STA20", "notes recon", statistics.trend_similarity, f", sl AS (SELECT song_id, s, regr_slope(pitch, k) AS b, count(*) AS n FROM (SELECT song_id, 0 AS s, pitch, {NUMBERED} FROM notes UNION ALL SELECT song_id, 1, pitch, {NUMBERED} FROM recon) x GROUP BY 1, 2) SELECT song_id, round(CASE WHEN x.n < 10 OR y.n < 10 THEN 0.5 WHEN greatest(abs(x.b), abs(y.b)) > 0 THEN 1 - abs(x.b - y.b) / (2 * greatest(abs(x.b), abs(y.b))) ELSE 1 END, 6) AS similarity FROM (SELECT * FROM sl WHERE s = 0) x JOIN (SELECT * FROM sl WHERE s = 1) y USING (song_id)")
add("WIN21", "notes", statistics.stationary, f", hf AS (SELECT song_id, pitch, k <= floor(count(*) OVER (PARTITION BY song_id) / 2) AS f FROM (SELECT *, {NUMBERED} FROM notes) x), sm AS (SELECT song_id, count(*) AS n, abs(avg(pitch) FILTER (f) - avg(pitch) FILTER (NOT f)) AS dm, abs(stddev_pop(pitch) FILTER (f) - stddev_pop(pitch) FILTER (NOT f)) AS ds, avg(pitch) AS m, stddev_pop(pitch) AS s FROM hf GROUP BY 1) SELECT song_id, n < 20 OR ((CASE WHEN m > 0 THEN dm / m < 0.2 ELSE dm < 1 END) AND (CASE WHEN s > 0 THEN ds / s < 0.2 ELSE ds < 1 END)) AS stationary FROM sm")
OVERLAP = "ov_{t} AS (SELECT a.song_id, count(*) AS pairs, avg(abs(a.pitch - b.pitch)) AS interval FROM (SELECT *, row_number() OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, pitch, end_tick, velocity) AS k FROM {t}) a JOIN (SELECT *, row_number() OVER (PARTITION BY song_id, track_idx ORDER BY start_tick, pitch, end_tick, velocity) AS k FROM {t}) b ON a.song_id = b.song_id AND a.track_idx = b.track_idx AND a.k < b.k AND b.start_tick < a.end_tick GROUP BY 1)"
add("JOI08", "notes", statistics.overlap_interval, f", {OVERLAP.format(t='notes')} SELECT song_id, pairs, round(interval, 6) AS interval FROM ov_notes")
add("MUS06", "notes recon", statistics.voicing_kept, f", {OVERLAP.format(t='notes')}, {OVERLAP.format(t='recon')} SELECT song_id, x.interval IS NULL OR y.interval IS NULL OR x.interval = 0 OR y.interval = 0 OR abs(x.interval - y.interval) / x.interval < 0.2 AS kept FROM (SELECT DISTINCT song_id FROM notes) s LEFT JOIN ov_notes x USING (song_id) LEFT JOIN ov_recon y USING (song_id)")
GAPS = "gp_{t} AS (SELECT song_id, gap FROM (SELECT song_id, gap, row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, gap) AS n FROM (SELECT song_id, start_tick - lag(start_tick) OVER (PARTITION BY song_id ORDER BY " + ORDER + ") AS gap FROM {t}) g WHERE gap IS NOT NULL GROUP BY 1, 2) c WHERE n <= 5)"
add("SET05", "notes recon", statistics.groove_kept, f", {GAPS.format(t='notes')}, {GAPS.format(t='recon')} SELECT song_id, coalesce(n, 0) AS shared, coalesce(n, 0) >= 3 AS kept FROM (SELECT DISTINCT song_id FROM notes) s LEFT JOIN (SELECT song_id, count(*) AS n FROM gp_notes JOIN gp_recon USING (song_id, gap) GROUP BY 1) j USING (song_id)")

# sequences
ENTROPY = "{n} AS (SELECT song_id, -sum(c * 1.0 / n * log2(c * 1.0 / n)) AS e, max(n) AS n, count(*) AS kinds FROM (SELECT song_id, c, sum(c) OVER (PARTITION BY song_id) AS n FROM (SELECT song_id, count(*) AS c FROM {src} GROUP BY song_id, {g}) a) b GROUP BY 1)"
GRAM = "gr AS (SELECT song_id, token_id AS a, lead(token_id) OVER w AS b, lead(token_id, 2) OVER w AS c FROM tokens WINDOW w AS (PARTITION BY song_id ORDER BY pos))"
GRAMS = f", {GRAM}, g2 AS (SELECT * FROM gr WHERE b IS NOT NULL), g3 AS (SELECT * FROM gr WHERE c IS NOT NULL), {ENTROPY.format(n='e1', src='gr', g='a')}, {ENTROPY.format(n='e2', src='g2', g='a, b')}, {ENTROPY.format(n='e3', src='g3', g='a, b, c')}"
add("SEQ02", "tokens", sequences.coherence, f"{GRAMS} SELECT song_id, round(1 - e1.kinds * 1.0 / e1.n, 6) AS repetition, round(coalesce(e2.e, 0), 6) AS bigram_entropy, round(coalesce(e3.e, 0), 6) AS trigram_entropy FROM e1 LEFT JOIN e2 USING (song_id) LEFT JOIN e3 USING (song_id)")
add("SEQ07", "tokens", sequences.complexity, f"{GRAMS} SELECT song_id, round(greatest(0, least(1, e1.kinds * 0.3 / e1.n + coalesce(e2.kinds * 0.3 / e2.n, 0) + CASE WHEN e1.kinds > 1 THEN 0.4 * e1.e / log2(e1.kinds) ELSE 0 END)), 6) AS complexity FROM e1 LEFT JOIN e2 USING (song_id)")
add("SEQ04", "tokens", sequences.pattern_consistency, ", p AS (SELECT song_id, token_id, n, size, floor(i / size) AS part FROM (SELECT song_id, token_id, row_number() OVER (PARTITION BY song_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY song_id) AS n, greatest(floor(count(*) OVER (PARTITION BY song_id) / 10), 5) AS size FROM tokens) x), k AS (SELECT song_id, part, count(DISTINCT token_id) AS kinds FROM p WHERE part * size < n - size GROUP BY 1, 2), l AS (SELECT song_id, 1 - abs(kinds - lag(kinds) OVER w) * 1.0 / greatest(kinds, lag(kinds) OVER w) AS v, lag(kinds) OVER w AS before FROM k WINDOW w AS (PARTITION BY song_id ORDER BY part)) SELECT song_id, round(CASE WHEN c.n < 10 THEN 1 ELSE coalesce(m, 1) END, 6) AS consistency FROM (SELECT song_id, count(*) AS n FROM tokens GROUP BY 1) c LEFT JOIN (SELECT song_id, avg(v) AS m FROM l WHERE before IS NOT NULL GROUP BY 1) a USING (song_id)")
add("FIL14", "tokens", lambda t: sequences.chord_check(t, 500), "SELECT *, beyond = 0 AND has_bar AND has_chord AS valid FROM (SELECT song_id, count(CASE WHEN token_id >= 500 THEN 1 END) AS beyond, bool_or(token_id = 4) AS has_bar, bool_or(token_id = 531) AS has_chord FROM tokens GROUP BY 1) x")
add("SCA13", "tokens", lambda t: t.select("song_id", "pos", tokens.token_class(F.col("token_id")).alias("class")), f"SELECT song_id, pos, {CLASS} AS class FROM tokens")
add("SCA24", "scores tokens", lambda s, t: sequences.penalized(s, t.withColumnRenamed("song_id", "row_id")), "SELECT row_id, token_id, CASE WHEN h.token_id IS NULL THEN score WHEN score > 0 THEN score / 1.1 ELSE score * 1.1 END AS score FROM scores LEFT JOIN (SELECT DISTINCT song_id AS row_id, token_id FROM tokens) h USING (row_id, token_id)")

# songs and tracks
add("SCA14", "tracks", lambda t: t.select("song_id", "track_idx", F.when((F.col("program") == 98) | ((F.col("program") != 29) & (F.col("program") >= 80)), "melody").otherwise("chord").alias("type")), "SELECT song_id, track_idx, CASE program WHEN 98 THEN 'melody' WHEN 29 THEN 'chord' ELSE CASE WHEN program >= 80 THEN 'melody' ELSE 'chord' END END AS type FROM tracks")
add("SCA22", "songs", lambda s: s.select("song_id", F.round(F.when(F.col("bpm") > 0, (F.col("bpm") - 90) / 50).otherwise(0.0), 6).alias("tempo")), "SELECT song_id, round(CASE WHEN bpm > 0 THEN (bpm - 90) / 50.0 ELSE 0 END, 6) AS tempo FROM songs")
add("AGG31", "results", lambda r: r.select("overall_score", F.col("seconds").cast("double").alias("seconds")).unpivot([], ["overall_score", "seconds"], "metric", "value").groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean")), "SELECT 'overall_score' AS metric, round(avg(overall_score), 6) AS mean FROM results UNION ALL SELECT 'seconds', round(avg(seconds), 6) FROM results")
