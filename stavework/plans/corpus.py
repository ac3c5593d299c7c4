"""Queries on the validation of a whole corpus and on what it suggests, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, song_metrics
from ..operators import structure as st
from ..views import view
from .catalog import recursive
from .registry import register
from .roundtrip import MATCHED, NOTES, SIDES, VERDICT
from .scores import add, at_once, by_song, known
from .structure import MOVED

#: Songs whose documents are broken on purpose, by the last digit of their number.
BROKEN = {3: "cut off", 5: "a field is missing", 7: "no time signature", 9: "a note ends before it starts"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and JSON text of every song of the tables, some of them broken."""
    notes, tracks, songs = (view(spark, sf_dir, n) for n in ("notes", "tracks", "songs"))
    digit = F.col("song_id") % 10
    ends = F.when((digit == 9) & (F.col("start_tick") % 480 == 0), F.col("start_tick")).otherwise(F.col("end_tick"))
    lists = notes.groupBy("song_id", "track_idx").agg(F.collect_list(F.struct("start_tick", ends.alias("end_tick"), "pitch", "velocity")).alias("notes"))
    own = lists.join(tracks.select("song_id", "track_idx", "program"), ["song_id", "track_idx"]).groupBy("song_id").agg(F.collect_list(F.struct("track_idx", "program", "notes")).alias("tracks"))
    fields = F.to_json(F.struct("song_id", F.when(digit != 5, F.col("ppq")).alias("ppq"), F.when(digit == 7, 0).otherwise(F.col("ts_num")).alias("ts_num"), "ts_den", "tracks"))
    text = F.when(digit == 3, F.substr(fields, F.lit(1), F.lit(40))).otherwise(fields)
    return songs.join(own, "song_id").select(F.concat(F.lit("song-"), "song_id", F.lit(".json")).alias("path"), text.alias("text"))


GOOD = NOTES.replace("FROM notes n JOIN", "FROM good n JOIN").replace(", n AS (", ", good AS (SELECT * FROM notes WHERE song_id % 10 NOT IN (3, 5, 7, 9)), n AS (", 1)
register("DAT13", lambda spark, sf_dir: corpus.validated(documents(spark, sf_dir)),
    recursive("notes tracks songs", GOOD + SIDES.replace("FROM notes n", "FROM good n") + MATCHED.format(a="sides", b="back") + f"""{VERDICT},
wrong AS (SELECT song_id, count_if(start_tick % 480 = 0) AS n FROM notes GROUP BY 1)
SELECT 'song-' || s.song_id || '.json' AS path, m.song_id, CASE WHEN m.song_id IS NULL THEN 'error' WHEN overall >= 0.9 THEN 'passed' ELSE 'failed' END AS status,
  CASE s.song_id % 10 WHEN 3 THEN 'malformed' WHEN 5 THEN 'schema' WHEN 7 THEN 'metadata' WHEN 9 THEN 'notes' END AS kind,
  CASE s.song_id % 10 WHEN 3 THEN 'not a JSON object' WHEN 5 THEN 'missing or of another type: ppq' WHEN 7 THEN 'resolution or time signature not positive' WHEN 9 THEN w.n || ' notes out of range' END AS message,
  original AS notes, overall, errors, warnings
FROM songs s JOIN wrong w ON w.song_id = s.song_id LEFT JOIN (SELECT m.*, v.errors, v.warnings FROM metrics m JOIN verdicts v ON v.song_id = m.song_id) m ON m.song_id = s.song_id"""))  # fmt: skip

DRUM_POLYPHONY = {"drum_polyphony": "drums * polyphony"}
METRICS_APART = by_song(
    [
        (known("AGG09"), {"missing_ratio": "max(missing_ratio)", "timing": "max(timing)", "velocity": "max(velocity)", "overall": "max(overall)", "notes": "max(original)"}),
        (known("MUS09"), {"musical": "max(overall)"}), (known("AGG04"), {"polyphony": "avg(CASE WHEN avg_polyphony > 0 THEN avg_polyphony END)"}), (known("SCA11"), {"drums": "max(CASE WHEN type = 'drums' THEN 1 ELSE 0 END)"}),
    ],
    DRUM_POLYPHONY,
)
METRICS = at_once("notes recon tempo_changes tracks", lambda a, b, c, t: song_metrics.quality(a, b, st.tempo_stability(c, MOVED(c)), t), METRICS_APART, DRUM_POLYPHONY)
_RULES = ", ".join(f"({', '.join('NULL' if x is None else repr(x) for x in r)}, {corpus.CONFIGURATION[r[4]]!r})" for r in corpus.RULES)
add("QUA11", [METRICS], corpus.suggestions, f""", rules(rule, metric, above, below, parameter, times, plus, most, level, gain, current) AS (VALUES {_RULES}),
long_ AS (SELECT song_id, unnest(['missing_ratio', 'timing', 'velocity', 'overall', 'musical', 'notes', 'polyphony', 'drum_polyphony']) AS metric, unnest([missing_ratio, timing, velocity, overall, musical, notes, polyphony, drum_polyphony]::DOUBLE[]) AS value FROM a)
SELECT DISTINCT song_id, rule, parameter, current::DOUBLE AS current, least(most, current * times + plus)::DOUBLE AS suggested, CASE level WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority, gain::DOUBLE AS gain
FROM long_ JOIN rules USING (metric) WHERE (above IS NULL OR value > above) AND (below IS NULL OR value < below)""")  # fmt: skip
