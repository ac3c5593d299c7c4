"""The music tables that queries run on, derived by SQL from the tables of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("supplier", "lineitem", "events", "embeddings")
#: Views in order of dependence; the text is plain enough for any engine.
SQL = {
    "notes": """SELECT CAST(l_suppkey AS BIGINT) AS song_id, CAST(l_linenumber - 1 AS INT) AS track_idx,
  CAST((((year(l_shipdate)*12+month(l_shipdate))*31+day(l_shipdate)) % 512) * 60 AS BIGINT) AS start_tick,
  CAST((((year(l_shipdate)*12+month(l_shipdate))*31+day(l_shipdate)) % 512) * 60 + floor(l_quantity) * 24 AS BIGINT) AS end_tick,
  CAST(30 + l_partkey % 61 AS INT) AS pitch, CAST(1 + CAST(floor(l_extendedprice) AS BIGINT) % 127 AS INT) AS velocity,
  l_orderkey, l_partkey FROM lineitem""",
    "recon": """SELECT song_id, track_idx,
  CAST(start_tick + CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey % 11 ELSE 0 END AS BIGINT) AS start_tick,
  CAST(end_tick + CASE WHEN l_orderkey % 7 = 0 THEN l_orderkey % 11 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 3 ELSE 0 END AS BIGINT) AS end_tick,
  CAST(CASE WHEN l_orderkey % 89 = 0 THEN pitch + 1 ELSE pitch END AS INT) AS pitch,
  CAST(least(127, velocity + CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 0 END) AS INT) AS velocity
  FROM notes WHERE l_orderkey % 97 <> 0""",
    "songs": """SELECT CAST(s_suppkey AS BIGINT) AS song_id, 480 AS ppq, CAST(60 + s_suppkey % 120 AS INT) AS bpm,
  CASE s_suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 2 END AS ts_num, CASE s_suppkey % 4 WHEN 2 THEN 8 ELSE 4 END AS ts_den,
  CASE s_suppkey % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'Am' WHEN 2 THEN 'F#m' WHEN 3 THEN 'Bb' END AS key_signature, s_name AS title FROM supplier""",
    "tracks": """SELECT song_id, track_idx,
  CASE track_idx WHEN 0 THEN 'Melodia principal' WHEN 1 THEN 'Chords pad' WHEN 2 THEN 'Bajo' WHEN 3 THEN '' WHEN 4 THEN 'Drum kit' WHEN 5 THEN 'Harmony' ELSE 'Synth 7' END AS name,
  CASE track_idx WHEN 0 THEN 98 WHEN 1 THEN 29 WHEN 2 THEN 33 WHEN 3 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 48 ELSE 81 END AS program,
  track_idx = 4 AS is_drum FROM (SELECT DISTINCT song_id, track_idx FROM notes) t""",
    "tempo_changes": """SELECT song_id, CAST(k * 7680 AS BIGINT) AS tick, CAST(bpm + k * 5 AS INT) AS bpm
  FROM songs CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE k <= song_id % 3""",
    "signatures": """SELECT song_id, CAST(k * 9600 AS BIGINT) AS tick, CAST(CASE WHEN k = 0 THEN ts_num ELSE 2 + k END AS INT) AS num, CAST(CASE WHEN k = 0 THEN ts_den ELSE 4 END AS INT) AS den
  FROM songs CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) x WHERE k <= CAST(floor(song_id / 3.0) AS BIGINT) % 3""",
    "tokens": """SELECT song_id, CAST(row_number() OVER (PARTITION BY song_id ORDER BY bar, section, a, b, c, d, e, part) AS BIGINT) AS pos, CAST(token_id AS INT) AS token_id FROM (
  WITH n AS (SELECT song_id, CAST(floor(start_tick / 1920.0) AS BIGINT) AS bar, start_tick, end_tick, pitch, velocity, track_idx, CASE WHEN track_idx IN (1, 5) THEN 2 ELSE 4 END AS section
    FROM notes WHERE track_idx IN (0, 1, 5) AND pitch BETWEEN 36 AND 84),
  m AS (SELECT DISTINCT song_id, bar FROM n)
  SELECT song_id, bar, 0 AS section, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS e, 0 AS part, 4 AS token_id FROM m
  UNION ALL SELECT song_id, bar, 1, 0, 0, 0, 0, 0, 0, 531 FROM m UNION ALL SELECT song_id, bar, 3, 0, 0, 0, 0, 0, 0, 532 FROM m
  UNION ALL SELECT song_id, bar, section, start_tick, pitch, track_idx, end_tick, velocity, 0, CAST(157 + floor((start_tick % 1920) / 40.0) AS INT) FROM n WHERE section = 4
  UNION ALL SELECT song_id, bar, section, start_tick, pitch, track_idx, end_tick, velocity, 1, 5 + pitch - 21 FROM n
  UNION ALL SELECT song_id, bar, section, start_tick, pitch, track_idx, end_tick, velocity, 2, CAST(93 + floor((velocity - 1) / 8.0) AS INT) FROM n
  UNION ALL SELECT song_id, bar, section, start_tick, pitch, track_idx, end_tick, velocity, 3, CAST(109 + least(47, floor((end_tick - start_tick) / 30.0)) AS INT) FROM n) u""",
    "results": """SELECT CAST(day(ts) AS INT) AS batch_id, CAST(event_id AS BIGINT) AS file_id, event_type <> 'error' AS success, least(1.0, value / 200.0) AS overall_score,
  CASE event_type WHEN 'error' THEN CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'corrupt header' WHEN 1 THEN 'memory overflow' WHEN 2 THEN 'token not in vocabulary' ELSE 'bad tempo metadata' END END AS error_message,
  CAST(event_id % 37 AS INT) AS seconds FROM events""",
    "broken": """SELECT song_id, pos, CASE WHEN pos BETWEEN 20 AND 60 AND song_id % 3 = 0 THEN CAST(40 + song_id % 2 * (pos % 3) AS INT) ELSE token_id END AS token_id FROM tokens""",
    "files": """SELECT song_id, coalesce(key_signature, 'C') AS key, bpm, title, concat(coalesce(key_signature, 'C'), '-', bpm, 'bpm-remi-', lower(replace(title, '#', '-')),
  CASE song_id % 3 WHEN 1 THEN '-transpose+2' WHEN 2 THEN '-transpose-3' ELSE '' END, '.json') AS name FROM songs""",
}
#: Score rows differ by engine in how a position is unnested.
SCORES_SPARK = "SELECT vec_id AS row_id, pos AS token_id, CAST(val AS DOUBLE) AS score FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, val"
SCORES_OTHER = "SELECT vec_id AS row_id, CAST(i AS INT) AS token_id, CAST(embedding[i + 1] AS DOUBLE) AS score FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) t"
NEEDS = {"broken": ["notes", "tokens"], "files": ["songs"], "recon": ["notes"], "tracks": ["notes"], "tempo_changes": ["songs"], "signatures": ["songs"], "tokens": ["notes"]}


_NAMES = re.compile(rf"\b(FROM|JOIN) ({'|'.join([*RAW, *SQL])})\b")


def _private(text: str) -> str:
    """text with its tables under names that no user's view has."""
    return _NAMES.sub(r"\1 stavework__\2", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table; raw tables are read from sf_dir as Parquet, with columns pruned by the plan."""
    for raw in RAW:
        spark.read.parquet(f"{sf_dir}/{raw}.parquet").createOrReplaceTempView(f"stavework__{raw}")
    if name == "scores":
        return spark.sql(_private(SCORES_SPARK))
    for n in [*NEEDS.get(name, []), name]:
        spark.sql(_private(SQL[n])).createOrReplaceTempView(f"stavework__{n}")
    return spark.table(f"stavework__{name}")


def with_views(names: str, body: str) -> str:
    """body for another engine, the named views (and what they need) before it as common table expressions."""
    wanted = [x for n in names.split() for x in [*NEEDS.get(n, []), n]]
    ordered = [n for n in [*SQL, "scores"] if n in wanted]
    parts = [f"{n} AS ({SCORES_OTHER if n == 'scores' else SQL[n]})" for n in ordered]
    return f"WITH {', '.join(parts)}{',' if body.lstrip().startswith(',') else ''} {body.lstrip().lstrip(',')}"
