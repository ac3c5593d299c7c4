"""Queries on cut points and chunks of long songs, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as ch
from ..views import view
from .catalog import add, recursive
from .registry import register

#: Seconds: a chunk's aim, overlap and least length, and the width of the search for a boundary.
SIZE, OVERLAP, LEAST, WINDOW = 20.0, 2.0, 10.0, 4.0

#: Tempo maps, and all lines on which a song may be cut, with their times. A measure line holds while its signature is the last one at or before
#: the window (from_tick to until_tick). Ticks and times convert by the stretch (between changes of tempo) that they lie in.
PLACES = """,
firsts AS (
  SELECT c.song_id, tick, c.bpm::DOUBLE AS bpm, ppq, ppq * c.bpm::DOUBLE / 60 AS rate FROM tempo_changes c JOIN songs s ON s.song_id = c.song_id),
stretches AS (
  SELECT *, coalesce(lead(tick) OVER w, 9007199254740992) AS next_tick, coalesce(lead(sec) OVER w, 1e18) AS next_sec
  FROM (SELECT *, coalesce(sum(lasts) OVER (PARTITION BY song_id ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS sec
    FROM (SELECT *, (lead(tick) OVER (PARTITION BY song_id ORDER BY tick) - tick) / rate AS lasts FROM firsts) a) b
  WINDOW w AS (PARTITION BY song_id ORDER BY tick)),
ends AS (SELECT song_id, max(end_tick) AS last FROM notes GROUP BY 1),
totals AS (SELECT song_id, ppq, last, sec + (last - tick) / rate AS total FROM ends JOIN stretches USING (song_id) WHERE last >= tick AND last < next_tick),
meters AS (
  SELECT song_id, tick AS from_tick, ppq, last, ppq * 4 * num // den AS measure, coalesce(lead(tick) OVER (PARTITION BY song_id ORDER BY tick), 9007199254740992) AS until_tick
  FROM signatures JOIN totals USING (song_id)),
lines AS (
  SELECT song_id, from_tick + measure * unnest(range(1, greatest(last - from_tick, 0) // measure + 1)) AS tick, from_tick, until_tick, 3.0::DOUBLE AS worth FROM meters
  UNION ALL SELECT song_id, from_tick, 0, 9007199254740992, 3.0 FROM meters
  UNION ALL SELECT song_id, ppq * unnest(range(1, last // ppq + 1)), 0, 9007199254740992, 1.0 FROM totals),
timed AS (
  SELECT l.*, sec + (l.tick - s.tick) / rate AS time FROM lines l JOIN stretches s ON s.song_id = l.song_id AND l.tick >= s.tick AND l.tick < next_tick)"""


def _window(state: str) -> str:
    """Rows of state (song_id, target) with the ticks low and high of the search window around target."""
    tick = "(CASE WHEN {x} < 0 THEN 0 ELSE {s}.tick + ceil(round(({x} - {s}.sec) * {s}.rate, 6)) END)::BIGINT"
    half = WINDOW / 2
    low, high = tick.format(x=f"(target - {half})", s="a"), tick.format(x=f"(target + {half})", s="b")
    return f"""SELECT t.song_id, t.target, totals.ppq, {low} AS low, least({high}, last) AS high FROM {state} t JOIN totals USING (song_id)
  JOIN stretches a ON a.song_id = t.song_id AND greatest(target - {half}, 0) >= a.sec AND greatest(target - {half}, 0) < a.next_sec
  JOIN stretches b ON b.song_id = t.song_id AND target + {half} >= b.sec AND target + {half} < b.next_sec"""


def _best(windows: str) -> str:
    """song_id and the best time of the windows that hold a boundary."""
    return f"""SELECT song_id, arg_max(time, score) AS time FROM (
    SELECT song_id, time, {{'score': round(worth * (1 - abs(time - target) / {WINDOW}), 9), 'worth': worth, 'back': -tick}} AS score FROM (
      SELECT song_id, target, tick, time, worth FROM {windows} JOIN timed l USING (song_id) WHERE tick BETWEEN low AND high AND low >= from_tick AND low < until_tick
      UNION ALL
      SELECT g.song_id, target, g.tick, sec + (g.tick - s.tick) / rate, worth FROM (
        SELECT song_id, target, low, high, end_tick AS tick, least(2.5, gap / ppq::DOUBLE * 0.5)::DOUBLE AS worth, gap, ppq FROM (
          SELECT song_id, target, low, high, ppq, end_tick, lead(start_tick) OVER (PARTITION BY song_id ORDER BY start_tick, end_tick) - end_tick AS gap
          FROM {windows} JOIN notes USING (song_id) WHERE start_tick BETWEEN low AND high OR end_tick BETWEEN low AND high) n
        WHERE gap > ppq AND end_tick BETWEEN low AND high) g
      JOIN stretches s ON s.song_id = g.song_id AND g.tick >= s.tick AND g.tick < s.next_tick) places) scored GROUP BY song_id"""


_NEXT = f"(SELECT song_id, part + 1 AS part, after AS start, least(after + {SIZE}, total) AS target, total FROM steps WHERE part < 0 OR (cut < total AND after < total))"
#: The cuts: one recursion a chunk, for all songs together.
CUTS = f"""{PLACES},
steps AS (
  SELECT song_id, -1 AS part, 0.0::DOUBLE AS start, 0.0::DOUBLE AS cut, 0.0::DOUBLE AS after, total FROM totals
  UNION ALL
  SELECT song_id, part, start, cut, CASE WHEN cut - {OVERLAP} <= start THEN start + {LEAST} ELSE cut - {OVERLAP} END, total FROM (
    SELECT s.song_id, s.part, s.start, s.total,
      CASE WHEN s.target >= s.total THEN s.total WHEN coalesce(time, s.target) - s.start < {LEAST} THEN least(s.start + {LEAST}, s.total) ELSE coalesce(time, s.target) END AS cut
    FROM {_NEXT} s LEFT JOIN ({_best(f"({_window(_NEXT)})")}) b USING (song_id)) c),
cuts AS (
  SELECT s.song_id, s.part, s.start, s.cut, (CASE WHEN s.start <= 0 THEN 0 ELSE a.tick + ceil(round((s.start - a.sec) * a.rate, 6)) END)::BIGINT AS low, least((b.tick + ceil(round((s.cut - b.sec) * b.rate, 6)))::BIGINT, last) AS high
  FROM steps s JOIN totals USING (song_id)
  JOIN stretches a ON a.song_id = s.song_id AND s.start >= a.sec AND s.start < a.next_sec
  JOIN stretches b ON b.song_id = s.song_id AND s.cut >= b.sec AND s.cut < b.next_sec WHERE s.part >= 0)"""


def add_recursive(name: str, needs: str, build: Callable[..., DataFrame], body: str) -> None:
    """As add, where body's tables after the views may refer to themselves."""
    views = needs.split()
    register(name, lambda spark, sf_dir: build(*(view(spark, sf_dir, n) for n in views)), recursive(needs, body))


def _cuts(notes: DataFrame, songs: DataFrame, changes: DataFrame, signatures: DataFrame) -> DataFrame:
    return ch.chunk_cuts(ch.song_arrays(notes, songs, changes, signatures), SIZE, OVERLAP, LEAST, window=WINDOW)


NEEDS = "notes songs tempo_changes signatures"
TARGETS = "(SELECT song_id, (song_id % 7 + 8)::DOUBLE AS target FROM songs)"

add("TOP07", NEEDS, lambda n, s, c, g: ch.cut_points(n, s, c, g, s.select("song_id", (F.col("song_id") % 7 + 8.0).alias("target")), WINDOW),
    f"""{PLACES}, windows AS ({_window(TARGETS)})
SELECT w.song_id, target, round(coalesce(time, target), 6) AS cut FROM windows w LEFT JOIN ({_best("windows")}) b USING (song_id)""")  # fmt: skip

add_recursive("DAT07", NEEDS, lambda n, s, c, g: ch.chunked_notes(n.drop("l_orderkey", "l_partkey"), _cuts(n, s, c, g)),
    f"""{CUTS}, held AS (
  SELECT n.song_id, part, track_idx, pitch, velocity, greatest(start_tick, low) - low AS start_tick, least(end_tick, high) - low AS end_tick, start_tick < low OR end_tick > high AS truncated
  FROM notes n JOIN cuts c ON c.song_id = n.song_id AND start_tick <= high AND end_tick >= low)
SELECT song_id, dense_rank() OVER (PARTITION BY song_id ORDER BY part)::INT AS chunk, track_idx, pitch, velocity, start_tick, greatest(end_tick, start_tick + 1) AS end_tick, truncated FROM held""")  # fmt: skip

add_recursive("DAT07_cuts", NEEDS, lambda n, s, c, g: _cuts(n, s, c, g).select("song_id", F.posexplode("cuts").alias("part", "c")).select(
    "song_id", "part", F.round("c.start", 6).alias("start"), F.round("c.cut", 6).alias("cut"), "c.low", "c.high"),
    f"{CUTS} SELECT song_id, part, round(start, 6) AS start, round(cut, 6) AS cut, low, high FROM cuts")

add_recursive("DAT07_headers", NEEDS, lambda n, s, c, g: ch.chunk_headers(_cuts(n, s, c, g)),
    f"""{CUTS}, marks AS (SELECT song_id, 'tempo' AS kind, tick, bpm AS value FROM firsts UNION ALL SELECT song_id, 'measure', from_tick, measure::DOUBLE FROM meters),
inside AS (SELECT c.song_id, part, kind, tick - low AS tick, value FROM cuts c JOIN marks m ON m.song_id = c.song_id AND tick BETWEEN low AND high)
SELECT song_id, part, kind, tick, value FROM inside
UNION ALL
SELECT c.song_id, part, kind, 0, arg_max(value, tick) FROM cuts c JOIN marks m ON m.song_id = c.song_id AND tick < low
WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.song_id = c.song_id AND i.part = c.part AND i.kind = m.kind AND i.tick = 0) GROUP BY c.song_id, part, kind""")  # fmt: skip
