"""Two note tables read song by song after one shuffle.

Notes are shuffled as bytes: a task packs its notes of a song into pieces, each column as narrow as its values allow, so a note takes some
7 bytes instead of a row of 60. Song numbers, ticks, pitches, tracks and velocities are whole numbers; any of them may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .compare import ORDER

#: Notes that a task packs together, and the most in a piece. They bound memory, not results.
MOST_ROWS, MOST_NOTES = 1 << 19, 1 << 10
#: Songs of one output batch.
MOST_SONGS = 1000
#: What stands for null, below all values, so that nulls come first in note order.
NONE = np.iinfo(np.int64).min
_WIDTHS = (1, 2, 4, 8)
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
_PIECE = pa.schema([("song_id", pa.int64()), ("side", pa.int8()), ("layout", pa.int32()), ("notes", pa.binary())])


def _layout(code: int) -> np.dtype:
    """Columns of a piece: two bits of its code a column say how wide it is."""
    return np.dtype([(c, f"<i{_WIDTHS[code >> 2 * i & 3]}") for i, c in enumerate(ORDER)])


def _width(values: np.ndarray) -> int:
    lo, hi = int(values.min()), int(values.max())
    return next(i for i, w in enumerate(_WIDTHS) if -(1 << 8 * w - 1) <= lo and hi < 1 << 8 * w - 1)


def _pieces(held: list[pa.RecordBatch], side: int) -> pa.RecordBatch:
    """One row a song and piece of the notes held."""
    table = pa.Table.from_batches(held)
    song = table.column("song_id").combine_chunks()
    unknown, number = song.is_null().to_numpy(zero_copy_only=False), song.fill_null(0).to_numpy(zero_copy_only=False)
    order = np.lexsort((number, ~unknown)) if unknown.any() else np.argsort(number, kind="stable")
    unknown, number = unknown[order], number[order]
    columns = {c: table.column(c).combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False) for c in ORDER}
    code = sum(_width(v) << 2 * i for i, v in enumerate(columns.values()))
    notes = np.empty(len(order), _layout(code))
    for c, v in columns.items():
        notes[c] = v[order]
    changes = np.flatnonzero((np.diff(number) != 0) | (np.diff(unknown.view(np.int8)) != 0)) + 1
    cuts = np.union1d(changes, np.arange(0, len(order), MOST_NOTES))
    ends = (np.append(cuts, len(order)) * notes.itemsize).astype(np.int32)
    own = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(ends), pa.py_buffer(notes)])
    alike = lambda x, kind: pa.array(np.full(len(cuts), x), kind)
    return pa.RecordBatch.from_arrays([pa.array(number[cuts], pa.int64(), mask=unknown[cuts]), alike(side, pa.int8()), alike(code, pa.int32()), own], schema=_PIECE)


def packed(notes: DataFrame, side: int) -> DataFrame:
    """song_id, side, layout and notes: pieces of a song's notes as bytes. A song has one or more from each task that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= MOST_ROWS:
                yield _pieces(held, side)
                held, n = [], 0
        if held:
            yield _pieces(held, side)

    return notes.select(*(F.col(c).cast("long").alias(c) for c in ("song_id", *ORDER))).mapInArrow(run, "song_id long, side byte, layout int, notes binary")


class Side:
    """A song's notes of one side in note order: an array of doubles a column, NaN for null."""

    __slots__ = ("end_tick", "pitch", "start_tick", "track_idx", "velocity")

    def __init__(self, pieces: list[np.ndarray]) -> None:
        columns = [np.concatenate([p[c] for p in pieces]).astype(np.int64) if pieces else np.zeros(0, np.int64) for c in ORDER]
        order = np.lexsort(columns[::-1])
        for name, values in zip(ORDER, columns, strict=True):
            x = values[order].astype(np.float64)
            x[x == NONE] = np.nan
            setattr(self, name, x)

    def __len__(self) -> int:
        return len(self.pitch)


def _songs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Side, Side]]:
    song, held = None, ([], [])
    for b in batches:
        layouts: dict[int, np.dtype] = {}
        for number, side, code, notes in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
            if number != song:
                if held[0] or held[1]:
                    yield song, Side(held[0]), Side(held[1])
                song, held = number, ([], [])
            layout = layouts.get(code) or layouts.setdefault(code, _layout(code))
            held[side].append(np.frombuffer(notes.as_buffer(), layout))
    if held[0] or held[1]:
        yield song, Side(held[0]), Side(held[1])


def each_song(a: DataFrame, b: DataFrame, *metrics: tuple[str, Callable[[Side, Side], tuple]]) -> DataFrame:
    """song_id and the columns of all metrics (their schema, and what gives a row of them from a song's two sides), one row a song of either side. NaN becomes null.

    Both sides are shuffled once, as packed(); nothing else is. A task holds one song's notes.
    """
    schema = ", ".join(["song_id long", *(s for s, _ in metrics)])
    functions = [f for _, f in metrics]
    rows = packed(a, 0).unionByName(packed(b, 1)).repartition("song_id").sortWithinPartitions("song_id", "side")
    fields = StructType.fromDDL(schema)
    names, types = fields.names, [_ARROW[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = zip(*found, strict=True) if found else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip(columns, types, strict=True)], names)

        for song, x, y in _songs(batches):
            found.append((song, *(v for f in functions for v in f(x, y))))
            if len(found) >= MOST_SONGS:
                yield out()
                found = []
        yield out()

    return rows.mapInArrow(run, schema)
