"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public vocabulary files are by default; every function that reads one takes the path as a parameter.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: White space of the word rule used for sizes and quality rules.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: The word rule itself.
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where the setting is absent, a temporary one, and that only on one
    machine: a cluster's executors don't share the driver's folders."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read back from it."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df, written once as Parquet to the checkpoint folder and read from there: each use reads its own columns, with the same values."""
    path = f"{_checkpoint_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *tables: DataFrame) -> str:
    """name, with as many underscores after it as it takes to be no column of the tables."""
    while any(name.lower() == c.lower() for t in tables for c in t.columns):
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, whatever the optimizer does with repeated references."""
    return F.element_at(F.transform(F.array(value), body), 1)


def file_bytes(path: str) -> bytes:
    return Path(path).read_bytes()


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most_chars: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about most_chars bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)), nan=0)
        group = (np.cumsum(sizes) - sizes) // most_chars
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the memory of freed arrays goes back to the system. Spark keeps its Python workers between tasks and stages, beside the JVM and
    workers of other stages, and the allocators would keep what the largest batch took."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return then_release


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one) on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in the open interval (0, 1) from uint64 counters."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def buffers(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of a column of texts end to end, and the offsets of its values; nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return bytes(memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]), offsets - offsets[0]
