"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of times each of its documents is due. Every document is taken the whole part
of that number of times; the fraction is rounded so that the words taken stay at the target. In a pair of documents with
fractions left, one fraction rises and the other falls, by amounts that keep the pair's words and all expectations, until one
is 0 or 1. Blocks of a source are worked off in parallel, each leaves one fraction at most, and what is left goes up a tree.
The last fraction of a source goes to the nearer whole number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, checkpointed, fresh, mix64, stored

#: Weights of the sources in code point order, repeated, and how often a source can be taken in whole.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents in a block, blocks whose rests meet in one node of the tree, and sources up to which their table is broadcast.
BLOCK, FAN, FEW_SOURCES = 4096, 256, 10_000
#: Parts in which rows that are alike are numbered.
PARTS = 256
_EPS = 1e-9
_ROW = "r long, k {key}, source string, size long, source_size long, target double, whole long, part double, block long, draw long"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source (null is one, the last): source_size, documents, target.

    Targets share all words by weight, but none is over most times its source's size: in ascending order of that bound per
    weight, sources are full while the bound is below what the rest would get; the others share what is left.
    The windows run over the table of sources, one row each.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    ranked = sums.withColumn("weight", weight).withColumn("bound", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", rest / left)
    full = F.col("bound") <= F.col("weight") * F.col("level")
    levels = levels.withColumn("full", full)
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return levels.select("source", "source_size", "documents", F.when(F.col("full"), F.col("bound")).otherwise(F.col("weight") * level).alias("target"))


def pivot(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """parts with all but one at most rounded to 0 or 1, sum(sizes * parts) as it was. draws: uniform numbers, one per row."""
    out = parts.tolist()
    size, draw, held = sizes.tolist(), draws.tolist(), -1
    for i, p in enumerate(out):
        if p <= _EPS or p >= 1 - _EPS:
            out[i] = 0.0 if p <= _EPS else 1.0
            continue
        if held < 0:
            held = i
            continue
        a, b, ratio = out[held], p, size[i] / size[held]
        rise, fall = min(1 - a, b * ratio), min(a, (1 - b) * ratio)
        move = rise if draw[i] * (rise + fall) < fall else -fall
        a, b = a + move, b - move / ratio
        a, b = (0.0 if x <= _EPS else 1.0 if x >= 1 - _EPS else x for x in (a, b))
        out[held], out[i] = a, b
        held = held if 0 < a < 1 else i if 0 < b < 1 else -1
    return np.array(out, np.float64)


def _uniform(draw: pd.Series, level: int) -> np.ndarray:
    x = draw.to_numpy(np.int64).view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dealt(rows: DataFrame, seed: int) -> DataFrame:
    """rows (r, k, source, size, h, documents and others) with draw and block, both by a hash of the row's values and its number among
    rows alike, so a key on many rows spreads over all blocks. Rows alike are numbered in PARTS parts, whose sums give what
    comes before each; which of them has which number makes no difference.
    """
    rows = rows.withColumn("g", F.xxhash64(F.lit(seed), "source", "k", "size", "h")).withColumn("part_of", F.pmod(F.xxhash64("r"), F.lit(PARTS)))
    counts = rows.groupBy("g", "part_of").agg(F.count("*").alias("n"))
    before = Window.partitionBy("g").orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("g", "part_of", F.sum("n").over(before).alias("offset")).where("offset > 0")
    place = F.row_number().over(Window.partitionBy("g", "part_of").orderBy("r"))
    numbered = rows.withColumn("place", place).join(offsets, ["g", "part_of"], "left").withColumn("nth", F.col("place") + F.coalesce("offset", F.lit(0)))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), "g", "nth"), F.ceil(F.col("documents") / BLOCK)).cast("long")
    return numbered.withColumn("draw", F.xxhash64(F.lit(seed), "g", "nth")).withColumn("block", block).drop("g", "part_of", "place", "offset", "nth")


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 5, row: str | None = None) -> DataFrame:
    """One row per row of docs: r (the column row, or its number in docs as read), key, size, source_size, target, taken, copies.

    Null texts have no words; a document without words is taken once if its source is due at all, which adds no words.
    Documents are put in blocks and in order by a hash of their values, their number among rows alike and the seed, so
    results don't depend on how the table is split. Other columns are dropped. docs is read once.
    """
    kind = docs.schema[key].dataType.simpleString()
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    sized = checkpointed(docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("r"), F.col(key).alias("k"), F.col(source).cast("string").alias("source"), words.alias("size"), F.xxhash64(text).alias("h")))
    targets = checkpointed(source_targets(sized))
    n_sources, largest = targets.agg(F.count("*"), F.max("documents")).first()
    if n_sources <= FEW_SOURCES:
        targets = F.broadcast(targets)
    due = F.when(F.col("size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.when(F.col("target") > 0, 1.0).otherwise(0.0))
    rows = sized.alias("d").join(targets.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).drop(F.col("s.source"))
    whole = F.floor(due + _EPS)
    rows = rows.withColumn("whole", whole.cast("long")).withColumn("part", F.greatest(due - whole, F.lit(0.0)))
    rows = dealt(rows, seed)
    rows = rows.select("r", "k", "source", "size", "source_size", "target", "whole", "part", "block", "draw")
    schema = _ROW.format(key=kind)

    def work(level: int, last: bool):  # noqa: ANN202
        def run(group: pd.DataFrame) -> pd.DataFrame:
            # long documents first, by powers of two, so that what is left in the end is a short one
            group = group.assign(_long=-np.log2(np.maximum(group["size"], 1)).astype(int)).sort_values(["_long", "draw", "k", "size", "r"]).drop(columns="_long")
            u = _uniform(group["draw"], level)
            part = pivot(group["size"].to_numpy(), group["part"].to_numpy(), u)
            if last:
                part = np.rint(part)
            return group.assign(part=part, block=group["block"] // FAN)

        return run

    blocks, level, done = -(-(largest or 1) // BLOCK), 0, []
    while True:
        last = blocks == 1
        rows = checkpointed(rows.groupBy("source", "block").applyInPandas(work(level, last), schema))
        settled = (F.col("part") == 0) | (F.col("part") == 1)
        done.append(rows.where(settled))
        if last:
            break
        rows, blocks, level = rows.where(~settled), -(-blocks // FAN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("whole") + F.col("part")).cast("long")
    return out.select("r", F.col("k").alias(key), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 5) -> DataFrame:
    """docs with every row as often as decide() takes it; all columns as they were. docs is read once and stored with row numbers. Texts go through one join."""
    r, n, nth = (fresh(c, docs) for c in ("_r", "_copies", "_copy"))
    rows = stored(docs.withColumn(r, F.monotonically_increasing_id()))
    copies = decide(rows, key, text, source, seed, r).where("copies > 0").select(F.col("r").alias(r), F.col("copies").alias(n))
    return rows.join(copies, r).withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
