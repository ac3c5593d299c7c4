"""A reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking, in SQL functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let

#: Buckets of rows that are numbered apart, Feistel rounds, and walks back into range (the share of numbers out of range is under
#: 1 / sqrt(rows), and there are under sqrt(rows) of them, so no walk is as long as this).
BUCKETS, ROUNDS, WALKS = 4096, 6, 48


def numbered(rows: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """rows with global numbers `row_number` 0, 1, ... that depend on the rows' values only, and the number of `rows`.

    Rows are ordered by (bucket of the key's hash, key, ties). Bucket sizes come from the key column alone; their running sums
    are a table of at most BUCKETS rows. Rows that agree in key and ties are interchangeable.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    sizes = rows.select(bucket.alias("bucket")).groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"), F.sum("count").over(everything).alias("rows"))
    within = Window.partitionBy("bucket").orderBy(F.col(key).asc_nulls_first(), *ties)
    out = rows.withColumn("bucket", bucket).withColumn("place", F.row_number().over(within) - 1)
    return out.join(F.broadcast(offsets), "bucket").withColumn("row_number", F.col("offset") + F.col("place")).drop("bucket", "place", "offset")


def _turn(i: int, seed: int, a: Column, b: Column) -> Callable[[Column], Column]:
    """Round i on a pair of digits: the left one changes in even rounds, the right one in odd rounds."""

    def odd(p: Column) -> Column:
        return F.struct(p["l"].alias("l"), F.pmod(p["r"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), p["l"]), b), b).alias("r"))

    def even(p: Column) -> Column:
        return F.struct(F.pmod(p["l"] + F.pmod(F.xxhash64(F.lit(seed), F.lit(i), p["r"]), a), a).alias("l"), p["r"].alias("r"))

    return odd if i % 2 else even


def permuted(number: Column, n: Column, seed: int) -> Column:
    """The place of number in a seeded permutation of 0 .. n - 1.

    Numbers are written as a pair (left, right) of digits below a = ceil(sqrt(n)) and b = ceil(n / a). Each round adds a
    hash of one digit to the other, which is a permutation of the a * b pairs. A result of n or more is permuted again.
    """
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1)).cast("long")
    b = F.ceil(n.cast("double") / a).cast("long")

    def rounds(x: Column, a: Column, b: Column) -> Column:
        pair = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        for i in range(ROUNDS):
            pair = let(pair, _turn(i, seed, a, b))
        return let(pair, lambda p: p["l"] * b + p["r"])

    once = rounds(number, a, b)
    walked = let(once, lambda y: F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), y, lambda acc, _: F.when(acc < n, acc).otherwise(rounds(acc, a, b)))))
    return let(walked, lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("permutation left its range"))).cast("long"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 29, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The shard and slot of every row, under the law `rows`: counts differ by at most one, slots run from 0 without gaps.

    Columns: key, size (UTF-8 bytes of the text, null as none, plus 8), text_crc32, law, shard, slot, grown_shard (null under
    this law), row_number, position (shuffled place; shard and slot are its remainder and quotient by the shard count).
    Texts are read once and not shuffled. Null keys are rows like others; repeated rows get slots of their own. An
    empty table gives an empty result. Other columns are dropped.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32"))
    out = numbered(rows, "k", ["text_crc32", "size"])
    out = out.withColumn("position", permuted(F.col("row_number"), F.col("rows"), seed))
    return out.select(
        F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), (F.col("position") % shards).cast("int").alias("shard"),
        ((F.col("position") - F.col("position") % shards) / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )
