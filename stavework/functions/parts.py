"""Tables of one row a key put together without joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def met(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of the first part with the columns of the others, null where a part has no such key: what left joins give, if no part has a key twice.

    Parts meet as rows, not by joins: joined by a key that all are parted by they'd be one stage, whose tasks hold the sorts and windows of all
    parts at once. The key is wrapped so that they don't pass for parted alike, and each part keeps its own tasks; only a row a
    key and part is shuffled. Keys with a null in the first part get nothing from the others, as with a join.
    """
    own = [[c for c in p.columns if c not in key] for p in parts]
    rows = None
    for i, (p, columns) in enumerate(zip(parts, own, strict=True)):
        here = (p.dropna(subset=key) if i else p).select(F.struct(*key).alias("_key"), F.lit(i == 0).alias("_first"), *columns)
        rows = here if rows is None else rows.unionByName(here, allowMissingColumns=True)
    every = [c for columns in own for c in columns]
    return rows.groupBy("_key").agg(F.bool_or("_first").alias("_first"), *(F.max(c).alias(c) for c in every)).where("_first").select("_key.*", *every)
