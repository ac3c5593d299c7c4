"""Queries of the subpackage that have SQL, against DuckDB on the same tables, and on texts that are null, empty or repeated."""

from pathlib import Path

import duckdb
import pytest

from stavework.llm import queries

SF = "/root/testdata/sf0.01"
#: Nulls, repeated rows, equal texts, escapes, template phrases with a word too many, characters beyond 16 bits.
ROWS = [
    (3, "the MIT License, and the mit license again; GNU General Public License"), (1, None), (2, ""), (5, "a b c d e " * 9), (5, "a b c d e " * 9), (None, "free text without a key"),
    (6, None), (29, " "), (37, "lone"), (40, "no word is said twice in these few lines\t" * 9), (10, "the rose is red " * 30 + "end"), (27, "one two three four five six seven eight nine ten " * 4), (51, "a " * 40),
    (8, "Licensed under the Apache license, version 2 0 \U0001f600\U0001f600 café!!\nx\nx\n\nWOW?! ok. "), (7, "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software"), (-4, "short"),
]
AIMS = [(1, "the MIT license is a rose"), (2, None), (3, "caf\u00e9 Apache software")]
CHATS = [(1, 1, "user", "a <|b <\\|c"), (1, 2, "assistant", None), (1, 2, "assistant", "<|im_end|>\n"), (1, 2, "assistant", "<|im_end|>\n"), (2, None, "r\\n\n<|", "x"), (3, 0, None, "café \U0001f600")]


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def compare(spark, name, folder):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{source}'")
    df = queries.queries()[name](spark, str(folder))
    cursor = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_whole_tables(spark, name):
    compare(spark, name, SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows(spark, tmp_path, name):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(AIMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    compare(spark, name, tmp_path)
