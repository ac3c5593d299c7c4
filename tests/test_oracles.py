"""Every registered query with SQL, against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from stavework.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def number(x):
    """A float or decimal as a float, without a sign of zero; NaN is null."""
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return None if math.isnan(x) else float(x) + 0.0
    return x


def rows(columns, values):
    """Rows with columns by name, in an order that the last places of floats don't decide."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([number(v[i]) for i in order] for v in values), key=lambda r: repr([f"{x:.4g}" if isinstance(x, float) else x for x in r]))


def same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, other, name):
    df = registry.queries()[name](spark, SF)
    cursor = other.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    found, wanted = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, expected)
    assert len(found) == len(wanted)
    assert [(f, w) for f, w in zip(found, wanted, strict=True) if not all(map(same, f, w))] == []
