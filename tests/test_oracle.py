"""Every registered query against its DuckDB oracle (sf0.001): same
columns, same row count, same values (order-insensitive, floats at 6
places)."""

import pytest

import __spark_entry__ as entry
from shardforge import catalog
from tests.conftest import SF_SMALL
from tools.check_oracle import digest

NAMES = sorted(catalog.queries())


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(NAMES)
    assert set(NAMES) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(entry.oracle_sql()[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(df.columns, s_rows)[0] == digest(d_cols, d_rows)[0]


def test_entry_runs(spark):
    out = entry.entry(spark)
    rows = out.collect()
    assert out.columns == ["shard", "rows", "distinct_keys", "mean_pixel"]
    n = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert sum(r["rows"] for r in rows) == n
    assert all(r["rows"] == r["distinct_keys"] for r in rows)
