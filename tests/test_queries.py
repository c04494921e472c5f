"""Every query with SQL gives the same rows as DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from runledger import plans

SF = "/root/testdata/sf0.001"


def same(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(same(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_oracle(spark, name):
    df = entry.queries()[name](spark, SF)
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(want.columns, want.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["user_id", "verdict", "k"]


def test_null_verdict_blocks(spark):
    from runledger.operators import ladders

    df = spark.createDataFrame([(1, None), (2, "verified"), (3, "violated")], "unit int, verdict string")
    assert sorted(r.unit for r in ladders.blocking(df).collect()) == [1, 3]


def test_all_unknown_settles_on_the_last_rung(spark):
    from runledger.operators import ladders

    df = spark.createDataFrame([(1, 4, "unknown"), (1, 8, "unknown"), (2, 4, "unknown"), (2, 8, "verified"), (2, 16, "violated")], "unit int, k int, verdict string")
    assert sorted(map(tuple, ladders.settled(df, "unit", ["k"]).collect())) == [(1, "unknown", 8), (2, "verified", 8)]
