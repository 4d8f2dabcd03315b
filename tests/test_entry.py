import glob
import os
from collections import Counter

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["pos", "endpoint"] and df.count() >= 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["p4_found", "degree_top", "layer_edge_aggregation", "validation_summary", "search_ranked", "change_plan"])
def test_against_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = Counter(str(tuple(r)) for r in df.select(*columns).collect())
    assert got == Counter(str(r) for r in want.fetchall())
