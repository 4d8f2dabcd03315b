import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions.ids import TYPE_PREFIXES, canonical_id, canonical_path
from pyspark.sql import functions as F


def canon(spark, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, id string")
    return [r[1] for r in rows.select("i", canonical_id(F.col("id"))).orderBy("i").collect()]


@pytest.mark.parametrize("given_id", ["function:src/auth.ts:login", "func:src/auth.ts:login", "function:function:src/auth.ts:login", "myproject:function:src/auth.ts:login", "Function:src\\auth.ts:login", " FUNC:src/auth.ts:login\t\n"])
def test_spellings_of_one_id(spark, given_id):
    assert canon(spark, [given_id]) == ["function:src/auth.ts:login"]


def test_null_blank_and_bare_ids(spark):
    assert canon(spark, [None, "", " \t", "src\\a.ts", "a:b", "file:"]) == [None, "", "", "src/a.ts", "a:b", "file:"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aF:\\ /." , max_size=8).map(lambda s: s), min_size=1, max_size=8), st.sampled_from(TYPE_PREFIXES))
def test_idempotent(spark, tails, prefix):
    ids = [f"{prefix}:{t}" for t in tails]
    once = canon(spark, ids)
    assert canon(spark, once) == once


def test_paths(spark):
    df = spark.createDataFrame([("./src\\a.py",), ("././b",), (None,)], "p string")
    assert [r[0] for r in df.select(canonical_path(F.col("p"))).collect()] == ["src/a.py", "b", None]
