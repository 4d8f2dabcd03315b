import os

import pytest

from plumbline.llm import entry

SF = "/root/testdata/sf0.001"


def test_names():
    q = entry.queries()
    assert {f"p{n}_found" for n in (1, 2, 3, 5, 6, 7, 9, 10)} | {"p8_packing"} <= set(q) and set(entry.oracle_sql()) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(
    "name,columns",
    [("p1_found", ["file_id"]), ("p2_found", ["vec_lo", "vec_hi"]), ("p3_found", ["src", "row_id"]), ("p5_found", ["file_id"]), ("p6_found", ["src", "row_id", "line_no"]), ("p7_found", ["node_id", "field", "pos"]), ("p9_found", ["doc_id", "item_id"]), ("p10_found", ["doc_id"])],
)
def test_columns_and_rows_once(spark, name, columns):
    df = entry.queries()[name](spark, SF)
    assert df.columns == columns
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
