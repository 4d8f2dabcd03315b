from datetime import datetime as D

import pytest

from plumbline.operators import orphans, skew

EDGE = "pos bigint, source string, target string, type string, observed_at timestamp_ntz, source_2 string"
NODE = "id string, first_seen_at timestamp_ntz, pos bigint"


def frames(spark, edges, nodes, external=(), tombs=()):
    return (
        spark.createDataFrame([(*e, "clash") for e in edges], EDGE),
        spark.createDataFrame([(*n, 0) for n in nodes], NODE),
        spark.createDataFrame([(x,) for x in external], "id string"),
        spark.createDataFrame(list(tombs), "id string, deleted_at timestamp_ntz"),
    )


T = [D(2024, 1, i) for i in range(1, 10)]


def test_reasons_and_boundaries(spark):
    f = frames(
        spark,
        [(1, "file:a", "file:gone", "calls", T[4]), (2, "FILE:a", "file:late", "calls", T[4]), (3, "file:a", "module:ext/x", "calls", T[4]), (4, None, " ", "calls", T[4]), (5, "file:a", "file:none", "calls", T[4]), (6, "file:a", "file:gone", "calls", T[2]), (7, "file:late", "file:a", "calls", T[5])],
        [("file:a", T[0]), ("file:gone", T[0]), ("file:late", T[5]), ("file:late ", T[6]), (None, T[0])],
        ["module:ext/x"],
        [("file:gone", T[6]), ("File:gone", T[4])],
    )
    got = {(r.pos, r.endpoint, r.reason) for r in orphans.direct_orphans(*f).collect()}
    # Deleted at the very time of the edge counts as gone; first seen at that time as there.
    assert got == {(1, "target", "deleted"), (2, "target", "later"), (5, "target", "missing")}


def test_empty_tables(spark):
    none = frames(spark, [], [])
    assert orphans.direct_orphans(*none).count() == 0
    some = frames(spark, [(1, "file:a", "file:b", "calls", None)], [])
    assert orphans.direct_orphans(*some).count() == 2
    assert orphans.cascade(*none).count() == 0


def test_repeated_edges_give_a_row_each(spark):
    f = frames(spark, [(1, "file:x", None, "calls", T[0]), (2, "file:x", None, "calls", T[0])], [])
    assert orphans.direct_orphans(*f).count() == 2


def test_cascade_follows_containers(spark):
    edges = [
        (1, "file:missing", "class:a", "contains", T[3]),
        (2, "class:a", "function:b", "contains", T[3]),
        (3, "file:ok", "class:kept", "contains", T[3]),
        (4, "file:missing", "class:kept", "contains", T[3]),
        (5, "file:ok", "function:b", "calls", T[3]),
        (6, "file:ok", "class:kept", "calls", T[3]),
    ]
    f = frames(spark, edges, [(x, T[0]) for x in ("class:a", "function:b", "class:kept", "file:ok")])
    got = {(r.pos, r.endpoint): r.level for r in orphans.cascade(*f).collect()}
    assert got == {(1, "source"): 0, (4, "source"): 0, (1, "target"): 1, (2, "source"): 1, (2, "target"): 2, (5, "target"): 2}


def test_report_counts(spark):
    f = frames(spark, [(1, "file:x", "module:ext/none", "calls", T[0])], [])
    rows = {(r.ref_table, r.reason, r.endpoint, r.month): r.orphans for r in orphans.orphan_report(orphans.direct_orphans(*f)).collect()}
    assert rows == {("nodes", "missing", "source", "2024-01"): 1, ("external_nodes", "missing", "target", "2024-01"): 1}


@pytest.mark.parametrize("hot", [None, ["a"]])
def test_hot_join_gives_the_same_rows(spark, hot):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("b", 20)], "k string, w int")
    got = sorted((str(r.k), r.v, r.w) for r in skew.join_unique(left, right, "k", "left", hot).collect())
    assert got == [("None", 4, None), ("a", 1, 10), ("a", 2, 10), ("b", 3, 20), ("c", 5, None)]


def test_hot_keys_are_bounded(spark):
    df = spark.range(1000).selectExpr("if(id < 400, 'hot', cast(id as string)) as k")
    assert skew.hot_keys(df, "k", 1000, share=10, least=1) == ["hot"]


def test_report_of_direct_and_inherited_orphans(spark):
    edges = [(1, "file:missing", "class:a", "contains", T[3]), (2, "file:ok", "class:a", "calls", T[3])]
    f = frames(spark, edges, [(x, T[0]) for x in ("class:a", "file:ok")])
    rows = {(r.ref_table, r.kind, r.endpoint, r.month): r.orphans for r in orphans.cascade_report(orphans.cascade(*f)).collect()}
    assert rows == {("nodes", "direct", "source", "2024-01"): 1, ("nodes", "inherited", "target", "2024-01"): 2}
