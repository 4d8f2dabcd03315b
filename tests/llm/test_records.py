from datetime import datetime as D

from plumbline.llm import neighbours as N
from plumbline.llm import survivors as S

NODE = "pos bigint, id string, name string, summary string, tags array<string>, file_path string, origin string, updated_at timestamp_ntz, node_id string"


def n(pos, id_, summary, tags, path, origin="scan", day=1):
    return (pos, id_, "a.py", summary, tags, path, origin, D(2024, 1, day) if day else None, "clash")


def found(spark, rows):
    return {(r.node_id, r.field): r.pos for r in S.survivor_positions(spark.createDataFrame(rows, NODE)).collect()}


def test_precedence(spark):
    rows = [
        n(1, "file:a", "good", ["x"], "a.py", "scan", 1),
        n(2, "FILE:a", "newer guess", ["y"], "a.py", "guess", 9),
        n(3, " file:a", "n/a", ["untagged", ""], "-", "scan", 8),
        n(4, "file:a", "a.py", [], None, None, 7),
        n(5, "file:b", "one row", ["x"], "b.py"),
    ]
    assert found(spark, rows) == {("file:a", "summary"): 1, ("file:a", "tags"): 1, ("file:a", "file_path"): 1}


def test_ties_go_to_the_largest_pos_and_nulls_come_first(spark):
    rows = [n(1, "file:a", "x", ["t"], "p", "llm", 2), n(2, "file:a", "y", None, "p", "llm", 2), n(3, "file:a", "z", None, None, "llm", None)]
    assert found(spark, rows) == {("file:a", "summary"): 2, ("file:a", "tags"): 1, ("file:a", "file_path"): 2}


def test_only_guesses_and_nothing_usable(spark):
    rows = [n(1, "file:a", "TODO", None, " ", "guess", 1), n(2, "file:a", "guessed", [None], None, "guess", 2), n(3, None, "x", ["t"], "p"), n(4, "", "x", ["t"], "p")]
    assert found(spark, rows) == {("file:a", "summary"): 2}
    assert found(spark, []) == {}


def test_stand_ins(spark):
    rows = [(s,) for s in ("(none)", " N/A ", "—", "...", "tbd", "No summary available.", "Unknown", "none of these", "a note", "TODO later maybe")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(S.stand_in(S.F.col("s"))).collect()]
    assert got == [True] * 7 + [False] * 3


def test_truth_discovery_prefers_what_reliable_sources_say(spark):
    votes = []
    for i in range(30):
        votes += [(f"e{i}", "f", "true", "good", 1), (f"e{i}", "f", "true", "fair", 1), (f"e{i}", "f", f"odd{i}", "bad", 1)]
    votes += [("z", "f", "right", "good", 1), ("z", "f", "wrong", "bad", 1), ("t", "f", "b", "fair", 1), ("t", "f", "a", "fair", 1)]
    table = spark.createDataFrame(votes, "entity string, field string, value string, source string, votes bigint")
    found = S.discover_truth(table)
    got, trust = {r.entity: r.value for r in found.chosen.collect()}, dict(found.trust.collect())
    assert found.converged and not S.discover_truth(table, max_rounds=1).converged
    joined = S.discover_truth(table, broadcast_sources=1)
    assert sorted(joined.chosen.select("entity", "value").collect()) == sorted(found.chosen.select("entity", "value").collect())
    assert got["z"] == "right" and got["t"] == "a" and trust["good"] > trust["bad"]
    empty = S.discover_truth(table.limit(0))
    assert empty.chosen.count() == 0 and empty.trust.count() == 0 and empty.converged


VEC = "vec_id bigint, model string, embedding array<float>, v string"


def brute(rows, k, least):
    import numpy as np

    by = {}
    for i, m, e, _ in rows:
        if e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            by.setdefault(m, []).append((i, np.array(e) / np.linalg.norm(e)))
    out = set()
    for vs in by.values():
        size = max(len(x) for _, x in vs)
        vs = [(i, x) for i, x in vs if len(x) == size]
        for i, x in vs:
            near = sorted(((-round(float(x @ y), 5), j) for j, y in vs if j != i))[:k]
            out |= {(min(i, j), max(i, j)) for s, j in near if -s >= least}
    return out


def test_neighbours_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 24))
    rows = [(i, "m", [float(v) for v in centers[i % 20] + 0.35 * rng.normal(size=24)], "x") for i in range(600)]
    rows += [(i, "o", [float(v) for v in rng.normal(size=6)], "x") for i in range(600, 640)]
    rows += [(900, "m", None, "x"), (901, "m", [0.0] * 24, "x"), (902, "m", [1.0, 2.0], "x"), (903, "m", [float("nan")] * 24, "x")]
    df = spark.createDataFrame(rows, VEC)
    want = brute(rows[:-4], 10, 0.85)
    got = {tuple(r) for r in N.similar_pairs(N.nearest(df, 10, 0.85, list_size=50)).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    every = {tuple(r) for r in N.similar_pairs(N.nearest(df, 10, list_size=50)).collect()}
    true = brute(rows[:-4], 10, -1)
    assert len(every & true) >= 0.9 * len(true)


def test_equal_vectors(spark):
    rows = [(i, "m", [1.0 + (i % 3), 2.0 * (1 + (i % 3))], "x") for i in range(40)] + [(99, "m", [1.0, -1.0], "x")]
    got = N.nearest(spark.createDataFrame(rows, VEC), 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r.neighbour)
    assert all(len(v) == 3 and i not in v for i, v in by.items()) and len(by) == 41


def test_small_inputs(spark):
    assert N.nearest(spark.createDataFrame([], VEC)).count() == 0
    assert N.nearest(spark.createDataFrame([(1, "m", [1.0, 0.0], "x")], VEC)).count() == 0
    two = N.nearest(spark.createDataFrame([(1, "m", [1.0, 0.0], "x"), (2, "m", [2.0, 0.0], "x"), (2, "m", [2.0, 0.0], "x")], VEC)).collect()
    assert sorted((r.vec_id, r.neighbour) for r in two) == [(1, 2), (2, 1)]
