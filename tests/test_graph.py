import random

import pytest

from plumbline.operators import build, graph, incremental, layers, quality, search
from plumbline.sources import graph_io

N = "pos bigint, kind string, project string, id string, type string, name string, file_path string, summary string, tags array<string>, complexity string, language_notes string, origin string"
E = "pos bigint, kind string, project string, source string, target string, type string, direction string, weight float"


def node(pos, id_, type_="file", name=None, path=None, summary="s", tags=("t",), complexity="simple"):
    return (pos, "codebase", "p", id_, type_, name or id_, path, summary, list(tags) if tags is not None else None, complexity, None, "scan")


def edge(pos, s, t, type_="imports", w=0.5):
    return (pos, "codebase", "p", s, t, type_, "forward", w)


def tables(spark, nodes, edges):
    return graph.graph_nodes(spark.createDataFrame(nodes, N)), graph.graph_edges(spark.createDataFrame(edges, E))


def random_graph(spark, n=24, m=40, seed=3):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
    ids = [f"file:{i:02}" for i in range(n)]
    return (*tables(spark, [node(i, x) for i, x in enumerate(ids)], [edge(i, ids[a], ids[b]) for i, (a, b) in enumerate(pairs)]), ids, {(ids[a], ids[b]) for a, b in pairs})


def test_views_keep_last_node_and_first_edge(spark):
    n, e = tables(spark, [node(1, "file:a", name="old"), node(2, "FILE:a", name="new"), node(3, None)], [edge(5, "file:a", "file:b", w=0.1), edge(2, "file:a", "file:b", w=0.9), edge(3, "", "file:b")])
    assert [(r.id, r.name) for r in n.collect()] == [("file:a", "new")]
    assert [(r.source, r.pos) for r in e.collect()] == [("file:a", 2)]


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_neighbours_against_breadth_first_search(spark, depth):
    n, e, ids, pairs = random_graph(spark)
    und = {x: {b for a, b in pairs if a == x} | {a for a, b in pairs if b == x} for x in ids}
    dist, todo = {ids[0]: 0}, [ids[0]]
    for x in todo:
        for y in und[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    want = {k: v for k, v in dist.items() if 0 < v <= depth}
    got = graph.neighbours(n, e, spark.createDataFrame([(ids[0],)], "id string"), depth)
    assert {r.id: r.depth for r in got.nodes.collect()} == want


def test_shortest_path(spark):
    _, e = tables(spark, [node(0, "file:a")], [edge(0, "b", "a"), edge(1, "b", "d"), edge(2, "a", "c"), edge(3, "c", "d"), edge(4, "x", "y")])
    assert graph.shortest_path(e, "a", "d") == ["a", "b", "d"]
    assert graph.shortest_path(e, "a", "y") == []
    assert graph.shortest_path(e, "a", "a") == ["a"]


def test_topological_levels_and_cycles(spark):
    n, e = tables(spark, [node(i, f"file:{x}") for i, x in enumerate("abcdef")], [edge(0, "file:a", "file:b"), edge(1, "file:b", "file:c"), edge(2, "file:a", "file:c"), edge(3, "file:d", "file:e"), edge(4, "file:e", "file:d")])
    got = {r.id[-1]: r.level for r in graph.topological_levels(n, e).collect()}
    assert got == {"a": 0, "f": 0, "b": 1, "c": 2, "d": None, "e": None}


def test_blast_radius_and_explain(spark):
    n, e = tables(
        spark,
        [node(0, "file:a", path="src/a.py"), node(1, "function:a:f", "function"), node(2, "file:b", path="src/b.py"), node(3, "file:c")],
        [edge(0, "file:a", "function:a:f", "contains"), edge(1, "file:b", "function:a:f", "calls"), edge(2, "file:b", "file:c")],
    )
    b = graph.blast_radius(n, e, spark.createDataFrame([("./src\\a.py",), ("src/none.py",)], "file_path string"))
    assert {r.id for r in b.changed.collect()} == {"file:a", "function:a:f"}
    assert {r.id for r in b.affected.collect()} == {"file:b"}
    assert [r[0] for r in b.unmapped.collect()] == ["src/none.py"]
    roles = {r.id: r.role for r in graph.explain(n, e, "file:a").nodes.collect()}
    assert roles == {"file:a": "target", "function:a:f": "child", "file:b": "connected"}


def test_layers_by_path(spark):
    paths = ["src/routes/login.ts", "src/services/auth.ts", "src/models/user.ts", "src/components/Button.tsx", "src/utils/format.ts", "src/random/orphan.ts"]
    n, _ = tables(spark, [node(i, f"file:{p}", path=p) for i, p in enumerate(paths)], [edge(0, "a", "b")])
    got = {r.id: r.layer for r in layers.detect_layers(n).collect()}
    assert [got[f"file:{p}"] for p in paths] == ["API Layer", "Service Layer", "Data Layer", "UI Layer", "Utility Layer", "Core"]


def test_layer_patterns_first_match_wins(spark):
    paths = ["src/api/users.ts", "src/api/auth.ts", "src/services/payments.ts", "src/lib/format.ts"]
    n, _ = tables(spark, [node(i, f"file:{p}", path=p) for i, p in enumerate(paths)], [edge(0, "a", "b")])
    got = sorted(r.layer for r in layers.apply_patterns(n, [("API", ["src/api/"]), ("Service", ["src/services/"])]).collect())
    assert got == ["API", "API", "Other", "Service"]


def test_merge_rules(spark):
    rows = [node(1, "file:a", name="old-name", summary="old summary", tags=["alpha", "beta"]), node(2, "file:a", name="new-name", summary=" ", tags=["beta", "gamma"])]
    got = build.merge_nodes(spark.createDataFrame(rows, N)).first()
    assert (got["name"], got["summary"], got["tags"], got["rows"]) == ("new-name", "old summary", "alpha,beta,gamma", 2)
    # Of spellings of one id the one with the longer summary stays whole.
    spelled = [*rows, node(3, "FILE:a", name="other", summary="a much longer summary", tags=["delta"])]
    got = build.merge_nodes(spark.createDataFrame(spelled, N)).collect()
    assert [(r["id"], r["name"], r["summary"], r["tags"], r["rows"]) for r in got] == [("file:a", "other", "a much longer summary", "delta", 3)]
    es = [edge(1, "file:a", "file:b", w=0.3), edge(2, "file:a", "file:b", w=0.9), edge(3, "file:a", "file:b", w=float("nan"))]
    best = build.merge_edges(spark.createDataFrame(es, E)).first()
    assert (round(best["weight"], 3), best["pos"], best["rows"]) == (0.9, 2, 3)


def test_normalise_rewrites_and_drops(spark):
    ns = [node(1, "func:a.ts:login", "function"), node(2, "function:a.ts:helper", "function")]
    es = [edge(1, "func:a.ts:login", "function:a.ts:helper", "calls"), edge(2, "function:a.ts:login", "function:a.ts:helper", "calls"), edge(3, "function:a.ts:login", "file:none")]
    got = build.normalise(spark.createDataFrame(ns, N), spark.createDataFrame(es, E))
    assert [(r.source, r.pos) for r in got.edges.collect()] == [("function:a.ts:login", 1)]
    s = got.statistics.first()
    assert (s.ids_fixed, s.edges_rewritten, s.missing_target, s.missing_source) == (1, 1, 1, 0)


def test_validation_codes(spark):
    ns = spark.createDataFrame([node(1, "file:a"), node(2, "file:a"), node(3, "file:b", tags=[], summary=" ")], N)
    es = spark.createDataFrame([edge(1, "file:a", "file:none", w=1.5), edge(2, "file:x", "file:a", w=float("nan"))], E)
    members = spark.createDataFrame([("file:a", "l1"), ("file:a", "l2"), ("file:gone", "l1")], "id string, layer_id string")
    got = {(r.code, r.issues) for r in quality.summary(quality.validate(ns, es, members)).collect()}
    assert got == {
        ("DUPLICATE_NODE_ID", 1), ("MISSING_SOURCE_NODE", 1), ("MISSING_TARGET_NODE", 1), ("INVALID_EDGE_WEIGHT", 2), ("MISSING_TAGS", 1), ("MISSING_SUMMARY", 1),
        ("NODE_IN_MULTIPLE_LAYERS", 1), ("FILE_NODE_NOT_IN_LAYER", 1), ("ORPHAN_NODE", 1), ("LAYER_MISSING_NODE", 1),
    }


def test_search(spark):
    n, e = tables(spark, [node(1, "file:login", name="login", tags=["auth"]), node(2, "file:render", name="render", tags=None), node(3, "function:foo", "function", name="foo")], [edge(0, "file:login", "file:render", "calls")])
    assert [r.id for r in search.token_search(n, "LOGIN auth").collect()] == ["file:login"]
    assert search.token_search(n, "  ").count() == 0
    top = search.ranked_search(n, "login").collect()
    assert top[0].id == "file:login" and top[0].score < 0.95
    assert search.ranked_search(n, "zzzqxv").count() == 0
    assert {r.id for r in search.expand_hits(search.token_search(n, "auth"), e, n).collect()} == {"file:login", "file:render"}


def test_vector_order(spark):
    v = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.7, 0.7]), (3, [1.0])], "vec_id bigint, embedding array<float>")
    got = search.vector_top(v, spark.createDataFrame([([1.0, 0.1],)], "v array<double>"), 0).collect()
    assert [r.vec_id for r in got] == [1]


def test_change_plan(spark):
    old = spark.createDataFrame([("p", "a/x", "1"), ("p", "a/y", "1"), ("p", "b/z", "1")], "project string, path string, hash string")
    new = spark.createDataFrame([("p", "a/x", "2"), ("p", "a/y", "1"), ("p", "c/n", "1")], "project string, path string, hash string")
    ch = incremental.changes(old, new)
    assert {r.path: r.change for r in ch.collect()} == {"a/x": "changed", "a/y": "same", "b/z": "deleted", "c/n": "new"}
    n, _ = tables(spark, [node(i, f"file:{i}") for i in range(40)], [edge(0, "a", "b")])
    r = incremental.plan(ch, n).first()
    assert (r.action, r.new_directories, r.nodes) == ("ARCHITECTURE", 1, 40)


def test_upsert_and_cache(spark):
    a = spark.createDataFrame([("n", "m", "h1", 1)], "node_id string, model string, text_hash string, updated_at bigint")
    b = spark.createDataFrame([("n", "m", "h2", 2), ("o", "m", "h3", 1)], a.schema)
    got = {(r.node_id, r.text_hash) for r in incremental.upsert(a, b, ["node_id", "model"], "updated_at").collect()}
    assert got == {("n", "h2"), ("o", "h3")}
    assert [r.node_id for r in incremental.embed_work(b, a).collect()] == ["n", "o"] or {r.node_id for r in incremental.embed_work(b, a).collect()} == {"n", "o"}


def test_save_and_load(spark, tmp_path):
    ns = spark.createDataFrame([(i, "codebase", f"file:{i}", "odd" if i == 0 else "file", f"m{i}", None, "s", ["t"], "simple", None) for i in range(5)], graph_io.NODE_SCHEMA)
    es = spark.createDataFrame([(0, "codebase", "file:0", "file:1", "imports", None, None, None), (1, "codebase", "file:0", "file:9", "imports", None, None, 0.5)], graph_io.EDGE_SCHEMA)
    graph_io.save_graph(ns, es, str(tmp_path / "g"))
    n, e = graph_io.load_graph(spark, str(tmp_path / "g"), "codebase")
    assert n.count() == 5 and n.where("id = 'file:0'").first().type == "file"
    assert [(r.source, r.target, r.direction, r.weight) for r in e.collect()] == [("file:0", "file:1", "forward", 1.0)]
    with pytest.raises(ValueError):
        graph_io.load_graph(spark, str(tmp_path / "g"), "other")
    layers_ = spark.createDataFrame([("codebase", "layer:api", "API", "d", 0, "file:1"), ("domain", "layer:x", "X", None, 0, "file:2")], graph_io.LAYER_SCHEMA)
    steps = spark.createDataFrame([("codebase", 1, "API", "first", i, f"file:{i}") for i in range(3)], graph_io.TOUR_SCHEMA)
    project = spark.createDataFrame([("codebase", "p", ["go"], [], None, "2024", "abc")], graph_io.PROJECT_SCHEMA)
    assert graph_io.save_graph(ns, es, str(tmp_path / "g"), layers_, steps, project) == 2
    saved = graph_io.load_saved(spark, str(tmp_path / "g"), "codebase")
    assert saved.layers.collect() == layers_.where("kind = 'codebase'").collect() and sorted(saved.tour.collect()) == sorted(steps.collect()) and saved.project.collect() == project.collect()
    assert graph_io.load_saved(spark, str(tmp_path / "g"), version=1).tour.count() == 0
    # A version that was not finished is not seen.
    (tmp_path / "g" / "v3" / "nodes").mkdir(parents=True)
    assert graph_io.load_saved(spark, str(tmp_path / "g")).layers.count() == 2
    with pytest.raises(ValueError):
        graph_io.load_graph(spark, str(tmp_path / "none"))
    graph_io.export_json(ns, es, str(tmp_path / "k"), layers_, steps, project)
    back = graph_io.import_saved(spark, str(tmp_path / "k"))
    assert sorted(back.layers.collect()) == sorted(layers_.collect()) and sorted(back.tour.collect()) == sorted(steps.collect()) and back.project.collect() == project.collect()
    graph_io.export_json(ns, es, str(tmp_path / "j"))
    assert graph_io.import_json(spark, str(tmp_path / "j"), "domain")[0].first().kind == "domain"


def test_git_status_and_settings(tmp_path):
    text = "# branch.oid x\0" + "1 .M N... 100644 100644 100644 a b src/lib.rs\0" + "2 R. N... 100644 100644 100644 a b R100 new name.rs\0old.rs\0" + "? fresh\0! ignored\0"
    assert graph_io.git_changes(text) == ["src/lib.rs", "new name.rs", "fresh"]
    p = tmp_path / "s.json"
    p.write_text('{"batch_size": 8}')
    s = graph_io.Settings.load(str(p), concurrency=2)
    assert (s.batch_size, s.concurrency, s.full_threshold) == (8, 2, 30)
    p.write_text('{"nope": 1}')
    with pytest.raises(ValueError):
        graph_io.Settings.load(str(p))


def test_walk_project(spark, tmp_path):
    for name, text in {"a.py": "x", "sub/b.py": "y", ".hidden/c.py": "z", "node_modules/d.js": "w", "gen/e.py": "v"}.items():
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True, parents=True)
        f.write_text(text)
    (tmp_path / ".gitignore").write_text("# no\ngen/\n")
    got = {r.path: r.content for r in graph_io.walk_project(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x", "sub/b.py": "y"}


def test_shortest_path_never_ends_early_in_silence(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "calls") for i in range(6)], "source string, target string, type string")
    with pytest.raises(RuntimeError):
        graph.shortest_path(e, "n0", "n5", max_rounds=2)
    assert len(graph.shortest_path(e, "n0", "n5")) == 6


def test_fuzzy_search(spark):
    rows = [node(1, "function:a.rs:login", name="login", summary="logs the user in", tags=["auth"]), node(2, "function:b.rs:handler", name="handler", summary="", tags=["ui"]), node(3, "function:c.rs:h", name="h-a-n-d-l-e-r-x", summary="", tags=[])]
    n = spark.createDataFrame(rows, N)
    find = lambda q, **k: [r.id.rsplit(":", 1)[1] for r in search.ranked_search(n, q, **k).collect()]
    assert find("login")[0] == "login" and find("auth")[0] == "login" and find("hndlr") == ["handler", "h"] and find("rldnh") == [] and find(" ") == []
    assert find("handler")[0] == "handler" and find("h.*r") == [] and find("login", node_type="class") == []


def test_tour_gives_nodes(spark):
    ns = [node(i, f"file:{x}") for i, x in enumerate("abcde")] + [node(9, "concept:k", "concept")]
    n, e = spark.createDataFrame(ns, N), spark.createDataFrame([edge(1, "file:a", "file:b", "imports"), edge(2, "file:b", "file:c", "imports")], E)
    levels = graph.topological_levels(n.where("type = 'file'"), e)
    members = spark.createDataFrame([("file:c", "layer:x", "X"), ("file:a", "layer:y", "Y"), ("file:b", "layer:y", "Y")], "id string, layer_id string, layer string")
    show = lambda df: [(r.step, r.title, r.id) for r in df.orderBy("step", "rank").collect()]
    got = show(build.tour_nodes(levels, members, n))
    assert got == [(1, "Y", "file:a"), (1, "Y", "file:b"), (2, "X", "file:c"), (3, "Supporting Components", "file:d"), (3, "Supporting Components", "file:e"), (4, "Key Concepts", "concept:k")]
    flat = show(build.tour_nodes(levels, members.limit(0), n))
    assert [(s, i[-1]) for s, _, i in flat] == [(1, "a"), (1, "d"), (1, "e"), (2, "b"), (2, "c"), (3, "k")] and flat[3][1] == "Step 2: Code Walkthrough"


def test_long_chains_end_or_raise(spark):
    size = 70
    n = spark.createDataFrame([node(i, f"file:{i:03}") for i in range(size)], N)
    e = spark.createDataFrame([edge(i, f"file:{i:03}", f"file:{i + 1:03}", "imports") for i in range(size - 1)], E)
    far = graph.reach(e, spark.createDataFrame([("file:000",)], "id string"), ("imports",))
    assert {r.id: r.depth for r in far.collect()} == {f"file:{i:03}": i for i in range(size)}
    with pytest.raises(RuntimeError):
        graph.topological_levels(n, e, max_rounds=3)


def test_join_ends_with_a_hot_target(spark, monkeypatch):
    from plumbline.operators import skew

    edges = spark.createDataFrame([(f"s{i}", "hub" if i % 3 else f"t{i}", i) for i in range(300)] + [(None, "hub", 300)], "source string, target string, n int")
    nodes = spark.createDataFrame([("hub", "H"), *((f"s{i}", f"S{i}") for i in range(0, 300, 2))], "id string, name string")
    real = skew.hot_keys
    monkeypatch.setattr(skew, "hot_keys", lambda df, key, rows: real(df, key, rows, least=50))
    got = {r.n: (r.a, r.b) for r in skew.join_ends(edges, nodes, {"name": "a"}, {"name": "b"}, "left").collect()}
    assert len(got) == 301 and got[1] == (None, "H") and got[2] == ("S2", "H") and got[3] == (None, None) and got[300] == (None, "H")
    assert skew.join_ends(edges, nodes, {"name": "a"}, {"name": "b"}).count() == sum(1 for i in range(0, 300, 2) if i % 3)
