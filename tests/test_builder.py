from plumbline.functions import parsers
from plumbline.operators import builder

FILES = [
    (1, "p", "src/app.py", "python", "from .lib import util\nimport pkg.mod\n\ndef main(a):\n    util(a)\n    helper()\n\ndef helper():\n    pass\n\nclass App:\n    def run(self):\n        main(1)\n"),
    (2, "p", "src/lib.py", "python", "def util(x):\n    return x\n"),
    (3, "p", "pkg/mod.py", "python", ""),
    (4, "p", "./web\\a.ts", "typescript", "import { b } from './sub/../b';\nexport function go(x: number) {}\n"),
    (5, "p", "web/b.ts", "typescript", "export const b = (y) => y;\n"),
    (6, "p", "Dockerfile", "dockerfile", "FROM alpine AS base\nEXPOSE 80\nRUN make all\n"),
    (7, "q", "src/lib.py", "python", "def util(x):\n    return x\n"),
    (8, "p", "src/lib.py", "python", "def util(x):\n    return x\ndef util2():\n    pass\n"),
    (9, "p", None, "python", "def lost():\n    pass\n"),
    (10, "p", "empty.py", "python", None),
]
SCHEMA = "file_id bigint, project string, path string, language string, content string"


def built(spark, rows=FILES):
    from pyspark.sql import functions as F

    files = spark.createDataFrame(rows, SCHEMA)
    return files, builder.build(files, parsers.extract(files, "file_id", F.col("language"), "content"))


def test_nodes_and_edges_of_files(spark):
    files, g = built(spark)
    nodes = {(r.project, r.id): r for r in g.nodes.collect()}
    assert {i for p, i in nodes if p == "q"} == {"file:src/lib.py", "function:src/lib.py:util"}
    assert {"file:src/app.py", "function:src/app.py:main", "class:src/app.py:App", "function:src/app.py:run", "file:web/a.ts", "function:web/a.ts:go", "service:Dockerfile", "service:Dockerfile:base", "endpoint:Dockerfile:80", "file:empty.py", "function:src/lib.py:util2"} <= {i for p, i in nodes if p == "p"}
    assert nodes["p", "service:Dockerfile:base"].summary == "Service base (image: alpine)" and nodes["p", "endpoint:Dockerfile:80"].type == "endpoint" and nodes["p", "service:Dockerfile"].name == "Dockerfile"
    edges = {(r.project, r.type, r.source, r.target): r.weight for r in g.edges.collect()}
    assert len(edges) == g.edges.count() and edges["p", "contains", "file:src/app.py", "function:src/app.py:main"] == 1.0
    imports = {(s, t) for p, kind, s, t in edges if kind == "imports"}
    assert imports == {("file:src/app.py", "file:src/lib.py"), ("file:src/app.py", "file:pkg/mod.py"), ("file:web/a.ts", "file:web/b.ts")}


def test_calls_between_functions(spark):
    from pyspark.sql import functions as F

    files, g = built(spark)
    sites = builder.call_sites(files, "file_id", F.col("language"), "content")
    got = {(r.source, r.target, r.weight) for r in builder.call_edges(g, sites, files).collect()}
    assert got == {("function:src/app.py:main", "function:src/lib.py:util", 0.8), ("function:src/app.py:main", "function:src/app.py:helper", 0.8), ("function:src/app.py:run", "function:src/app.py:main", 0.8)}


def test_no_files(spark):
    files, g = built(spark, FILES[:1])
    assert builder.build(files.limit(0), spark.createDataFrame([], "file_id bigint, group string, kind string, name string, detail string, line int")).nodes.count() == 0
