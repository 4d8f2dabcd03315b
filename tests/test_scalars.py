import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsers, scalars


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    "value,want",
    [("Low", "simple"), ("  TRIVIAL  ", "simple"), ("\tIntermediate\n", "moderate"), ("advanced", "complex"), ("", "moderate"), ("nightmare", "moderate"), (None, "moderate"), ("3", "simple"), ("3.0001", "moderate"), ("6", "moderate"), ("6.0001", "complex"), ("0.5", "moderate"), ("-1", "moderate"), ("NaN", "moderate"), ("Infinity", "moderate")],
)
def test_complexity(spark, value, want):
    assert one(spark, scalars.normalize_complexity, value) == want


@pytest.mark.parametrize(
    "path,want",
    [("README.md", "doc"), ("docs/intro.rst", "doc"), ("package.json", "config"), ("Cargo.toml", "config"), ("src/data/users.json", "data"), ("crates/foo/tests/integration.rs", "test"), ("src/foo_test.go", "test"), ("src/foo.rs", "source")],
)
def test_file_category(spark, path, want):
    assert one(spark, scalars.file_category, path) == want


def test_ids_and_slugs(spark):
    assert one(spark, scalars.merge_id, "Function:src\\foo.rs:bar") == "function:src/foo.rs:bar"
    assert one(spark, scalars.merge_id, "no-prefix\\path") == "no-prefix/path"
    assert one(spark, scalars.layer_id, "API Layer") == "layer:api-layer"
    assert one(spark, scalars.slugify, "A b/Ü!") == "a-b-ü-"
    assert one(spark, scalars.top_level_domain, "/src/auth/login.ts") == "auth"
    assert one(spark, scalars.top_level_domain, "main.rs") == "root"
    assert one(spark, scalars.entry_type, "src/handlers/x.py") == "http"


def test_prompt_hash_tells_parts_apart(spark):
    h = lambda a, b: one(spark, scalars.prompt_hash, a, b)
    assert h("a", "b|c") != h("a|b", "c") and h("", "abc") != h("a", "bc")


def test_wiki_text(spark):
    text = "---\ntitle: \"Named\"\ncategory: store\n---\n# Head\n\nFirst line\nsecond [[ target | label ]] [[b]] [[ ]]\n\nRest"
    assert one(spark, lambda t: scalars.title_of(t, F.lit("stem")), text) == "Named"
    assert one(spark, scalars.wikilinks, text) == ["target", "b"]
    assert one(spark, scalars.first_paragraph, text).startswith("First line second")
    assert one(spark, lambda t: scalars.title_of(t, F.lit("stem")), "plain") == "stem"
    assert len(one(spark, scalars.first_paragraph, "x" * 500)) == 280


def test_salvage(spark):
    f = lambda c: scalars.salvage_json_array(c, "array<struct<name:string>>")
    assert one(spark, f, 'Sure! ```json\n[{"name":"Data"}]\n``` done')[0].name == "Data"
    assert one(spark, f, "not json at all") is None


def names(language, text, group):
    return [i.name for i in parsers.analyze(language, text) if i.group == group]


def test_dockerfile():
    text = "FROM rust:1.83 AS builder\nCOPY . .\nRUN cargo \\\n  build\n\nFROM debian\nEXPOSE 8080/tcp\nCMD [\"x\"]\n"
    assert names("dockerfile", text, "service") == ["builder", "stage-2"]
    assert names("dockerfile", text, "step")[0] == "run: cargo"
    assert names("dockerfile", text, "endpoint") == ["8080"]


def test_makefile_env_ini_toml():
    assert names("makefile", "CC := gcc\nall: build test\nbuild:\n\tcc x\n", "step") == ["all <- build test", "build"]
    got = {i.name: i.detail for i in parsers.analyze("env", "# c\nDB=\"postgres://x\"\nexport KEY='v'  # n\nEMPTY=\n")}
    assert got == {"DB": "postgres://x", "KEY": "v", "EMPTY": ""}
    ini = parsers.analyze("ini", "; c\n[server]\nhost = 1\n")
    assert [(i.kind, i.name, i.detail) for i in ini] == [("section", "server", ""), ("variable", "host", "server|1")]
    assert [i.kind for i in parsers.analyze("toml", "[server]\nport = 8080\n")] == ["section", "variable"]


def test_markup_and_schemas():
    md = parsers.analyze("markdown", "# Top\n```\n# no\n```\n## Sub\n### Deep\n# Next\n")
    assert [(i.kind, i.name, i.detail) for i in md] == [("1", "Top", "6"), ("2", "Sub", "6"), ("3", "Deep", "6"), ("1", "Next", "8")]
    assert names("json", '{"openapi": "3", "paths": {"/users": {"get": {}}}}', "endpoint") == ["/users"]
    assert {i.kind for i in parsers.analyze("protobuf", "message A { message B {} }\nenum R { X = 0; }\nservice S { }\n")} == {"message", "enum", "service"}
    assert names("graphql", "type Query {\n  user(id: ID!): User\n}\n", "endpoint") == ["Query.user"]
    assert names("shell", "greet() { echo; }\nsource ./lib/common.sh\n", "import") == ["./lib/common.sh"]
    assert [(i.kind, i.name) for i in parsers.analyze("sql", "CREATE TABLE users (id INT);\nCREATE INDEX i ON u(e);\nCREATE MATERIALIZED VIEW stats AS SELECT 1;")] == [("table", "users"), ("index", "i"), ("view", "stats")]
    tf = parsers.analyze("terraform", 'resource "aws_s3_bucket" "logs" {}\nvariable "region" {}\ndata "a" "b" {}\n')
    assert [(i.group, i.kind, i.name) for i in tf] == [("resource", "aws_s3_bucket", "logs"), ("definition", "variable", "region"), ("definition", "data", "a.b")]


def test_code_and_plugins():
    py = "import os\nfrom .a import b\nclass C:\n    def m(self): return f(1)\ndef _p(x, *y): pass\n"
    assert names("python", py, "function") == ["_p", "m"] or set(names("python", py, "function")) == {"_p", "m"}
    assert names("python", py, "export") == ["C"]
    assert parsers.call_graph(py) == [("m", "f", 4)]
    assert names("go", "func (x *T) Get(a int) int {\n", "function") == ["Get"]
    assert names("rust", "pub fn f(a: i64) -> i64 {\n", "export") == ["f"]
    with pytest.raises(ValueError):
        parsers.analyze("nope", "")
    parsers.register("nope", lambda text: iter([parsers.Item("function", "function", text, "", 1)]))
    assert names("nope", "z", "function") == ["z"]
    parsers._READERS.pop("nope")


def test_structural_hash_ignores_order_and_lines(spark):
    rows = [(1, "function", "function", "f", "a,b", 1), (1, "import", "i", "x", "", 2), (2, "import", "i", "x", "q", 9), (2, "function", "function", "f", "c,d", 3), (3, "function", "function", "f", "a", 1), (3, "import", "i", "x", "", 2)]
    df = spark.createDataFrame(rows, "k int, group string, kind string, name string, detail string, line int")
    got = {r.k: r.structure for r in parsers.structural_hash(df, "k").collect()}
    assert got[1] == got[2] != got[3]


def test_signatures_over_lines_and_brackets():
    java = parsers.analyze("java", "class A {\n  public int f(Map<String, Integer> m,\n      int b) {\n  }\n}")
    assert [(i.name, i.detail, i.line) for i in java if i.group == "function"] == [("f", "Map<String, Integer> m, int b", 2)]
    ts = parsers.analyze("typescript", "export function go(\n  a: number,\n  b: string,\n): void {\n}\nfoo(\n1)\n")
    assert [(i.group, i.name, i.detail) for i in ts] == [("function", "go", "a: number, b: string"), ("export", "go", "")]


def test_top_level_keys_have_their_own_lines():
    got = {i.name: i.line for i in parsers.analyze("json", '{"x": {"b": 1},\n "b": [\n{"c": 1}],\n "openapi": "3", "paths": {\n "/u": {"get": {}}}}')}
    assert got == {"x": 1, "b": 2, "openapi": 4, "paths": 4, "/u": 5}


def test_arity_counts_parameters(spark):
    rows = [(k, "function", "function", "f", detail, 1) for k, detail in ((1, "Map<String, List<Integer>> m"), (2, "a"), (3, "a, b = (1, 2)"), (4, "a, b"), (5, ""))]
    items = spark.createDataFrame(rows, "file_id bigint, group string, kind string, name string, detail string, line int")
    got = {r.file_id: r.structure for r in parsers.structural_hash(items, "file_id").collect()}
    assert got[1] == got[2] and got[3] == got[4] and len(set(got.values())) == 3


def test_ignore_files_in_folders_and_yaml_settings(spark, tmp_path):
    from plumbline.sources import graph_io

    for name in ("a.log", "keep.log", "sub/x.tmp", "sub/deep/x.tmp", "other/x.tmp", "sub/top.py", "node_modules/m.js", ".hidden/h.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n!keep.log\n")
    (tmp_path / "sub" / ".gitignore").write_text("*.tmp\n!/deep/x.tmp\n")
    assert sorted(r.path for r in graph_io.walk_project(spark, str(tmp_path)).collect()) == ["keep.log", "other/x.tmp", "sub/deep/x.tmp", "sub/top.py"]
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("batch_size: 7\n")
    assert graph_io.Settings.load(str(tmp_path / "s.yaml"), concurrency=2).batch_size == 7
