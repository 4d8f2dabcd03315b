import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars
from plumbline.operators import external, quality
from plumbline.sources import graph_io

ASK = "node_id string, prompt_hash string, file_hash string, prompt string"


def test_calls_use_the_cache_and_keep_failures(spark):
    def answer(text):
        if text.startswith("bad"):
            raise ValueError("rejected")
        return text.upper()

    asked = spark.createDataFrame([("a", "p", "f", "hello"), ("a", "p", "f", "hello"), ("b", "p", "f", "known"), ("b", "p", "g", "other file"), ("c", "p", "f", "bad one"), ("d", "p", "f", None)], ASK)
    cache = spark.createDataFrame([("b", "p", "f", "CACHED")], "node_id string, prompt_hash string, file_hash string, response string")
    got = {(r.node_id, r.file_hash): (r.response, r.cached, bool(r.error)) for r in external.call_rows(asked, cache, answer, 2).collect()}
    assert got == {("a", "f"): ("HELLO", False, False), ("b", "f"): ("CACHED", True, False), ("b", "g"): ("OTHER FILE", False, False), ("c", "f"): (None, False, True), ("d", "f"): (None, False, True)}
    saved = external.call_rows(asked.where("node_id = 'c'"), cache, answer, 1, lambda i, t: [f"node:{i}"]).first()
    assert saved.response == "NODE:C"


def test_retries_and_polling():
    tries, waits = [], []

    def flaky(text):
        tries.append(text)
        if len(tries) < 3:
            raise external.Retryable
        return "ok"

    assert external.with_retries(flaky, "x", sleep=waits.append) == "ok" and len(waits) == 2
    assert [external.delay(n) for n in (1, 2, 8)] == [0.5, 1.0, 30.0]
    states = iter(["queued", "running", "completed"])
    assert external.poll(lambda: next(states), sleep=waits.append) == "completed"
    with pytest.raises(TimeoutError):
        external.poll(lambda: "running", limit=2, sleep=waits.append)


def test_exit_codes_and_tour_checks(spark):
    issues = spark.createDataFrame([("warning", "X")], "severity string, code string")
    assert (quality.exit_code(issues), quality.exit_code(issues, True), quality.exit_code(issues.limit(0), True)) == (0, 1, 0)
    steps = spark.createDataFrame([(1, ["a"]), (3, ["b", "gone"])], "step int, node_ids array<string>")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {(r.code, r.step) for r in quality.tour_checks(steps, nodes).collect()} == {("TOUR_STEP_GAP", 2), ("TOUR_MISSING_NODE", 3), ("TOUR_LENGTH", 2)}


def test_small_sources(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("gen/\n")
    text = open(graph_io.write_ignore_file(str(tmp_path))).read()
    assert "node_modules" in text and "gen/" in text
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.md").write_text("# A\n\ntext")
    (tmp_path / "w" / "b.txt").write_text("no")
    assert [(r.path, r.text) for r in graph_io.read_wiki(spark, str(tmp_path / "w")).collect()] == [("a.md", "# A\n\ntext")]
    files = spark.createDataFrame([("p", "README.md", "é" * 3000), ("p", "src/README.md", "x"), ("q", "readme", None)], "project string, path string, content string")
    (row,) = graph_io.readme_head(files).collect()
    assert row.project == "p" and len(row["head"].encode()) <= 1024 and set(row["head"]) == {"é"}


def test_more_scalars(spark):
    df = spark.createDataFrame([("k", "a\x00b" + "c" * 600)], "id string, t string")
    r = df.select(scalars.uuid_for_key(F.col("id")), F.size(scalars.fallback_texts(F.col("id"), F.col("t"))), scalars.iso_now()).first()
    assert r[0] == str(__import__("uuid").uuid5(scalars.NAMESPACE, "k")) and r[1] == 4 and r[2].endswith("Z")
    assert scalars.parse_type(" FILE ", ("file",)) == "file" and scalars.parse_type("nope", ("file",)) is None
