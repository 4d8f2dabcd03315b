from datetime import datetime as D

from plumbline.streaming import changes

SCHEMA = "event_id bigint, ts timestamp_ntz, event_type string, path string, hash string"


def rows(spark):
    return spark.createDataFrame([(1, D(2024, 1, 1, 0, 0), "a", "x", "1"), (2, D(2024, 1, 1, 0, 10), "a", "x", "2"), (3, D(2024, 1, 1, 1, 0), "a", "y", "1"), (4, D(2024, 1, 1, 1, 5), "b", "x", "2")], SCHEMA)


def test_batch_windows(spark):
    assert sorted((r.event_type, r.changes) for r in changes.volume(rows(spark)).collect()) == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.event_type, r.events) for r in changes.sessions(rows(spark)).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_stream_equals_batch(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.watched(changes.file_stream(spark, str(tmp_path / "in"), SCHEMA))
    q = changes.volume(stream).writeStream.outputMode("complete").format("memory").queryName("volume").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.changes) for r in spark.table("volume").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_keyed_change_detection_over_batches(spark, tmp_path):
    rows(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = {}

    def handle(batch, _):
        state = spark.createDataFrame(list(seen.items()) or [], "path string, hash string")
        for r in changes.changed_only(batch.withColumnRenamed("ts", "at").select("path", "hash", "at"), state).collect():
            seen[r.path] = r.hash

    stream = changes.file_stream(spark, str(tmp_path / "in"), SCHEMA)
    for _ in range(2):  # the second run finds nothing new
        changes.run_batches(stream, handle, str(tmp_path / "c")).awaitTermination(60)
    assert seen == {"x": "2", "y": "1"}


def test_slots_and_first_seen(spark):
    df = spark.createDataFrame([("a/domain-graph.json",), ("knowledge.json",), ("graph.json",)], "p string")
    assert [r[0] for r in df.select(changes.slot_of(df["p"])).collect()] == ["domain", "knowledge", "codebase"]
    assert changes.first_seen(rows(spark), ["path"]).count() == 2
