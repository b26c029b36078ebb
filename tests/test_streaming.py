from moraine.streaming.ingest import stream_entries
from moraine.testing import archives as make


def test_arriving_archives_are_listed(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.sit").write_bytes(make.classic([make.Member("one", b"1"), make.Member("two", b"22")]))
    (landing / "b.hqx").write_bytes(make.binhex(make.v5([make.Member("folder/three", b"333")])))
    query = stream_entries(spark, str(landing)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r["path"], r["is_dir"]) for r in spark.table("arrived").collect()} == {("one", False), ("two", False), ("folder", True), ("folder/three", False)}
