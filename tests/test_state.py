"""State of paths over three triggers: a change, a move, a deletion and a late listing."""

from datetime import datetime

from tracelode.streaming import state


def test_changes_over_triggers(spark, tmp_path):
    at = lambda k: datetime(2024, 1, 1, k)
    scans = [
        [("a", "h1", at(1)), ("b", "h2", at(1)), ("c", "h3", at(1))],
        [("a", "h1", at(2)), ("b", "h9", at(2)), ("c", None, at(2)), ("d", "h3", at(2))],
        [("a", None, at(3)), ("b", "h2", at(1)), ("e", "h5", at(3)), ("e", "h6", at(4)), ("e", None, at(2))],
    ]
    folder, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    for k, rows in enumerate(scans):
        spark.createDataFrame(rows, state.LISTING).coalesce(1).write.mode("append").parquet(folder)
        q = state.start(spark, folder, out, checkpoint, once=True)
        q.awaitTermination(180)
        assert q.exception() is None
        if k == 0:
            first = spark.read.parquet(out)
            assert {(r["path"], r["action"], r["hash"]) for r in first.collect()} == {("a", "add", "h1"), ("b", "add", "h2"), ("c", "add", "h3")}
    got = spark.read.parquet(out)
    rows = [(r["batch"], r["path"], r["action"], r["hash"], r["old_hash"]) for r in got.orderBy("batch", "path", "at").collect()]
    assert [x[1:] for x in rows if x[0] == 1] == [("b", "replace", "h9", "h2"), ("c", "retract", None, "h3"), ("d", "add", "h3", None)]
    assert [x[1:] for x in rows if x[0] == 2] == [("a", "retract", None, "h1"), ("e", "add", "h5", None), ("e", "replace", "h6", "h5")]
    records = spark.createDataFrame([("r1", "h1"), ("r2", "h2"), ("r3", "h3"), ("r9", "h9"), ("r5", "h5"), ("r6", "h6")], "name string, fileHash string")
    assert sorted(r["name"] for r in state.applied(records, got).collect()) == ["r3", "r6", "r9"]
