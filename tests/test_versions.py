"""Versions of a workspace: what is written together becomes visible together, and stays."""

import pytest
from pyspark.sql import functions as F

from tracelode.plans import commands


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.fixture
def ws(spark, tmp_path):
    return commands.init(spark, str(tmp_path / "ws"), [])


def frame(spark, *names, confidence=1.0):
    return spark.createDataFrame([(n, n, "program", confidence) for n in names], "id string, name string, type string, confidence double")


def test_a_change_that_fails_half_way_leaves_what_was(spark, ws):
    with ws.change():
        ws.write("entities", frame(spark, "a"))
        ws.write("relations", frame(spark, "r"))
    with pytest.raises(RuntimeError), ws.change():
        ws.write("entities", frame(spark, "b"))
        assert ids(ws.read("entities")) == ["b"]
        raise RuntimeError("executor lost")
    other = commands.init(spark, ws.folder, [])
    assert ids(ws.read("entities")) == ids(other.read("entities")) == ["a"] and max(other.versions()) == 1 and ids(other.read("relations")) == ["r"]
    failing = frame(spark, "c").withColumn("x", F.raise_error(F.lit("bad row")).cast("string"))
    with pytest.raises(Exception, match="bad row"):
        ws.write("entities", failing)
    assert ids(ws.read("entities")) == ["a"]


def test_versions_are_read_and_compared(spark, ws):
    rel = spark.createDataFrame([("a", "CALLS", "b", 1.0)], '`from` string, rel string, `to` string, confidence double')
    with ws.change():
        ws.write("entities", frame(spark, "a", "b"))
        ws.write("relations", rel)
    with ws.change():
        ws.write("entities", frame(spark, "b", "c", confidence=0.5))
    assert ids(ws.at(1).read("entities")) == ["a", "b"] and ids(ws.read("entities")) == ["b", "c"] and ws.read("relations").count() == 1
    got = commands.diff(ws.at(1), ws)
    assert sorted((r["name"], r["change"]) for r in got["entities"].collect()) == [("a", "removed"), ("b", "changed"), ("c", "added")] and got["relations"].count() == 0
    with pytest.raises(ValueError):
        ws.at(1).write("entities", frame(spark, "x"))


def test_nothing_written_and_ledgers(spark, ws):
    assert not ws.exists("entities") and ws.versions() == {}
    commands.observe(ws, "looked at it", "a")
    commands.decide(ws, "a", "keep")
    assert ws.exists("observations") and ws.read("decisions").first()["action"] == "keep" and ws.versions() == {}
    assert '"next": "ingest"' in commands.progress(ws)
    reader = commands.init(spark, ws.folder, [])
    assert not reader.exists("entities")
    ws.write("entities", frame(spark, "a"))
    assert not reader.exists("entities")
    reader.refresh()
    assert ids(reader.read("entities")) == ["a"]
