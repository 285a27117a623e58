"""A scan that lists first and reads only what has changed."""

import os

from pyspark.sql import functions as F

from tracelode.functions import schema
from tracelode.sources import files


def put(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_only_changed_files_are_read(spark, tmp_path):
    none = spark.createDataFrame([], schema.FILES)
    for k in range(6):
        put(tmp_path, f"f{k}.cbl", f"text {k}", 1_700_000_000 + k)
    put(tmp_path, "node_modules/x.cbl", "skipped", 1_700_000_000)
    read, same = files.scan_changed(spark, [str(tmp_path)], none)
    assert len(names(read)) == 6 and same.count() == 0
    old = schema.shaped(files.classify(read), schema.FILES).cache()
    old.count()
    read, same = files.scan_changed(spark, [str(tmp_path)], old)
    assert names(read) == ["f5.cbl"] or names(read) == []
    put(tmp_path, "f1.cbl", "other", 1_700_000_100)
    put(tmp_path, "f2.cbl", "restored", 1_600_000_000)
    put(tmp_path, "new.cbl", "new", 1_700_000_200)
    (tmp_path / "f3.cbl").unlink()
    read, same = files.scan_changed(spark, [str(tmp_path)], old)
    assert names(read) == ["f1.cbl", "f2.cbl", "new.cbl"] and names(same) == ["f0.cbl", "f4.cbl", "f5.cbl"]
    full = {r["path"]: r["hash"] for r in files.scan(spark, [str(tmp_path)]).collect()}
    both = {r["path"]: r["hash"] for r in read.select("path", "hash").union(same.select("path", "hash")).collect()}
    assert both == full


def test_listing_reads_no_content_and_time_reaches_the_source(spark, tmp_path):
    put(tmp_path, "a.cbl", "x", 1_700_000_000)
    plan = files.listed(spark, [str(tmp_path)]).select("path", "size", "mtime")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan
    late = files.listed(spark, [str(tmp_path)]).filter(F.col("modified") >= F.lit("2024-01-01").cast("timestamp"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(modificationTime" in late
    assert names(files.scan(spark, [str(tmp_path)], exclude=("**/a.*",))) == []


def test_many_old_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_PATHS", 2)
    for k in range(8):
        put(tmp_path, f"f{k}.cbl", f"text {k}", 1_700_000_000 + k)
    old = schema.shaped(files.classify(files.scan(spark, [str(tmp_path)])), schema.FILES).cache()
    old.count()
    for k in range(5):
        put(tmp_path, f"f{k}.cbl", f"older text {k}", 1_600_000_000 + k)
    read, same = files.scan_changed(spark, [str(tmp_path)], old)
    assert names(read) == [f"f{k}.cbl" for k in range(5)] and same.count() == 3
