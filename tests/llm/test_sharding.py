import zlib

from pyspark.sql import functions as F

from tracelode.llm import queries, sharding


def law(rows, n):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(n)]
    return max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.external_shuffle(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and law(rows, 40) and {r["law"] for r in rows} == {"rows"}
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 16 for r in rows)


def test_odd_rows_and_order(frame, odd):
    rows = sharding.shuffled(frame(odd + odd), 4, seed=3).collect()
    assert len(rows) == 2 * len(odd) and law(rows, 4)
    same = lambda p: sorted((str(r["doc_id"]), r["shard"], r["slot"]) for r in sharding.shuffled(frame(odd * 30).repartition(p), 4, seed=3).collect())
    assert same(1) == same(5)
    assert sharding.shuffled(frame([]), 4).count() == 0
    assert "lang_pred" in rows[0].asDict() and rows[0]["size"] != 7


def test_write(spark, frame, tmp_path):
    df = sharding.shuffled(frame([(i, f"t{i}") for i in range(100)]), 5)
    sharding.write_shards(df, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 5


def test_equal_rows_with_other_columns(spark, frame, monkeypatch):
    rows = [(i % 3, "same", i) for i in range(300)] + [(i, f"t{i}", 0) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, other int")
    got = lambda d: sorted((r["doc_id"], r["text"], r["other"], r["shard"], r["slot"]) for r in sharding.shuffled(d, 7, seed=2).collect())
    assert got(df) == got(df.repartition(6).orderBy(F.desc("other")))


def test_hot_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 50)
    rows = [(None, "same")] * 2000 + [(i, f"t{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, two = (sharding.shuffled(d, 5, seed=4, least=16).collect() for d in (df, df.repartition(3)))
    key = lambda r: (str(r["doc_id"]), r["shard"], r["slot"])
    assert len(one) == 2400 and law(one, 5) and sorted(map(key, one)) == sorted(map(key, two))
    _, counts = sharding.scattered(df.withColumn("text_crc32", F.crc32("text")), 16, 4, "doc_id")
    assert {r["__n"] < 220 for r in counts.collect()} == {True} and counts.agg(F.sum("__n")).first()[0] == 2400


def test_permutation(spark, frame):
    """Every place once, and the order of a bucket is the one that the seed draws."""
    import numpy as np

    rows = [(i, f"t{i}") for i in range(200)]
    got = sharding.shuffled(frame(rows), 1, seed=9, least=1).collect()
    slot = {r["doc_id"]: r["slot"] for r in got}
    draw = np.random.default_rng([9, 0]).permutation(200)
    assert [slot[i] for i in range(200)] == draw.tolist()


def test_columns_of_any_name_and_maps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    monkeypatch.setattr(sharding, "COPIES", 7)
    names = ["doc_id", "text", "__tie", "__copy", "__bucket", "__before", "__i", "a.b", "k0", "m"]
    rows = [(1, "same", "t", "c", "b", "f", "i", "d", "k", {"x": 1})] * 300 + [(i, f"t{i}", f"t{i}", "c", "b", "f", "i", f"d{i}", "k", {"x": i}) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, c2 string, c3 string, c4 string, c5 string, c6 string, c7 string, c8 string, m map<string,int>").toDF(*names)
    out = sharding.shuffled(df, 5, least=4)
    assert out.columns == [*names, "size", "text_crc32", "shard", "slot"]
    got = out.collect()
    key = lambda r: (*r[:9], r["m"]["x"])
    assert law(got, 5) and sorted(key(r) for r in got) == sorted((*r[:9], r[9]["x"]) for r in rows)


def test_copies_of_a_row_come_out_of_many_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "same")], "doc_id bigint, text string").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(300000))).alias("n")).drop("n")
    out = sharding.shuffled(df, 40)
    assert out.count() == 300000 and out.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    rows, _ = sharding.scattered(df.withColumn("text_crc32", F.crc32("text")), 96, 1, "doc_id")
    assert rows.groupBy(F.spark_partition_id()).count().count() > 1


def test_files_of_a_shard_follow_its_slots(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 200)
    df = sharding.shuffled(frame([(i, f"t{i}") for i in range(120)]), 2)
    sharding.write_shards(df, str(tmp_path / "s"), 2)
    back = spark.read.parquet(str(tmp_path / "s")).select("shard", "slot", F.input_file_name().alias("file")).collect()
    for s in (0, 1):
        mine = sorted((r["file"].rsplit("/", 1)[-1], r["slot"]) for r in back if r["shard"] == s)
        assert len({f for f, _ in mine}) > 2 and [x for _, x in mine] == list(range(60))
