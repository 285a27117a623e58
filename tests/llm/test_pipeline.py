from tracelode.llm import decontam, jaccard, queries

import corpus_pipeline
import __spark_entry__


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, before, sf), name)
        if name != "sharding":
            assert after.columns == docs.columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        was = {r["doc_id"] for r in before.select("doc_id").collect()}
        assert set(ids) <= was
        if name == "quality_classifier":
            bad = [i for i in ids if labels.get(i) == 0]
            good = [i for i in was - set(ids) if labels.get(i) == 1]
            assert len(bad) + len(good) <= 0.05 * len(labels)
        elif name == "ngram_jaccard_join":
            groups = {r["doc_id"]: r["component_id"] for r in jaccard.join(before, 5, 80).collect()}
            assert set(ids) == set(groups.values())
        elif name == "benchmark_decontamination":
            assert was - set(ids) == {r["doc_id"] for r in decontam.find(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        elif name == "source_mixing":
            assert len(ids) > 0.3 * len(was)
        else:
            assert set(ids) == was
        before = after


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and len([n for n in names if n.startswith("op")]) >= 10


def test_groups_without_ids_and_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text + " x"), (None, text), (None, "other words here"), (None, "other words here"), (None, None), (None, " "), (5, "alone"), (5, "alone"), (7, "b"), (7, "a")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, size string")
    got = corpus_pipeline.one_of_each_group(spark, df, "")
    assert got.columns == df.columns and sorted(((r[0] or 0), str(r[1])) for r in got.collect()) == [(0, " "), (0, "None"), (0, "other words here"), (1, text), (5, "alone"), (7, "a")]
    assert corpus_pipeline.one_of_each_group(spark, df.limit(0), "").count() == 0


def test_quality_keeps_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.selectExpr("*", "doc_id + 1 as score", "doc_id + 2 as predicted", "doc_id + 3 as n_passages")
    got = corpus_pipeline.keep_quality(spark, more, sf)
    rows = got.selectExpr("doc_id", "score - doc_id", "predicted - doc_id", "n_passages - doc_id").collect()
    assert got.columns == more.columns and rows and all(tuple(r)[1:] == (1, 2, 3) for r in rows)
    assert {r[0] for r in rows} == {r["doc_id"] for r in corpus_pipeline.keep_quality(spark, docs, sf).select("doc_id").collect()}


def test_columns_of_any_name_and_maps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.union(docs.limit(5)).selectExpr("*", "map('k', doc_id) as m", "text as `a.b`", "source as __text", "lang as score", "1 as __tie", "2 as spans")
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, odd, sf)
        assert after.columns[: len(odd.columns)] == odd.columns and after.filter("m['k'] <> doc_id or `a.b` <> text or __text <> source or score <> lang or __tie <> 1 or spans <> 2").count() == 0
    assert corpus_pipeline.one_of_each_group(spark, odd, sf).count() <= 60
