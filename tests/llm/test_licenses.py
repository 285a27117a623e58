import random
import re

import duckdb
from pyspark.sql import functions as F

from tracelode.llm import licenses, queries


def brute(text, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, percent=licenses.PERCENT):
    """(n_words, n_base, first, last, base labels, labels, score) of a text: every template against every block."""
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    stride, more, best = licenses.stride_of(templates), set(), 0.0
    for text_, label in templates:
        want = set(licenses.tokens_of(text_))
        for b in range(len(words) // stride + 1):
            run = words[b * stride : b * stride + 2 * stride + 1]
            held = {f"{x} {y}" for x, y in zip(run, run[1:], strict=False)} | set(run[: 2 * stride])
            if 100 * len(held & want) >= percent * len(want):
                more.add(label)
                best = max(best, len(held & want) / len(want))
    labels = {label for _, label in base}
    where = [i for i, _ in base]
    return len(words), len(base), min(where, default=None), max(where, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if base else best


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 5, "x", "y") for i, t in rows], "doc_id bigint, text string, n_words int, labels string, row string")
    return sorted(((tuple(r)) for r in licenses.scan(df, **more).collect()), key=str)


def same(spark, rows, **more):
    assert run(spark, rows, **more) == sorted(((i, *brute(t, **more)) for i, t in rows), key=str)


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    df = queries.license_scan(spark, sf)
    rel = con.sql(queries.ORACLE["op13_license_scan"])
    assert sorted(rel.columns) == sorted(df.columns)
    got = sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str)
    assert got == sorted(rel.fetchall(), key=str) and any(r[2] for r in got)


def test_odd_rows(spark, odd):
    rows = [*odd, (10, "UNDER the-MIT\x00license"), (10, "UNDER the-MIT\x00license"), (None, "under the mit license. Under the MIT License!"), (None, None), (11, "apache license version 2é"), (12, "CC BY-NC 4.0"), (13, "under the mit licence"), (14, "cc by nc " * 3)]
    same(spark, rows)


def test_edited_and_scattered_templates(spark):
    rng, rows = random.Random(4), []
    for n in range(150):
        out = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(200))]
        for _ in range(rng.randrange(4)):
            words = licenses.words_of(rng.choice(licenses.TEMPLATES)[0])
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = [rng.choice(["foreign", "the", "license"])]
            at = rng.randrange(len(out) + 1)
            out[at:at] = words
        rows.append((n, rng.choice([" ", "\n", ", "]).join(out)))
    same(spark, rows)
    got = run(spark, rows)
    assert sum(r[6] != r[5] for r in got) > 50


def test_own_templates_and_thresholds(spark):
    rows = [(1, "a b c d e f"), (2, "a b x d e f"), (3, "lonely"), (4, "a b c"), (5, "c d e f a b")]
    for percent in (1, 50, 80, 100):
        same(spark, rows, phrases=(("a b", "ab"),), templates=(("a b c d e f", "six"), ("lonely", "one"), ("lonely", "two")), percent=percent)


def test_empty(spark):
    assert run(spark, []) == []


def test_a_run_within_the_stride_lies_in_one_block(spark):
    filler = ["x"] * 200
    template = licenses.words_of(licenses.TEMPLATES[0][0])
    rows = [(k, " ".join(filler[:k] + template + filler)) for k in range(0, 90, 7)]
    assert all("mit" in r[6] for r in run(spark, rows))


def test_no_python_on_the_main_path(spark, sf):
    plan = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    rows = licenses.matches(spark.createDataFrame([(1, [(0, "all rights")])], "row long, hits array<struct<pos:int,token:string>>"), licenses.TEMPLATES)._jdf.queryExecution().toString()
    assert not any(w in plan + rows for w in ("ArrowEval", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups"))


def test_row_numbers_are_settled(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("All rights reserved").alias("text")).repartition(7)
    rows = licenses.scan(df).collect()
    assert len(rows) == 50 and all(r["labels"] == "all-rights-reserved" for r in rows)
