"""The stored index, numbers over all rows, sorted tables and the table function, against plain forms."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.operators import export, ordering, search
from tracelode.operators.extract import copybook

LETTERS = "abcde"


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(1, 9)))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(4))).replace(" ", rng.choice([" ", "-", "_"]))) for k in range(600)] + [(600, None), (601, "Pagaménto de Título"), (602, "PAGAMENTO"), (603, "pag amento")]
    df = spark.createDataFrame(rows, "id int, name string")
    folder = str(tmp_path_factory.mktemp("index") / "i")
    search.write_index(df, ["name"], folder, 4)
    return df, search.read_index(spark, folder)


@pytest.mark.parametrize("query", ["abcde", "abc dea", "eeabcd bb", "pagamento", "pagamneto titulo", "ab", "ddd-ccc aaa", "abcdeabcde", "de"])
@pytest.mark.parametrize("scorer", [text.RESOLUTION, text.EXECUTIVE])
def test_indexed_scores_are_all_scores(names, query, scorer):
    df, index = names
    rows = lambda d: sorted((r["id"], r["score"]) for r in d.collect())
    assert rows(search.fuzzy_indexed(df, index, query, ["name"], scorer)) == rows(search.fuzzy(df, query, ["name"], scorer))


def test_prefix_reaches_the_scan(names):
    _, index = names
    plan = search.by_prefix(index, "pag")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(token,PAG)" in plan
    assert sorted(r["id"] for r in search.by_prefix(index, "pagaménto").collect()) == [601, 602]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_numbers_have_no_gaps(spark, parts):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("a"), (F.col("id") % 3).alias("b"))
    want = {(r["a"], r["b"]): r["n"] for r in df.withColumn("n", F.row_number().over(Window.orderBy("b", "a"))).collect()}
    assert {(r["a"], r["b"]): r["n"] for r in ordering.numbered(df, [F.col("b"), F.col("a")], "n", parts).collect()} == want
    assert ordering.numbered(df.limit(0), [F.col("a")]).count() == 0


def test_sorted_as_a_dictionary_has_it(spark):
    e = spark.createDataFrame([("i2", "t", "b"), ("i1", "t", "B"), ("i3", "t", "á"), ("i4", "s", "z"), ("i5", "t", "a"), ("i6", "t", None)], "id string, type string, label string")
    assert [r["id"] for r in export.sorted_entities(e).collect()] == ["i4", "i6", "i5", "i3", "i2", "i1"]


def test_layout_streams_in_order(spark):
    lines = [("/a/one.cpy", "h", k, f"       {5 if k % 3 else 1:02d}  F{k} PIC X({k}).") for k in range(1, 2000)] + [("b\\two.cpy", "g", 1, "       01  REC."), ("b\\two.cpy", "g", 2, "       05  A PIC"), ("b\\two.cpy", "g", 3, "      -    S9(4) COMP-3 OCCURS 1 TO 5 TIMES"), ("b\\two.cpy", "g", 4, "           DEPENDING ON N."), ("b\\two.cpy", "g", 5, "short"), ("b\\two.cpy", "g", 6, "       05  FILLER."), ("b\\two.cpy", "g", 7, "       10  B REDEFINES A PICTURE IS 9.")]
    df = spark.createDataFrame(lines, "path string, hash string, line int, code string").repartition(3, F.rand(1))
    got = copybook.fields(df).collect()
    one = [r for r in got if r["book"] == "ONE"]
    assert len(one) == 1999 and all(r["parent"] == (f"F{r['line'] - r['line'] % 3}" if r["line"] % 3 and r["line"] > 2 else "ONE") for r in one)
    two = {r["name"]: r for r in got if r["book"] == "TWO"}
    assert two["A"]["pic"] == "S9(4) COMP-3" and two["A"]["occurs"].asDict() == {"min": 1, "max": 5, "depending_on": "N"} and two["A"]["line"] == 2
    assert two["B"]["parent"] == "REC" and two["B"]["redefines"] == "A" and two["B"]["pic"] == "9" and set(two) == {"REC", "A", "B"}


def test_open_declarations_hold_little_state():
    layout = copybook.Layout("B")
    for k in range(1, 200001):
        list(layout.feed(k, f"       05  F{k} PIC X."))
    assert len(layout.groups) <= 2 and len(layout.text) < 80
