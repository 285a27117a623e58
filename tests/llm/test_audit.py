import re
from itertools import permutations
from math import factorial

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import audit, common, queries


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text))]
        fails.append(i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs))
        rows.append((lang or "", fails, i in good, i in toxic))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley, found = dict.fromkeys(range(5), 0), []
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                kept = [r for r in left if not r[1][f]]
                before = len([r for r in mine if r[1][f]]) - len(gone)
                only = sum(r[1][f] and sum(r[1]) == 1 for r in mine)
                found.append((part, "".join("ABCDE"[g] for g in order), step, len(kept), len(gone), before, only, sum(r[2] for r in gone), sum(r[3] for r in gone), f))
                shapley[f] += len(gone)
                left = kept
        out += [(*r[:-1], shapley[r[-1]]) for r in found]
    return sorted(out)


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, lang, 1, "x", 2) for i, t, lang in docs], "doc_id bigint, text string, lang string, mask int, part string, n int")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return sorted(tuple(r) for r in audit.audit(audit.marked(d, lab), "ABCDE").collect())


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert sorted(tuple(r) for r in queries.filter_audit(spark, sf).collect()) == sorted(con.sql(queries.ORACLE["op11_filter_audit"]).fetchall())


def test_brute_force_on_odd_rows(spark, odd):
    long = " ".join(f"w{k}" for k in range(150))
    docs = [(i, t, "en" if i % 2 else None) for i, t in odd]
    docs += [(20, long, ""), (21, long, "en"), (22, long + " #", "de"), (22, long, "de"), (22, long, "de"), (None, long, "en"), (None, long, None), (23, "É" * 10 + "A", "en"), (24, "ABC " * 200, "en"), (25, None, "de"), (19, None, "de")]
    labels = [(20, 1, 0), (20, 0, 0), (21, None, 1), (22, 1, 1), (99, 1, 1), (None, 1, 1), (2, None, None)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_hot_text_id_and_null(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    docs = [(k, "same" if k % 3 else f"t{k}", "en") for k in range(40)] + [(7, "x", "de")] * 9 + [(None, "y", None)] * 9
    labels = [(k, k % 2, 1 - k % 2) for k in range(0, 40, 3)] + [(7, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, [], [(1, 1, 1)]) == []
    assert len(run(spark, [(1, "a", "en")], [])) == 600


@pytest.mark.parametrize("k", [1, 3, 6])
def test_other_numbers_of_filters(spark, k):
    rng = np.random.default_rng(k)
    rows = [(f"p{rng.integers(30)}", int(rng.integers(1 << (k + 2)))) for _ in range(500)]
    got = audit.audit(spark.createDataFrame(rows, "part string, mask int"), "UVWXYZ"[:k]).collect()
    assert len(got) == len({p for p, _ in rows}) * k * factorial(k)
    for r in got:
        seen, f = 0, "UVWXYZ".index(r["filter_order"][r["step"] - 1])
        for c in r["filter_order"][: r["step"] - 1]:
            seen |= 1 << "UVWXYZ".index(c)
        mine = [m for p, m in rows if p == r["part"]]
        assert r["removed"] == sum(m >> f & 1 and not m & seen for m in mine) and r["kept"] == sum(not m & (seen | 1 << f) for m in mine)
        assert r["good_lost"] == sum(m >> f & 1 and not m & seen and m >> k & 1 for m in mine)
    with pytest.raises(ValueError):
        audit.audit(spark.createDataFrame(rows, "part string, mask int"), "ABCDEFG")


def test_blocks_and_many_parts(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 7)
    monkeypatch.setattr(audit, "PARTS", 3)
    rows = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 20).alias("part"), (F.col("id") % 8).cast("int").alias("mask"))
    got = {(r["part"], r["before"], r["filter"]): r["removed"] for r in audit.index(rows, 1).collect()}
    assert len(got) == 20 and sum(got.values()) == 100


