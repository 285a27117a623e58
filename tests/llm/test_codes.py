import hashlib
import math

import duckdb
import numpy as np
import pytest

from tracelode.llm import codes, common, queries


def brute(rows):
    """rows: (vec_id, vector, label), in pure Python; vectors of each length by themselves."""
    sound = [(i, [max(-(1 << 62), min(1 << 62, math.floor(4096 * x) if abs(x) < 1e15 else int(x) * 4096)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for width in {len(v) for _, v, _ in sound}:
        mine = sorted((r for r in sound if len(r[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        at = [width * p // 8 for p in range(9)]
        books = [[v[at[p] : at[p + 1]] for _, v, _ in mine[:16]] for p in range(8)]

        def best(p, v, books=books, at=at):
            part = v[at[p] : at[p + 1]]
            return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(books[p]))

        for _ in range(6):
            new = []
            for p in range(8):
                groups = {}
                for _, v, _ in mine:
                    groups.setdefault(best(p, v)[1], []).append(v[at[p] : at[p + 1]])
                new.append([[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(books[p])])
            books[:] = new
        name = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for i, v, lab in mine:
            found = [best(p, v) for p in range(8)]
            out.append([i, lab, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), (1 << 63) - 1), 0, name])
    for r in out:
        r[4] = min(sum(q[3] for q in out if q[1] == r[1]), (1 << 63) - 1)
    return sorted((tuple(r) for r in out), key=str)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, v, lab, "x", 3) for i, v, lab in rows], f"vec_id bigint, embedding array<{kind}>, label int, code string, error int")
    return sorted((tuple(r) for r in codes.compress(df).collect()), key=str)


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    df = queries.vector_codes(spark, sf)
    rel = con.sql(queries.ORACLE["op12_vector_codes"])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())


def test_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rng = np.random.default_rng(3)
    rows = [(int(i) * 3, [float(np.float32(x)) for x in rng.normal(size=16)], int(i) % 3 if i % 4 else None) for i in rng.permutation(120)]
    rows += [(rows[0][0], rows[1][1], 1), rows[2], rows[2], (None, rows[3][1], None)]
    rows += [(500, None, 1), (501, [1.0, None] * 8, 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, None), (504, [], 1), (505, [], 2), (506, [0.5] * 11, 1), (507, [-0.5] * 11, 1), (508, [0.25] * 3, None)]
    assert run(spark, rows) == brute(rows)


def test_ties_and_repeats(spark):
    rows = [(i, [float(i % 2)] * 8, 0) for i in range(40)] + [(i, [0.5 + (i % 3) / 4096] * 8, 1) for i in range(40, 60)]
    assert run(spark, rows) == brute(rows)


def test_components_beyond_the_safe_range(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1e5 if i % 3 else 1e3)], i % 2) for i in range(40)] + [(90, [1e300] * 8, 7), (91, [-1e300, 1e14, -5e8, 0.1, 0.0, 0.0, 0.0, 0.0], 7)]
    assert run(spark, rows, "double") == brute(rows)


@pytest.mark.parametrize("scale", [1, 1 << 12, 1 << 20])
def test_screen_is_exact(scale):
    rng = np.random.default_rng(scale)
    v = rng.integers(-scale, scale + 1, (2000, 8))
    entries = np.concatenate((v[:8], v[:8] + rng.integers(-1, 2, (8, 8))))
    index, error = codes.nearest(v, entries)
    far = ((v[:, None] - entries[None]) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (error == far.min(1)).all()


def test_few_and_none(spark):
    assert run(spark, []) == []
    for n in (1, 5):
        rows = [(i, [float(i), 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], None) for i in range(n)]
        assert run(spark, rows) == brute(rows)


def test_error_falls_with_rounds(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").selectExpr("vec_id", "label", "embedding")
    total = [codes.encode(df, codes.train(df, rounds)).groupBy().sum("error").first()[0] for rounds in (0, 6)]
    assert total[1] < 0.9 * total[0]
