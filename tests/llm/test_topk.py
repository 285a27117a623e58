import numpy as np
import pytest

from tracelode.llm import queries, topk


def brute(rows, k=5, every=50):
    sound = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % every == 0}):
        a = next(v for i, v in sound if i == q)
        best = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b, strict=False))), i) for i, b in sound if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows], "vec_id bigint, embedding array<float>, rank int, score string")
    return sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect())


def test_tables(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.exact_top_k(spark, sf).collect()) == brute(rows)


def test_ties_repeats_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "SEEDS", 8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(20)] + [(300, None), (301, []), (302, [1.0, None]), (350, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.5, 0.25])]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("hot", [False, True])
def test_groups(spark, monkeypatch, hot):
    monkeypatch.setattr(topk, "QUERY_GROUP", 2)
    monkeypatch.setattr(topk, "CANDIDATE_GROUP", 10)
    monkeypatch.setattr(topk, "BANDS", 5)
    rows = [(i, [float(i % 7), float(i % 3), 1.0] if not hot or i % 3 else [1.0, 2.0, 0.5]) for i in range(320)]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_zeros_and_bounds_of_64_bits(spark):
    rows = [(0, [0.0, 0.0]), (0, [0.0, 0.0]), (50, [3.0, -1.0]), (50, [3.0, -1.0]), (7, [1e17, 0.0]), (8, [-1e17, 0.0]), (9, [1.0])]
    got = run(spark, rows)
    top = (1 << 63) - 1
    assert [r[2:] for r in got if r[0] == 50][0] == (7, top) and [r[2:] for r in got if r[0] == 50][-1] == (8, -(1 << 63))
    assert [r[2] for r in got if r[0] == 0] == [7, 8, 9, 50, 50]
