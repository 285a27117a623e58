import re
from collections import Counter

import numpy as np
import pytest

from tracelode.llm import components, jaccard


def grams(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = [(i, grams(t, k)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for n, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(n)
    for n, (i, s) in enumerate(sets):
        for m, c in Counter(m for g in s for m in where[g] if m > n).items():
            if 100 * c >= percent * (len(s) + len(sets[m][1]) - c):
                a, b = find(i), find(sets[m][0])
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def made(seed):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 300, int(rng.integers(3, 90)))] for _ in range(6)]
    rows = []
    for i in range(150):
        words = list(base[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"n{rng.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("k", "percent", "tile", "block"), [(3, 90, 8000, 1000), (5, 80, 5, 3), (2, 60, 8000, 10), (3, 90, 4, 1000)])
def test_against_brute_force(frame, odd, monkeypatch, k, percent, tile, block):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = made(k) + [(i + 1000, t) for i, t in odd]
    assert sorted(tuple(r) for r in jaccard.join(frame(rows), k, percent).collect()) == brute(rows, k, percent)


def test_tables(spark, sf, frame):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in jaccard.join(frame(rows)).collect()) == brute(rows, 3, 90)


def test_repeated_rows_null_ids_and_empty(frame):
    got = jaccard.join(frame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None)])).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]
    assert jaccard.join(frame([])).count() == 0


def test_different_texts_under_one_id(frame):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (2, a + " x"), (3, b + " y"), (5, None), (7, ""), (8, "c d e f"), (9, "c d e f"), (9, "g"), (4, "g"), (9, "g")]
    got = sorted((r[0], r[2]) for r in jaccard.join(frame(rows)).collect())
    assert got == [(2, 2), (3, 2), (4, 4), (5, 2), (5, 2), (5, 2), (7, 7), (8, 4), (9, 4), (9, 4), (9, 4)]


def template(n, size=40):
    """Texts of one length that share their rare words and differ in some of 8 places, in two groups that don't link."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        words = [f"{'ab'[i % 2]}{k}" for k in range(size)] + ["both", "groups", "share", "this"] * (i % 3 == 0)
        words[int(rng.integers(0, size))] = f"n{i}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("n", "tile", "block", "hot"), [(400, 50, 20, 1 << 26), (400, 50, 20, 1000), (1200, 300, 100, 1 << 20)])
def test_hot_tiles_and_keys(frame, monkeypatch, n, tile, block, hot):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HOT_BUCKET_BYTES", hot)
    rows = template(n)
    assert sorted(tuple(r) for r in jaccard.join(frame(rows), 3, 80).collect()) == brute(rows, 3, 80)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == 100
