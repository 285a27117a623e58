import numpy as np
import pytest

from tracelode.llm import decontam, queries


def distance(item, text):
    """Fewest edits between the item and a stretch of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, ch in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (ch != t), row[j] + 1, new[j - 1] + 1))
        row = np.array(new)
    return int(row.min())


def plain(t):
    return "".join(" " if c.isspace() else c.lower() if len(c.lower()) == 1 else c for c in t or "")


def test_random_edits(spark, frame):
    rng = np.random.default_rng(8)
    letters = list("abcdefg hij ")
    items = [(i, "".join(rng.choice(letters, int(rng.integers(35, 160))))) for i in range(6)]
    rows = []
    for d in range(40):
        item = list(items[d % 6][1])
        for _ in range(int(rng.integers(0, 16))):
            p, what = int(rng.integers(0, len(item))), int(rng.integers(0, 3))
            item[p : p + 1] = [] if what == 0 else [rng.choice(letters)] if what == 1 else [item[p], rng.choice(letters)]
        rows.append((d, ("".join(rng.choice(letters, int(rng.integers(0, 60))))).upper() + "".join(item) + "".join(rng.choice(letters, int(rng.integers(0, 60))))))
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontam.find(frame(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for d, t in rows:
        for i, x in items:
            e = distance(plain(x), plain(t))
            if e <= decontam.budget(len(x)):
                want[d, i] = e
    assert got == want and 5 < len(want) < 40


def test_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in queries.benchmark_leaks(spark, sf).collect()}
    inside = {(d["doc_id"], b["item_id"]) for d in docs for b in items if plain(b["text"]) in plain(d["text"])}
    assert inside <= got
    assert all(distance(plain(b["text"]), plain(d["text"])) <= decontam.budget(len(b["text"])) for d in docs for b in items if (d["doc_id"], b["item_id"]) in got - inside)


@pytest.mark.parametrize("items", [[], [(1, None), (2, ""), (3, "short")], [(1, "word word word word word word word word"), (1, "word word word word word word word word")]])
def test_odd_rows(spark, frame, odd, items):
    got = decontam.find(frame(odd), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r["doc_id"] for r in got} <= {6}
    assert decontam.find(frame([]), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def exact(rows, items):
    return {(d, i, distance(plain(x), plain(t))) for d, t in rows for i, x in items if x and t and distance(plain(x), plain(t)) <= decontam.budget(len(x))}


@pytest.mark.parametrize("entries", [1 << 19, 700])
def test_short_items_and_runs(spark, frame, monkeypatch, entries):
    monkeypatch.setattr(decontam, "ENTRIES", entries)
    items = [(1, "aaaaa"), (2, "12:30"), (3, "a" * 31), (4, "tiny word."), (5, " " * 90), (6, "ab" * 40), (7, "a" * 60 + "b"), (8, "x"), (9, "12:30"), (10, "abcabcab")]
    rows = [(1, "at 12:30 o'clock"), (2, "a" * 300), (3, " " * 400), (4, "ab" * 150), (5, "b" + "a" * 58 + "c" + "a" * 40), (6, "A TINY\tWORD."), (7, "x"), (8, "nothing here"), (9, "a" * 30), (10, "12:3 0 abcabcaXb"), (11, "zzabcabcab" + "a" * 70 + "b")]
    got = {(r["doc_id"], r["item_id"], r["n_edits"]) for r in decontam.find(frame(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == exact(rows, items) and len({i for _, i, _ in got}) == 10


def test_matches_do_not_cross_texts(spark, frame):
    got = decontam.find(frame([(1, "abcde"), (2, "fghij"), (3, "xx abcdefghij")]), spark.createDataFrame([(1, "abcdefghij"), (2, "efg")], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["end_at"]) for r in got} == {(3, 1, 13), (3, 2, 10)}


def test_memory_of_runs():
    import tracemalloc

    index = decontam.Index([1, 2], [np.full(600, 32, np.uint32), np.full(1500, 97, np.uint32)], 8)
    points = np.concatenate([np.full(64_000, 32), np.full(6_000, 97)]).astype(np.uint32)
    tracemalloc.start()
    got = decontam.matches(points, np.array([0, 64_000, 70_000]), index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(t, i, e) for t, i, e, _ in got] == [(0, 0, 0), (1, 1, 0)] and peak < 200 << 20
