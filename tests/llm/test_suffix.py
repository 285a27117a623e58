import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tracelode.llm import suffix


def brute(rows):
    big = 1 << 62
    data = sorted(((i if i is not None else big), (t or "").encode()) for i, t in rows)
    out, seen = [], {}
    for i, b in data:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            seen[w] = min(seen.get(w, big + 1), i)
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        edge = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((None if i == big else i, len(b), int(gone.sum()), edge, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def made(seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "beta", "the", "of", "gamma", "delta", "é", "漢"]
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(60) for _ in range(4)]
    rows = [(i, base[i % 4][int(rng.integers(0, 60)) :] + text(int(rng.integers(0, 30))) + base[(i + 1) % 4][: int(rng.integers(20, 120))]) for i in range(60)]
    return rows + [(100, "ab" * 400), (101, "ab" * 300), (102, "x" * 49), (103, "x" * 50), (104, "x" * 51), (None, base[0]), (105, "q" + "\x00" * 80), (106, "\x00" * 60), (7, base[2])]


@pytest.mark.parametrize("piece", [4 << 20, 3000])
def test_against_brute_force(spark, frame, odd, monkeypatch, piece):
    monkeypatch.setattr(suffix.least_documents, "__defaults__", (piece,))
    rows = made(1) + [(i + 1000, t) for i, t in odd]
    got = sorted((tuple(r) for r in suffix.dedup(frame(rows)).collect()), key=str)
    assert got == brute(rows)


def test_tables(spark, sf, frame):
    rows = rows_of(spark, sf)
    got = sorted((tuple(r) for r in suffix.dedup(frame(rows)).collect()), key=str)
    assert got == brute(rows)
    kept = suffix.dedup(frame(rows[:20]), with_text=True).collect()
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in kept)


def test_empty(frame):
    assert suffix.dedup(frame([])).count() == 0


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    text = rng.choice(np.frombuffer(b"ab", np.uint8), 600)
    wide = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    words = np.zeros(len(text), np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | wide[k : k + len(text)]
    order = suffix.refined(words, 600)
    raw = text.tobytes()
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    shared = suffix.common_prefixes(text, order, np.array([0]), np.array([len(text)]), 50)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :], raw[order[k] :]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert shared[k] == min(n, 50)


def test_a_long_document_is_cut_and_joined(monkeypatch, frame):
    monkeypatch.setattr(suffix, "CHUNK", 500)
    rng = np.random.default_rng(5)
    long = "".join(rng.choice(list("abcdef "), 5000))
    rows = [(1, long[700:2200]), (2, long), (3, long[100:180])]
    got = sorted((tuple(r) for r in suffix.dedup(frame(rows)).collect()), key=str)
    assert got == brute(rows)


def shard_of(rows, monkeypatch):
    """The rows (doc_id, text) as one group whose segments all go to one shard, and what its windows are compared by: bytes of each call."""
    docs = pa.table({"doc_id": pa.array([i for i, _ in rows]), "text": pa.array([t for _, t in rows]), "grp": pa.array([0] * len(rows), pa.int32())})
    parts = []
    for g in range(2):  # each half of the rows is a group
        part = docs.slice(g * len(rows) // 2, len(rows) // 2)
        start, size, _, _ = suffix.segments(*suffix.ordered(part)[1:], suffix.Powers(1))
        ids, raw, at = suffix.ordered(part)
        doc, size = ids[np.searchsorted(at, start, "right") - 1], size + suffix.WINDOW - 1
        parts.append((len(start), doc.tobytes() + size.astype(np.uint8).tobytes() + raw[suffix.within(start, size)].tobytes()))
    seen, plain = [], suffix.least_documents
    monkeypatch.setattr(suffix, "least_documents", lambda text, *a: seen.append(len(text)) or plain(text, *a))
    out = suffix._decide(pa.table({"shard": pa.array([0, 0], pa.int32()), "grp": pa.array([0, 1], pa.int32()), "n": pa.array([n for n, _ in parts]), "blob": pa.array([b for _, b in parts], pa.binary())}))
    return out, seen, sum(n for n, _ in parts)


def test_only_contents_under_a_shared_least_hash_are_compared(monkeypatch):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("abcdefghij "), 20000)) for _ in range(3)]
    out, seen, n = shard_of([(k, t) for k, t in enumerate(texts)] + [(k + 10, t) for k, t in enumerate(texts)], monkeypatch)
    first, second = (out.column("blob")[k].as_py() for k in range(2))
    assert len(first) == 0 and len(second) == 12 * n // 2  # all of the copies, none of the originals
    assert sum(seen) < 2000  # whole copies have nothing to compare


def test_stretches_of_hashes_give_what_one_piece_gives(monkeypatch, frame):
    monkeypatch.setattr(suffix, "STRETCH_BYTES", 200)
    rows = made(3)
    got = sorted((tuple(r) for r in suffix.dedup(frame(rows)).collect()), key=str)
    assert got == brute(rows)
