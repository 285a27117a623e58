import numpy as np
from pyspark.sql import functions as F

from tracelode.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.quality_score(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 100 and sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)


def test_gradient():
    rng = np.random.default_rng(0)
    x, owner = rng.normal(size=(60, 5)), np.repeat(np.arange(20), 3)
    y = (x[:, 0].reshape(20, 3).max(1) > 0.8).astype(float)
    model = quality.train(x, owner, y)
    p = quality.forward(model.p, (x - model.mean) / model.scale, owner)
    assert ((p["y"] >= 0.5) == y).mean() > 0.9
    assert np.allclose(quality.by_text(p["a"], owner), 1)


def test_odd_rows(spark, frame, odd):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 0, 1), (7, None, 0), (None, 1, 1), (9, 5, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(frame(odd), labels)
    rows = quality.score(frame(odd), model, ["doc_id"]).collect()
    assert len(rows) == len(odd) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert quality.fit(frame([]), labels).constant == 0.5
    none = quality.fit(frame(odd), labels.filter(F.lit(False)))
    assert {r["score"] for r in quality.score(frame(odd), none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(frame([]), none, ["doc_id"]).count() == 0


def brute(model, text):
    """The score of one text by loops over passages and places of the layers."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    x, _ = quality.encode(raw, np.array([0, len(raw)]), quality.class_table())
    e, weight = [], []
    for row in x:
        u = [(float(v) - m) / s for v, m, s in zip(row, model.mean, model.scale, strict=True)]
        h = [max(0.0, sum(a * b for a, b in zip(u, model.p["w1"][:, j], strict=True)) + model.p["b1"][j]) for j in range(model.p["w1"].shape[1])]
        lane = lambda w, b, j: sum(a * c for a, c in zip(h, model.p[w][:, j], strict=True)) + model.p[b][j]  # noqa: B023, E731
        weight.append(np.exp(sum(np.tanh(lane("v", "bv", j)) / (1 + np.exp(-lane("u", "bu", j))) * model.p["w"][j] for j in range(len(model.p["w"])))))
        e.append(h)
    z = [sum(w * h[j] for w, h in zip(weight, e, strict=True)) / sum(weight) for j in range(len(e[0]))]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, model.p["c"], strict=True)) + model.p["b"][0])))


def test_against_brute_force(spark, frame, odd):
    rows = [(100 + i, ("some good words in a row. " if i % 2 else "!!! ### $$$ ") * (1 + 40 * (i % 5))) for i in range(40)]
    model = quality.fit(frame(rows), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id bigint, quality int"))
    texts = dict(rows[:10] + [r for r in odd if r[0] != 6])
    got = {r["doc_id"]: r["score"] for r in quality.score(frame(list(texts.items())), model, ["doc_id"]).collect()}
    assert all(abs(got[i] - brute(model, t)) < 1e-5 for i, t in texts.items())


def test_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xffgood\xc3 words\xe9"))], "doc_id bigint, text binary")
    assert quality.score(df, quality.train(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0)), ["doc_id"]).first()["score"] == 0.5


def test_kept_text_with_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xffgood\xc3 words\xe9")), (2, bytearray(b"good words")), (3, None), (4, bytearray())], "doc_id bigint, b binary").selectExpr("doc_id", "cast(b as string) as text")
    rng = np.random.default_rng(3)
    x, owner = rng.normal(size=(20, quality.N_CLASSES + 6)), np.arange(20)
    model = quality.train(x, owner, (x[:, 0] > 0).astype(float))
    apart = {r["doc_id"]: r["score"] for r in quality.score(df, model, ["doc_id"]).collect()}
    kept = quality.score(df, model, ["text", "doc_id"])
    assert {r["doc_id"]: r["score"] for r in kept.select("doc_id", "score").collect()} == apart and len(apart) == 4
    assert {r["doc_id"]: r["h"] for r in kept.selectExpr("doc_id", "hex(cast(text as binary)) as h").collect()} == {r["doc_id"]: r["h"] for r in df.selectExpr("doc_id", "hex(cast(text as binary)) as h").collect()}
