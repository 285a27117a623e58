import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tracelode.llm import language, queries


def test_held_out_accuracy(spark, sf):
    got = queries.language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, frame, odd):
    docs = frame(odd)
    train = frame([(1, "the cat and the dog"), (2, "der hund und die katze"), (3, None)]).withColumn("lang", F.when(F.col("doc_id") == 1, "en").when(F.col("doc_id") == 2, "de"))
    got = {r["doc_id"]: r for r in language.identify(docs, language.fit(train), ["doc_id"]).collect()}
    assert len(got) == len(odd)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 8))
    assert got[4]["lang_pred"] in ("en", "de") and got[7]["lang_pred"] in ("en", "de")


def test_nothing_to_learn_from(spark, frame):
    empty = frame([]).withColumn("lang", F.lit(None).cast("string"))
    assert language.identify(frame([(1, "abc")]), language.fit(empty), ["doc_id"]).first()["lang_pred"] == "und"
    assert language.identify(frame([]), language.fit(empty), ["doc_id"]).count() == 0


def grams(text):
    """All n-grams of one to three places that begin at a letter, or two or three of which the second is one; a blank stands for what is no letter."""
    line = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = " " + re.sub(" +", " ", line).lstrip() + "  "
    return Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1) if line[i : i + min(n, 2)].strip())


def test_against_brute_force(spark, frame):
    train = [("en", "The cat and the dog ran."), ("en", "It was the dog, I think"), ("de", "Der Hund und die Katze"), ("fr", "Le chat et le chien; été")]
    rows = [(1, "the dog"), (2, "die Hunde und Katzen!"), (3, "et le chien"), (4, "x1y"), (5, "A-B?? c"), (6, "cat. "), (7, "Été")]
    labelled = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id bigint, text string, lang string")
    counts, size = {}, 1 << language.BITS
    for lang, text in train:
        counts.setdefault(lang, Counter()).update(grams(text))
    total = {x: sum(c.values()) + size / 2 for x, c in counts.items()}
    for r in language.identify(frame(rows), language.fit(labelled), ["doc_id"]).collect():
        g = grams(dict(rows)[r["doc_id"]])
        joint = {x: math.log(sum(y == x for y, _ in train) / 4) + sum(n * math.log((counts[x][w] + 0.5) / total[x]) for w, n in g.items()) for x in counts}
        top = max(joint, key=joint.get)
        p = 1 / sum(math.exp((v - joint[top]) / max(1, sum(g.values()) / 30)) for v in joint.values())
        assert r["lang_pred"] == top and abs(r["score"] - p) < 1e-4


def test_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xffthe\xc3 \xe9 cat")), (2, bytearray(b"\xff\xfe"))], "doc_id bigint, text binary")
    train = spark.createDataFrame([(1, "the cat", "en")], "doc_id bigint, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(df, language.fit(train), ["doc_id"]).orderBy("doc_id").collect()] == ["en", "und"]
