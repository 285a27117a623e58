import hashlib
import random
import re

from tracelode.llm import pii, queries


def base(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m.group())
        if 16 <= len(digits) <= 19 and sum((d if k % 2 == 0 else d * 2 - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]


def test_base_spans_on_random_texts():
    anchors, rng = pii.automaton(), random.Random(4)
    parts = [*"ab.@+-_ 0123456789()%\né", "4111 1111 1111 1111", "5500-0000-0000-0004", "1.2.3.4.5.6.7.8", "256.1.1.1", "+1 (017) 555-7713", "a@b.c@d.e", "x@y..z", "😀"]
    for _ in range(20000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        assert [s for s in pii.spans(t, anchors) if s[0] in pii.KINDS[:4]] == base(t), t


def test_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.pii_spans(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for k, *_ in want) and all(pii.joined([s]) in r["spans"] for s in want)


def test_added_kinds_and_mask():
    anchors = pii.automaton()
    text = 'see https://a.example.com/x?y=1, IBAN DE89 3704 0044 0532 0130 00 account: 12345678 token = "04dbebab91ab85687d33eeaaf9ac699e"'
    kinds = [k for k, *_ in pii.spans(text, anchors) if k in pii.KINDS[4:]]
    assert kinds == ["url", "account", "account", "secret"]
    assert pii.masked("write to me@x.org now") == "write to [email] now"
    assert not [k for k, *_ in pii.spans("IBAN DE00 3704 0044 0532 0130 00", anchors) if k == "account"]


def test_odd_rows(frame, odd):
    rows = pii.detect(frame(odd), ["doc_id"]).collect()
    assert len(rows) == len(odd) and all(r["spans"] == "" for r in rows)
    assert pii.detect(frame([]), ["doc_id"]).count() == 0


def test_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([(1, bytearray(b"\xff a@b.example \xe9"))], "doc_id bigint, text binary")
    assert pii.detect(df, ["doc_id"]).first()["spans"] == "email:2:13"


def planted(rng, kind):
    """A text with one value of an added kind in one of the forms in which such values are written, and the value."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    if kind == "url":
        host = ".".join(word(2, 9) for _ in range(rng.randint(1, 3))) + rng.choice([".com", ".org", ".de", ".co.uk", ":8080", ""])
        value = rng.choice(["http://", "https://", "ftp://", "HTTPS://"]) + host + rng.choice(["", "/", f"/{word(1, 8)}/{word(1, 8)}.html", f"/?q={word(1, 5)}&p={digits(2)}", f"/#{word(2, 6)}"])
        return rng.choice(["", "see ", "(", '"', "<"]) + value + rng.choice(["", " and", ".", ", so", ")", '"', ">"]), value
    if kind == "account":
        body = digits(18)
        check = 98 - int(body + "131400") % 97  # a made-up country DE
        iban = f"DE{check:02d}{body}"
        value = rng.choice([digits(rng.randint(6, 14)), f"{digits(3)}-{digits(2)}-{digits(4)}", iban, " ".join(iban[i : i + 4] for i in range(0, len(iban), 4))])
        return rng.choice(["account", "Account", "acct", "IBAN", "Konto", "SSN", "passport", "cuenta"]) + rng.choice([": ", " ", "=", " #", " no. ", " number ", " nr: ", "_id: ", " is "]) + value + rng.choice(["", ".", " ok", ","]), value
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
    value = "".join(rng.choice(alphabet) for _ in range(rng.randint(16, 48)))
    return rng.choice(["token", "Secret", "password", "API_KEY", "access_key", "apikey"]) + rng.choice([" = ", ": ", "=", ":", "= "]) + rng.choice(["", '"', "'"]) + value + rng.choice(["", '"', "'", " end", ";"]), value


def test_recall_of_the_added_kinds():
    anchors, rng = pii.automaton(), random.Random(12)
    for kind in ("url", "account", "secret"):
        hit = false = 0
        for _ in range(3000):
            text, value = planted(rng, kind)
            before = "prose of words, 12 of them; " * rng.randint(0, 2)
            found = [(s, e) for k, s, e in pii.spans(before + text, anchors) if k == kind]
            at = len(before) + text.index(value)
            hit += any(s <= at and e >= at + len(value) for s, e in found)
            false += any(e <= at or s >= at + len(value) for s, e in found)
        assert hit >= 0.95 * 3000 and false <= 0.01 * 3000, (kind, hit, false)
    assert not [x for x in pii.spans("prose of 12345678 words without a cue, at no. 7; an accountant is 44 years old", anchors) if x[0] in pii.KINDS[4:]]
