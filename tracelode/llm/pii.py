"""Personal data by anchor expansion.

One Aho-Corasick automaton finds at-signs, plus signs, digits, address schemes and identifier
cues in a text; from each anchor a local parser goes left and right and validates what it has
taken in. Base kinds are email, ip, card and phone; the method adds url (scheme anchors), account
(cue and number, or an IBAN with its check digits) and secret (cue and a long value).

Defined results: null text is empty and has no spans; spans of one kind do not overlap; offsets
are code points, end exclusive; repeated rows give repeated rows; bytes that are no UTF-8 count as
U+FFFD; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, named

# Kinds in order, anchors, and the characters of each part.
KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ftps://")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "cuenta", "compte", "passport", "ssn")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
URL = re.compile(r"[^\s<>\"'`]+")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#]|\Z)")
NUMBER = re.compile(r"(?:[\s_-]{0,2}(?i:no|nr|num|number|id|is)\b)?[\s:#=.\"']{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}|[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])")
VALUE = re.compile(r"\s{0,2}[:=]\s{0,2}[\"']?([A-Za-z0-9_/+.=-]{16,})")


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [("@", "email"), ("+", "phone"), *((d, "digit") for d in "0123456789"), *((s, "url") for s in SCHEMES), *((c, "account") for c in ACCOUNT_CUES), *((c, "secret") for c in SECRET_CUES)]:
        for form in {word, word.upper(), word.capitalize()}:
            found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind and start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)
    n = len(text)
    for end, (kind, size) in anchors.iter(text):
        at = end - size + 1
        if kind == "digit":
            if at >= done["card"]:
                m = CHAIN.match(text, at)
                done["card"] = m.end()
                if m.end() - at >= 16 and 16 <= len(digits := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    out["card"].append(m.span())
            if at >= done["ip"]:
                m = DOTTED.match(text, at)
                done["ip"] = m.end()
                if m.end() - at >= 7 and len(parts := m.group().split(".")) >= 4:
                    start = at
                    for k in range(0, len(parts) - 3, 4):
                        stop = start + len(".".join(parts[k : k + 4]))
                        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in parts[k : k + 4]):
                            out["ip"].append((start, stop))
                        start = stop + 1
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                done["email"] = m.end()
        elif kind == "phone":
            if at + 1 < n and text[at + 1] in DIGITS:
                k = at + 2
                while k < n and text[k] in PHONE:
                    k += 1
                while k > at + 2 and text[k - 1] not in DIGITS:
                    k -= 1
                if k >= at + 4 and 8 <= sum(c in DIGITS for c in text[at:k]) <= 15:
                    out["phone"].append((at, k))
        elif at >= done[kind]:
            if kind == "url":
                stop = URL.match(text, at).end()
                while text[stop - 1] in ".,;:!?)]}":
                    stop -= 1
                if stop > end + 1 and HOST.match(text[end + 1 : stop]):
                    out["url"].append((at, stop))
                    done["url"] = stop
            elif m := (NUMBER if kind == "account" else VALUE).match(text, end + 1):
                if kind == "secret" or m.group(1)[0] in DIGITS or iban(m.group(1)):
                    out[kind].append(m.span(1))
                    done[kind] = m.end(1)
    return [(k, s, e) for k in KINDS for s, e in sorted(out[k])]


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def detect(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of df (but those named like an output column), with a count for each base kind, base_sha256, spans, and n_added."""
    own = (*(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "n_added")
    keep, columns = carried(keep, own)
    rows = df.select(*columns, F.make_valid_utf8(named(text_col).cast("string")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = [spans(x, anchors) if x else [] for x in part.column(len(keep)).to_pylist()]
                base = [[s for s in f if s[0] in KINDS[:4]] for f in found]
                counts = [pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in KINDS[:4]]
                digest = pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base])
                added = pa.array([len(f) - len(b) for f, b in zip(found, base, strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *counts, digest, pa.array([joined(f) for f in found], pa.string()), added], [*part.schema.names[: len(keep)], *own])

    schema = T.StructType([*rows.schema.fields[: len(keep)], *[T.StructField(c, T.StringType() if c in ("base_sha256", "spans") else T.LongType()) for c in own]])
    return rows.mapInArrow(run, schema).toDF(*keep, *own)


def masked(text: str, anchors=None) -> str:
    """The text with each span replaced by its kind in brackets; where spans overlap, the earlier kind in KINDS wins."""
    taken: list[tuple[int, int, str]] = []
    for kind, start, end in spans(text, anchors or automaton()):
        if all(end <= s or start >= e for s, e, _ in taken):
            taken.append((start, end, kind))
    out, last = [], 0
    for start, end, kind in sorted(taken):
        out += [text[last:start], f"[{kind}]"]
        last = end
    return "".join(out) + text[last:]
