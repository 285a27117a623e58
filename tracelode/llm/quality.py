"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE code points. Every passage is encoded (shares of
character classes, word repetition, word and line lengths, then one learned ReLU layer); gated
attention, learned from document labels alone, weighs the passages; the weighted sum is scored.
Training runs on a bounded sample of labelled documents; scoring reads every passage of every text.

Defined results: null or empty text is one empty passage and gets the score of that; without
labels every score is 0.5, with one class only it is that class; labels that are null or neither
0 nor 1 are not used; a document labelled twice counts as 1 if most of its labels do; repeated rows
are scored one by one; bytes that are no UTF-8 count as U+FFFD; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, code_points, give_back, named, runs_of, utf8

PASSAGE = 512
#: Labelled documents that the model is fitted on, at most in expectation.
TRAIN_DOCUMENTS = 6000
HIDDEN, ATTENTION, STEPS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4
# The characters of each class; the rest are told apart by what they are.
CLASSES = ((".,;:", 6), ("|", 7), ("#%&*$@^~=+<>_\\/{}[]", 8), ("!", 9), ("?\"'()-", 10))
N_CLASSES = 12


def class_table() -> np.ndarray:
    """0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 line end, 6 to 10 as in CLASSES, 11 a letter outside ASCII."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            out[c] = 2 if ch.isupper() else 1 if c < 128 else 11
        elif ch.isdigit():
            out[c] = 3
        elif ch.isspace():
            out[c] = 5 if ch in "\n\r" else 4
    for chars, k in CLASSES:
        out[[ord(x) for x in chars]] = k
    return out


def encode(raw: np.ndarray, at: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of the texts, and the text of each passage."""
    points, starts = code_points(raw, at)
    length = np.diff(starts)
    per = np.maximum(1, -(-length // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per)))
    owner = np.repeat(np.arange(len(length)), per)
    n = int(first[-1])
    kind = classes[np.where(points < len(classes), points, 0)]
    text = np.repeat(np.arange(len(length)), length)
    passage = first[text] + (np.arange(len(points)) - starts[text]) // PASSAGE
    shares = np.bincount(passage * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES).astype(float)
    size = shares.sum(1)
    blank = (kind == 4) | (kind == 5)
    begins = np.ones(len(points), bool)
    if len(points):
        begins[1:] = blank[:-1] | (text[1:] != text[:-1])
    begins &= ~blank
    words = np.flatnonzero(begins)
    total = np.zeros((n, 5))
    if len(words):
        # a word's hash: the sum over its characters of (character x a power by place), mod 2**64
        place = np.arange(len(points)) - np.repeat(words, np.diff(np.append(words, len(points)))) if words[0] == 0 else np.concatenate((np.zeros(words[0], np.int64), np.arange(words[0], len(points)) - np.repeat(words, np.diff(np.append(words, len(points))))))
        powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        value = np.where(blank, 0, points.astype(np.uint64) * powers[place % 64])
        key = np.add.reduceat(value, words)
        chars = np.add.reduceat((~blank).astype(np.int64), words)
        of = passage[words]
        again = np.zeros(len(words))
        again[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
        order = np.lexsort((key, of))
        new = np.ones(len(words))
        new[1:] = (key[order][1:] != key[order][:-1]) | (of[order][1:] != of[order][:-1])
        total[:, 0] = np.bincount(of, minlength=n)
        total[:, 1] = np.bincount(of, again, minlength=n)
        total[:, 2] = np.bincount(of[order], new, minlength=n)
        total[:, 3] = np.bincount(of, chars, minlength=n)
        total[:, 4] = np.bincount(of, chars > 15, minlength=n)
    count = np.maximum(1, total[:, 0])
    return np.column_stack((np.sqrt(shares / np.maximum(1, size)[:, None]), total[:, 1] / count, total[:, 2] / count, total[:, 3] / count / 10, total[:, 4] / count, np.log1p(total[:, 0]) / 5, np.log1p(size) / 6)).astype(np.float32), owner


def by_text(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Sums of rows of each text; owner rises and misses no text."""
    return np.add.reduceat(values, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))), axis=0)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] | None
    constant: float = 0.5


def forward(p: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    e = np.maximum(0, x @ p["w1"] + p["b1"])
    t = np.tanh(e @ p["v"] + p["bv"])
    g = 1 / (1 + np.exp(-(e @ p["u"] + p["bu"])))
    s = (t * g) @ p["w"]
    a = np.exp(s - s.max())
    a /= by_text(a, owner)[owner]
    z = by_text(a[:, None] * e, owner)
    return {"e": e, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))}


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> Model:
    """Adam on the mean log loss of the documents, from a fixed start."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1), np.ones(1), None, float(y[0]) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = ((x - mean) / scale).astype(float)
    rng = np.random.default_rng(5)
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in {"w1": (x.shape[1], HIDDEN), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,)}.items()}
    p |= {"b1": np.zeros(HIDDEN), "bv": np.zeros(ATTENTION), "bu": np.zeros(ATTENTION), "b": np.zeros(1)}
    m, v = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        f = forward(p, x, owner)
        d = (f["y"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (f["e"] * dz[owner]).sum(1)
        ds = f["a"] * (da - by_text(f["a"] * da, owner)[owner])
        dgate = ds[:, None] * p["w"]
        dt, dg = dgate * f["g"] * (1 - f["t"] ** 2), dgate * f["t"] * f["g"] * (1 - f["g"])
        de = (f["a"][:, None] * dz[owner] + dt @ p["v"].T + dg @ p["u"].T) * (f["e"] > 0)
        grad = {"c": f["z"].T @ d, "b": np.array([d.sum()]), "w": (f["t"] * f["g"]).T @ ds, "v": f["e"].T @ dt, "bv": dt.sum(0), "u": f["e"].T @ dg, "bu": dg.sum(0), "w1": x.T @ de, "b1": de.sum(0)}
        for k in p:
            g = grad[k] + DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = class_table()
    for batch in batches:
        raw, at = utf8(batch.column(2))
        for i, j in runs_of(at, 1 << 18):
            x, owner = encode(raw[at[i] : at[j]], at[i : j + 1] - at[i], classes)
            cut = np.searchsorted(owner, np.arange(j - i + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["key", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", key_col: str = "doc_id", label_col: str = "quality", bound: int = TRAIN_DOCUMENTS) -> Model:
    """Fits on a hashed sample of about bound labelled documents; their passages come to the driver."""
    y = F.col(label_col).cast("double")
    known = labels.select(F.col(key_col).alias("key"), y.alias("y")).filter("y in (0, 1) and key is not null").groupBy("key").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = known.count()
    if not n:
        return train(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0))
    draw = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = F.broadcast(known.filter(draw < min(1.0, bound / n)))  # about bound rows of 16 bytes
    rows = docs.select(F.col(key_col).alias("key"), F.make_valid_utf8(F.col(text_col).cast("string")).alias("text")).join(sample, "key").select("key", "y", "text")
    got = rows.mapInArrow(_encoded, f"key {rows.schema['key'].dataType.simpleString()}, y int, x binary").toArrow().sort_by([("key", "ascending"), ("x", "ascending")])
    if not len(got):
        return train(np.zeros((0, 1)), np.zeros(0, int), np.zeros(0))
    width = N_CLASSES + 6
    parts = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, width) for x in got.column("x")]
    return train(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), got.column("y").to_numpy().astype(float))


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of df (but those named like an output column), with score, predicted and n_passages."""
    held = df.sparkSession.sparkContext.broadcast((model.mean, model.scale, model.p, model.constant))
    keep, columns = carried(keep, ("score", "predicted", "n_passages"))
    text, at_text = named(text_col).cast("string"), keep.index(text_col) if text_col in keep and isinstance(df.schema[text_col].dataType, T.StringType) else None
    # a text that is kept goes to Python once: the last column holds only what make_valid_utf8 changes
    mended = F.make_valid_utf8(text) if at_text is None else F.when(~F.is_valid_utf8(text), F.make_valid_utf8(text))
    rows = df.select(*columns, mended.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        classes, m = class_table(), Model(*held.value)
        for batch in batches:
            texts = batch.column(len(keep))
            if at_text is not None:
                own = batch.column(at_text)
                texts = own if texts.null_count == len(texts) else pc.coalesce(texts.cast(own.type), own)
            raw, at = utf8(texts)
            for i, j in runs_of(at, 1 << 18):
                x, owner = encode(raw[at[i] : at[j]], at[i : j + 1] - at[i], classes)
                out = np.full(j - i, m.constant) if m.p is None else forward(m.p, (x - m.mean) / m.scale, owner)["y"]
                passages = np.bincount(owner, minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[: len(keep)]], pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(passages)], [*batch.schema.names[: len(keep)], "score", "predicted", "n_passages"])
        give_back()

    own = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_passages", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], *own])).toDF(*keep, *[f.name for f in own])
