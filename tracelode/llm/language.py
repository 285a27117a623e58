"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything else counts as one space; the n-grams of one, two and
three characters are hashed into 2**16 buckets. Training counts buckets on the executors; the
matrix of log-probabilities (buckets x languages) is broadcast; scoring looks up the rows of
the buckets that occur in a text and adds them up, for many texts in one numpy pass.

Defined results: text that is null or has no letter gets ``und`` with score 0; without any
training row every text gets ``und``; repeated rows are scored one by one; a null id is kept;
bytes that are no UTF-8 count as U+FFFD;
columns besides id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, code_points, named, runs_of, utf8

BITS = 16
ORDERS = 3
#: Labelled documents of one language that the model is fitted on, at most in expectation.
TRAIN_PER_LANGUAGE = 4000


def letter_table() -> np.ndarray:
    """Of each code point of the first plane: its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(1 << 16, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(points: np.ndarray, fold: np.ndarray) -> np.ndarray:
    high = points >= len(fold)
    if not high.any():
        return fold[points]
    out = fold[np.where(high, 0, points)]
    some, back = np.unique(points[high], return_inverse=True)
    out[high] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else 0 for c in some.tolist()], np.uint32)[back]
    return out


def buckets_of(raw: np.ndarray, at: np.ndarray, fold: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram that begins at each place (2**BITS where there is none), where each text begins, and its letters."""
    points, starts = code_points(raw, at)
    low, n = letters_of(points, fold), len(at) - 1
    is_letter = low > 0
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1] & (row[1:] == row[:-1])
    count = np.concatenate(([0], np.cumsum(keep)))
    line = np.zeros(int(count[-1]) + 2 * n + 4, np.uint32)
    line[(count[:-1] + 2 * row + 2)[keep]] = low[keep]
    begin = count[starts[:-1]] + 2 * np.arange(n) + 1
    m = len(line) - 3
    a, b, c = line[:m], line[1 : m + 1], line[2 : m + 2]
    first, any_letter, out = a > 0, (a > 0) | (b > 0), []
    for order, (code, ok) in enumerate(
        (
            (a * np.uint32(0x9E3779B1), first),
            (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + np.uint32(0x165667B1), any_letter),
            (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77) + c * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F), any_letter),
        )
    ):
        if order < ORDERS:
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x2C1B3C6D)
            out.append(np.where(ok, (code >> np.uint32(32 - BITS)).astype(np.int64), 1 << BITS))
    has = np.add.reduceat(np.concatenate((is_letter, [False])).astype(np.int64), starts[:-1]) if n else np.zeros(0, np.int64)
    return out, begin, np.where(np.diff(starts) > 0, has, 0)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2**BITS + 1, languages), the last row 0
    prior: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.weights.nbytes + self.prior.nbytes


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, size, counts = letter_table(), (1 << BITS) + 1, {}
    for batch in batches:
        raw, at = utf8(batch.column(0))
        langs = batch.column(1).to_pylist()
        for i, j in runs_of(at):
            grams, begin, _ = buckets_of(raw[at[i] : at[j]], at[i : j + 1] - at[i], fold)
            for lang in set(langs[i:j]):
                total = counts.setdefault(lang, np.zeros(size, np.int64))
                ends = np.append(begin[1:], len(grams[0]))
                for k in (k for k in range(j - i) if langs[i + k] == lang):
                    for g in grams:
                        total += np.bincount(g[begin[k] : ends[k]], minlength=size)
    for lang, total in counts.items():
        hit = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(total[hit], pa.int64())], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> Model:
    """Counts n-grams of the rows with a language, of each language a hashed sample of about per_language rows.

    What comes to the driver is a count for each language and bucket: at most languages x 2**BITS rows.
    """
    rows = labelled.select(F.make_valid_utf8(F.col(text_col).cast("string")).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(key_col).alias("key")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(((1 << BITS) + 1, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(draw < share[F.col("lang")]).select("text", "lang")
    found = sample.mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(sizes)
    counts = np.zeros((1 << BITS, len(names)))
    counts[found["bucket"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()] = found["n"].to_numpy()
    log_p = np.log(counts + 0.5) - np.log(counts.sum(0) + 0.5 * (1 << BITS))
    log_p -= log_p.mean(1, keepdims=True)
    total = sum(sizes.values())
    return Model(names, np.vstack((log_p, np.zeros(len(names)))).astype(np.float32), np.log([sizes[x] / total for x in names]))


def scores(model: Model, raw: np.ndarray, at: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the best language (-1: none) and its probability, for each text.

    N-grams of a text depend on each other, so log-likelihoods are divided by a thirtieth of their number before they become probabilities; this does not change which is best.
    """
    n = len(at) - 1
    best, prob = np.full(n, -1), np.zeros(n)
    if not model.languages or not n:
        return best, prob
    grams, begin, letters = buckets_of(raw, at, fold)
    log_lik = np.zeros((n, len(model.languages)))
    used = np.zeros(n)
    for g in grams:
        log_lik += np.add.reduceat(model.weights[g], begin, axis=0)
        used += np.add.reduceat((g < (1 << BITS)).astype(np.int64), begin)
    joint = log_lik + model.prior
    top = joint.argmax(1)
    cool = (joint - joint.max(1, keepdims=True)) / np.maximum(1, used / 30)[:, None]
    p = np.exp(cool)
    p /= p.sum(1, keepdims=True)
    ok = letters > 0
    best[ok], prob[ok] = top[ok], p[np.arange(n), top][ok]
    return best, prob


def identify(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep of df (but those named like an output column), with lang_pred and score."""
    held = df.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))
    keep, columns = carried(keep, ("lang_pred", "score"))
    rows = df.select(*columns, F.make_valid_utf8(named(text_col).cast("string")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, m = letter_table(), Model(*held.value)
        names = pa.array([*m.languages, "und"], pa.string())
        for batch in batches:
            raw, at = utf8(batch.column(len(keep)))
            best, prob = np.zeros(len(at) - 1, np.int64), np.zeros(len(at) - 1)
            for i, j in runs_of(at):
                best[i:j], prob[i:j] = scores(m, raw[at[i] : at[j]], at[i : j + 1] - at[i], fold)
            pred = names.take(pa.array(np.where(best < 0, len(m.languages), best)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pred, pa.array(prob)], [*batch.schema.names[: len(keep)], "lang_pred", "score"])

    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*keep, "lang_pred", "score")


def held_out(mod: int, rest: int, key_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(key_col).cast("string"), F.lit(""))), F.lit(mod)) == rest
