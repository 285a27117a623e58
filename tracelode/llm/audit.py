"""Interaction of filters that are applied one after another, counted on a packed bitmap index.

Each document becomes one small row: its part and a mask of bits, one for each filter that it fails
and one for each mark (good, toxic). Tasks pack the rows of a block into NumPy bitsets, one bit a
document, ordered by part so that each part is a run of whole bytes: a bitset for each filter and
mark, and one of the places in use. For each set of filters that may have run before and each
filter that may come next, AND-NOT and population counts give, for all parts at once, how many
documents the filter removes, keeps, finds already gone, and which marks it costs. Spark adds the
counts up; nothing grows with the documents but the rows themselves. Orders share their prefixes:
k filters have k * 2^(k-1) steps of this kind, from which the k! orders are read by a small join.

`repeats` tells which rows repeat the text of a row with a smaller id: the least id of each text by
its SHA-256, joined back so that texts with many copies are not met in one task.

Defined results: a null text is empty; a null part is the empty string; a null id is neither
smaller nor larger than another, so its row repeats nothing and is repeated by nothing; of equal ids
none is smaller; a row is good (toxic) if any label row of its id says 1; labels of unknown ids and
null marks count for nothing; repeated rows count each; an empty table gives no rows; columns of
other names are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import longs, spread_join, whole, written

WORD = "[^\\x20\\x09-\\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Rows of a block, and parts whose counts a task holds before it hands them on.
BLOCK, PARTS = 1 << 16, 1000
MOST_FILTERS = 6


def text_filters(text: Column) -> dict[str, Column]:
    """Filters A to D, each true where a text fails: few words, repeated words, capitals, odd signs."""
    words, said = F.regexp_count(text, F.lit(WORD)), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": words < 100,
        "B": 100 * F.size(F.array_distinct(said)) < 80 * words,
        "C": 100 * (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame, id_col: str = "doc_id", key: str = "key") -> DataFrame:
    """rows (a written table) with repeats: whether a row with a smaller id has the same key. The key may be held by any share of all rows."""
    firsts = written(rows.groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first")), "firsts")
    return spread_join(rows, firsts, key, "n").withColumn("repeats", F.coalesce(F.col(id_col) > F.col("first"), F.lit(False))).drop("first")


def steps(k: int) -> list[tuple[int, int]]:
    """(filters before as a mask, next filter) for each step that some order of k filters has."""
    return [(before, f) for before in range(1 << k) for f in range(k) if not before >> f & 1]


def counted(mask: np.ndarray, part: np.ndarray, parts: int, k: int) -> np.ndarray:
    """(parts, steps, COUNTS): the counts of a block. Bit f of a mask: filter f fails; bits k and k + 1: good and toxic; part: 0 to parts - 1."""
    size = np.bincount(part, minlength=parts)
    bytes_of = -(-size // 8)
    first = np.concatenate(([0], np.cumsum(bytes_of)))
    order = np.argsort(part, kind="stable")
    rank = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(first[:-1] * 8, size) + rank

    def packed(bits: np.ndarray) -> np.ndarray:
        places = np.zeros(int(first[-1]) * 8, bool)
        places[at] = bits[order]
        return np.packbits(places)

    def ones(bits: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(bits).astype(np.int64), first[:-1])

    fails = [packed(mask >> f & 1 != 0) for f in range(k)]
    good, toxic = packed(mask >> k & 1 != 0), packed(mask >> (k + 1) & 1 != 0)
    used = packed(np.ones(len(mask), bool))
    union = [np.zeros_like(used)]
    for s in range(1, 1 << k):  # a set is the set without its lowest filter, and that one
        low = s & -s
        union.append(union[s ^ low] | fails[low.bit_length() - 1])
    everyone = (1 << k) - 1
    out = np.zeros((parts, len(steps(k)), len(COUNTS)), np.int64)
    for i, (before, f) in enumerate(steps(k)):
        gone = fails[f] & ~union[before]
        out[:, i, 0] = ones(used & ~union[before | 1 << f])
        out[:, i, 1] = ones(gone)
        out[:, i, 2] = ones(fails[f] & union[before])
        out[:, i, 3] = ones(fails[f] & ~union[everyone ^ 1 << f])
        out[:, i, 4] = ones(gone & good)
        out[:, i, 5] = ones(gone & toxic)
    return out


def index(rows: DataFrame, k: int) -> DataFrame:
    """(part, before, filter, COUNTS) of rows (part string, mask): one row for each part and step, from bitsets of each partition."""
    pairs, names = np.array(steps(k), np.int64), COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            sums = np.stack(list(held.values())).reshape(-1, len(names))
            part = pa.array(list(held), pa.string()).take(pa.array(np.repeat(np.arange(len(held)), len(pairs))))
            tiled = np.tile(pairs, (len(held), 1))
            return pa.RecordBatch.from_arrays([part, pa.array(tiled[:, 0]), pa.array(tiled[:, 1]), *[pa.array(c) for c in sums.T]], ["part", "before", "filter", *names])

        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                block = batch.slice(i, BLOCK)
                coded = whole(block.column("part")).dictionary_encode()
                code = longs(coded.indices)
                for lo in range(0, len(coded.dictionary), PARTS):
                    some = np.flatnonzero((code >= lo) & (code < lo + PARTS))
                    values = coded.dictionary.slice(lo, PARTS).to_pylist()
                    got = counted(longs(block.column("mask"))[some], code[some] - lo, len(values), k)
                    for value, counts in zip(values, got, strict=True):
                        held[value] = held[value] + counts if value in held else counts
                    if len(held) > PARTS:
                        yield out()
                        held.clear()
        if held:
            yield out()

    schema = "part string, before long, filter long, " + ", ".join(f"{c} long" for c in names)
    return rows.select("part", "mask").mapInArrow(run, schema).groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in names])


def orders(spark, letters: str) -> DataFrame:
    """(filter_order, step, before, filter): all orders of the filters, a fixed number of rows."""
    rows = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[g] for g in order), step, before, f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, before long, filter long")


def audit(rows: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of the filters and step, of rows (part, mask): COUNTS and shapley, the removals of the step's filter summed over all orders."""
    k = len(letters)
    if not 0 < k <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {k}")
    counts = written(index(rows, k), "steps")
    before = F.bit_count("before")
    weight = F.element_at(F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)]), (before + 1).cast("int")).cast("bigint")  # orders that have this prefix
    worth = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter"))
    counts = counts.withColumn("shapley", worth)
    fixed = orders(rows.sparkSession, letters)  # k * k! rows
    return counts.join(F.broadcast(fixed), ["before", "filter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def marked(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask) of each row: filters A to E in bits 0 to 4, good and toxic above them."""
    text = F.coalesce(F.make_valid_utf8(F.col(text_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    fails = text_filters(F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    rows = written(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("key"), mask.alias("mask")), "masks")
    rows = repeats(rows).select("doc_id", "part", (F.col("mask") + F.when(F.col("repeats"), 16).otherwise(0)).alias("mask"))
    rows = written(rows, "masks")
    named = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0)).alias("g"), F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0)).alias("t"))
    named = named.groupBy("doc_id").agg((32 * F.max("g") + 64 * F.max("t")).alias("bits")).filter("bits > 0 and doc_id is not null")
    ids = rows.groupBy("doc_id").agg(F.count("*").alias("n")).join(named, "doc_id", "left")
    return spread_join(rows, written(ids, "ids"), "doc_id", "n").select("part", (F.col("mask") + F.coalesce("bits", F.lit(0))).alias("mask"))


def audit_sql() -> str:
    """The same as audit(marked(documents, labels), "ABCDE"), for DuckDB."""
    gone = {f: f"(fails & {1 << i}) <> 0" for i, f in enumerate("ABCDE")}
    letter = "".join(f" WHEN '{f}' THEN {1 << i}" for i, f in enumerate("ABCDE"))
    return f"""WITH RECURSIVE l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
r AS (SELECT part, (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM r GROUP BY ALL),
o AS (SELECT '' AS filter_order, 0 AS before, 0 AS bit, 0 AS step UNION ALL
  SELECT filter_order || f, before | bit, CASE f{letter} END, step + 1 FROM o, (VALUES {", ".join(f"('{f}')" for f in gone)}) AS v(f) WHERE NOT contains(filter_order, f)),
s AS (SELECT DISTINCT before, bit FROM o WHERE step > 0),
k AS (SELECT part, before, bit, sum(CASE WHEN fails & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & bit <> 0 AND fails & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails & bit <> 0 AND fails & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, before, bit),
h AS (SELECT p.part, p.bit, sum(removed)::BIGINT AS shapley FROM (SELECT DISTINCT filter_order FROM o WHERE step = 5) a
  JOIN (SELECT filter_order, before, bit, step FROM o WHERE step > 0) b ON starts_with(a.filter_order, b.filter_order) JOIN k p ON p.before = b.before AND p.bit = b.bit GROUP BY p.part, p.bit)
SELECT k.part, a.filter_order, b.step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
FROM (SELECT filter_order FROM o WHERE step = 5) a JOIN o b ON b.step > 0 AND starts_with(a.filter_order, b.filter_order) JOIN k ON k.before = b.before AND k.bit = b.bit JOIN h ON h.part = k.part AND h.bit = k.bit"""
