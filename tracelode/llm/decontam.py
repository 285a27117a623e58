"""Benchmark decontamination by the q-gram lemma.

A text is contaminated by a benchmark item if some stretch of it is within k edits of the item (k:
EDIT_PERCENT of its length). Such a stretch shares at least m - q + 1 - k q of the item's q-grams,
on diagonals that are k apart at most. Texts are hashed q-gram by q-gram; regions with too few
grams of any item of that length are left; the rest are counted in overlapping bands of diagonals;
bands that meet the lemma's bound are verified by alignment within the band.

Hits open their posting entries in pieces of ENTRIES; counts of bands are carried on from piece to
piece until a band is complete, so memory does not grow with runs of a character. Items under LEAST
characters have no edits to spare and match exactly; those under Q characters have no q-gram and are
looked up by hashes of their own length.

Letter case and kinds of white space don't count. Defined results: null text or item is empty and
matches nothing; items may repeat and each is reported; rows that share an id are reported each;
tables may be empty; other columns are not looked at; bytes that are no UTF-8 count as U+FFFD. The
benchmark is read in blocks of BLOCK_CHARS, which are broadcast one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, runs_of, text_of, utf8, within

Q, EDIT_PERCENT, LEAST = 8, 8, 32
BLOCK_CHARS = 4_000_000
#: Posting entries (about 60 bytes each while they are counted) that a task opens at once.
ENTRIES = 1 << 19
A = np.uint32(0x9E3779B1)


def plain_table() -> np.ndarray:
    """Lower case of each code point of the first plane, where that is one character; white space is a blank."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isspace():
            out[c] = 32
        elif ch.isupper() and len(low := ch.lower()) == 1:
            out[c] = ord(low)
    return out


def plain(points: np.ndarray, fold: np.ndarray) -> np.ndarray:
    high = points >= len(fold)
    return np.where(high, points, fold[np.where(high, 0, points)])


def grams(p: np.ndarray, q: int = Q) -> np.ndarray:
    """32-bit hash of the q code points from each place."""
    if len(p) < q:
        return np.zeros(0, np.uint32)
    g = p[: len(p) - q + 1].astype(np.uint32)
    if q == Q:  # by doubling
        g, step, factor = p, 1, int(A)
        while step < Q:
            g = g[:-step] * np.uint32(factor & 0xFFFFFFFF) + g[step:]
            factor, step = factor * factor, step * 2
    else:
        for k in range(1, q):
            g = g * A + p[k : len(p) - q + 1 + k]
    g = g ^ (g >> np.uint32(16))
    return g * np.uint32(0x85EBCA6B)


def budget(m: int, percent: int = EDIT_PERCENT) -> int:
    """Edits that an item of m characters may have: so many that the lemma still asks for a shared gram; none under LEAST."""
    return 0 if m < LEAST else max(0, min(m * percent // 100, (m - Q) // Q))


class Lengths:
    """The q-grams of the items of like length: their hashes in order with item and place, and a table of their first bits."""

    def __init__(self, some: np.ndarray, items: list[np.ndarray], least: int, reach: int):
        code = [grams(items[i]) for i in some]
        flat = np.concatenate(code)
        order = np.argsort(flat, kind="stable")
        self.codes, self.item = flat[order], np.repeat(some, [len(c) for c in code])[order]
        self.place = np.concatenate([np.arange(len(c)) for c in code])[order]
        self.least, self.reach = least, reach
        self.shift = np.uint32(32 - min(26, max(12, len(flat).bit_length() + 3)))
        self.has = np.zeros(1 << (32 - int(self.shift)), bool)
        self.has[flat >> self.shift] = True


def taken_apart(index: "Index") -> dict:
    """The arrays of an index without its classes, as a broadcast needs no copy of this package on executors then."""
    return vars(index) | {"classes": [vars(c) for c in index.classes]}


def put_together(state: dict) -> "Index":
    index = Index.__new__(Index)
    index.__dict__ = dict(state)
    index.classes = []
    for arrays in state["classes"]:
        c = Lengths.__new__(Lengths)
        c.__dict__ = dict(arrays)
        index.classes.append(c)
    return index


class Index:
    """The q-grams of a block of items by classes of lengths, and the items without any by length."""

    def __init__(self, ids: list[int], items: list[np.ndarray], percent: int):
        self.ids, self.items = ids, items
        self.m = np.array([len(x) for x in items], np.int64)
        self.k = np.array([budget(len(x), percent) for x in items], np.int64)
        self.least = self.m - Q + 1 - self.k * Q
        kind = np.where(self.m < Q, -self.m, (2 * np.log2(np.maximum(self.m, 1))).astype(int))
        self.classes, self.short = [], []
        for c in np.unique(kind).tolist():
            some = np.flatnonzero(kind == c)
            if c < 0:
                code = np.concatenate([grams(items[i], -c) for i in some])
                order = np.argsort(code, kind="stable")
                self.short.append((-c, code[order], some[order]))
            else:
                self.classes.append(Lengths(some, items, int(self.least[some].min()), int((self.m + self.k)[some].max())))


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """Fewest edits that turn the item into a stretch of text on diagonals low to high, and where that stretch ends."""
    width = high - low + 1
    lane = np.arange(width)
    big = len(item) + width + 1
    wide = np.full(len(item) + width, np.uint32(0xFFFFFFFF))
    a, b = max(0, low), min(len(text), low + len(wide))
    if a < b:
        wide[a - low : b - low] = text[a:b]
    inside = (low + lane >= 0) & (low + lane <= len(text))
    row = np.where(inside, 0, big)
    for i, ch in enumerate(item):
        cost = row + (wide[i : i + width] != ch)
        cost[:-1] = np.minimum(cost[:-1], row[1:] + 1)
        row = np.minimum.accumulate(cost - lane) + lane
    end = low + len(item) + lane
    row = np.where((end >= 0) & (end <= len(text)), row, big)
    t = int(row.argmin())
    return int(row[t]), int(end[t])


def summed(code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, with their counts added up."""
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[first], (np.add.reduceat(count, first) if len(first) else count)


def whole_bands(points: np.ndarray, h: np.ndarray, row: np.ndarray, sound: np.ndarray, index: Index, c: Lengths, best: dict):
    """(text, item, low, high) of each band of diagonals that has as many grams of an item as the lemma asks for, unless best has the item without an edit."""
    hit = c.has[h >> c.shift] & sound
    count = np.concatenate(([0], np.cumsum(hit)))
    ends = np.minimum(np.arange(len(h)) + c.reach, len(h))
    full = np.flatnonzero(count[ends] - count[:-1] >= c.least)
    if not len(full):
        return
    mark = np.zeros(len(h) + 1, np.int32)
    mark[full] += 1
    mark -= np.bincount(ends[full], minlength=len(h) + 1).astype(np.int32)
    at = np.flatnonzero(hit & (np.cumsum(mark)[:-1] > 0))
    left = np.searchsorted(c.codes, h[at])
    n = np.searchsorted(c.codes, h[at], "right") - left
    at, left, n = at[n > 0], left[n > 0], n[n > 0]
    opened, items, base = np.cumsum(n), len(index.items), c.reach
    bits = (len(h) + 4 * base + 8).bit_length()
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * 2
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(opened, (opened[a - 1] if a else 0) + ENTRIES, "right")))
        entry, where = within(left[a:b], n[a:b]), np.repeat(at[a:b], n[a:b])
        item, diagonal, pair = c.item[entry], where - c.place[entry], row[where] * items + c.item[entry]
        done = [t * items + i for (t, i), v in best.items() if v[0] == 0]
        if done:
            open_ = ~np.isin(pair, np.array(done))
            item, diagonal, pair = item[open_], diagonal[open_], pair[open_]
        reached = int(at[b]) if b < len(at) else 1 << 62
        for shift in (0, 1):
            half = index.k[item] + 1
            code = (pair << bits) | ((diagonal + shift * half) // (2 * half) + base)
            code, many = summed(np.concatenate((held[shift][0], code)), np.concatenate((held[shift][1], np.ones(len(code), np.int64))))
            t, i = np.divmod(code >> bits, items)
            half = index.k[i] + 1
            low = ((code & ((1 << bits) - 1)) - base) * 2 * half - shift * half
            complete = low + 2 * half + index.m[i] <= reached
            held[shift] = code[~complete], many[~complete]
            for x in np.flatnonzero(complete & (many >= index.least[i])).tolist():
                yield int(t[x]), int(i[x]), int(low[x]), int(low[x] + 2 * half[x] - 1)
        a = b


def matches(points: np.ndarray, starts: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, end) of every item within its budget of a stretch of a text; the best stretch of each."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    h = grams(points)
    if len(h):
        row = np.searchsorted(starts, np.arange(len(h)), "right") - 1
        sound = np.arange(len(h)) + Q <= starts[row + 1]
        for c in index.classes:
            for t, i, low, high in whole_bands(points, h, row, sound, index, c, best):
                if best.get((t, i), (1, 0))[0]:
                    s, k = int(starts[t]), int(index.k[i])
                    edits, end = aligned(index.items[i], points[s : starts[t + 1]], low - s - k, high - s + k)
                    if edits <= k and (edits, end) < best.get((t, i), (1 << 30, 0)):
                        best[t, i] = edits, end
    for q, codes, items in index.short:
        g = grams(points, q)
        at = np.flatnonzero(np.isin(g, codes))
        left = np.searchsorted(codes, g[at])
        n = np.searchsorted(codes, g[at], "right") - left
        text = np.searchsorted(starts, at, "right") - 1
        for x in np.flatnonzero(at + q <= starts[text + 1]).tolist():
            t, p = int(text[x]), int(at[x])
            for i in items[left[x] : left[x] + n[x]].tolist():
                if (t, i) not in best and (points[p : p + q] == index.items[i]).all():
                    best[t, i] = 0, p + q - int(starts[t])
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = EDIT_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_edits, end_at) of every item that a document holds, by the best stretch; end_at in code points, exclusive."""
    spark = docs.sparkSession
    rows = text_of(docs, id_col, text_col, valid=True).filter("length(text) > 0")
    items = text_of(benchmark, item_col, item_text_col, valid=True).filter("length(text) > 0")
    size = int(items.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()[0])
    blocks, out, schema = max(1, -(-size // BLOCK_CHARS)), None, "doc_id bigint, item_id bigint, n_edits int, end_at bigint"
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == b)
        fold, got = plain_table(), part.orderBy("doc_id", "text").collect()  # a block: BLOCK_CHARS characters
        points = [plain(np.array([ord(c) for c in r["text"]], np.uint32), fold) for r in got]
        held = spark.sparkContext.broadcast(taken_apart(Index([r["doc_id"] for r in got], points, percent)) if got else None)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index, fold = held.value and put_together(held.value), plain_table()
            for batch in batches if index is not None else ():
                raw, at = utf8(batch.column(1))
                rows, item, edits, ends = [], [], [], []
                for i, j in runs_of(at):
                    p, starts = code_points(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                    for t, k, e, end in matches(plain(p, fold), starts, index):
                        rows.append(i + t)
                        item.append(index.ids[k])
                        edits.append(e)
                        ends.append(end)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(ends, pa.int64())], ["doc_id", "item_id", "n_edits", "end_at"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
