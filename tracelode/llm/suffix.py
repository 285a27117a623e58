"""Removal of repeated passages by suffix arrays over UTF-8 bytes.

A byte is removed if it lies in a WINDOW-byte string that also starts in a document with a smaller id.

Each window goes to the shard that its least k-gram hash names, so equal windows meet in one
shard; neighbouring windows with the same least hash travel as one segment. Windows whose least
hash occurs in one document only can't repeat and stay where they are. In a shard, segments of equal
content are one, and only those that share their least hash with another content are compared: by
stretches of these hashes, cut into pieces of bounded size; each piece gets a suffix array by
Larsson-Sadakane refinement and common prefixes by Kasai's rule; pieces of one hash are merged by
binary search of their sorted windows. The
smallest document of every window goes back to the documents, which are read in groups of bounded size.

Defined results: null text is empty; a text under WINDOW bytes, or one that repeats only itself,
loses nothing; rows that share an id don't remove from each other; a row without an id counts as
having the largest; an empty table gives no rows; other columns are not looked at. Hashes choose
shards and join equal segments (64 bits); windows are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, mixed, runs_of, spans_of, text_of, utf8, within

WINDOW, GRAM = 50, 19
SPAN = WINDOW - GRAM + 1  # k-grams of a window, and windows of a segment at most: a mask has 32 bits
GROUP_BYTES, SHARD_BYTES, PIECE_BYTES = 8 << 20, 4 << 20, 4 << 20
#: Bytes that a numpy pass hashes at once, and of segments that are compared at once: tables of 64 bits a byte then stay in the cache of a core.
CHUNK, STRETCH_BYTES = 1 << 17, 1 << 18
LEAST = 48
BASE = 0x9FB21C651E98DF25
LAST = (1 << 63) - 1


class Powers:
    """Byte values and powers of the base, for hashes of any stretch of a block."""

    def __init__(self, n: int):
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        self.up, self.down = self.series(BASE, n), self.series(pow(BASE, -1, 1 << 64), n)

    @staticmethod
    def series(x: int, n: int) -> np.ndarray:
        out = np.full(n + 1, np.uint64(x))
        out[0] = 1
        return np.cumprod(out)

    def totals(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.up):
            self.__init__(len(raw))
        out = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.values[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def hashes(self, totals: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mixed((totals[start + size] - totals[start]) * self.down[start] + size.astype(np.uint64))


def blocks(at: np.ndarray):
    """(first row, last row, first byte, last window start) of stretches to hash at once; a long row is cut, with windows that go over the cut."""
    for i, j in runs_of(at, CHUNK):
        if at[j] - at[i] <= 2 * CHUNK:
            yield i, j, int(at[i]), int(at[j])
        else:
            for a in range(int(at[i]), int(at[j]), CHUNK):
                yield i, j, a, min(a + CHUNK, int(at[j]))


def segments(raw: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, least k-gram hash and content hash of every segment of the rows."""
    out: list[tuple[np.ndarray, ...]] = []
    for i, j, a, b in blocks(at):
        stop = min(b + WINDOW - 1, int(at[j]))
        part = raw[a:stop]
        n = len(part) - WINDOW + 1
        if n <= 0:
            continue
        totals = powers.totals(part)
        m = len(part) - GRAM + 1
        least = mixed((totals[GRAM:] - totals[:m]) * powers.down[:m])
        step = 1
        while step < SPAN:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = least[:n]
        ok = np.ones(n, bool)
        for e in at[i + 1 : j]:  # windows that would go over the end of a row
            ok[max(0, int(e) - a - WINDOW + 1) : max(0, int(e) - a)] = False
        edge = np.ones(n, bool)
        edge[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])
        start = np.flatnonzero(edge)
        size = np.diff(np.append(start, n))
        live = ok[start]
        start, size = start[live], size[live]
        pieces = -(-size // SPAN)
        first = within(np.zeros(len(start), np.int64), pieces) * SPAN
        size = np.minimum(SPAN, np.repeat(size, pieces) - first)
        start = np.repeat(start, pieces) + first
        if len(start):
            out.append((start + a, size, least[start], powers.hashes(totals, start, size + WINDOW - 1)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def pieces(first: np.ndarray, n: int):
    """(from, to) of the stretches that begin at first and end where the next begins, or at n."""
    return zip(first.tolist(), [*first[1:].tolist(), n][: len(first)], strict=True)


def keyed(least: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash, and 32 further bits of it."""
    return ((least >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), (least & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def ordered(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null: the largest), bytes and row starts of a group of documents."""
    raw, at = utf8(docs.column("text"))
    return longs(docs.column("doc_id"), LAST), raw, at


def cuts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def distinct_keys(least: np.ndarray, doc: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Ascending (bucket, key), whether two documents here have it, the order of the rows by it and where it begins in them."""
    bucket, key = keyed(least, buckets)
    code = (bucket.astype(np.uint64) << np.uint64(32)) | key
    order = np.argsort(code, kind="stable")
    code, doc = code[order], doc[order]
    first = cuts(code)
    return (code[first] >> np.uint64(32)).astype(np.int64), (code[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)) if len(first) else np.zeros(0, bool), order, first


def _offer(buckets: int):
    """Of a group of documents, the distinct least hashes by bucket."""

    def run(docs: pa.Table) -> pa.Table:
        ids, raw, at = ordered(docs)
        start, _, least, _ = segments(raw, at, Powers(2 * CHUNK + WINDOW))
        doc = ids[np.searchsorted(at, start, "right") - 1]
        bucket, key, many, _, _ = distinct_keys(least, doc, buckets)
        first = cuts(bucket)
        blobs = [key[a:b].tobytes() + np.packbits(many[a:b]).tobytes() for a, b in pieces(first, len(key))]
        group = docs.column("grp")[0].as_py()
        return pa.table({"bucket": pa.array(bucket[first], pa.int32()), "grp": pa.array([group] * len(first), pa.int32()), "n": pa.array([b - a for a, b in pieces(first, len(key))], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _shared(part: pa.Table) -> pa.Table:
    """For each group the bits of its keys in this bucket that another document has too."""
    sizes = longs(part.column("n"))
    keys, many = [], []
    for n, blob in zip(sizes.tolist(), part.column("blob"), strict=True):
        b = blob.as_py()
        keys.append(np.frombuffer(b, "<u4", n))
        many.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=4 * n), count=n))
    _, back, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    flag = np.zeros(len(count), bool)
    flag[back[np.concatenate(many) > 0]] = True
    flag |= count > 1
    ends = np.cumsum(sizes)
    bits = [np.packbits(flag[back[e - n : e]]).tobytes() for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return pa.table({"grp": part.column("grp"), "bucket": part.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _send(buckets: int, shards: int):
    """Of a group, each distinct segment that may repeat, by shard, with the smallest document that has it here."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        none = pa.table({"shard": pa.array([], pa.int32()), "grp": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
        if not len(docs) or not len(replies):
            return none
        ids, raw, at = ordered(docs)
        start, size, least, content = segments(raw, at, Powers(2 * CHUNK + WINDOW))
        doc = ids[np.searchsorted(at, start, "right") - 1]
        bucket, key, _, by_key, begin = distinct_keys(least, doc, buckets)
        flag, bits = np.zeros(len(key), bool), dict(zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True))
        first = cuts(bucket)
        for a, b in pieces(first, len(key)):
            flag[a:b] = np.unpackbits(np.frombuffer(bits[int(bucket[a])], np.uint8), count=b - a) > 0
        mine = np.empty(len(least), bool)
        mine[by_key] = np.repeat(flag, np.diff(np.append(begin, len(least))))
        start, size, least, content, doc = start[mine], size[mine], least[mine], content[mine], doc[mine]
        order = np.lexsort((doc, content))
        order = order[cuts(content[order])]
        start, size, doc, to = start[order], size[order], doc[order], (mixed(least[order]) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        start, size, doc, to = start[order], size[order] + WINDOW - 1, doc[order], to[order]
        first = cuts(to)
        blobs = [doc[a:b].tobytes() + size[a:b].astype(np.uint8).tobytes() + raw[within(start[a:b], size[a:b])].tobytes() for a, b in pieces(first, len(to))]
        group = docs.column("grp")[0].as_py()
        return pa.table({"shard": pa.array(to[first], pa.int32()), "grp": pa.array([group] * len(first), pa.int32()), "n": pa.array([b - a for a, b in pieces(first, len(to))], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def refined(words: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of a text given by the eight bytes at each place, sorted to depth bytes, by Larsson-Sadakane refinement.

    Groups of suffixes that agree in h bytes are sorted by the group of the suffix h further on, then h doubles; places whose group has one suffix are done and not touched again.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    edge = np.concatenate(([True], words[order][1:] != words[order][:-1]))
    group = np.zeros(n, np.int64)
    group[order] = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    h = 8
    while h < depth:
        size_one = edge & np.concatenate((edge[1:], [True]))
        open_ = np.flatnonzero(~size_one)
        if not len(open_):
            break
        places = order[open_]
        ahead = places + h
        key = np.where(ahead < n, group[np.minimum(ahead, n - 1)] + 1, 0)
        own = group[places]
        again = np.argsort((own.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64), kind="stable")
        order[open_] = places[again]
        own, key = own[again], key[again]
        edge[open_] = np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1])))
        new = np.maximum.accumulate(np.where(edge[open_], open_, 0))
        group[order[open_]] = new
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, start: np.ndarray, count: np.ndarray, cap: int) -> np.ndarray:
    """By Kasai's rule, the bytes (cap at most) that each suffix of order shares with the one before it.

    start and count: the stretches of neighbouring places that order holds. All stretches advance
    together: what place i shares, less one, is where the comparison of place i + 1 begins, if the
    successor of the suffix before i comes before i + 1 in order.
    """
    n = len(text)
    text = np.concatenate((text, np.zeros(cap + 1, np.uint8)))
    before = np.full(n + 1, -1)
    before[order[1:]] = order[:-1]
    rank = np.full(n + 2, n + 1)
    rank[order] = np.arange(len(order))
    shared = np.zeros(n + 1, np.int64)
    by_count = np.argsort(-count, kind="stable")
    start, count = start[by_count], count[by_count]
    h = np.zeros(len(start), np.int64)
    for t in range(int(count[0]) if len(count) else 0):
        live = int(np.searchsorted(-count, -t, "left"))  # stretches of more than t places
        i = start[:live] + t
        j = before[i]
        if t:
            last = before[i - 1]
            h = np.where((last >= 0) & (rank[last + 1] < rank[i]), np.maximum(h[:live] - 1, 0), 0)
        h = np.where(j < 0, 0, h[:live])
        go = np.flatnonzero(j >= 0)
        while len(go):
            go = go[(h[go] < cap) & (text[i[go] + h[go]] == text[j[go] + h[go]])]
            h[go] += 1
        shared[i] = h
    return shared[order]


def least_documents(text: np.ndarray, start: np.ndarray, count: np.ndarray, doc: np.ndarray, piece_bytes: int = PIECE_BYTES) -> np.ndarray:
    """For every window (count of them from each start, one after another) the smallest document that has the same window."""
    ends = np.cumsum(count + WINDOW - 1)
    piece = (ends - 1) // piece_bytes
    first = cuts(piece)
    least, sorted_windows = [], []
    for a, b in pieces(first, len(start)):
        lo, hi = int(start[a]), int(start[b - 1] + count[b - 1] + WINDOW - 1)
        part = text[lo:hi]
        wide = np.concatenate((part, np.zeros(8, np.uint8))).astype(np.uint64)
        words = np.zeros(len(part), np.uint64)
        for k in range(8):
            words = (words << np.uint64(8)) | wide[k : k + len(part)]
        places = within(start[a:b] - lo, count[a:b])
        is_window = np.zeros(len(part), bool)
        is_window[places] = True
        order = refined(words, WINDOW)
        order = order[is_window[order]]
        shared = common_prefixes(part, order, start[a:b] - lo, count[a:b], WINDOW)
        groups = np.flatnonzero(np.concatenate(([True], shared[1:] < WINDOW)))
        of = np.zeros(len(part), np.int64)
        of[places] = np.repeat(doc[a:b], count[a:b])
        low = np.minimum.reduceat(of[order], groups)
        value = np.zeros(len(part), np.int64)
        value[order] = np.repeat(low, np.diff(np.append(groups, len(order))))
        least.append(value[places])
        sorted_windows.append((part, order[groups], low, lo, places))
    if len(first) == 1:
        return least[0]
    names = [window_keys(part, at) for part, at, _, _, _ in sorted_windows]
    keys, low = names[0], sorted_windows[0][2]
    for k in range(1, len(names)):  # merge by binary search
        more, at = names[k], np.searchsorted(keys, names[k])
        same = at < len(keys)
        same[same] = keys[at[same]] == more[same]
        low[at[same]] = np.minimum(low[at[same]], sorted_windows[k][2][same])
        keys, low = np.insert(keys, at[~same], more[~same]), np.insert(low, at[~same], sorted_windows[k][2][~same])
    return np.concatenate([low[np.searchsorted(keys, window_keys(part, places))] for part, _, _, _, places in sorted_windows])


def window_keys(part: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The windows at these places as byte strings that sort like their bytes (a last byte of 1 keeps zeros)."""
    out = np.ones((len(at), WINDOW + 1), np.uint8)
    for k in range(WINDOW):
        out[:, k] = part[at + k]
    return out.reshape(-1).view(f"S{WINDOW + 1}")


def least_grams(text: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Content hash of segments that lie one after another from at, and the least k-gram hash of each: that of its first window, as of all others."""
    content, least = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i, j in runs_of(at, CHUNK):
        totals, start = powers.totals(text[at[i] : at[j]]), at[i:j] - at[i]
        content.append(powers.hashes(totals, start, np.diff(at[i : j + 1])))
        low = np.full(j - i, ~np.uint64(0))
        for k in range(SPAN):
            low = np.minimum(low, mixed((totals[start + k + GRAM] - totals[start + k]) * powers.down[start + k]))
        least.append(low)
    return np.concatenate(content), np.concatenate(least)


def _decide(part: pa.Table) -> pa.Table:
    """Of each segment of a shard, by group, the windows that a smaller document has."""
    sizes = longs(part.column("n"))
    docs, lengths, texts = [], [], []
    for n, blob in zip(sizes.tolist(), part.column("blob"), strict=True):
        b = blob.as_buffer()
        docs.append(np.frombuffer(b, "<i8", n))
        lengths.append(np.frombuffer(b, np.uint8, n, 8 * n).astype(np.int64))
        texts.append(np.frombuffer(b, np.uint8, offset=9 * n))
    doc, length, text = np.concatenate(docs), np.concatenate(lengths), np.concatenate(texts)
    at = np.concatenate(([0], np.cumsum(length)))
    content, gram = least_grams(text, at, Powers(CHUNK + 2 * WINDOW))
    order = np.lexsort((doc, content))
    first = cuts(content[order])
    one, copies = order[first], np.diff(np.append(first, len(order)))
    which = np.empty(len(order), np.int64)
    which[order] = np.repeat(np.arange(len(first)), copies)
    # all windows of a content repeat with it; others can have them only under the same least hash
    mask = np.where(doc > doc[one][which], np.uint32(0xFFFFFFFF), np.uint32(0))
    by_gram = np.argsort(gram[one], kind="stable")
    edges = cuts(gram[one][by_gram])
    several = np.repeat(np.diff(np.append(edges, len(one))), np.diff(np.append(edges, len(one)))) > 1
    met = by_gram[several]
    count = length[one[met]] - WINDOW + 1
    if len(met):
        new = cuts(gram[one[met]])
        total = np.cumsum(length[one[met]])
        # stretches of whole hashes; a hash of many segments is a stretch of its own
        stretch = cuts(total[np.append(new[1:], len(met)) - 1] // STRETCH_BYTES)
        least = []
        for a, b in pieces(new[stretch], len(met)):
            some = one[met[a:b]]
            kept = text[within(at[some], length[some])]
            least.append(least_documents(kept, np.concatenate(([0], np.cumsum(length[some])[:-1])), count[a:b], doc[some]))
        least = np.concatenate(least)
        begin, place = np.concatenate(([0], np.cumsum(count)[:-1])), np.full(len(one), -1)
        place[met] = np.arange(len(met))
        rows = np.flatnonzero(place[which] >= 0)
        own, k = count[place[which[rows]]], begin[place[which[rows]]]
        bit = within(np.zeros(len(own), np.int64), own)
        hit = least[within(k, own)] < np.repeat(doc[rows], own)
        mask[rows] = np.add.reduceat(np.where(hit, np.int64(1) << bit, 0), np.concatenate(([0], np.cumsum(own)[:-1]))).astype(np.uint32)
    groups, blobs, ends = part.column("grp").to_pylist(), [], np.cumsum(sizes)
    for n, e in zip(sizes.tolist(), ends.tolist(), strict=True):
        some = np.flatnonzero(mask[e - n : e]) + e - n
        blobs.append(content[some].tobytes() + mask[some].tobytes())
    return pa.table({"grp": pa.array(groups, pa.int32()), "blob": pa.array(blobs, pa.binary())})


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _apply(with_text: bool):
    def run(docs: pa.Table, masks: pa.Table) -> pa.Table:
        ids, raw, at = ordered(docs)
        start, size, _, content = segments(raw, at, Powers(2 * CHUNK + WINDOW))
        doc = ids[np.searchsorted(at, start, "right") - 1]
        names, bits = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
        for blob in masks.column("blob"):
            b = blob.as_py()
            n = len(b) // 12
            names.append(np.frombuffer(b, "<u8", n))
            bits.append(np.frombuffer(b, "<u4", n, 8 * n))
        names, bits = np.concatenate(names), np.concatenate(bits)
        order = np.argsort(names)
        names, bits = names[order], bits[order]
        place = np.minimum(np.searchsorted(names, content), max(0, len(names) - 1))
        mask = np.where(names[place] == content, bits[place], np.uint32(0)) if len(names) else np.zeros(len(content), np.uint32)
        order = np.lexsort((doc, content))
        first = cuts(content[order])
        smallest = np.empty(len(order), np.int64)
        smallest[order] = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
        mask = np.where(doc > smallest, np.uint32(0xFFFFFFFF), mask)
        some = np.flatnonzero(mask)
        start, size, mask = start[some], size[some], mask[some]
        hit = (np.repeat(mask, size) >> within(np.zeros(len(size), np.int64), size).astype(np.uint32)) & 1 > 0
        windows = within(start, size)[hit]
        edge = np.zeros(len(raw) + 1, np.int32)
        edge[windows] += 1
        ends = np.bincount(windows + WINDOW, minlength=len(raw) + 1)
        gone = np.cumsum(edge - ends)[:-1] > 0
        removed, spans, digests, texts = [], [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            g = gone[a:b]
            kept = raw[a:b][~g].tobytes()
            removed.append(int(g.sum()))
            spans.append(len(spans_of(g)[0]) if removed[-1] else 0)
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept)
        out = {"doc_id": docs.column("doc_id"), "n_bytes": pa.array(np.diff(at)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept": pa.array(texts, pa.binary())} if with_text else {}))

    return run


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with_text the remaining bytes as kept."""
    docs = text_of(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0])
    groups, shards = max(LEAST, -(-total // GROUP_BYTES)), max(LEAST, -(-total // SHARD_BYTES))
    buckets = groups
    grouped = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(groups)).cast("int"))
    offers = grouped.groupBy("grp").applyInArrow(_offer(buckets), "bucket int, grp int, n bigint, blob binary")
    replies = offers.groupBy("bucket").applyInArrow(_shared, "grp int, bucket int, bits binary")
    sent = grouped.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(_send(buckets, shards), "shard int, grp int, n bigint, blob binary")
    masks = sent.groupBy("shard").applyInArrow(_decide, "grp int, blob binary")
    return grouped.groupBy("grp").cogroup(masks.groupBy("grp")).applyInArrow(_apply(with_text), RESULT + (", kept binary" if with_text else ""))
