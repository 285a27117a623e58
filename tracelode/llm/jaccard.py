"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Documents become sets of 64-bit hashes of word n-grams. Documents with equal sets are one class.
Two sets with similarity of at least t share one of the first n - ceil(t n) + 1 hashes in any
order that all sets keep (n: set size). The order here puts hashes that are frequent in a bounded
sample last, so that rare ones come first; how good the sample is changes the cost and not the
links. These first hashes are the keys, and the classes under one key are a
tile; keys of the same classes give the same tile once, and a tile of more than TILE classes is
cut into overlapping size bands. In a tile, only sizes within a factor of t meet, and bit counts
of the exclusive or of hashed bitmaps bound the overlap of two sets from above; classes that are
connected by pairs under the bound stay together in a refined tile. There, pairs that aren't
linked through others yet are decided by intersecting sorted arrays.

Tiles that are still too large (TILE before, BLOCK after the bitmaps) are split: blocks that each
also hold the tile's pivots (a few classes) are decided first; classes that the pivots don't
reach then meet every block. So links are complete, no task holds a whole hot tile, and a large
group of near copies costs about its size times the pivots; many classes under one key that don't
link cost their square, spread over tasks of two blocks. Buckets of keys over HOT_BUCKET_BYTES,
which a hot key makes, are not read by one task either: their entries become rows.

Defined results: null text, or text without words, has no n-grams, its own component, and no
links; fewer words than n are one n-gram; rows that share an id are one node, whose texts may differ; rows without an id
link nothing and have the component of their class, if any; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, mixed, runs_of, text_of, utf8, whole, within, written
from .components import components

TILE, BLOCK, PIVOTS = 8000, 1000, 4
#: Bytes of text whose keys one bucket of keys holds, on average.
KEY_BUCKET_BYTES = 16 << 20
#: Members of tiles that one task holds, on average.
MEMBERS = 1500
LEAST_BUCKETS = 48
#: Bytes of keys (16 an entry) up to which one task reads a bucket.
HOT_BUCKET_BYTES = 64 << 20
#: Keys (16 bytes) that pick out texts where these lie, without a shuffle of all texts; more of them are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Documents whose hashes are counted for the order, and frequent hashes that it has at most (16 bytes each, broadcast).
SAMPLE, FREQUENT = 4000, 200_000
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte, the same for A-Z and a-z; 0 for white space."""
    v = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    v[65:91] = v[97:123]
    v[[32, 9, 10, 11, 12, 13]] = 0
    return v


def word_hashes(raw: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of UTF-8 rows, and the row of each word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    v = values[raw]
    solid = v != 0
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power = np.full(n + 1, BASE)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(v * power[:n], out=total[1:])
    back = np.full(n + 1, INVERSE)
    back[0] = 1
    np.cumprod(back, out=back)
    words = mixed((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
    return words, np.searchsorted(at, s, "right") - 1


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int, values: np.ndarray) -> list[np.ndarray]:
    """For each row the ascending distinct hashes of its word k-grams."""
    words, row = word_hashes(raw, at, values)
    rows = len(at) - 1
    first = np.searchsorted(row, np.arange(rows + 1))
    m = len(words) - k + 1
    grams = np.zeros(max(0, m), np.uint64)
    for i in range(k):
        if m > 0:
            grams = grams * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + m]
    grams, out = mixed(grams), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
            out.append(mixed(np.array([h])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hash(s: np.ndarray) -> int:
    return int((mixed(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64) + np.uint64(len(s))).view(np.int64)) if len(s) else 0


ENTRY = np.dtype([("key", "<u8"), ("set", "<i8"), ("size", "<u4")])


def first_hashes(s: np.ndarray, count: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first count hashes of a set: those that aren't frequent, ascending, then the others by their frequency."""
    names, often = frequent
    if not len(names):
        return s[:count]
    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
    n = np.where(names[at] == s, often[at], 0)
    rare = s[n == 0]
    if len(rare) >= count:
        return rare[:count]
    order = np.lexsort((s, n))
    return s[order[:count]]


def _hashes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = byte_values()
        for batch in batches:
            raw, at = utf8(batch.column(1))
            for i, j in runs_of(at):
                sets = shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k, values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["x"])

    return run


def frequent_hashes(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that occur in three documents of a sample or more, ascending, with their numbers."""
    n = docs.count()
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "th", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(1, n))))
    top = sample.mapInArrow(_hashes(k), "x bigint").groupBy("x").agg(F.count("*").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "x").limit(FREQUENT).toPandas()
    names, often = top["x"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(names)
    return names[order], often[order]


def _profiles(k: int, num: int, den: int, buckets: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, names = byte_values(), ["bucket", "doc_id", "th", "n", "h", "blob"]
        for batch in batches:
            raw, at = utf8(batch.column(1))
            sizes, hashes, entries, seen, signs = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), [], set(), [None] * len(batch)
            for i, j in runs_of(at):
                for r, s in enumerate(shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k, values), i):
                    sizes[r], hashes[r] = len(s), set_hash(s)
                    if len(s) and hashes[r] not in seen:
                        seen.add(int(hashes[r]))
                        signs[r] = signature(s)
                        prefix = first_hashes(s, len(s) + (-len(s) * num) // den + 1, frequent.value)
                        e = np.empty(len(prefix), ENTRY)
                        e["key"], e["set"], e["size"] = mixed(prefix), hashes[r], len(s)
                        entries.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), -1, np.int32)), batch.column(0), batch.column(2), pa.array(sizes), pa.array(hashes), pa.array(signs, pa.binary())], names)
            if entries:
                e = np.concatenate(entries)
                to = ((e["key"] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                e, to = e[order], to[order]
                cut = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
                low = e["key"].astype(np.uint32)  # the rest of a key names its bucket; keys that still agree only make a tile larger
                blobs = [low[a:b].tobytes() + e["set"][a:b].tobytes() + e["size"][a:b].tobytes() for a, b in zip(cut, np.append(cut[1:], len(e)), strict=True)]
                zero = pa.nulls(len(cut), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to[cut]), zero, zero, zero, zero, pa.array(blobs, pa.binary())], names)

    return run


def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set: bit h mod size for each hash h, with two to four bits for each element."""
    bits = max(256, 1 << (2 * len(s) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(s >> np.uint64(17)) % np.uint64(bits)] = True
    return np.packbits(flags).tobytes()


def folded(sign: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits (size in words)."""
    while len(sign) > size:
        sign = sign[: len(sign) // 2] | sign[len(sign) // 2 :]
    return sign


def entries(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, classes and sizes of the entries in these blobs."""
    out: tuple[list, list, list] = [], [], []
    for blob in column:
        b = blob.as_buffer()
        n = b.size // 16
        for to, (kind, at) in zip(out, (("<u4", 0), ("<i8", 4 * n), ("<u4", 12 * n)), strict=True):
            to.append(np.frombuffer(b, kind, n, at))
    key, own, size = (np.concatenate(x) for x in out)
    return key, own, size.astype(np.int64)


def _entry_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            key, own, _ = entries(batch.column(1).slice(i, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), batch.column(0)[i].as_py(), np.int32)), pa.array(key.astype(np.int64)), pa.array(own)], ["bucket", "key", "h"])


def _tiles(num: int, den: int):
    """The distinct groups of classes that share a key of this bucket, cut where sizes drop by more than the threshold."""

    def run(bucket: pa.Table) -> pa.Table:
        key, own, size = entries(bucket.column("blob"))
        order = np.lexsort((own, size, key))
        key, own, size = key[order], own[order], size[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
        key, own, size = key[new], own[new], size[new]
        start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (size[:-1] * den < size[1:] * num))))
        count = np.diff(np.append(start, len(key)))
        tile = tile_ids(own, start, count)
        some = np.flatnonzero(count >= 2)
        _, first = np.unique(tile[some], return_index=True)
        some = some[first]
        return pa.table({"tile": pa.array(np.repeat(tile[some], count[some])), "h": pa.array(own[within(start[some], count[some])])})

    return run


def tile_ids(own: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A name for each group of classes that only depends on which they are."""
    return mixed(np.add.reduceat(mixed(own.view(np.uint64)), start) ^ mixed(count.astype(np.uint64))).view(np.int64) if len(start) else np.zeros(0, np.int64)


def _refine(num: int, den: int):
    """Of each tile, the groups of classes that are connected by pairs whose bitmaps allow enough overlap."""

    def may_link(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
        most = (n + m - apart) // 2
        return most * den >= (n + m - most) * num

    def run(part: pa.Table) -> pa.Table:
        lists = whole(part.column("tiles"))
        row = np.repeat(np.arange(len(part)), np.array(lists.value_lengths(), np.int64))
        h, n, tiles = longs(part.column("h"))[row], longs(part.column("n"))[row], longs(lists.flatten())
        uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
        n = n[first]
        raw, at = utf8(whole(part.column("sig")).take(pa.array(row[first])))
        raw = np.ascontiguousarray(raw)
        sign = [raw[a:b].view(np.uint64) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        words = np.diff(at) // 8
        order = np.lexsort((n[back], tiles))
        own, cut = back[order], np.flatnonzero(np.concatenate(([True], tiles[order][1:] != tiles[order][:-1])))
        size = np.diff(np.append(cut, len(own)))
        groups: list[np.ndarray] = []
        two = cut[size == 2]
        i, j = own[two], own[two + 1]
        close = n[i] * den >= n[j] * num
        i, j = i[close], j[close]
        for w in np.unique(words[i]).tolist():  # pairs, all of one width at once
            some = np.flatnonzero(words[i] == w)
            a, b = i[some], j[some]
            for k in range(0, len(a), 4096):
                x, y = np.stack([sign[q] for q in a[k : k + 4096]]), np.stack([folded(sign[q], w) for q in b[k : k + 4096]])
                good = may_link(n[a[k : k + 4096]], n[b[k : k + 4096]], np.bitwise_count(x ^ y).sum(1, dtype=np.int64))
                groups += [np.array(p) for p in zip(a[k : k + 4096][good].tolist(), b[k : k + 4096][good].tolist(), strict=True)]
        for c in np.flatnonzero(size > 2).tolist():
            members = own[cut[c] : cut[c] + size[c]]
            found, m, wide = Sets(len(members)), n[members], words[members]
            for w in np.unique(wide).tolist():  # sizes rise, and so do widths; a row meets its own width and the next
                lo = int(np.searchsorted(wide, w))
                hi = int(np.searchsorted(wide, w, "right"))
                top = int(np.searchsorted(m, m[hi - 1] * den // num, "right"))
                block = np.stack([folded(sign[q], w) for q in members[lo:top]])
                for x in range(lo, hi):
                    last = int(np.searchsorted(m, m[x] * den // num, "right"))
                    if last > x + 1:
                        apart = np.bitwise_count(block[x + 1 - lo : last - lo] ^ block[x - lo]).sum(1, dtype=np.int64)
                        for y in (np.flatnonzero(may_link(m[x + 1 : last], m[x], apart)) + x + 1).tolist():
                            if found.find(x) != found.find(y):
                                found.join(x, y)
            root = np.array([found.find(x) for x in range(len(members))])
            for r in np.flatnonzero(np.bincount(root, minlength=len(members)) > 1).tolist():
                groups.append(members[root == r])
        if not groups:
            return pa.table({"tile": pa.array([], pa.int64()), "h": pa.array([], pa.int64())})
        groups = [np.sort(uniq[g]) for g in groups]
        flat, count = np.concatenate(groups), np.array([len(g) for g in groups])
        start = np.concatenate(([0], np.cumsum(count)[:-1]))
        tile = tile_ids(flat, start, count)
        _, keep = np.unique(tile, return_index=True)
        return pa.table({"tile": pa.array(np.repeat(tile[keep], count[keep])), "h": pa.array(flat[within(start[keep], count[keep])])})

    return run


class Sets:
    """Union-find over the places 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 64-bit words for each set: bit h mod size for every hash h. At least four bits for each element of the largest set, while all rows together stay under 32 MB of flags."""
    bits = 1024
    while bits < 4 * max(len(s) for s in sets) and 2 * bits * len(sets) <= 1 << 25:
        bits *= 2
    flags = np.zeros((len(sets), bits), bool)
    flags[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), (np.concatenate(sets) >> np.uint64(17)) % np.uint64(bits)] = True
    return np.packbits(flags, axis=1).view(np.uint64)


def links(sets: list[np.ndarray], num: int, den: int) -> Sets:
    """Joins all places whose sets have similarity of at least num / den."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    size = np.array([len(sets[i]) for i in order], np.int64)
    signs, found = bitmaps([sets[i] for i in order]), Sets(len(sets))
    for x in range(len(order) - 1):
        last = int(np.searchsorted(size, size[x] * den // num, "right"))
        if last <= x + 1:
            continue
        apart = np.bitwise_count(signs[x + 1 : last] ^ signs[x]).sum(1, dtype=np.int64)
        both = size[x + 1 : last] + size[x]
        most = (both - apart) // 2  # no more can be shared
        for y in (np.flatnonzero(most * den >= (both - most) * num) + x + 1).tolist():
            i, j = order[x], order[y]
            if found.find(i) != found.find(j):
                shared = overlap(sets[i], sets[j])
                if shared * den >= (len(sets[i]) + len(sets[j]) - shared) * num:
                    found.join(i, j)
    return found


def _verify(k: int, num: int, den: int):
    def run(part: pa.Table) -> pa.Table:
        values = byte_values()
        tiles = longs(part.column("tile"))
        _, first, back = np.unique(longs(part.column("h")), return_index=True, return_inverse=True)
        ids = longs(part.column("doc_id"))[first]
        raw, at = utf8(whole(part.column("text")).take(pa.array(first)))
        sets: list[np.ndarray] = []
        for i, j in runs_of(at):
            sets += shingle_sets(raw[at[i] : at[j]], at[i : j + 1] - at[i], k, values)
        order = np.lexsort((back, tiles))
        cut = np.flatnonzero(np.concatenate(([True], tiles[order][1:] != tiles[order][:-1])))
        a, b = [], []
        known = Sets(len(ids))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
            members = np.unique(back[order[s:e]]).tolist()
            if len({known.find(i) for i in members}) == 1:
                continue
            found = links([sets[i] for i in members], num, den)
            for i, m in enumerate(members):
                r = members[found.find(i)]
                if known.find(r) != known.find(m):
                    known.join(r, m)
                    a.append(int(ids[r]))
                    b.append(int(ids[m]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has BROADCAST_IDS rows at most; else Spark shuffles."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def split(rows: DataFrame, limit: int, decide) -> DataFrame:
    """Edges (a, b) that decide finds in the rows (tile, h, doc_id, th) of tiles, none of which it is shown over 2 x limit members.

    A larger tile is cut into blocks with the same pivots; what these don't connect to the tile's main component meets every block.
    """
    counts = rows.groupBy("tile").agg(F.count("*").alias("m"), F.array(*[F.min_by("h", F.xxhash64("h", F.lit(i))) for i in range(PIVOTS)]).alias("pivots"))
    big = written(counts.filter(F.col("m") > limit).withColumn("blocks", F.ceil(F.col("m") / limit).cast("int")).drop("m"), "big")
    if not (n_big := big.count()):
        return decide(rows)
    near = F.broadcast if n_big <= BROADCAST_IDS else (lambda d: d)
    deal = lambda n, seed: F.pmod(F.xxhash64("h", F.lit(seed)), n).cast("int")
    own = lambda *c: F.xxhash64("tile", *c).alias("tile")
    large = rows.join(near(big), "tile").withColumn("block", deal(F.col("blocks"), 5)).withColumn("pivot", F.array_contains("pivots", F.col("h")))
    large = written(large.drop("pivots"), "large")
    blocks = large.withColumn("block", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    edges = decide(rows.join(near(big.select("tile")), "tile", "left_anti").unionByName(blocks.select(own("block"), "h", "doc_id", "th")))
    labels = components(edges).withColumnRenamed("id", "doc_id")
    named = written(large.drop("pivot").join(labels, "doc_id", "left").withColumn("c", F.coalesce("component", "doc_id")).drop("component"), "named")
    main = named.groupBy("tile", "c").agg(F.count("*").alias("k")).groupBy("tile").agg(F.max_by("c", F.struct("k", -F.col("c"))).alias("main"))
    rest = written(named.join(near(main), "tile").filter("c <> main").drop("main"), "rest")
    parts = written(rest.groupBy("tile").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts")), "parts")
    if parts.isEmpty():
        return edges
    rest = rest.join(near(parts), "tile").withColumn("part", deal(F.col("parts"), 6))
    meets = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = named.join(near(parts), "tile").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = [d.select(own("block", "part"), "h", "doc_id", "th") for d in (meets, held)]
    return edges.unionByName(decide(pairs[0].union(pairs[1]).distinct()))


def join(df: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when 100 x intersection >= percent x union."""
    docs = text_of(df, id_col, text_col).withColumn("th", F.xxhash64("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    buckets = max(LEAST_BUCKETS, -(-int(total) // KEY_BUCKET_BYTES))
    num, den = percent, 100
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_hashes(docs, words))
    profiles = written(docs.mapInArrow(_profiles(words, num, den, buckets, frequent), "bucket int, doc_id bigint, th bigint, n bigint, h bigint, blob binary"), "profiles")
    sets, keys = profiles.filter("bucket = -1").select("doc_id", "n", "h"), profiles.filter("bucket >= 0").select("bucket", "blob")
    classes = written(profiles.filter("bucket = -1 and n > 0").groupBy("h").agg(F.min("doc_id").alias("rep"), F.min_by("th", "doc_id").alias("th"), F.max("n").alias("n"), F.max("blob").alias("sig")), "classes")
    known = classes.filter("rep is not null")
    hot = written(keys.groupBy("bucket").agg(F.sum(F.octet_length("blob")).alias("b")).filter(F.col("b") > HOT_BUCKET_BYTES).select("bucket"), "hot")
    if hot.isEmpty():
        tiles = keys.groupBy("bucket").applyInArrow(_tiles(num, den), "tile bigint, h bigint").distinct()
    else:
        tiles = keys.join(sized(hot), "bucket", "left_anti").groupBy("bucket").applyInArrow(_tiles(num, den), "tile bigint, h bigint").distinct()
        spread = keys.join(sized(hot), "bucket", "left_semi").mapInArrow(_entry_rows, "bucket int, key bigint, h bigint").select(F.xxhash64("bucket", "key").alias("tile"), "h").distinct()
        tiles = tiles.union(spread)
    tiles = written(tiles, "tiles")
    rows = tiles
    wide = written(tiles.groupBy("tile").agg(F.count("*").alias("m")).filter(F.col("m") > TILE).select("tile"), "wide")
    if not wide.isEmpty():  # size bands: two sets that can link are in one band or in neighbouring ones
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)))
        banded = tiles.join(sized(wide), "tile").join(known.select("h", "n"), "h").withColumn("band", F.explode(F.array(band, band + 1)))
        rows = tiles.join(sized(wide), "tile", "left_anti").select("tile", "h").unionByName(banded.select(F.xxhash64("tile", "band").alias("tile"), "h"))

    def task(d: DataFrame, members: int):
        return F.pmod(F.xxhash64("tile"), F.lit(max(LEAST_BUCKETS, -(-d.count() // members)))).cast("int").alias("g")

    def refined(d: DataFrame) -> DataFrame:
        placed = d.groupBy(task(d, 10 * MEMBERS), "h").agg(F.collect_list("tile").alias("tiles"))
        near = placed.join(known.select("h", "n", "sig"), "h").groupBy("g").applyInArrow(_refine(num, den), "tile bigint, h bigint").distinct()
        return written(near.join(known.select("h", F.col("rep").alias("doc_id"), "th"), "h").select("tile", "h", "doc_id", "th"), "members")

    def verified(d: DataFrame) -> DataFrame:
        wanted = written(d.select("doc_id", "th").distinct(), "wanted")
        texts = docs.join(sized(wanted), ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
        placed = d.join(texts, ["doc_id", "th"]).select(task(d, MEMBERS), "tile", "h", "doc_id", "text")
        return written(placed.groupBy("g").applyInArrow(_verify(words, num, den), "a bigint, b bigint"), "links")

    if not wide.isEmpty():
        rows = written(rows.join(known.select("h", F.col("rep").alias("doc_id"), "th"), "h").select("tile", "h", "doc_id", "th"), "banded")
        edges = split(rows, TILE, lambda d: split(refined(d), BLOCK, verified))
    else:
        edges = split(refined(rows), BLOCK, verified)
    several = sets.filter("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("doc_id")
    several = written(several, "several")
    if not several.isEmpty():  # an id with different texts is one node
        edges = edges.unionByName(sets.join(sized(several), "doc_id", "left_semi").filter("n > 0").join(known.select("h", "rep"), "h").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct())
    labels = components(edges)
    placed = sets.join(classes.select("h", "rep"), "h", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep"))
    out = placed.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
