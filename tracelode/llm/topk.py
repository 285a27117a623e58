"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are integer after scaling. Queries are dealt into groups of QUERY_GROUP, candidates into
bands of falling length and, within a band, into groups of CANDIDATE_GROUP; the longest vectors of
the table (SEEDS, broadcast) give each query a first threshold. A tile is a group of queries and a
group of candidates whose length can still reach one of their thresholds; tiles are chosen from a
row of statistics for each group and read by executors, so nothing that grows with the queries
comes to the driver. In a tile, candidates are sorted by descending length; blocks whose length
cannot reach the threshold are left out, then pairs whose first rotated components and residual
lengths cannot; the products of the rest are finished in integers, and the k-th best of a block
raises the threshold. A tile hands on the k best of a query, and a window picks the k best of all.

Defined results: vectors that are null, empty or hold null or non-finite components take no part;
shorter vectors count as padded by zeros; a row with a query's own id is no candidate of it;
repeated rows are candidates each, with equal id and score, and one query
together (the least vector, if they differ); ties go to the smaller id; scores
beyond 64 bits are held at the bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import longs, whole, written

#: Queries and candidates of a tile (8 bytes a component), and groups of candidates at least.
QUERY_GROUP, CANDIDATE_GROUP, LEAST_GROUPS = 8_000, 50_000, 12
#: Bands of length; beyond so many groups, a band has several.
BANDS = 200
#: Tiles (8 bytes each) that are broadcast to the vectors; more are joined by shuffle.
BROADCAST_TILES = 1_000_000
#: Vectors that the rotation is fitted on, and longest vectors that give first thresholds.
ROTATION_SAMPLE, SEEDS = 20_000, 2_000
BLOCK = 1024
SAFE = float(1 << 52)


def vectors(column) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the sound vectors of a list column (padded by zeros), and which rows they are."""
    column = whole(column)
    flat = whole(column.flatten())
    values = flat.fill_null(np.nan).cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    size = np.array(column.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    rows = np.flatnonzero((size > 0) & (bad[ends] == bad[ends - size]))
    out = np.zeros((len(rows), int(size[rows].max()) if len(rows) else 0))
    for width in np.unique(size[rows]):
        some = np.flatnonzero(size[rows] == width)
        out[some, :width] = values[(ends[rows[some]] - width)[:, None] + np.arange(width)]
    return out, rows


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


def padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows as int64: in doubles where these are exact, else in Python's integers."""
    if not len(q):
        return np.zeros(0, np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < SAFE:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, c, strict=True)]
    return np.array([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in big], np.int64)


def best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: by score downwards, then by id."""
    order = np.lexsort((ids, ~score, query))  # ~ falls as a score rises, at the bounds too
    q = query[order]
    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


class Scan:
    """Queries with their rotation and thresholds, ready to meet batches of candidates."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.q, self.rotation, self.k = ids, q, rotation, k
        self.first = max(1, q.shape[1] // 4)
        turned = q @ rotation
        self.head, self.rest, self.norm = turned[:, : self.first], np.linalg.norm(turned[:, self.first :], axis=1), np.linalg.norm(q, axis=1)
        self.safe = float(self.norm.max(initial=0))
        self.least = np.full(len(ids), -np.inf)

    def meet(self, ids: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the k best of these candidates for each query, without those under its threshold."""
        width = self.q.shape[1]
        if c.shape[1] > width:  # further components meet only zeros
            c = c[:, :width]
        c = padded(c, width)
        order = np.argsort(-np.linalg.norm(c, axis=1), kind="stable")
        found, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), self.least.copy()
        for i in range(0, len(order), BLOCK):
            some = order[i : i + BLOCK]
            x, own = c[some], ids[some]
            turned = x @ self.rotation
            norm, rest = np.linalg.norm(x, axis=1), np.linalg.norm(turned[:, self.first :], axis=1)
            slack = 1e-9 * self.norm * norm[0] + 1e-6
            live = np.flatnonzero(self.norm * norm[0] + slack >= least)
            if not len(live):
                continue
            for j in range(0, len(live), 2048):
                who = live[j : j + 2048]
                bound = self.head[who] @ turned[:, : self.first].T + self.rest[who][:, None] * rest + slack[who][:, None]
                may = bound >= least[who][:, None]
                rows = np.flatnonzero(may.any(1))
                if not len(rows):
                    continue
                who, may = who[rows], may[rows]
                if self.safe * norm[0] < SAFE:  # sums of integers that doubles hold exactly: finish the products, then raise the thresholds by what this block has
                    score = self.q[who] @ x.T
                    may &= self.ids[who][:, None] != own
                    if len(some) > self.k:
                        kth = np.partition(np.where(may, score, -np.inf), -self.k, axis=1)[:, -self.k]
                        least[who] = np.maximum(least[who], kth)
                    a, b = np.nonzero(may & (score >= least[who][:, None]))
                    got = who[a], own[b], score[a, b].astype(np.int64)
                else:
                    a, b = np.nonzero(may & (self.ids[who][:, None] != own))
                    got = who[a], own[b], exact(self.q[who[a]], x[b])
                got = [np.concatenate(z) for z in zip(found, got, strict=True)]
                top = best(*got, self.k)
                found = tuple(z[top] for z in got)
            count = np.bincount(found[0], minlength=len(self.ids))
            full = np.flatnonzero(count >= self.k)
            low = np.full(len(self.ids), np.inf)
            np.minimum.at(low, found[0], found[2].astype(float))
            least[full] = np.maximum(least[full], low[full])
        ok = found[2] >= self.least[found[0]]
        return self.ids[found[0]][ok], found[1][ok], found[2][ok]


def _thresholds(seeds: tuple[np.ndarray, np.ndarray], rotation: np.ndarray, k: int, scale: float):
    """Of each query, the k-th best score that the seeds give it (null: none), and the length from which a vector may reach that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = vectors(batch.column(1))
            if not len(ok):
                continue
            ids, q = longs(batch.column(0))[ok], scaled(x, scale)
            scan = scan_of(ids, q, seeds[1], rotation, k)
            least = np.full(len(ids), -np.inf)
            if len(seeds[0]):
                got_q, _, got_s = scan.meet(*seeds)
                order = np.argsort(ids)
                place = order[np.searchsorted(ids[order], got_q)]
                low = np.full(len(ids), np.inf)
                np.minimum.at(low, place, got_s.astype(float))
                least = np.where(np.bincount(place, minlength=len(ids)) >= k, low, -np.inf)
            norm = scan.norm
            reach = np.where(norm > 0, (least - 1e-6) / np.maximum(norm * (1 + 1e-9), 1e-300), -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(1).take(pa.array(ok)), pa.array(least), pa.array(reach)], ["id", "v", "least", "reach"])

    return run


def scan_of(ids: np.ndarray, q: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> Scan:
    """A scan whose width fits queries and rotation; components of candidates beyond that of the queries meet only zeros."""
    width = max(q.shape[1], len(rotation))
    if width > len(rotation):
        n = len(rotation)
        rotation = np.block([[rotation, np.zeros((n, width - n))], [np.zeros((width - n, n)), np.eye(width - n)]])
    return Scan(ids, padded(q, width), rotation, k)


def _tile(rotation: np.ndarray, k: int, scale: float):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        q, ok = vectors(queries.column("v"))
        c, sound = vectors(rows.column("v"))
        got = [np.zeros(0, np.int64)] * 3
        if len(ok) and len(sound):
            scan = scan_of(longs(queries.column("id"))[ok], scaled(q, scale), c, rotation, k)
            scan.least = queries.column("least").to_numpy()[ok]
            got = scan.meet(longs(rows.column("id"))[sound], scaled(c, scale))
        return pa.table([pa.array(z) for z in got], ["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows of df for each row of queries."""
    zero = F.lit(0.0)
    norm = F.sqrt(F.aggregate("v", zero, lambda s, x: s + F.coalesce(x * x, F.lit(float("nan"))))) * scale + F.sqrt(F.size("v"))  # no less than that of the integers
    pick = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("id is not null and v is not null and size(v) > 0").withColumn("norm", norm).filter(~F.isnan("norm"))
    rows, asked = pick(df), pick(queries)
    fit = rows.filter(F.col("norm") < float("inf"))

    def gather(d: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = d.select("id", "v").toArrow()
        x, ok = vectors(t.column("v"))
        ids, first = np.unique(longs(t.column("id"))[ok], return_index=True)  # an id counts once towards a threshold
        return ids, scaled(x, scale)[first]

    seeds = gather(fit.orderBy(F.desc("norm"), "id").limit(SEEDS))
    number = rows.count()
    sample = gather(fit.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, ROTATION_SAMPLE / max(1, number)))).limit(2 * ROTATION_SAMPLE))[1]  # the fit is bounded, the search is not
    width = max(seeds[1].shape[1], sample.shape[1], 1)
    sample = padded(sample, width)
    _, turn = np.linalg.eigh(sample.T @ sample)
    rotation = np.ascontiguousarray(turn[:, ::-1])
    n_groups, q_groups = max(LEAST_GROUPS, -(-number // CANDIDATE_GROUP)), max(1, -(-asked.count() // QUERY_GROUP))
    bands = min(BANDS, n_groups)
    sub = -(-n_groups // bands)
    cut, top = rows.agg(F.percentile_approx("norm", [i / bands for i in range(1, bands)], 100_000), F.coalesce(F.max("norm"), F.lit(0.0))).first()
    cut = sorted(float(x) for x in cut or ())
    ends = F.array(*[F.lit(x) for x in cut]) if cut else F.array().cast("array<double>")
    above, level = F.size(F.filter(ends, lambda e: e < F.col("norm"))), F.size(F.filter(ends, lambda e: e == F.col("norm")))
    turn_no = F.monotonically_increasing_id()  # deals out vectors of one length, also repeated ones; no bound or result depends on the group that one gets
    # Written once: a vector stays in its group when a task of the search is run again.
    rows = written(rows.withColumn("cg", ((above + F.pmod(turn_no, level + 1)) * sub + F.pmod(F.floor(turn_no / 7), F.lit(sub))).cast("int")), "candidates")
    asked = asked.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_thresholds(seeds, rotation, k, scale), "id bigint, v array<double>, least double, reach double")
    asked = written(asked.withColumn("qg", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(q_groups)).cast("int")), "queries")
    tops = F.array(*[F.lit(x) for x in [*cut, top]])  # the greatest length of each band
    lengths = df.sparkSession.range((len(cut) + 1) * sub).select(F.col("id").cast("int").alias("cg"), F.element_at(tops, F.floor(F.col("id") / sub).cast("int") + 1).alias("top"))
    tiles = written(asked.groupBy("qg").agg(F.min("reach").alias("reach")).join(lengths, F.col("top") >= F.col("reach")).select("qg", "cg"), "tiles")  # one row a group on either side
    near = F.broadcast if tiles.count() <= BROADCAST_TILES else (lambda d: d)
    left, right = asked.join(near(tiles), "qg").select("qg", "cg", "id", "v", "least"), rows.join(near(tiles), "cg").select("qg", "cg", "id", "v")
    out = left.groupBy("qg", "cg").cogroup(right.groupBy("qg", "cg")).applyInArrow(_tile(rotation, k, scale), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
