"""Vector code compression: product codes by exact integer means, screened by float32 matrix products.

Components become integers floor(scale * x) and a vector is cut into PARTS consecutive parts. The
codebook of a part starts as that part of the first ENTRIES vectors; each round assigns every part
to its nearest entry and moves an entry to the floored mean of its parts. A round is one pass over
the table: tasks keep sums and counts by entry, whose number is fixed, and only these come to the
driver, as whole numbers of any size.

Assignment: a float32 matrix product gives every distance up to a rounding error that is bounded
from the lengths of both sides (conversion, products and sums in any order), so each entry has an
interval; entries whose interval reaches below the least upper bound are computed again in int64,
and the smaller index wins a tie. Parts with a component beyond SAFE are computed in Python's
integers. So every code and error is exact.

Defined results: rows whose vector is null or holds null or non-finite components are left out;
vectors of another length have codebooks of their own, and a length that PARTS does not divide has
parts that differ by one; fewer than ENTRIES vectors give fewer entries; of equal ids the smaller
vector comes first, and null ids come last; an entry that nothing is assigned to stays; errors
beyond 64 bits are held at the bound, components beyond 2^62 likewise; null labels belong together; repeated rows count each; an
empty table gives no rows; other columns are not looked at. The table is read ROUNDS + 2 times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import longs, spread_join, whole, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Components up to which distances are sure to fit 64 bits, for parts of up to 512 components.
SAFE = 1 << 26
MOST = (1 << 63) - 1
HELD = 1 << 62
#: Rows of a matrix product.
BLOCK = 1 << 14
UNIT = 2.0**-24


def sound(column, scale: float = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integer matrix) of the sound vectors of a list column, by length; Python's integers where a component is beyond SAFE."""
    column = whole(column)
    flat = whole(column.flatten())
    values = flat.fill_null(np.nan).cast(pa.float64()).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    size = np.array(column.value_lengths().fill_null(0), np.int64)
    ends = np.cumsum(size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    rows = np.flatnonzero(known & (bad[ends] == bad[ends - size]))
    for width in np.unique(size[rows]):
        some = rows[size[rows] == width]
        x = values[(ends[some] - width)[:, None] + np.arange(width)]
        wide = (np.abs(x) * scale > SAFE).any(1)
        if (~wide).any():
            yield some[~wide], np.floor(x[~wide] * scale).astype(np.int64)
        if wide.any():
            exact = [[exact_floor(float(v), scale) for v in row] for row in x[wide]]
            yield some[wide], np.array(exact, object).reshape(int(wide.sum()), int(width))


def exact_floor(value: float, scale: float) -> int:
    """floor(value * scale) without overflow, held at HELD."""
    (a, b), (c, d) = value.as_integer_ratio(), scale.as_integer_ratio()
    return min(max(a * c // (b * d), -HELD), HELD)


def cuts(width: int) -> list[int]:
    return [width * p // PARTS for p in range(PARTS + 1)]


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, ties to the smaller index, and its exact squared distance (int64, or Python's integers)."""
    if v.dtype == object or entries.dtype == object:
        far = ((v.astype(object)[:, None, :] - entries.astype(object)[None]) ** 2).sum(2) if v.shape[1] else np.zeros((len(v), len(entries)), object)
        index = np.array([min(range(len(entries)), key=row.__getitem__) for row in far], np.int64)
        return index, far[np.arange(len(v)), index]
    index, error = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    c = entries.astype(np.float64)
    square, length, single = (c * c).sum(1), np.sqrt((c * c).sum(1)), entries.astype(np.float32)
    steps = v.shape[1] + 4  # roundings of a product: two conversions, the product, the sums, and room for doubles
    gamma = steps * UNIT / (1 - steps * UNIT)
    for i in range(0, len(v), BLOCK):
        x = v[i : i + BLOCK]
        wide = x.astype(np.float64)
        product = (x.astype(np.float32) @ single.T).astype(np.float64)
        reach = np.sqrt((wide * wide).sum(1))[:, None] * length
        value, slack = square - 2 * product, 2.001 * gamma * reach + 2.0**-40 * square + 1e-6
        may = value - slack <= (value + slack).min(1)[:, None]
        row, entry = np.nonzero(may)
        far = np.full(may.shape, MOST, np.int64)
        far[row, entry] = ((x[row] - entries[entry]) ** 2).sum(1)
        index[i : i + BLOCK] = far.argmin(1)
        error[i : i + BLOCK] = far.min(1)
    return index, error


def first_vectors(rows: DataFrame, scale: float) -> dict[int, np.ndarray]:
    """The first ENTRIES sound vectors of each length: by id, then by components."""
    entries = ENTRIES

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, unnamed = longs(batch.column(0)), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for places, x in sound(batch.column(1), scale):
                best, key, none = held.setdefault(x.shape[1], []), ids[places], unnamed[places]
                may = np.ones(len(places), bool)
                if (~none).sum() >= entries:  # rows that are behind the first ones of this batch stay out
                    may = ~none & (key <= np.partition(key[~none], entries - 1)[entries - 1])
                if len(best) == entries and not best[-1][0]:
                    may &= ~none & (key <= best[-1][1])
                best.extend((bool(none[k]), int(key[k]), [int(c) for c in x[k]]) for k in np.flatnonzero(may))
                best.sort()
                del best[entries:]
        out = [(w, *r) for w, best in held.items() for r in best]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(4)], ["width", "unnamed", "id", "x"])

    found = rows.mapInArrow(least, "width long, unnamed boolean, id long, x array<long>")
    order = Window.partitionBy("width").orderBy("unnamed", "id", "x")
    out: dict[int, list] = {}
    # ENTRIES rows a length; the window is over ENTRIES rows a task and length.
    for r in found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= entries).select("width", "rank", "x").collect():
        out.setdefault(r["width"], []).append((r["rank"], r["x"]))
    return {w: integers([x for _, x in sorted(best)], w) for w, best in out.items()}


def integers(rows: list[list[int]], width: int) -> np.ndarray:
    """A matrix of int64, or of Python's integers if a component is beyond SAFE."""
    kind = object if any(abs(c) > SAFE for row in rows for c in row) else np.int64
    return np.array(rows, kind).reshape(len(rows), width)


def sums(rows: DataFrame, books: dict[int, np.ndarray], scale: float) -> dict[tuple[int, int, int], tuple[int, list[int]]]:
    """(length, part, entry): number of parts assigned and sum of each of their components."""
    shared, entries = rows.sparkSession.sparkContext.broadcast({w: b.tolist() for w, b in books.items()}), ENTRIES  # ENTRIES rows a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = {w: integers(b, w) for w, b in shared.value.items()}
        n: dict[int, np.ndarray] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in sound(batch.column(0), scale):
                width = x.shape[1]
                if width not in n:
                    n[width], total[width] = np.zeros((PARTS, entries), np.int64), np.zeros((entries, width), object)
                at = cuts(width)
                for p in range(PARTS):
                    v = x[:, at[p] : at[p + 1]]
                    index, _ = nearest(v, book[width][:, at[p] : at[p + 1]])
                    n[width][p] += np.bincount(index, minlength=entries)
                    for e in np.unique(index):
                        total[width][e, at[p] : at[p + 1]] += v[index == e].sum(0)
        out = [(w, p, e, int(n[w][p, e]), [str(c) for c in total[w][e, cuts(w)[p] : cuts(w)[p + 1]]]) for w in n for p in range(PARTS) for e in range(entries) if n[w][p, e]]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(5)], ["width", "part", "entry", "n", "x"])

    found = rows.select("embedding").mapInArrow(run, "width long, part long, entry long, n long, x array<string>")
    split = found.select("width", "part", "entry", "n", F.posexplode_outer("x").alias("at", "c"))
    added = split.groupBy("width", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("c"))
    out: dict[tuple[int, int, int], tuple[int, list[int]]] = {}
    for r in added.orderBy("width", "part", "entry", "at").collect():  # one row a component of a codebook
        key = (r["width"], r["part"], r["entry"])
        out.setdefault(key, (int(r["n"]), []))[1].extend([] if r["c"] is None else [int(r["c"])])
    return out


def train(rows: DataFrame, rounds: int = ROUNDS, scale: float = SCALE) -> dict[int, np.ndarray]:
    """Codebooks by length of vector: a row an entry, the parts side by side. rows: (vec_id, embedding)."""
    books = first_vectors(rows.select("vec_id", "embedding"), scale)
    for _ in range(rounds if books else 0):
        moved = {w: b.astype(object) for w, b in books.items()}
        for (w, p, e), (n, total) in sums(rows, books, scale).items():
            at = cuts(w)
            moved[w][e, at[p] : at[p + 1]] = [t // n for t in total]
        books = {w: integers(b.tolist(), w) for w, b in moved.items()}
    return books


def digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position."""
    at = cuts(book.shape[1])
    return hashlib.sha256(",".join(str(int(c)) for p in range(PARTS) for c in book[:, at[p] : at[p + 1]].ravel()).encode()).hexdigest()


def encode(rows: DataFrame, books: dict[int, np.ndarray], scale: float = SCALE) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of the sound rows of (vec_id, label, embedding)."""
    shared = rows.sparkSession.sparkContext.broadcast({w: (b.tolist(), digest(b)) for w, b in books.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = {w: (integers(b, w), name) for w, (b, name) in shared.value.items()}
        digits = np.array([f"{e:02x}" for e in range(ENTRIES)])
        for batch in batches:
            for places, x in sound(batch.column(2), scale):
                entries, name = book[x.shape[1]]
                at, code, error = cuts(x.shape[1]), np.full(len(x), "", "U16"), np.zeros(len(x), np.int64)
                for p in range(PARTS):
                    index, far = nearest(x[:, at[p] : at[p + 1]], entries[:, at[p] : at[p + 1]])
                    code, error = np.char.add(code, digits[index]), error + (far.astype(object) if far.max() > MOST // PARTS else far)
                take = pa.array(places)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(code.tolist(), pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64()), pa.array([name] * len(x), pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id long, label {label}, code string, error long, codebooks_sha256 string")


def compress(df: DataFrame, rounds: int = ROUNDS, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every sound row."""
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    codes = written(encode(rows, train(rows, rounds, scale), scale), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    labels = written(codes.groupBy("label").agg(F.count("*").alias("n"), F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "labels")
    return spread_join(codes, labels, "label", "n").select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def compress_sql(rounds: int = ROUNDS, scale: float = SCALE) -> str:
    """The same as compress(embeddings), for DuckDB, where all vectors have one length that PARTS divides."""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, label, [floor({scale} * y::DOUBLE)::BIGINT for y in embedding] AS x, len(embedding) // {PARTS} AS m FROM embeddings
  WHERE embedding IS NOT NULL AND len([y for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, i AS part, x[i * m + 1 : i * m + m] AS x FROM v, range({PARTS}) AS r(i))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {ENTRIES})",
    ]
    for k in range(rounds + 1):
        far = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, c.x)])::BIGINT"
        parts.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(far, entry)) AS best FROM (SELECT vec_id, p.part, entry, {far} AS far FROM p JOIN c{k} c ON p.part = c.part) GROUP BY vec_id, part)")
        if k < rounds:
            parts.append(
                f"""m{k} AS (SELECT part, entry, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY pos) AS x
  FROM (SELECT p.part, best.entry AS entry, pos, sum(x[pos])::BIGINT AS s, count(*)::BIGINT AS n FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.part = p.part, unnest(range(1, len(x) + 1)) AS u(pos) GROUP BY ALL) GROUP BY part, entry)"""
            )
            parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.part = c.part AND m.entry = c.entry)")
    return f"""WITH {", ".join(parts)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
e AS (SELECT vec_id, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT e.vec_id, label, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v ON e.vec_id = v.vec_id, h"""
