"""What the operators share: Arrow buffers as numpy arrays, hashes, and the checkpoint folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a numpy pass handles at once; a longer document is a pass of its own.
CHUNK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; where none is set, one of our own if all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and the table survives executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that one broadcast may hold: a key is handled on its own if it holds more than this share of the rows.
HOT_KEYS, LEAST_HOT = 100_000, 100


def spread_join(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the columns of side (one row for each key of rows, null too, with n, the number of rows of that key; n is left out).

    Keys that hold more than a HOT_KEYS-th of all rows are at most HOT_KEYS, whatever the size of the table: they are
    broadcast, and their rows stay where they are. The others are joined by shuffle, where no key can be large.
    Both tables should be written ones, as each is read twice.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    limit, on = max(LEAST_HOT, -(-total // HOT_KEYS)), F.col(key).eqNullSafe(F.col("__side"))
    named = side.withColumnRenamed(key, "__side")
    hot, rest = named.filter(F.col(n) > limit).drop(n), named.filter(F.col(n) <= limit).drop(n)
    columns = [*rows.columns, *[c for c in side.columns if c not in (key, n)]]
    few = rows.join(F.broadcast(hot), on, "inner").select(*columns)
    return rows.join(F.broadcast(hot.select("__side")), on, "left_anti").join(rest, on, "inner").select(*columns).union(few)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and what they keep of earlier tasks counts for their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def named(c: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + c.replace("`", "``") + "`")


def carried(keep: list[str], own: tuple[str, ...]) -> tuple[list[str], list[Column]]:
    """Those of the columns keep that no output column is named like, and these under names that nothing else has (k0, k1, ...)."""
    names = [c for c in keep if c not in own]
    return names, [named(c).alias(f"k{i}") for i, c in enumerate(names)]


def whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row starts (one more entry at the end); null is empty."""
    column = whole(column)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def longs(column, null: int = 0) -> np.ndarray:
    column = whole(column)
    return column.fill_null(null).cast(pa.int64()).to_numpy(zero_copy_only=False)


def runs_of(at: np.ndarray, limit: int = CHUNK):
    """Ranges of rows with at most limit bytes together, or a single longer row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def code_points(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and where each row starts."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), "<u4")
    firsts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=firsts[1:])
    return points, firsts[at]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: near keys land far apart."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def within(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (count of them) for each start, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", valid: bool = False) -> DataFrame:
    """Only the two columns that are asked for, whatever else the table holds under whatever name; valid: with U+FFFD for bytes that are no UTF-8."""
    text = named(text_col).cast("string")
    return df.select(named(id_col).cast("bigint").alias("doc_id"), (F.make_valid_utf8(text) if valid else text).alias("text"))
