"""Sharding by a two-pass external shuffle.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the row. Pass two
holds one bucket at a time, puts its rows in a Fisher-Yates order drawn from (seed, bucket), and
writes it. The places of a bucket follow those of the buckets before it, so every row has one
place in a uniform order of all rows; place p goes to shard p mod n as its slot p div n. Shard
sizes in rows differ by one at most, slots have no gaps, and a lost task draws the same order again.

Equal rows can't be told apart, so where a bucket is hot (HOT times the mean and more than HOT_ROWS)
its rows are counted by content before the shuffle and dealt out by copy number: a row that makes up
a third of the table spreads like any other.

Defined results: null text counts 0 bytes and has the crc32 of empty text; rows that are equal in
id and text but not in other columns are drawn by a hash of all carried columns (maps as JSON), so
the order is the same for every layout of the input; an empty table gives no rows; other columns are
carried under their own names, unless named like an output column, which replaces them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, named, whole, written

#: Bytes of rows that one bucket holds on average; a task holds one bucket.
BUCKET_BYTES = 4 << 20
#: No fewer buckets than this, so that small inputs spread too.
LEAST_BUCKETS = 96
#: Offsets of so many buckets at most (24 bytes each) are broadcast.
BROADCAST_BUCKETS = 50_000
#: A bucket of more than HOT times the mean and of more than HOT_ROWS rows has rows counted by content.
HOT, HOT_ROWS = 4, 2000
#: Copies of a row that are dealt out together.
COPIES = 10_000
#: Bytes of rows of one file that write_shards writes.
FILE_BYTES = 256 << 20
#: Buckets of one block of running sums.
SUM_BLOCK = 4096
OWN = {"size", "text_crc32", "shard", "slot"}


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return holds_map(kind.elementType)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.StructType) and any(holds_map(f.dataType) for f in kind.fields))


def comparable(field: T.StructField) -> Column:
    """The column, or its JSON if it holds maps, which can't be compared or hashed."""
    return F.to_json(F.struct(named(field.name))) if holds_map(field.dataType) else named(field.name)


def scattered(rows: DataFrame, n: int, seed: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """rows with __bucket (of n), and the number __n of rows of each bucket."""
    told = [comparable(f) for f in rows.schema.fields]
    rows = rows.withColumn("__tie", F.xxhash64(*told)).withColumn("__copy", F.lit(0).cast("bigint"))
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), "text_crc32", "__tie", "__copy"), F.lit(n)).cast("int")
    rows = rows.withColumn("__bucket", place)
    counts = written(rows.groupBy("__bucket").agg(F.count("*").alias("__n")), "counts")
    number = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    hot = counts.filter(F.col("__n") > max(HOT_ROWS, HOT * number / n)).select("__bucket")
    if not hot.isEmpty():
        same = rows.join(hot, "__bucket", "left_semi").drop("__bucket", "__copy")
        columns = same.columns
        one = same.groupBy(*[comparable(f).alias(f"__g{k}") for k, f in enumerate(same.schema.fields)]).agg(F.count("*").alias("__c"), *[F.first(c).alias(c) for c in columns])  # equal rows, so any is the first
        # Copies come in two steps: blocks of COPIES, dealt out, and then the copies of each block; no task and no array holds all copies of a row.
        blocks = one.select(*columns, "__c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__c") - 1) / COPIES))).alias("__b")).repartition(n, F.col("__tie"), F.col("__b"))
        last = F.least((F.col("__b") + 1) * COPIES, F.col("__c")) - 1
        same = blocks.withColumn("__copy", F.explode(F.sequence(F.col("__b") * COPIES, last))).select(*columns, "__copy").withColumn("__bucket", place)
        rows = rows.join(hot, "__bucket", "left_anti").select(*same.columns).unionByName(same)
        counts = written(rows.groupBy("__bucket").agg(F.count("*").alias("__n")), "counts")
    return rows, counts


def shuffled(df: DataFrame, shards: int = 40, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """All rows of df with size (bytes of text and 16), text_crc32, shard and slot, and the columns carry (all, if None)."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    keep, columns = carried(df.columns if carry is None else carry, tuple(OWN))
    rows = df.select(*columns, named(id_col).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    total = df.select(F.octet_length(text).cast("bigint").alias("b")).agg(F.coalesce(F.sum(F.col("b") + 16), F.lit(0))).first()[0]
    n = max(least, -(-int(total) // bucket_bytes))
    rows, counts = scattered(rows, n, seed, "id")
    blocks = counts.withColumn("__block", F.floor(F.col("__bucket") / SUM_BLOCK))
    whole_blocks = blocks.groupBy("__block").agg(F.sum("__n").alias("__m"))
    earlier = whole_blocks.select("__block", (F.sum("__m").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__m")).alias("__start"))  # a row for SUM_BLOCK buckets
    inside = F.sum("__n").over(Window.partitionBy("__block").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    before = blocks.withColumn("__in", inside).join(F.broadcast(earlier), "__block").select("__bucket", (F.col("__start") + F.col("__in")).alias("__before"))
    if n <= BROADCAST_BUCKETS:
        before = F.broadcast(before)
    schema = T.StructType([*rows.schema.fields, T.StructField("__i", T.LongType())])
    sort_on = ["id", "text_crc32", "size", "__tie", "__copy"]

    def draw(bucket: pa.Table) -> pa.Table:
        order = bucket.select(sort_on).to_pandas().sort_values(sort_on, kind="stable").index.to_numpy()
        number = int(whole(bucket.column("__bucket"))[0].as_py())
        place = np.empty(len(order), np.int64)
        place[order] = np.random.default_rng([seed, number]).permutation(len(order))  # Fisher-Yates
        return bucket.append_column("__i", pa.array(place))

    drawn = rows.groupBy("__bucket").applyInArrow(draw, schema)
    place = F.col("__before") + F.col("__i")
    out = drawn.join(before, "__bucket").select(*[f"k{k}" for k in range(len(keep))], "size", "text_crc32", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / F.lit(shards)).cast("bigint").alias("slot"))
    return out.toDF(*keep, "size", "text_crc32", "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int = 40) -> None:
    """Writes one folder a shard, its rows in slot order over files of about FILE_BYTES: file names rise with slots, and a task writes a range of slots."""
    total = df.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    df.repartitionByRange(max(shards, -(-int(total) // FILE_BYTES)), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
