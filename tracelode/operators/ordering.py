"""Positional logic as windows: carrying values forward, sequences, adjacent rows, merged phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut


def carry_forward(value: Column, by: list[str], order: list) -> Column:
    """The last value so far that isn't null."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def sequence(by: list[str], order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def merge_adjacent(df: DataFrame, by: list[str], order: list[str], label: str, most: int | None = None) -> DataFrame:
    """Runs of rows with the same label: (by, phase, label, n_rows, first, last of the order column), the first `most` of them."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    runs = marked.withColumn("phase", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "phase", label).agg(F.count("*").alias("n_rows"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return out.filter(F.col("phase") <= most) if most else out


def adjacent(df: DataFrame, by: list[str], order: list[str], value: str, changed_only: bool = False) -> DataFrame:
    """(by, order, value, next): each row with the value of the following one."""
    out = df.withColumn("next", F.lead(value).over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("next").isNotNull())
    return out.filter(F.col("next") != F.col(value)) if changed_only else out


def citation_ids(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with citation_id CIT-001, CIT-002, ... in this order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("string")
    return df.withColumn("citation_id", F.concat(F.lit("CIT-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)))


def natural(c: str) -> Column:
    """A text column in the order of a dictionary (letters before their case and marks), null as empty."""
    return F.collate(F.coalesce(F.col(c).cast("string"), F.lit("")), "UNICODE")


def ranged(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """df in this order over ranges of its rows: each partition is sorted, and partitions follow each other. order should tell all rows apart."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def numbered(df: DataFrame, order: list, name: str = "n", parts: int | None = None) -> DataFrame:
    """df with the place of each row in this order, from 1 and without gaps.

    Rows are dealt into ranges of the order, each range counts its own, and the counts of the ranges before it are added: a row for each
    range is all that comes together. Rows that the order does not tell apart share a range and are numbered in any order.
    """
    rows = cut(ranged(df, order, parts).withColumn("__range", F.spark_partition_id()))
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__size"))
    before = sizes.select("__range", (F.sum("__size").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")).alias("__before"))
    inside = rows.withColumn(name, F.row_number().over(Window.partitionBy("__range").orderBy(*order)))
    return inside.join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")  # a row for each range


def padded(n: Column, prefix: str, digits: int = 3) -> Column:
    """prefix and the number with as many digits at least."""
    n = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(n) < digits, F.lpad(n, digits, "0")).otherwise(n))
