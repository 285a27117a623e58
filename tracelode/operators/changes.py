"""Differences between snapshots, and what an incremental run has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(base: DataFrame, target: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, change): added, removed, or changed where value differs (null is a value)."""
    side = lambda d, v: d.select(*keys, F.struct(F.col(value).alias("v")).alias(v))  # noqa: E731  null only where the row is missing
    both = side(base, "__a").join(side(target, "__b"), keys, "full_outer")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a.v").eqNullSafe(F.col("__b.v")), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


def to_process(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose content is not what the previous inventory has for their path."""
    return files.join(previous.select("path", "hash"), ["path", "hash"], "left_anti")


def preserved(records: DataFrame, files: DataFrame, previous: DataFrame) -> DataFrame:
    """Records of files that did not change; those of changed and deleted files go."""
    same = files.join(previous.select("path", "hash"), ["path", "hash"], "left_semi").select(F.col("hash").alias("fileHash")).distinct()
    return records.join(same, "fileHash", "left_semi")


def status(files: DataFrame, previous: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """(path, status): new, modified, unchanged, deleted, or skipped for its size."""
    a = files.select("path", F.col("hash").alias("__new"), F.col("size").alias("__size"))
    both = a.join(previous.select("path", F.col("hash").alias("__old")), "path", "full_outer")
    big = F.coalesce(F.col("__size") > max_bytes, F.lit(False)) if max_bytes else F.lit(False)
    return both.select("path", F.when(F.col("__new").isNull(), "deleted").when(big, "skipped").when(F.col("__old").isNull(), "new").when(F.col("__new") == F.col("__old"), "unchanged").otherwise("modified").alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new, and what old has under other keys."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__k = 1").drop("__k")


def adherence(planned: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, state): implemented, missing (planned only) or extra (found only)."""
    p, f = planned.select(key).distinct().withColumn("__p", F.lit(True)), found.select(key).distinct().withColumn("__f", F.lit(True))
    return p.join(f, key, "full_outer").select(key, F.when(F.col("__p") & F.col("__f"), "implemented").when(F.col("__p"), "missing").otherwise("extra").alias("state"))


def adherence_status(states: DataFrame) -> DataFrame:
    """complete if nothing planned is missing, partial if something is implemented, else draft."""
    n = states.agg(F.count_if(F.col("state") == "implemented").alias("n_implemented"), F.count_if(F.col("state") == "missing").alias("n_missing"))
    return n.withColumn("status", F.when((F.col("n_missing") == 0) & (F.col("n_implemented") > 0), "complete").when(F.col("n_implemented") > 0, "partial").otherwise("draft"))
