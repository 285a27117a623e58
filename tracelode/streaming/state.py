"""What changes in a stream of inventories: state by path tells new, changed, moved and deleted files, so that their records can be taken back.

A listing is a row (path, hash, at) for each file that a scan has seen, with a null hash for a file that is gone. State is the last hash
of a path. Rows of one trigger are taken in the order of their time; older rows than the state's are left out, so late listings change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LISTING = "path string, hash string, at timestamp"
CHANGE = "path string, action string, hash string, old_hash string, at timestamp"


def changes(listings: DataFrame) -> DataFrame:
    """(path, action, hash, old_hash, at) of a stream of listings: add, replace or retract, where a file is not as it was."""

    def one(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = state.get if state.exists else (None, None)
        rows = []
        seen = sorted(((r.at, r.hash if isinstance(r.hash, str) else "") for part in parts for r in part.itertuples(index=False)))
        for at, name in seen:
            if last is not None and at < last:
                continue
            last, new = at, name or None
            if new != known:
                rows.append((key[0], "add" if known is None else "retract" if new is None else "replace", new, known, at))
            known = new
        if last is not None:
            state.update((known, last))
        yield pd.DataFrame(rows, columns=["path", "action", "hash", "old_hash", "at"])

    return listings.groupBy("path").applyInPandasWithState(one, CHANGE, "hash string, at timestamp", "append", GroupStateTimeout.NoTimeout)


def listings(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """A stream of listings that scans have written to a folder as Parquet."""
    return spark.readStream.schema(LISTING).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes the changes under out, one folder a trigger, so that a repeated trigger replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    writer = changes(listings(spark, folder)).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def applied(records: DataFrame, changes_: DataFrame, column: str = "fileHash") -> DataFrame:
    """records without those of files whose content was replaced or taken back and that no other path brings in again."""
    order = changes_.groupBy("path").agg(F.max_by("hash", "at").alias("hash"), F.collect_set("old_hash").alias("old"))
    gone = order.select(F.explode("old").alias(column)).distinct().join(order.select(F.col("hash").alias(column)).filter(f"{column} is not null"), column, "left_anti")
    return records.join(gone, column, "left_anti")
