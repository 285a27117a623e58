"""Files that arrive over time: a file stream whose batches go through the batch ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.storage import cut
from ..operators.extract import extract
from ..sources import files as sources


def arrivals(spark: SparkSession, root: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of new files under root, classified."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    name = F.element_at(F.split(path, "/"), -1)
    return sources.classify(raw.select(path.alias("path"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), sources.file_hash(F.col("content")).alias("hash"), "content"))


def start(spark: SparkSession, root: str, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Extracts each batch of arrivals and appends its raw records under out, one folder a batch, so that a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        lines = sources.lines(cut(df).filter("dialect is not null").select("path", "hash", "name", "dialect", sources.decoded(F.col("content")).alias("text")))
        e, r = extract(lines)
        e.write.mode("overwrite").parquet(f"{out}/raw_entities/batch={number}")
        r.write.mode("overwrite").parquet(f"{out}/raw_relations/batch={number}")

    writer = arrivals(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
