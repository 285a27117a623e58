"""Where iterative plans cut their lineage: Parquet in the shared folder of the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all runs in one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df itself if it only reads, selects and filters files; else cut, so that what uses it twice does not compute it twice."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return df if all(re.match(r"[\s:+-]*(Project|Filter|Relation)\b", x) for x in plan.splitlines() if x.strip()) else cut(df)


def cut(df: DataFrame) -> DataFrame:
    """df as a written table: a durable cut of the lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
