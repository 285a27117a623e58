"""Connected components by least labels with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): of every node of an edge, the smallest id in its component.

    A round takes the least label among a node and its neighbours, then the label of that label.
    Labels are written to the shared folder after each round; rounds grow with the logarithm of
    the longest path. Without edges the result is empty.
    """
    both = written(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).filter("x <> y").distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("l")).withColumnRenamed("x", "id"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy("x").agg(F.min("l").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "id"), "id", "left").select("id", "l", F.least("l", F.coalesce("near", "l")).alias("m"))
        jump = labels.select(F.col("id").alias("m"), F.col("l").alias("far"))
        new = written(step.join(jump, "m", "left").select("id", F.col("l").alias("old"), F.least("m", F.coalesce("far", "m")).alias("l")), "labels")
        labels = new.select("id", "l")
        if not new.filter("l <> old").limit(1).count():
            return labels.select("id", F.col("l").alias("component"))
