"""A property graph out of relational tables: how the operators meet tabular data.

Entities are regions, nations, customers, suppliers, parts and orders; containment follows the
foreign keys; a line item is one access of a supplier to a part (its return flag tells which
kind, its discount the confidence, its key the evidence); nations call nations where lines of
their suppliers fill orders of their customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))


def entities(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    none, no = F.lit(None).cast("string"), F.lit(False)
    parts = [
        t("region").select(key("region", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name"), none.alias("parent"), F.lit(1.0).alias("confidence"), no.alias("inferred")),
        t("nation").select(key("nation", "n_nationkey"), F.lit("nation"), "n_name", key("region", "n_regionkey"), F.lit(1.0), no),
        t("customer").select(key("customer", "c_custkey"), F.lit("customer"), "c_name", key("nation", "c_nationkey"), F.lit(0.9), F.col("c_acctbal") < 0),
        t("supplier").select(key("supplier", "s_suppkey"), F.lit("supplier"), "s_name", key("nation", "s_nationkey"), F.lit(0.9), F.col("s_acctbal") < 0),
        t("part").select(key("part", "p_partkey"), F.lit("part"), "p_name", none, F.lit(0.8), F.col("p_size") < 5),
    ]
    if orders:
        parts.append(t("orders").select(key("order", "o_orderkey"), F.lit("order"), key("order", "o_orderkey"), key("customer", "o_custkey"), F.lit(0.7), F.col("o_orderstatus") == "P"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def contains(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """CONTAINS edges: region, nation, customer or supplier, order."""
    e = entities(spark, sf_dir, orders).filter("parent is not null")
    return e.select(F.lit("CONTAINS").alias("rel"), F.col("parent").alias("from_id"), F.col("id").alias("to_id"), F.col("confidence"))


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw edge for each line item: supplier READS, WRITES or UPDATES part."""
    rel = F.when(F.col("l_returnflag") == "R", "READS").when(F.col("l_returnflag") == "A", "WRITES").otherwise("UPDATES")
    return table(spark, sf_dir, "lineitem").select(
        rel.alias("rel"),
        key("supplier", "l_suppkey").alias("from_id"),
        key("part", "l_partkey").alias("to_id"),
        F.round(1 - F.col("l_discount") * 7, 2).alias("confidence"),
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("evidence"),
        "l_shipdate",
    )


def calls(spark: SparkSession, sf_dir: str, least_share: float = 0.0) -> DataFrame:
    """Nations that call nations, with the number of lines. least_share: of the mean number of lines of a pair."""
    t = lambda n: table(spark, sf_dir, n)
    li = t("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    x = li.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy("l_suppkey", "o_custkey").agg(F.sum("n").alias("n"))
    x = x.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    g = x.groupBy("s_nationkey", "c_nationkey").agg(F.sum("n").alias("n"))
    g = g.select(key("nation", "s_nationkey").alias("from_id"), key("nation", "c_nationkey").alias("to_id"), "n")
    if least_share:
        mean = g.agg(F.avg("n").alias("mean"))
        g = g.join(F.broadcast(mean), F.col("n") > F.col("mean") * least_share).drop("mean")  # one row
    return g.select(F.lit("CALLS").alias("rel"), "from_id", "to_id", "n")
