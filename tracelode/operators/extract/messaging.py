"""Message layouts: files that describe a message or an exchange file, and the protocol that they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import records

# What tells a protocol, in order.
PROTOCOLS = ((r"\bCIP\b|\bC3\b|ACCC[0-9]{3}", "cip-c3"), (r"CNAB ?[0-9]{3}|CNAB", "cnab"), (r"CVM ?351|CVM351", "cvm351-b3"), (r"GARQ|SCC3", "garq-scc3"))
#: Lines that may name the layout; protocol and targets are sought in all lines, and a match may go over a line end.
HEAD_LINES = 200


def extract(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = F.upper(F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", ""))
    joined = lambda a: F.array_join(F.transform(a, lambda z: z["code"]), "\n")
    t = lines.groupBy("path", "hash").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("a"))
    t = t.select("path", "hash", joined(F.col("a")).alias("t"), joined(F.filter("a", lambda z: z["line"] <= HEAD_LINES)).alias("head"), base.alias("base"))
    text = F.concat_ws("\n", "base", F.upper("t"))
    protocol = F.lit("messaging")
    for p, name in reversed(PROTOCOLS):
        protocol = F.when(text.rlike(p), name).otherwise(protocol)
    named = F.upper(F.regexp_extract("head", r"(?im)^\s*(?:LAYOUT|MENSAGEM|MESSAGE)\s*[:=-]?\s*([A-Za-z][\w-]{2,})", 1))
    x = t.withColumn("protocol", protocol).withColumn("layout", F.when(F.length(named) > 0, named).otherwise(F.col("base"))).withColumn("sure", F.col("protocol") != "messaging")
    common = [F.col("path").alias("file"), F.col("hash").alias("fileHash"), F.lit("messaging").alias("extractor"), F.lit(1).alias("line"), F.lit(0).cast("bigint").alias("ordinal"), F.when(F.col("sure"), 0.9).otherwise(0.75).alias("confidence")]
    e = x.select(F.lit("message_layout").alias("type"), F.col("layout").alias("name"), F.array("protocol").alias("semantic_tags"), *common)
    sends = x.select("*", F.explode(F.array_distinct(F.regexp_extract_all(F.upper("t"), F.lit(r"\b(?:ENVIA|SENDS?|DESTINO)\s*[:=-]?\s*([A-Z][A-Z0-9-]{2,})"), 1))).alias("to"))
    r = sends.select(F.lit("SENDS").alias("rel"), F.col("layout").alias("from"), "to", F.lit("message_layout").alias("fromType"), F.lit("component").alias("toType"), *common)
    return records(e, r, lines.sparkSession)
