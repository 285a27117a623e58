"""Catalog lookups: aliases, canonical ids, subgraphs of a program, impact and lineage chains, transactions and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..functions.text import normalize_name
from . import graph

# Relations that a program's subgraph follows, that write and that read.
SUBGRAPH = ("CALLS", "CALLS_PROC", "READS", "WRITES", "UPDATES")
WRITERS, READERS = ("WRITES", "FEEDS", "TRANSFORMS", "UPDATES"), ("READS", "USES")


def generations(datasets: DataFrame, name: str = "name") -> DataFrame:
    """datasets with base and generation: A.B(+1), or A.B+1 where brackets are gone, is generation +1 of A.B."""
    base = F.regexp_extract(name, r"^(.*?)\(?([+-][0-9]+|0)\)?$", 1)
    gen = F.regexp_extract(name, r"^(.*?)\(?([+-][0-9]+|0)\)?$", 2)
    has = F.col(name).rlike(r"(\([+-]?[0-9]+\)|[+-][0-9]+)$")
    return datasets.withColumn("base", F.when(has & (F.length(base) > 0), base).otherwise(F.col(name))).withColumn("generation", F.when(has & (F.length(gen) > 0), gen))


def aliases(entities: DataFrame) -> DataFrame:
    """(alias, canonical_id, kind): bare names of programs, bases of generation datasets, copybooks with extension, tables without schema."""
    e = entities.filter("not coalesce(inferred, false)")
    gdg = generations(e.filter("type = 'dataset'"))
    return (
        e.filter("type = 'program'").select(normalize_name(F.col("name")).alias("alias"), F.col("id").alias("canonical_id"), F.lit("name").alias("kind"))
        .union(gdg.filter("generation is not null").select("base", "id", F.lit("generation")))
        .union(e.filter("type = 'copybook'").select(F.explode(F.array("name", F.concat("name", F.lit(".CPY")))), "id", F.lit("file")))
        .union(e.filter("type = 'table'").select(F.element_at(F.split("name", r"\."), -1), "id", F.lit("bare")))
        .distinct()
    )


def canonical(names: DataFrame, entities: DataFrame, known: DataFrame) -> DataFrame:
    """(name, type, id, how) of names (name, type): by alias, else by type and name, else by any type; the smallest id of each way."""
    n = names.select(normalize_name(F.col("name")).alias("name"), "type").distinct()
    by_alias = n.join(known.select(normalize_name(F.col("alias")).alias("name"), F.col("canonical_id").alias("id")), "name").select("name", "type", "id", F.lit(0).alias("how"))
    e = entities.select(normalize_name(F.col("name")).alias("name"), F.col("type").alias("etype"), "id")
    by_name = n.join(e, "name").select("name", "type", "id", F.when(F.col("etype").eqNullSafe(F.col("type")), 1).otherwise(2).alias("how"))
    got = by_alias.union(by_name).groupBy("name", "type").agg(F.min(F.struct("how", "id")).alias("b"))
    return n.join(got, ["name", "type"], "left").select("name", "type", "b.id", F.when(F.col("b.how") == 0, "alias").when(F.col("b.how") == 1, "typed").when(F.col("b.how") == 2, "any").alias("how"))


def subgraph(program: DataFrame, relations: DataFrame, max_depth: int = 3) -> DataFrame:
    """Edges below a program over data and calls, and its direct callers at depth 0."""
    used = relations.filter(F.col("rel").isin(*SUBGRAPH)).select("rel", "from_id", "to_id")
    down = graph.traverse(program, used, "downstream", max_depth)
    callers = used.filter(F.col("rel").isin("CALLS", "CALLS_PROC")).join(program.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("rel", "from_id", "to_id", F.lit(0).alias("depth"))
    return down.union(callers).distinct()


def impact_chain(seeds: DataFrame, relations: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, depth): what leads to the seeds, by hops, and at depth -1 what they lead to."""
    edges = relations.select("from_id", "to_id")
    up = graph.reach(seeds, edges, "upstream", max_depth)
    ahead = edges.join(seeds.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"), F.lit(-1).alias("depth")).distinct()
    return up.unionByName(ahead.join(up.select("id"), "id", "left_anti"))


def lineage_chain(term: str, entities: DataFrame, relations: DataFrame, most: int = 10) -> DataFrame:
    """(subject, side, id, rel): writers and readers of the entities of this name, else of those that hold it (up to most)."""
    t = term.strip().upper()
    exact = entities.filter((F.upper("name") == t) | (F.upper("id") == t)).select("id").orderBy("id").limit(most)
    hit = cut(exact)
    if hit.isEmpty():
        hit = cut(entities.filter(F.contains(F.upper("name"), F.lit(t))).select("id").orderBy("id").limit(most))
    r = relations.join(hit.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    side = F.when(F.col("rel").isin(*WRITERS), "writer").when(F.col("rel").isin(*READERS), "reader")
    return r.select(F.col("to_id").alias("subject"), side.alias("side"), F.col("from_id").alias("id"), "rel").filter("side is not null").distinct()


def unreferenced(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities (id) that no relation begins or ends at."""
    return entities.join(relations.select(F.col("from_id").alias("id")), "id", "left_anti").join(relations.select(F.col("to_id").alias("id")), "id", "left_anti")


def touching(relations: DataFrame, key: str) -> DataFrame:
    """Relations with this end, once each: two filters that files can answer, not one with OR."""
    return relations.filter(F.col("from_id") == key).unionByName(relations.filter((F.col("to_id") == key) & (F.col("from_id") != key)))


def files_with(files: DataFrame, records: DataFrame, key: str, columns: dict) -> DataFrame:
    """files with columns of their records, or the given value for a file without any."""
    both = files.join(records.select(key, *columns), key, "left")
    return both.select(*files.columns, *[F.coalesce(c, F.lit(v)).alias(c) for c, v in columns.items()])


def dependency_counts(relations: DataFrame) -> DataFrame:
    """(kind, n): call, batch and data edges."""
    kind = F.when(F.col("rel").isin("CALLS", "CALLS_PROC", "CALL-DYNAMIC"), "calls").when(F.col("rel").isin("CONTAINS", "EXECUTES"), "batch").when(F.col("rel").isin("READS", "WRITES", "UPDATES"), "data")
    return relations.select(kind.alias("kind")).filter("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def transactions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls by EXEC CICS LINK or XCTL (path, line, target, verb), and which files use CICS, DB2 or IMS (path, cics, db2, ims)."""
    up = F.upper("code")
    call = lines.select("path", "line", F.regexp_extract(up, r"\b(LINK|XCTL)\s+PROGRAM\s*\(\s*'([A-Z0-9@#$]+)'", 1).alias("verb"), F.regexp_extract(up, r"\b(?:LINK|XCTL)\s+PROGRAM\s*\(\s*'([A-Z0-9@#$]+)'", 1).alias("target")).filter("length(target) > 0")
    some = lambda p: F.max(up.rlike(p))
    return call, lines.groupBy("path").agg(some(r"\bEXEC\s+CICS\b").alias("cics"), some(r"\bEXEC\s+SQL\b").alias("db2"), some(r"\bCBLTDLI\b|\bEXEC\s+DLI\b").alias("ims"))


def defined_in(entities: DataFrame) -> DataFrame:
    """DEFINED_IN edges of every entity to its files."""
    return entities.select(F.lit("DEFINED_IN").alias("rel"), F.col("id").alias("from_id"), F.explode("files").alias("to_id"))
