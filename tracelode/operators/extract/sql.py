"""SQL scripts: tables, procedures and columns, and who accesses what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import records
from .cobol import SQL_RESERVED

TABLE = r"([A-Z_#@$][A-Z0-9_#@$]*(?:\.[A-Z_#@$][A-Z0-9_#@$]*)*)"
# Phrases before a table name, and what they do to it.
ACCESS = ((r"\bFROM\s+", "READS"), (r"\bJOIN\s+", "READS"), (r"\bINSERT\s+INTO\s+", "WRITES"), (r"\bMERGE\s+INTO\s+", "WRITES"), (r"\bUPDATE\s+", "UPDATES"), (r"\bDELETE\s+FROM\s+", "UPDATES"))
DEFINES = (r"\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?", r"\bALTER\s+TABLE\s+")
TYPES = r"CHAR|VARCHAR|VARCHAR2|NVARCHAR|INT|INTEGER|SMALLINT|BIGINT|DECIMAL|NUMERIC|NUMBER|FLOAT|REAL|DOUBLE|DATE|TIME|TIMESTAMP|DATETIME|BLOB|CLOB|TEXT|BIT|XML"


def texts(lines: DataFrame) -> DataFrame:
    """(path, hash, sql): whole scripts in upper case, without comments and quotes around names."""
    t = lines.groupBy("path", "hash").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code"))), lambda z: z["code"]), "\n").alias("t"))
    bare = F.regexp_replace(F.regexp_replace("t", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")
    return t.select("path", "hash", F.regexp_replace(F.upper(bare), r'[\[\]"]', "").alias("sql"))


def found(patterns, group: str) -> Column:
    """Names after each pattern, with the pattern's tag."""

    def tagged(pattern: str, tag: str) -> Column:
        return F.transform(F.regexp_extract_all("sql", F.lit(pattern + group), 1), lambda x: F.struct(F.lit(tag).alias("rel"), x.alias("name")))

    return F.flatten(F.array(*[tagged(p, tag) for p, tag in patterns]))


def line_of(name: Column) -> Column:
    """Line on which a name first stands."""
    at = F.instr(F.col("sql"), name)
    return (F.length(F.regexp_replace(F.substr(F.col("sql"), F.lit(1), at), "[^\n]", "")) + 1).cast("int")


def extract(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = texts(lines)
    created, called = F.regexp_extract_all("sql", F.lit(r"\bCREATE\s+(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:PROCEDURE|PROC|FUNCTION)\s+" + TABLE), 1), F.regexp_extract_all("sql", F.lit(r"\b(?:CALL|EXECUTE|EXEC)\s+" + TABLE), 1)
    base = F.upper(F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", ""))
    s = s.withColumn("created", F.array_distinct(created)).withColumn("called", F.array_distinct(called))
    s = s.withColumn("actor", F.coalesce(F.try_element_at("created", F.lit(1)), base)).withColumn("actorType", F.when(F.size("created") > 0, "procedure").otherwise("sql_script"))
    common = [F.col("path").alias("file"), F.col("hash").alias("fileHash"), F.lit("sql").alias("extractor")]
    good = lambda c: (F.length(c) > 1) & ~c.isin(*SQL_RESERVED)
    acc = s.select("path", "hash", "sql", "actor", "actorType", F.explode(F.array_distinct(F.concat(found(ACCESS, TABLE), found([(p, "DEFINES") for p in DEFINES], TABLE)))).alias("x")).select("path", "hash", "sql", "actor", "actorType", "x.*").filter(good(F.col("name")))
    ctes = s.select("path", F.explode(F.regexp_extract_all("sql", F.lit(r"(?:\bWITH|,)\s+([A-Z_][A-Z0-9_]*)\s+AS\s*\("), 1)).alias("name")).distinct()
    acc = acc.join(ctes, ["path", "name"], "left_anti")
    tables = acc.groupBy("path", "hash", "name").agg(F.min(line_of(F.col("name"))).alias("line")).select(F.lit("table").alias("type"), "name", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.lit(0.9).alias("confidence"), "line", *common)
    procs = s.select("path", "hash", "sql", F.explode(F.array_union("created", "called")).alias("name")).filter(good(F.col("name"))).select(F.lit("procedure").alias("type"), "name", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.lit(0.9).alias("confidence"), line_of(F.col("name")).alias("line"), *common)
    scripts = s.filter("actorType = 'sql_script'").select(F.lit("sql_script").alias("type"), F.col("actor").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.lit(0.9).alias("confidence"), F.lit(1).alias("line"), *common)
    cols = columns(s).select(F.lit("column").alias("type"), "name", "parent", F.lit("table").alias("parentType"), F.lit(0.8).alias("confidence"), "line", *common)
    e = tables.unionByName(procs).unionByName(scripts).unionByName(cols).withColumn("ordinal", F.col("line").cast("bigint"))
    rel = lambda d, r, to, kind: d.select(r.alias("rel"), F.col("actor").alias("from"), to.alias("to"), F.col("actorType").alias("fromType"), F.lit(kind).alias("toType"), F.lit(0.9).alias("confidence"), line_of(to).alias("line"), *common)
    calls = s.select("path", "hash", "sql", "actor", "actorType", F.explode("called").alias("name")).filter(good(F.col("name")) & (F.col("name") != F.col("actor")))
    r = rel(acc.filter("rel <> 'DEFINES'"), F.col("rel"), F.col("name"), "table").unionByName(rel(calls, F.lit("CALLS_PROC"), F.col("name"), "procedure")).withColumn("ordinal", F.col("line").cast("bigint"))
    return records(e, r, lines.sparkSession)


def columns(s: DataFrame) -> DataFrame:
    """(path, hash, parent, name, line) of select lists, assignments and insert lists, under the table of their statement."""
    def listed(p: str, a: int, b: int) -> Column:
        return F.transform(F.regexp_extract_all("sql", F.lit(p), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, p, a).alias("parent"), F.regexp_extract(m, p, b).alias("list")))

    select, update, insert = r"\bSELECT\s+([^;()]*?)\s+(?:INTO\s+[^;]*?\s+)?FROM\s+" + TABLE, r"\bUPDATE\s+" + TABLE + r"\s+SET\s+([^;]*?)(?:\s+WHERE\b|;|$)", r"\bINSERT\s+INTO\s+" + TABLE + r"\s*\(([^)]*)\)"
    parts = F.flatten(F.array(listed(select, 2, 1), listed(update, 1, 2), listed(insert, 1, 2)))
    x = s.select("path", "hash", "sql", F.explode(parts).alias("p")).select("path", "hash", "sql", "p.parent", F.explode(F.split("p.list", ",")).alias("piece"))
    name = F.element_at(F.split(F.regexp_extract(F.trim("piece"), r"^(?:DISTINCT\s+)?([A-Z_][A-Z0-9_.#$]*)", 1), r"\."), -1)
    x = x.withColumn("name", name).filter((F.length("name") > 1) & ~F.col("name").isin(*SQL_RESERVED))
    return x.groupBy("path", "hash", "parent", "name").agg(F.min(line_of(F.col("name"))).alias("line"))


def definitions(lines: DataFrame) -> DataFrame:
    """(path, parent, name, type) of CREATE TABLE columns: a declaration list is cut at commas outside brackets."""
    s = texts(lines).select("path", "hash", F.explode(F.regexp_extract_all("sql", F.lit(r"\bCREATE\s+TABLE\s+" + TABLE + r"\s*\(((?:[^()]|\([^()]*\))*)\)"), 0)).alias("m"))
    pattern = r"\bCREATE\s+TABLE\s+" + TABLE + r"\s*\(((?:[^()]|\([^()]*\))*)\)"
    body = F.regexp_replace(F.regexp_extract("m", pattern, 2), r"\([^()]*\)", "")
    x = s.select("path", F.regexp_extract("m", pattern, 1).alias("parent"), F.explode(F.split(body, ",")).alias("piece"))
    return x.select("path", "parent", F.regexp_extract(F.trim("piece"), r"^([A-Z_][A-Z0-9_#$]*)\s", 1).alias("name"), F.regexp_extract(F.trim("piece"), r"^[A-Z_][A-Z0-9_#$]*\s+(" + TYPES + r")\b", 1).alias("type")).filter("length(name) > 0 and length(type) > 0")
