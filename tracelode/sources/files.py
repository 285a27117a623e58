"""Files as rows: scan, classification, encoding, lines, and readers of what earlier runs have written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema
from ..functions.storage import cut
from ..functions.text import glob_regex

# Fixed values: (dialect, role) by extension; .txt and .inc are told by their content only.
EXTENSIONS = {
    ".cbl": ("cobol", "program"), ".cob": ("cobol", "program"), ".cpy": ("copybook", "copybook"), ".jcl": ("jcl", "job"), ".prc": ("jcl", "procedure"), ".sql": ("sql", "script"),
    ".ddl": ("sql", "script"), ".vbp": ("vb6", "project"), ".frm": ("vb6", "form"), ".cls": ("vb6", "class"), ".bas": ("vb6", "module"), ".ctl": ("vb6", "control"),
}
ROLE_BY_DIALECT = {"cobol": "program", "copybook": "copybook", "jcl": "job", "sql": "script", "vb6": "module", "messaging": "layout"}
SKIP_NAMES = (".git", "node_modules", ".workspace")
HEAD_BYTES, HEAD_LINES, UTF8_SAMPLE = 2048, 30, 512


#: Changed files with an old time that are read by name; more are found by reading all.
MOST_PATHS = 1000
MTIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def listed(spark: SparkSession, paths: list[str], skip: tuple[str, ...] = SKIP_NAMES, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All files under the paths but those in skipped folders or under an excluded glob: (path, name, ext, size, mtime, modified, content). Content is read only where it is selected."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).withColumnRenamed("path", "uri")
    df = df.withColumn("path", F.regexp_replace("uri", "^file:/*", "/"))
    name = F.element_at(F.split("path", "/"), -1)
    df = df.filter(~F.exists(F.split(F.lower("path"), "/"), lambda p: p.isin(*[s.lower() for s in skip])))
    for glob in exclude:
        df = df.filter(~F.col("path").rlike(glob_regex(glob)))
    return df.select("uri", "path", name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length").alias("size"), F.date_format("modificationTime", MTIME).alias("mtime"), F.col("modificationTime").alias("modified"), "content")


def hashed(files: DataFrame) -> DataFrame:
    return files.select("path", "name", "ext", "size", file_hash(F.col("content")).alias("hash"), "mtime", "content")


def scan(spark: SparkSession, paths: list[str], skip: tuple[str, ...] = SKIP_NAMES, exclude: tuple[str, ...] = ()) -> DataFrame:
    """All files under the paths (path, name, ext, size, hash, mtime, content) but those in skipped folders or under an excluded glob."""
    return hashed(listed(spark, paths, skip, exclude))


def scan_changed(spark: SparkSession, paths: list[str], previous: DataFrame, skip: tuple[str, ...] = SKIP_NAMES, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(files whose size or time is not that of the previous inventory, as scan gives them; the previous rows of all others).

    First only names, sizes and times are listed. Content is then read by time, which the source applies before it opens a file: files that are
    as new as the newest known one. Changed files with an older time are read by name if they are MOST_PATHS at most, else among all files.
    """
    every = listed(spark, paths, skip, exclude)
    now = cut(every.select("uri", "path", "size", "mtime", "modified"))
    known = previous.select("path", "size", "mtime").distinct()
    same = previous.join(now.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi")
    changed = cut(now.join(known, ["path", "size", "mtime"], "left_anti"))
    newest = previous.agg(F.max("mtime").alias("m")).first()["m"]
    if newest is None:
        return hashed(every), same
    since = F.to_timestamp(F.lit(newest), MTIME)
    late = every.filter(F.col("modified") >= since).join(changed.select("path"), "path", "left_semi")
    old = changed.filter(~(F.col("modified") >= since)).select("uri")
    few = [r["uri"] for r in old.limit(MOST_PATHS + 1).collect()]
    if not few:
        return hashed(late), same
    rest = listed(spark, few, skip, exclude) if len(few) <= MOST_PATHS else every.join(changed.filter(~(F.col("modified") >= since)).select("path"), "path", "left_semi")
    return hashed(late).unionByName(hashed(rest)), same


def file_hash(content: Column) -> Column:
    """The first 12 hex digits of SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 12)


def by_extension(ext: Column) -> tuple[Column, Column]:
    dialect = role = F.lit(None).cast("string")
    for e, (d, r) in EXTENSIONS.items():
        dialect, role = F.when(ext == e, d).otherwise(dialect), F.when(ext == e, r).otherwise(role)
    return dialect, role


def by_content(content: Column) -> Column:
    """Dialect by rules over the first lines, in order: cobol, copybook, jcl, sql, vb6, messaging."""
    head = F.slice(F.split(F.upper(F.decode(F.substring(content, 1, HEAD_BYTES), "ISO-8859-1")), "\r?\n"), 1, HEAD_LINES)
    some = lambda p: F.exists(head, lambda x: x.rlike(p))
    count = lambda p: F.size(F.filter(head, lambda x: x.rlike(p)))
    return (
        F.when(some(r"\b(IDENTIFICATION|PROCEDURE|DATA|ENVIRONMENT) DIVISION\b|\bPROGRAM-ID\b"), "cobol")
        .when(count(r"^.{0,10}\b(0[1-9]|[1-4][0-9]|77|88)\s+[A-Z][A-Z0-9-]*") >= 2, "copybook")
        .when(some(r"^//\S+\s+JOB\b") | (count("^//") > 3), "jcl")
        .when(some(r"^\s*(CREATE|ALTER|SELECT|INSERT|UPDATE|DELETE|DROP|WITH)\s"), "sql")
        .when(some(r"^VERSION [0-9.]+|^ATTRIBUTE VB_NAME|^BEGIN VB\.|^(PUBLIC|PRIVATE)? ?(SUB|FUNCTION) "), "vb6")
        .when(some(r"\bCIP\b|\bC3\b|CNAB|CVM351|GARQ|SCC3|<\?XML"), "messaging")
    )


def classify(files: DataFrame) -> DataFrame:
    """files with dialect and role: by extension, else by content."""
    dialect, role = by_extension(F.col("ext"))
    found = F.coalesce(dialect, by_content(F.col("content")))
    by_dialect = F.lit(None).cast("string")
    for d, r in ROLE_BY_DIALECT.items():
        by_dialect = F.when(found == d, r).otherwise(by_dialect)
    return files.withColumn("dialect", found).withColumn("role", F.coalesce(role, by_dialect))


def encoding(content: Column) -> Column:
    """By byte order mark, else utf-8 if the first bytes are valid and hold at most two NULs, else latin1. A character that the end of the sample cuts does not count."""
    mark, sample = F.hex(F.substring(content, 1, 3)), F.substring(content, 1, UTF8_SAMPLE)
    valid = F.is_valid_utf8(sample.cast("string"))
    for less in (1, 2, 3):
        valid = valid | ((F.octet_length(content) > UTF8_SAMPLE) & F.is_valid_utf8(F.substring(content, 1, UTF8_SAMPLE - less).cast("string")))
    nuls = F.length(F.regexp_replace(F.hex(sample), "(00)|..", "$1"))
    return (
        F.when(F.startswith(mark, F.lit("FFFE")), "UTF-16LE").when(F.startswith(mark, F.lit("FEFF")), "UTF-16BE").when(mark == "EFBBBF", "UTF-8-BOM")
        .when(valid & (nuls <= 4), "UTF-8").otherwise("ISO-8859-1")
    )


def decoded(content: Column) -> Column:
    enc = encoding(content)
    return (
        F.when(enc == "UTF-16LE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")).when(enc == "UTF-16BE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
        .when(enc == "UTF-8-BOM", F.decode(F.substring(content, 4, 1 << 30), "UTF-8")).when(enc == "UTF-8", F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    )


def lines(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line: line (from 1) and code, without the carriage return."""
    rest = [c for c in df.columns if c != text]
    out = df.select(*rest, F.posexplode(F.split(F.col(text), "\n")))
    return out.select(*rest, (F.col("pos") + 1).alias("line"), F.regexp_replace("col", "\r$", "").alias("code"))


def fixed_columns(code: Column) -> tuple[Column, Column]:
    """Indicator (column 7) and code area (columns 8 to 72) of a fixed-format line."""
    return F.substring(code, 7, 1), F.rtrim(F.substring(code, 8, 65))


def numbered(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, hash, name, line, code) of classified files with content."""
    return lines(files.select("path", "hash", "name", decoded(F.col("content")).alias("text")))


def sanitize(df: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """df with alias_path: the longest root (alias, root) that a path begins with becomes its alias; other paths keep their last segment.

    Roots are a handful of source folders, so the prefix join is against a small side.
    """
    keys = df.select(path).distinct()
    met = keys.join(roots, F.startswith(F.col(path), F.col("root")))
    best = met.groupBy(path).agg(F.max_by(F.concat_ws("/", "alias", F.regexp_replace(F.substr(F.col(path), F.length("root") + 1), "^/", "")), F.length("root")).alias("__alias"))
    return df.join(best, path, "left").withColumn("alias_path", F.coalesce("__alias", F.element_at(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"), -1))).drop("__alias")


def resolve_alias(df: DataFrame, roots: DataFrame, path: str = "alias_path") -> DataFrame:
    """df with path again: the alias replaced by its root."""
    first = F.substring_index(F.col(path), "/", 1)
    out = df.withColumn("__a", first).join(roots.select(F.col("alias").alias("__a"), "root"), "__a", "left")
    return out.withColumn("resolved", F.when(F.col("root").isNull(), F.col(path)).otherwise(F.concat_ws("/", F.regexp_replace("root", "/$", ""), F.substr(F.col(path), F.length("__a") + 2)))).drop("__a", "root")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.FILES).option("header", True).option("escape", '"').csv(path)


def write_inventory(files: DataFrame, path: str) -> None:
    schema.shaped(files, schema.FILES).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw entities and relations of JSON lines; lines that aren't JSON are skipped."""
    kinds = "kind string, "
    both = [spark.read.schema(kinds + ddl.removesuffix(", ordinal bigint")).option("mode", "DROPMALFORMED").json(path).filter(F.col("kind") == k).drop("kind") for k, ddl in (("entity", schema.RAW_ENTITY), ("relation", schema.RAW_RELATION))]
    return tuple(d.withColumn("ordinal", F.coalesce("line", F.lit(0)).cast("bigint")) for d in both)


def read_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a snapshot folder, in Parquet, else in JSON arrays."""
    def one(name: str, ddl: str) -> DataFrame:
        try:
            return spark.read.schema(ddl).parquet(f"{folder}/{name}.parquet").select("*")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.read.schema(ddl).option("multiLine", True).json(f"{folder}/{name}.json")

    return one("entities", schema.ENTITY), one("relations", schema.RELATION)


def write_model(entities: DataFrame, relations: DataFrame, folder: str) -> None:
    entities.write.mode("overwrite").parquet(f"{folder}/entities.parquet")
    relations.write.mode("overwrite").parquet(f"{folder}/relations.parquet")
