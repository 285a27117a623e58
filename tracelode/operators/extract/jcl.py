"""Batch jobs: jobs, steps and datasets, with conditions.

Statements are split at white space, so short names and missing names are read too; statements in
fixed columns give the same records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.storage import cut
from . import records

# Operations, dispositions that write, and words that give tags.
OPERATIONS = ("JOB", "EXEC", "DD", "PROC", "PEND", "IF", "ELSE", "ENDIF", "SET", "INCLUDE", "JCLLIB", "OUTPUT")
WRITES = ("NEW", "MOD", "CATLG")
TAGS = (("TERMO DE CESSAO", "termo-de-cessao"), ("RELATORIO", "relatorio"), ("EMITE", "emissao"), ("GERA", "geracao"))


def statements(lines: DataFrame) -> DataFrame:
    """(path, hash, line, op, label, operands, description, comment_lines): one row for each statement, continuations joined, with the comment block right above it."""
    w = Window.partitionBy("path").orderBy("line")
    x = lines.withColumn("c", F.rtrim(F.substring("code", 1, 72)))
    card, comment = F.startswith("c", F.lit("//")), F.startswith("c", F.lit("//*"))
    op = F.upper(F.regexp_extract("c", r"^//\S*\s+(\S+)", 1))
    x = x.withColumn("comment", comment).withColumn("op", F.when(card & ~comment & op.isin(*OPERATIONS), op)).withColumn("more", card & ~comment & F.col("op").isNull())
    x = x.withColumn("stmt", F.sum((~F.col("more")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("block", F.sum((~F.col("comment")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring("c", 4, 80), r"^[\s*]+", ""), r"^[\s-]+", ""), r"\s+", " "))
    body = F.when(F.col("more"), F.trim(F.substring("c", 3, 80))).otherwise(F.regexp_extract("c", r"^//\S*\s+\S+\s*(.*)$", 1))
    # comments go to the block that follows them, continuations to the block of their statement: one grouping of the lines gives both
    own = F.last(F.when(F.col("op").isNotNull(), F.struct("stmt", "block")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("own", own).withColumn("key", F.when(F.col("comment"), F.col("block") + 1).when(card & (F.col("own.stmt") == F.col("stmt")), F.col("own.block"))).filter("key is not null")
    first = lambda c: F.max(F.when(F.col("op").isNotNull(), F.col(c))).alias(c)
    s = x.groupBy("path", "key").agg(
        first("hash"), first("op"), first("line"), first("block"), F.max(F.when(F.col("op").isNotNull(), F.upper(F.regexp_extract("c", r"^//(\S*)", 1)))).alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("comment"), F.struct("line", body.alias("b"))))), lambda z: z["b"]), " ").alias("operands"), F.array_sort(F.collect_list(F.when(F.col("comment"), F.struct("line", text.alias("t"))))).alias("said"),
    ).filter("op is not null")
    some = F.when(F.size("said") > 0, F.col("said"))
    s = s.withColumn("notes", F.transform(some, lambda n: n["t"])).withColumn("comment_lines", F.transform(some, lambda n: n["line"])).drop("said")
    return s.withColumn("description", F.when(F.col("op").isin("JOB", "EXEC"), F.array_join(F.filter("notes", lambda n: F.length(n) > 0), " "))).withColumn("operands", F.upper("operands"))


def placed(lines: DataFrame) -> DataFrame:
    """Statements with their job, step and the number of the step in its job."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = statements(lines).withColumn("base", F.upper(F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", "")))
    s = s.withColumn("jobno", F.sum((F.col("op") == "JOB").cast("int")).over(w))
    s = s.withColumn("job", F.last(F.when(F.col("op") == "JOB", F.when(F.length("label") > 0, F.col("label")).otherwise(F.col("base"))), True).over(w))
    v = Window.partitionBy("path", "jobno").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("seq", F.sum((F.col("op") == "EXEC").cast("int")).over(v))
    own = F.when(F.length("label") > 0, F.col("label")).otherwise(F.concat(F.lit("STEP"), F.col("seq").cast("string")))
    return s.withColumn("step", F.last(F.when(F.col("op") == "EXEC", own), True).over(v))


def described(s: DataFrame) -> DataFrame:
    tags = F.filter(F.array(F.lit("jcl"), *[F.when(F.contains(F.upper("description"), F.lit(t)), tag) for t, tag in TAGS]), lambda t: t.isNotNull())
    has = F.length("description") > 0
    return s.withColumn("description_source", F.when(has, "jcl_comment")).withColumn("description_evidence", F.when(has, F.transform("comment_lines", lambda n: F.concat_ws(":", F.col("path"), n.cast("string"))))).withColumn("semantic_tags", F.when(has, tags)).withColumn("description", F.when(has, F.col("description")))


def extract(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = cut(described(placed(lines))).withColumn("file", F.col("path")).withColumn("fileHash", F.col("hash")).withColumn("extractor", F.lit("jcl")).withColumn("ordinal", F.col("line").cast("bigint"))
    meta = ["file", "fileHash", "line", "extractor", "ordinal", "description", "description_source", "description_evidence", "semantic_tags"]
    dsn = F.regexp_replace(F.regexp_extract("operands", r"DSN=([A-Z0-9@#$.()+&-]{1,44})", 1), "[()]", "")
    disp = F.regexp_extract("operands", r"DISP=\(?([A-Z]+)", 1)
    dd = s.filter("op = 'DD'").withColumn("dsn", dsn).filter(F.length("dsn") > 0).withColumn("disp", disp)
    ex = s.filter("op = 'EXEC'")
    e = (
        s.filter("op = 'JOB'").select(F.lit("job").alias("type"), F.col("job").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.lit(None).cast("int").alias("seq"), F.lit(1.0).alias("confidence"), *meta)
        .unionByName(ex.select(F.lit("step").alias("type"), F.col("step").alias("name"), F.col("job").alias("parent"), F.lit("job").alias("parentType"), F.col("seq").cast("int").alias("seq"), F.lit(1.0).alias("confidence"), *meta))
        .unionByName(dd.select(F.lit("dataset").alias("type"), F.col("dsn").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.lit(None).cast("int").alias("seq"), F.lit(0.9).alias("confidence"), *meta[:5], *[F.lit(None).cast(t).alias(c) for c, t in zip(meta[5:], ("string", "string", "array<string>", "array<string>"), strict=True)]))
    )
    pgm, proc, bare = F.regexp_extract("operands", r"PGM=([A-Z0-9@#$]+)", 1), F.regexp_extract("operands", r"PROC=([A-Z0-9@#$]+)", 1), F.regexp_extract("operands", r"^([A-Z0-9@#$]+)(?:[,\s]|$)", 1)
    ex = ex.withColumn("pgm", pgm).withColumn("target", F.when(F.length(pgm) > 0, pgm).when(F.length(proc) > 0, proc).otherwise(bare))
    base = [c for c in meta[:5]]
    rel = lambda d, r, a, b, at, bt, ap, bp, conf: d.select(r.alias("rel"), a.alias("from"), b.alias("to"), F.lit(at).alias("fromType"), bt.alias("toType"), ap.alias("fromParent"), bp.alias("toParent"), F.lit(conf).alias("confidence"), F.col("seq").cast("int").alias("seq"), *base)
    none = F.lit(None).cast("string")
    r = (
        rel(ex.filter("job is not null"), F.lit("CONTAINS"), F.col("job"), F.col("step"), "job", F.lit("step"), none, F.col("job"), 1.0)
        .unionByName(rel(ex.filter("length(target) > 0"), F.when(F.length("pgm") > 0, "EXECUTES").otherwise("CALLS_PROC"), F.col("step"), F.col("target"), "step", F.when(F.length("pgm") > 0, "program").otherwise("procedure"), F.col("job"), none, 1.0))
        .unionByName(rel(dd.filter("step is not null"), F.when(F.col("disp").isin(*WRITES), "WRITES").otherwise("READS"), F.col("step"), F.col("dsn"), "step", F.lit("dataset"), F.col("job"), none, 0.85))
    )
    return records(e, r, lines.sparkSession)


def conditions(lines: DataFrame) -> DataFrame:
    """(path, job, step, seq, tests, mode, run_condition) of every EXEC with COND: the tests as written, and when the step runs.

    COND=(4,LT) skips a step if 4 is less than a return code, so the step runs while all are at most 4.
    """
    runs = {"GT": ">=", "GE": ">", "LT": "<=", "LE": "<", "EQ": "<>", "NE": "="}
    ex = placed(lines).filter("op = 'EXEC'").filter(F.contains("operands", F.lit("COND=")))
    cond = F.regexp_extract("operands", r"COND=(\((?:[^()]|\([^()]*\))*\)|[A-Z]+)", 1)
    code, op, step = (F.regexp_extract_all("cond", F.lit(r"([0-9]{1,4}),\s*(GT|GE|LT|LE|EQ|NE)(?:,\s*([A-Z0-9@#$.]+))?"), i) for i in (1, 2, 3))
    ex = ex.withColumn("cond", cond).withColumn("tests", F.arrays_zip(code.alias("rc"), op.alias("op"), step.alias("step")))
    ex = ex.withColumn("mode", F.when(F.contains("cond", F.lit("EVEN")), "EVEN").when(F.contains("cond", F.lit("ONLY")), "ONLY"))
    say = lambda t: F.concat(F.lit("RC"), F.when(F.length(F.coalesce(t["step"], F.lit(""))) > 0, F.concat(F.lit("("), t["step"], F.lit(")"))).otherwise(F.lit("")), F.lit(" "), F.element_at(F.create_map(*[F.lit(x) for kv in runs.items() for x in kv]), t["op"]), F.lit(" "), t["rc"])
    text = F.array_join(F.transform("tests", say), " and ")
    return ex.select("path", "job", "step", "seq", "tests", "mode", F.when(F.col("mode") == "EVEN", F.concat(F.lit("even after a failure"), F.when(F.length(text) > 0, F.concat(F.lit(", if "), text)).otherwise(F.lit("")))).when(F.col("mode") == "ONLY", "only after a failure").otherwise(text).alias("run_condition"))
