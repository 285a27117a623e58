"""Desktop sources: projects, forms, classes and modules, and what their lines touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import records

# Controls that only hold others, and kinds of units by extension.
HOLDERS = ("PICTUREBOX", "FRAME", "SSFRAME")
UNITS = {".frm": "screen", ".cls": "class", ".bas": "module", ".vbp": "project"}
ROUTINE = r"(?i)^\s*(?:(?:Public|Private|Friend|Static)\s+)*(?:Sub|Function|Property\s+(?:Get|Let|Set))\s+(\w+)"


def units(lines: DataFrame) -> DataFrame:
    """Lines with the kind and name of their unit, and the routine that they are in; files of other extensions go."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1))
    kind = F.create_map(*[F.lit(v) for pair in UNITS.items() for v in pair])[ext]
    base = F.upper(F.regexp_replace(F.regexp_extract("path", r"([^/\\]+)$", 1), r"\.[^.]*$", ""))
    x = lines.withColumn("unit", kind).filter("unit is not null").withColumn("base", base).withColumn("up", F.upper("code"))
    x = x.withColumn("form", some(r"(?i)^\s*Begin\s+VB\.(?:MDI)?Form\s+(\w+)", "VB.")).withColumn("given", some(r'(?i)^Attribute\s+VB_Name\s*=\s*"([^"]+)"', "VB_NAME"))
    named = F.upper(F.coalesce(found("form"), found("given")))
    by_line = Window.partitionBy("path").orderBy("line")
    x = x.withColumn("called", named).withColumn("named", F.first("called", True).over(by_line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    x = x.withColumn("name", F.coalesce("named", "base")).withColumn("sure", F.col("named").isNotNull() | (F.col("unit") != "screen"))
    x = x.withColumn("starts", F.upper(F.coalesce(some(ROUTINE, "SUB", "FUNCTION", "PROPERTY"), F.lit(""))))
    return x.withColumn("routine", F.last(F.when(F.length("starts") > 0, F.col("starts")).when(F.col("code").rlike(r"(?i)^\s*End\s+(Sub|Function|Property)\b"), ""), True).over(by_line.rowsBetween(Window.unboundedPreceding, 0)))


def some(pattern: str, *words: str, group: int = 1):
    """What a pattern finds in the code, "" for nothing; it is tried only on lines that hold one of the words, as each match does. See found()."""
    return F.when(reduce(lambda a, b: a | b, [F.contains("up", F.lit(w)) for w in words]), F.regexp_extract("code", pattern, group))


def found(c: str):
    """A column of some(), null for nothing."""
    return F.when(F.length(c) > 0, F.col(c))


def dataset_name(c):
    """Last segment of a path, in upper case."""
    return F.upper(F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1))


def extract(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = units(lines)
    head = x.select("path", "hash", "unit", "name", "sure").distinct()
    common = ["path", "hash", "line", "unit", "name", "routine"]
    entity = lambda kind, name, conf, parent=None, ptype=None, control=None: F.struct(F.lit(kind).alias("type"), name.alias("name"), (parent if parent is not None else F.lit(None).cast("string")).alias("parent"), (ptype if ptype is not None else F.lit(None).cast("string")).alias("parentType"), F.lit(conf).alias("confidence"), (control if control is not None else F.lit(None).cast("string")).alias("controlType"))
    rel = lambda r, to, kind, conf, frm=None, ftype=None, fparent=None, tparent=None: F.struct(F.lit(r).alias("rel"), (frm if frm is not None else F.col("name")).alias("from"), to.alias("to"), (ftype if ftype is not None else F.col("unit")).alias("fromType"), F.lit(kind).alias("toType"), (fparent if fparent is not None else F.lit(None).cast("string")).alias("fromParent"), (tparent if tparent is not None else F.lit(None).cast("string")).alias("toParent"), F.lit(conf).alias("confidence"))
    # Each pattern is a column of its own, evaluated once a line; the records below only refer to these.
    screen, project = F.col("unit") == "screen", F.col("unit") == "project"
    code = x.filter(~F.col("code").rlike(r"^\s*'")).withColumns({
        "member_": F.when(project, F.regexp_extract("code", r"(?i)^\s*(?:Form|Class|Module)\s*=\s*(?:[^;]*;\s*)?(\S+)\s*$", 1)), "mkind": F.when(project, F.lower(F.regexp_extract("code", r"(?i)^\s*(Form|Class|Module)\s*=", 1))),
        "before": F.when(project, F.regexp_extract("code", r"=\s*([^;]+);", 1)), "ocx_": F.when(screen, some(r'(?i)^\s*Object\s*=.*?([\w.]+\.ocx)"?', ".OCX")),
        "ctype": F.upper(F.coalesce(some(r"(?i)^\s*Begin\s+(?:\w+)\.(\w+)\s+\w+", "BEGIN"), F.lit(""))), "cname": F.upper(F.coalesce(some(r"(?i)^\s*Begin\s+(?:\w+)\.\w+\s+(\w+)", "BEGIN"), F.lit(""))),
        "event": F.when(screen & F.contains("starts", F.lit("_")), F.regexp_extract("starts", r"^(.*)_[^_]+$", 1)),
        "lib_": some(r'(?i)\bLib\s+"([^"]+\.(?:dll|ocx))"', "LIB"), "declared_": some(r'(?i)\bDeclare\s+(?:Sub|Function)\s+\w+\s+Lib\s+"([^"]+)"', "DECLARE"), "proc_": some(r'(?i)CommandText\s*=\s*"([\w.]+)"', "COMMANDTEXT"),
        "sql": F.upper(some(r'"([^"]*\b(?:[Ss][Ee][Ll][Ee][Cc][Tt]|[Ii][Nn][Ss][Ee][Rr][Tt]|[Uu][Pp][Dd][Aa][Tt][Ee]|[Dd][Ee][Ll][Ee][Tt][Ee])\b[^"]*)"', "SELECT", "INSERT", "UPDATE", "DELETE")),
        "opened_": some(r'(?i)\bOpen\s+"([^"]+)"\s+For\s+\w+', "OPEN"), "mode": F.upper(some(r'(?i)\bOpen\s+"[^"]+"\s+For\s+(\w+)', "OPEN")), "listed_": some(r'(?i)\bDir\$?\(\s*"([^"]+)"', "DIR"),
        "handler_": some(r"(?i)\bWithEvents\s+\w+\s+As\s+(?:New\s+)?([\w.]+)", "WITHEVENTS"), "implements_": some(r"(?i)^\s*Implements\s+([\w.]+)", "IMPLEMENTS"), "made_": some(r"(?i)\b(?:New|As)\s+(cls\w+|\w+Class)\b", "CLS", "CLASS"),
        "timer": F.contains("up", F.lit("TIMER")) & F.col("code").rlike(r"(?i)\bTimer\w*_Timer\b"),
    })
    table = lambda p: F.when(F.length("sql") > 0, F.regexp_extract("sql", p, 1))
    code = code.withColumns({
        "mname": F.when(project, F.upper(F.regexp_replace(F.when(F.contains("code", F.lit(";")), F.col("before")).otherwise(found("member_")), r"\.[^.]*$", ""))), "ocx": F.upper(found("ocx_")), "lib": F.upper(F.coalesce(found("lib_"), found("declared_"))), "proc": F.upper(found("proc_")),
        "read_": table(r"\b(?<!DELETE )FROM\s+([A-Z_][\w.]*)"), "wrote_": table(r"\bINSERT\s+INTO\s+([A-Z_][\w.]*)"), "upd_": table(r"\b(?:UPDATE|DELETE\s+FROM)\s+([A-Z_][\w.]*)"),
        "opened": dataset_name(found("opened_")), "listed": dataset_name(found("listed_")), "handler": F.upper(found("handler_")), "implements": F.upper(found("implements_")), "made": F.upper(found("made_")),
    }).withColumns({"read": found("read_"), "wrote": found("wrote_"), "upd": found("upd_")})
    member, mkind, mname, ocx, ctype, cname, event, lib, proc, read, wrote, upd, opened, mode, listed, handler, implements, made = (F.col(c) for c in "member_ mkind mname ocx ctype cname event lib proc read wrote upd opened mode listed handler implements made".split())
    is_control = (F.length("code") > 0) & (F.length(cname) > 0) & ~ctype.isin("FORM", "MDIFORM", *HOLDERS)
    routine = F.when(F.length("starts") > 0, F.col("starts"))
    # The arrays are columns too, so that generated code makes them; a filter over the expressions is interpreted.
    ents = F.array(
        F.when((F.col("unit") == "screen") & ocx.isNotNull(), entity("component", ocx, 0.95)), F.when((F.col("unit") == "screen") & is_control, entity("control", cname, 1.0, F.col("name"), F.lit("screen"), ctype)),
        F.when(routine.isNotNull(), entity("subroutine", routine, 0.9, F.col("name"), F.col("unit"))), F.when(lib.isNotNull(), entity("component", lib, 0.9)), F.when(proc.isNotNull() & ~F.coalesce(F.contains(proc, F.lit(" ")), F.lit(False)), entity("procedure", proc, 0.82)),
        F.when(read.isNotNull(), entity("table", read, 0.76)), F.when(wrote.isNotNull(), entity("table", wrote, 0.76)), F.when(upd.isNotNull(), entity("table", upd, 0.76)), F.when(opened.isNotNull(), entity("dataset", opened, 0.78)), F.when(listed.isNotNull(), entity("dataset", listed, 0.72)),
    )
    rels = F.array(
        F.when((F.col("unit") == "project") & (F.length(member) > 0), F.struct(F.lit("CONTAINS").alias("rel"), F.col("name").alias("from"), mname.alias("to"), F.lit("project").alias("fromType"), F.when(mkind == "form", "screen").otherwise(mkind).alias("toType"), F.lit(None).cast("string").alias("fromParent"), F.lit(None).cast("string").alias("toParent"), F.lit(1.0).alias("confidence"))),
        F.when((F.col("unit") == "screen") & ocx.isNotNull(), rel("USES", ocx, "component", 0.95)), F.when(event.isNotNull() & (F.length(event) > 0) & ~event.isin("FORM", "CLASS"), rel("HANDLES", event, "control", 0.85, F.col("starts"), F.lit("subroutine"), F.col("name"), F.col("name"))),
        F.when(handler.isNotNull(), rel("HANDLES_EVENTS", handler, "class", 0.9)), F.when((F.col("unit") == "class") & implements.isNotNull(), rel("IMPLEMENTS", implements, "class", 1.0)), F.when(lib.isNotNull(), rel("USES_DLL", lib, "component", 0.9)), F.when(proc.isNotNull(), rel("CALLS_SP", proc, "procedure", 0.82)),
        F.when(read.isNotNull(), rel("READS", read, "table", 0.76)), F.when(wrote.isNotNull(), rel("WRITES", wrote, "table", 0.76)), F.when(upd.isNotNull(), rel("UPDATES", upd, "table", 0.76)),
        F.when(opened.isNotNull() & (mode == "INPUT"), rel("READS", opened, "dataset", 0.78)), F.when(opened.isNotNull() & mode.isin("OUTPUT", "APPEND"), rel("WRITES", opened, "dataset", 0.78)), F.when(opened.isNotNull() & mode.isin("RANDOM", "BINARY"), rel("UPDATES", opened, "dataset", 0.78)), F.when(listed.isNotNull(), rel("READS", listed, "dataset", 0.72)),
        F.when(F.col("timer"), rel("TRIGGERS", F.col("starts"), "subroutine", 0.7, None, None, None, F.col("name"))), F.when(made.isNotNull() & (made != F.col("name")), rel("DEPENDS_ON", made, "class", 0.7)),
    )
    top = head.select("path", "hash", F.lit(1).alias("line"), F.lit(0).alias("pos"), F.col("unit").alias("type"), "name", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.when(F.col("sure"), 1.0).otherwise(0.8).alias("confidence"), F.lit(None).cast("string").alias("controlType"))
    e = top.unionByName(code.withColumn("ents", ents).select("path", "hash", "line", F.posexplode(F.array_compact("ents"))).select("path", "hash", "line", "pos", "col.*"))
    r = code.withColumn("rels", rels).select(*common, F.posexplode(F.array_compact("rels"))).select("path", "hash", "line", "pos", "col.*")
    finish = lambda d: d.withColumn("file", F.col("path")).withColumn("fileHash", F.col("hash")).withColumn("extractor", F.lit("vb6")).withColumn("ordinal", F.col("line") * F.lit(32) + F.col("pos").cast("bigint"))
    return records(finish(e), finish(r), lines.sparkSession)
