"""Programs: calls, copybooks, data access, conditions and embedded SQL of fixed-format source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...functions.storage import cut
from ...sources.files import fixed_columns
from . import records

NAME = r"([A-Z][A-Z0-9@#$-]{1,29})"
PARAGRAPH = r"((?=[A-Z0-9-]*[A-Z])[A-Z0-9][A-Z0-9@#$-]{1,29})"  # may begin with a number
# Words that are no names, in COBOL and in SQL. VARYING and UNTIL belong to inline PERFORM.
RESERVED = tuple(
    "ACCEPT ADD ADVANCING ALL ALTER AND ARE AT BY CALL CANCEL CLOSE COMPUTE COPY DATA DISPLAY DIVIDE ELSE END EQUAL EVALUATE EXIT FROM GIVING GO GOBACK IF IN INTO IS LESS MOVE MULTIPLY NOT OF ON OPEN OR PERFORM READ RETURN REWRITE SEARCH SECTION SELECT SET SORT STOP STRING SUBTRACT THEN THRU TO UNSTRING USING WHEN WITH WRITE ZEROS ZERO UNTIL VARYING TIMES".split()
)
SQL_RESERVED = tuple(
    "SELECT FROM WHERE AND OR NOT IN EXISTS GROUP ORDER BY HAVING UNION ALL DISTINCT AS ON JOIN LEFT RIGHT INNER OUTER FULL CROSS SET VALUES INTO WITH CASE WHEN THEN ELSE END NULL IS BETWEEN LIKE CAST COALESCE DECODE INSERT UPDATE DELETE CREATE TABLE VIEW INDEX CURSOR DECLARE FETCH OPEN CLOSE EXEC SQL END-EXEC INCLUDE WHENEVER SQLERROR CONTINUE STOP SQLCODE SQLSTATE SQLCA USING RETURNING OUTPUT".split()
)
HEADER = r"(?i)\b(OBJETIVO|FUN[CÇ][AÃ]O|DESCRI[CÇ][AÃ]O|FINALIDADE)\b\s*[:=-]?\s*(\S.*)$"


def state(lines: DataFrame) -> DataFrame:
    """Lines with their indicator, upper-case code, program, SQL block and whether the procedure division has begun."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = lines.filter(F.length("code") >= 7).withColumn("ind", fixed_columns(F.col("code"))[0]).withColumn("comment", F.col("ind").isin("*", "/", "D"))
    x = x.withColumn("up", F.when(~F.col("comment"), F.upper(F.trim(fixed_columns(F.col("code"))[1]))).otherwise("")).withColumn("note", F.when(F.col("comment"), F.substring("code", 8, 200)))
    x = x.withColumn("opens", F.startswith("up", F.lit("EXEC SQL"))).withColumn("closes", F.contains("up", F.lit("END-EXEC")))
    x = x.withColumn("sql_no", F.sum(F.col("opens").cast("int")).over(w)).withColumn("ended", F.sum(F.col("closes").cast("int")).over(w) - F.col("closes").cast("int"))
    x = x.withColumn("in_sql", ~F.col("comment") & (F.col("sql_no") > F.col("ended")))
    pid = F.regexp_extract("up", r"^PROGRAM-ID\s*\.\s*([A-Z0-9@#$-]+)", 1)
    x = x.withColumn("declares", F.when(~F.col("in_sql") & (F.length(pid) > 0), pid)).withColumn("program", F.last("declares", True).over(w))
    return x.withColumn("in_procedure", F.max(F.startswith("up", F.lit("PROCEDURE DIVISION")).cast("int")).over(w) == 1)


def some(pattern: str, *words: str, group: int = 1) -> Column:
    """What a pattern finds in the code area, "" for nothing; it is tried only on lines that hold one of the words, as each match does."""
    return F.when(reduce(lambda a, b: a | b, [F.contains("up", F.lit(w)) for w in words]), F.regexp_extract("up", pattern, group)).otherwise("")


def named(c: str, reserved: tuple[str, ...] = RESERVED) -> Column:
    """A column of some(); null if it is empty or a reserved word."""
    return F.when((F.length(c) > 0) & ~F.col(c).isin(*reserved), F.col(c))


def edge(rel, to: Column, kind, confidence, frm: Column | None = None, from_type: str = "program", dynamic: bool = False) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(rel).alias("rel"), (frm if frm is not None else F.col("program")).alias("from"), to.alias("to"), F.lit(from_type).alias("fromType"), lit(kind).alias("toType"), lit(confidence).cast("double").alias("confidence"), F.lit(dynamic).alias("dynamic"))


def line_edges(x: DataFrame) -> DataFrame:
    """Edges of the code lines: the first of call, copy and perform ends a line; the others may all hold. NAME - text in a comment after the program's name is a call with little confidence."""
    # Each pattern is a column of its own, evaluated once a line; the edges only refer to these.
    code = x.filter(F.col("program").isNotNull() & (F.col("comment") | (~F.col("in_sql") & F.col("declares").isNull() & ~F.startswith("up", F.lit("PROCEDURE DIVISION")))))
    code = code.select("path", "hash", "line", "program", "up", "comment", "note").withColumns({
        "noted": F.when(F.col("comment"), F.regexp_extract(F.upper("note"), r"^\s{0,6}([A-Z][A-Z0-9@#$]{2,7})\s+-\s+\S", 1)).otherwise(""),
        "call": some(r"\bCALL\s+['\"]([A-Z0-9@#$-]+)['\"]", "CALL"), "var_": some(r"\bCALL\s+" + NAME + r"\b", "CALL"), "copy": some(r"\bCOPY\s+([A-Z0-9@#$-]+)", "COPY"),
        "perform_": some(r"\bPERFORM\s+" + PARAGRAPH, "PERFORM"), "thru_": some(r"\bPERFORM\s+[A-Z0-9][A-Z0-9@#$-]{1,29}\s+THRU\s+" + PARAGRAPH, "THRU"),
        "a_": some(r"\bMOVE\s+([A-Z][A-Z0-9@#$-]{2,29})\s+TO\s+[A-Z]", "MOVE"), "b_": some(r"\bMOVE\s+[A-Z][A-Z0-9@#$-]{2,29}\s+TO\s+([A-Z][A-Z0-9@#$-]{2,29})\b", "MOVE"),
        "verb": some(r"\b(READ|WRITE|REWRITE)\s+[A-Z]", "READ", "WRITE"), "data_": some(r"\b(?:READ|WRITE|REWRITE)\s+" + NAME + r"\b", "READ", "WRITE"),
        "mode": some(r"\bOPEN\s+(INPUT|OUTPUT|I-O|EXTEND)\s", "OPEN"), "opened_": some(r"\bOPEN\s+(?:INPUT|OUTPUT|I-O|EXTEND)\s+" + NAME + r"\b", "OPEN"),
        "tested_": some(r"\bIF\s+" + NAME + r"\b", "IF"), "routed_": some(r"\bEVALUATE\s+" + NAME + r"\b", "EVALUATE"), "point": F.col("up").rlike(r"\b(COMMIT|SYNCPOINT|CHECKPOINT)\b"),
    }).withColumns({"var": named("var_", SQL_RESERVED)} | {c: named(f"{c}_") for c in ("perform", "thru", "a", "b", "data", "opened", "tested", "routed")})
    call, var, copy, perform, thru, a, b, verb, data, mode, opened, tested, routed = (F.col(c) for c in "call var copy perform thru a b verb data mode opened tested routed".split())
    pick = lambda test, *e: F.when(test, F.array(*e))
    rest = F.array(
            F.when(a.isNotNull() & b.isNotNull(), edge("TRANSFORMS", b, "field", 0.7, a, "field")),
            F.when(data.isNotNull(), edge(F.when(verb == "READ", "READS").when(verb == "WRITE", "WRITES").otherwise("UPDATES"), data, "dataset", 0.82)),
            F.when(opened.isNotNull(), edge(F.when(mode == "INPUT", "READS").when(mode == "OUTPUT", "WRITES").otherwise("UPDATES"), opened, "dataset", 0.72)),
            F.when(tested.isNotNull(), edge("VALIDATES", tested, "field", 0.72)),
            F.when(routed.isNotNull(), edge("ROUTES_TO", routed, "field", 0.7)),
            F.when(F.col("point"), edge("CHECKPOINTS", F.lit("CHECKPOINT"), "procedure", 0.68)),
    )
    found = (
        pick(F.col("comment"), F.when(named("noted").isNotNull(), edge("CALLS", F.col("noted"), "program", 0.4)))
        .when(F.length(call) > 0, F.array( edge("CALLS", call, "program", 1.0)))
        .when(var.isNotNull(), F.array(edge("CALL-DYNAMIC", var, "program", 0.6, dynamic=True)))
        .when(F.length(copy) > 0, F.array(edge("INCLUDES", copy, "copybook", 1.0)))
        .when(perform.isNotNull(), F.array(edge("PERFORMS", perform, "paragraph", 0.85), F.when(thru.isNotNull(), edge("PERFORMS", thru, "paragraph", 0.85))))
        .otherwise(rest)
    )
    return code.withColumn("found", found).select("path", "hash", "line", "program", F.posexplode(F.array_compact("found"))).select("path", "hash", "line", F.col("program").alias("context"), "pos", "col.*")


def sql_blocks(x: DataFrame) -> DataFrame:
    """(path, hash, line, program, sql): embedded statements, lines joined; one that begins and ends on a line is whole."""
    s = x.filter("in_sql").groupBy("path", "hash", "sql_no").agg(F.min("line").alias("line"), F.max("program").alias("program"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "up"))), lambda z: z["up"]), " ").alias("sql"), F.max("closes").alias("closed"))
    return s.filter("closed and program is not null")


TABLE = r"([A-Z][A-Z0-9_#@$.]{0,28})"


def sql_edges(s: DataFrame) -> DataFrame:
    kinds = ((r"\bFROM\s+", "READS"), (r"\bINTO\s+", "WRITES"), (r"\bUPDATE\s+", "UPDATES"))

    def tagged(pattern: str, rel: str) -> Column:
        return F.transform(F.regexp_extract_all("sql", F.lit(pattern + TABLE), 1), lambda t: F.struct(F.lit(rel).alias("rel"), t.alias("to")))

    found = F.flatten(F.array(*[tagged(p, r) for p, r in kinds]))
    out = s.select("path", "hash", "line", "program", F.explode(F.array_distinct(found)).alias("x")).select("path", "hash", "line", "program", "x.*").filter(~F.col("to").isin(*SQL_RESERVED))
    return out.select("path", "hash", "line", F.col("program").alias("context"), F.lit(0).alias("pos"), "rel", F.col("program").alias("from"), "to", F.lit("program").alias("fromType"), F.lit("table").alias("toType"), F.lit(0.9).alias("confidence"), F.lit(False).alias("dynamic"))


def sql_columns(s: DataFrame) -> DataFrame:
    """Columns named in a statement, under its first table."""
    tables = F.regexp_extract("sql", r"\b(?:FROM|UPDATE|INSERT\s+INTO)\s+" + TABLE, 1)
    x = s.withColumn("parent", tables).filter(F.length("parent") > 0)
    name = F.regexp_extract(F.trim("piece"), r"([A-Z][A-Z0-9_#$]*)(?:\s*=|\s+AS\b|$)", 1)
    x = x.select("path", "hash", "line", "parent", F.explode(F.split("sql", ",")).alias("piece")).withColumn("name", name)
    return x.filter((F.length("name") >= 2) & ~F.col("name").isin(*SQL_RESERVED)).select("path", "hash", "line", "parent", "name").distinct()


def headers(x: DataFrame) -> DataFrame:
    """(path, program, description, ...): the longest purpose line in comments before the procedure division."""
    h = x.filter(F.col("comment") & ~F.col("in_procedure")).withColumn("n", F.regexp_replace(F.trim("note"), r"^\*+\s*", ""))
    key, body = F.upper(F.regexp_extract("n", HEADER, 1)), F.trim(F.regexp_extract("n", HEADER, 2))
    key = F.when(F.startswith(key, F.lit("FUN")), "FUNCAO").when(F.startswith(key, F.lit("DESCRI")), "DESCRICAO").otherwise(key)
    h = h.withColumn("key", key).withColumn("body", body).filter("length(body) > 0").withColumn("description", F.concat_ws(": ", "key", "body"))
    tags = F.filter(F.array(F.lower("key"), F.when(F.col("body").rlike(r"(?i)\bMENU\b"), "menu"), F.when(F.col("body").rlike(r"(?i)\bRELATORIO\b"), "relatorio")), lambda t: t.isNotNull())
    best = F.max_by(F.struct("description", F.concat_ws(":", "path", "line").alias("ref"), tags.alias("tags")), F.struct(F.length("description"), -F.col("line"))).alias("d")
    return h.groupBy("path").agg(best).select("path", "d.*")


def extract(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    x = state(lines)
    sql = sql_blocks(x)
    edges = line_edges(x).unionByName(sql_edges(sql))
    r = edges.withColumn("file", F.col("path")).withColumn("fileHash", F.col("hash")).withColumn("extractor", F.lit("cobol")).withColumn("ordinal", F.col("line") * F.lit(16) + F.col("pos").cast("bigint"))
    programs = x.filter("declares is not null").join(headers(x), "path", "left")
    e = programs.select(F.lit("program").alias("type"), F.col("declares").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("parentType"), F.lit(1.0).alias("confidence"), "path", "hash", "line", "description", F.when(F.col("description").isNotNull(), "cobol_header").alias("description_source"), F.when(F.col("description").isNotNull(), F.array("ref")).alias("description_evidence"), F.col("tags").alias("semantic_tags"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("description", "string"), ("description_source", "string"), ("description_evidence", "array<string>"), ("semantic_tags", "array<string>"))]
    e = e.unionByName(sql_columns(sql).select(F.lit("column").alias("type"), "name", "parent", F.lit("table").alias("parentType"), F.lit(0.75).alias("confidence"), "path", "hash", "line", *none))
    e = e.withColumn("file", F.col("path")).withColumn("fileHash", F.col("hash")).withColumn("extractor", F.lit("cobol")).withColumn("ordinal", F.col("line").cast("bigint"))
    return records(e, r, lines.sparkSession)


def flow(lines: DataFrame) -> dict[str, DataFrame]:
    """The procedure division: paragraphs (program, name, line), edges (program, from, to, kind, line, confidence) and var_values (program, var, value).

    A paragraph begins in columns 8 to 11. CALL of a variable becomes a CALL of each literal that was moved to it on an earlier line, else stays CALL-DYNAMIC.
    """
    x = state(lines).filter("in_procedure and not comment and not in_sql and program is not null")
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.upper(F.regexp_extract(F.substring("code", 8, 65), r"^([A-Za-z0-9][A-Za-z0-9@#$-]*)(?:\s+[Ss][Ee][Cc][Tt][Ii][Oo][Nn])?\s*\.", 1))
    x = x.withColumn("begins", F.when((F.length(head) > 0) & ~head.isin(*RESERVED) & ~F.contains("up", F.lit("DIVISION")), head)).withColumn("at", F.coalesce(F.last("begins", True).over(w), F.lit("MAIN")))
    paragraphs = x.filter("begins is not null").select("path", "hash", "program", F.col("begins").alias("name"), "line")
    moved, put = r"\bMOVE\s+['\"]([A-Z0-9@#$-]+)['\"]\s+TO\s+" + NAME, r"\bSET\s+" + NAME + r"\s+TO\s+['\"]([A-Z0-9@#$-]+)['\"]"
    x = x.select("path", "hash", "line", "program", "up", "at").withColumns({
        "perform_": some(r"\bPERFORM\s+" + PARAGRAPH, "PERFORM"), "thru_": some(r"\bPERFORM\s+[A-Z0-9][A-Z0-9@#$-]{1,29}\s+THRU\s+" + PARAGRAPH, "THRU"), "jump_": some(r"\bGO\s+TO\s+" + PARAGRAPH, "GO"),
        "lit": some(r"\bCALL\s+['\"]([A-Z0-9@#$-]+)['\"]", "CALL"), "called": some(r"\bCALL\s+" + NAME + r"\b", "CALL"), "moved": some(moved, "MOVE"), "moved_to": some(moved, "MOVE", group=2), "put_to": some(put, "SET"), "put": some(put, "SET", group=2),
        "b": F.when(F.col("up").rlike(r"^(ELSE )?IF\b"), "IF").when(F.col("up").rlike(r"^ELSE\b"), "ELSE").when(F.col("up").rlike(r"^WHEN\b"), "WHEN"),
    }).withColumns({c: named(f"{c}_") for c in ("perform", "thru", "jump")})
    kinds = {"IF": "IF-BRANCH", "ELSE": "ELSE-BRANCH", "WHEN": "EVAL-WHEN"}
    one = lambda test, to, kind, conf: F.when(test, F.struct(to.alias("to"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), F.lit(conf).alias("confidence")))
    # What a line says by itself, in one pass over the lines.
    found = F.array(
        *[one(F.col(c).isNotNull(), F.col(c), kind, 1.0) for c, kind in (("perform", "PERFORM"), ("thru", "PERFORM-THRU"), ("jump", "GO-TO"))],
        one(F.length("lit") > 0, F.col("lit"), "CALL", 1.0),
        one(F.col("b").isNotNull(), F.concat("at", F.lit("#"), "b", F.lit("-"), F.col("line").cast("string")), F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])[F.col("b")], 0.9),
    )
    said = x.withColumn("found", found).select("path", "hash", "program", F.col("at").alias("from"), "line", F.explode(F.array_compact("found")).alias("e")).select("path", "hash", "program", "from", "e.to", "e.kind", "line", "e.confidence")
    # Calls of variables and literals that are moved: the few lines that meet each other are written once.
    v = F.when(F.length("moved") > 0, F.struct(F.col("moved_to").alias("var"), F.col("moved").alias("value"))).when(F.length("put") > 0, F.struct(F.col("put_to").alias("var"), F.col("put").alias("value")))
    few = cut(x.withColumn("v", v).withColumn("var", F.when((F.length("lit") == 0) & (F.length("called") > 0), F.col("called"))).filter("v is not null or var is not null").select("path", "hash", "program", "at", "line", "var", "v"))
    values, dyn = few.filter("v is not null").select("path", "program", "line", "v.var", "v.value"), few.filter("var is not null").drop("v")
    step = lambda d, to, kind, conf: d.select("path", "hash", "program", F.col("at").alias("from"), to.alias("to"), F.lit(kind).alias("kind"), "line", F.lit(conf).alias("confidence"))
    met = dyn.join(values.select("path", "var", "value", F.col("line").alias("def")), ["path", "var"], "left").withColumn("value", F.when(F.col("def") < F.col("line"), F.col("value")))
    known = met.filter("value is not null").select("path", "hash", "program", "at", "line", "value").distinct()
    rest = dyn.join(known.select("path", "line").distinct(), ["path", "line"], "left_anti")
    edges = said.unionByName(step(known, F.col("value"), "CALL", 0.9)).unionByName(step(rest, F.col("var"), "CALL-DYNAMIC", 0.6))
    return {"paragraphs": paragraphs, "edges": edges, "var_values": values.select("program", "var", "value").distinct()}


def flow_records(f: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Raw records of a flow: paragraphs in their program, performs and jumps among paragraphs that exist, calls from paragraphs."""
    p = f["paragraphs"].select("path", "hash", "program", "name", "line")
    e = p.select(F.lit("paragraph").alias("type"), "name", F.col("program").alias("parent"), F.lit("program").alias("parentType"), F.lit(1.0).alias("confidence"), F.col("path").alias("file"), F.col("hash").alias("fileHash"), "line", F.lit("cobol-flow").alias("extractor"), F.col("line").cast("bigint").alias("ordinal"))
    names = p.select("program", F.col("name").alias("to")).distinct()
    jump = f["edges"].filter(F.col("kind").isin("PERFORM", "PERFORM-THRU", "GO-TO")).join(names, ["program", "to"], "left_semi")
    common = [F.col("path").alias("file"), F.col("hash").alias("fileHash"), "line", "confidence", F.lit("cobol-flow").alias("extractor"), F.col("line").cast("bigint").alias("ordinal")]
    r = (
        p.select(F.lit("CONTAINS").alias("rel"), F.col("program").alias("from"), F.col("name").alias("to"), F.lit("program").alias("fromType"), F.lit("paragraph").alias("toType"), F.lit(None).cast("string").alias("fromParent"), F.col("program").alias("toParent"), F.col("path").alias("file"), F.col("hash").alias("fileHash"), "line", F.lit(1.0).alias("confidence"), F.lit("cobol-flow").alias("extractor"), F.col("line").cast("bigint").alias("ordinal"))
        .unionByName(jump.select(F.when(F.col("kind") == "GO-TO", "GO-TO").otherwise("PERFORMS").alias("rel"), "from", "to", F.lit("paragraph").alias("fromType"), F.lit("paragraph").alias("toType"), F.col("program").alias("fromParent"), F.col("program").alias("toParent"), *common))
        .unionByName(f["edges"].filter("kind = 'CALL'").select(F.lit("CALLS").alias("rel"), "from", "to", F.lit("paragraph").alias("fromType"), F.lit("program").alias("toType"), F.col("program").alias("fromParent"), F.lit(None).cast("string").alias("toParent"), *common))
    )
    return records(e, r, p.sparkSession)
