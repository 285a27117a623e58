"""Queries over source files made of the tables' rows: extraction, classification, increments, and dossiers of what is found, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.storage import cut
from ..operators import catalog, changes, coverage, dossier, export, flows, modernize, search
from ..operators.extract import cobol, copybook, jcl, messaging, sql, target, using, vb6
from ..sources import files
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, oracle
        return f

    return keep


def say(*parts) -> Column:
    """Text of literals and columns; a part in braces is a column."""
    return F.concat(*[F.col(p[1:-1]).cast("string") if p.startswith("{") else F.lit(p) for p in parts])


def by_flag(read: Column, write: Column, other: Column) -> Column:
    return F.when(F.col("l_returnflag") == "R", read).when(F.col("l_returnflag") == "A", write).otherwise(other)


def source(spark: SparkSession, sf: str, ext: str, head: list[Column], body: Column) -> DataFrame:
    """A file for each supplier (path, hash, name, line, code): the head, then a line for each of its line items, numbered by order and line."""
    base = say("/src/F", "{s_suppkey}", ext)
    s = T.table(spark, sf, "supplier").select("s_suppkey", base.alias("path"))
    top = s.select("s_suppkey", "path", F.posexplode(F.array(*head))).select("path", (F.col("pos") + 1).alias("line"), F.col("col").alias("code"))
    li = T.table(spark, sf, "lineitem").withColumn("s_suppkey", F.col("l_suppkey"))
    rest = li.join(s, "s_suppkey").select("path", (F.lit(100) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("line"), body.alias("code"))
    return top.union(rest).select("path", F.substring(F.md5("path"), 1, 12).alias("hash"), F.element_at(F.split("path", "/"), -1).alias("name"), "line", "code")


LINE = "(100 + l_orderkey * 8 + l_linenumber)::INT"
KINDS = "CASE l_returnflag WHEN 'R' THEN {} WHEN 'A' THEN {} ELSE {} END"


def program() -> list[Column]:
    return [say("       PROGRAM-ID. P", "{s_suppkey}", "."), F.lit("       PROCEDURE DIVISION.")]


# --- extraction ----------------------------------------------------------------------------------


@query(f"""SELECT {KINDS.format("'CALLS'", "'READS'", "'INCLUDES'")} AS rel, 'P' || l_suppkey AS "from", {KINDS.format("'S'", "'D'", "'C'")} || l_partkey AS "to", {KINDS.format("'program'", "'dataset'", "'copybook'")} AS kind, {LINE} AS line, {KINDS.format("1.0", "0.82", "1.0")}::DOUBLE AS confidence FROM lineitem""")
def x_cobol(spark, sf):
    body = by_flag(say("           CALL 'S", "{l_partkey}", "'."), say("           READ D", "{l_partkey}"), say("           COPY C", "{l_partkey}", "."))
    return cobol.extract(source(spark, sf, ".cbl", program(), body))[1].select("rel", "from", "to", F.col("toType").alias("kind"), "line", "confidence")


@query(f"""SELECT {KINDS.format("'READS'", "'UPDATES'", "'WRITES'")} AS rel, 'P' || l_suppkey AS "from", 'T' || l_partkey AS "to", {LINE} AS line, 0.9::DOUBLE AS confidence FROM lineitem
UNION ALL SELECT 'UPDATES', 'P' || l_suppkey, 'T' || l_partkey, {LINE}, 0.9 FROM lineitem WHERE false""")
def x_cobol_sql(spark, sf):
    body = by_flag(say("           EXEC SQL SELECT A1 INTO :H FROM T", "{l_partkey}", " END-EXEC."), say("           EXEC SQL UPDATE T", "{l_partkey}", " SET QTY = 1 END-EXEC."), say("           EXEC SQL INSERT INTO T", "{l_partkey}", " VALUES (1) END-EXEC."))
    return cobol.extract(source(spark, sf, ".cbl", program(), body))[1].select("rel", "from", "to", "line", "confidence")


@query("""SELECT 'P' || s_suppkey AS name, 'OBJETIVO: ' || CASE WHEN s_suppkey % 2 = 0 THEN 'MENU OF ' ELSE 'WORK OF ' END || upper(s_name) AS description, CASE WHEN s_suppkey % 2 = 0 THEN 'objetivo,menu' ELSE 'objetivo' END AS tags FROM supplier""")
def x_cobol_header(spark, sf):
    s = T.table(spark, sf, "supplier")
    aim = F.concat(F.lit("      * OBJETIVO: "), F.when(F.col("s_suppkey") % 2 == 0, "MENU OF ").otherwise("WORK OF "), F.upper("s_name"))
    lines = s.select(say("/src/F", "{s_suppkey}", ".cbl").alias("path"), F.posexplode(F.array(F.lit("      * OBJETIVO: X"), aim, *program()))).select("path", F.lit("h").alias("hash"), "path", (F.col("pos") + 1).alias("line"), F.col("col").alias("code"))
    return cobol.extract(lines.toDF("path", "hash", "name", "line", "code"))[0].filter("type = 'program'").select("name", "description", F.array_join("semantic_tags", ",").alias("tags"))


@query(f"""SELECT 'P' || l_suppkey AS program, 'START' AS "from", {KINDS.format("'X' || l_partkey", "'Y' || l_partkey", "'Z' || l_partkey")} AS "to", {KINDS.format("'PERFORM'", "'GO-TO'", "'CALL'")} AS kind, {LINE} AS line FROM lineitem""")
def x_cobol_flow(spark, sf):
    body = by_flag(say("           PERFORM X", "{l_partkey}"), say("           GO TO Y", "{l_partkey}", "."), say("           CALL 'Z", "{l_partkey}", "'"))
    return cobol.flow(source(spark, sf, ".cbl", [*program(), F.lit("       START.")], body))["edges"].select("program", "from", "to", "kind", "line")


@query(f"""SELECT 'P' || l_suppkey AS program, 'S' || l_partkey AS callee, f AS field, CASE f WHEN 'REC-A' THEN 'BOOKA' WHEN 'REC-B' THEN 'BOOKA' END AS copybook, CASE f WHEN 'REC-A' THEN 1 WHEN 'REC-B' THEN 5 END::INT AS level, CASE f WHEN 'REC-B' THEN '9(4)' END AS pic, {LINE} AS line
FROM lineitem, unnest(['REC-A', 'REC-B', 'REC-X']) t(f) WHERE l_returnflag = 'R' OR (l_returnflag = 'A' AND f = 'REC-A')""")
def x_using(spark, sf):
    head = [say("       PROGRAM-ID. P", "{s_suppkey}", "."), F.lit("           COPY BOOKA."), F.lit("       01  REC-A."), F.lit("           05  REC-B PIC 9(4)."), F.lit("       PROCEDURE DIVISION.")]
    body = by_flag(say("           CALL 'S", "{l_partkey}", "' USING REC-A BY CONTENT REC-B REC-X"), say("           CALL 'S", "{l_partkey}", "' USING REC-A RETURNING REC-X END-CALL"), F.lit("           MOVE REC-A TO REC-B"))
    return using.uses(source(spark, sf, ".cbl", head, body)).select("program", "callee", "field", "copybook", "level", "pic", "line")


@query("""SELECT 'F' || p_partkey AS name, CASE WHEN p_size > 25 THEN 'REC' ELSE 'B' || substr(p_brand, 7) END AS parent, CASE WHEN p_size > 25 THEN 'field' ELSE 'copybook' END AS parent_type, CASE WHEN p_size > 25 THEN 5 ELSE 1 END::INT AS level, 'X(' || p_size || ')' AS pic, CASE WHEN p_size % 2 = 0 THEN p_size END::INT AS occurs FROM part
UNION ALL SELECT DISTINCT 'REC', 'B' || substr(p_brand, 7), 'copybook', 1, NULL, NULL::INT FROM part""")
def x_copybook(spark, sf):
    p = T.table(spark, sf, "part").withColumn("path", F.concat(F.lit("/src/B"), F.substring("p_brand", 7, 9), F.lit(".cpy")))
    lead = F.when(F.col("p_size") > 25, "           05  F").otherwise("       01  F")
    body = F.concat(lead, F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, say(" OCCURS ", "{p_size}", " TIMES")).otherwise(""), say(" PIC X(", "{p_size}", ")."))
    place = F.when(F.col("p_size") > 25, F.col("p_partkey") + 10).otherwise(F.col("p_partkey") + (1 << 30)).cast("int")  # level 1 after all of level 5
    lines = p.select("path", place.alias("line"), body.alias("code")).union(p.select("path", F.lit(1), F.lit("       01  REC.")).distinct()).select("path", F.lit("h").alias("hash"), F.lit("n").alias("name"), "line", "code")
    e = copybook.extract(lines)[0].filter("type = 'field'")
    return e.select("name", "parent", F.col("parentType").alias("parent_type"), "level", "pic", F.col("occurs.max").alias("occurs"))


ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag, l_shipdate"
JOBS = f"j AS (SELECT * REPLACE (seq AS l_linenumber) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER})::INT AS seq FROM lineitem))"


def jobs(spark, sf, cond: bool = False) -> DataFrame:
    """A job for each order, a step and a data set for each of its lines."""
    li = T.table(spark, sf, "lineitem").withColumn("path", say("/jcl/O", "{l_orderkey}", ".jcl"))
    li = li.withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))))
    test = F.when(F.lit(cond), say(",COND=(", "{q}", ",LT,S1)")).otherwise("")
    step = F.concat(say("//S", "{l_linenumber}", " EXEC PGM=P", "{l_suppkey}"), test)
    dd = F.concat(say("//D1 DD DSN=PART.P", "{l_partkey}", ",DISP="), F.when(F.col("l_returnflag") == "R", "SHR").otherwise("(NEW,CATLG)"))
    rest = li.withColumn("q", F.col("l_quantity").cast("int")).select("path", F.col("l_linenumber").alias("n"), F.posexplode(F.array(step, dd))).select("path", (F.col("n") * 2 + F.col("pos")).cast("int").alias("line"), F.col("col").alias("code"))
    top = li.select("path", say("//J", "{l_orderkey}", " JOB (A)").alias("code")).distinct().select("path", F.lit(1).alias("line"), "code")
    return top.union(rest).select("path", F.lit("h").alias("hash"), F.lit("n").alias("name"), "line", "code")


@query(f"""WITH {JOBS} SELECT 'CONTAINS' AS rel, 'J' || l_orderkey AS "from", 'S' || l_linenumber AS "to", 'J' || l_orderkey AS job, seq, 1.0::DOUBLE AS confidence FROM j UNION ALL SELECT 'EXECUTES', 'S' || l_linenumber, 'P' || l_suppkey, 'J' || l_orderkey, seq, 1.0 FROM j
UNION ALL SELECT CASE WHEN l_returnflag = 'R' THEN 'READS' ELSE 'WRITES' END, 'S' || l_linenumber, 'PART.P' || l_partkey, 'J' || l_orderkey, seq, 0.85 FROM j""")
def x_jcl(spark, sf):
    return jcl.extract(jobs(spark, sf))[1].select("rel", "from", "to", F.coalesce("fromParent", "toParent").alias("job"), "seq", "confidence")


@query(f"""WITH {JOBS} SELECT 'J' || l_orderkey AS job, 'S' || l_linenumber AS step, seq::BIGINT AS seq, 'RC(S1) <= ' || l_quantity::INT AS run_condition FROM j""")
def x_jcl_cond(spark, sf):
    return jcl.conditions(jobs(spark, sf, True)).select("job", "step", F.col("seq").cast("bigint").alias("seq"), "run_condition")


@query(f"""SELECT DISTINCT {KINDS.format("'READS'", "'UPDATES'", "'CALLS_PROC'")} AS rel, 'F' || l_suppkey AS "from", {KINDS.format("'T_'", "'U_'", "'PR_'")} || l_partkey AS "to" FROM lineitem""")
def x_sql_file(spark, sf):
    body = by_flag(say("select a1 from [T_", "{l_partkey}", "]; -- from nothing"), say("UPDATE U_", "{l_partkey}", " SET qty = 1;"), say("CALL PR_", "{l_partkey}", ";"))
    return sql.extract(source(spark, sf, ".sql", [F.lit("/* FROM NOWHERE */")], body))[1].select("rel", "from", "to")


@query("""SELECT 'T' || p_partkey AS parent, c AS name, CASE c WHEN 'ID' THEN 'INTEGER' ELSE 'DECIMAL' END AS type FROM part, unnest(['ID', 'PRICE']) t(c)""")
def sql_definitions(spark, sf):
    p = T.table(spark, sf, "part")
    lines = p.select(say("/d/P", "{p_partkey}", ".ddl").alias("path"), F.lit("h").alias("hash"), F.lit("n").alias("name"), F.lit(1).alias("line"), say("CREATE TABLE T", "{p_partkey}", " (ID INTEGER NOT NULL, PRICE DECIMAL(9,2), PRIMARY KEY (ID));").alias("code"))
    return sql.definitions(lines).select("parent", "name", "type")


@query(f"""SELECT {KINDS.format("'CALLS_SP'", "'USES_DLL'", "'WRITES'")} AS rel, 'FRM' || l_suppkey AS "from", {KINDS.format("'PR_'", "'D'", "'O'")} || l_partkey || {KINDS.format("''", "'.DLL'", "'.TXT'")} AS "to", {LINE} AS line, {KINDS.format("0.82", "0.9", "0.78")}::DOUBLE AS confidence FROM lineitem
UNION ALL SELECT 'USES', 'FRM' || s_suppkey, 'MSCOMCTL.OCX', 2, 0.95 FROM supplier""")
def x_vb6(spark, sf):
    head = [say("Begin VB.Form frm", "{s_suppkey}"), F.lit('Object = "{ABC}#1.0#0"; "MSCOMCTL.OCX"')]
    body = by_flag(say('  c.CommandText = "pr_', "{l_partkey}", '"'), say('Private Declare Function X Lib "d', "{l_partkey}", '.dll" ()'), say('Open "C:\\out\\o', "{l_partkey}", '.txt" For Output As #1'))
    return vb6.extract(source(spark, sf, ".frm", head, body))[1].select("rel", "from", "to", "line", "confidence")


@query("""SELECT DISTINCT 'SENDS' AS rel, 'MSG' || l_suppkey AS "from", 'COMP' || l_partkey AS "to", CASE WHEN l_suppkey % 2 = 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence FROM lineitem""")
def x_messaging(spark, sf):
    head = [say("MENSAGEM: MSG", "{s_suppkey}"), F.when(F.col("s_suppkey") % 2 == 0, "CNAB 240").otherwise("PLAIN")]
    return messaging.extract(source(spark, sf, ".lay", head, say("SENDS COMP", "{l_partkey}")))[1].select("rel", "from", "to", "confidence")


@query("""SELECT 'S' || s_suppkey || 'Controller' AS class, CASE WHEN s_suppkey % 2 = 0 THEN 'GET' ELSE 'POST' END AS method, '/s' || s_suppkey || '/{id}' AS path FROM supplier""")
def x_java_target(spark, sf):
    text = F.concat(say('package a.b;\n@RestController\n@RequestMapping("/s', "{s_suppkey}", '")\npublic class S', "{s_suppkey}", "Controller {\n @"), F.when(F.col("s_suppkey") % 2 == 0, "Get").otherwise("Post"), F.lit('Mapping("/{id}")\n void f() {}\n}\n'))
    return target.java(T.table(spark, sf, "supplier").select(say("/r/S", "{s_suppkey}", ".java").alias("path"), text.alias("text")))[1].select("class", "method", "path")


@query("""SELECT '/r/R' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.bicep' ELSE '.tf' END AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'key_vault' ELSE 'service_bus' END AS type FROM supplier""")
def x_infra_target(spark, sf):
    even = F.col("s_suppkey") % 2 == 0
    df = T.table(spark, sf, "supplier").select(F.concat(say("/r/R", "{s_suppkey}"), F.when(even, ".bicep").otherwise(".tf")).alias("path"), F.when(even, "resource kv 'Microsoft.KeyVault/vaults@2022' = {}").otherwise('resource "azurerm_servicebus_queue" "q" {}').alias("text"))
    return target.infrastructure(df)[0]


# --- files ------------------------------------------------------------------------------------------

TEXTS = (("cobol", "       PROGRAM-ID. A."), ("copybook", "       01  REC.\n       05  FLD PIC X."), ("jcl", "//A JOB (X)"), ("sql", "select 1 from t"), ("vb6", "VERSION 5.00"), ("messaging", "layout CNAB"), (None, "nothing to see"))


@query("SELECT s_suppkey, " + "CASE s_suppkey % 7 " + " ".join(f"WHEN {i} THEN {repr(d) if d else 'NULL'}" for i, (d, _) in enumerate(TEXTS)) + " END AS dialect FROM supplier")
def classify_content(spark, sf):
    text = F.lit(None).cast("string")
    for i, (_, t) in enumerate(TEXTS):
        text = F.when(F.col("s_suppkey") % 7 == i, t).otherwise(text)
    return T.table(spark, sf, "supplier").select("s_suppkey", files.by_content(text.cast("binary")).alias("dialect"))


@query("SELECT s_suppkey, CASE s_suppkey % 13 " + " ".join(f"WHEN {i} THEN '{d}/{r}'" for i, (d, r) in enumerate(files.EXTENSIONS.values())) + " ELSE 'sql/script' END AS kind FROM supplier")
def classify_ext(spark, sf):
    ext = F.lit(".txt")
    for i, e in enumerate(files.EXTENSIONS):
        ext = F.when(F.col("s_suppkey") % 13 == i, e).otherwise(ext)
    df = T.table(spark, sf, "supplier").select("s_suppkey", ext.alias("ext"), F.lit("SELECT 1").cast("binary").alias("content"))
    return files.classify(df).select("s_suppkey", F.concat_ws("/", "dialect", "role").alias("kind"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'UTF-8' WHEN 1 THEN 'UTF-8-BOM' WHEN 2 THEN 'UTF-16LE' ELSE 'ISO-8859-1' END AS encoding, text FROM documents WHERE text IS NOT NULL""")
def detect_encoding(spark, sf):
    d = T.table(spark, sf, "documents").filter("text is not null")
    k, utf8 = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    head = F.unhex(F.lit("E9"))  # a byte that no UTF-8 text begins with
    content = F.when(k == 0, utf8).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).otherwise(F.concat(head, F.lit("x").cast("binary"), utf8))
    enc = files.encoding(content)
    text = F.when(enc == "ISO-8859-1", F.decode(F.encode(F.substr(files.decoded(content), F.lit(3)), "ISO-8859-1"), "UTF-8")).otherwise(files.decoded(content))
    return d.select("doc_id", enc.alias("encoding"), text.alias("text"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '*' ELSE ' ' END AS indicator, 'MOVE ' || l_partkey AS code FROM lineitem""")
def fixed_columns(spark, sf):
    code = F.concat(F.rpad(F.substring(F.col("l_orderkey").cast("string"), 1, 6), 6, " "), F.when(F.col("l_returnflag") == "R", "*").otherwise(" "), F.rpad(say("MOVE ", "{l_partkey}"), 65, " "), F.lit("IGNORED"))
    ind, area = files.fixed_columns(code)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ind.alias("indicator"), area.alias("code"))


@query("SELECT page_id, url AS resolved FROM pages")
def resolve_alias(spark, sf):
    roots = spark.createDataFrame([("SOURCE_1", "http://"), ("SOURCE_2", "https://")], "alias string, root string")
    return files.resolve_alias(files.sanitize(T.table(spark, sf, "pages").select("page_id", "url"), roots, "url"), roots).select("page_id", "resolved")


SNAPSHOTS = "o AS (SELECT doc_id, substr(sha256(text), 1, 12) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, substr(sha256(CASE WHEN n_chars < 300 THEN text || '!' ELSE text END), 1, 12) AS h FROM documents WHERE doc_id % 10 <> 4)"


def snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two inventories that differ: that is what these operators work on."""
    d, sha = T.table(spark, sf, "documents"), lambda c: files.file_hash(c.cast("binary")).alias("hash")
    changed = F.when(F.col("n_chars") < 300, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return d.filter("doc_id % 10 <> 4").select(F.col("doc_id").alias("path"), sha(changed), F.col("n_chars").alias("size")), d.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), sha(F.col("text")), F.col("n_chars").alias("size"))


@query(f"WITH {SNAPSHOTS} SELECT n.doc_id AS path FROM n LEFT JOIN o ON n.doc_id = o.doc_id AND n.h = o.h WHERE o.h IS NULL")
def incremental_filter(spark, sf):
    return changes.to_process(*snapshots(spark, sf)).select("path")


@query(f"WITH {SNAPSHOTS}, s AS (SELECT DISTINCT n.h FROM n JOIN o ON n.doc_id = o.doc_id AND n.h = o.h) SELECT doc_id FROM o WHERE h IN (SELECT h FROM s)")
def incremental_preserved(spark, sf):
    new, old = snapshots(spark, sf)
    return changes.preserved(old.select(F.col("path").alias("doc_id"), F.col("hash").alias("fileHash")), new, old).select("doc_id")


@query(f"WITH {SNAPSHOTS} SELECT coalesce(n.doc_id, o.doc_id) AS path, coalesce(n.h, o.h) AS hash FROM n FULL JOIN o USING (doc_id)")
def upsert(spark, sf):
    new, old = snapshots(spark, sf)
    return changes.upsert(old, new, ["path"]).select("path", "hash")


@query(f"""SELECT '/src/F' || l_suppkey || '.cbl' AS path, {LINE} AS line, CASE l_returnflag WHEN 'R' THEN 'LINK' ELSE 'XCTL' END AS verb, 'S' || l_partkey AS target FROM lineitem WHERE l_returnflag <> 'N'""")
def lib_x_cobol(spark, sf):
    return catalog.transactions(transaction_lines(spark, sf))[0].select("path", "line", "verb", "target")


@query("""SELECT '/src/F' || s_suppkey || '.cbl' AS path, coalesce(bool_or(l_returnflag <> 'N'), false) AS cics, coalesce(bool_or(l_returnflag = 'N'), false) AS db2, false AS ims FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey""")
def lib_x_cobol_flags(spark, sf):
    return catalog.transactions(transaction_lines(spark, sf))[1]


def transaction_lines(spark, sf) -> DataFrame:
    body = by_flag(say("           EXEC CICS LINK PROGRAM('S", "{l_partkey}", "') END-EXEC."), say("           EXEC CICS XCTL PROGRAM ( 'S", "{l_partkey}", "' ) END-EXEC."), F.lit("           EXEC SQL COMMIT END-EXEC."))
    return source(spark, sf, ".cbl", program(), body)


# --- dossiers ----------------------------------------------------------------------------------------

WORLD = """x AS (SELECT s_nationkey AS seed, l_suppkey AS s, l_partkey AS p, CASE l_returnflag WHEN 'R' THEN 'READS' WHEN 'A' THEN 'WRITES' ELSE 'UPDATES' END AS rel, CASE l_suppkey % 3 WHEN 0 THEN 'cobol-mainframe' WHEN 1 THEN 'database' ELSE 'batch-mainframe' END AS fp,
  CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'dataset' END AS tt, CASE WHEN p_size % 2 = 0 THEN 'database' ELSE 'batch-mainframe' END AS tp, round(1 - l_discount * 7, 2) AS c, l_orderkey || ':' || l_linenumber AS ev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
m AS (SELECT seed, rel, s, p, fp, tt, tp, max(c) AS c FROM x GROUP BY ALL), k AS (SELECT *, CASE WHEN fp <> tp THEN 'handoff' WHEN rel = 'READS' THEN 'intake' WHEN rel = 'UPDATES' THEN 'persistence' WHEN rel = 'WRITES' AND tt = 'dataset' THEN 'output' END AS kind FROM m),
h AS (SELECT seed, kind, count(DISTINCT s) AS n_processing, count(DISTINCT p) FILTER (rel = 'READS') AS n_inputs, count(DISTINCT p) FILTER (rel <> 'READS' AND tt = 'table') AS n_persistence, count(DISTINCT p) FILTER (rel <> 'READS' AND tt = 'dataset') AS n_outputs, round(avg(c), 2) AS confidence, list_sort(list_distinct(list(fp))) AS platforms FROM k WHERE kind IS NOT NULL GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY list_position(['intake', 'validation', 'handoff', 'persistence', 'output'], kind))::INT AS seq, count(*) OVER (PARTITION BY seed) AS n_phases FROM h),
f AS (SELECT seed, kind, seq, n_phases, unnest([{f: 'objective', t: 1, c: true}, {f: 'trigger', t: 1, c: false}, {f: 'actors', t: 1, c: true}, {f: 'processing', t: n_processing, c: true}, {f: 'inputs', t: n_inputs, c: kind = 'intake' OR seq = 1}, {f: 'persistence', t: n_persistence, c: kind = 'persistence' OR n_persistence > 0},
  {f: 'outputs', t: n_outputs, c: kind = 'output' OR seq = n_phases OR n_outputs > 0}, {f: 'decisions', t: 0, c: false}, {f: 'contingencies', t: 0, c: seq = n_phases}]) AS z FROM q),
cl AS (SELECT seed, kind AS phase, seq, n_phases, z.f AS field, CASE WHEN z.t > 0 THEN 'fact' ELSE 'hypothesis' END AS type, z.c AS critical FROM f)"""


def world(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Entities of three kinds of programs and two of data, and their relations under the nation (seed) of the program."""
    s, p = T.table(spark, sf, "supplier"), T.table(spark, sf, "part")
    k = F.col("s_suppkey") % 3
    entities = s.select(T.key("supplier", "s_suppkey").alias("id"), F.when(k == 0, "program").when(k == 1, "procedure").otherwise("step").alias("type"), F.concat(F.lit("SUPP"), F.col("s_suppkey").cast("string")).alias("label")).union(
        p.select(T.key("part", "p_partkey"), F.when(F.col("p_size") % 2 == 0, "table").otherwise("dataset"), F.concat(F.lit("PART"), F.col("p_partkey").cast("string")))
    )
    r = T.accesses(spark, sf).groupBy("rel", "from_id", "to_id").agg(F.max("confidence").alias("confidence"), F.collect_set("evidence").alias("evidence"))
    return entities, r.join(s.select(T.key("supplier", "s_suppkey").alias("from_id"), F.col("s_nationkey").alias("seed")), "from_id")


def phases(spark, sf) -> DataFrame:
    e, r = world(spark, sf)
    return dossier.phases(r, e)


def sizes() -> list[Column]:
    return [F.size(c).cast("bigint").alias(f"n_{c}") for c in ("processing", "inputs", "persistence", "outputs")]


@query(f"WITH {WORLD} SELECT seed, kind, seq, n_processing, n_inputs, n_persistence, n_outputs, confidence FROM q")
def build_phases(spark, sf):
    return phases(spark, sf).select("seed", "kind", "seq", *sizes(), "confidence")


@query(f"WITH {WORLD} SELECT seed, phase, seq, field, type, critical FROM cl")
def phase_claims(spark, sf):
    return dossier.claims(phases(spark, sf)).select("seed", "phase", "seq", "field", "type", "critical")


@query(f"WITH {WORLD} SELECT seed, kind, n_processing, n_inputs, n_persistence, n_outputs, 0::BIGINT AS n_decisions FROM q")
def facts_only(spark, sf):
    p = cut(phases(spark, sf))  # read twice
    return dossier.facts_only(p, dossier.claims(p)).select("seed", "kind", *sizes(), F.size("decisions").cast("bigint").alias("n_decisions"))


@query(f"WITH {WORLD} SELECT seed, phase, coalesce(string_agg(field, ',' ORDER BY field) FILTER (critical AND type <> 'fact'), '') AS missing FROM cl GROUP BY ALL")
def missing_fields(spark, sf):
    return dossier.missing_fields(c := phases(spark, sf), dossier.claims(c)).select("seed", "phase", F.array_join("missing", ",").alias("missing"))


@query(f"WITH {WORLD} SELECT seed, phase, count(*) FILTER (type = 'fact') || '/' || count(*) FILTER (critical) AS status FROM cl GROUP BY ALL")
def traceability(spark, sf):
    p = phases(spark, sf)
    return dossier.traceability(p, dossier.claims(p))


@query(f"WITH {WORLD}, w AS (SELECT seed, kind AS from_kind, lead(kind) OVER y AS to_kind, platforms, lead(platforms) OVER y AS nxt FROM q WINDOW y AS (PARTITION BY seed ORDER BY seq)) SELECT seed, from_kind, to_kind FROM w WHERE to_kind IS NOT NULL AND platforms <> nxt")
def handoffs(spark, sf):
    return dossier.handoffs(phases(spark, sf))


@query(f"""WITH {WORLD}, w AS (SELECT seed, kind, lead(kind) OVER y AS to_kind, platforms, lead(platforms) OVER y AS nxt FROM q WINDOW y AS (PARTITION BY seed ORDER BY seq)), g AS (SELECT seed, max((to_kind IS NOT NULL AND platforms <> nxt)::INT) AS handoffs, count(*) AS n FROM w GROUP BY 1),
a AS (SELECT seed, max((field = 'processing' AND type = 'fact')::INT) AS orchestration, max((field = 'persistence' AND type = 'fact')::INT) AS persistence, max((field = 'outputs' AND type = 'fact')::INT) AS outputs, min((type = 'fact' OR NOT critical)::INT) AS citations FROM cl GROUP BY 1),
t AS (SELECT seed, floor(100 * (1 + (n >= 3 AND citations = 1)::INT + orchestration + handoffs + persistence + outputs + (n >= 2)::INT + citations) / 11.0 + 0.5)::BIGINT AS total_pct FROM a JOIN g USING (seed)) SELECT seed, total_pct, CASE WHEN total_pct >= 55 THEN 'partial' ELSE 'draft' END AS status, false AS complete FROM t""")
def quality_gate(spark, sf):
    p = phases(spark, sf)
    c = dossier.claims(p)
    seeds = p.select("seed").distinct().withColumn("resolved", F.lit(True))
    traces = p.select("seed", F.lit(0).alias("hop"))
    score = dossier.completeness(dossier.criteria(seeds, p, c, traces))
    return dossier.gate(score, dossier.missing_fields(p, c), p).join(score.select("seed", "total_pct"), "seed").select("seed", "total_pct", "status", "complete")


@query(f"""WITH {WORLD}, w AS (SELECT seed, kind, lead(kind) OVER y AS to_kind, platforms, lead(platforms) OVER y AS nxt FROM q WINDOW y AS (PARTITION BY seed ORDER BY seq)), g AS (SELECT seed, max((to_kind IS NOT NULL AND platforms <> nxt)::INT) AS handoffs, count(*) AS n FROM w GROUP BY 1),
a AS (SELECT seed, max((field = 'processing' AND type = 'fact')::INT) AS orchestration, max((field = 'persistence' AND type = 'fact')::INT) AS persistence, max((field = 'outputs' AND type = 'fact')::INT) AS outputs, min((type = 'fact' OR NOT critical)::INT) AS citations FROM cl GROUP BY 1), z AS (SELECT seed, unnest([{{'id': 'phases', 'ok': n >= 3 AND citations = 1}}, {{'id': 'orchestration', 'ok': orchestration = 1}}, {{'id': 'handoffs', 'ok': handoffs = 1}}, {{'id': 'persistence', 'ok': persistence = 1}}, {{'id': 'outputs', 'ok': outputs = 1}}, {{'id': 'rules', 'ok': false}}, {{'id': 'states', 'ok': n >= 2}}, {{'id': 'errors', 'ok': false}}, {{'id': 'citations', 'ok': citations = 1}}, {{'id': 'reverse_trace', 'ok': false}}]) AS c FROM a JOIN g USING (seed))
SELECT seed, 'gap:' || c.id AS id, CASE WHEN c.id IN ('resolution', 'phases', 'persistence', 'outputs', 'citations') THEN 'high' ELSE 'medium' END AS severity FROM z WHERE NOT c.ok UNION SELECT seed, 'gap:phase:' || phase, 'high' FROM cl WHERE critical AND type <> 'fact'""")
def gap_list(spark, sf):
    p = phases(spark, sf)
    c = dossier.claims(p)
    seeds = p.select("seed").distinct().withColumn("resolved", F.lit(True))
    score = dossier.completeness(dossier.criteria(seeds, p, c, p.select("seed", F.lit(0).alias("hop"))))
    return dossier.gap_list(score, dossier.gate(score, dossier.missing_fields(p, c), p)).select("seed", "id", "severity")


@query(f"WITH {WORLD}, w AS (SELECT p, max((rel <> 'READS')::INT) AS w FROM x GROUP BY 1) SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 2 = 1 THEN 'outbound' WHEN w = 1 THEN 'master' ELSE 'domain' END AS role FROM part LEFT JOIN w ON p = p_partkey UNION ALL SELECT 'supplier:' || s_suppkey, 'control' FROM supplier WHERE s_suppkey % 3 = 1")
def data_model(spark, sf):
    return dossier.data_model(*world(spark, sf)).select("id", "role")


@query(f"WITH {WORLD} SELECT split_part(ev, ':', 1) AS path, split_part(ev, ':', 2)::INT AS line, count(DISTINCT (s, rel, p)) AS n_owners, true AS navigable FROM x GROUP BY 1, 2")
def citations(spark, sf):
    e, r = world(spark, sf)
    none = e.limit(0).select("id", F.array().cast("array<string>").alias("files"), F.lit(0).alias("line"), F.lit("t").alias("extractor"))
    return dossier.citations(none, r.withColumn("extractor", F.lit("t"))).select("path", "line", "n_owners", "navigable")


@query(f"WITH {WORLD}, r AS (SELECT DISTINCT s, rel, p FROM x), one AS (SELECT DISTINCT p FROM r WHERE s = 3), two AS (SELECT DISTINCT s FROM r WHERE p IN (FROM one)) SELECT DISTINCT rel, 'supplier:' || s AS from_id, 'part:' || p AS to_id FROM r WHERE s = 3 OR s IN (FROM two) OR p IN (FROM one)")
def related_relations(spark, sf):
    r = world(spark, sf)[1].select("rel", "from_id", "to_id")
    return dossier.related(spark.createDataFrame([("supplier:3",)], "id string"), r, 2)


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'intake' WHEN value > 90 THEN 'validation' WHEN event_type = 'click' THEN 'handoff' WHEN user_id % 5 = 1 AND value > 50 THEN 'consolidation' WHEN user_id % 5 = 1 THEN 'persistence' WHEN value > 50 THEN 'output' WHEN event_type = 'view' THEN 'output' ELSE 'processing' END AS phase FROM events""")
def phase_classify_step(spark, sf):
    text = F.when(F.col("event_type") == "click", "run tela x").when(F.col("event_type") == "view", "gera x").otherwise("other")
    tables, out = (F.col("user_id") % 5 == 1).cast("int"), (F.col("value") > 50).cast("int")
    phase = dossier.step_phase(text, F.col("user_id") % 5 == 0, F.col("value") > 90, F.lit(0), tables, out)
    return T.table(spark, sf, "events").select("event_id", phase.alias("phase"))


@query("""SELECT p_brand AS seed, 'L' || n AS label, min(p_partkey) AS seq FROM part, unnest([1, 23, 456]) t(n) WHERE contains('XL' || p_partkey || 'Y', 'L' || n) GROUP BY ALL""")
def owner_service(spark, sf):
    p = T.table(spark, sf, "part")
    services = p.select(F.col("p_brand").alias("seed"), F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("name"), F.array(say("xl", "{p_partkey}", "y")).alias("legacy"))
    items = p.select(F.col("p_brand").alias("seed"), F.explode(F.array(*[F.lit(f"L{n}") for n in (1, 23, 456)])).alias("label"))
    return modernize.owner(items, services).select("seed", "label", F.col("name").alias("seq"))


@query("""SELECT 'part:' || p_partkey AS id, CASE WHEN r > 0 AND w > 0 THEN 'shared' WHEN r > 0 THEN 'reference' WHEN w > 0 THEN 'sink' ELSE 'unused' END AS role FROM part LEFT JOIN (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag <> 'R') AS w FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size % 2 = 0""")
def table_roles(spark, sf):
    return flows.table_roles(*world(spark, sf))


@query(f"""WITH {WORLD} SELECT 'supplier:' || s_suppkey AS id, CASE WHEN s_suppkey IN (SELECT s FROM x WHERE rel <> 'READS') THEN 'persistence' ELSE 'processing' END AS role FROM supplier WHERE s_suppkey % 3 = 0""")
def program_roles(spark, sf):
    e, r = world(spark, sf)
    return flows.program_roles(e.withColumn("semantic_tags", F.lit(None).cast("array<string>")), r)


# --- reports and search -------------------------------------------------------------------------------


@query(f"""WITH {WORLD}, e AS (SELECT count(*) AS n_entities FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey FROM part)), r AS (SELECT count(*) AS n_relations, count(*) FILTER (c >= 0.8) AS n_high, count(*) FILTER (c >= 0.5 AND c < 0.8) AS n_medium, count(*) FILTER (c < 0.5) AS n_low FROM m)
SELECT n_entities, n_relations, n_high, n_medium, n_low, (SELECT count(*) FROM nation) AS n_files, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n_files_with_entities, 100::BIGINT AS pct_evidence FROM e, r""")
def verify_report(spark, sf):
    e, r = world(spark, sf)
    home = T.table(spark, sf, "supplier").select(T.key("supplier", "s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("string")).alias("files"))
    e = e.join(home, "id", "left").withColumn("inferred", F.lit(False)).withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    f = T.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("path"))
    return coverage.report(e, r, f).select("n_entities", "n_relations", "n_high", "n_medium", "n_low", "n_files", "n_files_with_entities", "pct_evidence")


@query(f"""WITH {WORLD} SELECT 'low_confidence' AS kind, 'supplier:' || s || '|' || rel || '|part:' || p AS id FROM m WHERE c < 0.5 UNION ALL SELECT 'inferred_entity', 'part:' || p_partkey FROM part WHERE p_size < 5""")
def verify_gaps(spark, sf):
    e, r = world(spark, sf)
    unsure = T.table(spark, sf, "part").filter("p_size < 5").select(T.key("part", "p_partkey").alias("id"), F.lit(True).alias("inferred"))
    e = e.join(unsure, "id", "left").withColumn("files", F.array(F.lit("one file")))
    return coverage.gaps(e, r, spark.createDataFrame([("one file",)], "path string"))


@query(f"""WITH {WORLD}, m2 AS (SELECT rel, s, p, max(c) AS c, list_sort(list_distinct(list(ev))) AS ev FROM x GROUP BY ALL) SELECT '"' || rel || '","supplier:' || s || '","part:' || p || '","' || array_to_string(ev, ' | ') || '"' AS line FROM m2""")
def csv_edges(spark, sf):
    r = export.evidence_records(world(spark, sf)[1].withColumn("evidence", F.array_sort("evidence")))
    return export.csv_lines(export.csv_edges(r).select("rel", "from_id", "to_id", "evidence"))


def fuzzy_sql(equal: int, contains: int, token: int, every: int, some: int, similar: float, ratio: float) -> str:
    hit = f"a = b OR contains(a, b) OR contains(b, a) OR (least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) >= {ratio} AND 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= {similar})"
    return f"""WITH v AS (SELECT DISTINCT p_name AS name, trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')) AS v FROM part), t AS (SELECT name, v, len(list_filter(['RED', 'WIDGIT'], lambda a: len(list_filter(string_split(v, ' '), lambda b: {hit})) > 0)) AS h FROM v),
s AS (SELECT name, CASE WHEN v = 'RED WIDGIT' THEN {equal} WHEN contains(v, 'RED WIDGIT') OR contains('RED WIDGIT', v) THEN {contains} WHEN h > 0 THEN {token} * h + CASE WHEN h = 2 THEN {every} ELSE {some} END ELSE 0 END::INT AS score FROM t) SELECT name, score FROM s WHERE score > 0"""


@query(fuzzy_sql(180, 120, 26, 54, 14, 0.78, 0.0))
def fuzzy_resolution(spark, sf):
    return search.fuzzy(T.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct(), "red widgit", ["name"]).select("name", "score")


@query(fuzzy_sql(160, 115, 24, 48, 12, 0.72, 0.5))
def fuzzy_executive(spark, sf):
    return search.fuzzy(T.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct(), "red widgit", ["name"], X.EXECUTIVE).select("name", "score")


@query("""SELECT 'part:' || p_partkey AS id, 120 + CASE WHEN p_size % 2 = 0 THEN 20 ELSE 16 END - CASE WHEN p_size < 5 THEN 28 ELSE 0 END AS score FROM part WHERE contains('PART' || p_partkey, 'PART1') AND p_partkey <> 1 UNION ALL SELECT 'part:1', 180 + CASE WHEN p_size % 2 = 0 THEN 20 ELSE 16 END - CASE WHEN p_size < 5 THEN 28 ELSE 0 END FROM part WHERE p_partkey = 1""")
def score_entity(spark, sf):
    unsure = T.table(spark, sf, "part").select(T.key("part", "p_partkey").alias("id"), (F.col("p_size") < 5).alias("inferred"), F.lit(0.9).alias("confidence"))
    e = world(spark, sf)[0].join(unsure, "id")
    return search.rank_seed(e, "part1").filter("score > 100").select("id", "score")  # above what likeness of one word gives
