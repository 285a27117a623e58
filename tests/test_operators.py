"""Behaviour of single operators; each divergence that is meant has a test of its own."""

import pytest
from pyspark.sql import functions as F

from tracelode.functions import identity, text
from tracelode.operators import changes, coverage, dossier, export, graph, model, ordering, search
from tracelode.operators.extract import copybook, jcl, messaging, using
from tracelode.sources import files


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("v")).first()["v"]


def edges(spark, pairs, rel="CALLS"):
    return spark.createDataFrame([(rel, a, b, 1.0) for a, b in pairs], "rel string, from_id string, to_id string, confidence double")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.mark.parametrize(
    ("kind", "name", "parent", "hash_", "path", "want"),
    [("program", " pay ", None, "h", "x", "program:PAY"), ("step", "S1", "JOB", "h", "x", "step:JOB::S1"), ("step", "S1", "", "abc", "x", "step:S1@ABC"), ("field", "F", None, None, "/a/b/c.cpy", "field:F@B_C.CPY"), ("sql_script", "L", None, None, None, "sql_script:L@INLINE"), ("column", "C", "T", "h", "x", "column:C")],
)
def test_entity_id(spark, kind, name, parent, hash_, path, want):
    df = spark.createDataFrame([(kind, name, parent, hash_, path)], "k string, n string, p string, h string, f string")
    assert df.select(identity.entity_id(*[F.col(c) for c in "knphf"])).first()[0] == want


def test_slug_and_tokens(spark):
    assert one(spark, text.slugify(F.col("a")), a="  Ação Número 7! ") == "acao-numero-7"
    assert one(spark, text.slugify(F.col("a")), a="--") == "query"
    assert one(spark, text.camel_tokens(F.col("a")), a="PayMainController_v2") == ["pay", "main", "controller"]


def test_scores_differ_by_variant(spark):
    q, v = F.lit("payment batch"), F.col("a")
    assert one(spark, text.score_value(q, v), a="PAYMENT BATCH") == 180
    assert one(spark, text.score_value(q, v, text.EXECUTIVE), a="PAYMENT BATCH") == 160
    assert one(spark, text.score_value(q, v), a="daily payment batch run") == 120
    assert one(spark, text.score_value(q, v), a="paymant xx") == 26 + 14


def test_empty_value_scores_nothing(spark):
    assert one(spark, text.score_value(F.lit("pay"), F.col("a")), a="--") == 0


def test_duration(spark):
    assert [one(spark, text.duration_ms(F.col("a")), a=x) for x in ("0", "500ms", "30s", "2m", "x")] == [0, 500, 30000, 120000, None]


def test_walk_depth_and_duplicates(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")])
    down = {(r["from_id"], r["depth"]) for r in graph.traverse(ids(spark, "a"), e, "downstream", 1).collect()}
    assert down == {("a", 0), ("b", 1)}  # nodes at the last depth still show their edges
    both = graph.traverse(ids(spark, "a"), e, "both", 1, dedupe=False)
    assert both.filter("from_id = 'a' and to_id = 'b'").count() == 2
    assert graph.traverse(ids(spark, "a"), e, "both", 1).filter("from_id = 'a' and to_id = 'b'").count() == 1
    assert graph.affected(ids(spark, "a"), e, "downstream", 999).count() == 3


def test_back_edges_are_marked(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")])
    got = {(r["from_id"], r["to_id"]): r["is_back_edge"] for r in graph.chain(ids(spark, "a"), e, 3).collect()}
    assert got == {("a", "b"): False, ("b", "c"): True, ("c", "b"): True, ("c", "d"): False}


def test_cycles(spark):
    e = edges(spark, [("a", "a"), ("b", "c"), ("c", "b"), ("d", "e"), ("e", "f"), ("f", "d"), ("x", "y")])
    got = {r["id"]: (r["component"], r["size"]) for r in graph.cycle_nodes(e).collect()}
    assert got == {"a": ("a", 1), "b": ("b", 2), "c": ("b", 2), "d": ("d", 3), "e": ("d", 3), "f": ("d", 3)}


def test_trace_back_stops_at_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "a")])
    got = [(r["hop"], r["id"]) for r in graph.trace_back(ids(spark, "b"), e, F.lit(1)).orderBy("hop").collect()]
    assert got == [(0, "b"), (1, "a")]


def test_merge_takes_the_best_description(spark):
    rows = [("program", "p", "x", 1, 0.5, "cobol", "short", "jcl_comment", 1), ("program", "P", "y", 2, 1.0, "cobol", "longer text", "derived", 0), ("program", "P", "z", 3, 0.7, "jcl", "header", "cobol_header", 2)]
    raw = spark.createDataFrame(rows, "type string, name string, file string, line int, confidence double, extractor string, description string, description_source string, ordinal bigint")
    e = model.merge_entities(raw).collect()
    assert len(e) == 1 and e[0]["description"] == "header" and e[0]["files"] == ["x", "y", "z"] and e[0]["confidence"] == 1.0 and e[0]["line"] == 2


def test_endpoints(spark):
    raw_e = spark.createDataFrame([("step", "S", "J1", 1), ("step", "S", "J2", 2), ("copybook", "BOOK", None, 3)], "type string, name string, parent string, ordinal bigint")
    raw_r = spark.createDataFrame(
        [("EXECUTES", "S", "P", "step", None, "J2", "jcl"), ("INCLUDES", "P", "BOOK", None, None, None, "cobol"), ("READS", "P", "T", None, None, None, "cobol"), ("USES", "FRM", "X.OCX", None, None, None, "vb6"), ("ODD", "BOOK", "NEW", None, None, None, "x")],
        "rel string, `from` string, `to` string, fromType string, toType string, fromParent string, extractor string",
    )
    e, r = model.normalize(raw_e, raw_r)
    got = {(x["rel"], x["from_id"], x["to_id"]) for x in r.collect()}
    assert got == {("EXECUTES", "step:J2::S", "program:P"), ("INCLUDES", "program:P", "copybook:BOOK"), ("READS", "program:P", "table:T"), ("USES", "screen:FRM", "component:X.OCX"), ("ODD", "copybook:BOOK", "program:NEW")}
    made = {x["id"]: x["confidence"] for x in e.filter("inferred").collect()}
    assert made["table:T"] == 0.3 and "step:J2::S" not in made


def test_heuristic_targets(spark):
    got = model.heuristic_targets(spark.createDataFrame([("WS-PAY-PROG",), ("XX",)], "var string"), spark.createDataFrame([("PAY",), ("XX",)], "name string")).collect()
    assert [(r["var"], r["target"]) for r in got] == [("WS-PAY-PROG", "PAY")]


def test_merge_contracts_unions_fields(spark):
    ddl = "from_id string, to_id string, confidence double, fields array<struct<name: string, copybook: string>>"
    a, b = spark.createDataFrame([("p", "q", 0.5, [("A", None), ("B", None)])], ddl), spark.createDataFrame([("p", "q", 0.9, [("B", "BOOK")])], ddl)
    r = model.merge_contracts(a, b).collect()
    assert len(r) == 1 and r[0]["confidence"] == 0.9 and {(f["name"], f["copybook"]) for f in r[0]["fields"]} == {("A", None), ("B", "BOOK")}


def test_encoding_and_content(spark):
    rows = [("utf16", "ab".encode("utf-16")), ("bom", b"\xef\xbb\xbfab"), ("utf8", "é".encode()), ("latin", "é".encode("latin1")), ("nul", b"a\x00b\x00c\x00d")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "n string, content binary")
    got = {r["n"]: (r["e"], r["t"]) for r in df.select("n", files.encoding(F.col("content")).alias("e"), files.decoded(F.col("content")).alias("t")).collect()}
    assert got["utf16"] == ("UTF-16LE", "ab") and got["bom"] == ("UTF-8-BOM", "ab") and got["utf8"] == ("UTF-8", "é") and got["latin"] == ("ISO-8859-1", "é") and got["nul"][0] == "ISO-8859-1"
    heads = {"cobol": "       IDENTIFICATION DIVISION.\n", "copybook": "       01 A.\n          05 B PIC X.\n", "jcl": "//J JOB\n", "sql": "SELECT 1\n", "vb6": "VERSION 5.00\n", "messaging": "layout CNAB 240\n", None: "hello\n"}
    df = spark.createDataFrame([(k or "", bytearray(v.encode())) for k, v in heads.items()], "k string, content binary")
    assert all((r["k"] or None) == r["d"] for r in df.select("k", files.by_content(F.col("content")).alias("d")).collect())


def test_paths_outside_roots_keep_their_name(spark):
    roots = spark.createDataFrame([("SOURCE_1", "/a"), ("SOURCE_2", "/a/b")], "alias string, root string")
    df = spark.createDataFrame([("/a/x.c",), ("/a/b/y.c",), ("/z/w.c",)], "path string")
    got = {r["path"]: r["alias_path"] for r in files.sanitize(df, roots).collect()}
    assert got == {"/a/x.c": "SOURCE_1/x.c", "/a/b/y.c": "SOURCE_2/y.c", "/z/w.c": "w.c"}
    assert {r["resolved"] for r in files.resolve_alias(files.sanitize(df, roots), roots).collect()} == {"/a/x.c", "/a/b/y.c", "w.c"}


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1", 1), ("b", "9", 1), ("d", "1", 1), ("e", "5", 99)], "path string, hash string, size bigint")
    assert {r["path"] for r in changes.to_process(new, old).collect()} == {"b", "d", "e"}
    assert {r["path"]: r["status"] for r in changes.status(new, old, 50).collect()} == {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new", "e": "skipped"}


def test_copybook_layout():
    codes = [(i, "       " + x) for i, x in enumerate(["01  REC.", "    05  FILLER.", "        10 A PIC X(3).", "    05  B OCCURS 1 TO 5 TIMES", "        DEPENDING ON N PIC 9.", "    05  C REDEFINES B PIC X."], 1)]
    rows = {r["name"]: r for r in copybook.parse("BOOK", codes)}
    assert rows["REC"]["parent"] == "BOOK" and rows["A"]["parent"] == "REC" and rows["B"]["occurs"] == {"min": 1, "max": 5, "depending_on": "N"} and rows["C"]["redefines"] == "B" and rows["B"]["line"] == 4


def test_using_over_lines():
    codes = [(1, "       PROGRAM-ID. P."), (2, "           COPY BK."), (3, "       01  AREA-A."), (4, "       PROCEDURE DIVISION."), (5, "           CALL 'Q' USING BY REFERENCE AREA-A"), (6, "               BY VALUE X-B.")]
    assert [(r["callee"], r["field"], r["copybook"], r["line"]) for r in using.parse(codes)] == [("Q", "AREA-A", "BK", 5), ("Q", "X-B", None, 5)]


def test_phases_and_gate(spark):
    e = spark.createDataFrame([("program:P", "program", "P"), ("table:T", "table", "T"), ("dataset:D", "dataset", "D"), ("program:Q", "program", "Q")], "id string, type string, label string")
    r = spark.createDataFrame([("s", "READS", "program:P", "table:T", ["f:3"], 0.9), ("s", "CALLS", "program:P", "program:Q", ["f:4"], 1.0)], "seed string, rel string, from_id string, to_id string, evidence array<string>, confidence double")
    p = dossier.phases(r, e)
    assert {x["kind"] for x in p.collect()} == {"handoff", "validation"}  # program to table crosses platforms
    c = dossier.claims(p)
    assert c.filter("field = 'objective' and type = 'fact'").count() == 2 and c.filter("field = 'decisions'").first()["type"] == "hypothesis"
    done = dossier.completeness(spark.createDataFrame([("s", i, True) for i in "abcdefghij"] + [("s", "citations", False)], "seed string, id string, ok boolean")).first()
    assert done["total_pct"] == 91 and done["status"] == "partial"


def test_roles_and_exports(spark):
    df = spark.createDataFrame([("TB_STATUS", "table", True), ("TMP_X", "table", True), ("CLIENTE", "table", True), ("CLIENTE", "table", False), ("ARQ", "dataset", False)], "l string, k string, w boolean")
    assert [r[0] for r in df.select(dossier.data_role(F.col("l"), F.col("k"), F.col("w"))).collect()] == ["control", "staging", "master", "domain", "outbound"]
    x = spark.createDataFrame([('a"b', "c<d", "R")], "from_id string, to_id string, rel string")
    assert export.graphml_edges(x).first()["line"] == '  <edge source="a&quot;b" target="c&lt;d"><data key="rel">R</data></edge>'
    assert export.csv_lines(x).first()["line"] == '"a""b","c<d","R"'


def test_order_operators(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(["a", "a", None, "b", "b", "a"])], "g int, k int, t string")
    runs = [(r["phase"], r["t"], r["n_rows"]) for r in ordering.merge_adjacent(df, ["g"], ["k"], "t").orderBy("phase").collect()]
    assert runs == [(1, "a", 2), (2, None, 1), (3, "b", 2), (4, "a", 1)]
    carried = [r[0] for r in df.select("k", ordering.carry_forward(F.col("t"), ["g"], ["k"]).alias("c")).orderBy("k").select("c").collect()]
    assert carried == ["a", "a", "a", "b", "b", "a"]


def test_coverage_report(spark):
    e = spark.createDataFrame([("program:A", ["x"], False, "program"), ("program:B", [], True, "program")], "id string, files array<string>, inferred boolean, type string")
    r = spark.createDataFrame([("CALLS", "program:A", "program:B", 0.4, ["x:1"])], "rel string, from_id string, to_id string, confidence double, evidence array<string>")
    f = spark.createDataFrame([("x",), ("y",)], "path string")
    got = coverage.report(e, r, f).first()
    assert (got["pct_files"], got["pct_inferred"], got["pct_evidence"], got["n_low"]) == (50, 50, 100, 1)
    assert [x["path"] for x in coverage.files_without_entities(f, e).collect()] == ["y"]


def test_token_search_tiers(spark):
    df = spark.createDataFrame([("1", "PAY MAIN"), ("2", "PAYROLL"), ("3", "XPAY"), ("4", "PAY")], "id string, name string")
    aliases = spark.createDataFrame([("PAY", "2")], "alias string, canonical_id string")
    got = {r["id"]: r["tier"] for r in search.token_search(df, search.token_index(df, ["name"]), aliases, "pay").collect()}
    assert got == {"4": 1, "2": 2, "1": 3, "3": 4}


def test_catalog(spark):
    from tracelode.operators import catalog

    e = spark.createDataFrame([("dataset:A.B+1", "dataset", "A.B+1", False), ("table:S.T", "table", "S.T", False), ("program:P", "program", "P", False)], "id string, type string, name string, inferred boolean")
    known = catalog.aliases(e)
    assert {(r["alias"], r["canonical_id"]) for r in known.collect()} == {("A.B", "dataset:A.B+1"), ("T", "table:S.T"), ("P", "program:P")}
    got = {r["name"]: (r["id"], r["how"]) for r in catalog.canonical(spark.createDataFrame([("t", "table"), ("S.T", "table"), ("x", None)], "name string, type string"), e, known).collect()}
    assert got == {"T": ("table:S.T", "alias"), "S.T": ("table:S.T", "typed"), "X": (None, None)}
    lines = spark.createDataFrame([("f", 1, "EXEC CICS LINK PROGRAM('SUB1') END-EXEC"), ("f", 2, "EXEC SQL")], "path string, line int, code string")
    calls, flags = catalog.transactions(lines)
    assert [(r["verb"], r["target"]) for r in calls.collect()] == [("LINK", "SUB1")] and flags.first()["db2"] and not flags.first()["ims"]


def test_resolve(spark):
    e = spark.createDataFrame([("program:PAY", "program", "PAY", "PAY", None, False, 1.0), ("table:PAYTAB", "table", "PAYTAB", "PAYTAB", None, False, 0.9)], "id string, type string, name string, label string, description string, inferred boolean, confidence double")
    f = spark.createDataFrame([("job:X", "XJOB", "XJOB", "x", ["A"], ["B"])], "entry_id string, entry_label string, entry_name string, summary string, programs array<string>, data_objects array<string>")
    assert [(r["id"], r["status"]) for r in search.resolve(e, f, "pay").collect()] == [("program:PAY", "resolved")]


def test_messaging_reads_all_lines(spark):
    code = ["LAYOUT: FEED"] + ["x"] * 249 + ["header of CNAB 240", "SENDS PAYMAIN", "DESTINO:", "  PAYOUT"]
    df = spark.createDataFrame([("/m/feed.txt", "h", "feed.txt", i + 1, c) for i, c in enumerate(code)], "path string, hash string, name string, line int, code string")
    e, r = messaging.extract(df)
    assert [(x["name"], x["semantic_tags"], x["confidence"]) for x in e.collect()] == [("FEED", ["cnab"], 0.9)]
    assert {(x["rel"], x["from"], x["to"]) for x in r.collect()} == {("SENDS", "FEED", "PAYMAIN"), ("SENDS", "FEED", "PAYOUT")}


def test_ends_meet_one_entity_however_many_share_the_name(spark):
    entities = spark.createDataFrame([(f"part:{k:04}", "part", "SAME", None, k < 5) for k in range(2000)] + [("step:A::S", "step", "S", "A", False), ("step:B::S", "step", "S", "B", True)], "id string, type string, name string, parent string, inferred boolean")
    ends = spark.createDataFrame([(k, "to", "part", "SAME", "", 0) for k in range(50)] + [(90, "to", "step", "S", "B", 0), (91, "to", "step", "S", "C", 0), (92, "to", "step", "S", "", 0)], "__row int, side string, type string, name string, parent string, preference int")
    got = [(r["__row"], r["id"], r["q"]) for r in model.of_type(ends, entities).collect()]
    assert sorted(got) == [(k, "part:0005", 0) for k in range(50)] + [(90, "step:B::S", 0), (92, "step:A::S", 1)]


def test_jcl_statements_come_from_one_grouping_of_the_lines(spark):
    code = ["//* OF THE FILE", "//J JOB (A)", "//* ONE", "//* TWO", "//S1 EXEC PGM=P1,", "//     COND=(4,LT,S0)", "//* BETWEEN", "//     LOST=1", "plain", "//D1 DD DSN=A.B,", "//     DISP=SHR", "//* LAST"]
    lines = spark.createDataFrame([("/a/x.jcl", "h", "x", k, c) for k, c in enumerate(code, 1)], "path string, hash string, name string, line int, code string")
    s = jcl.statements(lines)
    got = [(r["line"], r["op"], r["label"], r["operands"], r["description"], r["comment_lines"]) for r in s.orderBy("line").collect()]
    assert got == [(2, "JOB", "J", "(A)", "OF THE FILE", [1]), (5, "EXEC", "S1", "PGM=P1, COND=(4,LT,S0)", "ONE TWO", [3, 4]), (10, "DD", "D1", "DSN=A.B, DISP=SHR", None, None)]
    assert "Join" not in s._jdf.queryExecution().optimizedPlan().toString()


def test_scores_evaluate_the_words_of_a_text_once(spark):
    """The texts of a value are normalised and split once, however often the score looks at them."""
    df = spark.range(1).select(text.score_text(F.lit("payment batch"), F.array(F.concat(F.lit("daily paymant x"), F.col("id").cast("string")))).alias("s"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first()["s"] == 26 + 14
    assert plan.count("levenshtein") == 2 and plan.count("paymant") == 1  # one for each branch that looks at words
