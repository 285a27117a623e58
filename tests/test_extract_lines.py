"""Patterns of the extractors: found on lines of any case, evaluated once a line, state read once a file."""

from tracelode.operators.extract import cobol, vb6


def lines(spark, path, codes):
    return spark.createDataFrame([(path, "h", path, k + 1, c) for k, c in enumerate(codes)], "path string, hash string, name string, line int, code string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


DESKTOP = [
    "begin vb.form frmone", 'object = "{A}#1.0#0"; "mscomctl.ocx"', "Begin VB.TextBox txtName", "private sub txtName_Change()", 'declare function f LIB "kernel32" ()', 'c.commandtext = "dbo.pr_x"',
    's = "delete from t_old where a = 1"', 's = "select a from t_new"', 'OPEN "c:\\d\\a.txt" for input as #1', 'x = dir$("c:\\d\\b.txt")', "dim withevents k as new clsOther", "Timer1_Timer", "end sub", "' open nothing",
]


def test_desktop_patterns_on_lines_of_any_case(spark):
    e, r = vb6.extract(lines(spark, "/s/one.frm", DESKTOP))
    got = {(x["rel"], x["from"], x["to"], x["line"]) for x in r.collect()}
    assert got == {
        ("USES", "FRMONE", "MSCOMCTL.OCX", 2), ("HANDLES", "TXTNAME_CHANGE", "TXTNAME", 4), ("USES_DLL", "FRMONE", "KERNEL32", 5), ("CALLS_SP", "FRMONE", "DBO.PR_X", 6), ("UPDATES", "FRMONE", "T_OLD", 7), ("READS", "FRMONE", "T_NEW", 8),
        ("READS", "FRMONE", "A.TXT", 9), ("READS", "FRMONE", "B.TXT", 10), ("HANDLES_EVENTS", "FRMONE", "CLSOTHER", 11), ("DEPENDS_ON", "FRMONE", "CLSOTHER", 11), ("TRIGGERS", "FRMONE", "", 12),
    }
    assert {(x["type"], x["name"]) for x in e.collect()} >= {("screen", "FRMONE"), ("control", "TXTNAME"), ("subroutine", "TXTNAME_CHANGE"), ("dataset", "A.TXT")}


def test_desktop_patterns_stand_once_in_the_plan(spark):
    relations = plan(vb6.extract(lines(spark, "/s/one.frm", DESKTOP))[1])
    for pattern in (r"CommandText\s*=", r"WithEvents\s+", r"Implements\s+"):
        assert relations.count(pattern) == 1, pattern


PROGRAM = [f"       {c}" for c in ("PROGRAM-ID. PA.", "PROCEDURE DIVISION.", "MAIN-PARA.", "    MOVE 'PX' TO WS-PROG", "    CALL WS-PROG", "    CALL WS-OTHER", "    PERFORM 100-STEP THRU 100-EXIT", "    IF WS-A = 1", "    GO TO 100-STEP.", "100-STEP.", "    CALL 'PY'")]


def test_flow_reads_the_state_of_a_file_once(spark):
    f = cobol.flow(lines(spark, "/c/a.cbl", PROGRAM))
    got = {(x["from"], x["to"], x["kind"], x["line"]) for x in f["edges"].collect()}
    assert got == {
        ("MAIN-PARA", "PX", "CALL", 5), ("MAIN-PARA", "WS-OTHER", "CALL-DYNAMIC", 6), ("MAIN-PARA", "100-STEP", "PERFORM", 7), ("MAIN-PARA", "100-EXIT", "PERFORM-THRU", 7), ("MAIN-PARA", "MAIN-PARA#IF-8", "IF-BRANCH", 8),
        ("MAIN-PARA", "100-STEP", "GO-TO", 9), ("100-STEP", "PY", "CALL", 11),
    }
    assert plan(f["edges"]).count("LogicalRDD") == 1


def test_edges_and_notes_come_from_one_pass(spark):
    r = cobol.extract(lines(spark, "/c/a.cbl", ["      * PB123 - EARLY", *PROGRAM, "      * PC123 - CALLED", "           EXEC SQL SELECT A FROM T1 END-EXEC."]))[1]
    got = {(x["rel"], x["to"], x["line"], x["confidence"]) for x in r.collect()}
    assert got >= {("CALLS", "PC123", 13, 0.4), ("READS", "T1", 14, 0.9), ("PERFORMS", "100-EXIT", 8, 0.85)} and not any(to == "PB123" for _, to, _, _ in got)
    assert plan(r).count("LogicalRDD") == 2
