from tracelode.operators.extract import using


def rows(text):
    lines = ["       PROGRAM-ID. MAIN.", "       WORKING-STORAGE SECTION.", "           COPY RECA.", "       01  REC-A PIC X(10).", "       01  REC-B.", "           05 REC-C PIC 9(4).", "       PROCEDURE DIVISION."]
    lines += ["           " + x for x in text.splitlines()]
    return [(r["callee"], r["field"]) for r in using.parse(list(enumerate(lines, 1)))]


def test_operands_end_at_the_next_statement():
    assert rows("IF X\nCALL 'SUBA' USING REC-A\nMOVE 1 TO REC-B\nCALL 'SUBB' USING REC-B\nEND-IF.\nCALL 'SUBC' USING REC-A.") == [("SUBA", "REC-A"), ("SUBB", "REC-B"), ("SUBC", "REC-A")]


def test_modes_returning_and_phrases():
    assert rows("CALL SUB-V USING BY REFERENCE REC-A\n  BY CONTENT LENGTH OF REC-B BY VALUE 5 RETURNING RC\nON EXCEPTION DISPLAY X END-CALL") == [("SUB-V", "REC-A"), ("SUB-V", "REC-B")]
    assert rows('CALL "A" GIVING RC.\nCALL "B".\nDISPLAY "CALL C USING D".\nCALL "E" USING "LIT" REC-A REC-A') == [("E", "REC-A")]
    assert rows("CALL") == rows("CALL 'X' USING") == []


def test_level_and_picture():
    lines = ["       PROGRAM-ID. MAIN.", "           COPY RECA.", "       01  REC-A PIC X(10).", "           05 REC-C PIC IS 9(4).", "       PROCEDURE  DIVISION.", "           CALL 'S' USING REC-A REC-C REC-X", "      *    CALL 'T' USING REC-A"]
    assert [(r["program"], r["field"], r["copybook"], r["level"], r["pic"], r["line"]) for r in using.parse(list(enumerate(lines, 1)))] == [("MAIN", "REC-A", "RECA", 1, "X(10)", 6), ("MAIN", "REC-C", "RECA", 5, "9(4)", 6), ("MAIN", "REC-X", None, None, None, 6)]


def test_files_are_scanned_in_a_stream_and_may_go_over_a_batch(spark):
    def codes(k):
        return [f"       PROGRAM-ID. M{k}.", "       01  REC-A.", "       PROCEDURE DIVISION.", "           CALL 'S' USING", f"             REC-A REC-{k}", "           MOVE REC-A TO REC-B", "           CALL 'T' USING REC-B"]

    df = spark.createDataFrame([(f"/c/{k}.cbl", n, c) for k in range(40) for n, c in enumerate(codes(k), 1)], "path string, line int, code string").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = using.uses(df)
        got = {(r["path"], r["program"], r["callee"], r["field"], r["level"], r["line"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(f"/c/{k}.cbl", f"M{k}", *x) for k in range(40) for x in (("S", "REC-A", 1, 4), ("S", f"REC-{k}", None, 4), ("T", "REC-B", None, 7))}
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no call of Python for each file
