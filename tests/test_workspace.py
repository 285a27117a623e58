"""Sources to model to queries, on a small legacy system written here."""

import pytest
from pyspark.sql import functions as F

from tracelode.plans import commands

PAY = """      * OBJETIVO: MENU DE PAGAMENTOS
       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYMAIN.
       WORKING-STORAGE SECTION.
           COPY PAYREC.
       01  PAY-AREA.
       01  WS-NEXT PIC X(8).
       PROCEDURE DIVISION.
       0000-START.
           PERFORM 1000-READ
           MOVE 'PAYOUT' TO WS-NEXT
           CALL WS-NEXT USING PAY-AREA.
           GO TO 9000-END.
       1000-READ.
           READ INFILE
           IF PAY-STATUS
           EVALUATE PAY-KIND
           CALL 'PAYCHK' USING BY REFERENCE PAY-AREA.
           PERFORM UNTIL WS-DONE
           EXEC SQL SELECT NAME, AMOUNT INTO :H FROM PAYTAB END-EXEC.
       9000-END.
           COMMIT.
"""
CHK = """       IDENTIFICATION DIVISION.
       PROGRAM-ID. PAYCHK.
           COPY PAYREC.
       PROCEDURE DIVISION.
       A-START.
           EXEC SQL
             UPDATE PAYTAB SET AMOUNT = 1
           END-EXEC.
"""
OUT = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. PAYOUT.\n       PROCEDURE DIVISION.\n       MAIN-P.\n           WRITE OUTFILE\n"
JCL = """//* EMITE RELATORIO
//PAYJOB   JOB (A)
//* FIRST STEP
//S1       EXEC PGM=PAYMAIN
//IN       DD DSN=PAY.INPUT,DISP=SHR
//OUT      DD DSN=PAY.OUTPUT,
//            DISP=(NEW,CATLG)
//S2 EXEC PGM=PAYOUT,COND=(4,LT,S1)
//   EXEC PROC=CLEANUP
"""
BOOK = """       01  PAY-AREA.
           05  PAY-STATUS PIC X(2).
           05  FILLER PIC X.
           05  PAY-GROUP OCCURS 3 TIMES.
               10  PAY-KIND PIC 9(4) COMP-3.
           05  PAY-ALT REDEFINES PAY-GROUP PIC X(9).
"""
SQL = "CREATE PROCEDURE dbo.LoadPay AS\nSELECT Name, Amount FROM [dbo].[PayTab];\nUPDATE PayLog SET Total = 1 WHERE x = 2;\nINSERT INTO PayHist (Name, Total) VALUES (1, 2);\nCALL OtherProc;\n"
FRM = 'VERSION 5.00\nObject = "{ABC}#1.0#0"; "MSCOMCTL.OCX"\nBegin VB.Form frmPay\n  Begin VB.CommandButton cmdGo\n  End\nEnd\nPrivate Declare Function X Lib "payapi.dll" ()\nPrivate Sub cmdGo_Click()\n  cmd.CommandText = "PR_PAY"\n  Open "C:\\out\\pay.txt" For Output As #1\nEnd Sub\n'


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("legacy")
    for name, text in {"pay.cbl": PAY, "chk.cbl": CHK, "out.cob": OUT, "payjob.jcl": JCL, "PAYREC.cpy": BOOK, "load.sql": SQL, "pay.frm": FRM, "notes.txt": "nothing here\n"}.items():
        (root / name).write_text(text)
    w = commands.init(spark, str(tmp_path_factory.mktemp("ws")), [str(root)])
    w.root = root
    commands.ingest(w)
    commands.build_model(w)
    commands.build_map(w)
    return w


def edges(w):
    return {(r["rel"], r["from_id"], r["to_id"]) for r in w.read("relations").collect()}


def test_inventory(ws):
    found = {r["name"]: (r["dialect"], len(r["hash"])) for r in ws.read("files").collect()}
    assert found["pay.cbl"] == ("cobol", 12) and found["PAYREC.cpy"][0] == "copybook" and found["notes.txt"][0] is None


def test_program_edges(ws):
    e = edges(ws)
    for want in [
        ("CALLS", "program:PAYMAIN", "program:PAYCHK"), ("CALLS", "program:PAYMAIN", "program:PAYOUT"), ("INCLUDES", "program:PAYMAIN", "copybook:PAYREC"), ("READS", "program:PAYMAIN", "table:PAYTAB"), ("UPDATES", "program:PAYCHK", "table:PAYTAB"),
        ("READS", "program:PAYMAIN", "dataset:INFILE"), ("PERFORMS", "paragraph:PAYMAIN::0000-START", "paragraph:PAYMAIN::1000-READ"), ("GO-TO", "paragraph:PAYMAIN::0000-START", "paragraph:PAYMAIN::9000-END"), ("CONTAINS", "program:PAYMAIN", "paragraph:PAYMAIN::1000-READ"),
        ("WRITES", "program:PAYOUT", "dataset:OUTFILE"), ("DATA_CONTRACT", "program:PAYMAIN", "program:PAYCHK"),
    ]:
        assert want in e, want
    assert not any(r[0] == "CALL-DYNAMIC" for r in e)


def test_inline_perform_is_no_paragraph(ws):
    assert not any(r[0] == "PERFORMS" and "UNTIL" in r[2] for r in edges(ws))


def test_sql_block_on_one_line_is_closed(ws):
    assert ("CHECKPOINTS", "program:PAYMAIN", "procedure:CHECKPOINT") in edges(ws)


def test_dynamic_call_keeps_its_variable(ws):
    r = ws.read("relations").filter("rel = 'CALLS' and from_id = 'program:PAYMAIN' and to_id = 'program:PAYOUT'").collect()
    assert [x["resolvedFrom"] for x in r] == ["WS-NEXT"] and r[0]["confidence"] == 0.95


def test_header_description(ws):
    p = ws.read("entities").filter("id = 'program:PAYMAIN'").first()
    assert p["description"] == "OBJETIVO: MENU DE PAGAMENTOS" and "menu" in p["semantic_tags"] and p["description_source"] == "cobol_header"


def test_contract_is_confirmed(ws):
    c = ws.read("relations").filter("rel = 'DATA_CONTRACT' and to_id = 'program:PAYCHK'").first()
    assert c["confidence"] == 0.9 and [(f["name"], f["copybook"], f["confirmed"]) for f in c["fields"]] == [("PAY-AREA", "PAYREC", True)]


def test_copybook_levels(ws):
    f = {r["name"]: r for r in ws.read("entities").filter("type = 'field' and extractor = 'copybook'").collect()}
    assert f["PAY-KIND"]["parent"] == "PAY-GROUP" and f["PAY-KIND"]["pic"] == "9(4) COMP-3" and f["PAY-GROUP"]["occurs"]["max"] == 3 and f["PAY-AREA"]["parentType"] == "copybook"


def test_jobs(ws):
    s = {r["step_name"]: r for r in ws.read("steps").collect()}
    assert s["S1"]["programs"] == ["program:PAYMAIN"] and {(d["id"], d["op"]) for d in s["S1"]["datasets"]} == {("dataset:PAY.INPUT", "READS"), ("dataset:PAY.OUTPUT", "WRITES")}
    assert s["S2"]["run_condition"] == "RC(S1) <= 4" and s["S2"]["seq"] == 2 and s["STEP3"]["programs"] == ["procedure:CLEANUP"]
    j = ws.read("entities").filter("id = 'job:PAYJOB'").first()
    assert j["description"] == "EMITE RELATORIO" and set(j["semantic_tags"]) == {"jcl", "relatorio", "emissao"}


def test_sql_file(ws):
    e = edges(ws)
    for want in [("READS", "procedure:DBO.LOADPAY", "table:DBO.PAYTAB"), ("UPDATES", "procedure:DBO.LOADPAY", "table:PAYLOG"), ("WRITES", "procedure:DBO.LOADPAY", "table:PAYHIST"), ("CALLS_PROC", "procedure:DBO.LOADPAY", "procedure:OTHERPROC")]:
        assert want in e, want
    assert {r["name"] for r in ws.read("entities").filter("type = 'column' and parent = 'PAYHIST'").collect()} == {"NAME", "TOTAL"} or "TOTAL" in {r["name"] for r in ws.read("entities").filter("type = 'column'").collect()}


def test_form(ws):
    e = edges(ws)
    for want in [("USES", "screen:FRMPAY", "component:MSCOMCTL.OCX"), ("USES_DLL", "screen:FRMPAY", "component:PAYAPI.DLL"), ("CALLS_SP", "screen:FRMPAY", "procedure:PR_PAY"), ("WRITES", "screen:FRMPAY", "dataset:PAY.TXT"), ("HANDLES", "subroutine:FRMPAY::CMDGO_CLICK", "control:FRMPAY::CMDGO")]:
        assert want in e, want


def test_flows_and_search(ws):
    f = {r["entry_id"]: r for r in ws.read("flows").collect()}
    assert f["job:PAYJOB"]["type"] == "batch" and {"PAYMAIN", "PAYCHK", "PAYOUT"} <= set(f["job:PAYJOB"]["programs"]) and "PAYTAB" in f["job:PAYJOB"]["data_objects"]
    assert f["screen:FRMPAY"]["type"] == "screen"
    got = commands.find(ws, "paymain")
    assert got["entities"].orderBy(F.desc("score")).first()["id"] == "program:PAYMAIN"
    assert got["flows"].filter("entry_id = 'job:PAYJOB'").count() == 1


def test_impact_and_lineage(ws):
    out = commands.impact(ws, "PAYCHK", 2, "upstream")
    assert "program:PAYMAIN" in {r["id"] for r in out["affected"].collect()}
    found = {(r["kind"], r["id"]) for r in commands.lineage(ws, "PAY-KIND").collect()}
    assert {("copybook", "copybook:PAYREC"), ("program", "program:PAYMAIN"), ("data", "table:PAYTAB"), ("step", "step:PAYJOB::S1"), ("job", "job:PAYJOB")} <= found
    nodes, entries = commands.reverse(ws, "PAYTAB")
    assert "job:PAYJOB" in {r["id"] for r in entries.collect()}


def test_verify_and_review(ws):
    v = commands.verify(ws)
    r = v["report"].first()
    assert r["n_files"] == 8 and r["n_files_with_entities"] == 7 and r["pct_files"] == 88
    assert {x["id"] for x in v["gaps"].filter("kind = 'file_without_entities'").collect()} == {str(ws.root / "notes.txt")}
    before = commands.review(ws)["pending"].count()
    name = commands.review(ws)["pending"].first()["name"]
    commands.decide(ws, name, "approve")
    assert commands.review(ws)["pending"].count() < before


def test_dossier_and_plan(ws):
    d = commands.analyze(ws, ["PAYMAIN"])
    kinds = {r["kind"] for r in d["phases"].collect()}
    assert {"intake", "validation"} <= kinds
    assert d["criteria"].count() == 11 and {r["type"] for r in d["claims"].collect()} <= {"fact", "inference", "hypothesis"}
    g = d["gate"].first()
    assert g["complete"] is False or not g["blockers"]
    plan = commands.modernize.package(d)
    assert plan["waves"].count() == 4 and plan["services"].count() == d["phases"].count() and plan["backlog"].count() == 2 * d["phases"].count()


def test_resolve_and_focused_view(ws):
    out = commands.resolve(ws, "paymain")
    assert out["selection"].first()["anchor_id"] in ("program:PAYMAIN", "job:PAYJOB") and "program:PAYMAIN" in {r["anchor_id"] for r in out["candidates"].collect()} and out["bridges"].count() > 0
    view = commands.focused(ws, "PAYMAIN", "focused_partial")
    assert view["subjects"].first()["id"] == "program:PAYMAIN" and view["subjects"].count() <= 18 and view["flows"].count() >= 1
    d = commands.analyze(ws, ["PAYMAIN"], facts_only=True)
    assert "PAYCHK" in {r["label"] for r in d["lineage"].filter("kind = 'chain'").collect()} and d["phases"].count() > 0


def test_adherence(ws, tmp_path):
    (tmp_path / "pom.xml").write_text("<project/>")
    (tmp_path / "Dockerfile").write_text("FROM x")
    (tmp_path / "A.java").write_text('package a.b;\n@RestController\n@RequestMapping("/pay")\npublic class PaymainValidationController {\n @GetMapping("/{id}")\n void f() {}\n}\n')
    (tmp_path / "k8s.yaml").write_text("kind: Deployment\nmetadata: {name: pay}\n---\nkind: Service\nmetadata: {name: pay}\n")
    (tmp_path / "main.bicep").write_text("resource kv 'Microsoft.KeyVault/vaults@2022' = {}\n")
    plan = commands.modernize_plan(ws, ["PAYMAIN"])
    out = commands.modernize_verify(ws, plan, str(tmp_path))
    assert {r["type"] for r in out["resources"].collect()} == {"key_vault", "aks"}
    assert [(r["method"], r["path"]) for r in out["apis"].collect()] == [("GET", "/pay/{id}")]
    assert out["builds"].first()["tool"] == "maven" and out["status"].first()["status"] == "partial"


def test_incremental(ws, spark):
    before = ws.read("raw_relations").count()
    (ws.root / "out.cob").write_text(OUT + "           WRITE LOGFILE\n")
    commands.ingest(ws)
    after = ws.read("raw_relations")
    assert after.count() == before + 1 and after.filter(F.col("to") == "LOGFILE").count() == 1


def test_exports(ws):
    from tracelode.operators import export

    assert commands.export_model(ws, "graphml").filter("part = 7").count() == ws.read("relations").count()
    assert commands.export_model(ws, "csv").columns[-1] == "fields"
    text = export.mermaid(ws.read("relations"), "t", 5)
    assert text.splitlines()[1] == "flowchart LR" and len(text.splitlines()) == 7
    nodes, led = commands.executive(ws, 5)
    assert "softwareSystem" in export.structurizr(nodes.select(F.col("node").alias("id"), F.lit("program").alias("type"), F.col("node").alias("label")), led, "pay")


def test_streaming(ws, spark, tmp_path):
    from tracelode.streaming import ingest

    q = ingest.start(spark, str(ws.root), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/raw_entities")).filter("type = 'program'").count() == 3


def test_api(ws):
    from tracelode.plans import api

    nodes, links = api.graph_view(ws, types=["program", "table"], least=0.1, limit=3)
    ids = {r["id"] for r in nodes.collect()}
    assert 0 < len(ids) <= 3 and all(r["from_id"] in ids and r["to_id"] in ids for r in links.collect())
    one = api.program(ws, "paymain")
    assert one["entity"].first()["id"] == "program:PAYMAIN" and one["out"].count() > 0 and one["in"].filter("from_id like 'step:%'").count() > 0
    assert "program:PAYMAIN" in {r["id"] for r in api.find(ws, "paymain").collect()}
    assert api.jobs(ws).filter("job = 'PAYJOB'").count() == 1 and api.batch(ws, "payjob").count() == api.jobs(ws).selectExpr("sum(size(steps)) as n").first()["n"]
    assert set(api.stats(ws)) == {"types", "rels"} and api.flow(ws, "PAYMAIN").columns
    near, far = api.neighborhood(ws, "PAYMAIN"), api.neighborhood(ws, "PAYMAIN", 2, include_homonyms=True)
    assert 0 < near.count() < far.count()


def test_documents_and_renderings(ws):
    from tracelode.operators import export

    d = commands.doc(ws)
    assert "program:PAYMAIN" in {r["id"] for r in d["programs"].collect()} and d["jobs"].count() == 1 and d["tables"].count() > 0
    text = export.verify_markdown(commands.verify(ws), "Pay")
    assert text.startswith("# Pay") and "## gaps" in text and "notes.txt" in text
    assert "EXEC" in export.mermaid_batch(ws.read("steps"), "PAYJOB")


def test_views_and_semantic_objects(ws):
    late = commands.focused(ws, "PAYMAIN", "focused", seconds=0.001)
    assert late["status"].first()["status"] == "partial" and late["subjects"].count() <= 18
    d = commands.analyze(ws, ["PAYMAIN"], trace="reverse")
    assert "lineage" not in d and d["resolution"].first()["status"] in ("resolved", "weak") and d["decisions"].count() > 0 and d["glossary"].filter("term = 'PAYMAIN'").count() == 1
    assert d["phase_items"].count() > 0 and commands.domain(ws, "x").id == "generic"
