"""Semantic objects, state machines, views with a deadline and renderings."""

import time

import pytest
from pyspark.sql import functions as F

from tracelode.operators import executive, export, packs, phases, semantics


@pytest.fixture(scope="module")
def world(spark):
    e = [("program:A", "program", "A", None), ("table:T", "table", "T", None), ("dataset:REMESSA", "dataset", "REMESSA", None), ("field:STATUS-X", "field", "STATUS-X", None), ("field:N", "field", "N", "campo de ERRO"), ("component:LIB.DLL", "component", "LIB.DLL", None), ("copybook:B", "copybook", "B", None), ("procedure:P", "procedure", "P", None)]
    entities = spark.createDataFrame([(*x, 0.5, False) for x in e], "id string, type string, label string, description string, confidence double, inferred boolean")
    r = [("READS", "program:A", "table:T"), ("WRITES", "program:A", "dataset:REMESSA"), ("VALIDATES", "program:A", "field:STATUS-X"), ("VALIDATES", "program:A", "field:N"), ("DATA_CONTRACT", "program:A", "program:A"), ("CALLS", "program:A", "program:ABEND")]
    relations = spark.createDataFrame([("q", *x, None, ["f:1"]) for x in r], "seed string, rel string, from_id string, to_id string, confidence double, evidence array<string>")
    out = phases.assembled(phases.journey(relations, entities), relations, entities)
    members = entities.select(F.lit("q").alias("seed"), "id")
    roles = spark.createDataFrame([("table:T", "domain")], "id string, role string")
    return out, relations, entities, members, semantics.objects(out["phases"], out["items"], relations, entities, members, roles)


def test_decisions_rules_and_contingencies(world):
    got = world[4]
    d = {r["id"]: r["rule"] for r in got["decisions"].collect()}
    assert d == {"decision:2:A VALIDATES N": "A VALIDATES N", "decision:2:A VALIDATES STATUS-X": "A VALIDATES STATUS-X", "decision:rel:program:A:VALIDATES:field:N": "A --VALIDATES--> N", "decision:rel:program:A:VALIDATES:field:STATUS-X": "A --VALIDATES--> STATUS-X"}
    rules = {r["id"]: r["confidence"] for r in got["business_rules"].collect()}
    assert len(rules) == 7 and rules["business-rule:rel:program:A:DATA_CONTRACT:program:A"] == 0.72
    assert {r["id"] for r in got["contingencies"].collect()} == {"error:entity:field:N", "error:rel:program:A:CALLS:program:ABEND"}


def test_transfers_messages_states_and_glossary(world):
    got = world[4]
    t = {(r["label"], r["direction"]) for r in got["transfers"].collect()}
    assert {x for x in t if x[1] != "handoff"} == {("REMESSA", "outbound"), ("T", "inbound")} and {x[0] for x in t if x[1] == "handoff"} <= {"REMESSA", "T", "artefato intermediario"}
    m = {r["id"]: r["inferred"] for r in got["messages"].collect()}
    assert m["message:entity:dataset:REMESSA"] is False and any(k.startswith("message:transfer:") for k in m)
    assert [(r["label"], r["inferred"], r["next"]) for r in got["state_items"].collect()] == [("STATUS-X", False, None)]
    g = {(r["term"], r["type"]) for r in got["glossary"].collect()}
    assert {("A", "ator"), ("LIB.DLL", "sistema-externo"), ("LIB.DLL", "ator"), ("P", "stored-procedure"), ("B", "layout"), ("T", "tabela")} <= g


def test_states_are_phases_where_nothing_is_named_so(spark, world):
    out, _, entities, members, _ = world
    s = semantics.states(out["phases"], entities.filter("type <> 'field'"), members).orderBy("place").collect()
    assert len(s) == out["phases"].count() and all(r["inferred"] for r in s) and s[0]["next"] == s[1]["label"] and s[-1]["next"] is None


def test_channels(spark):
    df = spark.createDataFrame([("pelo ISD",), ("cnab400 novo",), ("nada",), ("RETORNO",)], "v string")
    assert [tuple(r) for r in df.select(semantics.channel(F.col("v")), semantics.channel(F.col("v"), packs.CESSAO)).collect()] == [("ISD", "ISD"), ("CNAB400", "CNAB400"), ("ARQUIVO", "ARQUIVO"), ("ARQUIVO", "RETORNO")]


def test_machine(spark):
    rows = [("a", 1, "new"), ("a", 2, "new"), ("a", 3, "open"), ("a", 4, "done"), ("b", 1, "new"), ("b", 2, "open"), ("b", 3, "new"), ("b", 4, "done"), ("c", 1, None), ("c", 2, "loop"), ("c", 3, "again"), ("c", 4, "loop")]
    t = semantics.transitions(spark.createDataFrame(rows, "who string, k int, s string"), ["who"], ["k"], "s")
    got = {(r["state"], r["next"]): (r["n"], r["subjects"]) for r in t.collect()}
    assert got == {("new", "open"): (2, 2), ("open", "done"): (1, 1), ("open", "new"): (1, 1), ("new", "done"): (1, 1), ("done", None): (2, 2), (None, "loop"): (1, 1), ("loop", "again"): (1, 1), ("again", "loop"): (1, 1), ("loop", None): (1, 1)}
    m = {r["state"]: (r["n_out"], r["n_ends"], r["closed"], r["depth"]) for r in semantics.machine(t.filter("not (state <=> 'loop' and next is null)")).collect()}
    assert m["done"] == (0, 2, True, 0) and m["open"] == (2, 0, True, 1) and m["loop"][2:] == (False, None) and m[None][2] is False


def test_deadline(spark):
    slow = spark.range(0, 40, 1, 40).select(F.udf(lambda x: time.sleep(0.5) or x, "long")("id").alias("id"))
    began = time.time()
    status, out = executive.in_time(spark, 1.0, lambda: {"nodes": slow}, lambda: {"nodes": spark.range(3)})
    assert status == "partial" and out["nodes"].count() == 3 and time.time() - began < 15
    status, out = executive.in_time(spark, 60.0, lambda: {"nodes": spark.range(5)}, lambda: {"nodes": spark.range(3)})
    assert status == "complete" and out["nodes"].count() == 5
    with pytest.raises(ZeroDivisionError):
        executive.in_time(spark, 60.0, lambda: 1 / 0, lambda: {})


def test_renderings(spark, world):
    out, *_, objects = world
    text = export.mermaid_phases(out["phases"], "q").splitlines()
    assert text[0] == "flowchart LR" and sum("-->" in x for x in text) == out["phases"].count() - 1
    assert export.mermaid_states(objects["state_items"], "q").splitlines() == ["stateDiagram-v2", "  [*] --> n_state_field_STATUS_X", "  n_state_field_STATUS_X: STATUS-X"]
    steps = spark.createDataFrame([("J", "step:2", "two", 2, [], [("d:I", "READS"), ("d:O", "WRITES")]), ("J", "step:1", 'o"ne', 1, ["p"], None)], "job string, step string, label string, seq int, programs array<string>, datasets array<struct<id:string,op:string>>")
    assert export.mermaid_batch(steps, "j").splitlines() == ["graph TD", '  n_job_J["JOB: J"] --> n_step_1["STEP: o\'ne"]', '  n_step_1 -->|EXEC| n_p["p"]', '  n_step_1 --> n_step_2["STEP: two"]', '  n_d_I["d:I"] -->|READ| n_step_2', '  n_step_2 -->|WRITE| n_d_O["d:O"]']
    assert "No steps" in export.mermaid_batch(steps, "none")
    traces = spark.createDataFrame([("t", 0, "t", None), ("t", 1, "a", "WRITES"), ("t", 2, "b", "CALLS")], "terminal string, hop int, id string, rel string")
    assert export.mermaid_reverse(traces).splitlines() == ["flowchart RL", '  n_t["t"]', "  n_t -->|WRITES| n_a", "  n_a -->|CALLS| n_b"]
    rep = {k: spark.createDataFrame([("x", 1)], "k string, n int") for k in ("report", "types", "rels", "dialects", "buckets", "hotspots", "entrypoints", "isolated", "gaps")}
    assert "## hotspots\n\n| k | n |\n| --- | --- |\n| x | 1 |" in export.verify_markdown(rep)
