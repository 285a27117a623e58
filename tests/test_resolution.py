"""Resolution of questions, lineage summaries and views, on a graph whose results are plain to see."""

import pytest
from pyspark.sql import functions as F

from tracelode.functions import text
from tracelode.operators import executive, packs, resolution


@pytest.fixture(scope="module")
def small(spark):
    e = [("job:NIGHT", "job", "NIGHT", "NIGHT"), ("program:PAY", "program", "PAY", "PAY"), ("program:PAYX", "program", "PAYX", "PAYX"), ("table:LEDGER", "table", "LEDGER", "LEDGER"), ("dataset:OUT", "dataset", "OUT", "OUT"), ("screen:FRM", "screen", "FRM", "FRM"), ("component:LIB.DLL", "component", "LIB.DLL", "LIB.DLL"), ("field:PAY-AMT", "field", "PAY-AMT", "PAY-AMT"), ("step:S1", "step", "S1", "S1")]
    r = [("EXECUTES", "job:NIGHT", "program:PAY"), ("CALLS", "program:PAY", "program:PAYX"), ("READS", "program:PAY", "table:LEDGER"), ("UPDATES", "program:PAYX", "table:LEDGER"), ("WRITES", "program:PAY", "dataset:OUT"), ("USES_DLL", "screen:FRM", "component:LIB.DLL"), ("CALLS_SP", "screen:FRM", "table:LEDGER"), ("VALIDATES", "program:PAY", "field:PAY-AMT"), ("DATA_CONTRACT", "program:PAY", "program:PAYX")]
    entities = spark.createDataFrame([(*x, False, 1.0) for x in e], "id string, type string, name string, label string, inferred boolean, confidence double")
    return entities, spark.createDataFrame([(*x, 0.5) for x in r], "rel string, from_id string, to_id string, confidence double")


def test_seed_types(small):
    kinds = lambda seed_type: {r["type"] for r in resolution.accepted(small[0], seed_type).collect()}
    every = {"job", "program", "table", "dataset", "screen", "component", "field", "step"}
    assert kinds(None) == kinds("feature") == kinds("functionality") == kinds("other") == every
    assert kinds("batch") == {"job", "step", "program", "dataset"} and kinds("SCREEN") == kinds("vb6") == {"screen", "component"}
    assert kinds("field") == {"field"} and kinds("column") == kinds("stored-procedure") == set()


def test_stop_words_and_bare_letters(spark):
    df = spark.createDataFrame([("desconto pagamento",), ("PAG-AMENTO",), ("com",), ("de pagamento com desconto",), ("x",)], "v string")
    score = lambda q, v, s=text.RESOLUTION: df.filter(F.col("v") == v).select(text.score_text(F.lit(q), F.array("v"), s)).first()[0]
    assert score("pagamento com desconto", "desconto pagamento") == 106 and score("pagamento", "PAG-AMENTO") == 180
    assert score("pagamento com desconto", "com") == 120 and score("de", "x") == 0
    assert score("pagamento com desconto", "de pagamento com desconto") == 120 and score("um pagamento com desconto novo", "de pagamento com desconto") == 2 * 26 + 14
    assert score("com", "com") == 0 and score("com", "com", text.EXECUTIVE) == 160


def test_terminals_and_bridges(small):
    t = {r["id"]: (r["score"], r["terminal_score"]) for r in resolution.terminals(*small, "ledger").collect()}
    assert t == {"table:LEDGER": (180 + 30 + 20, 0)}
    t = {r["id"]: r["score"] for r in resolution.terminals(*small, "out").collect()}
    assert t == {"dataset:OUT": 180 + 20 + 20}
    b = {r["id"]: r["score"] for r in resolution.bridges(*small, "night").collect()}
    assert b == {"job:NIGHT": 180, "screen:FRM": 18, "component:LIB.DLL": 18, "table:LEDGER": 18}


def test_pack_patterns(spark):
    df = spark.createDataFrame([("RETORNO",), ("PR_TERMO_X PR_TERMO",), ("via CIP",), ("plain",)], "v string")
    rows = [tuple(r) for r in df.select(packs.terminal_score(F.col("v"), packs.CESSAO), packs.handoff_score(F.col("v"), packs.CESSAO), packs.terminal_score(F.col("v"), packs.GENERIC)).collect()]
    assert rows == [(12, 24, 12), (40, 0, 12), (28, 24, 0), (0, 0, 0)]
    values = spark.createDataFrame([("termo de cess\u00e3o",), ("x",)], "value string")
    assert packs.chosen(values) is packs.GENERIC and packs.chosen(values.union(values.sparkSession.createDataFrame([("CNAB600",)], "value string"))) is packs.CESSAO
    assert packs.chosen(values, "cessao-c3") is packs.CESSAO and packs.chosen(values, "nothing") is packs.GENERIC


FLOW = "entry_id string, type string, entry_label string, entry_name string, summary string, subject_ids array<string>, tokens array<string>, programs array<string>, procedures array<string>, data_objects array<string>, confidence double"


def test_resolve_target(spark, small):
    flows = spark.createDataFrame([("job:NIGHT", "batch", "NIGHT", "NIGHT", "night run", ["program:PAY"], [], ["PAY"], [], ["LEDGER"], 0.9)], FLOW)
    out = resolution.resolve_target(*small, flows, "pay")
    picked = out["selection"].first()
    assert picked["anchor_id"] == "program:PAY" and picked["status"] == "resolved" and picked["category"] == "feature_cluster"
    ids = {r["id"] for r in out["candidates"].collect()}
    assert {"candidate:entity:program:PAY", "candidate:entity:program:PAYX", "candidate:entity:field:PAY-AMT"} <= ids
    assert {"program:PAY", "job:NIGHT", "table:LEDGER"} <= {r["id"] for r in out["subjects"].collect()}
    flow = resolution.resolve_target(*small, flows, "night", "batch")["selection"].first()
    assert flow["anchor_id"] == "job:NIGHT"
    assert resolution.resolve_target(*small, flows, "nothing like it at all")["candidates"].filter("anchor_type = 'field'").count() == 0


def test_weak_anchor_is_blocked_or_gives_way(spark):
    e = spark.createDataFrame([("field:LONE-AMT", "field", "LONE-AMT", "LONE-AMT", False, 1.0)], "id string, type string, name string, label string, inferred boolean, confidence double")
    r = spark.createDataFrame([], "rel string, from_id string, to_id string, confidence double")
    out = resolution.resolve_target(e, r, spark.createDataFrame([], FLOW), "lone-amt")
    assert out["selection"].first()["status"] == "blocked" and out["selection"].first()["score"] == 180 + 2 - 28 + 8 + 2 + 10 + 14 - 70
    assert resolution.resolve_target(e.limit(0), r, spark.createDataFrame([], FLOW), "x")["selection"].count() == 0


def test_refinement_adopts_what_is_missing(spark):
    e = [("program:ALPHA", "program", "ALPHA"), ("program:ALPHB", "program", "ALPHB"), ("table:T", "table", "T"), ("dataset:D", "dataset", "D"), ("field:ERRO-X", "field", "ERRO-X")]
    entities = spark.createDataFrame([(i, k, n, n, False, 0.5) for i, k, n in e], "id string, type string, name string, label string, inferred boolean, confidence double")
    rels = spark.createDataFrame([("UPDATES", "program:ALPHB", "table:T", 0.5), ("WRITES", "program:ALPHB", "dataset:D", 0.5)], "rel string, from_id string, to_id string, confidence double")
    flows = spark.createDataFrame([], FLOW)
    ranking, nodes = resolution.candidates(entities, rels, flows, "alpha")
    alone = ranking.filter("anchor_id = 'program:ALPHA'").drop("place").withColumn("place", F.lit(1))
    better, adopted = resolution.refined(alone, ranking.filter("anchor_id <> 'program:ALPHA'").withColumn("place", F.lit(2)).withColumn("score", F.lit(500)), nodes, entities, rels, flows, "alpha")
    got = better.first()
    assert [r["label"] for r in adopted.collect()] == ["ALPHB"] and got["has_persistence"] and got["has_outputs"] and got["n_platforms"] == 3
    assert got["score"] == got["base_score"] + 100 + 3 * 12 + 16 + 12 + 20 + (3 * 14 + 24) + 18
    assert resolution.resolve_target(entities, rels, flows, "alpha", autonomous=False)["adopted"].count() == 0


def test_clusters_stop_at_their_size(spark):
    rels = spark.createDataFrame([("CALLS", "a", f"b{k:03d}", 1.0) for k in range(300)] + [("CALLS", "b000", "c", 1.0), ("KNOWS", "a", "x", 1.0)], "rel string, from_id string, to_id string, confidence double")
    seeds = spark.createDataFrame([("one", "a", 4, 20), ("two", "c", 1, 20), ("two", "b001", 1, 20)], "candidate string, id string, hops int, most int")
    got = {}
    for r in resolution.grown(seeds, rels, 4).collect():
        got.setdefault(r["candidate"], set()).add(r["id"])
    assert got["one"] == {"a", *[f"b{k:03d}" for k in range(19)]} and got["two"] == {"c", "b000", "b001", "a"}


def test_lineage_summary(spark, small):
    r = small[1].crossJoin(spark.createDataFrame([("one",)], "seed string"))
    got = {}
    for x in executive.lineage_summary(r, small[0]).collect():
        got.setdefault(x["kind"], set()).add(x["label"])
    assert got == {"inputs": {"LEDGER"}, "chain": {"NIGHT", "PAY", "PAYX", "FRM", "LIB.DLL", "LEDGER"}, "persistence": {"LEDGER"}, "outputs": {"OUT"}, "contracts": {"PAY -> PAYX"}, "terminals": {"LEDGER", "OUT"}}
    assert executive.lineage_summary(r, small[0], shown={**executive.SHOWN, "chain": 1}).filter("kind = 'chain'").collect()[0]["label"] == "PAY"


def test_budget_keeps_the_focus(spark, small):
    focus = spark.createDataFrame([("component:LIB.DLL",)], "id string")
    nodes, edges = executive.within_budget(*small, executive.Profile(1, 3, 2), focus)
    ids = {r["id"] for r in nodes.collect()}
    assert "component:LIB.DLL" in ids and len(ids) == 3 and "program:PAY" in ids and edges.count() <= 2


def test_focused_view(spark, small):
    flows = spark.createDataFrame([("job:NIGHT", ["PAY", "PAYX"], [], ["LEDGER"], ["program:PAY"]), ("screen:FRM", [], [], ["LEDGER"], ["screen:FRM"])], "entry_id string, programs array<string>, procedures array<string>, data_objects array<string>, subject_ids array<string>")
    view = executive.focused_view(spark.createDataFrame([("program:PAYX",)], "id string"), *small, flows)
    assert [r["entry_id"] for r in view["flows"].collect()] == ["job:NIGHT", "screen:FRM"] and view["subjects"].first()["id"] == "program:PAYX"
    assert view["nodes"].filter("id = 'component:LIB.DLL'").isEmpty() and view["edges"].filter("rel = 'CALLS'").count() == 1


def test_field_and_table_search(small):
    fields, users = executive.field_search(*small, "amt")
    assert [r["id"] for r in fields.collect()] == ["field:PAY-AMT"] and [r["id"] for r in users.collect()] == ["program:PAY"]
    table, used = executive.table_search(*small, "ledger")
    assert table.count() == 1 and {(r["id"], r["rel"]) for r in used.collect()} == {("program:PAY", "READS"), ("program:PAYX", "UPDATES")}


def test_ends_that_say_the_same_are_resolved_once(spark, monkeypatch):
    """Written are ends, not relations with their ends; the file counts only where it is part of an id."""
    from tracelode.functions import schema
    from tracelode.operators import model

    written, plain = [], model.cut
    monkeypatch.setattr(model, "cut", lambda df: written.append(plain(df)) or written[-1])
    entities = schema.shaped(spark.createDataFrame([("program:A", "program", "A", "A")], "id string, type string, name string, label string"), schema.ENTITY)
    raw = spark.createDataFrame([("CALLS", "a", "program", "b", "program", f"f{k}") for k in range(9)] + [("PERFORMS", "a", "program", "p", "paragraph", f"f{k % 2}") for k in range(4)], "rel string, `from` string, fromType string, `to` string, toType string, file string")
    out, made = model.resolve_endpoints(raw, entities)
    assert [w.count() for w in written] == [5, 5]
    assert {(r["from_id"], r["to_id"], r["n"]) for r in out.groupBy("from_id", "to_id").agg({"*": "count"}).toDF("from_id", "to_id", "n").collect()} == {("program:A", "program:B", 9), ("program:A", "paragraph:P@F0", 2), ("program:A", "paragraph:P@F1", 2)}
    assert {(r["id"], len(r["files"])) for r in made.collect()} == {("program:B", 9), ("paragraph:P@F0", 1), ("paragraph:P@F1", 1)}
