"""Queries over whole tables, on a few rows whose results are plain to see; most lines are later than 1995."""

import duckdb
import pytest

from tracelode.plans import question_queries, table_queries

TABLES = {
    "documents": "SELECT * FROM (VALUES (1::BIGINT, 'Ein Satz mit mehr als vierzig Zeichen, dann Straße und Ende.'), (2, '--'), (3, NULL)) t(doc_id, text)",
    "region": "SELECT 0::BIGINT AS r_regionkey, 'R' AS r_name",
    "nation": "SELECT * FROM (VALUES (0::BIGINT, 'N0', 0::BIGINT), (1, 'N1', 0)) t(n_nationkey, n_name, n_regionkey)",
    "customer": "SELECT 1::BIGINT AS c_custkey, 'C1' AS c_name, 1::BIGINT AS c_nationkey, -5.0::DOUBLE AS c_acctbal",
    "supplier": "SELECT * FROM (VALUES (1::BIGINT, 'S1', 0::BIGINT, 1.0::DOUBLE), (2, 'S2', 1, -1.0)) t(s_suppkey, s_name, s_nationkey, s_acctbal)",
    "part": "SELECT * FROM (VALUES (1::BIGINT, 'P1', 10::BIGINT), (2, 'P2', 2), (3, 'P3', 3), (4, 'P4', 1), (5, 'P5', 20)) t(p_partkey, p_name, p_size)",
    "orders": "SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 'O'), (2, 1, 'P')) t(o_orderkey, o_custkey, o_orderstatus)",
    "lineitem": """SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT, 0.0::DOUBLE, 'R', TIMESTAMP '1995-01-10', 10.0::DOUBLE), (1, 2, 2, 1, 0.1, 'A', '2001-06-01', 50.0),
        (2, 1, 3, 2, 0.05, 'N', '1999-01-01', 5.0), (2, 2, 3, 2, 0.0, 'R', '2000-01-01', 5.0)) t(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_returnflag, l_shipdate, l_quantity)""",
}


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    for name, sql in TABLES.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def rows(spark, name, small, *columns):
    return sorted(tuple(r[c] for c in columns) for r in table_queries.QUERIES[name](spark, small).collect())


def test_closure_of_all_lines(spark, small):
    assert rows(spark, "program_closure", small, "start", "id", "op") == [("nation:0", "part:1", "READS"), ("nation:0", "part:2", "WRITES"), ("nation:1", "part:3", "READS")]
    assert rows(spark, "flow_confidence", small, "start", "confidence", "n_edges") == [("nation:0", 0.65, 2), ("nation:1", 0.825, 2)]


def test_export_and_endpoints_of_all_lines(spark, small):
    assert rows(spark, "csv_edges_expanded", small, "rel", "to_id", "evidence") == [("READS", "part:1", "1:1"), ("READS", "part:3", "2:2"), ("UPDATES", "part:3", "2:1"), ("WRITES", "part:2", "1:2")]
    assert rows(spark, "resolve_endpoint", small, "name", "to_id", "n") == [("P1", "part:1", 1), ("P2", "part:2", 1), ("P3", "part:3", 2)]


def test_anti_joins_with_all_lines(spark, small):
    assert rows(spark, "lib_not_exists", small, "id") == [("customer:1",), ("nation:0",), ("nation:1",), ("part:4",), ("part:5",), ("region:0",)]
    assert rows(spark, "prune_inferred", small, "id") == [("part:1",), ("part:2",), ("part:3",), ("part:5",)]


def test_slug_of_whole_text(spark, small):
    assert rows(spark, "slugify", small, "doc_id", "slug") == [(1, "ein-satz-mit-mehr-als-vierzig-zeichen-dann-stra-e-und-ende"), (2, "query"), (3, "query")]


def test_pending_of_all_kinds(spark, small):
    want = [("entity", n) for n in ("C1", "P2", "P3", "P4", "S2", "order:2")] + [("relation", "supplier:1|WRITES|part:2")]
    assert rows(spark, "pending_filter", small, "kind", "name") == want


def test_merges_read_a_line_once(spark, small):
    """A join with a table of fixed values is a nested loop that reads all lines once for each of its partitions."""
    for name in ("merge_relation", "merge_relation_again"):
        plan = table_queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(spark, "merge_relation_again", small, "rel", "to_id", "evidence", "confidence") == [("READS", "part:1", "1:1", 1.0), ("READS", "part:3", "2:2", 1.0), ("UPDATES", "part:3", "2:1", 0.65), ("WRITES", "part:2", "1:2", 0.3)]


def test_parts_of_flows_are_made_once(spark, monkeypatch):
    """Parts of flows are written before phases are made of them, and no pair of suppliers is made before the flows are whole."""
    given, plain = [], question_queries.P.program
    monkeypatch.setattr(question_queries.P, "program", lambda of, parts: given.append(parts) or plain(of, parts))
    flows, parts_of = [], question_queries.P.flow_parts
    monkeypatch.setattr(question_queries.P, "flow_parts", lambda f, e: flows.append(f) or parts_of(f, e))
    question_queries.QUERIES["phases_program"](spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(given[0]) and "Generate" not in plan(given[0])
    last = plan(flows[0]).splitlines()
    assert not any("Aggregate" in x for x in last[: next(i for i, x in enumerate(last) if "Join" in x)])


def test_events_of_batch_steps_are_made_once(spark, monkeypatch):
    """Items and members of batch phases come from written events, and names and evidence are not ranked where only their numbers are asked for."""
    given, plain = [], question_queries.P.batch
    monkeypatch.setattr(question_queries.P, "batch", lambda *a: given.append(plain(*a)) or given[0])
    out = question_queries.QUERIES["phases_batch"](spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan(t) for t in given[0][1:] for x in ("Join", "Window"))
    assert "Window" not in plan(out)


def test_suppliers_of_a_nation_are_not_paired(spark, monkeypatch, tmp_path):
    """A flow has its entry and the first other supplier by itself; the rest of the nation is a list that is counted once, with the results of the SQL."""
    for name, ddl, data in (
        ("supplier", "s_suppkey bigint, s_nationkey int", [(k, k // 7) for k in range(1, 16)]), ("part", "p_partkey bigint, p_size int", [(1, 5), (2, 4), (3, 3)]),
        ("orders", "o_orderkey bigint", [(1,)]), ("lineitem", "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint", [(1, 1, 1, 2), (1, 2, 2, 2), (1, 3, 3, 5), (1, 4, 2, 9)]),
    ):
        spark.createDataFrame(data, ddl).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    given, plain = [], question_queries.P.program
    monkeypatch.setattr(question_queries.P, "program", lambda of, parts: given.append(parts) or plain(of, parts))
    df = question_queries.QUERIES["phases_program"](spark, str(tmp_path))
    assert given[0].filter("part = 'program'").count() == 15 * 2
    con = duckdb.connect()
    for name in ("supplier", "part", "orders", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(question_queries.ORACLE["phases_program"]).project(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)
    # lists give the same phases as their members written out, also as rows
    P = question_queries.P
    schema = "id string, type string, name string, label string, confidence double, files array<string>, line int"
    e = spark.createDataFrame([(k, "table" if k == "c" else "program", t, t, c, [k], 1) for k, t, c in (("a", "X", 0.5), ("b", "X", 0.25), ("c", "Y", 1.0), ("d", "Z", 0.75))], schema)
    r = spark.createDataFrame([("s", "CALLS", "b", "d", 0.5, ["f:1"]), ("t", "CALLS", "c", "q", 1.0, ["f:2"])], "seed string, rel string, from_id string, to_id string, confidence double, evidence array<string>")
    defs = P.fixed(spark.createDataFrame([("s", 2), ("t", 2)], "seed string, pos int"), P.PROGRAM)
    items = [("s", 2, "programs", "X"), ("t", 2, "programs", "Z")]
    members = [("s", 2, "b"), ("t", 2, "d"), ("t", 2, "c")]
    frame = lambda i, m: (defs, spark.createDataFrame(i, "seed string, pos int, field string, value string"), spark.createDataFrame(m, "seed string, pos int, id string"))
    uses = spark.createDataFrame([("s", 2, "programs", "l", "a"), ("t", 2, "programs", "l", "c")], "seed string, pos int, field string, list string, but string")
    lists = spark.createDataFrame([("l", "a", "X"), ("l", "b", "X"), ("l", "c", "Y")], "list string, id string, label string")
    one = P.assembled(frame(items, members), r, e, (uses, lists))
    two = P.assembled(frame([*items, ("s", 2, "programs", "Y"), ("t", 2, "programs", "X")], [*members, ("s", 2, "c"), ("t", 2, "a"), ("t", 2, "b")]), r, e)
    for k in one:
        assert sorted(map(str, one[k].collect())) == sorted(map(str, two[k].collect())), k
