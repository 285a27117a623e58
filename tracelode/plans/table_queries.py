"""Queries over the given tables, with the DuckDB SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema
from ..functions import text as X
from ..functions.identity import platform
from ..operators import catalog, changes, coverage, dossier, filters, flows, graph, model, ordering, search
from ..sources import files
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CALL_SHARE = 1.6
ENTITIES = """e AS (
  SELECT 'region:' || r_regionkey AS id, 'region' AS type, r_name AS name, NULL::VARCHAR AS parent, 1.0::DOUBLE AS confidence, false AS inferred FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'region:' || n_regionkey, 1.0, false FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'nation:' || c_nationkey, 0.9, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'nation:' || s_nationkey, 0.9, s_acctbal < 0 FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, NULL, 0.8, p_size < 5 FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order', 'order:' || o_orderkey, 'customer:' || o_custkey, 0.7, o_orderstatus = 'P' FROM orders)"""
ACCESSES = """a AS (SELECT CASE l_returnflag WHEN 'R' THEN 'READS' WHEN 'A' THEN 'WRITES' ELSE 'UPDATES' END AS rel, 'supplier:' || l_suppkey AS from_id,
  'part:' || l_partkey AS to_id, round(1 - l_discount * 7, 2) AS confidence, l_orderkey || ':' || l_linenumber AS evidence, l_shipdate FROM lineitem)"""
CALLS = f"""g AS (SELECT 'nation:' || s_nationkey AS from_id, 'nation:' || c_nationkey AS to_id, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
c AS (SELECT 'CALLS' AS rel, from_id, to_id, n FROM g WHERE n > (SELECT avg(n) FROM g) * {CALL_SHARE})"""
IMPACT = f"""{CALLS}, {ACCESSES}, {ENTITIES},
m AS (SELECT rel, from_id, to_id FROM c UNION ALL SELECT 'CONTAINS', parent, id FROM e WHERE type IN ('nation', 'supplier') UNION ALL SELECT DISTINCT rel, from_id, to_id FROM a)"""


def query(oracle: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return keep


def impact_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Nations call nations, contain suppliers, and suppliers access parts."""
    inside = T.contains(spark, sf, orders=False).filter(F.startswith("to_id", F.lit("nation:")) | F.startswith("to_id", F.lit("supplier:")))
    return T.calls(spark, sf, CALL_SHARE).select("rel", "from_id", "to_id").union(inside.select("rel", "from_id", "to_id")).union(T.accesses(spark, sf).select("rel", "from_id", "to_id").distinct())


def seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def merged(spark: SparkSession, sf: str) -> DataFrame:
    """Accesses merged into one edge for each (rel, from_id, to_id)."""
    return T.accesses(spark, sf).groupBy("rel", "from_id", "to_id").agg(F.max("confidence").alias("confidence"), F.count_distinct("evidence").alias("n_evidence"))


# --- graph -------------------------------------------------------------------------------------


def walk_sql(seed: str, depth: int, edges: str = "m", direction: str = "downstream") -> str:
    moves = {"downstream": f"SELECT from_id AS src, to_id AS nxt FROM {edges}", "upstream": f"SELECT to_id, from_id FROM {edges}"}
    moves = moves.get(direction, f"{moves['downstream']} UNION SELECT to_id, from_id FROM {edges}").replace("SELECT to_id, from_id", "SELECT to_id AS src, from_id AS nxt")
    return f"""mv AS (SELECT DISTINCT src, nxt FROM ({moves})), w AS (SELECT '{seed}' AS id, 0 AS depth UNION SELECT nxt, depth + 1 FROM w JOIN mv ON w.id = mv.src WHERE depth < {depth}),
v AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)"""


@query(f"WITH RECURSIVE {IMPACT}, {walk_sql('nation:7', 3)} SELECT m.rel, m.from_id, m.to_id, v.depth::INT AS depth FROM m JOIN v ON m.from_id = v.id")
def impact_downstream(spark, sf):
    return graph.traverse(seeds(spark, "nation:7"), impact_edges(spark, sf), "downstream", 3)


@query(f"WITH RECURSIVE {IMPACT}, {walk_sql('part:20', 2, direction='upstream')} SELECT m.rel, m.from_id, m.to_id, v.depth::INT AS depth FROM m JOIN v ON m.to_id = v.id")
def impact_upstream(spark, sf):
    return graph.traverse(seeds(spark, "part:20"), impact_edges(spark, sf), "upstream", 2)


@query(f"WITH RECURSIVE {IMPACT}, {walk_sql('supplier:3', 1, direction='both')} SELECT rel, from_id, to_id, min(depth)::INT AS depth FROM (SELECT m.*, depth FROM m JOIN v ON m.from_id = v.id UNION ALL SELECT m.*, depth FROM m JOIN v ON m.to_id = v.id) GROUP BY ALL")
def impact_both(spark, sf):
    return graph.traverse(seeds(spark, "supplier:3"), impact_edges(spark, sf), "both", 1)


@query(f"WITH RECURSIVE {IMPACT}, {walk_sql('nation:7', 2)} SELECT DISTINCT id FROM (SELECT m.from_id AS id FROM m JOIN v ON m.from_id = v.id UNION ALL SELECT m.to_id FROM m JOIN v ON m.from_id = v.id) WHERE id <> 'nation:7'")
def impact_affected(spark, sf):
    return graph.affected(seeds(spark, "nation:7"), impact_edges(spark, sf), "downstream", 2)


@query(f"""WITH RECURSIVE {CALLS}, {ACCESSES}, {ENTITIES}, m AS (SELECT rel, from_id, to_id, max(confidence) AS confidence FROM a GROUP BY ALL), {walk_sql('supplier:3', 1, direction='both')}
SELECT from_id, to_id, rel, min(depth)::INT AS depth FROM (SELECT m.*, depth FROM m JOIN v ON m.from_id = v.id UNION ALL SELECT m.*, depth FROM m JOIN v ON m.to_id = v.id) WHERE rel IN ('READS', 'WRITES') AND confidence >= 0.6 GROUP BY from_id, to_id, rel ORDER BY depth, from_id, to_id, rel LIMIT 5000""")
def neighborhood(spark, sf):
    return graph.neighborhood(seeds(spark, "supplier:3"), merged(spark, sf), 1, ["READS", "WRITES"], 0.6)


@query(f"WITH RECURSIVE {IMPACT}, u AS (SELECT * FROM m WHERE rel IN ('READS', 'WRITES', 'CONTAINS', 'CALLS')), {walk_sql('part:11', 20, 'u', 'upstream')} SELECT id, depth::INT AS depth, id NOT IN (SELECT to_id FROM u) AS is_entry FROM v")
def reverse_trace(spark, sf):
    nodes, entries = graph.reverse_trace(seeds(spark, "part:11"), impact_edges(spark, sf), ["READS", "WRITES", "CONTAINS", "CALLS"], 20)
    return nodes.join(entries.select("id", F.lit(True).alias("e")), "id", "left").select("id", "depth", F.coalesce("e", F.lit(False)).alias("is_entry"))


@query(f"""WITH RECURSIVE {ACCESSES}, {ENTITIES}, m AS (SELECT rel, from_id, to_id, max(confidence) AS confidence FROM a GROUP BY ALL UNION ALL SELECT 'CONTAINS', parent, id, confidence FROM e WHERE type IN ('nation', 'supplier')),
p AS (SELECT to_id, from_id AS parent, rel FROM m QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY CASE rel WHEN 'WRITES' THEN 3 WHEN 'UPDATES' THEN 2 ELSE 1 END DESC, confidence DESC, from_id, rel) = 1),
t AS (SELECT id AS terminal, 0 AS hop, id, NULL::VARCHAR AS rel FROM e WHERE type = 'part' UNION ALL SELECT terminal, hop + 1, parent, p.rel FROM t JOIN p ON t.id = p.to_id WHERE hop < 8)
SELECT terminal, hop::INT AS hop, id, rel FROM t""")
def trace_back(spark, sf):
    inside = T.contains(spark, sf, orders=False).filter(F.startswith("to_id", F.lit("nation:")) | F.startswith("to_id", F.lit("supplier:")))
    edges = merged(spark, sf).drop("n_evidence").unionByName(inside)
    parts = T.table(spark, sf, "part").select(T.key("part", "p_partkey").alias("id"))
    return graph.trace_back(parts, edges, F.when(F.col("rel") == "WRITES", 3).when(F.col("rel") == "UPDATES", 2).otherwise(1), 8)


@query(f"WITH {CALLS} SELECT DISTINCT from_id AS id FROM c WHERE from_id NOT IN (SELECT to_id FROM c WHERE from_id <> to_id)")
def find_roots(spark, sf):
    return graph.roots(T.calls(spark, sf, CALL_SHARE))


@query(f"""WITH RECURSIVE {CALLS}, m AS (SELECT * FROM c), {walk_sql('nation:7', 3)}, x AS (SELECT from_id, to_id, depth FROM m JOIN v ON m.from_id = v.id),
r AS (SELECT DISTINCT to_id AS start, to_id AS id, 0 AS d FROM x UNION SELECT r.start, x.to_id, d + 1 FROM r JOIN x ON r.id = x.from_id WHERE d < 4)
SELECT from_id, to_id, depth::INT AS depth, EXISTS (SELECT 1 FROM r WHERE r.start = x.to_id AND r.id = x.from_id) AS is_back_edge FROM x""")
def get_chain(spark, sf):
    return graph.chain(seeds(spark, "nation:7"), T.calls(spark, sf, CALL_SHARE), 3)


@query(f"""WITH RECURSIVE {CALLS}, r AS (SELECT from_id AS start, to_id AS id FROM c UNION SELECT r.start, c.to_id FROM r JOIN c ON r.id = c.from_id),
k AS (SELECT a.start AS id, min(a.id) AS component FROM r a JOIN r b ON a.start = b.id AND a.id = b.start GROUP BY a.start) SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM k""")
def find_cycles(spark, sf):
    return graph.cycle_nodes(T.calls(spark, sf, CALL_SHARE))


WAYS = "w0 AS (SELECT id, [id] AS way FROM k WHERE id = component)" + "".join(f", w{n + 1} AS (SELECT * FROM w{n} UNION ALL SELECT i.to_id, min(list_append(way, i.to_id)) FROM w{n} JOIN i ON i.from_id = w{n}.id WHERE len(way) = {n + 1} AND i.to_id NOT IN (SELECT id FROM w{n}) GROUP BY i.to_id)" for n in range(24))


@query(f"""WITH RECURSIVE {CALLS}, r AS (SELECT from_id AS start, to_id AS id FROM c UNION SELECT r.start, c.to_id FROM r JOIN c ON r.id = c.from_id),
k AS (SELECT a.start AS id, min(a.id) AS component FROM r a JOIN r b ON a.start = b.id AND a.id = b.start GROUP BY a.start), i AS (SELECT from_id, to_id, a.component FROM c JOIN k a ON a.id = from_id JOIN k b ON b.id = to_id WHERE a.component = b.component), {WAYS},
x AS (SELECT component, list_slice(way, list_position(way, to_id), len(way)) AS r FROM i JOIN w24 ON w24.id = from_id WHERE list_contains(way, to_id)), y AS (SELECT *, list_position(r, list_min(r)) AS p FROM x)
SELECT DISTINCT component, array_to_string(list_concat(list_concat(list_slice(r, p, len(r)), list_slice(r, 1, p - 1)), [list_min(r)]), ' > ') AS cycle, len(r)::INT AS length FROM y""")
def list_cycles(spark, sf):
    return graph.cycles(T.calls(spark, sf, CALL_SHARE)).select("component", F.array_join("cycle", " > ").alias("cycle"), "length")


@query(f"WITH RECURSIVE {IMPACT}, u AS (SELECT * FROM m WHERE rel IN ('CALLS', 'CONTAINS')), {walk_sql('nation:3', 2, 'u', 'both')} SELECT id, depth::INT AS depth FROM v ORDER BY depth, id LIMIT 36")
def expand_subjects(spark, sf):
    return graph.expand(seeds(spark, "nation:3"), impact_edges(spark, sf), ["CALLS", "CONTAINS"], 2, 36)


@query(f"WITH {ACCESSES} SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM a UNION ALL SELECT to_id FROM a) GROUP BY id")
def degree(spark, sf):
    return graph.degree(T.accesses(spark, sf))


@query(f"WITH {IMPACT} SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM m UNION ALL SELECT to_id, 0, 1 FROM m) GROUP BY id")
def adjacency(spark, sf):
    return graph.adjacency(impact_edges(spark, sf))


@query(f"""WITH {ACCESSES}, {ENTITIES}, m AS (SELECT rel, from_id, to_id, max(confidence) AS confidence FROM a GROUP BY ALL), d AS (SELECT id, count(*) AS degree FROM (SELECT from_id AS id FROM m UNION ALL SELECT to_id FROM m) GROUP BY id),
k AS (SELECT e.id FROM e LEFT JOIN d USING (id) WHERE type <> 'order' ORDER BY coalesce(degree, 0) DESC, e.id LIMIT 500) SELECT rel, from_id, to_id, confidence FROM m WHERE from_id IN (FROM k) AND to_id IN (FROM k)""")
def topk_degree_graph(spark, sf):
    _, edges = graph.top_degree(T.entities(spark, sf, orders=False), merged(spark, sf).drop("n_evidence"), 500)
    return edges.select("rel", "from_id", "to_id", "confidence")


@query(f"WITH {ACCESSES}, {ENTITIES}, k AS (SELECT id FROM e WHERE NOT inferred) SELECT DISTINCT rel, from_id, to_id FROM a WHERE from_id IN (FROM k) AND to_id IN (FROM k)")
def induced_subgraph(spark, sf):
    nodes = T.entities(spark, sf, orders=False).filter(~F.col("inferred"))
    return graph.induced(T.accesses(spark, sf).select("rel", "from_id", "to_id").distinct(), nodes)


@query(f"""WITH {ACCESSES}, {ENTITIES}, d AS (SELECT id, count(*) AS n FROM (SELECT from_id AS id FROM a UNION ALL SELECT to_id FROM a) GROUP BY id), n AS (SELECT e.id, type, coalesce(n, 0) AS w FROM e LEFT JOIN d USING (id) WHERE type IN ('supplier', 'part')),
k AS (SELECT id FROM n ORDER BY w DESC, id LIMIT 28), p AS (SELECT id, CASE WHEN id IN (FROM k) THEN id ELSE 'summary:' || type END AS node FROM n),
l AS (SELECT f.node AS from_id, t.node AS to_id, rel, count(*) AS n FROM a JOIN p f ON a.from_id = f.id JOIN p t ON a.to_id = t.id WHERE f.node <> t.node GROUP BY ALL) SELECT * FROM l ORDER BY n DESC, from_id, to_id, rel LIMIT 84""")
def reduce_graph(spark, sf):
    edges = T.accesses(spark, sf).select("rel", "from_id", "to_id")
    nodes = T.entities(spark, sf, orders=False).filter(F.col("type").isin("supplier", "part")).join(graph.degree(edges), "id", "left")
    return graph.reduce_graph(nodes, edges, F.coalesce("degree", F.lit(0)), 28)[1]


@query(f"WITH {CALLS}, d AS (SELECT DISTINCT from_id, to_id FROM c) SELECT id, sum(o)::BIGINT AS n_callees, sum(i)::BIGINT AS n_callers FROM (SELECT from_id AS id, 1 AS o, 0 AS i FROM d UNION ALL SELECT to_id, 0, 1 FROM d) GROUP BY id")
def call_graph(spark, sf):
    return graph.call_graph(T.calls(spark, sf, CALL_SHARE))


def closure_graph(spark, sf):
    """Nations call nations; a nation reads the parts that its suppliers read, in one edge each."""
    own = T.table(spark, sf, "supplier").select(T.key("supplier", "s_suppkey").alias("from_id"), T.key("nation", "s_nationkey").alias("n"))
    io = T.accesses(spark, sf).join(own, "from_id").groupBy("rel", F.col("n").alias("from_id"), "to_id").agg(F.max("confidence").alias("confidence"))
    calls = T.calls(spark, sf, CALL_SHARE).select("rel", "from_id", "to_id", F.lit(1.0).alias("confidence"))
    return calls.unionByName(io)


CLOSURE = f"""{CALLS}, {ACCESSES}, {ENTITIES}, io AS (SELECT rel, 'nation:' || s_nationkey AS from_id, to_id, max(confidence) AS confidence FROM a JOIN supplier ON from_id = 'supplier:' || s_suppkey GROUP BY ALL),
w AS (SELECT 'nation:' || n_nationkey AS start, 'nation:' || n_nationkey AS id, 0 AS depth FROM nation UNION SELECT start, to_id, depth + 1 FROM w JOIN c ON id = from_id WHERE depth < 2), v AS (SELECT start, id, min(depth) AS depth FROM w GROUP BY ALL)"""


def closures(spark, sf):
    start = T.table(spark, sf, "nation").select(T.key("nation", "n_nationkey").alias("start"), T.key("nation", "n_nationkey").alias("id"))
    return graph.closure(start, T.entities(spark, sf, orders=False), closure_graph(spark, sf), 2)


def mean_confidence(c):
    return c.select("start", F.round(F.col("total") / F.col("n"), 6).alias("confidence"), F.col("n").alias("n_edges"))


@query(f"WITH RECURSIVE {CLOSURE} SELECT start, to_id AS id, arg_min(rel, struct_pack(depth, from_id, rel)) AS op FROM v JOIN io ON v.id = io.from_id GROUP BY ALL")
def program_closure(spark, sf):
    return closures(spark, sf)["data"]


@query(f"WITH RECURSIVE {CLOSURE}, x AS (SELECT rel, from_id, to_id, 1.0::DOUBLE AS confidence FROM c UNION ALL SELECT rel, from_id, to_id, confidence FROM io) SELECT v.start, round(sum(x.confidence) / count(*), 6) AS confidence, count(*) AS n_edges FROM v JOIN x ON v.id = x.from_id GROUP BY v.start")
def flow_confidence(spark, sf):
    return mean_confidence(closures(spark, sf)["confidence"])


# --- model -------------------------------------------------------------------------------------


def access_records(spark, sf):
    """Line items as raw relations whose ends are known."""
    a = T.accesses(spark, sf).withColumn("from_type", F.lit("supplier")).withColumn("to_type", F.lit("part"))
    return a.select("rel", F.col("from_id").alias("from"), F.col("to_id").alias("to"), "from_id", "to_id", "from_type", "to_type", F.col("from_id").alias("from_label"), F.col("to_id").alias("to_label"), F.lit("table").alias("extractor"), "confidence", F.substring_index("evidence", ":", 1).alias("file"), F.substring_index("evidence", ":", -1).cast("int").alias("line"), F.lit(False).alias("dynamic"), F.xxhash64("evidence").alias("ordinal"))


@query(f"WITH {ACCESSES} SELECT rel, from_id, to_id, max(confidence) AS confidence, count(DISTINCT evidence) AS n_evidence FROM a GROUP BY rel, from_id, to_id")
def merge_relation(spark, sf):
    return model.merge_relations(access_records(spark, sf)).select("rel", "from_id", "to_id", "confidence", F.size("evidence").cast("bigint").alias("n_evidence"))


@query(f"WITH {ACCESSES} SELECT rel, from_id, to_id, array_to_string(list_sort(list_distinct(list(evidence))), ',') AS evidence, max(confidence) AS confidence FROM a GROUP BY rel, from_id, to_id")
def merge_relation_again(spark, sf):
    half = lambda k: model.merge_relations(access_records(spark, sf).filter(F.col("line") % 2 == k))  # noqa: E731  two merged halves that share keys
    return model.merge_relations_again(half(0).unionByName(half(1))).select("rel", "from_id", "to_id", F.array_join("evidence", ",").alias("evidence"), "confidence")


@query("""WITH p AS (SELECT upper(trim(p_name)) AS name, CASE WHEN p_size < 5 THEN 400 WHEN p_size < 20 THEN 300 ELSE 100 END AS rank, * FROM part)
SELECT 'part:' || name AS id, arg_min(p_brand, p_partkey) AS extractor, max(CASE WHEN p_size < 5 THEN 0.5 ELSE 0.9 END)::DOUBLE AS confidence, arg_max(p_type, struct_pack(r := rank, n := length(p_type), k := -p_partkey)) AS description, array_to_string(list_sort(list_distinct(list(p_brand))), '|') AS files,
array_to_string(list_sort(list_distinct(list(lower(p_brand)))), '|') AS tags FROM p GROUP BY name""")
def merge_entity(spark, sf):
    p = T.table(spark, sf, "part")
    source = F.when(F.col("p_size") < 5, "cobol_header").when(F.col("p_size") < 20, "jcl_comment").otherwise("derived")
    raw = p.select(F.lit("PART ").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_brand").alias("extractor"), F.when(F.col("p_size") < 5, 0.5).otherwise(0.9).alias("confidence"), F.col("p_type").alias("description"), source.alias("description_source"), F.array("p_brand").alias("semantic_tags"), F.col("p_partkey").alias("ordinal"))
    return model.merge_entities(raw).select("id", "extractor", "confidence", "description", F.array_join("files", "|").alias("files"), F.array_join("semantic_tags", "|").alias("tags"))


@query(f"WITH {ACCESSES} SELECT rel, to_id AS target, max(confidence) AS confidence, count(DISTINCT evidence) AS n_evidence, max(confidence) < 0.5 AS low FROM a GROUP BY rel, to_id")
def dedupe_relation_group(spark, sf):
    d = T.accesses(spark, sf).select("rel", F.col("to_id").alias("to_label"), "confidence", F.array("evidence").alias("evidence"))
    return model.dedupe_relations(d).select("rel", "target", "confidence", F.size("evidence").cast("bigint").alias("n_evidence"), "low")


@query(f"""WITH {ENTITIES}, r AS (SELECT CASE WHEN l_partkey % 7 = 0 THEN 'GHOST' || l_partkey ELSE p_name END AS target FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT upper(trim(name)) AS name, arg_min(id, struct_pack(i := inferred, k := id)) AS id FROM e WHERE type = 'part' GROUP BY 1)
SELECT r.target AS name, coalesce(n.id, 'part:' || upper(r.target)) AS to_id, n.id IS NULL AS inferred, count(*) AS n FROM r LEFT JOIN n ON upper(trim(r.target)) = n.name GROUP BY ALL""")
def resolve_endpoint(spark, sf):
    li, p = T.table(spark, sf, "lineitem"), T.table(spark, sf, "part")
    target = F.when(F.col("l_partkey") % 7 == 0, F.concat(F.lit("GHOST"), F.col("l_partkey").cast("string"))).otherwise(F.col("p_name"))
    raw = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.lit("READS").alias("rel"), T.key("S", "l_suppkey").alias("from"), F.lit("supplier").alias("fromType"), target.alias("to"), F.lit("part").alias("toType"), T.key("order", "l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"))
    known = T.entities(spark, sf, orders=False).filter("type = 'part'").withColumn("name", X.normalize_name(F.col("name"))).withColumn("label", F.col("name"))
    out, made = model.resolve_endpoints(raw, schema.shaped(known, schema.ENTITY))
    return out.groupBy(F.col("to").alias("name"), "to_id").agg(F.count("*").alias("n")).join(made.select(F.col("id").alias("to_id"), "inferred"), "to_id", "left").select("name", "to_id", F.coalesce("inferred", F.lit(False)).alias("inferred"), "n")


@query("""WITH u AS (SELECT event_id, user_id, event_type AS var FROM events WHERE value > 50), d AS (SELECT DISTINCT user_id, event_type AS var, upper(trim(json_extract_string(props, '$.k'))) AS lit FROM events WHERE value < 5)
SELECT event_id, CASE WHEN lit IS NULL THEN 'CALL-DYNAMIC' ELSE 'CALLS' END AS rel, coalesce(lit, var) AS target, CASE WHEN lit IS NULL THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence, lit IS NOT NULL AS traced FROM u LEFT JOIN d USING (user_id, var)""")
def resolve_dynamic_calls(spark, sf):
    ev = T.table(spark, sf, "events")
    values = ev.filter("value < 5").select(F.col("user_id").cast("string").alias("program"), F.col("event_type").alias("var"), F.get_json_object("props", "$.k").alias("value"))
    calls = ev.filter("value > 50").select(F.lit("CALL-DYNAMIC").alias("rel"), F.col("user_id").cast("string").alias("from"), F.col("event_type").alias("to"), F.lit(0.6).alias("confidence"), "event_id")
    rel = schema.shaped(calls, schema.RELATION + ", event_id bigint")
    return model.resolve_dynamic_calls(rel, values).select("event_id", "rel", F.col("to").alias("target"), "confidence", (F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0).alias("traced"))


@query(f"WITH {ENTITIES}, {ACCESSES} SELECT e.* FROM e WHERE type = 'part' AND (NOT inferred OR id IN (SELECT to_id FROM a))")
def prune_inferred(spark, sf):
    return model.prune_inferred(T.entities(spark, sf, orders=False).filter("type = 'part'"), T.accesses(spark, sf).select("from_id", "to_id"))


@query("""WITH x AS (SELECT 'supplier:' || l_suppkey AS from_id, 'part:' || l_partkey AS to_id, o_orderpriority AS f, round(1 - l_discount, 4) AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT from_id, to_id, array_to_string(list_sort(list_distinct(list(f))), ',') AS fields, max(c) AS confidence FROM x GROUP BY ALL""")
def merge_contracts(spark, sf):
    li, o = T.table(spark, sf, "lineitem"), T.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    item = F.struct(F.col("o_orderpriority").alias("name"), F.lit(None).cast("string").alias("copybook"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("pic"), F.lit(False).alias("confirmed"))
    x = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    side = lambda test: schema.shaped(x.filter(test).groupBy(T.key("supplier", "l_suppkey").alias("from_id"), T.key("part", "l_partkey").alias("to_id")).agg(F.array_sort(F.collect_set(item)).alias("fields"), F.round(F.max(1 - F.col("l_discount")), 4).alias("confidence")), schema.RELATION)
    out = model.merge_contracts(side("l_returnflag = 'R'"), side("l_returnflag <> 'R'"))
    return out.select("from_id", "to_id", F.array_join(F.array_sort(F.transform("fields", lambda f: f["name"])), ",").alias("fields"), "confidence")


@query(f"""WITH {ENTITIES}, d AS (SELECT 'supplier:' || l_suppkey AS step, count(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_partkey END) AS n_programs, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_partkey END) AS n_datasets FROM lineitem GROUP BY 1)
SELECT n.id AS job_id, n.name AS job, s.id AS step, s.name AS step_name, s.id AS label, coalesce(n_programs, 0) AS n_programs, coalesce(n_datasets, 0) AS n_datasets, CASE WHEN s.inferred THEN 'only if unsure' END AS run_condition FROM e n JOIN e s ON s.parent = n.id AND s.type = 'supplier' LEFT JOIN d ON d.step = s.id WHERE n.type = 'nation'""")
def batch_join(spark, sf):
    e = T.entities(spark, sf, orders=False).filter(F.col("type").isin("nation", "supplier")).withColumn("type", F.when(F.col("type") == "nation", "job").otherwise("step")).withColumn("label", F.col("id")).withColumn("seq", F.lit(1))
    inside = T.contains(spark, sf, orders=False).filter(F.startswith("to_id", F.lit("supplier:"))).select("rel", "from_id", "to_id")
    runs = T.accesses(spark, sf).select(F.when(F.col("rel") == "UPDATES", "EXECUTES").otherwise(F.col("rel")).alias("rel"), "from_id", "to_id")
    nations = e.filter("type = 'job'").select(F.col("id").alias("parent"), F.col("name").alias("job"))
    only = e.filter("type = 'step' and inferred").join(nations, "parent").select("job", F.col("name").alias("step"), F.lit("only if unsure").alias("run_condition"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return flows.batch(e, inside.union(runs), only).select("job_id", "job", "step", "step_name", "label", F.when(F.col("programs").isNull(), 0).otherwise(count("programs")).cast("bigint").alias("n_programs"), F.when(F.col("datasets").isNull(), 0).otherwise(count("datasets")).cast("bigint").alias("n_datasets"), "run_condition")


@query("""WITH b AS (SELECT 'copybook:' || upper(p_brand) AS id, p_brand FROM part WHERE p_partkey = 17), s AS (SELECT DISTINCT l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN b USING (p_brand) WHERE l_returnflag = 'R'),
k AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM s JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT 'copybook' AS kind, id FROM b UNION SELECT 'program', 'supplier:' || s_suppkey FROM k UNION SELECT 'data', 'table:' || s_nationkey FROM k UNION SELECT 'step', 'nation:' || s_nationkey FROM k UNION SELECT 'job', 'region:' || n_regionkey FROM k""")
def lineage_join(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    fields = t("part").select(T.key("field", "p_partkey").alias("id"), F.lit("field").alias("type"), F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("parent"), F.lit("copybook").alias("parentType"))
    nested = fields.select(F.concat("id", F.lit("-sub")), "type", F.concat("name", F.lit("-sub")), F.col("name"), F.lit("field"))
    books = t("lineitem").filter("l_returnflag = 'R'").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.lit("INCLUDES").alias("rel"), T.key("supplier", "l_suppkey").alias("from_id"), F.concat(F.lit("copybook:"), F.upper("p_brand")).alias("to_id")).distinct()
    s, n = t("supplier"), t("nation")
    rest = s.select(F.lit("READS").alias("rel"), T.key("supplier", "s_suppkey").alias("from_id"), T.key("table", "s_nationkey").alias("to_id")).union(s.select(F.lit("EXECUTES"), T.key("nation", "s_nationkey"), T.key("supplier", "s_suppkey"))).union(n.select(F.lit("CONTAINS"), T.key("region", "n_regionkey"), T.key("nation", "n_nationkey")))
    return model.lineage(seeds(spark, "field:17-sub"), fields.union(nested), books.union(rest))


@query("""WITH f AS (SELECT l_suppkey, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY l_suppkey), q AS (SELECT unnest([1, 5, 9, 13, 40]) AS id)
SELECT l_suppkey AS entry, count(*) AS n_matched, string_agg(q.id::VARCHAR, ',' ORDER BY q.id) AS matched FROM f JOIN q ON list_contains(ids, q.id) GROUP BY l_suppkey""")
def related_flows(spark, sf):
    flows = T.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("entry_id")).agg(F.collect_set("l_partkey").alias("subject_ids"))
    out = search.related_flows(flows, spark.createDataFrame([(x,) for x in (1, 5, 9, 13, 40)], "id bigint"))
    return out.select(F.col("entry_id").alias("entry"), "n_matched", F.array_join("matched_ids", ",").alias("matched"))


# --- anti joins, coverage ------------------------------------------------------------------------


@query(f"WITH {CALLS}, {ENTITIES} SELECT id, name FROM e WHERE type = 'nation' AND id NOT IN (SELECT to_id FROM c)")
def anti_entrypoints(spark, sf):
    return coverage.entrypoints(T.entities(spark, sf, orders=False).filter("type = 'nation'"), T.calls(spark, sf, CALL_SHARE)).select("id", "name")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_isolated(spark, sf):
    rel = T.table(spark, sf, "lineitem").select(F.lit("READS").alias("rel"), F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"))
    return coverage.isolated(T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), rel)


@query("SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_no_entities(spark, sf):
    found = T.table(spark, sf, "labels").select(F.array("doc_id").alias("files"))
    return coverage.files_without_entities(T.table(spark, sf, "documents").select(F.col("doc_id").alias("path")), found)


@query(f"WITH {ENTITIES}, {ACCESSES} SELECT id FROM e WHERE type <> 'order' AND NOT EXISTS (SELECT 1 FROM a WHERE from_id = id) AND NOT EXISTS (SELECT 1 FROM a WHERE to_id = id)")
def lib_not_exists(spark, sf):
    return catalog.unreferenced(T.entities(spark, sf, orders=False), T.accesses(spark, sf)).select("id")


@query(f"WITH {ACCESSES} SELECT rel, from_id, to_id, evidence FROM a WHERE from_id = 'part:42' OR to_id = 'part:42'")
def lib_or_join(spark, sf):
    return catalog.touching(T.accesses(spark, sf), "part:42").select("rel", "from_id", "to_id", "evidence")


@query("SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def lib_left_join_files(spark, sf):
    return catalog.files_with(T.table(spark, sf, "documents").select("doc_id", "source"), T.table(spark, sf, "labels"), "doc_id", {"quality": -1, "toxic": -1})


@query(f"WITH {ENTITIES} SELECT type, count(*) AS n FROM e GROUP BY type")
def count_by_type(spark, sf):
    return coverage.histogram(T.entities(spark, sf), "type")


@query(f"WITH {ACCESSES} SELECT rel, count(*) AS n FROM a GROUP BY rel")
def count_by_rel(spark, sf):
    return coverage.histogram(T.accesses(spark, sf), "rel")


@query(f"WITH {ACCESSES} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n FROM a GROUP BY 1")
def confidence_buckets(spark, sf):
    return coverage.confidence_buckets(T.accesses(spark, sf))


@query("SELECT source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, floor(100.0 * count(l.doc_id) / count(*) + 0.5)::BIGINT AS pct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def coverage_pct(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source").join(T.table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("l").alias("n_labelled")).withColumn("pct", X.percent(F.col("n_labelled"), F.col("n_docs")))


@query("""WITH x AS (SELECT source, count(l.doc_id)::DOUBLE / count(*) AS f, avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END) AS ev, avg(CASE WHEN n_chars > 500 THEN 1.0 ELSE 0.0 END) AS r FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT source, round(0.3 * f + 0.4 * ev + 0.3 * r, 6) AS score, CASE WHEN 0.3 * f + 0.4 * ev + 0.3 * r >= 0.9 THEN 'high' WHEN 0.3 * f + 0.4 * ev + 0.3 * r >= 0.6 THEN 'medium' ELSE 'low' END AS grade FROM x""")
def coverage_score(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(T.table(spark, sf, "labels"), "doc_id", "left")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = d.groupBy("source").agg(share(F.col("quality").isNotNull()).alias("f"), share(F.col("quality") == 1).alias("ev"), share(F.col("n_chars") > 500).alias("r"))
    score, grade = coverage.weighted_score(F.col("f"), F.col("ev"), F.col("r"))
    return g.select("source", F.round(score, 6).alias("score"), grade.alias("grade"))


@query("""SELECT 'part:' || l_partkey AS to_id, count(*) AS n, min(l_orderkey || ':' || l_linenumber) AS first_evidence FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size >= 25) GROUP BY l_partkey ORDER BY n DESC, to_id LIMIT 50""")
def unresolved_topn(spark, sf):
    known = T.table(spark, sf, "part").filter("p_size >= 25").select(T.key("part", "p_partkey").alias("id"))
    return coverage.unresolved(T.accesses(spark, sf), known, 50)


@query(f"WITH {ACCESSES} SELECT rel, count(DISTINCT to_id) AS n_targets, count(DISTINCT evidence) AS n_evidence FROM a GROUP BY rel")
def distinct_evidence(spark, sf):
    return coverage.distinct_evidence(T.accesses(spark, sf))


@query("SELECT 'nation:' || c_nationkey AS id, count(*) AS fan_in FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY fan_in DESC, id LIMIT 10")
def hotspots_fan_in(spark, sf):
    o, c = T.table(spark, sf, "orders").select("o_custkey"), T.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rel = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.lit("CALLS").alias("rel"), T.key("nation", "c_nationkey").alias("to_id"))
    return coverage.hotspots(rel, T.entities(spark, sf, orders=False).filter("type = 'nation'"))


@query(f"WITH {ACCESSES} SELECT to_id, floor(avg(confidence) * 100 + 0.5) / 100 AS confidence FROM a GROUP BY to_id")
def average_round2(spark, sf):
    return coverage.mean_confidence(T.accesses(spark, sf), "to_id")


@query(f"""WITH {ACCESSES}, {ENTITIES}, m AS (SELECT parent AS cluster, id, confidence FROM e WHERE type IN ('supplier', 'customer')), x AS (SELECT cluster, count(*) AS n_members, round(avg(confidence), 2) AS entity_confidence FROM m GROUP BY 1),
r AS (SELECT cluster, count(*) FILTER (rel = 'READS') AS n_inputs, count(*) FILTER (rel IN ('WRITES', 'UPDATES')) AS n_outputs, round(avg(a.confidence), 2) AS relation_confidence FROM a JOIN m ON a.from_id = m.id GROUP BY 1)
SELECT cluster, n_members, entity_confidence, coalesce(n_inputs, 0) AS n_inputs, coalesce(n_outputs, 0) AS n_outputs, 0::BIGINT AS n_calls, coalesce(relation_confidence, 1.0) AS relation_confidence FROM x LEFT JOIN r USING (cluster)""")
def cluster_metrics(spark, sf):
    e = T.entities(spark, sf, orders=False)
    members = e.filter(F.col("type").isin("supplier", "customer")).select(F.col("parent").alias("cluster"), "id")
    return coverage.cluster_metrics(members, e, T.accesses(spark, sf)).select("cluster", "n_members", "entity_confidence", "n_inputs", "n_outputs", "n_calls", "relation_confidence")


@query("""WITH d AS (SELECT doc_id AS name, CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS action FROM labels) SELECT action, count(*) AS n, min(name) AS first FROM d GROUP BY action""")
def review_report(spark, sf):
    d = T.table(spark, sf, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("action"), F.lit(0).alias("at"))
    return coverage.review_report(d).select("action", "n", F.element_at("names", 1).alias("first"))


@query(f"""WITH {ENTITIES}, {ACCESSES}, m AS (SELECT rel, from_id, to_id, max(confidence) AS confidence FROM a GROUP BY ALL), ok AS (SELECT DISTINCT 'order:' || l_orderkey AS name FROM lineitem WHERE l_quantity > 45),
p AS (SELECT 'entity' AS kind, name FROM e WHERE confidence < 0.8 OR inferred UNION ALL SELECT 'relation', from_id || '|' || rel || '|' || to_id FROM m WHERE confidence < 0.5) SELECT kind, name FROM p WHERE name NOT IN (FROM ok)""")
def pending_filter(spark, sf):
    ok = T.table(spark, sf, "lineitem").filter("l_quantity > 45").select(T.key("order", "l_orderkey").alias("name"), F.lit("approve").alias("action")).distinct()
    rel = merged(spark, sf).select(F.col("from_id").alias("from"), "rel", F.col("to_id").alias("to"), "confidence")
    return coverage.pending(T.entities(spark, sf), rel, ok)


@query("SELECT coalesce(CASE WHEN p_size > 10 THEN p_brand END, 'UNSCOPED') AS parent, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS columns FROM part GROUP BY 1")
def columns_by_table(spark, sf):
    e = T.table(spark, sf, "part").select(F.lit("column").alias("type"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("parent"), F.col("p_type").alias("label"))
    return dossier.columns_by_table(e).select("parent", F.array_join("columns", ",").alias("columns"))


# --- filters and scalar functions -----------------------------------------------------------------


@query(f"WITH {ENTITIES} SELECT id, name FROM e WHERE type IN ('nation', 'supplier')")
def filter_type(spark, sf):
    return filters.of_types(T.entities(spark, sf, orders=False), "Nation", "supplier").select("id", "name")


@query(f"WITH {ACCESSES} SELECT rel, from_id, to_id, evidence FROM a WHERE confidence >= 0.9 AND rel IN ('READS', 'UPDATES')")
def filter_min_conf(spark, sf):
    return filters.of_rels(filters.confident(T.accesses(spark, sf), 0.9), "reads", "UPDATES").select("rel", "from_id", "to_id", "evidence")


@query(f"WITH {ENTITIES} SELECT id FROM e WHERE NOT inferred AND type = 'part'")
def filter_no_inferred(spark, sf):
    return filters.of_types(filters.without_inferred(T.entities(spark, sf, orders=False)), "part").select("id")


@query(f"WITH {ENTITIES} SELECT id, name, type FROM e WHERE id = 'NATION_7' OR upper(name) = 'NATION_7' ORDER BY id LIMIT 1")
def get_entity(spark, sf):
    return search.get_entity(T.entities(spark, sf, orders=False), "NATION_7").select("id", "name", "type")


@query("""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(strip_accents(replace(replace(text, 'ß', '-'), 'ẞ', '-'))), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents) SELECT doc_id, CASE WHEN slug <> '' THEN slug ELSE 'query' END AS slug FROM s""")
def slugify(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.slugify(F.col("text")).alias("slug"))


@query("""WITH r AS (SELECT 'SOURCE_' || k AS alias, root FROM (VALUES (1, 'http://'), (2, 'https://'), (3, 'https://www.')) t(k, root)) SELECT page_id, arg_max(r.alias || '/' || substr(url, length(root) + 1), length(root)) AS path FROM pages JOIN r ON starts_with(url, root) GROUP BY page_id""")
def sanitize_paths(spark, sf):
    from ..sources import files

    roots = spark.createDataFrame([("SOURCE_1", "http://"), ("SOURCE_2", "https://"), ("SOURCE_3", "https://www.")], "alias string, root string")
    return files.sanitize(T.table(spark, sf, "pages").select("page_id", "url"), roots, "url").select("page_id", F.col("alias_path").alias("path"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS hash FROM documents")
def hash_file(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", files.file_hash(F.col("text").cast("binary")).alias("hash"))


@query("SELECT substr(sha256(text), 1, 12) AS hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_hashes(spark, sf):
    return T.table(spark, sf, "documents").groupBy(F.substring(F.sha2("text", 256), 1, 12).alias("hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IS NOT NULL")
def json_get(spark, sf):
    return T.table(spark, sf, "events").filter("event_type is not null").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n::BIGINT AS line_no, length(line)::BIGINT AS size FROM l""")
def read_lines(spark, sf):
    from ..sources import files

    lines = files.lines(T.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return lines.select("doc_id", F.col("line").cast("bigint").alias("line_no"), F.length("code").cast("bigint").alias("size"))


@query("""SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""")
def extract_links(spark, sf):
    p = T.table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return p.groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("href").alias("n_distinct"))


@query("""SELECT page_id, regexp_matches(url, '(?i)://[^/]*\\.[^/]*/.*') AS any_depth, regexp_matches(url, '(?i)/[^/]*1[^/]/') AS one_more, regexp_matches(url, '(?i)utm_') AS plain FROM pages""")
def exclude_globs(spark, sf):
    some = lambda g: F.col("url").rlike(X.glob_regex(g))
    return T.table(spark, sf, "pages").select("page_id", some("://*.*/**").alias("any_depth"), some("/*1?/").alias("one_more"), some("utm_").alias("plain"))


@query(f"WITH {ENTITIES} SELECT CASE WHEN type = 'table' THEN 'database' ELSE 'legacy' END AS platform, count(*) AS n FROM e GROUP BY 1")
def platform_of(spark, sf):
    return T.entities(spark, sf).groupBy(platform(F.col("type")).alias("platform")).agg(F.count("*").alias("n"))


# --- windows, order, sets --------------------------------------------------------------------------


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events")
def carry_forward(spark, sf):
    return T.table(spark, sf, "events").select("event_id", ordering.carry_forward(F.when(F.col("event_type") == "purchase", F.col("value")), ["user_id"], ["ts", "event_id"]).alias("last_purchase"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS seq FROM conversations")
def step_seq(spark, sf):
    return T.table(spark, sf, "conversations").select("conv_id", "turn", ordering.sequence(["conv_id"], ["turn"]).alias("seq"))


@query("""WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM m) SELECT user_id, phase::BIGINT AS phase, event_type, count(*) AS n_rows FROM r WHERE phase <= 12 GROUP BY ALL""")
def phase_merge(spark, sf):
    return ordering.merge_adjacent(T.table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", 12).select("user_id", F.col("phase").cast("bigint").alias("phase"), "event_type", "n_rows")


@query("SELECT conv_id, turn, role, nxt AS next FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt <> role")
def adjacent_pairs(spark, sf):
    return ordering.adjacent(T.table(spark, sf, "conversations"), ["conv_id"], ["turn"], "role", True).select("conv_id", "turn", "role", "next")


@query("SELECT conv_id, turn AS from_step, nxt AS to_step FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL")
def step_chain(spark, sf):
    return ordering.adjacent(T.table(spark, sf, "conversations"), ["conv_id"], ["turn"], "turn").select("conv_id", F.col("turn").alias("from_step"), F.col("next").alias("to_step"))


@query("SELECT conv_id, turn, 'CIT-' || lpad(row_number() OVER (PARTITION BY conv_id ORDER BY role, turn)::VARCHAR, 3, '0') AS citation_id FROM conversations")
def citation_id(spark, sf):
    return ordering.citation_ids(T.table(spark, sf, "conversations"), ["conv_id"], ["role", "turn"]).select("conv_id", "turn", "citation_id")


@query("WITH t AS (SELECT p_partkey AS id, p_size AS score FROM part ORDER BY score DESC, id LIMIT 6) SELECT * FROM t WHERE score >= (SELECT max(score) FROM t) - 18")
def score_window(spark, sf):
    return search.score_window(T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("score")))


@query(f"""WITH {ACCESSES}, t AS (SELECT rel, from_id, to_id, max(confidence) AS c FROM a GROUP BY ALL), b AS (SELECT rel, from_id, to_id, max(confidence) AS c FROM a WHERE l_shipdate < '1998-06-01' GROUP BY ALL)
SELECT rel, from_id, to_id, CASE WHEN b.c IS NULL THEN 'added' WHEN t.c IS NULL THEN 'removed' ELSE 'changed' END AS change FROM t FULL JOIN b USING (rel, from_id, to_id) WHERE b.c IS NULL OR t.c IS NULL OR b.c <> t.c""")
def snapshot_diff(spark, sf):
    one = lambda d: d.groupBy("rel", "from_id", "to_id").agg(F.max("confidence").alias("confidence"))
    a = T.accesses(spark, sf)
    return changes.snapshot_diff(one(a.filter("l_shipdate < '1998-06-01'")), one(a), ["rel", "from_id", "to_id"], "confidence")


@query("""WITH o AS (SELECT doc_id, substr(sha256(text), 1, 12) AS h FROM documents WHERE doc_id % 10 <> 3), n AS (SELECT doc_id, substr(sha256(CASE WHEN n_chars < 300 THEN text || '!' ELSE text END), 1, 12) AS h FROM documents WHERE doc_id % 10 <> 4)
SELECT doc_id AS path, CASE WHEN n.h IS NULL THEN 'deleted' WHEN o.h IS NULL THEN 'new' WHEN n.h = o.h THEN 'unchanged' ELSE 'modified' END AS status FROM n FULL JOIN o USING (doc_id)""")
def incremental_status(spark, sf):
    d = T.table(spark, sf, "documents")
    sha = lambda c: F.substring(F.sha2(c, 256), 1, 12).alias("hash")
    # two snapshots that differ: the operator's input, not a cut of the table
    new = d.filter("doc_id % 10 <> 4").select(F.col("doc_id").alias("path"), sha(F.when(F.col("n_chars") < 300, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), F.col("n_chars").alias("size"))
    return changes.status(new, d.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("path"), sha(F.col("text"))))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_by_key(spark, sf):
    return changes.first_by(T.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT coalesce(p, f) AS p_brand, CASE WHEN p IS NOT NULL AND f IS NOT NULL THEN 'implemented' WHEN p IS NOT NULL THEN 'missing' ELSE 'extra' END AS state FROM (SELECT DISTINCT p_brand AS p FROM part WHERE p_size < 4) FULL JOIN (SELECT DISTINCT p_brand AS f FROM part WHERE p_size > 47) ON p = f")
def adherence_sets(spark, sf):
    p = T.table(spark, sf, "part")
    return changes.adherence(p.filter("p_size < 4"), p.filter("p_size > 47"), "p_brand")


@query("SELECT conv_id AS job, string_agg(role, '>' ORDER BY coalesce(CASE WHEN turn > 0 THEN turn END, 9999), role) AS steps FROM conversations GROUP BY conv_id")
def sort_steps(spark, sf):
    steps = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("job"), F.when(F.col("turn") > 0, F.col("turn")).cast("int").alias("seq"), F.col("role").alias("label"))
    return flows.ordered(steps).select("job", F.array_join("steps", ">").alias("steps"))


# --- search -----------------------------------------------------------------------------------------


@query(f"""WITH {ENTITIES} SELECT id, score FROM (SELECT id, CASE WHEN upper(id) = 'NATION_1' OR upper(name) = 'NATION_1' THEN 100 WHEN starts_with(upper(name), 'NATION_1') OR starts_with(upper(coalesce(parent, '')), 'NATION_1') OR starts_with(upper(type), 'NATION_1') THEN 70
WHEN contains(upper(id), 'NATION_1') OR contains(upper(name), 'NATION_1') OR contains(upper(coalesce(parent, '')), 'NATION_1') THEN 40 ELSE 0 END AS score FROM e) WHERE score > 0""")
def entity_search(spark, sf):
    return search.entities(T.entities(spark, sf), "nation_1").select("id", "score")


@query(f"WITH {ACCESSES} SELECT DISTINCT rel, from_id, to_id FROM a WHERE contains(upper(from_id), 'PART:77') OR contains(upper(to_id), 'PART:77')")
def relation_search(spark, sf):
    return search.relations(T.accesses(spark, sf).select("rel", "from_id", "to_id").distinct(), "part:77")


@query("""WITH f AS (SELECT n_name AS entry_label, 'nation:' || n_nationkey AS entry_id, upper(n_name) AS u, n_name || ' of ' || r_name AS summary FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT entry_id, score FROM (SELECT entry_id, (CASE WHEN u = 'NATION_2' THEN 100 ELSE 0 END) + (CASE WHEN starts_with(u, 'NATION_2') OR starts_with(upper(summary), 'NATION_2') THEN 35 ELSE 0 END) + (CASE WHEN u = 'NATION_2' THEN 25 ELSE 0 END) + (CASE WHEN contains(u, 'NATION_2') OR contains(upper(summary), 'NATION_2') THEN 15 ELSE 0 END) AS score FROM f) WHERE score > 0""")
def flow_search(spark, sf):
    n, r = T.table(spark, sf, "nation"), T.table(spark, sf, "region")
    f = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(T.key("nation", "n_nationkey").alias("entry_id"), F.col("n_name").alias("entry_label"), F.col("n_name").alias("entry_name"), F.concat("n_name", F.lit(" of "), "r_name").alias("summary"), F.array(T.key("nation", "n_nationkey")).alias("subject_ids"), F.array(F.upper("n_name")).alias("tokens"))
    return search.flows(f, "nation_2").select("entry_id", "score")


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part), p AS (SELECT x.a AS a, y.a AS b FROM n x JOIN n y ON x.a < y.a) SELECT a, b, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS similarity FROM p WHERE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.72""")
def name_similarity(spark, sf):
    n = T.table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    # names of the vocabulary meet where they share a letter pair: 1 - d / m >= 0.72 leaves one in common
    pairs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2))))
    x = n.withColumn("g", F.explode(pairs("a")))
    y = x.withColumnRenamed("a", "b")
    both = x.join(y, "g").filter("a < b and least(length(a), length(b)) >= 0.72 * greatest(length(a), length(b))").select("a", "b").distinct().withColumn("similarity", X.similarity(F.col("a"), F.col("b")))
    return both.filter("similarity >= 0.72").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("""WITH t AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')), ' ')) AS token FROM part) SELECT token, count(*) AS n FROM t WHERE token <> '' GROUP BY token""")
def token_index(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.token_index(p, ["name"]).groupBy("token").agg(F.count("*").alias("n"))


@query("""WITH t1 AS (SELECT p_partkey AS id, 1 AS tier FROM part WHERE upper(p_name) = 'SMALL' UNION SELECT min(p_partkey), 2 FROM part), t AS (SELECT id, min(tier) AS tier FROM t1 GROUP BY id),
w AS (SELECT DISTINCT p_partkey AS id FROM part WHERE len(list_filter(string_split(trim(regexp_replace(upper(p_name), '[^A-Z0-9]+', ' ', 'g')), ' '), lambda x: starts_with(x, 'SMALL'))) > 0)
SELECT id, tier::INT AS tier FROM t UNION ALL SELECT id, 3 FROM w WHERE id NOT IN (SELECT id FROM t) AND (SELECT count(*) FROM t) < 5""")
def name_tiers(spark, sf):
    p = T.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    nick = p.agg(F.min("id").alias("canonical_id")).withColumn("alias", F.lit("small"))
    return search.token_search(p, search.token_index(p, ["name"]), nick, "small").filter("tier < 4")


@query("""WITH t AS (SELECT strip_accents(upper(text)) AS u FROM documents) SELECT max(contains(u, 'LICENSE')::INT) + max(contains(u, 'TOKEN')::INT) + max(contains(u, 'ZZYZX')::INT) + max(contains(u, 'MAIL')::INT) AS n_terms, max(contains(u, 'LICENSE')::INT) + max(contains(u, 'TOKEN')::INT) + max(contains(u, 'ZZYZX')::INT) + max(contains(u, 'MAIL')::INT) >= 3 AS special FROM t""")
def domain_pack_resolve(spark, sf):
    return search.domain_pack(T.table(spark, sf, "documents").select(F.col("text").alias("value")), ["LICENSE", "TOKEN", "ZZYZX", "MAIL"])


@query("SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)")
def contained_passages(spark, sf):
    """Benchmark texts inside documents. A word between two others of an item stands as a word in every text that holds the item; items without one are a few and meet all texts."""
    b = T.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item")).filter("item is not null")
    words = F.split("item", "[^\\p{L}]+")
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda t: F.length(t) > 0)
    b = b.withColumn("w", F.try_element_at(F.array_sort(inner, lambda x, y: F.length(y) - F.length(x)), F.lit(1)))
    keyed, bare = b.filter("w is not null"), b.filter("w is null").select("item_id", "item")
    small = b.count() <= 100_000  # items that a broadcast holds; more are joined by shuffle of the words
    near = F.broadcast if small else (lambda d: d)
    d = T.table(spark, sf, "documents").select("doc_id", "text")
    if small:
        keys = keyed.agg(F.collect_set("w").alias("keys"))
        d = d.join(F.broadcast(keys)).withColumn("ws", F.array_intersect(F.array_distinct(F.split("text", "[^\\p{L}]+")), "keys")).drop("keys")  # one row
    else:
        d = d.withColumn("ws", F.array_distinct(F.split("text", "[^\\p{L}]+")))
    hit = d.select("doc_id", "text", F.explode("ws").alias("w")).join(near(keyed), "w").filter(F.contains("text", F.col("item"))).select("doc_id", "item_id")
    rest = d.join(near(bare), F.contains("text", F.col("item"))).select("doc_id", "item_id")
    return hit.union(rest).distinct()


# --- claims, phases, exports ---------------------------------------------------------------------------


@query("""SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'fact' WHEN l.doc_id IS NOT NULL THEN 'inference' ELSE 'hypothesis' END AS claim FROM documents d LEFT JOIN labels l USING (doc_id)""")
def claims(spark, sf):
    from ..operators import dossier

    d = T.table(spark, sf, "documents").select("doc_id").join(T.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.select("doc_id", dossier.claim_type(F.lit(True), F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("quality").isNotNull()).alias("claim"))


@query("""WITH c AS (SELECT conv_id, max((role = 'user')::INT)::DOUBLE AS resolution, (count(*) >= 4)::INT::DOUBLE AS phases, max((role = 'assistant')::INT)::DOUBLE AS outputs, (count(*) % 2)::DOUBLE AS rules FROM conversations GROUP BY 1), x AS (SELECT *, floor(100 * (resolution + phases + outputs + rules) / 4 + 0.5)::BIGINT AS total_pct FROM c)
SELECT conv_id AS seed, total_pct, CASE WHEN resolution + phases + outputs = 3 AND total_pct >= 85 THEN 'complete' WHEN total_pct >= 55 THEN 'partial' ELSE 'draft' END AS status FROM x""")
def completeness_score(spark, sf):
    g = T.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("seed")).agg(F.max(F.col("role") == "user").alias("resolution"), (F.count("*") >= 4).alias("phases"), F.max(F.col("role") == "assistant").alias("outputs"), (F.count("*") % 2 == 1).alias("rules"))
    rows = g.select("seed", F.explode(F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).alias("ok")) for c in ("resolution", "phases", "outputs", "rules")])).alias("c")).select("seed", "c.*")
    return dossier.completeness(rows).select("seed", "total_pct", "status")


@query("""WITH x AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'WRITES' WHEN 'click' THEN 'READS' WHEN 'view' THEN 'VALIDATES' ELSE 'UPDATES' END AS rel, CASE user_id % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'program' WHEN 2 THEN 'dataset' END AS tt, CASE WHEN value > 50 THEN 'step' ELSE 'program' END AS ft FROM events),
y AS (SELECT *, CASE tt WHEN 'table' THEN 'd' WHEN 'program' THEN 'c' WHEN 'dataset' THEN 'b' END AS tp, CASE ft WHEN 'step' THEN 'b' ELSE 'c' END AS fp FROM x)
SELECT event_id, CASE WHEN tt IS NOT NULL AND tp <> fp THEN 'handoff' WHEN rel = 'READS' THEN 'intake' WHEN rel = 'VALIDATES' THEN 'validation' WHEN rel = 'UPDATES' THEN 'persistence' WHEN rel = 'WRITES' AND tt = 'dataset' THEN 'output' END AS phase FROM y""")
def phase_classify(spark, sf):
    kind, k = F.col("event_type"), F.col("user_id") % 4
    rel = F.when(kind == "purchase", "WRITES").when(kind == "click", "READS").when(kind == "view", "VALIDATES").otherwise("UPDATES")
    to = F.when(k == 0, "table").when(k == 1, "program").when(k == 2, "dataset")
    return T.table(spark, sf, "events").select("event_id", dossier.relation_phase(rel, F.when(F.col("value") > 50, "step").otherwise("program"), to).alias("phase"))


@query(f"""WITH {ACCESSES}, m AS (SELECT rel, from_id, to_id, list_distinct(list(evidence)) AS ev FROM a GROUP BY ALL) SELECT rel, from_id, to_id, unnest(ev) AS evidence FROM m""")
def csv_edges_expanded(spark, sf):
    from ..operators import export

    m = T.accesses(spark, sf).groupBy("rel", "from_id", "to_id").agg(F.max("confidence").alias("confidence"), F.collect_set("evidence").alias("evidence"))
    return export.csv_edges(m, expanded=True).select("rel", "from_id", "to_id", "evidence")


@query("""SELECT 'nation:' || n_nationkey AS id, '  <node id="nation:' || n_nationkey || '"><data key="label">' || replace(n_name, '&', '&amp;') || '</data><data key="type">nation</data></node>' AS line FROM nation""")
def graphml_nodes(spark, sf):
    from ..operators import export

    return export.graphml_nodes(T.entities(spark, sf, orders=False).filter("type = 'nation'").withColumn("label", F.col("name"))).select("id", "line")


@query(f"""WITH {CALLS} SELECT '  "' || from_id || '" -> "' || to_id || '" [label="CALLS"];' AS line FROM c""")
def dot_edges(spark, sf):
    from ..operators import export

    return export.dot_edges(T.calls(spark, sf, CALL_SHARE)).select("line")


@query("""WITH p AS (SELECT DISTINCT p_partkey, unnest(string_split(lower(p_name), ' ')) AS t FROM part), b AS (SELECT item, unnest(string_split(item, '-')) AS t FROM (VALUES ('blue-widget-service'), ('gear-api'), ('rod-store')) x(item))
SELECT DISTINCT p_partkey, item FROM p JOIN b USING (t) WHERE length(t) >= 3 AND t NOT IN ('service', 'api', 'store')""")
def service_match(spark, sf):
    from ..operators import modernize

    services = spark.createDataFrame([("blue-widget-service",), ("gear-api",), ("rod-store",)], "item string")
    return modernize.token_match(T.table(spark, sf, "part").select("p_partkey", "p_name"), services, "p_name", "item").select("p_partkey", "item")


# --- catalog -----------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {IMPACT}, u AS (SELECT * FROM m), {walk_sql('part:33', 2, 'u', 'upstream')} SELECT id, depth::INT AS depth FROM v UNION ALL SELECT DISTINCT to_id, -1 FROM u WHERE from_id = 'part:33' AND to_id NOT IN (SELECT id FROM v)""")
def lib_impact_chain(spark, sf):
    from ..operators import catalog

    return catalog.impact_chain(seeds(spark, "part:33"), impact_edges(spark, sf), 2)


@query(f"""WITH {ACCESSES} SELECT DISTINCT to_id AS subject, CASE WHEN rel = 'READS' THEN 'reader' ELSE 'writer' END AS side, from_id AS id, rel FROM a WHERE to_id IN (SELECT 'part:' || p_partkey FROM part WHERE upper(p_name) = 'NEW PLATE' ORDER BY 'part:' || p_partkey LIMIT 10)""")
def lib_lineage_chain(spark, sf):
    from ..operators import catalog

    return catalog.lineage_chain("new plate", T.entities(spark, sf, orders=False), T.accesses(spark, sf))


@query(f"""WITH RECURSIVE {IMPACT}, u AS (SELECT * FROM m WHERE rel <> 'CONTAINS'), {walk_sql('nation:7', 1, 'u')} SELECT DISTINCT rel, from_id, to_id, depth FROM (SELECT u.rel, u.from_id, u.to_id, v.depth::INT AS depth FROM u JOIN v ON u.from_id = v.id UNION ALL SELECT rel, from_id, to_id, 0 FROM u WHERE rel = 'CALLS' AND to_id = 'nation:7')""")
def lib_program_subgraph(spark, sf):
    from ..operators import catalog

    return catalog.subgraph(seeds(spark, "nation:7"), impact_edges(spark, sf), 1)


@query(f"WITH {IMPACT} SELECT CASE WHEN rel = 'CALLS' THEN 'calls' WHEN rel = 'CONTAINS' THEN 'batch' ELSE 'data' END AS kind, count(*) AS n FROM m GROUP BY 1")
def lib_dependency_counts(spark, sf):
    from ..operators import catalog

    return catalog.dependency_counts(impact_edges(spark, sf))


@query(f"""WITH {ENTITIES}, n AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT 'NOBODY'), k AS (SELECT upper(name) AS name, min(id) AS id FROM e WHERE type = 'part' GROUP BY 1) SELECT n.name, 'part' AS type, k.id, CASE WHEN k.id IS NOT NULL THEN 'typed' END AS how FROM n LEFT JOIN k USING (name)""")
def lib_find_canonical(spark, sf):
    from ..operators import catalog

    names = T.table(spark, sf, "part").select(F.upper("p_name").alias("name")).union(spark.createDataFrame([("NOBODY",)], "name string")).withColumn("type", F.lit("part"))
    none = spark.createDataFrame([], "alias string, canonical_id string")
    return catalog.canonical(names, T.entities(spark, sf, orders=False).filter("type = 'part'"), none)
