"""Graph operators on edges (rel, from_id, to_id, ...): walks are frontier joins, one hop a round.

A hop joins the frontier with the edges and leaves out what was visited; each hop is written to
the shared folder, so a plan stays short and a lost executor costs one hop. Nothing of the
graph comes to the driver but the count that tells when a walk is over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut, settled


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges in and out."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, n_out, n_in) of every endpoint."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("to_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def steps(edges: DataFrame, direction: str) -> DataFrame:
    """(at, next) of the moves that a walk in this direction can make."""
    down, up = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next")), edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"))
    return (down if direction == "downstream" else up if direction == "upstream" else down.union(up)).distinct()


def reach(seeds: DataFrame, edges: DataFrame, direction: str = "both", max_depth: int = 4, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., id, depth) of all nodes within max_depth hops of the seeds, by fewest hops.

    by: columns of seeds that name independent walks, which run in one go. max_depth 999 means until nothing new is found.
    """
    moves = cut(steps(edges, direction))
    frontier = cut(seeds.select(*by, "id").distinct().withColumn("depth", F.lit(0)))
    visited, depth = frontier, 0
    while depth < max_depth:
        depth += 1
        ahead = frontier.join(moves, frontier["id"] == moves["at"]).select(*by, F.col("next").alias("id")).distinct()
        frontier = cut(ahead.join(visited, [*by, "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def traverse(seeds: DataFrame, edges: DataFrame, direction: str = "both", max_depth: int = 4, dedupe: bool = True) -> DataFrame:
    """Edges of all nodes that are at most max_depth hops away, with the depth of the node that is expanded.

    dedupe False: an edge whose ends are both expanded comes once for each in direction both.
    """
    edges = settled(edges)
    nodes = reach(seeds, edges, direction, max_depth)
    out = edges.join(nodes.withColumnRenamed("id", "from_id"), "from_id")
    into = edges.join(nodes.withColumnRenamed("id", "to_id"), "to_id")
    columns = [*edges.columns, "depth"]
    if direction == "downstream":
        return out.select(columns)
    if direction == "upstream":
        return into.select(columns)
    both = out.select(columns).union(into.select(columns))
    return both.groupBy(*edges.columns).agg(F.min("depth").alias("depth")) if dedupe else both


def affected(seeds: DataFrame, edges: DataFrame, direction: str = "both", max_depth: int = 4) -> DataFrame:
    """Distinct ends of the edges of a walk, without the seeds."""
    return ends_of(traverse(seeds, edges, direction, max_depth), seeds)


def ends_of(walked: DataFrame, seeds: DataFrame) -> DataFrame:
    """Distinct ends of edges that were walked, without the seeds."""
    return walked.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().join(seeds.select("id"), "id", "left_anti")


def homonyms(seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """seeds (id) and all entities that have the name of one, whatever their type."""
    names = entities.join(seeds.select("id"), "id", "left_semi").select(F.upper("name").alias("n")).distinct()
    return seeds.select("id").union(entities.withColumn("n", F.upper("name")).join(names, "n", "left_semi").select("id")).distinct()


def neighborhood(seeds: DataFrame, edges: DataFrame, depth: int = 1, rels: list[str] | None = None, least: float = 0.0, limit: int = 5000, entities: DataFrame | None = None) -> DataFrame:
    """Edges around the seeds (with entities: and around what is called like them), filtered after the walk, one for each (from, to, rel), by depth and ids up to limit."""
    seeds = cut(homonyms(seeds, entities)) if entities is not None else seeds
    found = traverse(seeds, edges, "both", min(depth, 4))
    if rels:
        found = found.filter(F.col("rel").isin(*rels))
    found = found.filter(F.coalesce("confidence", F.lit(0.0)) >= least)
    return found.groupBy("from_id", "to_id", "rel").agg(F.min("depth").alias("depth")).orderBy("depth", "from_id", "to_id", "rel").limit(limit)


def roots(edges: DataFrame) -> DataFrame:
    """Callers that nothing calls (a call of itself doesn't count)."""
    return edges.select(F.col("from_id").alias("id")).distinct().join(edges.filter("from_id <> to_id").select(F.col("to_id").alias("id")), "id", "left_anti")


def chain(seeds: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(from_id, to_id, depth, is_back_edge) of the calls below the seeds; a back edge leads to a node that leads back to its caller within max_depth + 1 calls."""
    walked = cut(traverse(seeds, edges, "downstream", max_depth).select("from_id", "to_id", "depth").distinct())
    back = on_cycles_pairs(walked, max_depth + 1)
    return walked.join(back, ["from_id", "to_id"], "left").select("from_id", "to_id", "depth", F.coalesce("is_back_edge", F.lit(False)).alias("is_back_edge"))


def on_cycles_pairs(edges: DataFrame, max_depth: int) -> DataFrame:
    """(from_id, to_id, is_back_edge) of the edges whose end leads back to their start; only edges inside a component are walked."""
    pairs = cut(edges.select("from_id", "to_id").distinct())
    of = cut(cycle_nodes(pairs).select("id", "component"))
    inside = pairs.join(of.select(F.col("id").alias("from_id"), F.col("component").alias("c")), "from_id").join(of.select(F.col("id").alias("to_id"), F.col("component").alias("d")), "to_id").filter("c = d").select("from_id", "to_id")
    inside = cut(inside)
    seeds = inside.select(F.col("to_id").alias("start"), F.col("to_id").alias("id")).distinct()
    closure = reach(seeds, inside, "downstream", max_depth, by=("start",))
    back = closure.select(F.col("start").alias("to_id"), F.col("id").alias("from_id"))
    return inside.join(back, ["from_id", "to_id"], "left_semi").withColumn("is_back_edge", F.lit(True))


#: Pointer jumps of one written table.
JUMPS = 4


def raked(pairs: DataFrame) -> DataFrame:
    """pairs without the edges at nodes that nothing leads to or that lead nowhere: one layer of them."""
    return pairs.join(pairs.select(F.col("to_id").alias("from_id")).distinct(), "from_id", "left_semi").join(pairs.select(F.col("from_id").alias("to_id")).distinct(), "to_id", "left_semi").select("from_id", "to_id")


def chained(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """pairs with chains as single edges, the chains (id, chain, from_id, to_id), and rings (id, component); None if no node is on a chain.

    A node of a chain has one edge in and one out. Every such node points to the next one, and pointers
    jump over pointers, so that rounds grow with the logarithm of the longest chain. A chain is named after its last node; nodes
    that never come to an end lie on a ring of their own, which is named after its smallest node.
    """
    one_out = pairs.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n"), F.min("to_id").alias("next")).filter("n = 1 and id <> next").select("id", "next")
    one_in = pairs.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n")).filter("n = 1").select("id")
    at = cut(one_out.join(one_in, "id").select("id", "next", F.col("id").alias("last"), F.col("id").alias("least")))
    n = at.count()
    if not n:
        return None
    far = 1
    while far <= n:
        for _ in range(JUMPS):
            on = at.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("last").alias("l2"), F.col("least").alias("m2"))
            at = at.join(on, "next", "left").select("id", F.coalesce("n2", "next").alias("next"), F.coalesce("l2", "last").alias("last"), F.least("least", "m2").alias("least"))
            far *= 2
        at = cut(at)
        if at.join(at.select(F.col("id").alias("next")), "next", "left_semi").isEmpty():
            break
    inner = at.select("id")
    rings = at.join(inner.withColumnRenamed("id", "next"), "next", "left_semi").select("id", F.col("least").alias("component"))
    ended = at.join(inner.withColumnRenamed("id", "next"), "next", "left_anti")
    heads = pairs.join(inner.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
    first = heads.join(ended.select(F.col("id").alias("to_id"), F.col("last").alias("chain"), "next"), "to_id").select("chain", "from_id", F.col("next").alias("to_id"))
    first = cut(first)
    rest = heads.join(inner.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select("from_id", "to_id")
    chains = ended.select("id", F.col("last").alias("chain")).join(first, "chain")
    return cut(rest.union(first.select("from_id", "to_id")).distinct()), cut(chains), cut(rings)


def contracted(pairs: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """pairs raked and with chains as edges, over and over, the chains of each time, and rings: what is left has branches at every node. Trees and chains go in rounds that grow with the logarithm of their size."""
    levels, rings, n = [], [], pairs.count()
    while n:
        found = chained(pairs)
        if found is not None:
            pairs, chains, ring = found
            levels.append(chains)
            rings.append(ring)
        pairs = cut(raked(pairs))
        n, before = pairs.count(), n
        if n == before:
            break
    return pairs, levels, rings


def coloured(pairs: DataFrame) -> DataFrame:
    """(id, colour): of each node the smallest node that leads to it; a colour also jumps to the colour of its own node."""
    colours = cut(pairs.select(F.col("from_id").alias("id")).union(pairs.select("to_id")).distinct().withColumn("colour", F.col("id")))
    while True:
        ahead = pairs.join(colours.withColumnRenamed("id", "from_id"), "from_id").groupBy(F.col("to_id").alias("id")).agg(F.min("colour").alias("near"))
        step = colours.join(ahead, "id", "left").select("id", F.col("colour").alias("old"), F.least("colour", F.coalesce("near", "colour")).alias("m"))
        far = colours.select(F.col("id").alias("m"), F.col("colour").alias("far"))
        new = cut(step.join(far, "m", "left").select("id", "old", F.least("m", F.coalesce("far", "m")).alias("colour")))
        colours = new.select("id", "colour")
        if new.filter("colour <> old").isEmpty():
            return colours


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(id, component, size): nodes that can reach themselves, by the smallest node that each can reach and be reached from.

    Trees and chains are contracted first. Then a round colours each node with the smallest node that leads to it. The nodes of a colour that lead back to the node it is named after are a component; the rest, within its colour, goes to the next round. Nodes of a chain belong to a component if both ends of the chain do. State is one colour a node and never a pair of nodes.
    """
    pairs, levels, rings = contracted(cut(edges.select("from_id", "to_id").distinct()))
    out = [r.select("id", "component") for r in rings]
    while not pairs.isEmpty():
        colours = coloured(pairs)
        c, d = colours.select(F.col("id").alias("from_id"), F.col("colour").alias("c")), colours.select(F.col("id").alias("to_id"), F.col("colour").alias("d"))
        pairs = cut(pairs.join(c, "from_id").join(d, "to_id").filter("c = d").select("from_id", "to_id", "c"))
        roots = pairs.select(F.col("c").alias("id")).distinct()
        found = cut(reach(roots, pairs.select("from_id", "to_id"), "upstream", 999).join(colours, "id").select("id", F.col("colour").alias("component")))
        selves = pairs.filter("from_id = to_id").select(F.col("from_id").alias("id"))
        many = found.groupBy("component").agg(F.count("*").alias("size"))
        out.append(cut(found.join(many, "component").join(selves.withColumn("self", F.lit(True)), "id", "left").filter("size > 1 or self").select("id", "component")))
        rest = pairs.join(found.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(found.select(F.col("id").alias("to_id")), "to_id", "left_anti")
        pairs, more, round_ = contracted(cut(rest.select("from_id", "to_id")))
        levels, out = levels + more, out + [r.select("id", "component") for r in round_]
    if not out:
        return edges.select(F.col("from_id").alias("id"), F.col("from_id").alias("component"), F.lit(0).cast("bigint").alias("size")).limit(0)
    nodes = cut(reduce(lambda a, b: a.unionByName(b), out))
    for chains in reversed(levels):  # what was contracted last comes back first
        a, b = nodes.select(F.col("id").alias("from_id"), "component"), nodes.select(F.col("id").alias("to_id"), F.col("component").alias("d"))
        nodes = cut(nodes.unionByName(chains.join(a, "from_id").join(b, "to_id").filter("component = d").select("id", "component")))
    name = nodes.groupBy("component").agg(F.min("id").alias("name"), F.count("*").alias("size"))
    return nodes.join(name, "component").select("id", F.col("name").alias("component"), "size")


def cycles(edges: DataFrame, longest: int = 64) -> DataFrame:
    """(component, cycle, length): closed paths, one for each edge that leads back to a node on the shortest way from the smallest node of its component.

    All components are walked at once from their smallest nodes; a node keeps one way, the shortest and then the smallest by ids. A cycle begins and
    ends at its smallest node. Ways of more than longest nodes are not followed; every component has a cycle through its smallest node if that is no longer.
    """
    pairs = cut(edges.select("from_id", "to_id").distinct())
    of = cut(cycle_nodes(pairs).select("id", "component"))
    inside = pairs.join(of.select(F.col("id").alias("from_id"), "component"), "from_id").join(of.select(F.col("id").alias("to_id"), F.col("component").alias("d")), "to_id").filter("component = d").select("component", "from_id", "to_id")
    inside = cut(inside)
    frontier = cut(of.filter("id = component").select("id", F.array("id").alias("way")))
    ways = frontier
    for _ in range(longest - 1):
        ahead = frontier.join(inside, frontier["id"] == inside["from_id"]).select(F.col("to_id").alias("id"), F.concat("way", F.array("to_id")).alias("way")).groupBy("id").agg(F.min("way").alias("way"))
        frontier = cut(ahead.join(ways.select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        ways = ways.unionByName(frontier)
    back = inside.join(ways.withColumnRenamed("id", "from_id"), "from_id").withColumn("at", F.array_position("way", F.col("to_id"))).filter("at > 0")
    ring = back.select("component", F.slice("way", F.col("at").cast("int"), F.size("way")).alias("r")).withColumn("k", F.array_position("r", F.array_min("r")).cast("int"))
    turned = F.concat(F.slice("r", F.col("k"), F.size("r")), F.slice("r", F.lit(1), F.col("k") - 1), F.array(F.array_min("r")))
    return ring.select("component", turned.alias("cycle"), F.size("r").alias("length")).distinct()


def reverse_trace(seeds: DataFrame, edges: DataFrame, rels: list[str], max_depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """Nodes upstream of the seeds with their depth, and which of them are entry points (nothing above)."""
    used = edges.filter(F.col("rel").isin(*rels))
    nodes = cut(reach(seeds, used, "upstream", max_depth))
    return nodes, nodes.join(used.select(F.col("to_id").alias("id")), "id", "left_anti")


def best_parent(edges: DataFrame, priority: Column) -> DataFrame:
    """(id, parent, rel) of the incoming edge with the highest priority, then confidence, then smallest id."""
    order = Window.partitionBy("to_id").orderBy(priority.desc(), F.coalesce("confidence", F.lit(0.0)).desc(), "from_id", "rel")
    return edges.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(F.col("to_id").alias("id"), F.col("from_id").alias("parent"), "rel")


def trace_back(terminals: DataFrame, edges: DataFrame, priority: Column, max_hops: int = 8) -> DataFrame:
    """(terminal, hop, id, rel): from each terminal along best parents, up to max_hops or a node seen before."""
    parents = cut(best_parent(edges, priority))
    at = terminals.select(F.col("id").alias("terminal"), "id", F.array("id").alias("seen"), F.lit(0).alias("hop"), F.lit(None).cast("string").alias("rel"))
    out = at
    for hop in range(1, max_hops + 1):
        at = cut(at.select("terminal", "id", "seen").join(parents, "id").filter(~F.array_contains("seen", F.col("parent"))).select("terminal", F.col("parent").alias("id"), F.concat("seen", F.array("parent")).alias("seen"), F.lit(hop).alias("hop"), "rel"))
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out.select("terminal", "hop", "id", "rel")


def expand(seeds: DataFrame, edges: DataFrame, rels: list[str], depth: int, limit: int) -> DataFrame:
    """(id, depth) around the seeds over allowed relations, cut at limit by (depth, id)."""
    return reach(seeds, edges.filter(F.col("rel").isin(*rels)), "both", depth).orderBy("depth", "id").limit(limit)


def closure(seeds: DataFrame, entities: DataFrame, edges: DataFrame, max_depth: int = 4) -> dict[str, DataFrame]:
    """Program closures of all seeds (start, id) in one walk over CALLS and CALLS_PROC.

    nodes: (start, id, type, depth); data: (start, id, op), the op of the nearest edge; contracts; confidences of all edges out of the nodes. Ends that are no entity are left out.
    """
    known, edges = entities.select("id", "type"), settled(edges)
    moves = edges.filter(F.col("rel").isin("CALLS", "CALLS_PROC")).join(known.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    nodes = cut(reach(seeds, moves, "downstream", max_depth, by=("start",)).join(known, "id"))
    out = nodes.withColumnRenamed("id", "from_id").join(edges, "from_id")
    io = out.filter(F.col("rel").isin("READS", "WRITES", "UPDATES")).join(known.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    data = io.groupBy("start", F.col("to_id").alias("id")).agg(F.min_by("rel", F.struct("depth", "from_id", "rel")).alias("op"))
    contracts = out.filter("rel = 'DATA_CONTRACT'").select("start", "from_id", "to_id").distinct()
    confidence = out.groupBy("start").agg(F.sum(F.coalesce("confidence", F.lit(1.0))).alias("total"), F.count("*").alias("n"))
    return {"nodes": nodes, "data": data, "contracts": contracts, "confidence": confidence}


def top_degree(entities: DataFrame, edges: DataFrame, limit: int = 500, cap: int = 2000) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree (ties by id), and the edges among them."""
    edges = settled(edges)
    ranked = entities.join(degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    nodes = cut(ranked.orderBy(F.desc("degree"), "id").limit(min(limit, cap)))
    return nodes, induced(edges, nodes)


def reduce_graph(nodes: DataFrame, edges: DataFrame, weight: Column, limit: int = 28, priority: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Keeps the nodes of highest weight and folds the others into one summary node for each type.

    nodes: (id, type, ...). Edges are led to the summaries, made distinct, cut at the larger of three times limit and 24 by priority, and nodes without an edge left out.
    """
    edges = settled(edges)
    # the limit is the feature: the top nodes are found by a bounded sort, not by a rank over all
    kept = cut(nodes.withColumn("__w", weight).orderBy(F.desc("__w"), "id").limit(limit).select("id"))
    place = cut(nodes.select("id", "type").join(kept.withColumn("__kept", F.lit(True)), "id", "left").select("id", F.when(F.col("__kept"), F.col("id")).otherwise(F.concat(F.lit("summary:"), "type")).alias("node")))
    a, b = place.select(F.col("id").alias("from_id"), F.col("node").alias("f")), place.select(F.col("id").alias("to_id"), F.col("node").alias("t"))
    led = edges.join(a, "from_id").join(b, "to_id").filter("f <> t").groupBy(F.col("f").alias("from_id"), F.col("t").alias("to_id"), "rel").agg(F.count("*").alias("n"))
    order = [(priority if priority is not None else F.col("n")).desc(), F.col("from_id"), F.col("to_id"), F.col("rel")]
    led = cut(led.orderBy(*order).limit(max(3 * limit, 24)))
    ends = led.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    shown = place.groupBy("node").agg(F.count("*").alias("members")).join(ends, "node", "left_semi")
    return shown, led


def call_graph(edges: DataFrame) -> DataFrame:
    """(id, n_callees, n_callers) over calls of programs, by distinct partner."""
    used = edges.filter(F.col("rel").isin("CALLS", "CALLS_PROC")).select("from_id", "to_id").distinct()
    ends = used.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(used.select("to_id", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("n_callees"), F.sum("i").alias("n_callers"))
