"""From a question to what it is about: entities, flows, terminals and bridges as candidates of one ranking.

Each candidate gathers a cluster: what its flows hold and what lies around it, hop by hop, up to a
number of nodes. All clusters grow together; a hop takes the new nodes of each cluster in the order
of their ids until the cluster is full, so hubs add no more rows than fit. Measures of a cluster
(platforms, inputs, stores, outputs, signals) and its fit with the pack of the domain raise the
score; the ranking is then steadied (a weak best one gives way to a feature cluster near it) and
refined (other candidates that cover what is missing are merged into the best one).

Scores are the same for every layout of the data: where the order of rows would decide, depth and
id or label do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import platform
from ..functions.storage import cut, settled
from ..functions.text import half_up, score_text
from . import packs, search
from .packs import GENERIC, Pack

# Types of entities by what they can be in a question, and their weights.
WEAK_TYPES, WEAK_ANCHORS = ("field", "column", "control", "paragraph", "step"), ("step", "field", "column", "table", "control", "paragraph")
ENTRY_TYPES, ACTOR_TYPES = ("job", "screen", "program", "project"), ("screen", "project", "component", "class", "module", "subroutine")
BRIDGE_TYPES = ("job", "step", "program", "screen", "project", "component", "class", "module", "procedure", "table", "dataset")
TYPE_WEIGHT = {"job": 34, "screen": 32, "table": 30, "procedure": 30, "project": 28, "program": 22, "dataset": 20, "module": 16, "class": 16, "component": 12, "copybook": 12, "field": 2, "column": 2, "control": 2, "paragraph": 2}
OTHER_WEIGHT, WEAK_PENALTY = 6, 28
# What a question of a seed type may be about; types that are not named allow everything.
ENTITY_SEEDS = {
    "table": ("table",), "field": ("field",), "column": ("column",), "dataset": ("dataset",), "program": ("program",), "procedure": ("procedure",), "stored-procedure": ("procedure",),
    "screen": ("screen", "class", "module", "project", "component"), "vb6": ("screen", "class", "module", "project", "component"), "batch": ("job", "step", "program", "dataset"),
}
FLOW_SEEDS = {"batch": "batch", "screen": "screen", "vb6": "screen", "program": "program_entry"}
# Relations by what they tell of an entity or a cluster.
WRITING, CROSSING = ("WRITES", "UPDATES", "CALLS_SP", "EMITS", "GENERATES_REPORT", "TRANSFERS_TO"), ("TRANSFERS_TO", "USES_DLL", "CALLS_SP", "TRIGGERS", "HANDLES_EVENTS", "USES")
CHAIN, READING = ("CALLS", "CALLS_PROC", "CALLS_SP", "EXECUTES", "TRIGGERS", "USES_DLL"), ("READS", "RECEIVES")
STORING, SENDING, RULING = ("WRITES", "UPDATES", "CALLS_SP"), ("WRITES", "EMITS", "GENERATES_REPORT", "TRANSFERS_TO"), ("VALIDATES", "ROUTES_TO", "TRANSITIONS_TO", "CHECKPOINTS")
WALKED = (
    "CALLS", "CALLS_PROC", "CALLS_SP", "EXECUTES", "READS", "WRITES", "UPDATES", "VALIDATES", "ROUTES_TO", "TRANSITIONS_TO", "EMITS", "RECEIVES", "TRANSFERS_TO", "USES_DLL", "TRIGGERS", "GENERATES_REPORT",
    "CHECKPOINTS", "USES", "HANDLES", "HANDLES_EVENTS", "DATA_CONTRACT", "CONTAINS", "PERFORMS", "GO-TO", "TRANSFORMS",
)
ERROR_WORDS = r"(?i)\b(ABEND|ERROR|ERRO|FAIL|FALHA|INVALID|NOT\s+FOUND|NAO\s+ENCONTR|REJECT|REJEIT|RC=|RETURN\s+CODE)\b"
STATE_WORDS = r"(?i)\b(STATUS|SITUAC|STATE|ESTADO|FASE|ETAPA)\b"
CATEGORY_WEIGHT = {"feature_cluster": 60, "flow": 44, "entrypoint": 30}
OTHER_CATEGORY = 8
#: What a written end and a crossing add; candidates of each kind; nodes of a cluster by what began it.
WRITTEN, CROSSED = 20, 18
MOST_FLOWS, MOST_ENTITIES, MOST_TERMINALS, MOST_BRIDGES = 10, 16, 12, 12
FLOW_NODES, ENTITY_NODES, REFINED_NODES = 120, 132, 160
LISTED, MOST_TEXT, NO_CONFIDENCE = 12, 42, 0.6


def one_of(c: Column, table: dict, default: int) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def type_weight(kind: Column) -> Column:
    return one_of(F.lower(F.coalesce(kind, F.lit(""))), TYPE_WEIGHT, OTHER_WEIGHT)


def category_weight(category: Column) -> Column:
    return one_of(category, CATEGORY_WEIGHT, OTHER_CATEGORY)


def accepted(entities: DataFrame, seed_type: str | None = None) -> DataFrame:
    """Entities that a question of this seed type may be about; all of them without one."""
    kinds = ENTITY_SEEDS.get((seed_type or "").lower())
    return entities.filter(F.col("type").isin(*kinds)) if kinds else entities


def accepted_flows(flows: DataFrame, seed_type: str | None = None) -> DataFrame:
    kind = FLOW_SEEDS.get((seed_type or "").lower())
    return flows.filter(F.col("type") == kind) if kind else flows


def texts(columns: list[str], names: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """Array of those columns that there are."""
    out = F.array(*[F.col(c).cast("string") for c in names if c in columns])
    for c in lists:
        out = F.concat(out, F.coalesce(F.col(c), F.array().cast("array<string>"))) if c in columns else out
    return out


def described(columns: list[str]) -> Column:
    return F.concat_ws(" ", *[F.col(c) for c in ("label", "name", "description") if c in columns])


def ranked(entities: DataFrame, query: str) -> DataFrame:
    """entities with score: likeness to the query in any of their texts, and the weight of their type; without likeness no row."""
    base = score_text(F.lit(query), texts(entities.columns, ("id", "name", "label", "parent", "type", "description"), ("semantic_tags", "files")))
    weak = F.when(F.col("type").isin(*WEAK_TYPES), WEAK_PENALTY).otherwise(0)
    return entities.withColumn("base", base).filter("base > 0").withColumn("score", F.col("base") + type_weight(F.col("type")) - weak).drop("base")


def terminals(entities: DataFrame, relations: DataFrame, query: str, pack: Pack = GENERIC, like: DataFrame | None = None) -> DataFrame:
    """(id, type, label, score, terminal_score): ends that a question may mean, by likeness, patterns of the pack and whether anything writes them. like: ranked(entities, query), if it is at hand."""
    into = relations.filter(F.col("rel").isin(*WRITING)).select(F.col("to_id").alias("id")).distinct().withColumn("written", F.lit(WRITTEN))
    like = (ranked(entities, query) if like is None else like).select("id", F.col("score").alias("like"))
    e = entities.select("id", "type", "label", packs.terminal_score(described(entities.columns), pack).alias("terminal_score")).join(like, "id", "left").filter("like is not null or terminal_score > 0")
    e = e.join(into, "id", "left")
    return e.select("id", "type", "label", (F.coalesce("like", F.lit(0)) + F.col("terminal_score") + F.coalesce("written", F.lit(0))).alias("score"), "terminal_score")


def bridges(entities: DataFrame, relations: DataFrame, query: str, pack: Pack = GENERIC) -> DataFrame:
    """(id, type, label, score): what may carry a flow across platforms, by likeness to the query with the pack's terms, patterns of the pack and relations that cross."""
    asked = " ".join([query, *pack.terms, *pack.systems])
    e = entities.filter(F.col("type").isin(*BRIDGE_TYPES))
    like = score_text(F.lit(asked), texts(e.columns, ("id", "name", "label", "description"), ("semantic_tags",)))
    met = relations.filter(F.col("rel").isin(*CROSSING)).select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("crossed", F.lit(CROSSED))
    e = e.select("id", "type", "label", (like + packs.handoff_score(described(e.columns), pack)).alias("own")).join(met, "id", "left")
    return e.select("id", "type", "label", (F.col("own") + F.coalesce("crossed", F.lit(0))).alias("score")).filter("score > 0")


def best(df: DataFrame, most: int, *order) -> DataFrame:
    """The first rows; a bounded table."""
    return df.orderBy(F.desc("score"), *order, "id").limit(most)  # the limit is the feature


# --- clusters ---------------------------------------------------------------------------------------


def grown(seeds: DataFrame, relations: DataFrame, depth: int) -> DataFrame:
    """(candidate, id) of clusters that begin with seeds (candidate, id, hops, most): hop by hop, ids in order, until a cluster has its hops or as many nodes as it may."""
    moves = relations.filter(F.col("rel").isin(*WALKED))
    moves = cut(moves.select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).union(moves.select("to_id", "from_id")).distinct())
    nodes = cut(seeds.groupBy("candidate", "id").agg(F.max("hops").alias("hops"), F.max("most").alias("most")))
    frontier = nodes
    for k in range(1, depth + 1):
        size = nodes.groupBy("candidate").agg(F.count("*").alias("size"))
        ahead = moves.join(F.broadcast(frontier.filter(F.col("hops") >= k)), "id").select("candidate", F.col("next").alias("id"), "hops", "most").distinct()  # as many rows as all clusters may hold
        ahead = ahead.join(F.broadcast(nodes.select("candidate", "id")), ["candidate", "id"], "left_anti").join(F.broadcast(size), "candidate")
        n = F.row_number().over(Window.partitionBy("candidate").orderBy("id"))
        frontier = cut(ahead.withColumn("n", n).filter(F.col("n") <= F.col("most") - F.col("size")).select("candidate", "id", "hops", "most"))
        if frontier.isEmpty():
            break
        nodes = nodes.unionByName(frontier)
    return cut(nodes.select("candidate", "id"))


def measured(nodes: DataFrame, entities: DataFrame, relations: DataFrame, flows: DataFrame, query: str, pack: Pack = GENERIC, terminal: str | None = None) -> DataFrame:
    """Measures of clusters (candidate, id), one row for each: platforms, counts, signals, fit and confidences. nodes is bounded, see grown()."""
    near = F.broadcast(nodes)
    columns = entities.columns
    name, text = F.coalesce("label", "name"), described(columns)
    tags = F.coalesce(F.col("semantic_tags"), F.array().cast("array<string>")) if "semantic_tags" in columns else F.array().cast("array<string>")
    about = F.concat(F.array(*[F.col(c) for c in ("description",) if c in columns]), tags).cast("array<string>")
    hint = score_text(F.lit(terminal), texts(columns, ("id", "name", "label", "description"))) if terminal else F.lit(0)
    e = entities.join(near, "id").select(
        "candidate", "id", "type", platform(F.col("type")).alias("platform"), F.col("confidence"), F.filter(about, lambda x: x.isNotNull()).alias("about"), name.rlike(STATE_WORDS).alias("state"),
        (name.rlike(ERROR_WORDS) | F.coalesce(F.col("description").rlike(ERROR_WORDS), F.lit(False)) if "description" in columns else name.rlike(ERROR_WORDS)).alias("error"),
        (F.greatest(packs.terminal_score(text, pack), hint) > 0).alias("end"),
    )
    e = cut(e)
    of = e.groupBy("candidate").agg(
        F.count_distinct("platform").alias("n_platforms"), F.max(F.col("platform") == "vb6-desktop").alias("desktop"), F.count_if(F.col("type").isin("component", "project")).alias("external"), F.count_if("state").alias("e_state"), F.count_if("error").alias("e_error"),
        F.count_if(F.col("type").isin(*ACTOR_TYPES)).alias("e_actor"), F.count_if("end").alias("ends"), F.avg("confidence").alias("entity_confidence"),
    )
    # Relations that touch a cluster, once each.
    labels = entities.select("id", name.alias("l"))
    touching = relations.select("rel", "from_id", "to_id", "confidence")
    touching = touching.join(F.broadcast(nodes.withColumnRenamed("id", "from_id")), "from_id").unionByName(touching.join(F.broadcast(nodes.withColumnRenamed("id", "to_id")), "to_id")).dropDuplicates(["candidate", "rel", "from_id", "to_id"])
    touching = touching.join(labels.select(F.col("id").alias("from_id"), F.col("l").alias("fl")), "from_id", "left").join(labels.select(F.col("id").alias("to_id"), F.col("l").alias("tl")), "to_id", "left")
    touching = cut(touching.withColumn("fl", F.coalesce("fl", "from_id")).withColumn("tl", F.coalesce("tl", "to_id")))
    rel, either = F.col("rel"), lambda p: F.col("fl").rlike(p) | F.col("tl").rlike(p)
    r = touching.groupBy("candidate").agg(
        F.max(rel.isin(*READING)).alias("has_inputs"), F.max(rel.isin(*STORING)).alias("has_persistence"), F.max(rel.isin(*SENDING)).alias("has_outputs"), F.count_if(rel.isin(*RULING)).alias("rules"),
        F.count_if(either(ERROR_WORDS)).alias("r_error"), F.count_if(either(STATE_WORDS)).alias("r_state"), F.count_if(packs.handoff_score(F.concat_ws(" ", "fl", "tl"), pack) > 0).alias("r_actor"), F.avg("confidence").alias("relation_confidence"),
    )
    links = touching.filter(rel.isin(*CHAIN)).select("candidate", F.explode(F.array("fl", "tl")).alias("l")).distinct().groupBy("candidate").agg(F.count("*").alias("chain"))
    subjects = flows.select("entry_id", F.explode("subject_ids").alias("id")).join(near, "id").select("candidate", "entry_id").distinct().groupBy("candidate").agg(F.count("*").alias("n_flows"))
    said = e.select("candidate", F.explode("about").alias("value"))
    like = said.groupBy("candidate").agg(F.least(F.max(score_text(F.lit(query), F.array("value"))), F.lit(MOST_TEXT)).alias("text"))
    # The pack's terms over the descriptions and the first names of what goes in, stays and goes out.
    put = touching.select("candidate", F.explode(F.array_compact(F.array(*[F.when(rel.isin(*kinds), F.struct(F.lit(k).alias("kind"), F.col("tl").alias("value"))) for k, kinds in (("in", READING), ("kept", STORING), ("out", SENDING))]))).alias("x")).select("candidate", "x.kind", "x.value").distinct()
    first = put.withColumn("n", F.row_number().over(Window.partitionBy("candidate", "kind").orderBy("value"))).filter(F.col("n") <= LISTED).select("candidate", "value")
    asked = nodes.select("candidate").distinct().select("candidate", F.lit(query).alias("value"))
    return reduce(lambda a, b: a.join(b, "candidate", "left"), [of, r, links, subjects, like, packs.terms_met(said.union(first).union(asked), pack, ["candidate"])])


def dimensions(m: DataFrame) -> DataFrame:
    """m with the filled measures of clusters, cross_platform and business_fit."""
    for c in ("entity_confidence", "relation_confidence"):
        m = m.withColumn(c, F.coalesce(half_up(F.col(c), 2), F.lit(NO_CONFIDENCE)))
    m = m.fillna(0).fillna(False)
    m = m.withColumn("has_handoff", F.col("n_platforms") > 1).withColumn("errors", F.col("e_error") + F.col("r_error"))
    m = m.withColumn("terminal_presence", (F.col("ends") > 0) | F.col("has_outputs"))
    cross = F.least(F.lit(100), F.col("n_platforms") * 14 + F.when(F.col("has_handoff"), 24).otherwise(0) + F.least(F.col("external") * 6, F.lit(18)))
    fit = F.least(F.lit(100), F.least(F.lit(packs.MOST), F.col("n_terms") * packs.TERM_EACH) + F.when(F.col("terminal_presence"), 18).otherwise(0) + F.when(F.col("rules") > 0, 10).otherwise(0))
    return m.withColumn("cross_platform", cross).withColumn("business_fit", fit)


def average(*columns: str) -> Column:
    """Mean of those that are there, on two digits."""
    some = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return half_up(F.aggregate(some, F.lit(0.0), lambda a, x: a + x) / F.size(some), 2)


ORDER = (F.desc, "score"), (F.desc, "category_weight"), (F.desc, "type_rank"), (F.desc, "confidence"), (F.asc, "label"), (F.asc, "id")


def placed(candidates: DataFrame) -> DataFrame:
    """candidates with place, 1 for the best; a window over a bounded table."""
    c = candidates.withColumn("category_weight", category_weight(F.col("category"))).withColumn("type_rank", type_weight(F.col("anchor_type")))
    return c.withColumn("place", F.row_number().over(Window.orderBy(*[f(n) for f, n in ORDER]))).drop("category_weight", "type_rank")


CANDIDATE = ("id", "category", "label", "anchor_id", "anchor_type", "base_score", "score", "confidence", "weak", "blocked", "n_platforms", "chain", "n_flows", "has_persistence", "has_outputs", "has_handoff", "terminal_presence", "ends", "errors", "cross_platform", "business_fit")


def candidates(entities: DataFrame, relations: DataFrame, flows: DataFrame, query: str, seed_type: str | None = None, depth: int = 4, pack: Pack = GENERIC, terminal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates of a question (CANDIDATE columns, place) and their nodes (candidate, id). flows: entry_id, type, entry_label, entry_name, summary, subject_ids, tokens, programs, procedures, data_objects, confidence."""
    depth = max(1, depth)
    entities, relations, flows = settled(entities), settled(relations), settled(flows)  # each is read many times
    like = cut(ranked(entities, query))
    f = best(search.flows(accepted_flows(flows, seed_type), query).withColumn("id", F.col("entry_id")), MOST_FLOWS, "entry_label").select(F.concat(F.lit("candidate:flow:"), "entry_id").alias("candidate"), "entry_id", F.col("score").alias("match"))
    found = [
        best(accepted(like, seed_type), MOST_ENTITIES, F.desc(type_weight(F.col("type"))), "type", "label").select("id", F.col("score").alias("match"), F.lit(0).alias("rank")),
        best(accepted(terminals(entities, relations, terminal or query, pack, None if terminal else like), seed_type), MOST_TERMINALS, "type", "label").select("id", "score", F.lit(1)),
        best(accepted(bridges(entities, relations, query, pack), seed_type), MOST_BRIDGES, "type", "label").select("id", "score", F.lit(2)),
    ]
    e = reduce(lambda a, b: a.union(b), found).groupBy("id").agg(F.min_by("match", "rank").alias("match"))
    f, e = cut(f), cut(e.select(F.concat(F.lit("candidate:entity:"), "id").alias("candidate"), "id", "match"))
    # What a cluster begins with: a flow with its subjects, or an entity with its flows and theirs.
    parts = flows.select("entry_id", F.explode(F.array_union("subject_ids", F.array("entry_id"))).alias("part"))
    subjects = flows.select("entry_id", F.explode("subject_ids").alias("id"))
    related = cut(subjects.join(F.broadcast(e.select("candidate", "id")), "id").select("candidate", "entry_id").distinct())
    begin = f.join(parts, "entry_id").select("candidate", F.col("part").alias("id"), F.lit(max(2, depth - 1)).alias("hops"), F.lit(FLOW_NODES).alias("most"))
    begin = begin.union(e.select("candidate", "id", F.lit(depth), F.lit(ENTITY_NODES))).union(related.join(parts, "entry_id").select("candidate", "part", F.lit(depth), F.lit(ENTITY_NODES)))
    nodes = grown(begin, relations, max(depth, 2))
    m = dimensions(measured(nodes, entities, relations, flows, query, pack, terminal))
    n = related.groupBy("candidate").agg(F.count("*").alias("own_flows"))
    one = entities.select("id", F.col("type").alias("anchor_type"), F.coalesce("label", "name").alias("label"), F.coalesce("inferred", F.lit(False)).alias("inferred"), F.col("confidence").alias("own_confidence"))
    e = e.join(one, "id").join(n, "candidate", "left").join(m, "candidate", "left").fillna(0, ["own_flows"])
    kind = F.col("anchor_type")
    weak = kind.isin(*WEAK_TYPES) & (F.col("own_flows") == 0)
    category = F.when(F.col("own_flows") > 0, "feature_cluster").when(kind.isin(*ENTRY_TYPES), "entrypoint").otherwise("entity")
    bonus = lambda p, stored, out, over: F.col("n_platforms") * p + F.when(F.col("has_persistence"), stored).otherwise(0) + F.when(F.col("has_outputs"), out).otherwise(0) + F.when(F.col("has_handoff"), over).otherwise(0) + F.col("cross_platform") + F.col("business_fit") + F.col("text")
    e = e.withColumn("weak", weak).withColumn("blocked", weak & (F.col("chain") < 2)).withColumn("category", category)
    e = e.withColumn("score", F.col("match") + category_weight(F.col("category")) + type_weight(kind) + bonus(10, 12, 10, 16) - F.when(F.col("weak"), 70).otherwise(0) - F.when(F.col("inferred"), 14).otherwise(0)).withColumnRenamed("id", "anchor_id")
    rich = F.size("programs") * 3 + F.size("procedures") * 2 + F.size("data_objects") + (F.size("steps") * 4 if "steps" in flows.columns else F.lit(0))
    head = flows.select("entry_id", F.col("type").alias("flow_type"), F.coalesce("entry_label", "entry_name", "entry_id").alias("label"), rich.alias("rich"), F.col("confidence").alias("own_confidence"))
    g = f.join(head, "entry_id").join(m, "candidate", "left").join(entities.select(F.col("id").alias("entry_id"), F.col("type").alias("entry_type")), "entry_id", "left")
    g = g.withColumn("category", F.when((F.col("n_platforms") > 1) | (F.col("n_flows") > 1), "feature_cluster").otherwise("flow")).withColumn("anchor_type", F.coalesce("entry_type", "flow_type")).withColumnRenamed("entry_id", "anchor_id")
    g = g.withColumn("score", F.col("match") + 80 + F.least(F.col("rich"), F.lit(48)) + bonus(12, 16, 12, 18)).withColumn("weak", F.lit(False)).withColumn("blocked", F.lit(False))
    shape = lambda d: d.withColumnRenamed("candidate", "id").withColumnRenamed("match", "base_score").withColumn("confidence", average("own_confidence", "entity_confidence", "relation_confidence")).select(*CANDIDATE)
    return cut(placed(shape(e).unionByName(shape(g)))), nodes


def steadied(ranking: DataFrame, pack: Pack = GENERIC) -> DataFrame:
    """The row of ranking (CANDIDATE, place) that is taken: the best, or the first feature cluster that covers more and scores little less."""
    top = ranking.filter("place = 1").select(F.col("id").alias("top"), F.col("score").alias("top_score"), F.col("anchor_type").alias("top_type"), F.col("cross_platform").alias("top_cross"), F.col("business_fit").alias("top_fit"))
    more = F.col("top_type").isin(*WEAK_ANCHORS) | (F.col("cross_platform") >= F.col("top_cross") + 16)
    if pack.id != GENERIC.id:
        more = more | (F.col("business_fit") >= F.col("top_fit") + 12)
    better = (F.col("id") != F.col("top")) & (F.col("category") == "feature_cluster") & ~F.col("blocked") & more & (F.col("score") >= F.col("top_score") - 42)
    r = ranking.join(F.broadcast(top)).filter((F.col("place") == 1) | better)  # one row
    return r.orderBy((F.col("place") == 1).cast("int"), "place").limit(1).select(*ranking.columns)


def missing() -> list[tuple[str, Column]]:
    """What a cluster may lack: name, and whether a row with the measures has it."""
    return [("persistencia", F.col("has_persistence")), ("saidas", F.col("has_outputs")), ("handoffs", F.col("has_handoff")), ("terminal", F.col("ends") > 0), ("contingencias", F.col("errors") > 0)]


def refined(chosen: DataFrame, ranking: DataFrame, nodes: DataFrame, entities: DataFrame, relations: DataFrame, flows: DataFrame, query: str, depth: int = 4, pack: Pack = GENERIC, terminal: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen candidate with up to three others merged in that have what it lacks (CANDIDATE), and those (id, label); no rows if there are none."""
    lack = chosen.select(F.col("id").alias("mine"), F.col("score").alias("my_score"), F.col("n_platforms").alias("my_platforms"), *[(~has).alias(f"no_{k}") for k, has in missing()])
    adds = reduce(lambda a, b: a | b, [F.col(f"no_{k}") & has for k, has in missing()]) | (F.col("n_platforms") > F.col("my_platforms"))
    gaps = reduce(lambda a, b: a | b, [F.col(f"no_{k}") for k, _ in missing()])
    others = ranking.filter("place > 1 and not weak and not blocked").join(F.broadcast(lack)).filter(gaps & (F.col("id") != F.col("mine")) & (F.col("score") >= F.col("my_score") - 26) & adds)  # one row
    adopted = cut(others.orderBy("place").limit(3).select("id", "label", "place", "mine"))
    ids = adopted.select("id").union(adopted.select("mine")).distinct()
    merged = nodes.join(F.broadcast(ids.withColumnRenamed("id", "candidate")), "candidate", "left_semi").select("id").distinct()  # four ids
    name = F.concat("mine", F.lit(":refined"))
    begin = merged.join(F.broadcast(adopted.select(name.alias("candidate")).distinct())).select("candidate", "id", F.lit(depth).alias("hops"), F.lit(REFINED_NODES).alias("most"))  # one row
    m = dimensions(measured(grown(begin, relations, depth), entities, relations, flows, query, pack, terminal)).withColumnRenamed("candidate", "name")
    own = chosen.select(F.concat("id", F.lit(":refined")).alias("name"), "label", "anchor_id", "anchor_type", "base_score", F.col("confidence").alias("own_confidence"))
    bonus = F.col("n_platforms") * 12 + F.when(F.col("has_persistence"), 16).otherwise(0) + F.when(F.col("has_outputs"), 12).otherwise(0) + F.when(F.col("has_handoff"), 20).otherwise(0)
    score = F.col("base_score") + 100 + bonus + F.col("cross_platform") + F.col("business_fit") + F.col("text") + F.least(F.col("n_flows") * 8, F.lit(24))
    out = own.join(m, "name").withColumnRenamed("name", "id").withColumn("category", F.lit("feature_cluster")).withColumn("score", score).withColumn("weak", F.lit(False)).withColumn("blocked", F.lit(False))
    return out.withColumn("confidence", average("own_confidence", "entity_confidence", "relation_confidence")).select(*CANDIDATE), adopted.select("id", "label")


def resolve_target(entities: DataFrame, relations: DataFrame, flows: DataFrame, query: str, seed_type: str | None = None, depth: int = 4, pack: Pack = GENERIC, terminal: str | None = None, autonomous: bool = True) -> dict[str, DataFrame]:
    """What a question is about: selection (CANDIDATE, status; no row if nothing is like it), candidates, subjects (id) of the selection, what was adopted, terminals and bridges."""
    ranking, nodes = candidates(entities, relations, flows, query, seed_type, depth, pack, terminal)
    chosen = cut(steadied(ranking, pack))
    whole = F.col("has_persistence") & F.col("has_outputs") & F.col("has_handoff") & F.col("terminal_presence") & ~F.col("weak")
    adopted = ranking.limit(0).select("id", "label")
    if autonomous and not chosen.filter(~whole).isEmpty():
        better, taken = refined(chosen, ranking, nodes, entities, relations, flows, query, depth, pack, terminal)
        both = cut(placed(chosen.drop("place").unionByName(better)))
        first = both.filter("place = 1").drop("place")
        if not first.filter(F.endswith("id", F.lit(":refined"))).isEmpty():
            adopted = taken
        old = chosen.select(F.col("id").alias("old"))
        chosen = first.unionByName(ranking.drop("place").join(F.broadcast(old), F.col("id") == F.col("old"), "left_anti"))  # one row
        chosen = cut(steadied(placed(chosen), pack))
    status = F.when(F.col("blocked"), "blocked").when(F.col("weak"), "weak").otherwise("resolved")
    mine = chosen.select(F.regexp_replace("id", ":refined$", "").alias("candidate")).union(adopted.select("id"))
    return {
        "selection": chosen.drop("place").withColumn("status", status), "candidates": ranking, "adopted": adopted, "subjects": nodes.join(F.broadcast(mine), "candidate", "left_semi").select("id").distinct(),  # four rows
        "terminals": best(accepted(terminals(entities, relations, terminal or query, pack), seed_type), MOST_TERMINALS, "type", "label"), "bridges": best(accepted(bridges(entities, relations, query, pack), seed_type), MOST_BRIDGES, "type", "label"),
    }
