"""Deep analysis of a seed: phases, semantic objects, citations, claims, completeness and the quality gate.

Everything is a table keyed by seed and phase; documents are nested only on export.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import platform
from ..functions.storage import cut
from . import graph, ordering
from . import phases as forms
from .packs import GENERIC, Pack
from .phases import mapped, relation_phase, step_phase  # noqa: F401

# Priorities of incoming edges, roles of data, paths that are no files, criteria that block.
REVERSE_PRIORITY = {"CALLS_SP": 7, "WRITES": 6, "UPDATES": 6, "EMITS": 6, "GENERATES_REPORT": 6, "TRANSFERS_TO": 6, "CALLS_PROC": 5, "CALLS": 5, "EXECUTES": 5, "READS": 4, "RECEIVES": 4, "VALIDATES": 3, "ROUTES_TO": 3, "TRANSITIONS_TO": 3}
ROLES = ((r"(?i)(RETORNO|FINAL|ASSIN|PROTOCOLO)", "return"), (r"(?i)(OUT|SAIDA|REMESSA|EMIT|RELATOR|REPORT)", "outbound"), (r"(?i)(TMP|TEMP|AUX|WORK|STG|STAGE)", "staging"), (r"(?i)(PARM|PARAM|DOM|TIPO|STATUS|CONTROLE|CTRL)", "control"))
PSEUDO_PATH = r"(?i)^(resolved-via-flow|inferred|summary|lineage|analysis):"
CRITICAL_CRITERIA = ("resolution", "phases", "persistence", "outputs", "citations", "reverse_trace")
FIELDS = ("objective", "trigger", "actors", "processing", "inputs", "persistence", "outputs", "decisions", "contingencies")
def reverse_priority(rel: Column) -> Column:
    return mapped(rel, REVERSE_PRIORITY, 1)


def data_role(label: Column, kind: Column, written: Column) -> Column:
    """return, outbound, staging or control by name; else master or domain for tables, outbound for datasets."""
    out = F.when(kind == "table", F.when(written, "master").otherwise("domain")).when(kind == "dataset", "outbound").otherwise("control")
    for pattern, role in reversed(ROLES):
        out = F.when(label.rlike(pattern), role).otherwise(out)
    return out


def claim_type(has_text: Column, navigable: Column, has_evidence: Column) -> Column:
    return F.when(has_text & navigable, "fact").when(has_text & has_evidence, "inference").otherwise("hypothesis")


def related(seeds: DataFrame, relations: DataFrame, depth: int = 2) -> DataFrame:
    """Relations within depth + 1 hops of the seeds (id), in any direction, once each."""
    return graph.traverse(seeds, relations, "both", depth).drop("depth").distinct()


def citations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(citation_id, path, line, extractor, navigable, n_owners): distinct places of evidence, numbered CIT-001, CIT-002, ... by path, line and extractor over all of them.

    All extractors count, inferred ones too. Numbers come from ranges of the order, so that no task sorts all places.
    """
    e = entities.select(F.explode("files").alias("path"), "line", "extractor", F.col("id").alias("owner"))
    r = relations.select(F.explode("evidence").alias("ref"), "extractor", F.concat_ws("|", "from_id", "rel", "to_id").alias("owner"))
    r = r.select(F.regexp_replace("ref", ":[0-9]+$", "").alias("path"), F.regexp_extract("ref", ":([0-9]+)$", 1).alias("n"), "extractor", "owner").select("path", F.when(F.length("n") > 0, F.col("n").cast("int")).alias("line"), "extractor", "owner")
    places = e.unionByName(r).groupBy("path", "line", "extractor").agg(F.count_distinct("owner").alias("n_owners"))
    places = ordering.numbered(places, [F.col("path"), F.coalesce("line", F.lit(0)), F.coalesce("extractor", F.lit(""))], "n")
    return places.withColumn("navigable", F.col("line").isNotNull() & ~F.col("path").rlike(PSEUDO_PATH)).withColumn("citation_id", ordering.padded(F.col("n"), "CIT-")).drop("n")


def phases(relations: DataFrame, entities: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, kind, seq, label, objective, trigger, actors, processing, inputs, persistence, outputs, evidence, confidence) from relations (seed, ...), one row for each kind that has any; evidence holds the first places, n_evidence counts them."""
    kinds = entities.select("id", "type", "label")
    r = relations.join(kinds.select(F.col("id").alias("from_id"), F.col("type").alias("ft"), F.col("label").alias("fl")), "from_id", "left").join(kinds.select(F.col("id").alias("to_id"), F.col("type").alias("tt"), F.col("label").alias("tl")), "to_id", "left")
    r = r.withColumn("kind", relation_phase(F.col("rel"), F.col("ft"), F.col("tt"))).filter("kind is not null")
    pick = lambda test, c: F.array_sort(F.collect_set(F.when(test, F.col(c))))
    out = r.groupBy(by, "kind").agg(
        pick(F.col("ft").isin("program", "step", "screen", "procedure", "paragraph"), "fl").alias("processing"),
        pick(F.col("rel").isin(*forms.INTAKE), "tl").alias("inputs"),
        pick(F.col("rel").isin("WRITES", "UPDATES", "CALLS_SP") & F.col("tt").isin("table", "procedure"), "tl").alias("persistence"),
        pick(F.col("rel").isin(*forms.OUTPUT, "UPDATES") & (F.col("tt") == "dataset"), "tl").alias("outputs"),
        pick(F.col("rel").isin(*forms.VALIDATION), "tl").alias("decisions"),
        F.round(F.avg("confidence"), 2).alias("confidence"),
        F.array_sort(F.collect_set(platform(F.col("ft")))).alias("platforms"),
    )
    order = mapped(F.col("kind"), {k: i for i, k in enumerate(forms.KINDS)}, 9)
    out = out.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    proof = forms.shown(r.select(by, "kind", F.explode("evidence").alias("ref")).distinct(), [by, "kind"], "ref", forms.MOST_EVIDENCE)
    out = out.join(proof.select(by, "kind", F.col("values").alias("evidence"), F.col("n").alias("n_evidence")), [by, "kind"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    out = out.select("*", *forms.texts(F.col("kind"), GENERIC.phases), mapped(F.col("kind"), forms.TRIGGERS, "").alias("trigger"))
    return out.withColumn("contingencies", F.filter("decisions", lambda d: d.rlike(r"(?i)(ERR|ABEND|RC|STATUS)")))


def claims(phases_: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, phase, seq, field, text, type, critical, confidence): one claim for each field of a phase. A piece of evidence with a line is navigable."""
    nav = F.exists("evidence", lambda e: e.rlike(":[0-9]+$") & ~e.rlike(PSEUDO_PATH))
    last = F.max("seq").over(Window.partitionBy(by))
    p = phases_.withColumn("nav", nav).withColumn("last", last)
    size = lambda c: F.size(c) > 0
    kind, ends = F.col("kind"), F.col("seq") == F.col("last")
    critical = {"objective": F.lit(True), "trigger": F.lit(False), "actors": F.lit(True), "processing": F.lit(True), "inputs": (kind == "intake") | (F.col("seq") == 1), "persistence": (kind == "persistence") | size("persistence"), "outputs": (kind == "output") | ends | size("outputs"), "decisions": (kind == "validation") | size("decisions"), "contingencies": size("contingencies") | (kind == "validation") | ends}
    text = lambda f: F.col(f) if f in ("objective", "trigger") else F.array_join(f, ", ")
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(f).alias("text"), critical[f].alias("critical")) for f in FIELDS]))
    c = p.select(by, F.col("kind").alias("phase"), "seq", "confidence", "nav", (F.size("evidence") > 0).alias("has"), rows.alias("c")).select(by, "phase", "seq", "confidence", "nav", "has", "c.*")
    return c.withColumn("type", claim_type(F.length(F.trim("text")) > 0, F.col("nav"), F.col("has"))).drop("nav", "has")


def facts_only(phases_: DataFrame, claims_: DataFrame, by: str = "seed") -> DataFrame:
    """Phases with the fields blank that are no facts."""
    facts = claims_.filter("type = 'fact'").groupBy(by, F.col("phase").alias("kind")).agg(F.collect_set("field").alias("__facts"))
    out = phases_.join(facts, [by, "kind"], "left").withColumn("__facts", F.coalesce("__facts", F.array().cast("array<string>")))
    for f in FIELDS:
        empty = F.lit("") if f in ("objective", "trigger") else F.array().cast("array<string>")
        out = out.withColumn(f, F.when(F.array_contains("__facts", f), F.col(f)).otherwise(empty))
    return out.drop("__facts")


def missing_fields(phases_: DataFrame, claims_: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, phase, missing): critical fields of a phase without a fact."""
    return claims_.filter("critical").groupBy(by, "phase").agg(F.array_sort(F.collect_set(F.when(F.col("type") != "fact", F.col("field")))).alias("missing"))


def handoffs(phases_: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, from_kind, to_kind): neighbouring phases on different platforms."""
    w = Window.partitionBy(by).orderBy("seq")
    nxt = phases_.select(by, F.col("kind").alias("from_kind"), F.lead("kind").over(w).alias("to_kind"), "platforms", F.lead("platforms").over(w).alias("next_platforms"))
    return nxt.filter(F.col("to_kind").isNotNull() & (F.col("platforms") != F.col("next_platforms"))).select(by, "from_kind", "to_kind")


def states(phases_: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, state, next): labels of the phases as states, with the one that follows."""
    return phases_.select(by, F.col("label").alias("state"), F.lead("label").over(Window.partitionBy(by).orderBy("seq")).alias("next"))


def rules(relations: DataFrame) -> DataFrame:
    """(from_id, rule, evidence): conditions and routes that programs apply."""
    return relations.filter(F.col("rel").isin(*forms.VALIDATION)).select("from_id", F.concat_ws(" ", "rel", "to_label").alias("rule"), "evidence")


def errors(relations: DataFrame) -> DataFrame:
    """(from_id, label): return codes, abends and error fields that are looked at."""
    return relations.filter(F.col("to_label").rlike(r"(?i)\b(RC|ABEND|ERRO|ERROR|SQLCODE|STATUS|RETURN-CODE)\b")).select("from_id", F.col("to_label").alias("label"))


def objects(entities: DataFrame) -> DataFrame:
    """(kind, id, label): stored procedures, file layouts and external components."""
    kind = F.when(F.col("type").isin("procedure", "stored_procedure"), "procedure").when(F.col("type").isin("copybook", "message_layout"), "layout").when(F.col("type") == "component", "external")
    return entities.select(kind.alias("kind"), "id", "label").filter("kind is not null")


def data_model(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, type, label, role) of tables, datasets and procedures."""
    written = relations.filter(F.col("rel").isin("WRITES", "UPDATES")).select(F.col("to_id").alias("id")).distinct().withColumn("w", F.lit(True))
    e = entities.filter(F.col("type").isin("table", "dataset", "procedure") & (F.length(F.trim("label")) >= 3)).join(written, "id", "left")
    return e.select("id", "type", "label", data_role(F.col("label"), F.col("type"), F.coalesce("w", F.lit(False))).alias("role"))


def columns_by_table(entities: DataFrame) -> DataFrame:
    return entities.filter("type = 'column'").groupBy(F.coalesce("parent", F.lit("UNSCOPED")).alias("parent")).agg(F.array_sort(F.collect_set("label")).alias("columns"))


def reverse_traces(terminals: DataFrame, relations: DataFrame, hops: int = 8) -> DataFrame:
    return graph.trace_back(terminals, relations, reverse_priority(F.col("rel")), hops)


def traceability(phases_: DataFrame, claims_: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, phase, status): facts over critical fields of each phase."""
    n = claims_.groupBy(by, "phase").agg(F.count_if(F.col("type") == "fact").alias("facts"), F.count_if("critical").alias("total"))
    return n.select(by, "phase", F.when(F.col("total") > 0, F.concat_ws("/", F.col("facts").cast("string"), F.col("total").cast("string"))).otherwise("none").alias("status"))


def completeness(criteria: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, total_pct, status, gaps) of criteria (seed, id, ok): complete without a critical gap from 85 percent, partial from 55, else draft."""
    g = criteria.groupBy(by).agg(F.floor(100 * F.avg(F.col("ok").cast("double")) + 0.5).alias("total_pct"), F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("id")))).alias("gaps"))
    critical = F.size(F.array_intersect("gaps", F.array(*[F.lit(c) for c in CRITICAL_CRITERIA])))
    return g.withColumn("status", F.when((critical == 0) & (F.col("total_pct") >= 85), "complete").when(F.col("total_pct") >= 55, "partial").otherwise("draft"))


def criteria(seed_rows: DataFrame, phases_: DataFrame, claims_: DataFrame, traces: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, id, ok) of the eleven criteria. seed_rows: (seed, resolved)."""
    fact = lambda f: F.max((F.col("field") == f) & (F.col("type") == "fact"))
    c = claims_.groupBy(by).agg(fact("processing").alias("orchestration"), fact("persistence").alias("persistence"), fact("outputs").alias("outputs"), fact("decisions").alias("rules"), fact("contingencies").alias("errors"), F.min((F.col("type") == "fact") | ~F.col("critical")).alias("citations"))
    p = phases_.groupBy(by).agg((F.count("*") >= 3).alias("enough"), (F.count("*") >= 2).alias("states"))
    h = handoffs(phases_, by).select(by).distinct().withColumn("handoffs", F.lit(True))
    t = traces.filter("hop > 0").select(by).distinct().withColumn("reverse_trace", F.lit(True))
    all_ = seed_rows.join(c, by, "left").join(p, by, "left").join(h, by, "left").join(t, by, "left").withColumn("phases", F.col("enough") & F.col("citations")).withColumnRenamed("resolved", "resolution")
    ids = ("resolution", "phases", "orchestration", "handoffs", "persistence", "outputs", "rules", "states", "errors", "citations", "reverse_trace")
    return all_.select(by, F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.coalesce(F.col(i), F.lit(False)).alias("ok")) for i in ids])).alias("c")).select(by, "c.*")


def gate(score: DataFrame, missing: DataFrame, phases_: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, status, complete, blockers, warnings): any blocker makes complete partial."""
    m = missing.filter(F.size("missing") > 0).groupBy(by).agg(F.array_sort(F.collect_set(F.concat(F.lit("phase:"), "phase"))).alias("ph"))
    many = phases_.groupBy(by).agg((F.size(F.array_distinct(F.flatten(F.collect_list("platforms")))) > 1).alias("many"))
    g = score.join(m, by, "left").join(many, by, "left")
    none = F.array().cast("array<string>")
    blockers = F.concat(F.array_intersect("gaps", F.array(*[F.lit(c) for c in CRITICAL_CRITERIA])), F.coalesce("ph", none))
    warnings = F.concat(F.when(F.coalesce("many", F.lit(False)) & F.array_contains("gaps", "handoffs"), F.array(F.lit("handoff_inference"))).otherwise(none), F.when(F.array_contains("gaps", "reverse_trace"), F.array(F.lit("reverse_trace"))).otherwise(none))
    g = g.withColumn("blockers", blockers).withColumn("warnings", warnings)
    ok = F.size("blockers") == 0
    return g.select(by, F.when(ok | (F.col("status") != "complete"), F.col("status")).otherwise("partial").alias("status"), (ok & (F.col("status") == "complete")).alias("complete"), "blockers", "warnings")


def gap_list(score: DataFrame, gates: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, id, severity): gaps of criteria and of phases."""
    high = ("resolution", "phases", "persistence", "outputs", "citations")
    a = score.select(by, F.explode("gaps").alias("id")).select(by, F.concat(F.lit("gap:"), "id").alias("id"), F.when(F.col("id").isin(*high), "high").otherwise("medium").alias("severity"))
    b = gates.select(by, F.explode(F.filter("blockers", lambda x: F.startswith(x, F.lit("phase:")))).alias("id")).select(by, F.concat(F.lit("gap:"), "id"), F.lit("high"))
    return a.union(b).distinct()


def main_flows(seeds: DataFrame, flows: DataFrame) -> DataFrame:
    """(seed, flow_id or null): for each seed (seed, id) the flow that begins at one of its ids, else one that has it as a subject; the first by id."""
    met = flows.select(F.col("entry_id").alias("flow_id"), F.explode("subject_ids").alias("id")).union(flows.select("entry_id", "entry_id")).distinct()
    hit = seeds.join(met, "id").groupBy("seed").agg(F.min(F.struct((F.col("flow_id") != F.col("id")).cast("int").alias("far"), "flow_id")).alias("f"))
    return seeds.select("seed").distinct().join(hit, "seed", "left").select("seed", F.col("f.flow_id").alias("flow_id"))


def analyze(seeds: DataFrame, entities: DataFrame, relations: DataFrame, depth: int = 2, flows: DataFrame | None = None, steps: DataFrame | None = None, pack: Pack = GENERIC) -> dict[str, DataFrame]:
    """The whole dossier of seeds (seed, id), as tables; all seeds go through each step together. With flows and steps, phases take the form of the seed's flow."""
    nodes = cut(graph.reach(seeds, relations, "both", depth, by=("seed",)))
    r = relations.join(nodes.select("seed", F.col("id").alias("from_id")), "from_id").unionByName(relations.join(nodes.select("seed", F.col("id").alias("to_id")), "to_id")).dropDuplicates(["seed", "rel", "from_id", "to_id"])
    r = cut(r)
    if flows is None or steps is None:
        p, more = cut(phases(r, entities)), {}
    else:
        more = forms.built(main_flows(seeds, flows), r, entities, flows, steps, pack)
        p = cut(more.pop("phases"))
    c = cut(claims(p))
    ends = nodes.join(entities.filter(F.col("type").isin("dataset", "table", "procedure")).select("id"), "id", "left_semi").select("seed", F.col("id").alias("terminal"))
    walked = reverse_traces(ends.select(F.col("terminal").alias("id")).distinct(), relations)
    traces = cut(ends.join(walked, "terminal"))
    resolved = seeds.join(entities.filter(~F.col("type").isin("step", "field", "column", "table", "control", "paragraph") & ~F.coalesce("inferred", F.lit(False))).select("id", F.lit(True).alias("r")), "id", "left").groupBy("seed").agg(F.coalesce(F.max("r"), F.lit(False)).alias("resolved"))
    crit = cut(criteria(resolved, p, c, traces))
    score = cut(completeness(crit))
    gates = gate(score, missing_fields(p, c), p)
    return {"phases": p, "claims": c, "traces": traces, "criteria": crit, "score": score, "gate": gates, "gaps": gap_list(score, gates), "handoffs": handoffs(p), "states": states(p), "rules": rules(r), "errors": errors(r), "objects": objects(entities.join(nodes.select("id").distinct(), "id", "left_semi")), "data_model": data_model(entities.join(nodes.select("id").distinct(), "id", "left_semi"), r), "citations": citations(entities.join(nodes.select("id").distinct(), "id", "left_semi"), r), "traceability": traceability(p, c), "relations": r} | {f"phase_{k}": v for k, v in more.items()}
