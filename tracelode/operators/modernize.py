"""Target plane: phases become services with resources, risk, contracts, waves and a backlog; a target repository is held against the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camel_tokens, normalize_name, slugify
from .dossier import mapped

# What each kind of phase becomes, and the resources that it needs.
COMPONENTS = {
    "intake": ("Spring Batch ingestion worker", ("aks", "blob_storage", "app_insights", "key_vault")),
    "validation": ("Spring Boot validation service", ("aks", "api_management", "app_insights", "key_vault")),
    "processing": ("Spring Boot processing service", ("aks", "api_management", "app_insights", "key_vault")),
    "handoff": ("Spring Boot anti-corruption layer", ("aks", "service_bus", "api_management", "app_insights", "key_vault")),
    "persistence": ("Spring Boot persistence service", ("aks", "azure_sql", "app_insights", "key_vault")),
    "output": ("Spring Batch outbound worker", ("aks", "blob_storage", "service_bus", "app_insights", "key_vault")),
}
SUFFIX = {"intake": "ingestion", "validation": "validation-service", "processing": "processing-service", "handoff": "integration-acl", "persistence": "persistence-service", "output": "delivery-worker"}
WAVES = (("wave-0", "foundation"), ("wave-1", "integration"), ("wave-2", "rules"), ("wave-3", "persistence and delivery"))
FILES, MESSAGES, DESKTOP = r"(?i)(FILE|ARQ|DATASET|CNAB|REMESSA|RETORNO|\.)", r"(?i)(MSG|MESSAGE|QUEUE|CIP|C3|ISD|TOPIC)", r"(?i)(VB6|DESKTOP|FORM|SCREEN|OPERADOR)"
STOP_TOKENS = ("service", "api", "store", "worker", "app", "the", "component")


def some(c: str, pattern: str) -> Column:
    return F.exists(c, lambda x: x.rlike(pattern))


def mappings(phases: DataFrame, by: str = "seed") -> DataFrame:
    """phases with component, resources, integration, coexistence, legacy sources and blockers."""
    kind = F.col("kind")
    base = mapped(kind, {k: "|".join(v[1]) for k, v in COMPONENTS.items()}, "|".join(COMPONENTS["validation"][1]))
    extra = lambda test, r: F.when(test, F.array(F.lit(r))).otherwise(F.array().cast("array<string>"))
    resources = F.array_sort(F.array_distinct(F.concat(F.split(base, r"\|"), extra(F.size("persistence") > 0, "azure_sql"), extra(some("inputs", FILES) | some("outputs", FILES), "blob_storage"), extra((kind == "handoff") | some("inputs", MESSAGES) | some("outputs", MESSAGES), "service_bus"), extra(kind != "intake", "api_management"))))
    desktop = some("actors", DESKTOP)
    component = F.when((kind != "handoff") & desktop, "Spring Boot API facade").otherwise(mapped(kind, {k: v[0] for k, v in COMPONENTS.items()}, COMPONENTS["validation"][0]))
    style = F.when(kind == "handoff", "acl+event-bridge").when(some("outputs", MESSAGES), "event-driven").when(desktop, "rest-api").otherwise("batch-adapter")
    coexist = F.when(kind == "handoff", "anti-corruption-layer + controlled dual write").when(desktop, "api facade + legacy front end").when(F.size("persistence") > 0, "sync with legacy + cutover by checkpoint").otherwise("parallel run + strangler routing")
    return phases.select(
        by, "kind", "seq", "label", "evidence", component.alias("component"), resources.alias("resources"), style.alias("integration"), coexist.alias("coexistence"),
        F.array_distinct(F.concat("processing", "inputs", "persistence", "outputs")).alias("legacy"), "inputs", "persistence", "outputs",
        F.filter(F.array(F.when((kind == "persistence") & (F.size("persistence") == 0), "no persistent object"), F.when(~F.exists("evidence", lambda e: e.rlike(":[0-9]+$")), "no navigable citation")), lambda b: b.isNotNull()).alias("blockers"),
    )


def risk(m: DataFrame, external: Column | None = None, procedures: Column | None = None) -> DataFrame:
    """m with risk and level: sources and resources, kind, desktop parts, outside systems, procedures, missing citations."""
    kind = F.col("kind")
    points = (
        F.least(F.lit(20), F.size("legacy") * 2) + F.least(F.lit(15), F.size("resources") * 2) + F.when(kind == "handoff", 15).when(kind == "persistence", 18).otherwise(0) + F.when(some("legacy", DESKTOP), 10).otherwise(0)
        + F.when(external if external is not None else F.lit(False), 8).otherwise(0) + F.when((procedures if procedures is not None else F.lit(False)) & (kind == "persistence"), 10).otherwise(0) + F.when(F.size("evidence") == 0, 10).otherwise(0)
    )
    m = m.withColumn("risk", points)
    return m.withColumn("level", F.when(F.col("risk") >= 55, "high").when(F.col("risk") >= 32, "medium").otherwise("low"))


def wave(kind: Column, level: Column) -> Column:
    return F.when(kind == "handoff", "wave-1").when((level == "low") & kind.isin("validation", "processing"), "wave-2").when((kind == "persistence") | (level == "high") | (kind == "output"), "wave-3").otherwise("wave-2")


def services(m: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, id, name, ...): one candidate service for each phase, with its wave."""
    suffix = mapped(F.col("kind"), SUFFIX, "service")
    return m.withColumn("wave", wave(F.col("kind"), F.col("level"))).withColumn("id", F.concat_ws(":", F.lit("service_candidate"), slugify(F.col(by)), "kind", F.col("seq").cast("string"))).withColumn("name", F.concat_ws("-", slugify(F.col(by)), suffix))


def contracts(s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, provider, consumer, style): each service with the next one."""
    w = Window.partitionBy(by).orderBy("seq")
    return s.select(by, F.col("name").alias("provider"), F.coalesce(F.lead("name").over(w), F.lit("legacy")).alias("consumer"), F.col("integration").alias("style"))


def owner(items: DataFrame, s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, label, name): the first service with a legacy source that holds the label (upper case, without blanks around). The sources of a seed are what its items meet."""
    exact = s.select(by, "seq", "name", F.explode("legacy").alias("source")).distinct()
    met = items.select(by, "label").distinct().join(exact, by).filter(F.contains(normalize_name(F.col("source")), normalize_name(F.col("label"))))
    return met.groupBy(by, "label").agg(F.min_by("name", "seq").alias("name"))


def data_migration(s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, label, name, approach) of every persistent object, under its first service."""
    items = s.select(by, F.explode("persistence").alias("label")).distinct()
    return owner(items, s, by).withColumn("approach", F.lit("bulk load, then change data capture until cutover"))


def portfolio(s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, n_services, n_high, score, priority)."""
    p = s.groupBy(by).agg(F.count("*").alias("n_services"), F.count_if(F.col("level") == "high").alias("n_high"), F.floor(F.avg("risk") + 0.5).alias("score"))
    return p.withColumn("priority", F.when(F.col("score") >= 55, "late").when(F.col("score") >= 32, "middle").otherwise("early"))


def waves(s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, wave, goal, services): four waves for each seed; the first is the foundation."""
    fixed = s.sparkSession.createDataFrame(list(WAVES), "wave string, goal string")  # four rows
    named = s.groupBy(by, "wave").agg(F.array_sort(F.collect_set("name")).alias("services"))
    grid = s.select(by).distinct().withColumn("wave", F.explode(F.array(*[F.lit(w) for w, _ in WAVES])))
    return grid.join(F.broadcast(fixed), "wave").join(named, [by, "wave"], "left").select(by, "wave", "goal", F.coalesce("services", F.array().cast("array<string>")).alias("services"))


def cutover(s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, step, action) for each service in order of its wave."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("wave", "seq"))
    return s.select(by, n.alias("step"), F.concat_ws(" ", F.lit("switch"), "name", F.lit("after"), "coexistence").alias("action"))


def backlog(s: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, id, title, wave): BL-001, BL-002, ... one to build, one to provision for each service."""
    rows = s.select(by, "wave", "seq", F.posexplode(F.array(F.concat_ws(" ", F.lit("Build"), "name"), F.concat_ws(" ", F.lit("Provision"), F.array_join("resources", ", ")))).alias("k", "title"))
    n = F.row_number().over(Window.partitionBy(by).orderBy("wave", "seq", "k"))
    return rows.select(by, F.concat(F.lit("BL-"), F.lpad(n.cast("string"), 3, "0")).alias("id"), "title", "wave")


def target_plane(s: DataFrame, by: str = "seed") -> tuple[DataFrame, DataFrame]:
    """Entities (seed, id, type, name) and relations (seed, rel, from_id, to_id) of the target."""
    res = s.select(by, F.col("id").alias("from_id"), F.explode("resources").alias("r"))
    entities = s.select(by, "id", F.lit("service").alias("type"), "name").union(res.select(by, F.concat(F.lit("resource:"), "r"), F.lit("resource"), "r")).union(s.select(by, F.concat(F.lit("wave:"), "wave"), F.lit("wave"), "wave")).distinct()
    old = s.select(by, "id", F.explode("legacy").alias("l"))
    relations = (
        res.select(by, F.lit("DEPLOYS_ON").alias("rel"), "from_id", F.concat(F.lit("resource:"), "r").alias("to_id")).filter("to_id = 'resource:aks'")
        .union(res.filter("r = 'key_vault'").select(by, F.lit("PROTECTS_WITH"), "from_id", F.lit("resource:key_vault")))
        .union(res.filter("r = 'azure_sql'").select(by, F.lit("MIGRATES_TO"), "from_id", F.lit("resource:azure_sql")))
        .union(res.filter("r = 'service_bus'").select(by, F.lit("PUBLISHES_EVENT"), "from_id", F.lit("resource:service_bus")))
        .union(res.filter("r = 'api_management'").select(by, F.lit("EXPOSES_API"), "from_id", F.lit("resource:api_management")))
        .union(old.select(by, F.lit("EXTRACTS_TO"), F.concat(F.lit("legacy:"), "l"), "id"))
        .union(s.select(by, F.lit("CUTS_OVER_AT"), "id", F.concat(F.lit("wave:"), "wave")))
    )
    return entities, relations.distinct()


def gate(s: DataFrame, analysis_gate: DataFrame, by: str = "seed") -> DataFrame:
    """(seed, status, n_blockers): complete only if the analysis is and no service has a blocker."""
    n = s.groupBy(by).agg(F.sum(F.size("blockers")).alias("n_blockers"))
    return n.join(analysis_gate.select(by, "complete"), by, "left").select(by, F.when(F.coalesce("complete", F.lit(False)) & (F.col("n_blockers") == 0), "complete").when(F.coalesce("complete", F.lit(False)), "partial").otherwise("draft").alias("status"), "n_blockers")


def package(analysis: dict[str, DataFrame], by: str = "seed") -> dict[str, DataFrame]:
    """The whole target package of a dossier (see dossier.analyze)."""
    s = services(risk(mappings(analysis["phases"], by)), by)
    entities, relations = target_plane(s, by)
    return {"services": s, "contracts": contracts(s, by), "data_migration": data_migration(s, by), "portfolio": portfolio(s, by), "waves": waves(s, by), "cutover": cutover(s, by), "backlog": backlog(s, by), "target_entities": entities, "target_relations": relations, "gate": gate(s, analysis["gate"], by)}


def token_match(left: DataFrame, right: DataFrame, a: str, b: str, stop: tuple[str, ...] = STOP_TOKENS) -> DataFrame:
    """Pairs of rows whose names share a word of three characters or more that is no stop token: an equi-join on words."""
    words = lambda d, c: d.withColumn("__w", F.explode(F.filter(camel_tokens(F.col(c)), lambda t: ~t.isin(*stop))))
    return words(left, a).join(words(right, b), "__w").drop("__w").distinct()


def adherence(plan: dict[str, DataFrame], inventory: dict[str, DataFrame], by: str = "seed") -> DataFrame:
    """(seed, kind, item, state) of services, resources and contracts, planned against found; inventory: components (name), resources (type), apis (path)."""
    s = plan["services"].select(by, "name").distinct()
    found = token_match(s, inventory["components"].select(F.col("name").alias("component")), "name", "component").select(by, "name").distinct()
    state = lambda d, hit, keys: d.join(hit.withColumn("__h", F.lit(True)), keys, "left").withColumn("state", F.when(F.col("__h"), "implemented").otherwise("missing"))
    a = state(s, found, [by, "name"]).select(by, F.lit("service").alias("kind"), F.col("name").alias("item"), "state")
    r = plan["services"].select(by, F.explode("resources").alias("r")).distinct()
    b = state(r, inventory["resources"].select(F.col("type").alias("r")).distinct(), ["r"]).select(by, F.lit("resource"), "r", "state")
    k = plan["contracts"].select(by, "provider").distinct()
    apis = token_match(k, inventory["apis"].select("path"), "provider", "path").select(by, "provider").distinct()
    c = state(k, apis, [by, "provider"]).select(by, F.lit("contract"), "provider", "state")
    return a.union(b).union(c)
