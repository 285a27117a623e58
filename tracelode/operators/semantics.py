"""What phases, relations and entities of a question mean: decisions, rules, contingencies, handoffs, transfers, messages, states and a glossary.

Inputs are the tables of phases.assembled (phases, items) and, by seed, the relations and entities
around it. Everything stays rows; ids tell the same thing once. Null labels give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..functions.text import half_up, slugify
from . import graph, phases
from .packs import GENERIC, Pack

# Words of states, kinds of terms and what is noted of them, channels by pattern, default confidences.
STATE_NAMES = r"(?i)\b(STATUS|SITUAC|SITUATION|STATE|ESTADO|FASE|ETAPA)\b"
MESSAGES = "(?i)" + phases.MESSAGE_WORDS
CHANNELS = (("(?i)ISD", "ISD"), ("(?i)CIP|C3", "CIP/C3"), ("(?i)CNAB600", "CNAB600"), ("(?i)CNAB400", "CNAB400"))
OTHER_CHANNEL, OTHER_ARTIFACT = "ARQUIVO", "artefato intermediario"
NOTES = {"sistema-externo": "componente ou integracao externa observada", "stored-procedure": "procedimento persistente ou integracao de banco", "layout": "copybook ou layout de arquivo identificado"}
ACTOR_TYPES = ("screen", "job", "program", "project", "component")
MOST_TERMS = 80


def phrase(relations: DataFrame, link: str) -> Column:
    return F.concat(F.col("fl"), F.lit(link[0]), F.col("rel"), F.lit(link[1]), F.col("tl"))


def once(df: DataFrame, *order: Column) -> DataFrame:
    """The first row of each id of a seed."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy("seed", "id").orderBy(*order))).filter("__k = 1").drop("__k")


def decisions(phases_: DataFrame, items: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(seed, id, label, rule, confidence): gates of phases, and relations that validate or route."""
    gates = items.filter("field = 'gates'").join(phases_.select("seed", "seq", F.col("label").alias("phase"), "confidence"), ["seed", "seq"])
    a = gates.select("seed", F.concat_ws(":", F.lit("decision"), "seq", "value").alias("id"), F.concat(F.lit("Decisao em "), "phase").alias("label"), F.col("value").alias("rule"), "confidence")
    r = phases.labelled(relations.filter(F.col("rel").isin(*phases.GATES)), entities)
    b = r.select("seed", F.concat_ws(":", F.lit("decision:rel"), "from_id", "rel", "to_id").alias("id"), F.concat_ws(" ", "rel", "fl").alias("label"), phrase(r, (" --", "--> ")).alias("rule"), F.coalesce("confidence", F.lit(0.75)).alias("confidence"))
    return a.union(b.dropDuplicates(["seed", "id"]))


def business_rules(decisions_: DataFrame, relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(seed, id, label, rule, confidence): each decision, and relations that validate or bind by contract."""
    a = decisions_.select("seed", F.concat(F.lit("business-rule:"), "id").alias("id"), F.concat(F.lit("Regra associada a "), "label").alias("label"), "rule", "confidence")
    r = phases.labelled(relations.filter(F.col("rel").isin("DATA_CONTRACT", "VALIDATES")), entities)
    b = r.select("seed", F.concat_ws(":", F.lit("business-rule:rel"), "from_id", "rel", "to_id").alias("id"), F.concat_ws(" ", "rel", "fl").alias("label"), F.concat_ws(" ", "fl", "rel", "tl").alias("rule"), F.coalesce("confidence", F.lit(0.72)).alias("confidence"))
    return a.union(b.dropDuplicates(["seed", "id"]))


def contingencies(phases_: DataFrame, items: DataFrame, decisions_: DataFrame, relations: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, id, label, rule, confidence): gates, decisions, entities and relations that speak of errors. members: (seed, id) of the entities around a seed."""
    wrong = lambda c: F.coalesce(c.rlike(phases.ERROR_WORDS), F.lit(False))
    gates = items.filter((F.col("field") == "gates") & wrong(F.col("value"))).join(phases_.select("seed", "seq", F.col("label").alias("phase"), "confidence"), ["seed", "seq"])
    a = gates.select("seed", F.concat_ws(":", F.lit("error"), "seq", "value").alias("id"), F.concat(F.lit("Contingencia em "), "phase").alias("label"), F.col("value").alias("rule"), "confidence")
    b = decisions_.filter(wrong(F.col("rule"))).select("seed", F.concat(F.lit("error:"), "id"), F.concat(F.lit("Decisao sensivel: "), "label"), "rule", "confidence")
    about = F.col("description") if "description" in entities.columns else F.lit(None).cast("string")
    e = members.join(entities.select("id", "label", about.alias("about"), "confidence").filter(wrong(F.col("label")) | wrong(F.col("about"))), "id")
    c = e.select("seed", F.concat(F.lit("error:entity:"), "id"), "label", F.coalesce("about", "label"), F.coalesce("confidence", F.lit(0.7)))
    r = phases.labelled(relations, entities).withColumn("said", F.concat_ws(" ", "fl", "rel", "tl")).filter(wrong(F.col("said")))
    d = r.select("seed", F.concat_ws(":", F.lit("error:rel"), "from_id", "rel", "to_id").alias("id"), "said", F.col("said").alias("rule"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))
    return a.union(b).union(c.distinct()).union(d.dropDuplicates(["seed", "id"]))


def channel(text: Column, pack: Pack = GENERIC) -> Column:
    """The first channel of the pack that a text names, else of those that are known everywhere."""
    out = F.lit(OTHER_CHANNEL)
    for pattern, name in reversed([*[(f"(?i){c}", c) for c in pack.channels], *CHANNELS]):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def handoffs(phases_: DataFrame, pack: Pack = GENERIC) -> DataFrame:
    """(seed, id, label, from_seq, to_seq, from_platform, to_platform, artifact, channel, confidence): neighbouring phases on other platforms, with what passes between them."""
    w = Window.partitionBy("seed").orderBy("seq")
    keep = ("seq", "label", "platforms", "inputs", "processing", "confidence")
    p = phases_.select("seed", *keep, "outputs", *[F.lead(c).over(w).alias(f"next_{c}") for c in keep])
    p = p.filter((F.size("platforms") > 0) & (F.size("next_platforms") > 0) & (F.col("platforms") != F.col("next_platforms")))
    said = F.concat_ws(" ", "outputs", "next_inputs", "processing", "next_processing")
    return p.select(
        "seed", F.concat_ws(":", F.lit("handoff"), "seq", "next_seq").alias("id"), F.concat_ws(" -> ", "label", "next_label").alias("label"), F.col("seq").alias("from_seq"), F.col("next_seq").alias("to_seq"), F.col("platforms")[0].alias("from_platform"), F.col("next_platforms")[0].alias("to_platform"),
        F.coalesce(F.get("outputs", F.lit(0)), F.get("next_inputs", F.lit(0)), F.lit(OTHER_ARTIFACT)).alias("artifact"), channel(said, pack).alias("channel"), half_up((F.col("confidence") + F.col("next_confidence")) / 2, 2).alias("confidence"),
    )


def transfers(phases_: DataFrame, items: DataFrame, handoffs_: DataFrame) -> DataFrame:
    """(seed, id, label, phase, direction, confidence): what goes into and out of phases, and what is handed over."""
    i = items.filter("field in ('inputs', 'outputs')").join(phases_.select("seed", "seq", "confidence"), ["seed", "seq"])
    inward = F.max(F.col("field") == "inputs").over(Window.partitionBy("seed", "seq", "value"))
    i = i.select("seed", F.concat_ws(":", F.lit("transfer"), "seq", slugify(F.col("value"), "item")).alias("id"), F.col("value").alias("label"), F.col("seq").cast("string").alias("phase"), F.when(inward, "inbound").otherwise("outbound").alias("direction"), "confidence")
    first = once(i, F.col("direction"), F.col("label"))
    return first.union(handoffs_.select("seed", F.concat(F.lit("transfer:"), "id"), F.col("artifact"), "id", F.lit("handoff"), "confidence"))


def messages(transfers_: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, id, label, confidence, inferred): transfers and data that are named like messages."""
    a = transfers_.filter(F.col("label").rlike(MESSAGES)).select("seed", F.concat(F.lit("message:"), "id").alias("id"), "label", "confidence", (F.col("direction") == "handoff").alias("inferred"))
    named = entities.filter(F.col("type").isin("dataset", "component", "procedure") & F.col("label").rlike(MESSAGES))
    unsure = F.coalesce("inferred", F.lit(False)) if "inferred" in entities.columns else F.lit(False)
    e = members.join(named.select("id", "label", F.coalesce("confidence", F.lit(0.72)).alias("confidence"), unsure.alias("inferred")), "id")
    return a.union(e.select("seed", F.concat(F.lit("message:entity:"), "id"), "label", "confidence", "inferred").distinct())


def states(phases_: DataFrame, entities: DataFrame, members: DataFrame) -> DataFrame:
    """(seed, id, place, label, next, inferred): fields and columns that are named like states, in the order of their ids, else the phases; each with the one that follows."""
    e = members.distinct().join(entities.filter(F.col("type").isin("field", "column") & F.col("label").rlike(STATE_NAMES)).select("id", "label"), "id")
    explicit = e.select("seed", F.concat(F.lit("state:"), "id").alias("id"), F.row_number().over(Window.partitionBy("seed").orderBy("id")).alias("place"), "label", F.lit(False).alias("inferred"))
    other = phases_.join(explicit.select("seed").distinct(), "seed", "left_anti").select("seed", F.concat(F.lit("state:"), F.col("seq").cast("string")).alias("id"), F.col("seq").cast("int").alias("place"), "label", F.lit(True).alias("inferred"))
    return explicit.union(other).withColumn("next", F.lead("label").over(Window.partitionBy("seed").orderBy("place"))).select("seed", "id", "place", "label", "next", "inferred")


def transitions(events: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """(state, next, n, subjects): changes of state that subjects go through, as events (by, order, state) tell; events that repeat the state are one stay.

    A subject's events meet in one window, which Spark reads in order and spills; what comes out is a row for each pair of states. next is null where a subject ends.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    stays = events.withColumn("__was", F.lag(state).over(w)).withColumn("__first", F.row_number().over(w) == 1).filter(F.col("__first") | ~F.col("__was").eqNullSafe(F.col(state)))
    moves = stays.withColumn("next", F.lead(state).over(w))
    per = moves.groupBy(*by, F.col(state).alias("state"), "next").agg(F.count("*").alias("n"))
    return per.groupBy("state", "next").agg(F.sum("n").alias("n"), F.count("*").alias("subjects"))


def machine(transitions_: DataFrame) -> DataFrame:
    """(state, n_out, n_ends, closed, depth): of each state how often it is left and ends a subject, whether some end can be reached from it, and from how many steps."""
    t = cut(transitions_)
    edges = t.filter("next is not null and state is not null").select(F.col("state").alias("from_id"), F.col("next").alias("to_id"))
    ends = t.filter("next is null and state is not null").select(F.col("state").alias("id")).distinct()
    back = graph.reach(ends, edges, "upstream", 999)
    n = t.groupBy("state").agg(F.sum(F.when(F.col("next").isNotNull(), F.col("n")).otherwise(0)).alias("n_out"), F.sum(F.when(F.col("next").isNull(), F.col("n")).otherwise(0)).alias("n_ends"))
    return n.join(back.select(F.col("id").alias("state"), "depth"), "state", "left").select("state", "n_out", "n_ends", F.col("depth").isNotNull().alias("closed"), "depth")


def glossary(phases_: DataFrame, entities: DataFrame, members: DataFrame, roles: DataFrame) -> DataFrame:
    """(seed, term, type, note): the first MOST_TERMS terms of a seed by type and term: actors, external systems, procedures, layouts and tables. roles: (id, role) of tables."""
    e = members.distinct().join(entities.select("id", "type", "label").filter("label is not null"), "id").join(roles.select("id", "role"), "id", "left")
    is_ = lambda *kinds: F.col("type").isin(*kinds)
    entry = lambda kind, note: F.struct(F.lit(kind).alias("type"), note.alias("note"))
    rows = F.array_compact(F.array(
        F.when(is_(*ACTOR_TYPES), entry("ator", F.col("type"))), F.when(is_("component", "project") | F.col("label").rlike(r"(?i)\.(DLL|OCX)$"), entry("sistema-externo", F.lit(NOTES["sistema-externo"]))),
        F.when(is_("procedure"), entry("stored-procedure", F.lit(NOTES["stored-procedure"]))), F.when(is_("copybook"), entry("layout", F.lit(NOTES["layout"]))),
        F.when(is_("table") & F.col("role").isNotNull(), entry("tabela", F.concat(F.lit("papel: "), F.col("role")))),
    ))
    a = e.select("seed", F.col("label").alias("term"), F.explode(rows).alias("x")).select("seed", "term", "x.type", "x.note", F.lit(0).alias("rank"))
    b = phases_.select("seed", F.explode("actors").alias("term"), F.lit("ator").alias("type"), F.lit("phase-actor").alias("note"), F.lit(1).alias("rank"))
    one = a.union(b).groupBy("seed", "term", "type").agg(F.min_by("note", F.struct("rank", "note")).alias("note"))
    return one.withColumn("k", F.row_number().over(Window.partitionBy("seed").orderBy("type", "term"))).filter(F.col("k") <= MOST_TERMS).drop("k")


def objects(phases_: DataFrame, items: DataFrame, relations: DataFrame, entities: DataFrame, members: DataFrame, roles: DataFrame, pack: Pack = GENERIC) -> dict[str, DataFrame]:
    """All semantic objects of all seeds."""
    d = cut(decisions(phases_, items, relations, entities))
    h = cut(handoffs(phases_, pack))
    t = cut(transfers(phases_, items, h))
    return {"decisions": d, "business_rules": business_rules(d, relations, entities), "contingencies": contingencies(phases_, items, d, relations, entities, members), "handoff_details": h, "transfers": t, "messages": messages(t, entities, members), "state_items": states(phases_, entities, members), "glossary": glossary(phases_, entities, members, roles)}
