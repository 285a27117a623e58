"""Views for readers of reports: lineage summaries, graph budgets, a system view and a view around a question."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import cut, settled
from . import graph

# What relations a summary reads, and how many names of each list it shows.
TAKES, TAKEN = ("READS", "RECEIVES"), ("dataset", "table", "procedure", "component")
LINKS = ("CALLS", "CALLS_PROC", "CALLS_SP", "EXECUTES", "TRIGGERS", "USES_DLL")
KEEPS, KEPT = ("WRITES", "UPDATES", "CALLS_SP"), ("table", "procedure")
SENDS, SENT = ("WRITES", "EMITS", "GENERATES_REPORT", "TRANSFERS_TO"), ("dataset", "component", "procedure", "table")
SHOWN = {"inputs": 12, "chain": 18, "persistence": 12, "outputs": 12, "contracts": 12, "terminals": 8}


@dataclass(frozen=True)
class Profile:
    """Limits of a view: flows, subjects, nodes and edges before they are reduced."""

    flows: int
    nodes: int
    edges: int
    subjects: int = 0


# The limits of each view; a partial view is what is left when time runs out.
PROFILES = {"system": Profile(10, 320, 960), "focused": Profile(6, 220, 720, 36), "system_partial": Profile(6, 180, 540), "focused_partial": Profile(4, 120, 360, 18)}


def lineage_summary(relations: DataFrame, entities: DataFrame, by: str = "seed", shown: dict[str, int] | None = None) -> DataFrame:
    """(seed, kind, label, n_relations): what goes in, the chain of work, what is kept, what goes out, contracts and terminals of relations (seed, ...).

    Labels come by the number of their relations, then by name, up to the number of each kind that is shown.
    """
    about = entities.select("id", "type", "label")
    r = relations.join(about.select(F.col("id").alias("from_id"), F.col("label").alias("fl")), "from_id", "left").join(about.select(F.col("id").alias("to_id"), F.col("type").alias("tt"), F.col("label").alias("tl")), "to_id", "left")
    fl, tl, rel = F.coalesce("fl", "from_id"), F.coalesce("tl", "to_id"), F.col("rel")
    takes, keeps, sends = rel.isin(*TAKES) & F.col("tt").isin(*TAKEN), rel.isin(*KEEPS) & F.col("tt").isin(*KEPT), rel.isin(*SENDS) & F.col("tt").isin(*SENT)
    links = rel.isin(*LINKS)
    say = lambda test, kind, label: F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(kind).alias("kind"), label.alias("label")))
    found = F.array(say(takes, "inputs", tl), say(takes | links, "chain", fl), say(links, "chain", tl), say(keeps, "persistence", tl), say(sends, "outputs", tl), say(rel == "DATA_CONTRACT", "contracts", F.concat_ws(" -> ", fl, tl)), say(keeps | sends, "terminals", tl))
    rows = r.select(by, F.explode(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).alias("x")).groupBy(by, "x.kind", "x.label").agg(F.count("*").alias("n_relations"))
    most = F.create_map(*[F.lit(v) for kv in (shown or SHOWN).items() for v in kv])
    rank = F.row_number().over(Window.partitionBy(by, "kind").orderBy(F.desc("n_relations"), "label"))
    return rows.withColumn("__k", rank).filter(F.col("__k") <= most[F.col("kind")]).drop("__k")


def richness(flow_columns: tuple[str, ...] = ("programs", "procedures", "data_objects")) -> Column:
    """What a flow holds: its programs count three times, procedures and data twice."""
    weights = {"programs": 3, "procedures": 2, "data_objects": 2}
    out = F.lit(0)
    for c in flow_columns:
        out = out + F.coalesce(F.size(c), F.lit(0)) * weights[c]
    return out


def richest(flows: DataFrame, most: int) -> DataFrame:
    """The flows that hold most, ties by id; the limit is the view's."""
    return flows.withColumn("richness", richness()).orderBy(F.desc("richness"), "entry_id").limit(most)


def within_budget(nodes: DataFrame, edges: DataFrame, profile: Profile, focus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, ...) and edges (rel, from_id, to_id) cut to the profile: nodes of the focus (id) first and always, then those of highest degree; edges by ends in the focus, then by ids."""
    edges = settled(edges)
    ranked = nodes.join(graph.degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    mark = focus.select("id", F.lit(True).alias("__focus")).distinct() if focus is not None else None
    ranked = ranked.join(mark, "id", "left") if mark is not None else ranked.withColumn("__focus", F.lit(None).cast("boolean"))
    ranked = ranked.withColumn("__focus", F.coalesce("__focus", F.lit(False)))
    others = ranked.filter(~F.col("__focus")).orderBy(F.desc("degree"), "id").limit(profile.nodes)  # the limit is the view's
    focused = cut(ranked.filter("__focus"))
    room = max(0, profile.nodes - focused.count())
    kept = cut(focused.unionByName(others.orderBy(F.desc("degree"), "id").limit(room)))  # the focus, and a budget of rows
    inside = graph.induced(edges.select("rel", "from_id", "to_id").distinct(), kept)
    ends = kept.select("id", F.col("__focus").cast("int").alias("f"))
    inside = inside.join(F.broadcast(ends.select(F.col("id").alias("from_id"), F.col("f").alias("a"))), "from_id").join(F.broadcast(ends.select(F.col("id").alias("to_id"), F.col("f").alias("b"))), "to_id")  # a budget of rows
    shown = inside.orderBy((F.col("a") + F.col("b")).desc(), "from_id", "to_id", "rel").limit(profile.edges).select("rel", "from_id", "to_id")
    return kept.drop("__focus"), shown


def focused_view(seeds: DataFrame, entities: DataFrame, relations: DataFrame, flows: DataFrame, profile: Profile = PROFILES["focused"], depth: int = 2) -> dict[str, DataFrame]:
    """A view around seeds (id): subjects by hops up to the profile's number, the flows that hold most of them, and the graph among what is near, within its budget."""
    relations = settled(relations.select("rel", "from_id", "to_id"))
    near = cut(graph.reach(seeds, relations, "both", depth))
    subjects = near.orderBy("depth", "id").limit(profile.subjects)
    met = flows.select("entry_id", F.explode("subject_ids").alias("id")).join(near.select("id"), "id", "left_semi").groupBy("entry_id").agg(F.count("*").alias("n_subjects"))
    chosen = richest(flows.join(met, "entry_id"), profile.flows).orderBy(F.desc("n_subjects"), F.desc("richness"), "entry_id")
    nodes, edges = within_budget(entities.join(near.select("id"), "id", "left_semi"), relations, profile, seeds)
    return {"subjects": subjects, "flows": chosen, "nodes": nodes, "edges": edges}


def field_search(entities: DataFrame, relations: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Fields whose name holds the term, and what programs (id) refer to an end that holds it."""
    t = name.strip().upper()
    fields = entities.filter((F.col("type") == "field") & F.contains(F.upper("name"), F.lit(t)))
    users = relations.filter(F.contains(F.upper("to_id"), F.lit(t))).select(F.col("from_id").alias("id")).distinct()
    return fields, users if not fields.isEmpty() else users.limit(0)


def table_search(entities: DataFrame, relations: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The table of this name, and what accesses it (id, rel), also under a schema."""
    t = name.strip().upper()
    table = entities.filter((F.col("type") == "table") & (F.upper("name") == t))
    used = relations.filter(F.col("rel").isin("READS", "WRITES", "UPDATES", "USES") & F.upper("to_id").rlike(r"(^|[:.])\Q" + t + r"\E$"))
    return table, used.select(F.col("from_id").alias("id"), "rel").distinct()


def in_time(spark: SparkSession, seconds: float, full: Callable[[], dict[str, DataFrame]], partial: Callable[[], dict[str, DataFrame]]) -> tuple[str, dict[str, DataFrame]]:
    """("complete", full()) if it ends within so many seconds, else its jobs are cancelled and the result is ("partial", partial()).

    The tables of full are written before it counts as ended, so what comes back is there and not only planned. Jobs are found by a tag of their own: no others are cancelled.
    """
    tag, late = f"view-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        while not done.wait(0.05):  # jobs that begin after the first call are met too
            spark.interruptTag(tag)

    done = threading.Event()
    timer = threading.Timer(seconds, stop)
    spark.addTag(tag)
    timer.start()
    try:
        out = {k: cut(v) for k, v in full().items()}
        if not late.is_set():
            return "complete", out
    except Exception:  # noqa: BLE001
        if not late.is_set():  # a failure of its own
            raise
    finally:
        done.set()
        timer.cancel()
        spark.removeTag(tag)
    return "partial", partial()
