"""The public commands: each takes and returns DataFrames; a workspace is a folder of Parquet tables."""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schema
from ..functions.storage import cut
from ..operators import changes, coverage, dossier, executive as views, export, filters, flows, graph, model, modernize, packs, resolution, search, semantics
from ..operators.extract import cobol, extract, jcl, using
from ..operators.extract import target as target_repo
from ..sources import files as sources

MANIFEST = "version int, stamp string, name string, path string"
PHASES = ("init", "ingest", "model", "map", "verify", "analyze", "modernize")


@dataclass
class Workspace:
    """A project's tables, in versions that are never changed.

    A table is written to a folder of its own. What belongs together becomes visible at once, by a manifest that is written last and says
    which folder each table has in a version; a run that fails before leaves the version before readable. One writer at a time is assumed;
    if two finish at once, the later name of the two manifests counts. Ledgers (append) are not versioned.
    """

    spark: SparkSession
    folder: str
    roots: tuple[str, ...]
    version: int | None = None  # a fixed version to read; the newest if None
    known: dict[int, dict[str, str]] | None = field(default=None, repr=False, compare=False)
    pending: dict[str, str] | None = field(default=None, repr=False, compare=False)

    def versions(self) -> dict[int, dict[str, str]]:
        """Of each version the folder of each table: a few rows a version."""
        if self.known is None:
            try:
                rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifests/*").select("version", "stamp", "name", "path").collect()
            except AnalysisException as e:
                if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                    raise
                rows = []
            last = {}
            for r in rows:
                last[r["version"]] = max(last.get(r["version"], ""), r["stamp"])
            self.known = {}
            for r in rows:
                if r["stamp"] == last[r["version"]]:
                    self.known.setdefault(r["version"], {})[r["name"]] = r["path"]
        return self.known

    def refresh(self) -> None:
        """Looks again for versions that others have written."""
        self.known = None

    def tables(self) -> dict[str, str]:
        found = [v for v in self.versions() if self.version is None or v <= self.version]
        return (self.versions()[max(found)] if found else {}) | (self.pending or {})

    def at(self, version: int) -> Workspace:
        """The workspace as it was in a version; it can't be written."""
        return replace(self, version=version, known=self.known, pending=None)

    @contextmanager
    def change(self):
        """What is written inside becomes one version, or none if something fails."""
        if self.version is not None:
            raise ValueError(f"version {self.version} is fixed: a past version is not written again")
        if self.pending is not None:  # inside another change
            yield self
            return
        self.pending = {}
        try:
            yield self
            if self.pending:
                self.publish(self.tables())
        finally:
            self.pending = None

    def publish(self, tables: dict[str, str]) -> None:
        number, stamp = max(self.versions(), default=0) + 1, uuid.uuid4().hex
        rows = [(number, stamp, name, path) for name, path in sorted(tables.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.folder}/manifests/{number:08d}-{stamp}")
        self.known = self.versions() | {number: dict(tables)}

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.tables().get(name) or f"{self.folder}/{name}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        with self.change():
            path = f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            self.pending[name] = path
        return self.read(name)

    def exists(self, name: str) -> bool:
        if name in self.tables():
            return True
        try:
            return bool(self.spark.read.parquet(f"{self.folder}/{name}").columns)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise

    def append(self, name: str, df: DataFrame) -> None:
        df.write.mode("append").parquet(f"{self.folder}/{name}")


def init(spark: SparkSession, folder: str, roots: list[str]) -> Workspace:
    return Workspace(spark, folder.rstrip("/"), tuple(roots))


def ingest(ws: Workspace, with_records: bool = True) -> DataFrame:
    """Scans and classifies the roots; extracts what is new or changed, and keeps the records of unchanged files."""
    with ws.change():
        return ingested(ws, with_records)


def ingested(ws: Workspace, with_records: bool) -> DataFrame:
    old = ws.read("files") if ws.exists("files") else ws.spark.createDataFrame([], schema.FILES)
    read, same = sources.scan_changed(ws.spark, list(ws.roots), old)
    found = cut(sources.classify(read).unionByName(same, allowMissingColumns=True))
    todo = changes.to_process(found, old)
    if with_records:
        lines = cut(sources.lines(todo.filter("dialect is not null").select("path", "hash", "name", "dialect", sources.decoded(F.col("content")).alias("text"))))
        e, r = extract(lines)
        cob, job = lines.filter("dialect = 'cobol'"), lines.filter("dialect = 'jcl'")
        f = cobol.flow(cob)
        fe, fr = cobol.flow_records(f)
        new = {"raw_entities": e.unionByName(fe), "raw_relations": r.unionByName(fr), "var_values": f["var_values"], "flow_edges": f["edges"], "uses": using.uses(cob), "conditions": jcl.conditions(job)}
        for name, df in new.items():
            df = cut(df)
            if ws.exists(name):
                before = ws.read(name)
                if "fileHash" in before.columns:
                    df = df.unionByName(changes.preserved(before, found.select("path", "hash"), old).select(df.columns))
                elif "path" in before.columns:
                    df = df.unionByName(before.join(found.select("path").distinct(), "path", "left_semi").join(todo.select("path"), "path", "left_anti").select(df.columns))
                else:
                    df = df.unionByName(before).distinct()
            ws.write(name, df)
    return ws.write("files", schema.shaped(found, schema.FILES))


def build_model(ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Canonical entities and relations: merged, resolved, dynamic calls replaced, contracts added, unused inferred entities dropped."""
    entities, relations = model.normalize(ws.read("raw_entities"), ws.read("raw_relations"))
    relations = cut(model.resolve_dynamic_calls(relations, ws.read("var_values")))
    relations = cut(model.merge_relations_again(relations))
    calls = relations.filter("from_type = 'program'")
    made = model.build_contracts(calls, ws.read("uses"), relations.filter("rel = 'INCLUDES'"))
    relations = cut(relations.unionByName(made))
    with ws.change():
        return ws.write("entities", model.prune_inferred(entities, relations)), ws.write("relations", relations)


def build_map(ws: Workspace) -> DataFrame:
    """Batch steps and functional flows."""
    e, r = ws.read("entities"), ws.read("relations")
    with ws.change():
        steps = ws.write("steps", flows.batch(e, r, ws.read("conditions")))
        return ws.write("flows", flows.functional(e, r, steps))


def find(ws: Workspace, term: str, kind: str | None = None, with_relations: bool = False) -> dict[str, DataFrame]:
    entities = search.entities(ws.read("entities"), term, kind)
    out = {"entities": entities, "flows": search.flows(ws.read("flows"), term)}
    if with_relations or entities.isEmpty():
        out["relations"] = search.relations(ws.read("relations"), term)
    return out


def seeds(ws: Workspace, name: str) -> DataFrame:
    """Entities of this name or id."""
    return ws.read("entities").filter((F.upper("name") == name.upper()) | (F.col("id") == name)).select("id")


def impact(ws: Workspace, name: str, depth: int = 4, direction: str = "both", full: bool = False) -> dict[str, DataFrame]:
    s, r = seeds(ws, name), ws.read("relations").select("rel", "from_id", "to_id", "confidence")
    edges = cut(graph.traverse(s, r, direction, 999 if full else depth))
    return {"edges": edges, "affected": graph.ends_of(edges, s), "flows": search.related_flows(ws.read("flows"), s)}


def lineage(ws: Workspace, field: str) -> DataFrame:
    return model.lineage(seeds(ws, field), ws.read("entities"), ws.read("relations"))


def reverse(ws: Workspace, name: str, depth: int = 20) -> tuple[DataFrame, DataFrame]:
    rels = ["CALLS", "CALLS_PROC", "EXECUTES", "CONTAINS", "READS", "WRITES", "UPDATES"]
    return graph.reverse_trace(seeds(ws, name), ws.read("relations"), rels, depth)


def verify(ws: Workspace) -> dict[str, DataFrame]:
    e, r, f = ws.read("entities"), ws.read("relations"), ws.read("files")
    programs = e.filter("type = 'program' and not coalesce(inferred, false)").select("id")
    return {"report": coverage.report(e, r, f), "gaps": coverage.gaps(e, r, f), "entrypoints": coverage.entrypoints(programs, r), "isolated": coverage.isolated(programs, r), "hotspots": coverage.hotspots(r, e), "types": coverage.histogram(e, "type"), "rels": coverage.histogram(r, "rel"), "dialects": coverage.histogram(f, "dialect"), "buckets": coverage.confidence_buckets(r)}


def domain(ws: Workspace, query: str = "", requested: str = "auto") -> packs.Pack:
    """The domain pack that is asked for, or that the names and texts of the model and the question speak for."""
    e, r = ws.read("entities"), ws.read("relations")
    said = e.select(F.explode(F.concat(F.array(*[F.col(c) for c in ("id", "name", "label", "description")]), F.coalesce("semantic_tags", F.array().cast("array<string>")))).alias("value"))
    said = said.unionByName(r.select(F.explode(F.array("from_id", "to_id", "rel")).alias("value"))).unionByName(ws.spark.createDataFrame([(query,)], "value string"))
    return packs.chosen(said.filter("value is not null"), requested)


def resolve(ws: Workspace, query: str, seed_type: str | None = None, depth: int = 4, pack: str = "auto", terminal: str | None = None, autonomous: bool = True) -> dict[str, DataFrame]:
    """What a question is about, its candidates, and the terminals and bridges that may be meant."""
    return resolution.resolve_target(ws.read("entities"), ws.read("relations"), ws.read("flows"), query, seed_type, depth, domain(ws, query, pack), terminal, autonomous)


def analyze(ws: Workspace, seed_names: list[str], depth: int = 2, seed_type: str | None = None, facts_only: bool = False, pack: str = "auto", terminal: str | None = None, autonomous: bool = True, trace: str = "both") -> dict[str, DataFrame]:
    """Dossiers of all seeds at once: each name resolves to one candidate and what was merged into it. facts_only: phases without what is no fact; trace: forward leaves out the reverse traces, reverse the lineage."""
    rows, entities, relations, flows_ = None, ws.read("entities"), ws.read("relations"), ws.read("flows")
    taken = domain(ws, " ".join(seed_names), pack)
    for name in seed_names:  # a handful of questions
        found = resolution.resolve_target(entities, relations, flows_, name, seed_type, depth, taken, terminal, autonomous)
        also = found["candidates"].join(F.broadcast(found["adopted"].select("id")), "id", "left_semi")  # three rows
        anchors = found["selection"].select("anchor_id").union(also.select("anchor_id")).distinct().select(F.lit(name).alias("seed"), F.col("anchor_id").alias("id"))
        picked = found["selection"].select(F.lit(name).alias("seed"), "id", "category", "label", "score", "confidence", "status")
        rows = (anchors, picked) if rows is None else (rows[0].union(anchors), rows[1].union(picked))
    if rows is None:
        raise ValueError("no question is asked")
    out = dossier.analyze(cut(rows[0]), entities, relations, depth, flows_, ws.read("steps"), taken)
    out["resolution"] = rows[1]
    members = out["relations"].select("seed", F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    out |= semantics.objects(out["phases"], out["phase_items"], out["relations"], entities, members, out["data_model"].filter("type = 'table'"), taken)
    out["lineage"] = views.lineage_summary(out["relations"], entities)
    if trace in ("forward", "reverse"):
        out.pop("traces" if trace == "forward" else "lineage")
    if facts_only:
        out["phases"] = dossier.facts_only(out["phases"].drop(*[c for c in out["phases"].columns if c.startswith("n_")]), out["claims"])
    return out


def focused(ws: Workspace, name: str, profile: str = "focused", seconds: float | None = None) -> dict[str, DataFrame]:
    """The executive view around one name, within the profile's limits. With seconds, a view that takes longer gives way to that of the partial profile; its status is a table of one row."""
    view = lambda p: views.focused_view(seeds(ws, name), ws.read("entities"), ws.read("relations"), ws.read("flows"), views.PROFILES[p])
    if seconds is None:
        return view(profile)
    status, out = views.in_time(ws.spark, seconds, lambda: view(profile), lambda: view(f"{profile.removesuffix('_partial')}_partial"))
    return out | {"status": ws.spark.createDataFrame([(status,)], "status string")}


def modernize_plan(ws: Workspace, seed_names: list[str]) -> dict[str, DataFrame]:
    return modernize.package(analyze(ws, seed_names))


def modernize_verify(ws: Workspace, plan: dict[str, DataFrame], target_root: str) -> dict[str, DataFrame]:
    files = sources.scan(ws.spark, [target_root]).select("path", sources.decoded(F.col("content")).alias("text"))
    found = {k: cut(v) for k, v in target_repo.inventory(files).items()}
    states = cut(modernize.adherence(plan, found))
    return found | {"adherence": states, "status": changes.adherence_status(states)}


def diff(ws: Workspace, other: Workspace) -> dict[str, DataFrame]:
    """What other has against ws, two workspaces or two versions of one (ws.at(1)): entities by (name, type), relations by (from, rel, to)."""
    e = changes.snapshot_diff(ws.read("entities"), other.read("entities"), ["name", "type"], "confidence")
    r = changes.snapshot_diff(ws.read("relations"), other.read("relations"), ["from", "rel", "to"], "confidence")
    return {"entities": e, "relations": r.filter("change <> 'changed'")}


def observe(ws: Workspace, text: str, about: str | None = None) -> None:
    ws.append("observations", ws.spark.createDataFrame([(datetime.now(UTC).isoformat(), about, text)], "at string, about string, text string"))


def decide(ws: Workspace, name: str, action: str) -> None:
    ws.append("decisions", ws.spark.createDataFrame([(datetime.now(UTC).isoformat(), name, action)], "at string, name string, action string"))


def review(ws: Workspace) -> dict[str, DataFrame]:
    d = ws.read("decisions") if ws.exists("decisions") else ws.spark.createDataFrame([], "at string, name string, action string")
    return {"pending": coverage.pending(ws.read("entities"), ws.read("relations"), d), "report": coverage.review_report(d)}


def executive(ws: Workspace, limit: int = 28) -> tuple[DataFrame, DataFrame]:
    """The system as a graph of at most limit nodes and summaries."""
    e, r = ws.read("entities"), ws.read("relations")
    nodes = e.join(graph.degree(r), "id", "left")
    return graph.reduce_graph(nodes, r, search.type_weight(F.col("type")) + F.coalesce("degree", F.lit(0)), limit)


def export_model(ws: Workspace, form: str, least: float = 0.0, rels: list[str] | None = None, types: list[str] | None = None, no_inferred: bool = False) -> DataFrame:
    """Rows of an export: csv, csv-expanded, csv-nodes, graphml, dot or jsonl."""
    e, r = filters.of_types(ws.read("entities"), *(types or [])), filters.of_rels(filters.confident(ws.read("relations"), least), *(rels or []))
    if no_inferred:
        e = filters.without_inferred(e)
    if types or no_inferred:
        r = graph.induced(r, e)
    e, r = export.sorted_entities(e), export.sorted_relations(r)
    return {"csv": lambda: export.csv_edges(r), "csv-expanded": lambda: export.csv_edges(r, True), "csv-nodes": lambda: export.csv_nodes(e), "graphml": lambda: export.graphml(e, r), "dot": lambda: export.dot(e, r), "jsonl": lambda: export.jsonl(export.evidence_records(r))}[form]()


def doc(ws: Workspace) -> dict[str, DataFrame]:
    """Roles of programs and tables, and the steps of jobs in order."""
    e, r = ws.read("entities"), ws.read("relations")
    return {"programs": flows.program_roles(e, r), "tables": flows.table_roles(e, r), "jobs": flows.ordered(ws.read("steps"))}


def stats(ws: Workspace) -> dict[str, DataFrame]:
    return {"types": coverage.histogram(ws.read("entities"), "type"), "rels": coverage.histogram(ws.read("relations"), "rel")}


def progress(ws: Workspace) -> str:
    """Which phases have left tables, as JSON."""
    made = {"init": True, "ingest": ws.exists("files"), "model": ws.exists("relations"), "map": ws.exists("flows"), "verify": ws.exists("relations"), "analyze": ws.exists("dossier_phases"), "modernize": ws.exists("target_services")}
    return json.dumps({"phases": made, "next": next((p for p in PHASES if not made[p]), None)})
