"""What a service would answer, as DataFrames: graph, program, search, flow, jobs, batch, stats, neighborhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import flows, graph, search
from . import commands
from .commands import Workspace

DEFAULT_LIMIT, MOST_NODES, MOST_DEPTH, MOST_EDGES = 500, 2000, 4, 5000


def graph_view(ws: Workspace, types: list[str] | None = None, rels: list[str] | None = None, least: float = 0.0, limit: int = DEFAULT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree after the filters, and the edges among them."""
    e, r = ws.read("entities"), ws.read("relations")
    e = e.filter(F.col("type").isin(*types)) if types else e
    e = e.filter(F.coalesce("confidence", F.lit(0.0)) >= least)
    r = r.filter(F.col("rel").isin(*rels)) if rels else r
    return graph.top_degree(e, graph.induced(r.filter(F.coalesce("confidence", F.lit(0.0)) >= least), e), limit, MOST_NODES)


def program(ws: Workspace, name: str) -> dict[str, DataFrame]:
    one = search.get_entity(ws.read("entities").filter("type = 'program'"), name)
    r = ws.read("relations")
    return {"entity": one, "out": r.join(one.select(F.col("id").alias("from_id")), "from_id", "left_semi"), "in": r.join(one.select(F.col("id").alias("to_id")), "to_id", "left_semi")}


def find(ws: Workspace, term: str, kind: str | None = None) -> DataFrame:
    return commands.find(ws, term, kind)["entities"]


def flow(ws: Workspace, name: str) -> DataFrame:
    return ws.read("flow_edges").filter(F.upper("program") == name.upper())


def jobs(ws: Workspace) -> DataFrame:
    return flows.ordered(ws.read("steps"))


def batch(ws: Workspace, job: str) -> DataFrame:
    return ws.read("steps").filter(F.upper("job") == job.upper())


def stats(ws: Workspace) -> dict[str, DataFrame]:
    return commands.stats(ws)


def neighborhood(ws: Workspace, name: str, depth: int = 1, rels: list[str] | None = None, least: float = 0.0, include_homonyms: bool = False) -> DataFrame:
    return graph.neighborhood(commands.seeds(ws, name), ws.read("relations"), min(depth, MOST_DEPTH), rels, least, MOST_EDGES, ws.read("entities") if include_homonyms else None)
