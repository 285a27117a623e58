"""Exports: CSV rows, GraphML, DOT, Mermaid, Structurizr and JSON lines; large outputs are rows to write, small ones text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_quote, dot_escape, xml_escape
from . import ordering

#: Rows that a diagram text is made of at most; beyond, reduce the graph first.
DIAGRAM_ROWS = 500


def sorted_entities(entities: DataFrame) -> DataFrame:
    """Entities by type, label and id as a dictionary has them, in ranges: files follow each other."""
    return ordering.ranged(entities, [ordering.natural(c) for c in ("type", "label", "id")] + [F.col("id")])


def sorted_relations(relations: DataFrame) -> DataFrame:
    return ordering.ranged(relations, [ordering.natural(c) for c in ("rel", "from_id", "to_id")] + [F.col("from_id"), F.col("to_id")])


def csv_edges(relations: DataFrame, expanded: bool = False) -> DataFrame:
    """Relations with evidence as one text (joined by " | "), or one row for each piece of evidence."""
    if expanded:
        return relations.withColumn("evidence", F.explode_outer("evidence"))
    return relations.withColumn("evidence", F.array_join("evidence", " | "))


def csv_nodes(entities: DataFrame) -> DataFrame:
    return entities.select("id", "type", "name", "label", "parent", F.array_join("files", " | ").alias("files"), "confidence", "inferred")


def csv_lines(df: DataFrame) -> DataFrame:
    """Every row as one quoted CSV line."""
    return df.select(F.concat_ws(",", *[csv_quote(F.col(c)) for c in df.columns]).alias("line"))


def graphml_nodes(entities: DataFrame) -> DataFrame:
    line = F.concat(F.lit('  <node id="'), xml_escape(F.col("id")), F.lit('"><data key="label">'), xml_escape(F.col("label")), F.lit('</data><data key="type">'), xml_escape(F.col("type")), F.lit("</data></node>"))
    return entities.select("id", line.alias("line"))


def graphml_edges(relations: DataFrame) -> DataFrame:
    line = F.concat(F.lit('  <edge source="'), xml_escape(F.col("from_id")), F.lit('" target="'), xml_escape(F.col("to_id")), F.lit('"><data key="rel">'), xml_escape(F.col("rel")), F.lit("</data></edge>"))
    return relations.select("from_id", "to_id", "rel", line.alias("line"))


def graphml(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(part, line): the lines of a GraphML document; write them in the order of part and line."""
    spark = entities.sparkSession
    head = spark.createDataFrame([(0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (2, '<key id="label" for="node" attr.name="label" attr.type="string"/>'), (3, '<key id="type" for="node" attr.name="type" attr.type="string"/>'), (4, '<key id="rel" for="edge" attr.name="rel" attr.type="string"/>'), (5, '<graph edgedefault="directed">'), (8, "</graph></graphml>")], "part int, line string")
    return head.union(graphml_nodes(entities).select(F.lit(6), "line")).union(graphml_edges(relations).select(F.lit(7), "line"))


def dot_edges(relations: DataFrame) -> DataFrame:
    line = F.concat(F.lit("  "), dot_escape(F.col("from_id")), F.lit(" -> "), dot_escape(F.col("to_id")), F.lit(" [label="), dot_escape(F.col("rel")), F.lit("];"))
    return relations.select("from_id", "to_id", "rel", line.alias("line"))


def dot(entities: DataFrame, relations: DataFrame, layout: str = "LR") -> DataFrame:
    """(part, line) of a DOT digraph."""
    head = entities.sparkSession.createDataFrame([(0, "digraph model {"), (1, f"  rankdir={layout};"), (4, "}")], "part int, line string")
    nodes = entities.select(F.lit(2), F.concat(F.lit("  "), dot_escape(F.col("id")), F.lit(" [label="), dot_escape(F.col("label")), F.lit("];")))
    return head.union(nodes).union(dot_edges(relations).select(F.lit(3), "line"))


def jsonl(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("line"))


def evidence_records(relations: DataFrame) -> DataFrame:
    """Relations that have evidence."""
    return relations.filter(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0)


def _safe(x: str) -> str:
    return "n_" + "".join(c if c.isalnum() else "_" for c in x)


def mermaid(relations: DataFrame, title: str = "", limit: int = 80, direction: str = "LR") -> str:
    """Flowchart of the first edges (by ids); the limit is what a diagram can hold."""
    rows = relations.select("from_id", "to_id", "rel").orderBy("from_id", "to_id", "rel").limit(min(limit, DIAGRAM_ROWS)).collect()
    out = [f"%% {title}"] * bool(title) + [f"flowchart {direction}"]
    for r in rows:
        label = lambda x: x.replace('"', "'")
        out.append(f'  {_safe(r["from_id"])}["{label(r["from_id"])}"] -->|{r["rel"]}| {_safe(r["to_id"])}["{label(r["to_id"])}"]')
    return "\n".join(out)


def _quoted(x) -> str:
    return str(x).replace('"', "'")


def mermaid_batch(steps: DataFrame, job: str) -> str:
    """Flowchart of a job's steps in order, with what they run, read and write, out of flows.batch rows."""
    rows = steps.filter(F.upper("job") == job.upper()).orderBy(F.coalesce("seq", F.lit(9999)), "label").limit(DIAGRAM_ROWS).collect()
    out, before = ["graph TD"], _safe(f"job:{job.upper()}") + f'["JOB: {_quoted(job.upper())}"]'
    for r in rows:
        node = _safe(r["step"])
        out.append(f'  {before} --> {node}["STEP: {_quoted(r["label"])}"]')
        before = node
        out += [f'  {node} -->|EXEC| {_safe(p)}["{_quoted(p)}"]' for p in r["programs"] or []]
        for d in r["datasets"] or []:
            box = f'{_safe(d["id"])}["{_quoted(d["id"])}"]'
            out.append(f"  {box} -->|READ| {node}" if d["op"] == "READS" else f"  {node} -->|WRITE| {box}")
    return "\n".join(out if rows else [*out, f'  none["No steps found for job {_quoted(job.upper())}"]'])


def mermaid_phases(phases: DataFrame, seed: str) -> str:
    """Flowchart of the phases of a seed in order."""
    rows = phases.filter(F.col("seed") == seed).orderBy("seq").limit(DIAGRAM_ROWS).collect()
    names = [_safe(f"phase:{r['seq']}") for r in rows]
    return "\n".join(["flowchart LR", *[f'  {n}["{_quoted(r["label"])}"]' for n, r in zip(names, rows, strict=True)], *[f"  {a} --> {b}" for a, b in zip(names, names[1:], strict=False)]])


def mermaid_states(states: DataFrame, seed: str) -> str:
    """State diagram of a seed's states (semantics.states), from the first on."""
    rows = states.filter(F.col("seed") == seed).orderBy("place").limit(DIAGRAM_ROWS).collect()
    names = [_safe(r["id"]) for r in rows]
    moves = [f"  {a} --> {b}: {'transicao inferida' if r['inferred'] else 'transicao observada'}" for a, b, r in zip(names, names[1:], rows, strict=False)]
    return "\n".join(["stateDiagram-v2", *([f"  [*] --> {names[0]}"] if names else []), *[f"  {n}: {_quoted(r['label'])}" for n, r in zip(names, rows, strict=True)], *moves])


def mermaid_reverse(traces: DataFrame, limit: int = 80) -> str:
    """Flowchart of reverse traces (terminal, hop, id, rel): from each end back to where it comes from."""
    rows = traces.select("terminal", "hop", "id", "rel").distinct().orderBy("terminal", "hop").limit(min(limit, DIAGRAM_ROWS)).collect()
    out, last = ["flowchart RL"], {}
    for r in rows:
        if r["hop"] == 0:
            out.append(f'  {_safe(r["id"])}["{_quoted(r["id"])}"]')
        elif r["terminal"] in last:
            out.append(f"  {_safe(last[r['terminal']])} -->|{_quoted(r['rel'])}| {_safe(r['id'])}")
        last[r["terminal"]] = r["id"]
    return "\n".join(dict.fromkeys(out))


def verify_markdown(report: dict[str, DataFrame], title: str = "Coverage") -> str:
    """The report of commands.verify as text: totals, histograms, entry points, isolated programs, hotspots and gaps, each up to a number of rows."""
    total = report["report"].first().asDict()
    out = [f"# {title}", "", *[f"- {k}: {v}" for k, v in total.items()]]
    for name in ("types", "rels", "dialects", "buckets", "hotspots", "entrypoints", "isolated", "gaps"):
        df = report[name]
        out += ["", f"## {name}", "", markdown_table(df.orderBy(*df.columns), df.columns)]
    return "\n".join(out)


# What a type is called in a component model.
TECHNOLOGY = {"program": "COBOL program", "job": "Batch job", "table": "Relational table", "dataset": "File", "screen": "Desktop form", "procedure": "Stored procedure"}


def structurizr(nodes: DataFrame, edges: DataFrame, system: str) -> str:
    """Workspace text of a reduced graph (id, type, label and from_id, to_id, rel)."""
    n = nodes.orderBy("id").limit(DIAGRAM_ROWS).collect()
    e = edges.orderBy("from_id", "to_id", "rel").limit(DIAGRAM_ROWS).collect()
    quote = lambda x: str(x).replace("\\", "\\\\").replace('"', '\\"')
    out = ["workspace {", "  model {", f'    sys = softwareSystem "{quote(system)}" {{']
    out += [f'      {_safe(r["id"])} = container "{quote(r["label"])}" "" "{TECHNOLOGY.get(r["type"], r["type"])}"' for r in n]
    out += ["    }"] + [f'    {_safe(r["from_id"])} -> {_safe(r["to_id"])} "{r["rel"]}"' for r in e]
    return "\n".join([*out, "  }", "  views {", "    container sys {", "      include *", "      autoLayout lr", "    }", "  }", "}"])


def markdown_table(df: DataFrame, columns: list[str], limit: int = 50) -> str:
    """The first rows as a table for a report."""
    rows = df.select(*columns).limit(min(limit, DIAGRAM_ROWS)).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
