"""Batch flows and functional flows: entries (jobs, screens, root programs) with all that they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from . import graph

# Short words that are no tokens of a flow.
STOP = ("DE", "DO", "DA", "DOS", "DAS", "THE", "AND")


def batch(entities: DataFrame, relations: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """(job, step, seq, label, programs, datasets, run_condition): one row for each step; programs by EXECUTES and CALLS_PROC, datasets by READS and WRITES."""
    steps = relations.filter("rel = 'CONTAINS'").join(entities.filter("type = 'job'").select(F.col("id").alias("from_id"), F.col("name").alias("job")), "from_id").join(entities.select(F.col("id").alias("to_id"), F.col("name").alias("step_name"), "label", "seq"), "to_id").select(F.col("from_id").alias("job_id"), "job", F.col("to_id").alias("step"), "step_name", "label", "seq")
    runs = relations.filter(F.col("rel").isin("EXECUTES", "CALLS_PROC")).groupBy(F.col("from_id").alias("step")).agg(F.array_sort(F.collect_set("to_id")).alias("programs"))
    io = relations.filter(F.col("rel").isin("READS", "WRITES")).groupBy(F.col("from_id").alias("step")).agg(F.array_sort(F.collect_set(F.struct(F.col("to_id").alias("id"), F.col("rel").alias("op")))).alias("datasets"))
    out = steps.join(runs, "step", "left").join(io, "step", "left")
    if conditions is None:
        return out.withColumn("run_condition", F.lit(None).cast("string"))
    c = conditions.select("job", F.col("step").alias("step_name"), "run_condition").dropDuplicates(["job", "step_name"])
    return out.join(c, ["job", "step_name"], "left")


def ordered(steps: DataFrame) -> DataFrame:
    """(job, steps): labels in order; steps without a number come last."""
    s = F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(9999)).alias("s"), "label")))
    return steps.groupBy("job").agg(F.transform(s, lambda x: x["label"]).alias("steps"))


def functional(entities: DataFrame, relations: DataFrame, steps: DataFrame, max_depth: int = 4) -> DataFrame:
    """(entry_id, type, entry_name, entry_label, programs, procedures, data_objects, subject_ids, tokens, summary, confidence) of all flows.

    Closures of all entries are walked together.
    """
    program = entities.filter("type in ('program', 'procedure')").select("id", "type")
    by_job = steps.select(F.col("job_id").alias("start"), "step", F.explode_outer("programs").alias("id"))
    in_steps = by_job.select("id").distinct()
    called = relations.filter(F.col("rel").isin("CALLS", "CALLS_PROC") & (F.col("to_type") == "program")).select(F.col("to_id").alias("id")).distinct()
    roots = entities.filter("type = 'program' and not coalesce(inferred, false)").join(in_steps.filter("id is not null"), "id", "left_anti").join(called, "id", "left_anti").select(F.col("id").alias("start"), "id")
    real = by_job.join(program.filter("type = 'program'").select("id"), "id", "left_semi").select("start", "id")
    seeds = cut(real.union(roots).distinct())
    c = graph.closure(seeds, entities, relations, max_depth)
    nodes = cut(c["nodes"].select("start", "id", "type").union(by_job.join(program, "id").select("start", "id", "type")).distinct())
    own = steps.select(F.col("job_id").alias("start"), F.explode("datasets").alias("d")).select("start", F.col("d.id").alias("id"), F.col("d.op").alias("op"))
    data = own.withColumn("k", F.lit(0)).union(c["data"].select("start", "id", "op", F.lit(1))).groupBy("start", "id").agg(F.min_by("op", F.struct("k", "op")).alias("op"))
    data = cut(data)
    routines = entities.filter("type = 'subroutine'").select("id", F.col("parent").alias("name"))
    screens = entities.filter("type = 'screen'").select(F.col("id").alias("start"), "name")
    routine = screens.join(routines, "name").select("start", "id")
    used = relations.filter(F.col("rel").isin("USES", "HANDLES_EVENTS")).select(F.col("from_id").alias("start"), F.col("to_id").alias("id")).join(screens.select("start"), "start", "left_semi")
    handled = routine.join(relations.filter("rel = 'HANDLES'").select(F.col("from_id").alias("id"), "to_id"), "id").select("start", F.col("to_id").alias("id"))
    on_screen = cut(routine.union(used).union(handled).distinct())
    heads = entities.filter("type in ('job', 'screen')").select(F.col("id").alias("start"), "name", "label", "type", "description", "confidence").union(entities.join(roots.select("id"), "id", "left_semi").select("id", "name", "label", "type", "description", "confidence"))
    members = nodes.select("start", "id").union(data.select("start", "id")).union(on_screen).union(steps.select("job_id", "step")).union(heads.select("start", F.col("start").alias("id"))).distinct()
    about = members.join(entities.select("id", "label", "description", F.coalesce("confidence", F.lit(1.0)).alias("conf"), F.coalesce("semantic_tags", F.array().cast("array<string>")).alias("tags")), "id", "left").groupBy("start").agg(
        F.array_sort(F.collect_set("id")).alias("subject_ids"), F.collect_set("label").alias("labels"), F.collect_set("description").alias("descriptions"), F.flatten(F.collect_list("tags")).alias("tags"), F.round(F.avg("conf"), 2).alias("member_confidence")
    )
    names = lambda d, name: d.join(entities.select("id", F.coalesce("label", "name").alias("l")), "id").groupBy("start").agg(F.array_sort(F.collect_set("l")).alias(name))
    out = heads.join(about, "start", "left").join(names(nodes.filter("type = 'program'"), "programs"), "start", "left").join(names(nodes.filter("type = 'procedure'"), "procedures"), "start", "left").join(names(data, "data_objects"), "start", "left").join(c["confidence"], "start", "left")
    none = F.array().cast("array<string>")
    for a in ("programs", "procedures", "data_objects"):
        out = out.withColumn(a, F.coalesce(a, none))
    words = F.transform(F.concat("labels", "descriptions", "tags"), lambda x: F.upper(x))
    tokens = F.array_distinct(F.concat(words, F.filter(F.flatten(F.transform(words, lambda x: F.split(x, "[^A-Z0-9]+"))), lambda t: (F.length(t) >= 3) & ~t.isin(*STOP))))
    kind = F.when(F.col("type") == "job", "batch").when(F.col("type") == "screen", "screen").otherwise("program_entry")
    mean = F.round(F.col("total") / F.col("n"), 2)
    root_mean = F.round((F.col("total") + F.coalesce("confidence", F.lit(0.0))) / (F.col("n") + F.col("confidence").isNotNull().cast("int")), 2)
    confidence = F.when(kind == "screen", F.coalesce("member_confidence", F.lit(0.85))).when(kind == "batch", F.coalesce(mean, F.lit(1.0))).otherwise(F.coalesce(root_mean, "confidence", F.lit(0.9)))
    summary = F.concat_ws(" | ", F.coalesce("label", "name"), F.concat_ws(" -> ", F.slice("programs", 1, 5)), F.concat_ws(", ", F.slice("data_objects", 1, 4)), "description")
    return out.select(F.col("start").alias("entry_id"), kind.alias("type"), F.col("name").alias("entry_name"), F.coalesce("label", "name").alias("entry_label"), "programs", "procedures", "data_objects", "subject_ids", tokens.alias("tokens"), summary.alias("summary"), confidence.alias("confidence"))


def program_roles(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, role): menu, orchestration, persistence, subroutine or processing, by what a program does and its tags."""
    out = relations.groupBy(F.col("from_id").alias("id")).agg(F.count_if(F.col("rel").isin("CALLS", "CALLS_PROC", "EXECUTES")).alias("calls"), F.count_if(F.col("rel").isin("WRITES", "UPDATES")).alias("writes"))
    into = relations.filter(F.col("rel").isin("CALLS", "CALLS_PROC", "EXECUTES")).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers"))
    p = entities.filter("type = 'program'").join(out, "id", "left").join(into, "id", "left").fillna(0, ["calls", "writes", "callers"])
    menu = F.array_contains(F.coalesce("semantic_tags", F.array().cast("array<string>")), "menu")
    return p.select("id", F.when(menu, "menu").when(F.col("calls") >= 3, "orchestration").when(F.col("writes") > 0, "persistence").when((F.col("callers") > 0) & (F.col("calls") == 0), "subroutine").otherwise("processing").alias("role"))


def table_roles(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(id, role): shared (read and maintained), reference (read only), sink (written only) or unused."""
    n = relations.groupBy(F.col("to_id").alias("id")).agg(F.count_if(F.col("rel") == "READS").alias("r"), F.count_if(F.col("rel").isin("WRITES", "UPDATES")).alias("w"))
    t = entities.filter("type = 'table'").join(n, "id", "left").fillna(0, ["r", "w"])
    return t.select("id", F.when((F.col("r") > 0) & (F.col("w") > 0), "shared").when(F.col("r") > 0, "reference").when(F.col("w") > 0, "sink").otherwise("unused").alias("role"))
