"""Coverage, gaps and dead code: aggregates and anti-joins over the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import half_up, percent

HIGH, MEDIUM = 0.8, 0.5


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def bucket(confidence: Column) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= HIGH, "high").when(c >= MEDIUM, "medium").otherwise("low")


def confidence_buckets(relations: DataFrame) -> DataFrame:
    return relations.groupBy(bucket(F.col("confidence")).alias("bucket")).agg(F.count("*").alias("n"))


def entrypoints(programs: DataFrame, calls: DataFrame) -> DataFrame:
    """Programs (id) that no call names."""
    return programs.join(calls.filter("rel = 'CALLS'").select(F.col("to_id").alias("id")), "id", "left_anti")


def isolated(programs: DataFrame, relations: DataFrame) -> DataFrame:
    """Programs that call nothing, touch no data and are called by nothing."""
    calls = relations.filter(F.col("rel").isin("CALLS", "CALLS_PROC"))
    out = programs.join(calls.select(F.col("from_id").alias("id")), "id", "left_anti")
    out = out.join(relations.filter(F.col("rel").isin("READS", "WRITES", "UPDATES")).select(F.col("from_id").alias("id")), "id", "left_anti")
    return out.join(calls.select(F.col("to_id").alias("id")), "id", "left_anti")


def files_without_entities(files: DataFrame, entities: DataFrame) -> DataFrame:
    return files.join(entities.select(F.explode("files").alias("path")).distinct(), "path", "left_anti")


def hotspots(relations: DataFrame, entities: DataFrame, top: int = 10) -> DataFrame:
    """Real programs by the number of call edges that lead to them (ties by id)."""
    n = relations.filter(F.col("rel").isin("CALLS", "CALLS_PROC")).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("fan_in"))
    real = entities.filter(~F.coalesce("inferred", F.lit(False))).select("id")
    return n.join(real, "id", "left_semi").orderBy(F.desc("fan_in"), "id").limit(top)


def distinct_evidence(relations: DataFrame, by: str = "rel") -> DataFrame:
    """(by, n_targets, n_evidence): distinct ends and places of evidence."""
    return relations.groupBy(by).agg(F.count_distinct("to_id").alias("n_targets"), F.count_distinct("evidence").alias("n_evidence"))


def mean_confidence(relations: DataFrame, by: str) -> DataFrame:
    """(by, confidence): the mean to two decimals, halves up; 1 where no relation has one."""
    return relations.groupBy(by).agg(F.coalesce(half_up(F.avg("confidence"), 2), F.lit(1.0)).alias("confidence"))


def report(entities: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """One row of totals and percentages: files with entities, inferred entities, relations with evidence, buckets."""
    e = entities.agg(F.count("*").alias("n_entities"), F.count_if(F.coalesce("inferred", F.lit(False))).alias("n_inferred"))
    r = relations.agg(F.count("*").alias("n_relations"), F.count_if(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0).alias("n_evidence"), *[F.count_if(bucket(F.col("confidence")) == b).alias(f"n_{b}") for b in ("high", "medium", "low")])
    f = files.agg(F.count("*").alias("n_files"))
    g = files.join(entities.select(F.explode("files").alias("path")).distinct(), "path", "left_semi").agg(F.count("*").alias("n_files_with_entities"))
    one = e.withColumn("k", F.lit(1))
    for d in (r, f, g):
        one = one.join(d.withColumn("k", F.lit(1)), "k")
    return one.drop("k").select(
        "*",
        percent(F.col("n_files_with_entities"), F.col("n_files")).alias("pct_files"),
        percent(F.col("n_inferred"), F.col("n_entities")).alias("pct_inferred"),
        percent(F.col("n_evidence"), F.col("n_relations")).alias("pct_evidence"),
    )


def weighted_score(files_share: Column, evidence_share: Column, resolved_share: Column) -> tuple[Column, Column]:
    """0.3, 0.4 and 0.3 of the shares, and its grade (0.9 high, 0.6 medium)."""
    score = 0.3 * files_share + 0.4 * evidence_share + 0.3 * resolved_share
    return score, F.when(score >= 0.9, "high").when(score >= 0.6, "medium").otherwise("low")


def unresolved(relations: DataFrame, entities: DataFrame, top: int = 50) -> DataFrame:
    """Ends that are no entity, by how often they occur (ties by name), with their first place."""
    lost = relations.join(entities.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return lost.groupBy("to_id").agg(F.count("*").alias("n"), F.min("evidence").alias("first_evidence")).orderBy(F.desc("n"), "to_id").limit(top)


def gaps(entities: DataFrame, relations: DataFrame, files: DataFrame) -> DataFrame:
    """(kind, id): files without entities, inferred entities, relations under medium confidence or without evidence."""
    name = F.concat_ws("|", "from_id", "rel", "to_id")
    return (
        files_without_entities(files, entities).select(F.lit("file_without_entities").alias("kind"), F.col("path").alias("id"))
        .union(entities.filter("inferred").select(F.lit("inferred_entity"), "id"))
        .union(relations.filter(F.coalesce("confidence", F.lit(0.0)) < MEDIUM).select(F.lit("low_confidence"), name))
        .union(relations.filter(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0).select(F.lit("no_evidence"), name))
    )


def pending(entities: DataFrame, relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(kind, name) that wait for review: unsure or inferred entities and unsure relations without an approval (decisions: name, action)."""
    e = entities.filter((F.coalesce("confidence", F.lit(0.0)) < HIGH) | F.coalesce("inferred", F.lit(False))).select(F.lit("entity").alias("kind"), "name")
    r = relations.filter(F.coalesce("confidence", F.lit(0.0)) < MEDIUM).select(F.lit("relation"), F.concat_ws("|", "from", "rel", "to"))
    return e.union(r).join(decisions.filter("action = 'approve'").select("name").distinct(), "name", "left_anti").select("kind", "name")


def review_report(decisions: DataFrame) -> DataFrame:
    """(action, n, names) of the latest decision on each name."""
    latest = decisions.groupBy("name").agg(F.max_by("action", F.struct("at", "action")).alias("action"))
    return latest.groupBy("action").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("name")).alias("names"))


def cluster_metrics(members: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """For each cluster of members (cluster, id): types, platforms, inputs, outputs, calls and mean confidences (two decimals, 1 if there is none)."""
    from ..functions.identity import platform

    m = members.join(entities.select("id", "type", "confidence"), "id")
    e = m.groupBy("cluster").agg(F.count("*").alias("n_members"), F.count_distinct("type").alias("n_types"), F.count_distinct(platform(F.col("type"))).alias("n_platforms"), F.coalesce(F.round(F.avg("confidence"), 2), F.lit(1.0)).alias("entity_confidence"))
    r = relations.join(members.select("cluster", F.col("id").alias("from_id")), "from_id")
    r = r.groupBy("cluster").agg(F.count_if(F.col("rel") == "READS").alias("n_inputs"), F.count_if(F.col("rel").isin("WRITES", "UPDATES")).alias("n_outputs"), F.count_if(F.col("rel").isin("CALLS", "CALLS_PROC")).alias("n_calls"), F.coalesce(F.round(F.avg("confidence"), 2), F.lit(1.0)).alias("relation_confidence"))
    zero = {"n_inputs": 0, "n_outputs": 0, "n_calls": 0, "relation_confidence": 1.0}
    return e.join(r, "cluster", "left").fillna(zero)
