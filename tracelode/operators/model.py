"""From raw records to the canonical model: merging, endpoint resolution, dynamic calls, contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity, schema
from ..functions.storage import cut
from ..functions.text import normalize_name

# How much a source of descriptions counts.
SOURCE_RANK = {"cobol_header": 400, "jcl_comment": 300, "flow_summary": 200, "derived": 100}


def source_rank(c):
    out = F.lit(0)
    for name, rank in SOURCE_RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def merge_entities(raw: DataFrame) -> DataFrame:
    """One row for each id: files and tags united, highest confidence, first value of the rest by ordinal; the description of the best source, then the longest."""
    r = schema.shaped(raw, schema.RAW_ENTITY).withColumn("name", normalize_name(F.col("name"))).withColumn("type", F.lower(F.trim("type"))).filter("length(name) > 0 and length(type) > 0")
    r = r.withColumn("id", identity.entity_id(F.col("type"), F.col("name"), F.col("parent"), F.col("fileHash"), F.col("file")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(c)  # noqa: E731  of rows that have a value
    described = F.when(F.length("description") > 0, F.struct(source_rank(F.col("description_source")), F.length("description"), -F.coalesce("ordinal", F.lit(0))))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    out = r.groupBy("id").agg(
        *[first(c) for c in ("type", "name", "parent", "parentType", "line", "extractor", "fileHash", "level", "pic", "controlType", "seq")],
        F.min_by("occurs", F.when(F.col("occurs").isNotNull(), F.col("ordinal"))).alias("occurs"),
        F.array_sort(F.collect_set("file")).alias("files"),
        F.max("confidence").alias("confidence"),
        F.lit(False).alias("inferred"),
        F.max_by("description", described).alias("description"),
        F.max_by("description_source", described).alias("description_source"),
        union("description_evidence").alias("description_evidence"),
        F.transform(union("semantic_tags"), lambda t: F.lower(t)).alias("semantic_tags"),
    )
    out = out.withColumn("label", identity.entity_label(F.col("type"), F.col("name"), F.col("parent")))
    return schema.shaped(out, schema.ENTITY)


def of_type(ends: DataFrame, entities: DataFrame) -> DataFrame:
    """(__row, side, id, p, q, i) of ends (__row, side, type, name, parent, preference): the entity of that type and name, from the same parent if there is one. An end meets one row, however many entities share its name."""
    names = entities.select("id", "type", "name", normalize_name(F.col("parent")).alias("parent"), F.struct(F.coalesce("inferred", F.lit(False)).cast("int").alias("i"), "id").alias("best"))
    anywhere, inside = names.groupBy("type", "name").agg(F.min("best").alias("any")), names.groupBy("type", "name", "parent").agg(F.min("best").alias("own"))
    met = ends.join(anywhere, ["type", "name"]).join(inside, ["type", "name", "parent"], "left").filter((F.length("parent") == 0) | F.col("own").isNotNull() | ~F.col("type").isin(*identity.SCOPED))
    return met.withColumn("best", F.coalesce("own", "any")).select("__row", "side", "best.id", F.col("preference").alias("p"), F.col("own").isNull().cast("int").alias("q"), "best.i")


def end_of(side: str) -> Column:
    """All that an end of a raw relation is resolved by, as one value; of the file only the key, and only where it is part of an id."""
    name, given, parent = normalize_name(F.col(f"`{side}`")), F.lower(F.trim(F.col(f"{side}Type"))), normalize_name(F.col(f"{side}Parent"))
    extractor = F.upper(F.coalesce("extractor", F.lit("")))
    kind = F.coalesce(given, identity.inferred_type(F.col("rel"), side, extractor, name))
    by_file = (kind == "sql_script") | (kind.isin(*identity.SCOPED) & (F.length(parent) == 0))
    return F.struct(F.lit(side).alias("side"), F.col("rel"), extractor.alias("extractor"), name.alias("name"), given.alias("given"), parent.alias("parent"), kind.alias("kind"), F.when(by_file, identity.file_key(F.col("fileHash"), F.col("file"))).alias("at"))


def resolve_endpoints(raw: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations with from_id and to_id, and the entities that had to be inferred.

    An end is looked up by its given type and name (and parent), else by the candidate types of its relation in order, else by a name that only one entity has; what is left becomes an inferred entity with confidence 0.3. Real entities go first; inferred ones don't change what another end resolves to.
    Ends that say the same are resolved once, however many relations have them.
    """
    spark, entities = raw.sparkSession, entities.filter("id is not null")
    r = schema.shaped(raw, schema.RAW_RELATION).withColumn("rel", F.upper("rel"))
    r = r.withColumn("__from", end_of("from")).withColumn("__to", end_of("to"))
    ends = r.select(F.explode(F.array("__from", "__to")).alias("end")).distinct()
    ends = cut(ends.select("end", F.monotonically_increasing_id().alias("__row"))).select("__row", "end", "end.*")
    options = identity.candidate_types(spark)
    exact = options.filter("extractor <> '*'").select("side", "rel", "extractor").distinct().withColumn("__own", F.lit(True))
    typed = ends.filter("given is not null").drop("end").withColumn("type", F.col("given")).withColumn("preference", F.lit(0))
    # 120 fixed rows on the right
    open_ = ends.filter("given is null").drop("end").join(F.broadcast(exact), ["side", "rel", "extractor"], "left").withColumn("extractor", F.when(F.col("__own"), F.col("extractor")).otherwise("*")).join(F.broadcast(options), ["side", "rel", "extractor"]).select(*typed.columns)
    by_type = of_type(typed.unionByName(open_), entities)
    names = entities.select("id", "name")
    single = names.groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n = 1").select("name", "id")
    by_name = ends.filter("given is null").join(single, "name").select("__row", "side", "id", F.lit(99).alias("p"), F.lit(0).alias("q"), F.lit(0).alias("i"))
    found = by_type.unionByName(by_name).groupBy("__row").agg(F.min_by("id", F.struct("p", "q", "i", "id")).alias("id"))
    own = identity.entity_id(F.col("kind"), F.col("name"), F.col("parent"), F.col("at"), F.lit(None).cast("string"))
    ids = cut(ends.join(found, "__row", "left").select("end", F.coalesce("id", own).alias("id"), F.col("id").isNull().alias("lost")))
    lost = ids.filter("lost").select("end", "id", F.col("end.kind").alias("type"), "end.name", "end.parent")
    made = lost.groupBy("id").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min(F.when(F.length("parent") > 0, F.col("parent"))).alias("parent"))
    # read only if files are asked for
    files = r.select(F.explode(F.array("__from", "__to")).alias("end"), "file").join(lost.select("end", "id"), "end").groupBy("id").agg(F.array_sort(F.collect_set("file")).alias("files"))
    made = made.join(files, "id", "left").withColumn("confidence", F.lit(0.3)).withColumn("inferred", F.lit(True)).withColumn("extractor", F.lit("inferred")).withColumn("label", identity.entity_label(F.col("type"), F.col("name"), F.col("parent")))
    made = schema.shaped(made, schema.ENTITY)
    about = entities.select("id", "type", "label").unionByName(made.select("id", "type", "label")).dropDuplicates(["id"])
    known = ids.join(about, "id", "left").dropDuplicates(["end"])
    for side in ("from", "to"):
        r = r.join(known.select(F.col("end").alias(f"__{side}"), F.col("id").alias(f"{side}_id"), F.col("type").alias(f"{side}_type"), F.col("label").alias(f"{side}_label")), f"__{side}", "left")
    return r.drop("__from", "__to"), made


def merge_relations(resolved: DataFrame) -> DataFrame:
    """One row for each (rel, from_id, to_id): distinct evidence, highest confidence, first value of the rest by ordinal."""
    r = resolved.withColumn("__ref", F.when(F.col("file").isNotNull(), F.concat_ws(":", "file", "line")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.coalesce(F.col("ordinal"), F.lit(0)))).alias(c)
    out = r.groupBy("rel", "from_id", "to_id").agg(*[first(c) for c in ("from", "to", "from_type", "to_type", "from_label", "to_label", "extractor")], F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("__ref")).alias("evidence"), F.max("dynamic").alias("dynamic"))
    return schema.shaped(out, schema.RELATION)


def normalize(raw_entities: DataFrame, raw_relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Canonical entities and relations of raw records."""
    entities = cut(merge_entities(raw_entities))
    resolved, made = resolve_endpoints(raw_relations, entities)
    relations = cut(merge_relations(resolved))
    return entities.unionByName(made.join(entities.select("id"), "id", "left_anti")), relations


def resolve_dynamic_calls(relations: DataFrame, var_values: DataFrame) -> DataFrame:
    """CALL-DYNAMIC edges whose variable has known literals become CALLS (0.95); the others stay.

    var_values: (program, var, value).
    """
    dynamic = relations.filter("rel = 'CALL-DYNAMIC'")
    known = var_values.select(normalize_name(F.col("program")).alias("__p"), normalize_name(F.col("var")).alias("__v"), normalize_name(F.col("value")).alias("__to")).distinct()
    on = (normalize_name(F.col("from")) == F.col("__p")) & (normalize_name(F.col("to")) == F.col("__v"))
    met = dynamic.join(known, on)
    calls = met.withColumn("evidence", F.array_union(F.coalesce("evidence", F.array().cast("array<string>")), F.array(F.concat(F.lit("resolved-via-flow:"), "__v"))))
    calls = calls.withColumn("resolvedFrom", F.col("__v")).withColumn("rel", F.lit("CALLS")).withColumn("to", F.col("__to")).withColumn("to_id", F.concat(F.lit("program:"), "__to")).withColumn("to_type", F.lit("program")).withColumn("to_label", F.col("__to")).withColumn("confidence", F.lit(0.95)).withColumn("dynamic", F.lit(True)).drop("__p", "__v", "__to")
    rest = dynamic.join(known, on, "left_anti")
    return relations.filter("rel <> 'CALL-DYNAMIC'").unionByName(rest).unionByName(calls)


def heuristic_targets(names: DataFrame, programs: DataFrame) -> DataFrame:
    """(var, target): known programs (name) that a variable's name stands for, without its prefix, suffix and hyphens."""
    bare = F.regexp_replace(F.col("var"), "^(WRK|WS|LK|LS|DF)-?", "")
    forms = F.array(F.col("var"), bare, F.regexp_replace(bare, "-?(PROGRAMA|PROGRAM|PROG|PGM)$", ""), F.replace(F.regexp_replace(bare, "-?(PROGRAMA|PROGRAM|PROG|PGM)$", ""), F.lit("-"), F.lit("")))
    tried = names.select("var", F.explode(F.array_distinct(forms)).alias("target")).filter("length(target) >= 3")
    return tried.join(programs.select(F.col("name").alias("target")).distinct(), "target", "left_semi").select("var", "target").distinct()


def build_contracts(calls: DataFrame, uses: DataFrame, includes: DataFrame) -> DataFrame:
    """DATA_CONTRACT edges: what a CALL passes USING, with the copybook that defines it.

    uses: (program, callee, field, copybook, level, pic); a field is confirmed if the callee includes the copybook too. Confidence 0.9 confirmed, 0.7 with a copybook, else 0.5.
    """
    shared = includes.select(F.col("from_id").alias("callee_id"), F.upper("to_label").alias("copybook")).distinct().withColumn("confirmed", F.lit(True))
    rows = uses.select(F.concat(F.lit("program:"), "program").alias("from_id"), F.concat(F.lit("program:"), "callee").alias("to_id"), "field", F.upper("copybook").alias("copybook"), *([F.col(c) if c in uses.columns else F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("pic", "string"))]))
    rows = rows.join(calls.filter(F.col("rel").isin("CALLS", "CALL-DYNAMIC")).select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_semi")
    rows = rows.join(shared.withColumnRenamed("callee_id", "to_id"), ["to_id", "copybook"], "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    item = F.struct(F.col("field").alias("name"), "copybook", "level", "pic", "confirmed")
    out = rows.groupBy("from_id", "to_id").agg(F.array_sort(F.collect_set(item)).alias("fields"))
    has = lambda test: F.exists("fields", test)
    confidence = F.when(has(lambda f: f["confirmed"]), 0.9).when(has(lambda f: f["copybook"].isNotNull()), 0.7).otherwise(0.5)
    return schema.shaped(out.withColumn("rel", F.lit("DATA_CONTRACT")).withColumn("confidence", confidence).withColumn("extractor", F.lit("data-contract")), schema.RELATION)


def merge_contracts(old: DataFrame, new: DataFrame) -> DataFrame:
    """One contract for each (from_id, to_id): the more confident one, with the fields that only the others name."""
    rows = old.unionByName(new)
    order = Window.partitionBy("from_id", "to_id").orderBy(F.desc("confidence"), F.desc(F.size("fields")), F.to_json("fields"))
    ranked = rows.withColumn("__k", F.row_number().over(order))
    every = ranked.groupBy("from_id", "to_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("__k", "fields")))["fields"]).alias("__all"))
    best = ranked.filter("__k = 1").drop("__k").join(every, ["from_id", "to_id"])
    names = F.array_distinct(F.transform("__all", lambda f: f["name"]))
    fields = F.transform(names, lambda n: F.filter("__all", lambda f: f["name"] == n)[0])
    return best.withColumn("fields", fields).drop("__all").select(*old.columns)


def prune_inferred(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Without the inferred entities that no relation names."""
    ends = relations.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    return entities.filter(~F.coalesce("inferred", F.lit(False))).unionByName(entities.filter("inferred").join(ends, "id", "left_semi"))


def dedupe_relations(relations: DataFrame, side: str = "to") -> DataFrame:
    """One row for each (rel, label of that side): highest confidence, united evidence, and whether it is low (under 0.5)."""
    out = relations.groupBy("rel", F.col(f"{side}_label").alias("target")).agg(F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
    return out.withColumn("low", F.coalesce("confidence", F.lit(0.0)) < 0.5)


def lineage(field: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id): copybooks that hold the fields (id), programs that include them, what these access, steps that run them, jobs.

    A nested field is followed to its copybook through its parents.
    """
    parents = entities.filter("type = 'field'").select("id", "name", "parent", "parentType")
    at = cut(field.join(parents, "id").select("id", "parent", "parentType"))
    books = at.filter("parentType = 'copybook'").select(F.concat(F.lit("copybook:"), F.upper("parent")).alias("id"))
    for _ in range(49):  # levels of a copybook
        at = cut(at.filter("parentType = 'field'").join(parents.select(F.col("name").alias("parent"), F.col("parent").alias("up"), F.col("parentType").alias("upType")), "parent").select("id", F.col("up").alias("parent"), F.col("upType").alias("parentType")).distinct())
        if at.isEmpty():
            break
        books = books.union(at.filter("parentType = 'copybook'").select(F.concat(F.lit("copybook:"), F.upper("parent"))))
    books = cut(books.distinct())
    edge = lambda *rels: relations.filter(F.col("rel").isin(*rels)).select("from_id", "to_id")
    programs = edge("INCLUDES").join(books.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    data = edge("READS", "WRITES", "UPDATES").join(programs.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct()
    runs = edge("EXECUTES").join(programs.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    jobs = edge("CONTAINS").join(runs.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).distinct()
    out = books.select(F.lit("copybook").alias("kind"), "id")
    for kind, d in (("program", programs), ("data", data), ("step", runs), ("job", jobs)):
        out = out.union(d.select(F.lit(kind), "id"))
    return out


def merge_relations_again(relations: DataFrame) -> DataFrame:
    """Canonical relations that have come to share a key (rel, from_id, to_id), as one."""
    rows = relations.withColumn("__k", F.xxhash64("evidence", "confidence", "extractor"))
    keep = ("from", "to", "from_type", "to_type", "from_label", "to_label", "extractor", "resolvedFrom")
    out = rows.groupBy("rel", "from_id", "to_id").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(-F.coalesce("confidence", F.lit(0.0)), "__k"))).alias(c) for c in keep], F.max("confidence").alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("evidence", F.array().cast("array<string>")))))).alias("evidence"), F.max("dynamic").alias("dynamic"), F.min_by("fields", F.when(F.col("fields").isNotNull(), F.col("__k"))).alias("fields"))
    return schema.shaped(out, schema.RELATION)
