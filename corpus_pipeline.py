"""A training-corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has kept, and is
written as Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import decontam, jaccard, language, mixing, quality, sharding
from tracelode.llm.common import named, table, written


def renamed(docs: DataFrame, held: tuple[str, ...]) -> DataFrame:
    """docs with all columns but held under names that no operator gives to its own."""
    return docs.toDF(*[c if c in held else f"__c{k}" for k, c in enumerate(docs.columns)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = docs.select("doc_id", "text", language.held_out(3, 1).alias("__held_out"))
    model = quality.fit(scored.filter(~F.col("__held_out")), table(spark, sf_dir, "labels"))
    rows = renamed(docs, ("doc_id", "text"))
    return quality.score(rows, model, rows.columns).filter("predicted = 1").select(*rows.columns).toDF(*docs.columns)


def least_row(docs: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key the least one, by the other columns in order (maps by their JSON)."""
    held = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    at = f"c{docs.columns.index(key)}"
    rest = [f for f in held.schema.fields if f.name != at]
    least = held.groupBy(at).agg(F.min_by(F.struct(*[f.name for f in rest]), F.struct(*[sharding.comparable(f) for f in rest])).alias("row"))
    return least.select(*[F.col(c) if c == at else F.col(f"row.{c}") for c in held.columns]).toDF(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8) the document with the smallest id.

    Rows that share an id leave one, the least. Rows without an id can't be named as members: those with words leave one of each text, and none of a text that a row with an id has.
    """
    groups = written(jaccard.join(docs, words=5, percent=80), "groups")
    drop = written(groups.filter("doc_id <> component_id").select("doc_id").distinct(), "drop")
    kept = docs.filter("doc_id is not null").join(jaccard.sized(drop), "doc_id", "left_anti").select(*[named(c) for c in docs.columns])
    held = groups.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not held.isEmpty():
        kept = least_row(kept, "doc_id")
    if groups.filter("doc_id is null").isEmpty():
        return kept
    bare, words = docs.filter("doc_id is null"), F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    one = least_row(bare.filter(words), "text").join(docs.filter("doc_id is not null").select("text"), "text", "left_anti").select(*[named(c) for c in docs.columns])
    return kept.unionByName(bare.filter(~words)).unionByName(one)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    leaks = written(decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(jaccard.sized(leaks), "doc_id", "left_anti").select(*[named(c) for c in docs.columns])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of documents whose tokens follow the target weights of sources, languages and topics."""
    rows = renamed(docs, ("doc_id", "text", "source", "lang"))
    return mixing.mix(rows).filter("kept").select(*rows.columns).toDF(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in shuffled order, with their shard and their slot in it."""
    return sharding.shuffled(docs, shards=40, seed=1)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
    ("sharding", sharded),
]
#: A trained classifier decides the first stage; SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
