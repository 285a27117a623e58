"""Filters that commands and exports share: by type, relation, confidence and origin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_types(entities: DataFrame, *types: str) -> DataFrame:
    return entities.filter(F.col("type").isin(*[t.lower() for t in types])) if types else entities


def of_rels(relations: DataFrame, *rels: str) -> DataFrame:
    return relations.filter(F.col("rel").isin(*[r.upper() for r in rels])) if rels else relations


def confident(df: DataFrame, least: float) -> DataFrame:
    """Rows with at least this confidence; none counts as 0."""
    return df.filter(F.coalesce("confidence", F.lit(0.0)) >= least)


def without_inferred(entities: DataFrame) -> DataFrame:
    return entities.filter(~F.coalesce("inferred", F.lit(False)))
