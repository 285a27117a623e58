"""Extractors: lines of source files become raw entities and relations.

Each takes lines (path, hash, name, line, code) of its dialect and returns two DataFrames in the
schemas of raw records. State along a file (current program, step, block) is a window over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ...functions import schema


def records(entities: DataFrame | None, relations: DataFrame | None, spark) -> tuple[DataFrame, DataFrame]:
    """Both in the schemas of raw records; None is empty."""
    e = entities if entities is not None else spark.createDataFrame([], schema.RAW_ENTITY)
    r = relations if relations is not None else spark.createDataFrame([], schema.RAW_RELATION)
    return schema.shaped(e, schema.RAW_ENTITY), schema.shaped(r, schema.RAW_RELATION)


def extract(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw records of classified lines (dialect, path, hash, name, line, code), by the registry of dialects."""
    e = r = None
    for dialect, f in registry().items():
        a, b = f(lines.filter(lines["dialect"] == dialect).drop("dialect"))
        e, r = (a, b) if e is None else (e.unionByName(a), r.unionByName(b))
    return e, r


def registry() -> dict:
    """Extractor of each dialect; add one here to support another."""
    from . import cobol, copybook, jcl, messaging, sql, vb6

    return {"cobol": cobol.extract, "copybook": copybook.extract, "jcl": jcl.extract, "sql": sql.extract, "vb6": vb6.extract, "messaging": messaging.extract}
