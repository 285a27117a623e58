"""Keys of the graph: entity ids, labels, candidate types of endpoints, platforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import normalize_name

# Types whose identity includes the parent, and the platform of each type.
SCOPED = ("step", "field", "subroutine", "control", "paragraph")
PLATFORMS = {
    "batch-mainframe": ("job", "step", "dataset"),
    "cobol-mainframe": ("program", "copybook", "field", "paragraph"),
    "vb6-desktop": ("project", "screen", "control", "subroutine", "class", "module", "component"),
    "database": ("table", "column", "procedure", "sql_script", "stored_procedure"),
}
# Endpoint types to try, in order, by relation and extractor (* is any other).
FROM_TYPES = {
    ("CONTAINS", "*"): ("job", "project", "program"),
    ("CALLS", "*"): ("program", "paragraph"),
    ("CALL", "*"): ("program", "paragraph"),
    ("CALL-DYNAMIC", "*"): ("program", "paragraph"),
    ("DATA_CONTRACT", "*"): ("program", "paragraph"),
    ("CALLS_SP", "*"): ("screen", "class", "module", "subroutine", "program", "procedure"),
    **{(r, "JCL"): ("step",) for r in ("CALLS_PROC", "EXECUTES", "READS", "WRITES", "UPDATES")},
    **{(r, "SQL"): ("procedure", "sql_script") for r in ("CALLS_PROC", "EXECUTES", "READS", "WRITES", "UPDATES")},
    **{(r, "*"): ("program", "paragraph", "procedure") for r in ("CALLS_PROC", "EXECUTES", "READS", "WRITES", "UPDATES")},
    ("INCLUDES", "*"): ("program",),
    **{(r, "*"): ("screen", "class", "module") for r in ("USES", "USES_DLL")},
    **{(r, "*"): ("program", "paragraph", "screen", "class", "module", "subroutine") for r in ("VALIDATES", "ROUTES_TO", "TRANSITIONS_TO", "CHECKPOINTS")},
    ("IMPLEMENTS", "*"): ("class",),
    **{(r, "*"): ("paragraph",) for r in ("PERFORMS", "GO-TO", "IF-BRANCH", "ELSE-BRANCH", "EVAL-WHEN")},
}
TO_TYPES = {
    ("CONTAINS", "*"): ("step", "screen", "class", "module", "paragraph"),
    **{(r, "*"): ("program",) for r in ("CALLS", "CALL", "EXECUTES", "DATA_CONTRACT")},
    ("CALL-DYNAMIC", "*"): ("dynamic_target",),
    **{(r, "*"): ("procedure",) for r in ("CALLS_PROC", "CALLS_SP")},
    ("INCLUDES", "*"): ("copybook",),
    **{(r, "JCL"): ("dataset",) for r in ("READS", "WRITES", "UPDATES")},
    **{(r, "*"): ("table", "dataset") for r in ("READS", "WRITES", "UPDATES")},
    **{(r, "*"): ("component",) for r in ("USES", "USES_DLL")},
    **{(r, "*"): ("field", "column", "control", "dataset", "table", "procedure") for r in ("VALIDATES", "ROUTES_TO", "TRANSITIONS_TO")},
    ("CHECKPOINTS", "*"): ("dataset", "table", "procedure"),
    ("IMPLEMENTS", "*"): ("class",),
    **{(r, "*"): ("paragraph",) for r in ("PERFORMS", "GO-TO", "IF-BRANCH", "ELSE-BRANCH", "EVAL-WHEN")},
}


def file_key(file_hash: Column, path: Column) -> Column:
    """The file's hash, else its last two path segments, else INLINE."""
    tail = F.upper(F.regexp_replace(F.array_join(F.slice(F.reverse(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")), 1, 2), "\u0001"), "[^A-Za-z0-9_.\u0001-]", ""))
    two = F.split(tail, "\u0001")
    named = F.when(F.size(two) > 1, F.concat_ws("_", two[1], two[0])).otherwise(two[0])
    return F.coalesce(F.when(F.length(file_hash) > 0, F.upper(file_hash)), F.when(F.length(named) > 0, named), F.lit("INLINE"))


def entity_id(kind: Column, name: Column, parent: Column, file_hash: Column, path: Column) -> Column:
    kind, name, parent = F.lower(F.trim(kind)), normalize_name(name), normalize_name(parent)
    by_file = F.concat(kind, F.lit(":"), name, F.lit("@"), file_key(file_hash, path))
    return (
        F.when(kind.isin(*SCOPED) & (F.length(parent) > 0), F.concat(kind, F.lit(":"), parent, F.lit("::"), name))
        .when(kind.isin(*SCOPED, "sql_script"), by_file)
        .otherwise(F.concat(kind, F.lit(":"), name))
    )


def entity_label(kind: Column, name: Column, parent: Column) -> Column:
    name, parent = normalize_name(name), normalize_name(parent)
    return F.when(kind.isin(*SCOPED) & (F.length(parent) > 0), F.concat(parent, F.lit("::"), name)).otherwise(name)


def platform(kind: Column) -> Column:
    out = F.lit("legacy")
    for name, kinds in PLATFORMS.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def candidate_types(spark: SparkSession) -> DataFrame:
    """(side, rel, extractor, type, preference): about 120 fixed rows."""
    rows = [(side, rel, ext, kind, k) for side, table in (("from", FROM_TYPES), ("to", TO_TYPES)) for (rel, ext), kinds in table.items() for k, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "side string, rel string, extractor string, type string, preference int")


def inferred_type(rel: Column, side: str, extractor: Column, name: Column) -> Column:
    """The first candidate; a component for names of OCX or DLL files; else a program."""
    table = FROM_TYPES if side == "from" else TO_TYPES
    upper, ext = F.upper(F.trim(rel)), F.upper(F.coalesce(extractor, F.lit("")))
    out = F.when(F.upper(name).rlike(r"\.OCX|\.DLL"), "component").otherwise("program")
    for key, kinds in sorted(table.items(), key=lambda x: x[0][1] != "*"):
        out = F.when((upper == key[0]) & ((ext == key[1]) if key[1] != "*" else F.lit(True)), kinds[0]).otherwise(out)
    return out
