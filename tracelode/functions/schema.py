"""Explicit schemas of files, records, entities and relations."""

from __future__ import annotations

FILES = "path string, name string, ext string, dialect string, role string, size bigint, hash string, mtime string, timestamp string"
OCCURS = "struct<min: int, max: int, depending_on: string>"
FIELDS = "array<struct<name: string, copybook: string, level: int, pic: string, confirmed: boolean>>"
RAW_ENTITY = (
    "type string, name string, parent string, parentType string, file string, line int, confidence double, extractor string, fileHash string, "
    f"level int, pic string, occurs {OCCURS}, controlType string, seq int, description string, description_source string, description_evidence array<string>, semantic_tags array<string>, ordinal bigint"
)
RAW_RELATION = (
    "rel string, `from` string, `to` string, fromType string, toType string, fromParent string, toParent string, file string, line int, confidence double, extractor string, fileHash string, "
    "seq int, dynamic boolean, context string, eventName string, varName string, ordinal bigint"
)
ENTITY = (
    "id string, type string, name string, label string, parent string, parentType string, files array<string>, line int, confidence double, extractor string, fileHash string, inferred boolean, "
    f"level int, pic string, occurs {OCCURS}, controlType string, seq int, description string, description_source string, description_evidence array<string>, semantic_tags array<string>"
)
RELATION = (
    "rel string, `from` string, `to` string, from_id string, to_id string, from_type string, to_type string, from_label string, to_label string, confidence double, evidence array<string>, extractor string, "
    f"dynamic boolean, resolvedFrom string, fields {FIELDS}"
)


def shaped(df, ddl: str):
    """df with exactly the columns of the schema: missing ones are null, others go."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(ddl)])
