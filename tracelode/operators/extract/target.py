"""Target repositories: Java components and their routes, infrastructure resources, deployment and build files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Resource types of infrastructure languages by logical type, kinds of annotations, ignored folders.
RESOURCES = (
    ("aks", r"Microsoft\.ContainerService/managedClusters|azurerm_kubernetes_cluster"), ("azure_sql", r"Microsoft\.Sql/servers|azurerm_mssql_\w+|azurerm_sql_\w+"), ("blob_storage", r"Microsoft\.Storage/storageAccounts|azurerm_storage_\w+"),
    ("service_bus", r"Microsoft\.ServiceBus/namespaces|azurerm_servicebus_\w+"), ("api_management", r"Microsoft\.ApiManagement/service|azurerm_api_management\w*"), ("key_vault", r"Microsoft\.KeyVault/vaults|azurerm_key_vault\w*"), ("app_insights", r"Microsoft\.Insights/components|azurerm_application_insights"),
)
KINDS = (("RestController", "controller"), ("Controller", "controller"), ("Service", "service"), ("Repository", "repository"), ("Entity", "entity"), ("Configuration", "configuration"), ("KafkaListener", "listener"), ("JmsListener", "listener"), ("Component", "component"))
IGNORED = ("node_modules", ".git", "target", "build", "dist", "out", ".gradle", ".idea", "bin", "obj", ".terraform")
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "CronJob", "Job", "Service", "Ingress", "ConfigMap")


def kept(files: DataFrame) -> DataFrame:
    return files.filter(~F.exists(F.split("path", "/"), lambda p: p.isin(*IGNORED)))


def java(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """components (path, package, name, kind) and apis (path_file, class, method, path) of (path, text)."""
    x = kept(files).filter(F.endswith("path", F.lit(".java")))
    notes = F.regexp_extract_all("text", F.lit(r"@(\w+)"), 1)
    kind = F.lit("class")
    for note, k in reversed(KINDS):
        kind = F.when(F.array_contains(notes, note), k).otherwise(kind)
    name = F.regexp_extract("text", r"\b(?:class|interface|record|enum)\s+(\w+)", 1)
    x = x.withColumn("name", name).filter("length(name) > 0")
    components = x.select("path", F.regexp_extract("text", r"\bpackage\s+([\w.]+)\s*;", 1).alias("package"), "name", kind.alias("kind"))
    root = F.regexp_extract(F.regexp_extract("text", r"(?s)^(.*?)\b(?:class|interface)\s", 1), r'@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?"([^"]*)"', 1)
    body = F.regexp_extract("text", r"(?s)\b(?:class|interface)\s+\w+(.*)$", 1)
    maps = F.regexp_extract_all(body, F.lit(r"@(?:Get|Post|Put|Delete|Patch|Request)Mapping(?:\([^)]*\))?"), 0)
    x = x.select("path", "name", root.alias("root"), F.explode(maps).alias("m"))
    verb = F.upper(F.regexp_extract("m", r"@(\w+)Mapping", 1))
    verb = F.when(verb == "REQUEST", F.when(F.length(F.regexp_extract("m", r"RequestMethod\.(\w+)", 1)) > 0, F.regexp_extract("m", r"RequestMethod\.(\w+)", 1)).otherwise("ANY")).otherwise(verb)
    full = F.regexp_replace(F.concat_ws("/", F.lit(""), "root", F.regexp_extract("m", r'"([^"]*)"', 1)), "/+", "/")
    apis = x.select(F.col("path").alias("file"), F.col("name").alias("class"), verb.alias("method"), F.when(F.length(full) > 1, F.regexp_replace(full, "/$", "")).otherwise("/").alias("path"))
    return components, apis


def infrastructure(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """resources (file, type), deployments (file, kind, name) and builds (file, tool) of (path, text)."""
    x = kept(files)
    hits = F.filter(F.array(*[F.when(F.col("text").rlike(p), t) for t, p in RESOURCES]), lambda t: t.isNotNull())
    resources = x.filter(F.col("path").rlike(r"\.(bicep|tf)$")).select(F.col("path").alias("file"), F.explode(hits).alias("type"))
    docs = x.filter(F.col("path").rlike(r"\.ya?ml$")).select("path", "text")

    def parse(it):
        import yaml

        for pdf in it:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    parsed = [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
                except yaml.YAMLError:
                    parsed = []
                for d in parsed:
                    meta = d.get("metadata") if isinstance(d.get("metadata"), dict) else {}
                    if d.get("kind") in WORKLOADS:
                        out.append((path, str(d["kind"]), str(meta.get("name", ""))))
                    elif "jobs" in d or "stages" in d or "steps" in d:
                        out.append((path, "pipeline", re.split(r"[/\\]", path)[-1]))
            yield pd.DataFrame(out, columns=["file", "kind", "name"])

    deployments = docs.mapInPandas(parse, "file string, kind string, name string")
    deployments = deployments.union(x.filter(F.col("path").rlike(r"(^|/)Dockerfile$")).select("path", F.lit("container"), F.lit("Dockerfile")))
    clusters = deployments.filter(F.col("kind").isin("Deployment", "StatefulSet", "DaemonSet")).select("file", F.lit("aks").alias("type"))
    tool = F.when(F.col("path").rlike(r"(^|/)pom\.xml$"), "maven").when(F.col("path").rlike(r"(^|/)build\.gradle(\.kts)?$"), "gradle")
    builds = x.select(F.col("path").alias("file"), tool.alias("tool")).filter("tool is not null")
    return resources.union(clusters).distinct(), deployments.distinct(), builds


def inventory(files: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a target repository, of files (path, text)."""
    components, apis = java(files)
    resources, deployments, builds = infrastructure(files)
    return {"components": components.distinct(), "apis": apis.distinct(), "resources": resources, "deployments": deployments, "builds": builds}
