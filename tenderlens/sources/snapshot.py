"""Snapshot interchange: one set of JSON lines for each node label and relation type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Personal fields of officials, left out unless asked for.
PRIVATE = {"Authorizer": ("document_type", "document_number")}


def read_nodes(spark: SparkSession, path: str, label: str, properties: str) -> DataFrame:
    """``id`` and the properties (a DDL string) of the nodes of a label; nothing is inferred."""
    rows = spark.read.schema(f"id string, label string, properties struct<{properties}>").json(f"{path}/nodes_{label}.jsonl")
    return rows.filter(F.col("label") == label).select("id", "properties.*")


def read_relations(spark: SparkSession, path: str, kind: str, properties: str = "seq: long") -> DataFrame:
    rows = spark.read.schema(f"start string, end string, type string, properties struct<{properties}>").json(f"{path}/rels_{kind}.jsonl")
    return rows.filter(F.col("type") == kind).select("start", "end", "properties.*")


def node_rows(df: DataFrame, label: str, key: str, keep_documents: bool = False) -> DataFrame:
    """(id, label, properties) of an entity table, redacted; nulls are absent from the JSON."""
    hidden = () if keep_documents else PRIVATE.get(label, ())
    props = [c for c in df.columns if c not in hidden]
    return df.select(F.concat(F.lit(f"{label}:"), F.col(key).cast("string")).alias("id"), F.lit(label).alias("label"), F.struct(*props).alias("properties"))


def write_snapshot(nodes: dict[str, tuple[DataFrame, str]], relations: dict[str, DataFrame], path: str, keep_documents: bool = False) -> DataFrame:
    """Write each label (table, key) and relation (start, end and properties); returns the manifest (kind, name,
    rows).  Labels without rows get no files."""
    parts = None
    for label, (df, key) in nodes.items():
        rows = node_rows(df, label, key, keep_documents)
        if rows.limit(1).count():
            rows.write.mode("overwrite").json(f"{path}/nodes_{label}.jsonl")
            n = df.agg(F.count("*").alias("rows")).select(F.lit("node").alias("kind"), F.lit(label).alias("name"), "rows")
            parts = n if parts is None else parts.unionByName(n)
    for kind, df in relations.items():
        if df.limit(1).count():
            props = [c for c in df.columns if c not in ("start", "end")]
            extra = [F.struct(*props).alias("properties")] if props else []
            df.select("start", "end", F.lit(kind).alias("type"), *extra).write.mode("overwrite").json(f"{path}/rels_{kind}.jsonl")
            n = df.agg(F.count("*").alias("rows")).select(F.lit("relation").alias("kind"), F.lit(kind).alias("name"), "rows")
            parts = n if parts is None else parts.unionByName(n)
    return parts
