"""Upserts and joins that bring landed records into the entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.functions.normalize import contact_key, name_key


def last_non_null(c: str, seq: str) -> Column:
    """The value of the latest row that has one; equal sequence numbers go to the greater value."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(seq, c)))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Merge by key, property by property: the last non-null wins and null never overwrites.  ``updates``
    has a load sequence; ``target`` counts as older than all of it.  One shuffle with partial sums, so a
    key with very many updates is folded before it."""
    old = target.withColumn(seq, F.lit(None).cast(updates.schema[seq].dataType))
    both = old.unionByName(updates, allowMissingColumns=True).withColumn("__at", F.coalesce(F.col(seq).cast("long"), F.lit(-(2**62))))
    cols = [c for c in both.columns if c not in (*keys, seq, "__at")]
    return both.groupBy(*keys).agg(*(last_non_null(c, "__at").alias(c) for c in cols))


def upsert_edges(edges: DataFrame, left: tuple[DataFrame, str, str], right: tuple[DataFrame, str, str], keys: list[str], seq: str = "seq") -> DataFrame:
    """Edges whose two ends exist, one for each key, properties overlaid.  ``left`` and ``right`` are (nodes,
    node key, edge column).  Null key parts count as -1, so that a missing line number is a key of its own."""
    for nodes, key, column in (left, right):
        ends = nodes.select(F.col(key).alias(column)).distinct()
        edges = edges.join(ends, column, "left_semi")
    for k in keys:
        edges = edges.withColumn(k, F.coalesce(F.col(k), F.lit(-1).cast(edges.schema[k].dataType)))
    cols = [c for c in edges.columns if c not in (*keys, seq)]
    if not cols:
        return edges.select(*keys).distinct()
    return edges.groupBy(*keys).agg(*(last_non_null(c, seq).alias(c) for c in cols))


def collision_guard(existing: DataFrame, incoming: DataFrame, key: str = "process_number") -> tuple[DataFrame, DataFrame]:
    """(clean, rejects): incoming rows whose key is stored under another source are rejected."""
    stored = existing.select(key, F.col("source").alias("stored_source")).filter("stored_source is not null").distinct()
    marked = incoming.join(stored, key, "left").withColumn("__bad", F.coalesce(F.col("stored_source") != F.col("source"), F.lit(False)))
    return marked.filter("not __bad").drop("stored_source", "__bad"), marked.filter("__bad").drop("__bad")


def merge_first_non_null(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the first non-null of each field, in the order of a column."""
    cols = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in cols))


def coalesce_buyer(process: DataFrame, documents: DataFrame) -> DataFrame:
    """The buyer code on a contract page wins over the process page's.  With an organisation code the buyer's
    contact belongs to the organisation, else to the unit (``buyer_kind``)."""
    page = documents.groupBy("process_number").agg(F.min_by("buyer_code", F.when(F.col("buyer_code").isNotNull(), F.col("document_number"))).alias("doc_code"), F.max("is_open_order").alias("open_order"))
    out = process.join(page, "process_number", "left").withColumn("buyer_code", F.coalesce("doc_code", "buyer_code"))
    return out.withColumn("buyer_kind", F.when(F.col("open_order"), "organization").otherwise("unit")).drop("doc_code", "open_order")


def overlay_contract_summary(documents: DataFrame, summary: DataFrame) -> DataFrame:
    """Status and currency of the summary table overwrite the document's where present."""
    s = summary.select("document_number", F.col("status").alias("__s"), F.col("currency").alias("__c"))
    out = documents.join(s, "document_number", "left")
    return out.withColumn("status", F.coalesce("__s", "status")).withColumn("currency", F.coalesce("__c", "currency")).drop("__s", "__c")


def resolve_provider_by_name(rows: DataFrame, providers: DataFrame, keep_unresolved: bool = False) -> DataFrame:
    """Adds ``provider_cuit`` by name within a process; of equal names the first (``position``) wins.  An id
    that a row has is preferred; rows that find none are dropped unless kept."""
    first = providers.withColumn("__key", name_key(F.col("business_name"))).filter("__key <> ''").groupBy("process_number", "__key").agg(F.min_by("cuit", "position").alias("__cuit"))
    out = rows.withColumn("__key", name_key(F.col("name"))).join(first, ["process_number", "__key"], "left")
    own = F.col("provider_cuit") if "provider_cuit" in rows.columns else F.lit(None).cast("string")
    out = out.withColumn("provider_cuit", F.coalesce(own, F.col("__cuit"))).drop("__key", "__cuit")
    return out if keep_unresolved else out.filter("provider_cuit is not null")


def contact_edges(entities: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, contact_type, value_key, value): addresses, phones and emails by normalised key; the value shown
    is the first seen of its key."""
    long = entities.selectExpr(key, seq, "stack(3, 'Address', address, 'Phone', phone, 'Email', email) as (contact_type, value)").filter("trim(value) <> ''")
    long = long.withColumn("value_key", contact_key(F.col("contact_type"), F.col("value")))
    shown = long.groupBy("contact_type", "value_key").agg(F.min_by("value", F.struct(seq, "value")).alias("value"))
    return long.select(key, "contact_type", "value_key").distinct().join(shown, ["contact_type", "value_key"]).select(key, "contact_type", "value_key", "value")


def pending(worklist: DataFrame, done: DataFrame) -> DataFrame:
    """Lines of a worklist (column ``value``) still to do: byte-order marks, blank lines and // comments go."""
    line = F.trim(F.regexp_replace("value", "^\\uFEFF", ""))
    todo = worklist.select(line.alias("process_number")).filter("process_number <> '' and not startswith(process_number, '//')").distinct()
    return todo.join(done.select("process_number"), "process_number", "left_anti")


def open_processes(process: DataFrame, months: int, source: str, today: Column) -> DataFrame:
    """Processes of a portal whose opening, or else its plan, is not older than so many months."""
    return process.filter(F.col("source") == source).filter(F.coalesce("opening_date", "scheduled_date") >= F.add_months(today, -months))


def build_price_index(official: DataFrame, variation: DataFrame, base: str = "2016-12-01", level: float = 100.0) -> DataFrame:
    """(series_id, period, index_value): the official index, and before its base month a level chained back
    from monthly variation, which ends at the first gap.  Months are few (twelve a year), and the chain
    is one window over them."""
    base_day = F.lit(base).cast("date")
    back = variation.filter(F.col("period") <= base_day).select("period", "pct")
    w = Window.orderBy(F.desc("period"))
    step = F.months_between(F.lag("period").over(w), F.col("period"))
    run = back.withColumn("gap", F.when(F.lag("period").over(w).isNull(), F.col("period") != base_day).otherwise(step != 1).cast("int"))
    run = run.withColumn("gaps", F.sum("gap").over(w)).filter("gaps = 0").withColumn("f", F.sum(F.log1p(F.col("pct") / 100)).over(w))
    chained = run.select(F.lit("chained").alias("series_id"), F.add_months("period", -1).alias("period"), F.round(F.lit(level) * F.exp(-F.col("f")), 6).alias("index_value"))
    return chained.unionByName(official.select(F.lit("official").alias("series_id"), "period", F.col("index_value").cast("double").alias("index_value")))


def indicator_refresh_window(price_index: DataFrame, fx_rate: DataFrame, lookback: int = 40) -> DataFrame:
    """One row, ``since``: from where indicators are loaded again, before the older of the two latest dates."""
    a, b = price_index.agg(F.max("period").alias("a")), fx_rate.agg(F.max("observed_date").alias("b"))
    return a.crossJoin(b).select(F.date_sub(F.least("a", "b"), lookback).alias("since"))
