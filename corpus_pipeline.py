"""A training corpus in five stages, each of them one of the corpus operators over what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Stages work on all rows and whole texts; null texts and repeated rows are handled as the
operators say, extra columns are kept, and columns that a stage adds for its own use begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import decontaminate, line_dedup, mixing, near_join, quality_rules
from tenderlens.plans.staging import materialize, small


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the policy rejects go."""
    return quality_rules.passing(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly equal an earlier line go, and documents that had no other.  A column ``n_chars``
    follows the text."""
    out = line_dedup.without_repeated_lines(docs, count="__removed")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.filter((F.col("__removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that links of similarity 0.8 or more connect, the one with the least id stays (a null
    id comes last).  Rows are told apart by id and text, so rows that share an id, or have none, are
    documents of their own; rows equal in both count once."""
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = near_join.near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "class_id")
    found = materialize(found.groupBy("__key").agg(F.min("class_id").alias("class_id"), F.count("*").alias("__n")), "near")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("first")
    stay = keyed.select("doc_id", "__key").join(found, "__key").groupBy("class_id").agg(first, F.max("__n").alias("__n"))
    stay = materialize(stay.select(F.col("first.__key").alias("__key"), "__n"), "stay")
    out = keyed.join(small(stay), "__key")
    if stay.filter("__n > 1").limit(1).count():
        out = out.filter("__n = 1").unionByName(out.filter("__n > 1").dropDuplicates(["__key"]))
    return out.select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the curriculum takes of each document, range-sorted by training position."""
    return mixing.training_order(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard_join", near_copies), ("decontamination", leaks), ("mixing", mix)]

#: Edit distances, latent cosines and Jaccard links over all pairs are out of SQL's reach; tests compare
#: the run with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs
