"""Findings to entity scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlens.operators import groups  # noqa: F401  registers the group checks
from tenderlens.operators.checks import REGISTRY
from tenderlens.plans.tables import Config

# Flags that together say more than their sum, and by how much.
SYNDROMES = (
    ("Cartel: rotation + shared ownership", ("bid_rotation_ring", "shared_contact_cluster"), 1.6),
    ("Cartel: rotation confirmed by community structure", ("bid_rotation_ring", "cobid_community"), 1.25),
    ("Shell competition: fake competition + shared contacts", ("fake_competition", "shared_contact_cluster"), 1.45),
    ("Cover bidding around a serial winner", ("serial_winner", "cover_bidding"), 1.4),
    ("Insider channel: dominance + authorizer/unit triad", ("serial_winner", "authorizer_provider_ring"), 1.5),
    ("Insider proxy: cross-agency win + shared contacts", ("cross_agency_proxy", "shared_contact_cluster"), 1.4),
)
NAMESPACES = ("provider", "unit", "authorizer")


def attribute(findings: DataFrame, key: str, namespace: str | None = None) -> DataFrame:
    """(entity_type, id, name, check, finding): a row for each entity that a finding counts for; null or empty
    ids are skipped."""
    rows = findings.withColumn("__f", F.to_json(F.struct(*findings.columns)))
    parts = []
    for kind, id_col, name_col in REGISTRY[key].entities:
        if namespace in (None, kind):
            name = F.col(name_col) if name_col else F.col(id_col)
            parts.append(rows.select(F.lit(kind).alias("entity_type"), F.col(id_col).cast("string").alias("id"), name.alias("name"), F.lit(key).alias("check"), F.col("__f").alias("finding")))
    if not parts:
        parts = [rows.select(F.lit("").alias("entity_type"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.lit(key).alias("check"), F.col("__f").alias("finding")).limit(0)]
    return reduce(DataFrame.unionByName, parts).filter("id is not null and id <> ''")


def attributed(findings: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [attribute(df, key) for key, df in findings.items()])


def intensity(count: Column) -> Column:
    """1 finding about 0.29, 10 or more 1."""
    return F.when(count > 0, F.least(F.lit(1.0), F.log2(count + 1) / F.log2(F.lit(11)))).otherwise(0.0)


def syndromes(flags: Column) -> Column:
    """The syndromes all of whose flags are there."""
    every = F.array(*(F.struct(F.lit(label).alias("label"), F.array(*(F.lit(k) for k in keys)).alias("keys"), F.lit(m).alias("multiplier")) for label, keys, m in SYNDROMES))
    return F.filter(every, lambda s: F.size(F.array_except(s["keys"], flags)) == 0)


def syndrome_multiplier(flags: Column) -> Column:
    """The greatest multiplier of a complete syndrome, else 1; they do not stack."""
    return F.aggregate(syndromes(flags), F.lit(1.0), lambda m, s: F.greatest(m, s["multiplier"]))


def weights(cfg: Config) -> dict[str, int]:
    return {k: cfg.weights.get(k, c.weight) for k, c in REGISTRY.items()}


def entity_scores(rows: DataFrame, cfg: Config, features: DataFrame | None = None) -> DataFrame:
    """(entity_type, id, name, score, base_score, confidence, flags, evidence) from attributed findings.

    A check counts its weight by the intensity of its findings; checks of weight 0 neither score nor flag.
    Only providers have syndromes.  ``features`` (provider_cuit, ...) are recorded and change no score.
    """
    per = rows.groupBy("entity_type", "id", "check").agg(F.count("*").alias("count"), F.min("name").alias("name"))
    w = F.create_map(*[x for k, v in weights(cfg).items() for x in (F.lit(k), F.lit(v))])
    per = per.withColumn("weight", F.coalesce(w[F.col("check")], F.lit(0)))
    inten = intensity(F.col("count"))
    per = per.withColumn("intensity", F.bround(inten, 3)).withColumn("raw", F.col("weight") * inten).withColumn("contribution", F.bround(F.col("weight") * inten, 2))
    scored = F.col("weight") != 0
    out = per.groupBy("entity_type", "id").agg(
        F.min("name").alias("name"),
        F.array_sort(F.collect_list(F.when(scored, F.col("raw")))).alias("raws"),
        F.array_sort(F.collect_list(F.when(scored, F.col("check")))).alias("flags"),
        F.array_sort(F.collect_list(F.when(scored, F.struct((-F.col("contribution")).alias("order"), "check", "count", "weight", "intensity", "contribution")))).alias("checks"),
    )
    base = F.aggregate("raws", F.lit(0.0), lambda a, x: a + x)  # in the order of size: the same sum everywhere
    mult = F.when(F.col("entity_type") == "provider", syndrome_multiplier(F.col("flags"))).otherwise(1.0)
    found = F.when(F.col("entity_type") == "provider", syndromes(F.col("flags"))).otherwise(F.filter(syndromes(F.col("flags")), lambda s: F.lit(False)))
    out = out.withColumn("base", base).withColumn("multiplier", mult).withColumn("synergies", found)
    evidence = F.struct(F.transform("checks", lambda c: c.dropFields("order")).alias("checks"), "synergies", "multiplier")
    out = out.select(
        "entity_type", "id", "name", F.least(F.bround(F.col("base") * F.col("multiplier")), F.lit(100)).cast("int").alias("score"), F.least(F.bround("base"), F.lit(100)).cast("int").alias("base_score"),
        F.size("flags").alias("confidence"), "flags", evidence.alias("evidence"),
    )
    if features is not None:
        cols = [c for c in features.columns if c != "provider_cuit"]
        f = features.select(F.col("provider_cuit").alias("id"), F.lit("provider").alias("entity_type"), F.struct(*cols).alias("features"))
        out = out.join(f, ["entity_type", "id"], "left")
    return out


def all_scores(findings: dict[str, DataFrame], cfg: Config, features: DataFrame | None = None) -> DataFrame:
    return entity_scores(attributed(findings), cfg, features)
