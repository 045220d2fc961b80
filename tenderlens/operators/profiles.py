"""Profiles, rankings and searches over findings, scores and tables, written for sets of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.operators.checks import REGISTRY
from tenderlens.operators.scoring import weights
from tenderlens.plans.tables import Config, Tables, process_window

#: Columns that a search over findings looks into.
SEARCHED = ("provider_cuit", "provider_name", "unit_code", "unit_name", "authorizer", "process_number", "process")


def company_profiles(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, score, findings): the distinct findings of each provider by check, and its score."""
    own = rows.filter("entity_type = 'provider'").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("check", "finding"))).alias("findings"))
    return own.join(scores.filter("entity_type = 'provider'").select("id", "score"), "id", "full")


def entity_profiles(rows: DataFrame, namespace: str) -> DataFrame:
    """(id, name, total_tenders, n_findings, findings) of a namespace: the first real name, the greatest total."""
    real = F.when(F.col("name").isNotNull() & (F.col("name") != "—"), F.col("name"))
    total = F.coalesce(F.get_json_object("finding", "$.total_tenders"), F.get_json_object("finding", "$.total_awarded_in_unit")).cast("long")
    own = rows.filter(F.col("entity_type") == namespace)
    return own.groupBy("id").agg(F.coalesce(F.min(real), F.lit("—")).alias("name"), F.coalesce(F.max(total), F.lit(0)).alias("total_tenders"), F.count("*").alias("n_findings"), F.array_sort(F.collect_set(F.struct("check", "finding"))).alias("findings"))


def rank_entities(rows: DataFrame, scores: DataFrame, cfg: Config, namespace: str) -> DataFrame:
    """(id, risk_score, confidence, has_synergy, check_counts): the score, or else the sum of the weights of the
    checks that hit."""
    w = F.create_map(*[x for k, v in weights(cfg).items() for x in (F.lit(k), F.lit(v))])
    per = rows.filter(F.col("entity_type") == namespace).groupBy("id", "check").agg(F.count("*").alias("n"))
    own = per.groupBy("id").agg(F.sum(F.coalesce(w[F.col("check")], F.lit(0))).alias("fallback"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("check", "n")))).alias("check_counts"))
    s = scores.filter(F.col("entity_type") == namespace).select("id", "score", "confidence", (F.col("evidence.multiplier") > 1).alias("syn"))
    out = own.join(s, "id", "left")
    return out.select("id", F.coalesce("score", "fallback").cast("int").alias("risk_score"), F.coalesce("confidence", F.lit(0)).alias("confidence"), F.coalesce("syn", F.lit(False)).alias("has_synergy"), "check_counts").orderBy(F.desc("risk_score"), "id")


def risk_breakdown(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """(entity_type, id, score, syndromes, evidence) of the ids asked for."""
    return scores.join(ids.select("id").distinct(), "id", "left_semi").select("entity_type", "id", "score", F.transform("evidence.synergies", lambda s: s["label"]).alias("syndromes"), "evidence")


def dashboard_stats(rows: DataFrame, scores: DataFrame, findings: dict[str, DataFrame]) -> DataFrame:
    """(section, label, value): totals, five score buckets, the top ten, findings by check, and the fifteen most
    frequent flags."""
    bucket = F.when(F.col("score") >= 80, 4).otherwise(F.floor(F.col("score") / 20)).cast("int")
    names = F.array(*(F.lit(x) for x in ("0-20", "21-40", "41-60", "61-80", "81-100")))
    scored = scores.filter("entity_type = 'provider'")
    buckets = scored.groupBy(F.element_at(names, bucket + 1).alias("label")).agg(F.count("*").alias("value")).select(F.lit("bucket").alias("section"), "label", "value")
    top = scored.orderBy(F.desc("score"), "id").limit(10).select(F.lit("top").alias("section"), F.col("id").alias("label"), F.col("score").cast("long").alias("value"))
    per = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("value")).select(F.lit("check").alias("section"), F.lit(k).alias("label"), "value") for k, df in findings.items()])
    flags = scored.select(F.explode("flags").alias("label")).groupBy("label").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "label").limit(15).select(F.lit("flag").alias("section"), "label", "value")
    totals = scored.agg(F.count("*").alias("value")).select(F.lit("total").alias("section"), F.lit("entities").alias("label"), "value")
    units = rows.filter("entity_type = 'unit'").agg(F.count_distinct("id").alias("value")).select(F.lit("total").alias("section"), F.lit("units").alias("label"), "value")
    return reduce(DataFrame.unionByName, [buckets, top, per, flags, totals, units])


def search_scores(scores: DataFrame, text: str | None = None, least: int | None = None, most: int | None = None, flag: str | None = None, page: int = 1, size: int = 50) -> DataFrame:
    """A page of scores, highest first: by a part of id or name, a range, and a flag.  Pages start at 1."""
    out = scores
    if text:
        out = out.filter(F.contains(F.lower("id"), F.lit(text.lower())) | F.contains(F.lower("name"), F.lit(text.lower())))
    if least is not None:
        out = out.filter(F.col("score") >= least)
    if most is not None:
        out = out.filter(F.col("score") <= most)
    if flag:
        out = out.filter(F.array_contains("flags", flag))
    return out.orderBy(F.desc_nulls_last("score"), "entity_type", "id").offset((max(1, page) - 1) * size).limit(size)


def distinct_flags(scores: DataFrame) -> DataFrame:
    return scores.select(F.explode("flags").alias("flag")).distinct()


def search_findings(findings: DataFrame, text: str) -> DataFrame:
    """Findings in which a searched column holds the text, whatever its case."""
    cols = [c for c in SEARCHED if c in findings.columns]
    hit = reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in cols])
    return findings.filter(hit)


def trim_findings(rows: DataFrame, n: int) -> DataFrame:
    """(entity_type, id, check, total, finding): the first ``n`` findings of each entity and check, and how many
    there are.  An entity with very many is counted before the shuffle; the first are found by a window that
    Spark limits per group before it shuffles."""
    total = rows.groupBy("entity_type", "id", "check").agg(F.count("*").alias("total"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("entity_type", "id", "check").orderBy("finding"))).filter(F.col("k") <= n)
    return first.join(total, ["entity_type", "id", "check"]).select("entity_type", "id", "check", "total", "finding")


def search_processes(t: Tables, cfg: Config, text: str | None = None, cuits: DataFrame | None = None, units: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """(process_number, opening, unit_code, winners, n_bids): newest first, undated last."""
    p = process_window(t.process, cfg).withColumn("opening", F.coalesce("opening_date", "scheduled_date"))
    if text:
        p = p.filter(F.contains(F.lower("process_number"), F.lit(text.lower())) | F.contains(F.lower("descriptive_name"), F.lit(text.lower())))
    if units is not None:
        p = p.join(units.select(F.col("code").alias("unit_code")).distinct(), "unit_code", "left_semi")
    if cuits is not None:
        p = p.join(t.bid.join(cuits.select(F.col("cuit").alias("provider_cuit")), "provider_cuit", "left_semi").select("process_number").distinct(), "process_number", "left_semi")
    p = p.orderBy(F.desc_nulls_last("opening"), "process_number").limit(limit)
    won = t.contract.join(p.select("process_number"), "process_number", "left_semi").groupBy("process_number").agg(F.array_sort(F.collect_set("provider_cuit")).alias("winners"))
    bids = t.bid.join(p.select("process_number"), "process_number", "left_semi").groupBy("process_number").agg(F.count("*").alias("n_bids"))
    out = p.select("process_number", "opening", "unit_code").join(won, "process_number", "left").join(bids, "process_number", "left").fillna(0, ["n_bids"])
    return out.orderBy(F.desc_nulls_last("opening"), "process_number")


def opinions_of(t: Tables, numbers: DataFrame) -> DataFrame:
    """(process_number, opinions): opinions on the bids of a process in sequence, each with whom it would award,
    whom it rejects for what, and who signed.  Built from the leaves up, each level a sum by its own key."""
    n, key = numbers.select("process_number").distinct(), ["process_number", "source", "sequence"]
    names = t.provider.select(F.col("cuit").alias("provider_cuit"), F.col("business_name").alias("name"))
    own = lambda df: df.join(n, "process_number", "left_semi")
    listed = lambda df, item, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias(name))
    awards = listed(own(t.pre_award).join(names, "provider_cuit", "left"), ["merit_order", "provider_cuit", "name", "is_primary"], "pre_adjudicated")
    reasons = own(t.rejection).groupBy(*key, "provider_cuit").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    rejected = listed(reasons.join(names, "provider_cuit", "left"), ["provider_cuit", "name", "reasons"], "rejected")
    signers = listed(own(t.opinion_signer), ["username", "role"], "signers")
    out = own(t.opinion)
    for part, name in ((awards, "pre_adjudicated"), (rejected, "rejected"), (signers, "signers")):
        out = out.join(part, key, "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    item = ["sequence", "source", "issue_date", "pre_award_total", "currency", "pre_adjudicated", "rejected", "signers"]
    return out.groupBy("process_number").agg(F.array_sort(F.collect_list(F.struct(*item))).alias("opinions"))


def process_detail(t: Tables, numbers: DataFrame) -> DataFrame:
    """(process_number, bids, contracts, opinions, n_lines): bids by amount, contracts with who signed them, and
    the opinions, if there is a table of them."""
    n = numbers.select("process_number").distinct()
    bids = t.bid.join(n, "process_number", "left_semi").groupBy("process_number").agg(F.array_sort(F.collect_list(F.struct(F.col("total_amount").alias("amount"), "provider_cuit", "currency"))).alias("bids"))
    signed = t.authorized_by.groupBy("document_number", "source").agg(F.array_sort(F.collect_set("authorizer")).alias("authorizers"))
    docs = t.contract.join(n, "process_number", "left_semi").join(signed, ["document_number", "source"], "left").groupBy("process_number").agg(F.array_sort(F.collect_list(F.struct("document_number", "provider_cuit", "total_amount", "authorizers"))).alias("contracts"))
    lines = t.bid_line.join(n, "process_number", "left_semi").groupBy("process_number").agg(F.count("*").alias("n_lines"))
    out = n.join(bids, "process_number", "left").join(docs, "process_number", "left").join(lines, "process_number", "left").fillna(0, ["n_lines"])
    return out if t.opinion is None else out.join(opinions_of(t, n), "process_number", "left")


def findings_for_process(findings: dict[str, DataFrame], numbers: DataFrame) -> DataFrame:
    """(process_number, check, finding): findings whose process column is, or whose list holds, a number."""
    parts = []
    for key, df in findings.items():
        whole = F.to_json(F.struct(*df.columns)).alias("finding")
        for c in ("process_number", "process"):
            if c in df.columns:
                parts.append(df.select(F.col(c).alias("process_number"), F.lit(key).alias("check"), whole))
        if "processes" in df.columns:
            parts.append(df.select(F.explode("processes.process_number").alias("process_number"), F.lit(key).alias("check"), whole))
    return reduce(DataFrame.unionByName, parts).join(numbers.select("process_number").distinct(), "process_number", "left_semi")


def detection_status(findings: dict[str, DataFrame], scores: DataFrame) -> DataFrame:
    """(kind, name, n): findings by check, scored entities by namespace."""
    per = [df.agg(F.count("*").alias("n")).select(F.lit("check").alias("kind"), F.lit(k).alias("name"), "n") for k, df in findings.items()]
    return reduce(DataFrame.unionByName, [*per, scores.groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("scored").alias("kind"), "name", "n")])


def check_catalogue(spark) -> DataFrame:
    """(key, weight, thresholds, entities) of the registered checks."""
    rows = [(c.key, c.weight, {k: float(v) for k, v in c.thresholds.items()}, sorted({e[0] for e in c.entities})) for c in REGISTRY.values()]
    return spark.createDataFrame(rows, "key string, weight int, thresholds map<string,double>, entities array<string>")


def graph_counts(t: Tables) -> DataFrame:
    """(kind, name, n): rows of each entity table and of the edges that its keys stand for."""
    nodes = {"Process": t.process, "ContractingUnit": t.unit, "Provider": t.provider, "Bid": t.bid, "BidLine": t.bid_line, "ContractualDocument": t.contract}
    edges = {"HAS_BID": t.bid, "AWARDED_TO": t.contract, "AUTHORIZED_BY": t.authorized_by, "MANAGED_BY": t.process.filter("unit_code is not null")}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), F.lit(name).alias("name"), "n") for k, d in (("node", nodes), ("edge", edges)) for name, df in d.items()]
    return reduce(DataFrame.unionByName, parts)


def top_awardees(t: Tables, n: int = 20) -> DataFrame:
    """(provider_cuit, contracts, amount): who was awarded most."""
    per = t.contract.groupBy("provider_cuit").agg(F.count("*").alias("contracts"), F.round(F.sum(F.col("total_amount").cast("decimal(38,4)")), 2).cast("double").alias("amount"))
    return per.orderBy(F.desc("amount"), "provider_cuit").limit(n)


def processes_without_bids(t: Tables) -> DataFrame:
    return t.process.join(t.bid.select("process_number"), "process_number", "left_anti").select("process_number", "source", "unit_code")


def buyer_chain(t: Tables) -> DataFrame:
    """(unit_code, provider_cuit, processes, contracts): the chain from buyer to supplier."""
    rows = t.contract.join(t.process.select("process_number", "unit_code"), "process_number")
    return rows.groupBy("unit_code", "provider_cuit").agg(F.count_distinct("process_number").alias("processes"), F.count("*").alias("contracts"))
