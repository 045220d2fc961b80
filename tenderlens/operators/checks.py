"""Red-flag checks: functions from tables and settings to findings.

``@check`` registers a check with its key, weight, default thresholds and the entities that a finding
counts for: (entity type, id column, name column).  A user adds a check the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.operators import valuation as val
from tenderlens.plans.staging import materialize, small
from tenderlens.plans.tables import Config, Tables, cents, name_or_dash, process_window, top_n


@dataclass(frozen=True)
class Check:
    key: str
    weight: int
    thresholds: dict[str, float]
    entities: tuple[tuple[str, str, str | None], ...]
    run: Callable[[Tables, Config], DataFrame]


REGISTRY: dict[str, Check] = {}

PROVIDER = ("provider", "provider_cuit", "provider_name")
UNIT = ("unit", "unit_code", "unit_name")
AUTHORIZER = ("authorizer", "authorizer", None)


def check(key: str, weight: int, thresholds: dict[str, float], entities: tuple):
    def wrap(fn: Callable[[Tables, Config], DataFrame]):
        REGISTRY[key] = Check(key, weight, thresholds, entities, fn)
        return fn

    return wrap


def _limit(cfg: Config, key: str) -> Callable[[str], float]:
    defaults = REGISTRY[key].thresholds
    return lambda name: cfg.get(name, defaults[name])


def pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(100.0 * part / whole, digits)


def _provider_names(t: Tables) -> DataFrame:
    return t.provider.select(F.col("cuit").alias("provider_cuit"), name_or_dash(F.col("business_name")).alias("provider_name"))


def _unit_names(t: Tables) -> DataFrame:
    return t.unit.groupBy(F.col("code").alias("unit_code")).agg(F.min("name").alias("unit_name"))


def paid(t: Tables, cfg: Config) -> DataFrame:
    """Contracts of value in the window, with their real value."""
    return process_window(val.valued_contracts(t), cfg).filter("total_amount > 0")


def signed_contracts(t: Tables) -> DataFrame:
    """Valued contracts, a row for each official who signed one."""
    if "signed_contracts" in t.shared:
        return t.shared["signed_contracts"]
    signed = t.authorized_by.select("document_number", "source", "authorizer").distinct()
    docs = val.valued_contracts(t).select("document_number", "source", "provider_cuit", "unit_code", "opening_date", "total_amount", "real_ars")
    return docs.join(signed, ["document_number", "source"])


def _documents(t: Tables, key: Column) -> Column:
    """How many documents there are, by a key that holds the number; rows, where each document is known to have one."""
    return F.count(key) if t.single_documents else F.count_distinct(key)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


@check("serial_winner", 20, {"serial_winner_min_bids": 5, "serial_winner_pct": 60.0}, (PROVIDER,))
def serial_winner(t: Tables, cfg: Config) -> DataFrame:
    """Providers that win most of what they bid for, with what they won by currency."""
    of = _limit(cfg, "serial_winner")
    dated = process_window(t.process, cfg).select("process_number")
    bids = t.bid.join(dated, "process_number").groupBy("provider_cuit").agg(F.count_distinct("process_number").alias("total_bids"))
    won = process_window(val.valued_contracts(t), cfg)
    wins = won.groupBy("provider_cuit").agg(F.count_distinct("process_number").alias("total_wins"))
    money = won.filter("total_amount > 0").groupBy("provider_cuit", "currency").agg(F.sum(F.col("total_amount").cast("decimal(38,4)")).alias("amount"), F.sum("real_ars").alias("real"))
    money = money.groupBy("provider_cuit").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("currency", F.lit("ARS")).alias("currency"), cents(F.col("amount")).alias("amount")))).alias("total_won"), cents(_zero(F.sum("real"))).alias("total_real_ars")
    )
    out = bids.join(wins, "provider_cuit").withColumn("win_pct", pct(F.col("total_wins"), F.col("total_bids")))
    out = out.filter((F.col("total_bids") >= of("serial_winner_min_bids")) & (F.col("win_pct") >= of("serial_winner_pct"))).join(money, "provider_cuit").join(_provider_names(t), "provider_cuit")
    out = val.with_usd(out, t.fx_rate, "total_real_ars", "total_real_usd")
    out = out.select("provider_cuit", "provider_name", "total_bids", "total_wins", "win_pct", "total_won", "total_real_ars", "total_real_usd")
    return top_n(out, [F.desc("win_pct"), F.desc("total_wins"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("authorizer_bias", 30, {"bias_min_contracts": 5, "bias_min_amount": 10_000_000, "bias_pct": 40.0}, (PROVIDER, AUTHORIZER))
def authorizer_bias(t: Tables, cfg: Config) -> DataFrame:
    """Officials who sign an outsized share of their documents for one provider."""
    of = _limit(cfg, "authorizer_bias")
    each = process_window(signed_contracts(t), cfg)
    key = F.struct("document_number", "source")
    pair = each.filter("total_amount > 0").groupBy("authorizer", "provider_cuit").agg(_documents(t, key).alias("contracts_for_prov"), cents(_zero(F.sum("real_ars"))).alias("total_real_ars"))
    pair = pair.filter((F.col("contracts_for_prov") >= of("bias_min_contracts")) & (F.col("total_real_ars") >= of("bias_min_amount")))
    total = each.groupBy("authorizer").agg(_documents(t, key).alias("total_signed"))
    out = pair.join(total, "authorizer").withColumn("bias_pct", pct(F.col("contracts_for_prov"), F.col("total_signed"))).filter(F.col("bias_pct") >= of("bias_pct"))
    out = val.with_usd(out.join(_provider_names(t), "provider_cuit"), t.fx_rate, "total_real_ars", "total_real_usd")
    out = out.select("authorizer", "provider_cuit", "provider_name", "contracts_for_prov", "total_signed", "bias_pct", "total_real_ars", "total_real_usd")
    return top_n(out, [F.desc("bias_pct"), F.desc("total_real_ars"), F.asc("authorizer"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("authorizer_provider_ring", 45, {"triad_min_contracts": 4, "triad_min_amount": 5_000_000, "triad_min_auth_pct": 40.0, "triad_min_unit_pct": 25.0}, (PROVIDER, UNIT, AUTHORIZER))
def authorizer_provider_ring(t: Tables, cfg: Config) -> DataFrame:
    """Official, unit and provider bound by both the official's count and the unit's money; the unit's money
    is pooled over both portals."""
    of = _limit(cfg, "authorizer_provider_ring")
    docs, key = process_window(val.valued_contracts(t), cfg), F.struct("document_number", "source")
    each = process_window(signed_contracts(t), cfg)
    triad = each.filter("total_amount > 0").groupBy("authorizer", "unit_code", F.col("source").alias("portal"), "provider_cuit").agg(_documents(t, key).alias("contracts"), _zero(F.sum("real_ars")).alias("real"))
    triad = triad.filter((F.col("contracts") >= of("triad_min_contracts")) & (F.col("real") >= of("triad_min_amount"))).withColumn("real_ars", cents(F.col("real")))
    total = each.groupBy("authorizer").agg(_documents(t, key).alias("all_contracts"))
    unit = docs.filter("total_amount > 0").groupBy("unit_code").agg(cents(_zero(F.sum("real_ars"))).alias("unit_real"))
    out = triad.join(total, "authorizer").join(unit, "unit_code")
    out = out.withColumn("authorizer_pct", F.bround(100.0 * F.col("contracts") / F.col("all_contracts"), 1)).withColumn("unit_pct", F.when(F.col("unit_real") != 0, F.bround(100.0 * F.col("real_ars") / F.col("unit_real"), 1)).otherwise(0.0))
    out = out.filter((F.col("authorizer_pct") >= of("triad_min_auth_pct")) & (F.col("unit_pct") >= of("triad_min_unit_pct"))).join(_provider_names(t), "provider_cuit").join(_unit_names(t), "unit_code")
    out = out.crossJoin(F.broadcast(val.latest_usd(t.fx_rate))).withColumn("real_usd", F.when(F.col("usd") > 0, F.bround(F.col("real_ars") / F.col("usd"), 2)))
    out = out.select("authorizer", "unit_code", "unit_name", "provider_cuit", "provider_name", "contracts", "real_ars", "authorizer_pct", "unit_pct", "real_usd")
    return top_n(out, [F.desc(F.col("authorizer_pct") + F.col("unit_pct")), F.desc("real_ars"), F.asc("authorizer"), F.asc("unit_code"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("uoc_favoritism", 30, {"uoc_min_contracts": 3, "uoc_min_amount": 5_000_000, "uoc_min_pct": 10.0}, (PROVIDER, UNIT))
def uoc_favoritism(t: Tables, cfg: Config) -> DataFrame:
    """Providers with a large part of a unit's real spend; units of the two portals stand apart."""
    of = _limit(cfg, "uoc_favoritism")
    per = paid(t, cfg).groupBy("unit_code", "source", "provider_cuit").agg(_documents(t, F.col("document_number")).alias("contracts_for_prov"), _zero(F.sum("real_ars")).alias("real"))
    unit = per.groupBy("unit_code", "source").agg(F.sum("contracts_for_prov").alias("total_awarded_in_unit"), F.sum("real").alias("unit_real"))
    out = per.withColumn("total_real_ars", cents(F.col("real"))).filter((F.col("contracts_for_prov") >= of("uoc_min_contracts")) & (F.col("total_real_ars") >= of("uoc_min_amount"))).join(unit, ["unit_code", "source"])
    out = out.withColumn("concentration_pct", F.when(F.col("unit_real") > 0, pct(F.col("total_real_ars"), F.col("unit_real").cast("double"))).otherwise(0.0)).filter(F.col("concentration_pct") >= of("uoc_min_pct"))
    out = val.with_usd(out.join(_provider_names(t), "provider_cuit").join(_unit_names(t), "unit_code"), t.fx_rate, "total_real_ars", "total_real_usd")
    out = out.select("unit_code", "unit_name", "provider_cuit", "provider_name", "contracts_for_prov", "total_awarded_in_unit", "concentration_pct", "total_real_ars", "total_real_usd")
    return top_n(out, [F.desc("concentration_pct"), F.desc("total_real_ars"), F.asc("unit_code"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("contract_splitting", 30, {"split_max_contract_ars": 5_000_000, "split_min_count": 3, "split_min_total_ars": 5_000_000}, (PROVIDER, UNIT))
def contract_splitting(t: Tables, cfg: Config) -> DataFrame:
    """Several small contracts of one unit with one provider in a month that add up."""
    of = _limit(cfg, "contract_splitting")
    tiny = paid(t, cfg).filter(F.col("perfection_date").isNotNull() & (F.col("real_ars") > 0) & (F.col("real_ars") <= of("split_max_contract_ars")))
    tiny = tiny.withColumn("month", F.trunc("perfection_date", "month")).withColumn("source", F.coalesce("source", F.lit("comprar")))
    by = ["unit_code", "provider_cuit", "month", "source"]
    hit = tiny.groupBy(*by).agg(_documents(t, F.col("document_number")).alias("split_count"), cents(F.sum("real_ars")).alias("split_total_ars"))
    hit = small(materialize(hit.filter((F.col("split_count") >= of("split_min_count")) & (F.col("split_total_ars") >= of("split_min_total_ars"))), "split"))
    # the processes are gathered for what was found only
    listed = tiny.join(hit, by).groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("process_number", F.col("source_url").alias("comprar_url")))).alias("processes"))
    out = hit.join(listed, by).withColumn("month", F.date_format("month", "yyyy-MM"))
    out = val.with_usd(out.join(_provider_names(t), "provider_cuit").join(_unit_names(t), "unit_code"), t.fx_rate, "split_total_ars", "split_total_usd")
    out = out.select("unit_code", "unit_name", "provider_cuit", "provider_name", "month", "source", "split_count", "split_total_ars", "split_total_usd", "processes")
    return top_n(out, [F.desc("split_total_ars"), F.desc("split_count"), F.asc("unit_code"), F.asc("provider_cuit"), F.asc("month"), F.asc("source")], cfg.limit, cfg.ordered)


@check("contract_cost_overrun", 25, {"overrun_min_pct": 20.0}, (PROVIDER, UNIT))
def contract_cost_overrun(t: Tables, cfg: Config) -> DataFrame:
    """Works contracts that grew: the portal's own figure, else current against original."""
    of = _limit(cfg, "contract_cost_overrun")
    own = F.when(F.col("current_amount") > 0, F.round(100.0 * (F.col("current_amount") - F.col("total_amount")) / F.col("total_amount"), 1))
    p = process_window(t.process, cfg).select("process_number", "unit_code", "source_url")
    rows = t.contract.filter("coalesce(source, 'comprar') = 'contratar' and total_amount > 0").join(p, "process_number").withColumn("overrun_pct", F.coalesce("variation_pct", own))
    rows = rows.filter(F.col("overrun_pct") >= of("overrun_min_pct")).join(_provider_names(t), "provider_cuit").join(_unit_names(t), "unit_code")
    out = rows.select(
        F.col("process_number").alias("process"), F.col("source_url").alias("process_url"), "unit_code", "unit_name", "provider_cuit", "provider_name", "document_number",
        F.round("total_amount", 2).alias("original_amount"), F.round(F.coalesce("current_amount", "total_amount"), 2).alias("current_amount"), "overrun_pct", F.coalesce("currency", F.lit("ARS")).alias("currency"),
    )
    return top_n(out, [F.desc("overrun_pct"), F.desc("current_amount"), F.asc("document_number")], cfg.limit, cfg.ordered)


@check("cover_bidding", 20, {"cover_min_competitors": 2, "cover_max_margin_pct": 2.0}, (PROVIDER, ("provider", "runner_up_cuit", "runner_up_name")))
def cover_bidding(t: Tables, cfg: Config) -> DataFrame:
    """A winner and a runner-up just above it, among rivals in the same currency; each rival bid counts once."""
    of = _limit(cfg, "cover_bidding")
    bids = t.bid.filter("total_amount > 0").select("process_number", "provider_cuit", "total_amount", F.coalesce("currency", F.lit("ARS")).alias("currency"))
    winners = t.contract.groupBy("process_number").agg(F.collect_set("provider_cuit").alias("winners"))
    dated = process_window(t.process, cfg).select("process_number", "source_url")
    rival = F.struct(F.col("total_amount").alias("amount"), F.col("provider_cuit").alias("cuit"))
    side = Window.partitionBy("process_number", "currency")
    each = bids.withColumn("own", F.count("*").over(Window.partitionBy("process_number", "currency", "provider_cuit")))
    each = each.withColumn("competing_bids", F.count("*").over(side) - F.col("own")).withColumn("first", F.min(rival).over(side))
    each = each.withColumn("second", F.min(F.when(F.col("provider_cuit") != F.col("first.cuit"), rival)).over(side))
    each = each.withColumn("r", F.when(F.col("provider_cuit") != F.col("first.cuit"), F.col("first")).otherwise(F.col("second"))).withColumnRenamed("total_amount", "won_amount")
    won = each.filter("competing_bids > 0").join(winners, "process_number").filter(F.array_contains("winners", F.col("provider_cuit"))).join(dated, "process_number")
    out = won.select("process_number", "source_url", "provider_cuit", "won_amount", "currency", "competing_bids", "r")
    out = out.filter((F.col("competing_bids") >= of("cover_min_competitors")) & (F.col("r.amount") >= F.col("won_amount")) & (F.col("r.amount") <= F.col("won_amount") * (1 + of("cover_max_margin_pct") / 100.0)))
    names = _provider_names(t)
    out = out.distinct().join(names, "provider_cuit").join(names.select(F.col("provider_cuit").alias("runner_up_cuit"), F.col("provider_name").alias("runner_up_name")), F.col("r.cuit") == F.col("runner_up_cuit"))
    out = out.select("process_number", F.col("source_url").alias("process_url"), "provider_cuit", "provider_name", "competing_bids", "won_amount", F.col("r.amount").alias("runner_up_amount"), "runner_up_cuit", "runner_up_name", "currency", F.round(100.0 * (F.col("r.amount") - F.col("won_amount")) / F.col("won_amount"), 2).alias("margin_pct"))
    return top_n(out, [F.asc("margin_pct"), F.desc("competing_bids"), F.asc("process_number"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


def shared_contacts(t: Tables) -> DataFrame:
    """(p1, p2, contact): provider pairs, p1 first, that have a contact in common."""
    own = provider_contacts(t)
    return own.select(F.col("provider_cuit").alias("p1"), "contact").join(own.select(F.col("provider_cuit").alias("p2"), "contact"), "contact").filter("p1 < p2").select("p1", "p2", "contact")


def provider_contacts(t: Tables) -> DataFrame:
    """Distinct (provider_cuit, contact)."""
    contact = F.struct(F.col("contact_type").alias("type"), F.col("contact_value").alias("contact")).alias("contact")
    return t.contact.filter("entity_type = 'provider'").select(F.col("entity_key").alias("provider_cuit"), contact).distinct()


@check("fake_competition", 35, {}, (("provider", "provider1_cuit", "provider1_name"), ("provider", "provider2_cuit", "provider2_name")))
def fake_competition(t: Tables, cfg: Config) -> DataFrame:
    """Rivals in a process that share a contact.  Providers meet by process and contact together, so a contact
    of very many providers pairs only those that bid side by side.  Processes in which no contact comes twice, counted by
    its hash, go before anything is paired."""
    contacts = small(materialize(provider_contacts(t), "fake"))
    dated = process_window(t.process, cfg).select("process_number", F.col("source_url").alias("process_url"))
    bids = t.bid.select("process_number", "provider_cuit")
    twice = bids.join(contacts.select("provider_cuit", F.xxhash64("contact").alias("h")), "provider_cuit").groupBy("process_number", "h").agg(F.count("*").alias("n")).filter("n > 1")
    twice = small(materialize(twice.select("process_number").distinct(), "fake"))
    at = materialize(bids.join(twice, "process_number", "left_semi").distinct().join(contacts, "provider_cuit"), "fake")
    both = at.withColumnRenamed("provider_cuit", "p1").join(at.withColumnRenamed("provider_cuit", "p2"), ["process_number", "contact"]).filter("p1 < p2")
    both = both.groupBy("process_number", "p1", "p2").agg(F.array_sort(F.collect_set("contact")).alias("shared_contacts")).join(dated, "process_number")
    n = _provider_names(t)
    both = both.join(n.select(F.col("provider_cuit").alias("p1"), F.col("provider_name").alias("provider1_name")), "p1").join(n.select(F.col("provider_cuit").alias("p2"), F.col("provider_name").alias("provider2_name")), "p2")
    out = both.select("process_number", "process_url", F.col("p1").alias("provider1_cuit"), "provider1_name", F.col("p2").alias("provider2_cuit"), "provider2_name", "shared_contacts")
    return top_n(out, [F.desc("process_number"), F.asc("provider1_cuit"), F.asc("provider2_cuit")], cfg.limit, cfg.ordered)


@check("cross_agency_proxy", 50, {}, (PROVIDER, UNIT))
def cross_agency_proxy(t: Tables, cfg: Config) -> DataFrame:
    """Providers that share a contact with a unit and win from others."""
    contact = F.struct(F.col("contact_type").alias("type"), F.col("contact_value").alias("contact")).alias("contact")
    units = t.contact.filter("entity_type = 'unit'").select(F.col("entity_key").alias("unit_code"), F.col("source").alias("unit_source"), contact).distinct()
    provs = t.contact.filter("entity_type = 'provider'").select(F.col("entity_key").alias("provider_cuit"), contact).distinct()
    linked = units.join(provs, "contact").groupBy("unit_code", "unit_source", "provider_cuit").agg(F.array_sort(F.collect_set("contact")).alias("shared_contacts"))
    linked = materialize(linked, "proxy")
    asked = small(linked.select("provider_cuit").distinct())
    p = process_window(t.process, cfg).select("process_number", F.col("unit_code").alias("at"), F.col("source").alias("at_source"))
    won = t.contract.join(asked, "provider_cuit", "left_semi").join(p, "process_number").groupBy("provider_cuit", "at", "at_source").agg(F.count_distinct(F.struct("document_number", "source")).alias("n"))
    every = won.groupBy("provider_cuit").agg(F.sum("n").alias("total"))
    inside = won.select("provider_cuit", F.col("at").alias("unit_code"), F.col("at_source").alias("unit_source"), "n")
    out = linked.join(every, "provider_cuit").join(inside, ["provider_cuit", "unit_code", "unit_source"], "left").withColumn("external_contracts_won", F.col("total") - _zero(F.col("n"))).filter("external_contracts_won > 0")
    out = out.join(_provider_names(t), "provider_cuit").join(_unit_names(t), "unit_code").select("unit_code", "unit_name", "provider_cuit", "provider_name", "external_contracts_won", "shared_contacts")
    return top_n(out, [F.desc("external_contracts_won"), F.asc("unit_code"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("contact_hub_multi_provider", 30, {"hub_min_providers": 5}, ())
def contact_hub(t: Tables, cfg: Config) -> DataFrame:
    """Contacts of many providers, with the page of a member's most recently read process.  The window does not
    apply; processes without a reading date come last."""
    own = t.contact.filter("entity_type = 'provider'").select("contact_type", "contact_value", F.col("entity_key").alias("provider_cuit")).distinct().join(_provider_names(t), "provider_cuit")
    hubs = own.groupBy("contact_type", "contact_value").agg(F.count("*").alias("provider_count"), F.array_sort(F.collect_list(F.concat("provider_cuit", F.lit(" ("), "provider_name", F.lit(")")))).alias("member_samples")).filter(F.col("provider_count") >= _limit(cfg, "contact_hub_multi_provider")("hub_min_providers"))
    read = t.bid.select("process_number", "provider_cuit").join(t.process.select("process_number", "scraped_at", "source_url"), "process_number")
    day = small(materialize(read.groupBy("provider_cuit").agg(F.max("scraped_at").alias("day")), "hub"))
    last = read.join(day, "provider_cuit").filter(F.col("scraped_at").eqNullSafe(F.col("day"))).groupBy("provider_cuit").agg(F.max(F.struct("scraped_at", "process_number", "source_url")).alias("seen"))
    ref = own.join(last, "provider_cuit").groupBy("contact_type", "contact_value").agg(F.max("seen").alias("seen"))
    out = hubs.join(ref, ["contact_type", "contact_value"], "left").select("contact_type", "contact_value", "provider_count", "member_samples", F.col("seen.source_url").alias("ref_url"))
    return top_n(out, [F.desc("provider_count"), F.asc("contact_type"), F.asc("contact_value")], cfg.limit, cfg.ordered)


@check("cdi_abuse", 15, {"cdi_min_processes": 10, "cdi_min_pct": 60.0}, (UNIT,))
def cdi_abuse(t: Tables, cfg: Config) -> DataFrame:
    """Units that buy mostly by direct award."""
    of = _limit(cfg, "cdi_abuse")
    direct = (F.col("process_type_code") == "CDI") | F.contains(F.lower("selection_procedure"), F.lit("directa"))
    per = process_window(t.process, cfg).groupBy("unit_code", "source").agg(F.count_distinct("process_number").alias("total_tenders"), F.count_distinct(F.when(direct, F.col("process_number"))).alias("cdi_processes"))
    out = per.filter(F.col("total_tenders") >= of("cdi_min_processes")).withColumn("cdi_pct", pct(F.col("cdi_processes"), F.col("total_tenders"))).filter(F.col("cdi_pct") >= of("cdi_min_pct"))
    out = out.join(_unit_names(t), "unit_code").select("unit_code", "unit_name", "total_tenders", "cdi_processes", "cdi_pct")
    return top_n(out, [F.desc("cdi_pct"), F.desc("total_tenders"), F.asc("unit_code")], cfg.limit, cfg.ordered)


@check("round_price_bids", 5, {"round_min_price": 10_000, "round_modulo": 10_000, "round_min_pct": 90.0, "round_min_lines": 5}, (PROVIDER,))
def round_price_bids(t: Tables, cfg: Config) -> DataFrame:
    """Providers whose unit prices are round numbers."""
    of = _limit(cfg, "round_price_bids")
    price = F.col("unit_price")
    is_round = (price == F.floor(price)) & (F.floor(price) % int(of("round_modulo")) == 0)
    rows = t.bid_line.filter(price > of("round_min_price")).join(process_window(t.process, cfg).select("process_number"), "process_number")
    per = rows.groupBy("provider_cuit").agg(F.sum(F.when(is_round, 1).otherwise(0)).alias("round_lines"), F.count("*").alias("total_lines")).filter(F.col("total_lines") >= of("round_min_lines"))
    out = per.withColumn("round_pct", pct(F.col("round_lines"), F.col("total_lines"))).filter(F.col("round_pct") >= of("round_min_pct")).join(_provider_names(t), "provider_cuit")
    return top_n(out.select("provider_cuit", "provider_name", "round_lines", "total_lines", "round_pct"), [F.desc("round_pct"), F.desc("total_lines"), F.asc("provider_cuit")], cfg.limit, cfg.ordered)


@check("spending_spikes", 0, {"spike_multiplier": 2.0}, ())
def spending_spikes(t: Tables, cfg: Config) -> DataFrame:
    """Months in which a portal's real spend is far above the mean of its months; the processes are gathered
    for those months only."""
    rows = paid(t, cfg).filter("perfection_date is not null").withColumn("month", F.date_format("perfection_date", "yyyy-MM")).withColumn("source", F.coalesce("source", F.lit("comprar")))
    per = rows.groupBy("month", "source").agg(_zero(F.sum("real_ars")).alias("spend"))
    mean = per.withColumn("mean", F.avg(F.col("spend").cast("double")).over(Window.partitionBy("source")))
    spend = F.col("spend").cast("double")
    hit = mean.filter((F.col("mean") > 0) & (spend > F.col("mean") * _limit(cfg, "spending_spikes")("spike_multiplier")))
    listed = rows.join(F.broadcast(hit.select("month", "source")), ["month", "source"]).groupBy("month", "source").agg(F.array_sort(F.collect_set(F.struct("process_number", F.col("source_url").alias("comprar_url")))).alias("processes"))
    out = hit.join(listed, ["month", "source"]).select("month", "source", cents(F.col("spend")).alias("real_ars_spend"), F.round(100.0 * (spend - F.col("mean")) / F.col("mean"), 1).alias("outlier_pct"), "processes")
    out = val.with_usd(out, t.fx_rate, "real_ars_spend", "real_usd_spend").select("month", "source", "real_ars_spend", "real_usd_spend", "outlier_pct", "processes")
    return top_n(out, [F.desc("real_ars_spend"), F.asc("month"), F.asc("source")], cfg.limit, cfg.ordered)
