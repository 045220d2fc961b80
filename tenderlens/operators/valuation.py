"""Amounts in real terms: as-of joins to a monthly price index and daily exchange rates.

A series is expanded to a calendar without gaps (each observation until the next), so that an as-of join
is an equality join against a table whose size is the length of time, not of the data; that table is
broadcast.  What lies after the last observation meets that one row.

All six kinds of priced entities run through one stream of facts (:func:`priced_facts`): a fact carries its
amounts as a list, so it is dated, linked and valued where it is, and nothing is shuffled to melt or to fold.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.functions.normalize import normalize_currency
from tenderlens.plans.tables import OFFICIAL_FROM, Tables, money


def observation_date(own: Column, process_dates: list[Column]) -> Column:
    """A fact's own date, else the first of its process's."""
    return F.coalesce(own, *process_dates)


def effective_currency(own: Column, parent: Column, process_currencies: Column) -> Column:
    """Own currency, else the parent's, else the first of the process's that can be normalised; null, or a
    label that says nothing, means that no link is made."""
    return normalize_currency(F.coalesce(_told(own), _told(parent), first_currency(process_currencies)))


def _told(label: Column) -> Column:
    return F.when(label != "", label)


def first_currency(process_currencies: Column) -> Column:
    return F.get(F.filter(F.transform(process_currencies, normalize_currency), lambda c: c.isNotNull()), F.lit(0))


def filled_calendar(series: DataFrame, keys: list[str], at: str, value: str, step: str) -> DataFrame:
    """(keys, slot, seen, value): a row for each step from an observation up to the next; the last one of
    a series has a row of its own and ``open`` true."""
    w = Window.partitionBy(*keys).orderBy(at)
    nxt = series.select(*keys, F.col(at).alias("seen"), F.col(value).alias("value"), F.lead(at).over(w).alias("until"))
    stop = F.date_sub("until", 1) if step == "1 day" else F.add_months("until", -1)
    slots = F.explode(F.expr("sequence(seen, coalesce(stop, seen), interval " + step + ")"))
    return nxt.withColumn("stop", stop).select(*keys, slots.alias("slot"), "seen", "value", F.col("until").isNull().alias("open"))


def as_of(facts: DataFrame, calendar: DataFrame, on: dict[str, Column], slot: Column, out: dict[str, str]) -> DataFrame:
    """Left as-of join: each fact gets the latest observation at or before its slot.  ``on`` gives the
    fact's value for each key; ``out`` names the columns taken from ``value`` and ``seen``."""
    keyed = facts
    for n, (k, c) in enumerate(on.items()):
        keyed = keyed.withColumn(f"__k{n}", c)
    keyed = keyed.withColumn("__slot", slot)
    names = [f"__k{n}" for n in range(len(on))]
    cal = calendar.select(*(F.col(k).alias(n) for k, n in zip(on, names)), F.col("slot").alias("__slot"), F.struct("value", "seen").alias("__hit"))
    last = calendar.filter("open").select(*(F.col(k).alias(n) for k, n in zip(on, names)), F.struct("value", "seen").alias("__last"))
    joined = keyed.join(F.broadcast(cal), [*names, "__slot"], "left").join(F.broadcast(last), names, "left")
    hit = F.coalesce("__hit", F.when(F.col("__slot") >= F.col("__last.seen"), F.col("__last")))
    for field, name in out.items():
        joined = joined.withColumn(name, hit[field])
    return joined.drop(*names, "__slot", "__hit", "__last")


def series_of(observed: Column, official_from: date) -> Column:
    """The index of a day: the chained one before the official one starts."""
    return F.when(observed < F.lit(official_from), "chained").when(observed.isNotNull(), "official")


def link_inflation(facts: DataFrame, price_index: DataFrame, official_from: date = OFFICIAL_FROM) -> DataFrame:
    """Adds ``series_id``, ``index_value``, ``index_period`` and ``index_strategy`` (same_month, nearest_prior)
    for facts with an ``observed`` date and an effective ``currency_used``.  A fact meets the series of its day
    only: where that has no observation up to the day, there is no link, whatever the other one holds."""
    linked = F.col("currency_used").isNotNull()
    facts = facts.withColumn("series_id", F.when(linked, series_of(F.col("observed"), official_from)))
    cal = filled_calendar(price_index, ["series_id"], "period", "index_value", "1 month")
    out = as_of(facts, cal, {"series_id": F.col("series_id")}, F.trunc("observed", "month"), {"value": "index_value", "seen": "index_period"})
    strategy = F.when(F.col("index_period") == F.trunc("observed", "month"), "same_month").when(F.col("index_period").isNotNull(), "nearest_prior")
    return out.withColumn("index_strategy", strategy)


def link_fx(facts: DataFrame, fx_rate: DataFrame, amount: str = "total_amount") -> DataFrame:
    """Adds ``rate``, ``rate_date``, ``fx_ars`` (two decimals) and ``fx_strategy`` for facts whose effective
    currency is not ARS."""
    foreign = F.when(F.col("currency_used") != "ARS", F.col("currency_used"))
    cal = filled_calendar(fx_rate, ["currency"], "observed_date", "rate", "1 day")
    out = as_of(facts, cal, {"currency": foreign}, F.col("observed"), {"value": "rate", "seen": "rate_date"})
    strategy = F.when(F.col("rate_date") == F.col("observed"), "exact_day").when(F.col("rate_date").isNotNull(), "previous_business_day")
    return out.withColumn("fx_ars", F.round(F.col(amount).cast("decimal(18,4)") * F.col("rate").cast("decimal(18,6)"), 2).cast("double")).withColumn("fx_strategy", strategy)


def real_value(df: DataFrame, price_index: DataFrame, amount: str = "total_amount", out: str = "real_ars") -> DataFrame:
    """Adds ``out``: the nominal pesos at the highest index there is; null without an index.  A null stored
    currency counts as pesos, whatever currency a fallback linked."""
    top = price_index.agg(F.max("index_value").alias("__top"))
    nominal = F.when(F.coalesce("currency", F.lit("ARS")) == "ARS", F.when(F.col("index_value").isNotNull(), F.col(amount))).otherwise(F.col("fx_ars"))
    value = F.when(F.col("index_value") > 0, nominal * F.col("__top") / F.col("index_value"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, money(value)).drop("__top")


def latest_usd(fx_rate: DataFrame) -> DataFrame:
    """One row: the newest dollar rate, null if there is none."""
    return fx_rate.filter("currency = 'USD'").agg(F.max_by("rate", "observed_date").alias("usd"))


def with_usd(df: DataFrame, fx_rate: DataFrame, ars: str, out: str) -> DataFrame:
    """Adds ``out``: pesos in dollars at the newest rate, two decimals."""
    return df.crossJoin(F.broadcast(latest_usd(fx_rate))).withColumn(out, F.when(F.col("usd") > 0, F.round(F.col(ars) / F.col("usd"), 2))).drop("usd")


PROCESS_DATES = ("opening_date", "scheduled_date", "gazette_date", "scraped_at")


def _valued(facts: DataFrame, t: Tables) -> DataFrame:
    return real_value(link_fx(link_inflation(facts, t.price_index, t.official_from), t.fx_rate), t.price_index)


def valued_contracts(t: Tables) -> DataFrame:
    """Contracts with their process's window column, unit and links, and ``real_ars`` (decimal or null)."""
    if "valued_contracts" in t.shared:
        return t.shared["valued_contracts"]
    p = t.process.select("process_number", *PROCESS_DATES, "currencies", "unit_code", "source_url")
    facts = t.contract.join(p, "process_number")
    facts = facts.withColumn("observed", observation_date(F.col("perfection_date"), [F.col(c) for c in PROCESS_DATES]))
    facts = facts.withColumn("currency_used", effective_currency(F.col("currency"), F.lit(None).cast("string"), F.col("currencies")))
    return _valued(facts, t)


# ---- all priced entities -------------------------------------------------------------------------------


def _fact(df: DataFrame, kind: str, key: list[str], own_date: str, total: str, unit: str | None, amounts: dict[str, list[str]]) -> DataFrame:
    """The facts of one kind.  ``amounts`` gives, for each amount column, the currency columns to try in turn;
    the frame has the process's ``__date`` and ``__first`` currency."""
    names = {tuple(cols): f"__c{n}" for n, cols in enumerate({tuple(c): 0 for c in amounts.values()})}
    for cols, name in names.items():
        df = df.withColumn(name, normalize_currency(F.coalesce(*(_told(F.col(c)) for c in cols), F.col("__first"))))
    label = lambda cols: F.col(names[tuple(cols)])
    each = [F.struct(F.lit(name).alias("field"), F.col(name).cast("double").alias("amount"), label(cols).alias("currency")) for name, cols in amounts.items()]
    some = F.filter(F.array(*each), lambda x: x["amount"].isNotNull() & x["currency"].isNotNull())
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]
    return df.select(
        F.lit(kind).alias("kind"), F.concat_ws("|", *parts).alias("key"), "currency", label(amounts[total]).alias("currency_used"), F.to_date(F.coalesce(F.to_date(own_date), F.col("__date"))).alias("observed"),
        F.col(total).cast("double").alias("total_amount"), (F.col(unit).cast("double") if unit else F.lit(None).cast("double")).alias("unit_price"), some.alias("amounts"),
    )


def priced_facts(t: Tables) -> DataFrame:
    """(kind, key, currency, currency_used, observed, total_amount, unit_price, amounts): a row for each priced
    entity of every kind that ``t`` has a table of.  The key holds its parts with ``|`` between them;
    ``currency`` is as stored, ``currency_used`` that of the total; ``amounts`` lists the amounts that have a
    currency, the two on extensions in their own.

    A line is dated and, failing a currency of its own, denominated by the bid, document or request it
    belongs to, and then by the process."""
    p = t.process.select("process_number", F.coalesce(*(F.to_date(c) for c in PROCESS_DATES)).alias("__date"), first_currency(F.col("currencies")).alias("__first"))
    bid = t.bid.join(p, "process_number")
    out = [_fact(bid, "bid", ["process_number", "provider_cuit"], "submitted_at", "total_amount", None, {"total_amount": ["currency"]})]
    if "total_per_line" in t.bid_line.columns:
        parent = t.bid.select("process_number", "provider_cuit", F.col("currency").alias("__parent"), F.col("submitted_at").alias("__own"))
        line = t.bid_line.join(parent, ["process_number", "provider_cuit"], "left").join(p, "process_number")
        out.append(_fact(line, "bid_line", ["process_number", "provider_cuit", "line_number", "alternative_number"], "__own", "total_per_line", "unit_price", {"unit_price": ["currency", "__parent"], "total_per_line": ["currency", "__parent"]}))
    doc = t.contract.join(p, "process_number")
    amounts = {"total_amount": ["currency"]}
    if "extension_currency" in t.contract.columns:
        amounts |= {c: ["extension_currency", "currency"] for c in ("max_extendable_amount", "available_extension_amount")}
    out.append(_fact(doc, "contractual_document", ["document_number", "source"], "perfection_date", "total_amount", None, amounts))
    if t.contract_line is not None:
        parent = t.contract.select("document_number", "source", "process_number", F.col("currency").alias("__parent"), F.col("perfection_date").alias("__own"))
        line = t.contract_line.join(parent, ["document_number", "source"]).join(p, "process_number")
        out.append(_fact(line, "contract_line", ["document_number", "source", "line_number", "alternative_number"], "__own", "total_price", "unit_price", {"unit_price": ["currency", "__parent"], "total_price": ["currency", "__parent"]}))
    if t.provision_request is not None:
        request = t.provision_request.join(p, "process_number", "left")
        out.append(_fact(request, "provision_request", ["request_number"], "created_at", "total_amount", None, {"total_amount": ["currency"]}))
        if t.provision_line is not None:
            parent = request.select("request_number", "__date", "__first", F.col("currency").alias("__parent"), F.col("created_at").alias("__own"))
            line = t.provision_line.join(parent, "request_number")
            out.append(_fact(line, "provision_request_line", ["request_number", "line_number", "alternative_number"], "__own", "total_price", "unit_price", {"unit_price": ["currency", "__parent"], "total_price": ["currency", "__parent"]}))
    return reduce(DataFrame.unionByName, out)


def _pesos() -> Column:
    return F.coalesce("currency", F.lit("ARS")) == "ARS"


def inflation_links(facts: DataFrame, t: Tables) -> DataFrame:
    """(kind, key, observed, series_id, index_period, index_value, index_strategy, amount_fields, ars_then,
    unit_ars_then): the link of each fact that has an amount with a currency and whose series reaches back to its day.
    Total and unit price count as pesos of the time if the stored currency is none or ARS."""
    some = facts.filter((F.size("amounts") > 0) & F.col("observed").isNotNull()).withColumn("currency_used", F.lit("any"))
    out = link_inflation(some, t.price_index, t.official_from).filter("index_value is not null")
    fields = F.array_sort(F.transform("amounts", lambda x: x["field"])).alias("amount_fields")
    return out.select("kind", "key", "observed", "series_id", "index_period", "index_value", "index_strategy", fields, F.when(_pesos(), F.col("total_amount")).alias("ars_then"), F.when(_pesos(), F.col("unit_price")).alias("unit_ars_then"))


def fx_links(facts: DataFrame, t: Tables) -> DataFrame:
    """(kind, key, currency, observed, rate_date, rate, fx_strategy, amount_fields, ars_then, unit_ars_then): a
    link for each foreign currency of a fact's amounts that has a rate by its day.  Pesos of the time are
    the total and the unit price at that rate, also where only an extension is in that currency."""
    foreign = F.array_distinct(F.filter(F.transform("amounts", lambda x: x["currency"]), lambda c: c != "ARS"))
    each = facts.filter("observed is not null").select("kind", "key", "observed", "total_amount", "unit_price", "amounts", F.explode(foreign).alias("currency_used"))
    out = link_fx(each, t.fx_rate).filter("rate is not null")
    own = F.filter("amounts", lambda x: x["currency"] == F.col("currency_used"))
    unit = F.round(F.col("unit_price").cast("decimal(18,4)") * F.col("rate").cast("decimal(18,6)"), 2).cast("double")
    return out.select("kind", "key", F.col("currency_used").alias("currency"), "observed", "rate_date", "rate", "fx_strategy", F.array_sort(F.transform(own, lambda x: x["field"])).alias("amount_fields"), F.col("fx_ars").alias("ars_then"), unit.alias("unit_ars_then"))


def valued_facts(t: Tables, facts: DataFrame | None = None) -> DataFrame:
    """The facts with the links of their totals, and ``real_ars``."""
    return _valued(priced_facts(t) if facts is None else facts, t)


def spend_by_year(t: Tables) -> DataFrame:
    """(entity, year, n, ars, real_ars): what priced entities of each kind cost, at the time and at the top index."""
    nominal = F.when(_pesos(), F.col("total_amount")).otherwise(F.col("fx_ars"))
    every = valued_facts(t).withColumn("year", F.year("observed")).withColumn("ars", money(nominal))
    return every.groupBy(F.col("kind").alias("entity"), "year").agg(F.count("*").alias("n"), F.round(F.sum("ars"), 2).cast("double").alias("ars"), F.round(F.coalesce(F.sum("real_ars"), F.lit(0)), 2).cast("double").alias("real_ars"))
