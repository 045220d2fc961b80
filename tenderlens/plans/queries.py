"""Queries over the mapped tables, one or more for each operator, and the same in SQL.

Nested results are shown as text, built alike on both sides, so that rows can be compared as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenderlens.functions import normalize as norm
from tenderlens.operators import checks, groups, ingest, network, profiles, runs, scoring, valuation
from tenderlens.operators.components import connected_components
from tenderlens.plans import fixture_map
from tenderlens.plans.staging import at_once, materialize, shared_dir
from tenderlens.plans.tables import Config, Tables, process_window, top_n
from tenderlens.sources import snapshot
from tenderlens.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Thresholds at which the evenly spread test data yields findings.
TUNED = Config(
    thresholds={
        "serial_winner_pct": 17.0, "bias_min_contracts": 3, "bias_min_amount": 0, "bias_pct": 10.0, "uoc_min_contracts": 3, "uoc_min_amount": 0, "uoc_min_pct": 5.0,
        "split_max_contract_ars": 1e12, "split_min_count": 2, "split_min_total_ars": 0, "triad_min_contracts": 2, "triad_min_amount": 0, "triad_min_auth_pct": 4.0, "triad_min_unit_pct": 1.0,
        "hub_min_providers": 3, "cdi_min_pct": 30.0, "round_min_pct": 20.0, "spike_multiplier": 1.3,
        "community_min_density": 1.0,
    }
)


#: What queries of many checks read again and again.
STORED = ("process", "bid", "contract", "authorized_by")


def query(name: str, sql: str | None = None, needs: str = "", written: tuple[str, ...] = ()):
    """Register fn(tables) -> DataFrame; ``needs`` names the mapped tables that the SQL reads, ``written`` those that
    are stored once before the query reads them."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(fixture_map.load(spark, sf_dir, written))
        if sql:
            head = fixture_map.ctes(*needs.split()) if needs else ""
            body = sql.strip()
            whole = body if not head else head + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
            ORACLES[name] = whole.replace("WITH ", "WITH RECURSIVE ", 1) if any(r in body for r in ("reach(", "hx(", "cl(members)")) else whole
        return fn

    return wrap


def joined(c: Column | str, item: Callable[[Column], Column], sep: str = ";") -> Column:
    return F.array_join(F.transform(c, item), sep)


def dec2(c: Column) -> Column:
    return c.cast("decimal(38,2)").cast("string")


def contacts_text(c: str) -> Column:
    return joined(c, lambda x: F.concat(x["type"], F.lit(":"), x["contact"]))


# ---- normalisation -----------------------------------------------------------------------------------

#: Messy values derived from orders, by the same text in both engines.
MESSY = """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 0 THEN '  Firma&nbsp;' || CAST(o_custkey AS STRING) || '   S.A.  ' WHEN 1 THEN 's/d' WHEN 2 THEN ' N/A ' WHEN 3 THEN '' WHEN 4 THEN 'No  informado' ELSE NULL END AS txt,
  CASE o_orderkey % 4 WHEN 0 THEN '30-' || CAST(o_custkey AS STRING) || '-1' WHEN 1 THEN 'none' ELSE '' END AS cuit,
  CASE o_orderkey % 9 WHEN 0 THEN 'Peso Argentino' WHEN 1 THEN 'DÓLAR ESTADOUNIDENSE' WHEN 2 THEN '$' WHEN 3 THEN 'Euro - EUR' WHEN 4 THEN 'Real' WHEN 5 THEN 'Yen Japonés' WHEN 6 THEN '-' WHEN 7 THEN 'Libra Esterlina' ELSE 'Guaraní' END AS cur,
  CASE o_orderkey % 4 WHEN 0 THEN '1.350.' || CAST(100 + o_orderkey % 900 AS STRING) || ',50' WHEN 1 THEN '-' || CAST(o_orderkey AS STRING) || ',0' WHEN 2 THEN 'abc' ELSE '1,2,3' END AS num,
  CASE o_orderkey % 5 WHEN 0 THEN ' Sí ' WHEN 1 THEN 'NO' WHEN 2 THEN 'X' WHEN 3 THEN '' ELSE 'tal vez' END AS yes,
  CASE o_orderkey % 6 WHEN 0 THEN CAST(1 + o_orderkey % 28 AS STRING) || '/' || CAST(1 + o_orderkey % 12 AS STRING) || '/2021 13:05:07' WHEN 1 THEN '05/02/2020 03:07:03 p.m.' WHEN 2 THEN '2019-11-30T08:15' WHEN 3 THEN '31/12/2018 23:59 Hrs.' WHEN 4 THEN '15/08/2017' ELSE 'pronto' END AS moment,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 99 AS STRING) || '/3-' || CAST(o_orderkey AS STRING) || '-LPR21' WHEN 1 THEN CAST(o_orderkey % 99 AS STRING) || '-0043-CDI24' WHEN 2 THEN 'X-1-LPR21' ELSE NULL END AS number,
  CASE o_orderkey % 4 WHEN 0 THEN '262/11 - Hospital  ' || CAST(o_custkey AS STRING) WHEN 1 THEN 'Unidad - Sur - Dos' WHEN 2 THEN '101-000Compras' ELSE 'Dirección' END AS unit,
  CASE o_orderkey % 3 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Email' ELSE 'Address' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN '+54 11 4' || CAST(o_custkey AS STRING) WHEN 1 THEN ' Info@Firma.AR ' ELSE 'sin numero' END AS value
FROM orders"""


def normalisation(name: str, make: Callable[[], dict[str, Column]], sql: str):
    """A query of columns over the messy values."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.sql(MESSY.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
        return rows.select("k", *(c.alias(n) for n, c in make().items()))

    QUERIES[name] = run
    ORACLES[name] = f"WITH m AS ({MESSY}) {sql}"


_BAD = "('no definido','no definida','no informada','no informado','no aplica','no disponible','sin definir','sin dato','s/d','n/d','n/a','na','none','null','-','--')"


def _clean(x: str) -> str:
    flat = f"regexp_replace(regexp_replace(regexp_replace({x}, '&nbsp;?', ' ', 'g'), '[\\s\\x{{00A0}}]+', ' ', 'g'), '^ | $', '', 'g')"
    return f"CASE WHEN {flat} <> '' AND lower({flat}) NOT IN {_BAD} THEN {flat} END"


normalisation("a10_clean_text", lambda: {"clean": norm.clean_text(F.col("txt"))}, f"SELECT k, {_clean('txt')} AS clean FROM m")
normalisation(
    "a11_ids_and_names", lambda: {"cuit": norm.clean_cuit(F.col("cuit")), "name": norm.normalize_name(F.col("txt"))},
    f"SELECT k, nullif(regexp_replace(cuit, '[^0-9]', '', 'g'), '') AS cuit, {_clean('upper(txt)')} AS name FROM m",
)
normalisation(
    "a12_currency", lambda: {"code": norm.normalize_currency(F.col("cur"))},
    "SELECT k, CASE o WHEN 0 THEN 'ARS' WHEN 1 THEN 'USD' WHEN 2 THEN 'ARS' WHEN 3 THEN 'EUR' WHEN 4 THEN 'BRL' WHEN 5 THEN 'JPY' WHEN 6 THEN NULL WHEN 7 THEN 'GBP' ELSE 'Guaraní' END AS code FROM (SELECT k, k % 9 AS o FROM m)",
)
normalisation(
    "a13_numbers", lambda: {"x": norm.parse_number_ar(F.col("num")), "n": norm.parse_int(F.col("num"))},
    "SELECT k, TRY_CAST(regexp_replace(replace(replace(num, '.', ''), ',', '.'), '[^0-9.]', '', 'g') AS DOUBLE) AS x, TRY_CAST(regexp_replace(num, '[^0-9]', '', 'g') AS BIGINT) AS n FROM m",
)
normalisation("a14_yes_no", lambda: {"yes": norm.parse_bool_es(F.col("yes"))}, "SELECT k, CASE WHEN lower(trim(yes)) IN ('si','sí','yes','true','1','x') THEN true WHEN lower(trim(yes)) IN ('no','false','0','') THEN false END AS yes FROM m")
normalisation(
    "a15_dates", lambda: {"at": F.date_format(norm.parse_datetime_ar(F.col("moment")), "yyyy-MM-dd HH:mm:ss"), "day": norm.parse_date_ar(F.col("moment")).cast("string")},
    """SELECT k, CASE k % 6 WHEN 4 THEN NULL ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS at, strftime(t, '%Y-%m-%d') AS day FROM (
SELECT k, coalesce(try_strptime(moment, '%d/%m/%Y %H:%M:%S'), try_strptime(replace(moment, 'p.m.', 'PM'), '%d/%m/%Y %I:%M:%S %p'), try_strptime(moment, '%Y-%m-%dT%H:%M'), try_strptime(moment, '%d/%m/%Y %H:%M Hrs.'), try_strptime(moment, '%d/%m/%Y')) AS t FROM m)""",
)


def _number_parts() -> dict[str, Column]:
    s = norm.split_process_number(F.col("number"))
    return {n: s[n] for n in ("saf_code", "sequence", "type_code", "year", "saf")}


normalisation(
    "a16_process_number", _number_parts,
    """SELECT k, r['a'] AS saf_code, r['b'] AS sequence, r['c'] AS type_code, r['d'] AS year, TRY_CAST(string_split(r['a'], '/')[1] AS INT) AS saf FROM (
SELECT k, CASE WHEN regexp_matches(trim(number), '^[0-9/]+-[0-9]+-[A-Z]+[0-9]{2}$') THEN regexp_extract(trim(number), '^([0-9/]+)-([0-9]+)-([A-Z]+)([0-9]{2})$', ['a', 'b', 'c', 'd']) END AS r FROM m)""",
)


def _unit_parts() -> dict[str, Column]:
    s = norm.split_unit_code(F.col("unit"))
    return {"code": s["code"], "name": s["name"]}


normalisation(
    "a17_unit_code", _unit_parts,
    "SELECT k, CASE k % 4 WHEN 0 THEN '262/11' WHEN 1 THEN 'Unidad' WHEN 2 THEN '101-000' ELSE 'Dirección' END AS code, CASE k % 4 WHEN 0 THEN regexp_replace(regexp_extract(unit, '- (.*)$', 1), ' +', ' ', 'g') WHEN 1 THEN 'Sur - Dos' WHEN 2 THEN 'Compras' END AS name FROM m",
)

# ---- ingestion -----------------------------------------------------------------------------------------

_UPDATES = "SELECT process_number, CASE WHEN CAST(process_number AS BIGINT) % 3 = 0 THEN 'closed' END AS status, CASE WHEN CAST(process_number AS BIGINT) % 4 = 0 THEN 'http://new' END AS source_url, 1 AS seq FROM process UNION ALL SELECT process_number, CASE WHEN CAST(process_number AS BIGINT) % 6 = 0 THEN 'awarded' END, NULL, 2 FROM process WHERE CAST(process_number AS BIGINT) % 2 = 0"


def _updates(t: Tables) -> DataFrame:
    n = F.col("process_number").cast("long")
    a = t.process.select("process_number", F.when(n % 3 == 0, "closed").alias("status"), F.when(n % 4 == 0, "http://new").alias("source_url"), F.lit(1).alias("seq"))
    b = t.process.filter(n % 2 == 0).select("process_number", F.when(n % 6 == 0, "awarded").alias("status"), F.lit(None).cast("string").alias("source_url"), F.lit(2).alias("seq"))
    return a.unionByName(b)


@query("a3_upsert", f"WITH u AS ({_UPDATES}), a AS (SELECT process_number, status, source_url, 0 AS seq FROM process UNION ALL SELECT * FROM u) SELECT process_number, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(source_url, seq) FILTER (source_url IS NOT NULL) AS source_url FROM a GROUP BY process_number", "process")
def _a3(t):
    return ingest.upsert(t.process.select("process_number", "status", "source_url"), _updates(t), ["process_number"])


@query("a4_upsert_edges", "SELECT process_number, provider_cuit, line_number, max(offered_quantity) AS offered_quantity FROM (SELECT process_number, provider_cuit, CASE WHEN line_number = 1 THEN -1 ELSE line_number END AS line_number, offered_quantity FROM bid_line) WHERE provider_cuit IN (SELECT cuit FROM provider WHERE CAST(cuit AS BIGINT) % 2 = 0) AND process_number IN (SELECT process_number FROM process WHERE status <> 'P') GROUP BY ALL", "bid_line provider process")
def _a4(t):
    edges = t.bid_line.select("process_number", "provider_cuit", F.when(F.col("line_number") != 1, F.col("line_number")).alias("line_number"), "offered_quantity", F.col("offered_quantity").alias("seq"))
    return ingest.upsert_edges(edges, (t.process.filter("status <> 'P'"), "process_number", "process_number"), (t.provider.filter("cast(cuit as bigint) % 2 = 0"), "cuit", "provider_cuit"), ["process_number", "provider_cuit", "line_number"])


@query("a5_collision_guard", "SELECT process_number, 'comprar' AS source, source AS stored_source FROM process WHERE source <> 'comprar'", "process")
def _a5(t):
    return ingest.collision_guard(t.process, t.process.select("process_number", F.lit("comprar").alias("source")))[1]


@query("a6_merge_first_non_null", "SELECT provider_cuit, arg_min(currency, CAST(process_number AS BIGINT)) FILTER (currency IS NOT NULL) AS currency, arg_min(total_amount, CAST(process_number AS BIGINT)) AS total_amount FROM bid GROUP BY provider_cuit", "bid")
def _a6(t):
    rows = t.bid.select("provider_cuit", "currency", "total_amount", F.col("process_number").cast("long").alias("at"))
    return ingest.merge_first_non_null(rows, ["provider_cuit"], "at")


@query("a7_coalesce_buyer", "SELECT p.process_number, coalesce(CASE WHEN CAST(p.process_number AS BIGINT) % 2 = 0 AND c.document_number IS NOT NULL THEN c.provider_cuit END, p.unit_code) AS buyer_code, CASE WHEN CAST(p.process_number AS BIGINT) % 3 = 0 AND c.document_number IS NOT NULL THEN 'organization' ELSE 'unit' END AS buyer_kind FROM process p LEFT JOIN contract c USING (process_number)", "process contract")
def _a7(t):
    n = F.col("process_number").cast("long")
    docs = t.contract.select("process_number", "document_number", F.when(n % 2 == 0, F.col("provider_cuit")).alias("buyer_code"), (n % 3 == 0).alias("is_open_order"))
    return ingest.coalesce_buyer(t.process.select("process_number", F.col("unit_code").alias("buyer_code")), docs)


@query("a8_overlay_summary", "SELECT document_number, CASE WHEN CAST(process_number AS BIGINT) % 4 = 0 THEN 'signed' ELSE 'draft' END AS status, coalesce(CASE WHEN CAST(process_number AS BIGINT) % 5 = 0 THEN 'EUR' END, currency) AS currency FROM contract", "contract")
def _a8(t):
    n = F.col("process_number").cast("long")
    docs = t.contract.select("document_number", F.lit("draft").alias("status"), "currency")
    return ingest.overlay_contract_summary(docs, t.contract.select("document_number", F.when(n % 4 == 0, "signed").alias("status"), F.when(n % 5 == 0, "EUR").alias("currency")))


@query("a9_resolve_provider", "SELECT DISTINCT b.process_number, upper(p.business_name) || '.' AS name, b.provider_cuit FROM bid b JOIN provider p ON p.cuit = b.provider_cuit", "bid provider")
def _a9(t):
    known = t.bid.join(t.provider, F.col("provider_cuit") == F.col("cuit")).select("process_number", "cuit", "business_name", F.col("cuit").cast("long").alias("position"))
    rows = known.select("process_number", F.concat(F.upper("business_name"), F.lit(".")).alias("name"))
    return ingest.resolve_provider_by_name(rows, known).select("process_number", "name", "provider_cuit")


@query("a18_contact_edges", "WITH e AS (SELECT cuit, 'Phone' AS contact_type, '+54 ' || CAST(CAST(cuit AS BIGINT) % 40 AS STRING) AS value FROM provider UNION ALL SELECT cuit, 'Email', 'Mail' || CAST(CAST(cuit AS BIGINT) % 7 AS STRING) || '@X.AR' FROM provider), k AS (SELECT *, CASE contact_type WHEN 'Phone' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE lower(value) END AS value_key FROM e) SELECT cuit, contact_type, value_key, arg_min(value, CAST(cuit AS BIGINT)) OVER (PARTITION BY contact_type, value_key) AS value FROM k", "provider")
def _a18(t):
    n = F.col("cuit").cast("long")
    rows = t.provider.select("cuit", n.alias("seq"), F.lit("").alias("address"), F.concat(F.lit("+54 "), (n % 40).cast("string")).alias("phone"), F.concat(F.lit("Mail"), (n % 7).cast("string"), F.lit("@X.AR")).alias("email"))
    return ingest.contact_edges(rows, "cuit", "seq")


@query("a19_pending", "SELECT DISTINCT process_number FROM process WHERE CAST(process_number AS BIGINT) % 11 <> 0 AND status = 'P'", "process")
def _a19(t):
    n = F.col("process_number").cast("long")
    lines = t.process.select(F.when(n % 11 == 0, F.concat(F.lit("// "), "process_number")).otherwise(F.concat(F.lit("﻿"), "process_number", F.lit(" "))).alias("value"))
    return ingest.pending(lines, t.process.filter("status <> 'P'"))


@query("a20_open_processes", "SELECT process_number, opening_date FROM process WHERE source = 'comprar' AND coalesce(opening_date, scheduled_date) >= DATE '2001-02-01' - INTERVAL 6 MONTH", "process")
def _a20(t):
    return ingest.open_processes(t.process, 6, "comprar", F.lit("2001-02-01").cast("date")).select("process_number", "opening_date")


_MONTHLY = "SELECT CAST(date_trunc('month', opening_date) AS DATE) AS period, CAST(count(*) % 7 AS DOUBLE) AS pct FROM process WHERE opening_date IS NOT NULL GROUP BY 1"


@query("a21_price_index", f"WITH v AS ({_MONTHLY}), b AS (SELECT period, pct, row_number() OVER (ORDER BY period DESC) AS n FROM v WHERE period <= DATE '2000-12-01'), g AS (SELECT * FROM b WHERE period = DATE '2000-12-01' - to_months(CAST(n - 1 AS INT))) SELECT 'chained' AS series_id, strftime(period - INTERVAL 1 MONTH, '%Y-%m-%d') AS period, round(round(100 * exp(-sum(ln(1 + pct / 100)) OVER (ORDER BY period DESC)), 6), 4) AS index_value FROM g UNION ALL SELECT series_id, strftime(period, '%Y-%m-%d'), index_value FROM price_index WHERE period >= DATE '2000-12-01'", "process price_index")
def _a21(t):
    v = t.process.filter("opening_date is not null").groupBy(F.trunc("opening_date", "month").alias("period")).agg((F.count("*") % 7).cast("double").alias("pct"))
    out = ingest.build_price_index(t.price_index.filter("period >= date'2000-12-01'"), v, "2000-12-01")
    return out.select("series_id", F.col("period").cast("string").alias("period"), F.round("index_value", 4).alias("index_value"))


@query("a22_refresh_window", "SELECT strftime(least((SELECT max(opening_date) FROM process), (SELECT max(perfection_date) FROM contract)) - INTERVAL 40 DAY, '%Y-%m-%d') AS since", "process contract")
def _a22(t):
    a, b = t.process.select(F.col("opening_date").alias("period")), t.contract.select(F.col("perfection_date").alias("observed_date"))
    return ingest.indicator_refresh_window(a, b).select(F.col("since").cast("string").alias("since"))


# ---- valuation -----------------------------------------------------------------------------------------

_ERA = f"CASE WHEN observed < DATE '{fixture_map.OFFICIAL_FROM}' THEN 'chained' ELSE 'official' END"
VALUED = f"""f AS (SELECT c.*, p.opening_date, p.unit_code, p.source_url, coalesce(c.perfection_date, p.opening_date, p.scheduled_date, p.gazette_date, p.scraped_at) AS observed, coalesce(c.currency, p.currencies[1]) AS currency_used FROM contract c JOIN process p ON c.process_number = p.process_number),
li AS (SELECT f.*, CASE WHEN currency_used IS NOT NULL THEN i.index_value END AS index_value, CASE WHEN currency_used IS NOT NULL THEN i.period END AS index_period FROM (SELECT *, {_ERA} AS series FROM f) f ASOF LEFT JOIN price_index i ON f.series = i.series_id AND f.observed >= i.period),
lf AS (SELECT li.*, x.rate, x.observed_date AS rate_date, CAST(round(CAST(total_amount AS DECIMAL(18,4)) * CAST(x.rate AS DECIMAL(18,6)), 2) AS DOUBLE) AS fx_ars FROM (SELECT *, CASE WHEN currency_used <> 'ARS' THEN currency_used ELSE '?' END AS cu FROM li) li ASOF LEFT JOIN fx_rate x ON li.cu = x.currency AND li.observed >= x.observed_date),
vc AS (SELECT *, CAST(CASE WHEN index_value > 0 THEN (CASE WHEN coalesce(currency, 'ARS') = 'ARS' THEN total_amount ELSE fx_ars END) * (SELECT max(index_value) FROM price_index) / index_value END AS DECIMAL(38,8)) AS real_ars FROM lf),
usd AS (SELECT arg_max(rate, observed_date) AS usd FROM fx_rate WHERE currency = 'USD'),
pn AS (SELECT cuit AS provider_cuit, business_name AS provider_name FROM provider), un AS (SELECT code AS unit_code, min(name) AS unit_name FROM unit GROUP BY code)"""
_V = "contract process price_index fx_rate provider unit authorized_by"


#: What the facts of all priced entities read several times.
PRICED = ("process", "bid", "bid_line", "contract")

#: All priced entities: ``c`` is the currency of total and unit price, ``e`` that of the amounts on extensions.
_FACTS = f"""pd AS (SELECT process_number, coalesce(opening_date, scheduled_date, gazette_date, scraped_at) AS pdate, currencies[1] AS pc FROM process),
fa AS (SELECT 'bid' AS kind, b.process_number || '|' || b.provider_cuit AS key, b.currency, coalesce(b.submitted_at, pdate) AS observed, b.total_amount, NULL::DOUBLE AS unit_price, coalesce(b.currency, pc) AS c, NULL AS e, NULL::DOUBLE AS mx, NULL::DOUBLE AS av, 'total_amount' AS tf FROM bid b JOIN pd USING (process_number)
UNION ALL SELECT 'bid_line', l.process_number || '|' || l.provider_cuit || '|' || l.line_number || '|' || l.alternative_number, l.currency, coalesce(b.submitted_at, pdate), l.total_per_line, l.unit_price, nullif(coalesce(l.currency, b.currency, pc), '-'), NULL, NULL, NULL, 'total_per_line' FROM bid_line l JOIN pd USING (process_number) LEFT JOIN bid b ON b.process_number = l.process_number AND b.provider_cuit = l.provider_cuit
UNION ALL SELECT 'contractual_document', d.document_number || '|' || d.source, d.currency, coalesce(d.perfection_date, pdate), d.total_amount, NULL, coalesce(d.currency, pc), coalesce(d.extension_currency, d.currency, pc), d.max_extendable_amount, d.available_extension_amount, 'total_amount' FROM contract d JOIN pd USING (process_number)
UNION ALL SELECT 'contract_line', l.document_number || '|' || l.source || '|' || l.line_number || '|' || l.alternative_number, l.currency, coalesce(d.perfection_date, pdate), l.total_price, l.unit_price, nullif(coalesce(l.currency, d.currency, pc), '-'), NULL, NULL, NULL, 'total_price' FROM contract_line l JOIN contract d USING (document_number, source) JOIN pd ON pd.process_number = d.process_number
UNION ALL SELECT 'provision_request', r.request_number, r.currency, coalesce(r.created_at, pdate), r.total_amount, NULL, coalesce(r.currency, pc), NULL, NULL, NULL, 'total_amount' FROM provision_request r LEFT JOIN pd ON pd.process_number = r.process_number
UNION ALL SELECT 'provision_request_line', l.request_number || '|' || l.line_number || '|' || l.alternative_number, l.currency, coalesce(r.created_at, pdate), l.total_price, l.unit_price, coalesce(l.currency, r.currency, pc), NULL, NULL, NULL, 'total_price' FROM provision_line l JOIN provision_request r USING (request_number) LEFT JOIN pd ON pd.process_number = r.process_number),
am AS (SELECT *, list_filter([{{'f': tf, 'a': total_amount, 'c': c}}, {{'f': 'unit_price', 'a': unit_price, 'c': c}}, {{'f': 'max_extendable_amount', 'a': mx, 'c': e}}, {{'f': 'available_extension_amount', 'a': av, 'c': e}}], lambda x: x.a IS NOT NULL AND x.c IS NOT NULL) AS amounts, {_ERA} AS series FROM fa),
vi AS (SELECT am.*, CASE WHEN c IS NOT NULL THEN i.index_value END AS index_value FROM am ASOF LEFT JOIN price_index i ON am.series = i.series_id AND am.observed >= i.period),
vx AS (SELECT vi.*, CAST(round(CAST(total_amount AS DECIMAL(18,4)) * CAST(x.rate AS DECIMAL(18,6)), 2) AS DOUBLE) AS fx_ars FROM (SELECT *, CASE WHEN c <> 'ARS' THEN c ELSE '?' END AS cu FROM vi) vi ASOF LEFT JOIN fx_rate x ON vi.cu = x.currency AND vi.observed >= x.observed_date),
vf AS (SELECT *, CAST(CASE WHEN index_value > 0 THEN (CASE WHEN coalesce(currency, 'ARS') = 'ARS' THEN total_amount ELSE fx_ars END) * (SELECT max(index_value) FROM price_index) / index_value END AS DECIMAL(38,8)) AS real_ars FROM vx)"""
_P = "bid bid_line contract contract_line provision_request provision_line process price_index fx_rate"
_TEXTS = "array_to_string(list_sort(list_transform({}, lambda x: x.f)), ';')"


@query("b1_observation_date", f"WITH {_FACTS} SELECT kind, key, strftime(observed, '%Y-%m-%d') AS observed FROM fa", _P, written=PRICED)
def _b1(t):
    return valuation.priced_facts(t).select("kind", "key", F.col("observed").cast("string").alias("observed"))


@query("b2_effective_currency", f"WITH {_FACTS} SELECT kind, key, a.f AS field, a.c AS currency FROM (SELECT kind, key, unnest(amounts) AS a FROM am)", _P, written=PRICED)
def _b2(t):
    return valuation.priced_facts(t).select("kind", "key", F.explode("amounts").alias("a")).select("kind", "key", "a.field", "a.currency")


@query(
    "b3_link_inflation",
    f"""WITH {_FACTS} SELECT kind, key, series AS series_id, i.index_value, CASE WHEN i.period = date_trunc('month', observed) THEN 'same_month' ELSE 'nearest_prior' END AS index_strategy, {_TEXTS.format('amounts')} AS amount_fields,
CASE WHEN coalesce(currency, 'ARS') = 'ARS' THEN total_amount END AS ars_then, CASE WHEN coalesce(currency, 'ARS') = 'ARS' THEN unit_price END AS unit_ars_then FROM am ASOF JOIN price_index i ON am.series = i.series_id AND am.observed >= i.period WHERE len(amounts) > 0""",
    _P,
    written=PRICED,
)
def _b3(t):
    out = valuation.inflation_links(valuation.priced_facts(t), t)
    return out.select("kind", "key", "series_id", "index_value", "index_strategy", F.array_join("amount_fields", ";").alias("amount_fields"), "ars_then", "unit_ars_then")


@query(
    "b4_link_fx",
    f"""WITH {_FACTS}, us AS (SELECT *, list_filter(amounts, lambda x: x.c = 'USD') AS own FROM am) SELECT kind, key, x.currency, x.rate, CASE WHEN x.observed_date = observed THEN 'exact_day' ELSE 'previous_business_day' END AS fx_strategy, {_TEXTS.format('own')} AS amount_fields,
CAST(round(CAST(total_amount AS DECIMAL(18,4)) * CAST(rate AS DECIMAL(18,6)), 2) AS DOUBLE) AS ars_then, CAST(round(CAST(unit_price AS DECIMAL(18,4)) * CAST(rate AS DECIMAL(18,6)), 2) AS DOUBLE) AS unit_ars_then FROM us ASOF JOIN fx_rate x ON us.observed >= x.observed_date WHERE len(own) > 0""",
    _P,
    written=PRICED,
)
def _b4(t):
    out = valuation.fx_links(valuation.priced_facts(t), t)
    return out.select("kind", "key", "currency", "rate", "fx_strategy", F.array_join("amount_fields", ";").alias("amount_fields"), "ars_then", "unit_ars_then")


@query("b5_real_value", f"WITH {_FACTS} SELECT kind, key, CAST(round(real_ars, 2) AS DOUBLE) AS real_ars FROM vf", _P, written=PRICED)
def _b5(t):
    return valuation.valued_facts(t).select("kind", "key", F.round("real_ars", 2).cast("double").alias("real_ars"))


@query("b6_to_usd", f"WITH {VALUED} SELECT document_number, CASE WHEN usd > 0 THEN round(total_amount / usd, 2) END AS total_usd FROM contract, usd", _V)
def _b6(t):
    return valuation.with_usd(t.contract, t.fx_rate, "total_amount", "total_usd").select("document_number", "total_usd")


@query(
    "b7_spend_by_year",
    f"""WITH {_FACTS} SELECT kind AS entity, CAST(year(observed) AS INT) AS year, count(*) AS n, CAST(round(sum(CAST(CASE WHEN coalesce(currency, 'ARS') = 'ARS' THEN total_amount ELSE fx_ars END AS DECIMAL(38,8))), 2) AS DOUBLE) AS ars,
CAST(round(coalesce(sum(real_ars), 0), 2) AS DOUBLE) AS real_ars FROM vf GROUP BY ALL""",
    _P,
    written=PRICED,
)
def _b7(t):
    return valuation.spend_by_year(t)


# ---- checks --------------------------------------------------------------------------------------------

_CENTS = "CAST(round(coalesce(sum(real_ars), 0), 2) AS DOUBLE)"


@query(
    "c1_serial_winner",
    f"""WITH {VALUED}, b AS (SELECT provider_cuit, count(DISTINCT process_number) AS total_bids FROM bid JOIN process USING (process_number) GROUP BY 1), w AS (SELECT provider_cuit, count(DISTINCT process_number) AS total_wins FROM vc GROUP BY 1),
mc AS (SELECT provider_cuit, coalesce(currency, 'ARS') AS cur, sum(CAST(total_amount AS DECIMAL(38,4))) AS amt FROM vc WHERE total_amount > 0 GROUP BY provider_cuit, currency), ml AS (SELECT provider_cuit, string_agg(cur || ':' || CAST(CAST(amt AS DECIMAL(38,2)) AS VARCHAR), ';' ORDER BY cur, amt) AS total_won FROM mc GROUP BY 1),
mr AS (SELECT provider_cuit, {_CENTS} AS total_real_ars FROM vc WHERE total_amount > 0 GROUP BY 1)
SELECT provider_cuit, provider_name, total_bids, total_wins, round(100.0::DOUBLE * total_wins / total_bids, 1) AS win_pct, total_won, total_real_ars, round(total_real_ars / usd, 2) AS total_real_usd FROM b JOIN w USING (provider_cuit) JOIN ml USING (provider_cuit) JOIN mr USING (provider_cuit) JOIN pn USING (provider_cuit), usd WHERE total_bids >= 5 AND round(100.0::DOUBLE * total_wins / total_bids, 1) >= 17""",
    _V + " bid",
)
def _c1(t):
    return checks.serial_winner(t, TUNED).withColumn("total_won", joined("total_won", lambda x: F.concat(x["currency"], F.lit(":"), dec2(x["amount"]))))


@query(
    "c2_authorizer_bias",
    f"""WITH {VALUED}, e AS (SELECT vc.*, a.authorizer FROM vc JOIN (SELECT DISTINCT * FROM authorized_by) a ON vc.document_number = a.document_number AND vc.source = a.source),
p AS (SELECT authorizer, provider_cuit, count(DISTINCT document_number) AS contracts_for_prov, {_CENTS} AS total_real_ars FROM e WHERE total_amount > 0 GROUP BY ALL), tt AS (SELECT authorizer, count(DISTINCT document_number) AS total_signed FROM e GROUP BY 1)
SELECT authorizer, provider_cuit, provider_name, contracts_for_prov, total_signed, round(100.0::DOUBLE * contracts_for_prov / total_signed, 1) AS bias_pct, total_real_ars, round(total_real_ars / usd, 2) AS total_real_usd FROM p JOIN tt USING (authorizer) JOIN pn USING (provider_cuit), usd WHERE contracts_for_prov >= 3 AND round(100.0::DOUBLE * contracts_for_prov / total_signed, 1) >= 10""",
    _V,
)
def _c2(t):
    return checks.authorizer_bias(t, TUNED)


@query(
    "c3_authorizer_provider_ring",
    f"""WITH {VALUED}, e AS (SELECT vc.*, a.authorizer FROM vc JOIN (SELECT DISTINCT * FROM authorized_by) a ON vc.document_number = a.document_number AND vc.source = a.source),
tr AS (SELECT authorizer, unit_code, source, provider_cuit, count(DISTINCT document_number) AS contracts, {_CENTS} AS real_ars FROM e WHERE total_amount > 0 GROUP BY ALL HAVING count(DISTINCT document_number) >= 2),
tt AS (SELECT authorizer, count(DISTINCT document_number) AS n FROM e GROUP BY 1), ut AS (SELECT unit_code, {_CENTS} AS u FROM vc WHERE total_amount > 0 GROUP BY 1),
o AS (SELECT authorizer, unit_code, unit_name, provider_cuit, provider_name, contracts, real_ars, round_even(100.0::DOUBLE * contracts / n, 1) AS authorizer_pct, CASE WHEN u <> 0 THEN round_even(100.0::DOUBLE * real_ars / u, 1) ELSE 0.0 END AS unit_pct, round_even(real_ars / usd, 2) AS real_usd FROM tr JOIN tt USING (authorizer) JOIN ut USING (unit_code) JOIN pn USING (provider_cuit) JOIN un USING (unit_code), usd)
SELECT * FROM o WHERE authorizer_pct >= 4 AND unit_pct >= 1""",
    _V,
)
def _c3(t):
    return checks.authorizer_provider_ring(t, TUNED)


@query(
    "c4_uoc_favoritism",
    f"""WITH {VALUED}, p AS (SELECT unit_code, source, provider_cuit, count(DISTINCT document_number) AS contracts_for_prov, coalesce(sum(real_ars), 0) AS r FROM vc WHERE total_amount > 0 GROUP BY ALL), u AS (SELECT unit_code, source, sum(contracts_for_prov)::BIGINT AS total_awarded_in_unit, sum(r) AS ur FROM p GROUP BY ALL),
o AS (SELECT unit_code, unit_name, provider_cuit, provider_name, contracts_for_prov, total_awarded_in_unit, CASE WHEN ur > 0 THEN round(100.0::DOUBLE * CAST(round(r, 2) AS DOUBLE) / CAST(ur AS DOUBLE), 1) ELSE 0.0 END AS concentration_pct, CAST(round(r, 2) AS DOUBLE) AS total_real_ars FROM p JOIN u USING (unit_code, source) JOIN pn USING (provider_cuit) JOIN un USING (unit_code))
SELECT o.*, round(total_real_ars / usd, 2) AS total_real_usd FROM o, usd WHERE contracts_for_prov >= 3 AND concentration_pct >= 5""",
    _V,
)
def _c4(t):
    return checks.uoc_favoritism(t, TUNED)


@query(
    "c5_contract_splitting",
    f"""WITH {VALUED}, g AS (SELECT unit_code, provider_cuit, strftime(perfection_date, '%Y-%m') AS month, source, count(DISTINCT document_number) AS split_count, {_CENTS} AS split_total_ars, string_agg(DISTINCT process_number, ';' ORDER BY process_number) AS processes FROM vc WHERE perfection_date IS NOT NULL AND total_amount > 0 AND real_ars > 0 GROUP BY ALL)
SELECT unit_code, unit_name, provider_cuit, provider_name, month, source, split_count, split_total_ars, round(split_total_ars / usd, 2) AS split_total_usd, processes FROM g JOIN pn USING (provider_cuit) JOIN un USING (unit_code), usd WHERE split_count >= 2""",
    _V,
)
def _c5(t):
    return checks.contract_splitting(t, TUNED).withColumn("processes", joined("processes", lambda x: x["process_number"]))


@query(
    "c6_contract_cost_overrun",
    """WITH o AS (SELECT c.process_number AS process, source_url AS process_url, unit_code, 'Unit ' || unit_code AS unit_name, provider_cuit, business_name AS provider_name, document_number, round(total_amount, 2) AS original_amount, round(current_amount, 2) AS current_amount,
coalesce(variation_pct, CASE WHEN current_amount > 0 THEN round(100.0::DOUBLE * (current_amount - total_amount) / total_amount, 1) END) AS overrun_pct, coalesce(currency, 'ARS') AS currency FROM contract c JOIN process p ON c.process_number = p.process_number JOIN provider ON cuit = provider_cuit WHERE c.source = 'contratar' AND total_amount > 0) SELECT * FROM o WHERE overrun_pct >= 20""",
    "contract process provider",
)
def _c6(t):
    return checks.contract_cost_overrun(t, TUNED)


@query(
    "c7_cover_bidding",
    """WITH b AS (SELECT process_number, provider_cuit, total_amount, coalesce(currency, 'ARS') AS currency FROM bid WHERE total_amount > 0), w AS (SELECT DISTINCT process_number, provider_cuit FROM contract),
g AS (SELECT b.process_number, b.provider_cuit, b.total_amount AS won_amount, b.currency, count(*) AS competing_bids, min({'a': o.total_amount, 'c': o.provider_cuit}) AS r FROM b JOIN w USING (process_number, provider_cuit) JOIN b o ON o.process_number = b.process_number AND o.currency = b.currency AND o.provider_cuit <> b.provider_cuit GROUP BY ALL)
SELECT process_number, source_url AS process_url, g.provider_cuit, n1.business_name AS provider_name, competing_bids, won_amount, r.a AS runner_up_amount, r.c AS runner_up_cuit, n2.business_name AS runner_up_name, currency, round(100.0::DOUBLE * (r.a - won_amount) / won_amount, 2) AS margin_pct FROM g JOIN process USING (process_number) JOIN provider n1 ON n1.cuit = provider_cuit JOIN provider n2 ON n2.cuit = r.c WHERE competing_bids >= 2 AND r.a >= won_amount AND r.a <= won_amount * (1 + 2.0::DOUBLE / 100)""",
    "bid contract process provider",
)
def _c7(t):
    return checks.cover_bidding(t, TUNED)


_SHARED = "sc AS (SELECT a.entity_key AS p1, b.entity_key AS p2, string_agg(DISTINCT a.contact_type || ':' || a.contact_value, ';' ORDER BY a.contact_type || ':' || a.contact_value) AS shared_contacts, count(DISTINCT a.contact_type || ':' || a.contact_value) AS weight FROM contact a JOIN contact b ON a.contact_type = b.contact_type AND a.contact_value = b.contact_value AND a.entity_key < b.entity_key WHERE a.entity_type = 'provider' AND b.entity_type = 'provider' GROUP BY ALL)"


@query(
    "c8_fake_competition",
    f"WITH {_SHARED}, b AS (SELECT DISTINCT process_number, provider_cuit FROM bid) SELECT process_number, source_url AS process_url, p1 AS provider1_cuit, n1.business_name AS provider1_name, p2 AS provider2_cuit, n2.business_name AS provider2_name, shared_contacts FROM sc JOIN b b1 ON b1.provider_cuit = p1 JOIN b b2 USING (process_number) JOIN process USING (process_number) JOIN provider n1 ON n1.cuit = p1 JOIN provider n2 ON n2.cuit = p2 WHERE b2.provider_cuit = p2",
    "contact bid process provider",
)
def _c8(t):
    return checks.fake_competition(t, TUNED).withColumn("shared_contacts", contacts_text("shared_contacts"))


@query(
    "c9_cross_agency_proxy",
    """WITH l AS (SELECT u.entity_key AS unit_code, u.source AS us, p.entity_key AS provider_cuit, string_agg(DISTINCT u.contact_type || ':' || u.contact_value, ';' ORDER BY u.contact_type || ':' || u.contact_value) AS shared_contacts FROM contact u JOIN contact p ON u.contact_type = p.contact_type AND u.contact_value = p.contact_value WHERE u.entity_type = 'unit' AND p.entity_type = 'provider' GROUP BY ALL)
SELECT l.unit_code, 'Unit ' || l.unit_code AS unit_name, l.provider_cuit, business_name AS provider_name, count(DISTINCT document_number) AS external_contracts_won, shared_contacts FROM l JOIN contract c ON c.provider_cuit = l.provider_cuit JOIN process p ON p.process_number = c.process_number JOIN provider ON cuit = l.provider_cuit WHERE NOT (p.unit_code = l.unit_code AND p.source = l.us) GROUP BY l.unit_code, l.us, l.provider_cuit, business_name, shared_contacts""",
    "contact contract process provider",
)
def _c9(t):
    return checks.cross_agency_proxy(t, TUNED).withColumn("shared_contacts", contacts_text("shared_contacts"))


@query(
    "c10_contact_hub",
    """WITH o AS (SELECT DISTINCT contact_type, contact_value, entity_key, business_name FROM contact JOIN provider ON cuit = entity_key WHERE entity_type = 'provider'),
h AS (SELECT contact_type, contact_value, count(*) AS provider_count, string_agg(entity_key || ' (' || business_name || ')', ';' ORDER BY entity_key || ' (' || business_name || ')') AS member_samples FROM o GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT contact_type, contact_value, arg_max(source_url, {'a': scraped_at, 'b': process_number}) AS ref_url FROM o JOIN bid ON provider_cuit = entity_key JOIN process USING (process_number) GROUP BY ALL)
SELECT contact_type, contact_value, provider_count, member_samples, ref_url FROM h LEFT JOIN r USING (contact_type, contact_value)""",
    "contact provider bid process",
)
def _c10(t):
    return checks.contact_hub(t, TUNED).withColumn("member_samples", F.array_join("member_samples", ";"))


@query(
    "c11_cdi_abuse",
    "WITH u AS (SELECT unit_code, source, count(*) AS total_tenders, count(*) FILTER (process_type_code = 'CDI' OR lower(selection_procedure) LIKE '%directa%') AS cdi_processes FROM process GROUP BY ALL) SELECT unit_code, 'Unit ' || unit_code AS unit_name, total_tenders, cdi_processes, round(100.0::DOUBLE * cdi_processes / total_tenders, 1) AS cdi_pct FROM u WHERE total_tenders >= 10 AND round(100.0::DOUBLE * cdi_processes / total_tenders, 1) >= 30",
    "process",
)
def _c11(t):
    return checks.cdi_abuse(t, TUNED)


@query(
    "c12_round_price_bids",
    "WITH u AS (SELECT provider_cuit, sum(CASE WHEN unit_price % 10000 = 0 THEN 1 ELSE 0 END)::BIGINT AS round_lines, count(*) AS total_lines FROM bid_line JOIN process USING (process_number) WHERE unit_price > 10000 GROUP BY 1) SELECT provider_cuit, business_name AS provider_name, round_lines, total_lines, round(100.0::DOUBLE * round_lines / total_lines, 1) AS round_pct FROM u JOIN provider ON cuit = provider_cuit WHERE total_lines >= 5 AND round(100.0::DOUBLE * round_lines / total_lines, 1) >= 20",
    "bid_line process provider",
)
def _c12(t):
    return checks.round_price_bids(t, TUNED)


@query(
    "c13_spending_spikes",
    f"""WITH {VALUED}, m AS (SELECT strftime(perfection_date, '%Y-%m') AS month, source, CAST(coalesce(sum(real_ars), 0) AS DOUBLE) AS spend, {_CENTS} AS real_ars_spend, string_agg(DISTINCT process_number, ';' ORDER BY process_number) AS processes FROM vc WHERE perfection_date IS NOT NULL AND total_amount > 0 GROUP BY ALL), a AS (SELECT *, avg(spend) OVER (PARTITION BY source) AS mean FROM m)
SELECT month, source, real_ars_spend, round(real_ars_spend / usd, 2) AS real_usd_spend, round(100.0::DOUBLE * (spend - mean) / mean, 1) AS outlier_pct, processes FROM a, usd WHERE mean > 0 AND spend > mean * 1.3::DOUBLE""",
    _V,
)
def _c13(t):
    return checks.spending_spikes(t, TUNED).withColumn("processes", joined("processes", lambda x: x["process_number"]))


@query("c15_cobid_community", written=STORED)
def _c15(t):
    t = network.with_edges(t)
    return groups.cobid_community(t, _tuned(t))


_CC = """cp AS (SELECT p1, p2 FROM sc), nn AS (SELECT p1 AS n FROM cp UNION SELECT p2 FROM cp), ee AS (SELECT p1 AS u, p2 AS v FROM cp UNION SELECT p2, p1 FROM cp),
reach(n, r) AS (SELECT n, n FROM nn UNION SELECT reach.n, ee.v FROM reach JOIN ee ON reach.r = ee.u), cc AS (SELECT n AS node, min(r) AS component FROM reach GROUP BY n)"""



@query(
    "c16_shared_contact_cluster",
    f"""WITH {_SHARED}, {_CC}, b AS (SELECT DISTINCT process_number, provider_cuit FROM bid), w AS (SELECT DISTINCT process_number, provider_cuit FROM contract),
o AS (SELECT component, b.process_number, count(*) AS k FROM cc JOIN b ON provider_cuit = node GROUP BY ALL HAVING count(*) >= 2), z AS (SELECT component, count(*) AS cobid_processes FROM o GROUP BY 1),
x AS (SELECT component, count(DISTINCT w.provider_cuit) AS distinct_winners FROM o JOIN w USING (process_number) JOIN cc USING (component) WHERE w.provider_cuit = cc.node GROUP BY 1), s AS (SELECT component, count(*) AS cluster_size FROM cc GROUP BY 1),
i AS (SELECT component, cluster_size, cobid_processes, coalesce(distinct_winners, 0)::BIGINT AS distinct_winners, row_number() OVER (ORDER BY cobid_processes DESC, cluster_size DESC, component) AS cluster_id FROM s JOIN z USING (component) LEFT JOIN x USING (component))
SELECT cluster_id::INT AS cluster_id, node AS provider_cuit, business_name AS provider_name, cluster_size, cobid_processes, distinct_winners FROM i JOIN cc USING (component) JOIN provider ON cuit = node""",
    "contact bid contract provider",
)
def _c16(t):
    return groups.shared_contact_cluster(t, TUNED).drop("shared_contacts", "co_members")


# ---- network -------------------------------------------------------------------------------------------

_COBID = "bb AS (SELECT DISTINCT process_number, provider_cuit FROM bid JOIN process USING (process_number)), ce AS (SELECT x.provider_cuit AS a, y.provider_cuit AS b, count(*) AS weight FROM bb x JOIN bb y ON x.process_number = y.process_number AND x.provider_cuit < y.provider_cuit GROUP BY ALL)"
#: The strongest pairs: the least weight that at most one pair in twenty reaches, whatever the size of the data.
_STRONG = f"{_COBID}, ws AS (SELECT weight, sum(n) OVER (ORDER BY weight DESC) AS above, sum(n) OVER () AS every FROM (SELECT weight, count(*) AS n FROM ce GROUP BY 1)), se AS (SELECT * FROM ce WHERE weight >= (SELECT coalesce(min(weight) FILTER (above * 20 <= every), max(weight)) FROM ws))"


def _strong_weight(t: Tables) -> int:
    weights = materialize(network.cobid_edges(t, 1, Config()).groupBy("weight").agg(F.count("*").alias("n")), "hist")
    above = F.sum("n").over(Window.orderBy(F.desc("weight")))  # a row for each weight there is
    least = F.coalesce(F.min(F.when(F.col("above") * 20 <= F.col("every"), F.col("weight"))), F.max("weight"))
    return weights.select("weight", above.alias("above"), F.sum("n").over(Window.partitionBy()).alias("every")).agg(least).first()[0] or 1


def _strong(t: Tables) -> DataFrame:
    t = network.with_edges(t)
    return materialize(network.cobid_edges(t, _strong_weight(t), Config()), "strong")


def _tuned(t: Tables) -> Config:
    """The tuned thresholds, those on edges as the data has them."""
    w = _strong_weight(t)
    return replace(TUNED, thresholds=TUNED.thresholds | {"ring_min_cobid_weight": w, "community_min_edge_weight": w})


def _capped(cfg: Config) -> Config:
    """``cfg`` for queries whose SQL has rings in the cores of large components."""
    return replace(cfg, thresholds=cfg.thresholds | {"ring_component_cap": 60})


@query("d1_cobid_edges", f"WITH {_COBID} SELECT * FROM ce WHERE weight >= 2", "bid process")
def _d1(t):
    return network.cobid_edges(t, 2, Config())


@query("d2_contact_pairs", f"WITH {_SHARED} SELECT p1 AS a, p2 AS b, weight, shared_contacts AS contacts FROM sc", "contact")
def _d2(t):
    return network.contact_pairs(t).withColumn("contacts", F.array_join("contacts", ";"))


def _nation_groups(t: Tables) -> DataFrame:
    return t.provider.select((F.col("cuit").cast("long") % 12).cast("string").alias("group_id"), F.col("cuit").alias("member"))


_GROUPS = "gg AS (SELECT CAST(CAST(cuit AS BIGINT) % 12 AS STRING) AS group_id, cuit AS member FROM provider)"


@query(
    "d3_group_outcomes",
    f"WITH {_GROUPS}, bb AS (SELECT DISTINCT process_number, provider_cuit FROM bid JOIN process USING (process_number)) SELECT group_id, b.process_number, string_agg(member, ';' ORDER BY member) AS bidders, coalesce(string_agg(c.provider_cuit, ';' ORDER BY c.provider_cuit), '') AS winners FROM gg JOIN bb b ON member = b.provider_cuit LEFT JOIN contract c ON c.process_number = b.process_number AND c.provider_cuit = member GROUP BY group_id, b.process_number HAVING count(*) >= 2",
    "provider bid process contract",
)
def _d3(t):
    return network.group_outcomes(_nation_groups(t), t, Config()).withColumn("bidders", F.array_join("bidders", ";")).withColumn("winners", F.array_join("winners", ";"))


@query("d4_provider_stats", "SELECT b.provider_cuit, bid_processes, coalesce(won_processes, 0) AS won_processes FROM (SELECT provider_cuit, count(DISTINCT process_number) AS bid_processes FROM bid GROUP BY 1) b LEFT JOIN (SELECT provider_cuit, count(DISTINCT process_number) AS won_processes FROM contract GROUP BY 1) w USING (provider_cuit)", "bid contract process")
def _d4(t):
    return network.provider_stats(t, Config())


@query("d5_connected_components", f"WITH {_SHARED}, {_CC} SELECT * FROM cc", "contact")
def _d5(t):
    return connected_components(network.contact_pairs(t), "a", "b")


@query("d6_communities")
def _d6(t):
    return network.communities(_strong(t))


#: Core numbers by falling h-indices, components, and what :func:`network.peel_to_cap` leaves; forty rounds are more than this graph needs.
_PEELED = f"""{_STRONG}, bw AS (SELECT a AS u, b AS v FROM se UNION ALL SELECT b, a FROM se),
hx(i, node, c) AS (SELECT 0, u, count(*) FROM bw GROUP BY u UNION ALL SELECT * FROM (SELECT i + 1, u, max(least(rk, c)) FROM (SELECT i, u, c, row_number() OVER (PARTITION BY u ORDER BY c DESC) AS rk FROM hx JOIN bw ON v = node WHERE i < 40) GROUP BY i, u)),
cr AS (SELECT node, c AS core FROM hx WHERE i = 40), rs(n, r) AS (SELECT u, u FROM bw UNION SELECT rs.n, bw.v FROM rs JOIN bw ON rs.r = bw.u), cn AS (SELECT n AS node, min(r) AS component FROM rs GROUP BY n),
oc AS (SELECT node, component, core FROM cr JOIN cn USING (node)), sz AS (SELECT component, core, sum(k) OVER (PARTITION BY component ORDER BY core DESC) AS n FROM (SELECT component, core, count(*) AS k FROM oc GROUP BY ALL)), lv AS (SELECT component, coalesce(min(core) FILTER (n <= 60), max(core)) AS least FROM sz GROUP BY 1),
st AS (SELECT node, component FROM oc JOIN lv USING (component) WHERE core >= least), pe AS (SELECT s1.component, a, b, weight FROM se JOIN st s1 ON s1.node = a JOIN st s2 ON s2.node = b)"""


def _cliques_sql(edges: str) -> str:
    """``mc``: the maximal cliques of three to eight nodes in a table of edges."""
    return f"""ad AS (SELECT n, list(m) AS l FROM (SELECT a AS n, b AS m FROM {edges} UNION ALL SELECT b, a FROM {edges}) GROUP BY n),
cl(members) AS (SELECT [a, b] FROM {edges} UNION ALL SELECT list_append(members, n) FROM cl JOIN ad ON n > members[-1] AND list_has_all(l, members)),
mc AS (SELECT members FROM cl WHERE len(members) BETWEEN 3 AND 8 AND NOT EXISTS (SELECT 1 FROM ad WHERE list_has_all(l, members)))"""


_CLIQUES = f"{_PEELED}, {_cliques_sql('pe')}"


def _greedy_sql(order: str) -> str:
    """``took``: of ``ready`` (g, members, ...) the groups that a greedy choice in an order takes, one at a time."""
    return f"""rk AS (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM ready), pk(k, used, ok) AS (SELECT 0::BIGINT, []::VARCHAR[], false UNION ALL SELECT rk.k, CASE WHEN list_has_any(used, members) THEN used ELSE list_concat(used, members) END, NOT list_has_any(used, members) FROM pk JOIN rk ON rk.k = pk.k + 1),
took AS (SELECT rk.* FROM rk JOIN pk USING (k) WHERE ok)"""


_RINGS_OF = f"""gm AS (SELECT array_to_string(members, '|') AS g, unnest(members) AS m FROM mc), bo AS (SELECT g, process_number FROM gm JOIN bb ON provider_cuit = m GROUP BY ALL HAVING count(*) >= 2), sh AS (SELECT g, count(*) AS shared FROM bo GROUP BY g HAVING count(*) >= 5),
gw AS (SELECT gm.g, m, count(c.process_number) AS wins FROM gm LEFT JOIN (SELECT g, c.process_number, provider_cuit FROM bo JOIN (SELECT DISTINCT process_number, provider_cuit FROM contract) c USING (process_number)) c ON c.g = gm.g AND provider_cuit = m GROUP BY ALL),
gt AS (SELECT g, sum(wins) AS total, count(*) AS k FROM gw WHERE wins > 0 GROUP BY g HAVING count(*) >= 2), ro AS (SELECT g, round_even(100.0::DOUBLE * sum(-(wins / total) * ln(wins / total)) / ln(k), 1) AS rotation_pct FROM gw JOIN gt USING (g) WHERE wins > 0 GROUP BY g, k),
sg AS (SELECT x.g, round_even(sum(weight) / count(*), 1) AS cobid_strength FROM se JOIN gm x ON x.m = a JOIN gm y ON y.m = b AND y.g = x.g GROUP BY 1), ready AS (SELECT array_to_string(members, '|') AS g, members, shared, rotation_pct, cobid_strength FROM mc JOIN sh ON sh.g = array_to_string(members, '|') JOIN ro USING (g) JOIN sg USING (g) WHERE rotation_pct >= 45),
{_greedy_sql("rotation_pct DESC, cobid_strength DESC, shared DESC, members")},
ri AS (SELECT row_number() OVER (ORDER BY k)::INT AS ring_id, m AS provider_cuit, business_name AS provider_name, len(members)::INT AS ring_size, shared AS shared_processes, wins AS member_wins, rotation_pct, cobid_strength, members FROM took JOIN gw USING (g) JOIN provider ON cuit = m),
rr AS (SELECT ri.* REPLACE (dense_rank() OVER (ORDER BY rotation_pct DESC, cobid_strength DESC, shared_processes DESC, members)::INT AS ring_id) FROM ri)"""
#: The rings in what :func:`network.peel_to_cap` leaves, as the source has them.
_RINGS = f"{_CLIQUES}, {_RINGS_OF}"
_RING_ROWS = "SELECT * EXCLUDE (members), array_to_string(list_filter(members, lambda x: x <> provider_cuit), ';') AS co_members FROM rr"


@query("c14_bid_rotation_ring", f"WITH {_STRONG}, {_cliques_sql('se')}, {_RINGS_OF} {_RING_ROWS}", "bid process contract provider")
def _c14(t):
    t = network.with_edges(t)
    return groups.bid_rotation_ring(t, _tuned(t)).withColumn("co_members", joined("co_members", lambda x: F.substring_index(x["text"], " ", 1)))


@query("d7_coreness", f"WITH {_PEELED} SELECT node, core FROM cr", "bid process")
def _d7c(t):
    return network.coreness(_strong(t))


@query("d7_k_core", f"WITH {_PEELED} SELECT a, b, weight FROM se WHERE a IN (SELECT node FROM cr WHERE core >= 3) AND b IN (SELECT node FROM cr WHERE core >= 3)", "bid process")
def _d7(t):
    return network.k_core(_strong(t), 3).select("a", "b", "weight")


@query("d7_peel_to_cap", f"WITH {_PEELED} SELECT component, a, b, weight FROM pe", "bid process")
def _d7b(t):
    return network.peel_to_cap(_strong(t), 60)


@query("d8_maximal_cliques", f"WITH {_CLIQUES} SELECT array_to_string(members, ';') AS members, len(members)::INT AS size FROM mc", "bid process")
def _d8(t):
    return network.maximal_cliques(network.peel_to_cap(_strong(t))).select(F.array_join("members", ";").alias("members"), F.size("members").alias("size"))


@query("d9_group_cohesion", f"WITH {_COBID}, {_GROUPS}, i AS (SELECT x.group_id, weight FROM ce JOIN gg x ON x.member = a JOIN gg y ON y.member = b WHERE x.group_id = y.group_id), n AS (SELECT group_id, count(*) AS n FROM gg GROUP BY 1) SELECT group_id, n, count(weight) AS n_edges, coalesce(sum(weight), 0)::BIGINT AS weight, round(coalesce(sum(weight), 0) / (n * (n - 1) / 2), 6) AS density FROM n LEFT JOIN i USING (group_id) GROUP BY group_id, n", "bid process provider")
def _d9(t):
    return network.group_cohesion(_nation_groups(t), network.cobid_edges(t, 1, Config())).select("group_id", "n", "n_edges", "weight", F.round("density", 6).alias("density"))


@query("d9_normalized_entropy", f"WITH {_GROUPS}, w AS (SELECT group_id, member, count(*) AS wins FROM gg JOIN contract ON provider_cuit = member GROUP BY ALL), s AS (SELECT group_id, sum(wins) AS total, count(*) AS k FROM w GROUP BY 1) SELECT group_id, round(CASE WHEN k > 1 THEN sum(-(wins / total) * ln(wins / total)) / ln(k) ELSE 0 END, 6) AS entropy FROM w JOIN s USING (group_id) GROUP BY group_id, k", "provider contract")
def _d9b(t):
    wins = _nation_groups(t).join(t.contract.groupBy(F.col("provider_cuit").alias("member")).agg(F.count("*").alias("wins")), "member")
    return network.normalized_entropy(wins).select("group_id", F.round("entropy", 6).alias("entropy"))


@query("d10_win_distribution", f"WITH {_GROUPS}, bb AS (SELECT DISTINCT process_number, provider_cuit FROM bid JOIN process USING (process_number)), o AS (SELECT group_id, process_number FROM gg JOIN bb ON member = provider_cuit GROUP BY ALL HAVING count(*) >= 2), w AS (SELECT group_id, provider_cuit AS member, count(*) AS wins FROM o JOIN contract USING (process_number) GROUP BY ALL) SELECT group_id, member, coalesce(wins, 0) AS wins FROM gg LEFT JOIN w USING (group_id, member)", "provider bid process contract")
def _d10(t):
    g = _nation_groups(t)
    return network.win_distribution(g, network.group_outcomes(g, t, Config()))


@query("d11_select_disjoint", f"WITH {_CLIQUES}, ready AS (SELECT array_to_string(members, '|') AS g, members FROM mc), {_greedy_sql('len(members) DESC, members')} SELECT g AS group_id, len(members)::INT AS size FROM took", "bid process")
def _d11(t):
    rows = network.maximal_cliques(network.peel_to_cap(_strong(t))).select(F.array_join("members", "|").alias("group_id"), "members", F.size("members").alias("size"))
    return network.select_disjoint(rows, ["size"]).select("group_id", "size")


@query("d12_cobid_degree", f"WITH {_STRONG} SELECT node, count(*) AS degree FROM (SELECT a AS node FROM se UNION ALL SELECT b FROM se) GROUP BY 1", "bid process")
def _d12(t):
    return network.cobid_degree(_strong(t))


@query("d12_betweenness")
def _d12b(t):
    t = network.with_edges(t)
    return network.cobid_centrality(t, _strong_weight(t))


_WON = "won AS (SELECT provider_cuit, c.process_number, unit_code, c.document_number, c.source AS csource, total_amount, currency FROM contract c JOIN process p ON p.process_number = c.process_number)"
_CENT = "CAST(round(sum(CAST(total_amount AS DECIMAL(38,4))), 2) AS DOUBLE)"


@query(
    "d13_provider_graph",
    f"""WITH {_WON}, a AS (SELECT cuit FROM provider), w AS (SELECT provider_cuit AS anchor, process_number, {_CENT} AS amount, min(currency) AS currency FROM won JOIN a ON cuit = provider_cuit GROUP BY ALL), own AS (SELECT DISTINCT entity_key, contact_type || ':' || contact_value AS c FROM contact WHERE entity_type = 'provider')
SELECT anchor, 'provider:' || anchor AS source, 'process:' || process_number AS target, 'WON' AS kind, amount, currency FROM w
UNION ALL SELECT DISTINCT provider_cuit, 'provider:' || provider_cuit, 'process:' || process_number, 'BID', NULL, NULL FROM bid b JOIN a ON cuit = provider_cuit JOIN process USING (process_number) WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.anchor = b.provider_cuit AND w.process_number = b.process_number)
UNION ALL SELECT m.entity_key, 'provider:' || o.entity_key, 'contact:' || m.c, 'CONTACT', NULL, NULL FROM own m JOIN a ON cuit = m.entity_key JOIN own o ON o.c = m.c""",
    "contract process provider bid contact",
)
def _d13(t):
    return network.provider_graph(t, t.provider, Config())


@query(
    "d14_unit_graph",
    f"WITH {_WON} SELECT unit_code AS anchor, 'unit:' || unit_code AS source, 'process:' || process_number AS target, 'MANAGED' AS kind, NULL::DOUBLE AS amount, NULL AS currency FROM process UNION ALL SELECT unit_code, 'provider:' || provider_cuit, 'process:' || process_number, 'WON', {_CENT}, min(currency) FROM won GROUP BY unit_code, provider_cuit, process_number",
    "contract process",
)
def _d14(t):
    return network.unit_graph(t, t.unit, Config())


@query(
    "d15_authorizer_graph",
    f"WITH {_WON}, s AS (SELECT DISTINCT won.*, authorizer FROM won JOIN authorized_by a ON a.document_number = won.document_number AND a.source = won.csource) SELECT DISTINCT authorizer AS anchor, 'authorizer:' || authorizer AS source, 'process:' || process_number AS target, 'AUTHORIZED' AS kind, NULL::DOUBLE AS amount, NULL AS currency FROM s UNION ALL SELECT authorizer, 'provider:' || provider_cuit, 'process:' || process_number, 'WON', {_CENT}, min(currency) FROM s GROUP BY authorizer, provider_cuit, process_number",
    "contract process authorized_by",
)
def _d15(t):
    return network.authorizer_graph(t, t.authorized_by.select(F.col("authorizer").alias("name")), Config())


@query("d16_summarise_graph", f"WITH {_WON}, e AS (SELECT unit_code AS anchor, 'unit:' || unit_code AS s, 'process:' || process_number AS t, 'MANAGED' AS kind FROM process UNION ALL SELECT DISTINCT unit_code, 'provider:' || provider_cuit, 'process:' || process_number, 'WON' FROM won), n AS (SELECT anchor, s AS node FROM e UNION SELECT anchor, t FROM e) SELECT anchor, 'node:' || split_part(node, ':', 1) AS kind, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT anchor, 'edge:' || kind, count(*) FROM e GROUP BY ALL", "contract process")
def _d16(t):
    return network.summarise_graph(network.unit_graph(t, t.unit, Config()), 50)[0]


def _around_providers(t: Tables) -> DataFrame:
    return network.provider_graph(t, t.provider, Config())


_ANCHORED = "e AS (SELECT DISTINCT 'provider:' || provider_cuit AS s, 'process:' || process_number AS t FROM bid JOIN process USING (process_number) UNION SELECT 'provider:' || o.entity_key, 'contact:' || m.contact_type || ':' || m.contact_value FROM contact m JOIN contact o ON o.contact_type = m.contact_type AND o.contact_value = m.contact_value WHERE m.entity_type = 'provider' AND o.entity_type = 'provider'), an AS (SELECT 'provider:' || cuit AS node FROM provider)"


@query("d17_shared_subgraph", f"WITH {_ANCHORED}, d AS (SELECT t, count(*) FILTER (s IN (SELECT node FROM an)) AS na, count(*) AS np FROM e GROUP BY t), h AS (SELECT t FROM d WHERE np >= 2 OR na >= 2) SELECT node FROM an UNION SELECT t FROM h UNION SELECT s FROM e WHERE t IN (SELECT t FROM h)", "bid process contact provider")
def _d17(t):
    return network.shared_subgraph(_around_providers(t), t.provider.select(F.concat(F.lit("provider:"), "cuit").alias("node")))


@query("d18_collapse_leaves", f"WITH {_ANCHORED}, lf AS (SELECT t FROM e GROUP BY t HAVING count(*) = 1 AND t LIKE 'process:%'), m AS (SELECT s, count(*) AS n FROM e WHERE t IN (SELECT t FROM lf) GROUP BY s HAVING count(*) > 12) SELECT s AS source, t AS target, 1::BIGINT AS n FROM e WHERE NOT (t IN (SELECT t FROM lf) AND s IN (SELECT s FROM m)) UNION ALL SELECT s, 'cluster:' || s, n FROM m", "bid process contact provider")
def _d18(t):
    return network.collapse_leaf_processes(network.provider_touches(t, t.provider, Config()), 12)


@query("d21_pair_history", f"WITH {_SHARED}, b AS (SELECT DISTINCT process_number, provider_cuit FROM bid), w AS (SELECT process_number, string_agg(DISTINCT provider_cuit, ';' ORDER BY provider_cuit) AS winners FROM contract GROUP BY 1) SELECT p1 AS a, p2 AS b, process_number, winners FROM sc JOIN b x ON x.provider_cuit = p1 JOIN b y USING (process_number) LEFT JOIN w USING (process_number) WHERE y.provider_cuit = p2", "contact bid contract")
def _d21(t):
    return network.pair_history(t, network.contact_pairs(t).select("a", "b")).withColumn("winners", F.array_join("winners", ";"))


# ---- windows and limits --------------------------------------------------------------------------------


@query("e6_process_window", "SELECT process_number, unit_code FROM process WHERE opening_date >= DATE '1997-03-01' AND opening_date <= DATE '1998-06-30'", "process")
def _e6(t):
    from datetime import date

    return process_window(t.process, Config(date_from=date(1997, 3, 1), date_to=date(1998, 6, 30))).select("process_number", "unit_code")


@query("e7_top_n", "SELECT process_number, provider_cuit, total_amount FROM bid ORDER BY total_amount DESC, process_number, provider_cuit LIMIT 500", "bid")
def _e7(t):
    return top_n(t.bid.select("process_number", "provider_cuit", "total_amount"), [F.desc("total_amount"), F.asc("process_number"), F.asc("provider_cuit")], 500)


# ---- scoring and profiles ------------------------------------------------------------------------------

#: The query of each check whose findings SQL can say too, but for rings and communities.
SAID = {
    "serial_winner": "c1_serial_winner", "authorizer_bias": "c2_authorizer_bias", "authorizer_provider_ring": "c3_authorizer_provider_ring", "uoc_favoritism": "c4_uoc_favoritism",
    "contract_splitting": "c5_contract_splitting", "contract_cost_overrun": "c6_contract_cost_overrun", "cover_bidding": "c7_cover_bidding", "fake_competition": "c8_fake_competition",
    "cross_agency_proxy": "c9_cross_agency_proxy", "contact_hub_multi_provider": "c10_contact_hub", "cdi_abuse": "c11_cdi_abuse", "round_price_bids": "c12_round_price_bids",
    "spending_spikes": "c13_spending_spikes", "shared_contact_cluster": "c16_shared_contact_cluster",
}


#: With the rings, whose SQL looks for cliques, as the queries about syndromes have them.
#: The SQL of rings with the cap, which e14 and e15 hold.
_CAPPED_RINGS = (fixture_map.ctes(*"bid process contract provider".split()) + f",\n{_RINGS} {_RING_ROWS}").replace("WITH ", "WITH RECURSIVE ", 1)
SAID_RINGS = SAID | {"bid_rotation_ring": "c14_bid_rotation_ring"}


def _findings(t: Tables, every: Config | None = None, said: dict[str, str] = SAID) -> dict[str, DataFrame]:
    """The findings of the checks that SQL can say, or of all sixteen by the settings given, each written once.
    They are counted and joined, so they need no order."""
    t = network.with_edges(t) if said is SAID_RINGS and not every else t
    cfg = replace(every or (_capped(_tuned(t)) if said is SAID_RINGS else TUNED), ordered=False)
    t = runs.with_shared(t)
    keys = [k for k in checks.REGISTRY if every or k in said]
    return dict(zip(keys, at_once(lambda k: materialize(checks.REGISTRY[k].run(t, cfg), k), keys)))


def _parts(name: str) -> str:
    """The SQL of a check as nested text."""
    return "(" + (_CAPPED_RINGS if name == "c14_bid_rotation_ring" else ORACLES[name]) + ")"


def _scored_sql(said: dict[str, str] = SAID) -> str:
    weights = scoring.weights(TUNED)
    rows = []
    for key, name in said.items():
        for kind, col, label in checks.REGISTRY[key].entities:
            rows.append(f"SELECT '{kind}' AS entity_type, {col} AS id, {label or col} AS name, '{key}' AS chk, {weights[key]} AS weight FROM {_parts(name)}")
    return " UNION ALL ".join(rows)


def _counted_sql() -> str:
    """(chk, n): findings of each check that SQL can say."""
    return " UNION ALL ".join(f"SELECT '{key}' AS chk, count(*) AS n FROM {_parts(name)}" for key, name in SAID.items())


def _syndrome_sql(flags: str, what: str) -> str:
    """Of the syndromes in which all flags are there: the greatest multiplier, or the labels in order."""
    test = lambda keys: " AND ".join(f"list_contains({flags}, '{k}')" for k in keys)
    if what == "multiplier":
        return "greatest(1.0::DOUBLE, " + ", ".join(f"CASE WHEN {test(k)} THEN {m} ELSE 1.0 END::DOUBLE" for _, k, m in scoring.SYNDROMES) + ")"
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {test(k)} THEN '{label}' END" for label, k, _ in scoring.SYNDROMES) + "], lambda x: x IS NOT NULL), ';')"


def _score_sql(said: dict[str, str]) -> tuple[str, str]:
    """CTEs of the attributed findings, and of the scores on top of them."""
    attr = f"att AS ({_scored_sql(said)}), pc AS (SELECT entity_type, id, chk, weight, count(*) AS n, min(name) AS name FROM att GROUP BY ALL)"
    return attr, f"""{attr}, sb AS (SELECT entity_type, id, min(name) AS name, sum(weight * least(1.0::DOUBLE, log2(n + 1) / log2(11)) ORDER BY weight * least(1.0::DOUBLE, log2(n + 1) / log2(11))) AS base, count(*) AS confidence, list(chk ORDER BY chk) AS fl FROM pc GROUP BY ALL),
sm AS (SELECT *, CASE WHEN entity_type = 'provider' THEN {_syndrome_sql('fl', 'multiplier')} ELSE 1.0 END AS mult, CASE WHEN entity_type = 'provider' THEN {_syndrome_sql('fl', 'labels')} ELSE '' END AS syndromes FROM sb),
sc AS (SELECT entity_type, id, name, least(round_even(base * mult, 0), 100)::INT AS score, least(round_even(base, 0), 100)::INT AS base_score, confidence::INT AS confidence, array_to_string(fl, ';') AS flags, mult, syndromes FROM sm)"""


_ATTR, _SCORE = _score_sql(SAID)
_SCORE_RINGS = _score_sql(SAID_RINGS)[1]
_SCORED = "entity_type, id, name, score, base_score, confidence, flags"


@query("e1_attribute", f"WITH {_ATTR} SELECT entity_type, id, name, chk AS \"check\" FROM att", written=STORED)
def _e1(t):
    return scoring.attributed(_findings(t)).select("entity_type", "id", "name", "check")


@query("e2_intensity", "SELECT provider_cuit, count(*) AS n, round(least(1.0::DOUBLE, log2(count(*) + 1) / log2(11)), 6) AS intensity FROM contract GROUP BY 1", "contract")
def _e2(t):
    return t.contract.groupBy("provider_cuit").agg(F.count("*").alias("n")).withColumn("intensity", F.round(scoring.intensity(F.col("n")), 6))


@query("e3_syndromes", "SELECT cuit, CASE WHEN c % 2 = 0 AND c % 3 = 0 THEN 1.6 WHEN c % 5 = 0 AND c % 3 = 0 THEN 1.45 WHEN c % 7 = 0 AND c % 11 = 0 THEN 1.4 ELSE 1.0 END::DOUBLE AS multiplier FROM (SELECT cuit, CAST(cuit AS BIGINT) AS c FROM provider)", "provider")
def _e3(t):
    n = F.col("cuit").cast("long")
    marks = ((2, "bid_rotation_ring"), (3, "shared_contact_cluster"), (5, "fake_competition"), (7, "serial_winner"), (11, "cover_bidding"))
    flags = F.array_compact(F.array(*(F.when(n % k == 0, flag) for k, flag in marks)))
    return t.provider.select("cuit", scoring.syndrome_multiplier(flags).alias("multiplier"))


@query("e4_entity_scores", f"WITH {_SCORE} SELECT {_SCORED} FROM sc", written=STORED)
def _e4(t):
    return scoring.all_scores(_findings(t), TUNED).select("entity_type", "id", "name", "score", "base_score", "confidence", F.array_join("flags", ";").alias("flags"))


@query("e5_all_scores", written=STORED)
def _e5(t):
    """All sixteen checks, with the centrality of providers recorded beside the score."""
    t = network.with_edges(t)
    cfg = _tuned(t)
    jobs = (lambda: _findings(t, cfg), lambda: materialize(network.cobid_centrality(t, cfg.thresholds["community_min_edge_weight"]), "e5"))
    findings, centrality = at_once(lambda job: job(), jobs)
    return scoring.all_scores(findings, cfg, centrality)


@query("e12_company_profiles", f"WITH {_SCORE} SELECT id, score, n::INT AS n_checks FROM sc JOIN (SELECT id, count(DISTINCT chk) AS n FROM att WHERE entity_type = 'provider' GROUP BY 1) USING (id) WHERE entity_type = 'provider'", written=STORED)
def _e12(t):
    f = _findings(t)
    out = profiles.company_profiles(scoring.attributed(f), scoring.all_scores(f, TUNED))
    return out.select("id", "score", F.size(F.array_distinct(F.transform("findings", lambda x: x["check"]))).alias("n_checks"))


@query("e13_entity_profiles", f"WITH {_ATTR}, tt AS (SELECT unit_code AS id, max(n) AS total_tenders FROM (SELECT unit_code, total_tenders AS n FROM {_parts('c11_cdi_abuse')} UNION ALL SELECT unit_code, total_awarded_in_unit FROM {_parts('c4_uoc_favoritism')}) GROUP BY 1) SELECT id, name, coalesce(total_tenders, 0) AS total_tenders, n_findings FROM (SELECT id, min(name) AS name, count(*) AS n_findings FROM att WHERE entity_type = 'unit' GROUP BY 1) LEFT JOIN tt USING (id)", written=STORED)
def _e13(t):
    return profiles.entity_profiles(scoring.attributed(_findings(t)), "unit").select("id", "name", "total_tenders", "n_findings")


@query("e14_rank_entities", f"WITH {_SCORE_RINGS} SELECT id, score AS risk_score, confidence, mult > 1 AS has_synergy, c AS check_counts FROM sc JOIN (SELECT entity_type, id, string_agg(chk || ':' || n, ';' ORDER BY chk) AS c FROM pc GROUP BY ALL) USING (entity_type, id) WHERE entity_type = 'provider'", written=STORED)
def _e14(t):
    f = _findings(t, said=SAID_RINGS)
    out = profiles.rank_entities(scoring.attributed(f), scoring.all_scores(f, TUNED), TUNED, "provider")
    entries = F.transform(F.map_entries("check_counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return out.withColumn("check_counts", F.array_join(F.array_sort(entries), ";"))


@query("e15_risk_breakdown", f"WITH {_SCORE_RINGS} SELECT entity_type, id, score, syndromes FROM sc WHERE entity_type = 'provider'", written=STORED)
def _e15(t):
    out = profiles.risk_breakdown(scoring.all_scores(_findings(t, said=SAID_RINGS), TUNED).filter("entity_type = 'provider'"), t.provider.select(F.col("cuit").alias("id")))
    return out.select("entity_type", "id", "score", F.array_join("syndromes", ";").alias("syndromes"))


@query(
    "e16_dashboard_stats",
    f"""WITH {_SCORE}, p AS (SELECT * FROM sc WHERE entity_type = 'provider') SELECT 'bucket' AS section, CASE WHEN score >= 80 THEN '81-100' WHEN score >= 60 THEN '61-80' WHEN score >= 40 THEN '41-60' WHEN score >= 20 THEN '21-40' ELSE '0-20' END AS label, count(*) AS value FROM p GROUP BY ALL
UNION ALL SELECT 'top', id, score FROM (SELECT id, score FROM p ORDER BY score DESC, id LIMIT 10)
UNION ALL SELECT 'check', chk, n FROM ({_counted_sql()})
UNION ALL SELECT * FROM (SELECT 'flag', flag, count(*) AS k FROM (SELECT unnest(string_split(flags, ';')) AS flag FROM p) GROUP BY flag ORDER BY k DESC, flag LIMIT 15)
UNION ALL SELECT 'total', 'entities', count(*) FROM p UNION ALL SELECT 'total', 'units', count(DISTINCT id) FROM att WHERE entity_type = 'unit'""",
    written=STORED,
)
def _e16(t):
    f = _findings(t)
    return profiles.dashboard_stats(scoring.attributed(f), scoring.all_scores(f, TUNED), f)


@query("e17_search_scores", f"WITH {_SCORE} SELECT entity_type, id, score FROM sc WHERE score >= 10 AND score <= 90 AND contains(flags, 'uoc_favoritism') ORDER BY score DESC, entity_type, id LIMIT 20 OFFSET 20", written=STORED)
def _e17(t):
    return profiles.search_scores(scoring.all_scores(_findings(t), TUNED), None, 10, 90, "uoc_favoritism", 2, 20).select("entity_type", "id", "score")


@query("e17_distinct_flags", f"WITH {_SCORE} SELECT DISTINCT unnest(string_split(flags, ';')) AS flag FROM sc", written=STORED)
def _e17b(t):
    return profiles.distinct_flags(scoring.all_scores(_findings(t), TUNED))


@query("e18_search_findings", f"SELECT process, document_number, overrun_pct FROM {_parts('c6_contract_cost_overrun')} WHERE lower(concat_ws(' ', provider_cuit, provider_name, unit_code, unit_name)) LIKE '%0000001%' OR process LIKE '%0000001%'")
def _e18(t):
    return profiles.search_findings(checks.contract_cost_overrun(t, TUNED), "0000001").select("process", "document_number", "overrun_pct")


@query("e19_trim_findings", f"WITH {_ATTR} SELECT entity_type, id, chk AS \"check\", n AS total, least(n, 3) AS shown FROM pc", written=STORED)
def _e19(t):
    return profiles.trim_findings(scoring.attributed(_findings(t)), 3).groupBy("entity_type", "id", "check", "total").agg(F.count("*").alias("shown"))


@query("e20_search_processes", "WITH p AS (SELECT process_number, opening_date AS opening, unit_code FROM process ORDER BY opening_date DESC NULLS LAST, process_number LIMIT 200) SELECT process_number, strftime(opening, '%Y-%m-%d') AS opening, unit_code, (SELECT string_agg(DISTINCT provider_cuit, ';' ORDER BY provider_cuit) FROM contract c WHERE c.process_number = p.process_number) AS winners, (SELECT count(*) FROM bid b WHERE b.process_number = p.process_number) AS n_bids FROM p", "process contract bid")
def _e20(t):
    out = profiles.search_processes(t, Config(), units=t.unit, limit=200)
    return out.withColumn("winners", F.array_join("winners", ";")).withColumn("opening", F.col("opening").cast("string"))


@query(
    "e21_process_detail",
    """WITH n AS (SELECT process_number FROM process), b AS (SELECT process_number, string_agg(provider_cuit || ':' || CAST(CAST(total_amount AS DECIMAL(38,2)) AS VARCHAR), ';' ORDER BY total_amount, provider_cuit) AS bids FROM bid GROUP BY 1), c AS (SELECT process_number, string_agg(document_number || ':' || authorizer, ';' ORDER BY document_number) AS contracts FROM contract JOIN authorized_by USING (document_number, source) GROUP BY 1), l AS (SELECT process_number, count(*) AS n_lines FROM bid_line GROUP BY 1),
aw AS (SELECT process_number, source, sequence, string_agg(provider_cuit || '=' || business_name || CASE WHEN is_primary THEN '*' ELSE '' END, ',' ORDER BY merit_order NULLS FIRST, provider_cuit) AS t FROM pre_award JOIN provider ON cuit = provider_cuit GROUP BY ALL),
rj AS (SELECT process_number, source, sequence, string_agg(provider_cuit || '=' || reason, ',' ORDER BY provider_cuit) AS t FROM rejection GROUP BY ALL), sg AS (SELECT process_number, source, sequence, string_agg(username || '=' || role, ',' ORDER BY username) AS t FROM opinion_signer GROUP BY ALL),
op AS (SELECT process_number, string_agg(sequence || ':' || coalesce(strftime(issue_date, '%Y-%m-%d'), '') || ':' || CAST(CAST(pre_award_total AS DECIMAL(38,2)) AS VARCHAR) || '(' || coalesce(aw.t, '') || '|' || coalesce(rj.t, '') || '|' || coalesce(sg.t, '') || ')', ';' ORDER BY sequence) AS opinions FROM opinion LEFT JOIN aw USING (process_number, source, sequence) LEFT JOIN rj USING (process_number, source, sequence) LEFT JOIN sg USING (process_number, source, sequence) GROUP BY 1)
SELECT process_number, bids, contracts, coalesce(n_lines, 0) AS n_lines, opinions FROM n LEFT JOIN b USING (process_number) LEFT JOIN c USING (process_number) LEFT JOIN l USING (process_number) LEFT JOIN op USING (process_number)""",
    "process bid contract authorized_by bid_line opinion pre_award rejection opinion_signer provider",
)
def _e21(t):
    out = profiles.process_detail(t, t.process)
    awards = lambda o: joined(o["pre_adjudicated"], lambda p: F.concat(p["provider_cuit"], F.lit("="), p["name"], F.when(p["is_primary"], "*").otherwise("")), ",")
    rejected = lambda o: joined(o["rejected"], lambda r: F.concat(r["provider_cuit"], F.lit("="), F.array_join(r["reasons"], "+")), ",")
    signers = lambda o: joined(o["signers"], lambda x: F.concat(x["username"], F.lit("="), x["role"]), ",")
    text = lambda o: F.concat(o["sequence"].cast("string"), F.lit(":"), F.coalesce(o["issue_date"].cast("string"), F.lit("")), F.lit(":"), dec2(o["pre_award_total"]), F.lit("("), awards(o), F.lit("|"), rejected(o), F.lit("|"), signers(o), F.lit(")"))
    return out.select("process_number", joined("bids", lambda b: F.concat(b["provider_cuit"], F.lit(":"), dec2(b["amount"]))).alias("bids"), joined("contracts", lambda c: F.concat(c["document_number"], F.lit(":"), F.array_join(c["authorizers"], "+"))).alias("contracts"), "n_lines", joined("opinions", text).alias("opinions"))


@query("e22_findings_for_process", f"WITH r AS (SELECT process AS process_number, 'contract_cost_overrun' AS \"check\" FROM {_parts('c6_contract_cost_overrun')} UNION ALL SELECT process_number, 'cover_bidding' FROM {_parts('c7_cover_bidding')} UNION ALL SELECT process_number, 'fake_competition' FROM {_parts('c8_fake_competition')} UNION ALL SELECT unnest(string_split(processes, ';')), 'contract_splitting' FROM {_parts('c5_contract_splitting')} UNION ALL SELECT unnest(string_split(processes, ';')), 'spending_spikes' FROM {_parts('c13_spending_spikes')}) SELECT process_number, \"check\", count(*) AS n FROM r GROUP BY ALL", written=STORED)
def _e22(t):
    return profiles.findings_for_process(_findings(t), t.process.select("process_number")).groupBy("process_number", "check").agg(F.count("*").alias("n"))


@query("e23_detection_status", f"WITH {_SCORE} SELECT 'scored' AS kind, entity_type AS name, count(*) AS n FROM sc GROUP BY ALL UNION ALL SELECT 'check', chk, n FROM ({_counted_sql()})", written=STORED)
def _e23(t):
    f = _findings(t)
    return profiles.detection_status(f, scoring.all_scores(f, TUNED))


@query("e23_graph_counts", "SELECT 'node' AS kind, 'Process' AS name, count(*) AS n FROM process UNION ALL SELECT 'node', 'ContractingUnit', count(*) FROM unit UNION ALL SELECT 'node', 'Provider', count(*) FROM provider UNION ALL SELECT 'node', 'Bid', count(*) FROM bid UNION ALL SELECT 'node', 'BidLine', count(*) FROM bid_line UNION ALL SELECT 'node', 'ContractualDocument', count(*) FROM contract UNION ALL SELECT 'edge', 'HAS_BID', count(*) FROM bid UNION ALL SELECT 'edge', 'AWARDED_TO', count(*) FROM contract UNION ALL SELECT 'edge', 'AUTHORIZED_BY', count(*) FROM authorized_by UNION ALL SELECT 'edge', 'MANAGED_BY', count(*) FROM process WHERE unit_code IS NOT NULL", "process unit provider bid bid_line contract authorized_by")
def _e23b(t):
    return profiles.graph_counts(t)


@query("e24_top_awardees", f"SELECT provider_cuit, count(*) AS contracts, {_CENT} AS amount FROM contract GROUP BY 1 ORDER BY amount DESC, provider_cuit LIMIT 20", "contract")
def _e24(t):
    return profiles.top_awardees(t)


@query("e24_processes_without_bids", "SELECT process_number, source, unit_code FROM process WHERE process_number NOT IN (SELECT process_number FROM bid)", "process bid")
def _e24b(t):
    return profiles.processes_without_bids(t)


@query("e24_buyer_chain", "SELECT unit_code, c.provider_cuit, count(DISTINCT c.process_number) AS processes, count(*) AS contracts FROM contract c JOIN process p ON p.process_number = c.process_number GROUP BY ALL", "contract process")
def _e24c(t):
    return profiles.buyer_chain(t)


# ---- group findings around providers --------------------------------------------------------------------


@query("d19_network_neighborhood", written=STORED)
def _d19(t):
    t = network.with_edges(t)
    cfg = _tuned(t)
    keys = ("bid_rotation_ring", "shared_contact_cluster", "cobid_community", "authorizer_provider_ring")
    jobs = {k: lambda k=k: checks.REGISTRY[k].run(t, cfg) for k in keys} | {"centrality": lambda: network.cobid_centrality(t, cfg.thresholds["community_min_edge_weight"])}
    found = dict(zip(jobs, at_once(lambda job: materialize(job(), "d19"), jobs.values())))
    return groups.network_neighborhood(found, t.provider, found.pop("centrality"))


@query(
    "d20_related_providers",
    f"""WITH {_RINGS}, {_SHARED}, {_CC}, b2 AS (SELECT component FROM cc JOIN bb ON provider_cuit = node GROUP BY component, process_number HAVING count(*) >= 2), gg AS (SELECT 'ring' AS chk, ring_id::VARCHAR AS g, provider_cuit AS p FROM rr UNION ALL SELECT 'cluster', component, node FROM cc WHERE component IN (SELECT component FROM b2)),
l AS (SELECT x.p AS cuit, y.p AS related, count(*) AS links FROM gg x JOIN gg y ON x.chk = y.chk AND x.g = y.g WHERE x.p <> y.p GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY cuit ORDER BY links DESC, related)::INT AS rank FROM l""",
    "bid process contract provider contact",
    written=STORED,
)
def _d20(t):
    """Over rings and contact clusters; communities, which SQL cannot say, are in ``d20_related_all``."""
    t = network.with_edges(t)
    cfg = replace(_capped(_tuned(t)), ordered=False)
    keys = ("bid_rotation_ring", "shared_contact_cluster")
    found = dict(zip(keys, at_once(lambda k: materialize(checks.REGISTRY[k].run(t, cfg), "d20"), keys)))
    return groups.related_providers(found, t.provider)


@query("d20_related_all", written=STORED)
def _d20b(t):
    """Over all three group checks."""
    t = network.with_edges(t)
    cfg = replace(_tuned(t), ordered=False)
    keys = list(groups.GROUP_CHECKS)
    found = dict(zip(keys, at_once(lambda k: materialize(checks.REGISTRY[k].run(t, cfg), "d20"), keys)))
    return groups.related_providers(found, t.provider)


# ---- snapshots, streaming, runs: through files in the shared folder ---------------------------------------


def _folder(t: Tables, tag: str) -> str:
    return f"{shared_dir(t.process.sparkSession)}/{tag}-{uuid.uuid4().hex}"


@query("a1_read_snapshot", "SELECT process_number, source, unit_code FROM process", "process")
def _a1(t):
    path = _folder(t, "snap")
    snapshot.write_snapshot({"Process": (t.process.select("process_number", "source", "unit_code"), "process_number")}, {}, path)
    return snapshot.read_nodes(t.process.sparkSession, path, "Process", "process_number: string, source: string, unit_code: string").drop("id")


@query("a2_write_snapshot", "SELECT 'node' AS kind, 'Provider' AS name, count(*) AS rows FROM provider UNION ALL SELECT 'node', 'Authorizer', count(DISTINCT authorizer) FROM authorized_by UNION ALL SELECT 'relation', 'AUTHORIZED_BY', count(*) FROM authorized_by", "provider authorized_by")
def _a2(t):
    people = t.authorized_by.select(F.col("authorizer").alias("full_name"), F.lit("1").alias("document_number")).distinct()
    rel = t.authorized_by.select(F.concat(F.lit("ContractualDocument:"), "document_number").alias("start"), F.concat(F.lit("Authorizer:"), "authorizer").alias("end"))
    return snapshot.write_snapshot({"Provider": (t.provider, "cuit"), "Authorizer": (people, "full_name")}, {"AUTHORIZED_BY": rel}, _folder(t, "snap"))


@query("a23_incremental_ingest", f"WITH u AS ({_UPDATES}) SELECT process_number, arg_max(status, seq) FILTER (status IS NOT NULL) AS status, arg_max(source_url, seq) FILTER (source_url IS NOT NULL) AS source_url FROM u GROUP BY process_number", "process")
def _a23(t):
    spark, path = t.process.sparkSession, _folder(t, "stream")
    schema = "process_number string, status string, source_url string, seq int"
    for n in (1, 2):  # the bundles land in two parts, and the stream runs after each
        _updates(t).filter(F.col("seq") == n).write.json(f"{path}/land/b{n}")
        incremental.incremental_ingest(incremental.stream_bundles(spark, f"{path}/land/*", schema), f"{path}/table", ["process_number"], f"{path}/check").awaitTermination()
    return incremental.current(spark, f"{path}/table", "process_number string, status string, source_url string", ["process_number"])


def _persisted(t: Tables, every: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, attributed findings, scores) of a stored run of the checks that SQL can say too, or of all.  A check
    that failed has no findings, which would look like one that found none, so it is an error here."""
    spark, path = t.process.sparkSession, _folder(t, "run")
    t = network.with_edges(t) if every else t
    cfg = _tuned(t) if every else replace(TUNED, disabled=frozenset(set(checks.REGISTRY) - set(SAID)))
    status = runs.persist_run(spark, t, cfg, path, "r1")
    line = status.first()
    if line["state"] != runs.DONE:
        raise RuntimeError(f"checks failed: {line['error']}")
    return status, *runs.read_run(spark, path, runs.latest_run(spark, path))


@query("e8_run_detection", f"WITH {_ATTR} SELECT chk AS \"check\", count(*) AS n FROM att GROUP BY 1", written=STORED)
def _e8(t):
    return _persisted(t)[1].groupBy("check").agg(F.count("*").alias("n"))


@query("e10_persist_run", f"WITH {_SCORE} SELECT entity_type, id, score FROM sc", written=STORED)
def _e10(t):
    return _persisted(t)[2].select("entity_type", "id", "score")


@query("e11_run_status", "SELECT 'r1' AS run_id, 'done' AS state, count(*) AS processes, false AS windowed, 0 AS n_failed, 0 AS n_at_limit FROM process", "process", written=STORED)
def _e11(t):
    return _persisted(t)[0].select("run_id", "state", "processes", "windowed", F.size("failed").alias("n_failed"), F.size("at_limit").alias("n_at_limit"))


@query("e8_run_all_checks", written=STORED)
def _e8b(t):
    """A stored run of all sixteen checks."""
    return _persisted(t, True)[1].groupBy("check").agg(F.count("*").alias("n"))


@query(
    "e11_should_rerun",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (status <> 'P') AS early FROM process) SELECT run_id, state, windowed, processes, answers, answers AND n - early >= 500 AS again
FROM (SELECT 'old' AS run_id, 'done' AS state, false AS windowed, early AS processes, true AS answers, * FROM c UNION ALL SELECT 'part', 'done', true, n, false, * FROM c UNION ALL SELECT 'lost', 'failed', false, n, false, * FROM c)""",
    "process",
)
def _e11b(t):
    """The ledger of three runs: over the processes that were closed, over some dates, and one that failed.  Only
    the first answers for a run over all dates; whether there is to be another follows from the counts."""
    from datetime import date

    spark, path = t.process.sparkSession, _folder(t, "runs")
    cfg = Config(disabled=frozenset(set(checks.REGISTRY) - {"cdi_abuse"}))
    runs.persist_run(spark, replace(t, process=t.process.filter("status <> 'P'")), cfg, path, "old")
    runs.persist_run(spark, t, replace(cfg, date_from=date(1997, 1, 1)), path, "part")
    try:
        runs.persist_run(spark, replace(t, price_index=t.price_index.withColumn("index_value", F.raise_error(F.lit("no index")).cast("double"))), cfg, path, "lost")
    except Exception as e:
        if "no index" not in str(e):
            raise
    last = runs.latest_run(spark, path)
    lines = runs.ledger(spark, path)
    at = lines.filter(F.col("run_id") == last).first()["processes"]
    again = runs.should_rerun(t.process.count(), at, cfg)
    answers = F.col("run_id") == last
    return lines.select("run_id", "state", "windowed", "processes", answers.alias("answers"), (answers & F.lit(again)).alias("again"))
