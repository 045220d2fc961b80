"""Procurement tables derived from order data, by text that Spark and DuckDB both run.

``{name}`` refers to another table of the list or to an input; ``@range(n)`` is a table of ids below n and
``@array(x)`` a list of one.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tenderlens.operators.ingest import build_price_index
from tenderlens.plans.staging import bucketed, materialize
from tenderlens.plans.tables import Tables

#: Where the index of the mapped tables changes from the chained series to the official one.
OFFICIAL_FROM = date(1998, 1, 1)
INPUTS = ("orders", "lineitem", "customer", "supplier", "nation")
#: Tables that are stored by process, in buckets of about so many order lines.
BY_PROCESS = ("process", "bid", "bid_line", "contract")
BUCKET_LINES = 1_000_000

STEPS: list[tuple[str, str]] = [
    (
        "process",
        """SELECT CAST(o_orderkey AS STRING) AS process_number,
  CASE WHEN o_orderkey % 5 = 0 THEN 'contratar' ELSE 'comprar' END AS source,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'CDI' ELSE 'LPR' END AS process_type_code,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'Contratacion Directa' ELSE 'Licitacion' END AS selection_procedure,
  o_orderstatus AS status,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS opening_date,
  CAST(NULL AS DATE) AS scheduled_date, CAST(NULL AS DATE) AS gazette_date, CAST(o_orderdate AS DATE) AS scraped_at,
  'Purchase ' || CAST(o_custkey AS STRING) AS descriptive_name,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN @array('USD') ELSE @array('ARS') END AS currencies,
  CAST(c_nationkey AS STRING) || '-' || substr(c_mktsegment, 1, 3) AS unit_code,
  'OFFICIAL ' || CAST(o_custkey % 300 AS STRING) AS authorizer,
  'http://portal.example/' || CAST(o_orderkey AS STRING) AS source_url
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    ),
    (
        "unit_codes",
        """SELECT unit_code AS code, dense_rank() OVER (ORDER BY unit_code) AS rnk
FROM (SELECT DISTINCT CAST(c_nationkey AS STRING) || '-' || substr(c_mktsegment, 1, 3) AS unit_code FROM {customer}) c""",
    ),
    ("unit", "SELECT code, s.source AS source, 'Unit ' || code AS name, rnk FROM {unit_codes} CROSS JOIN (SELECT 'comprar' AS source UNION ALL SELECT 'contratar' AS source) s"),
    ("provider", "SELECT CAST(s_suppkey AS STRING) AS cuit, s_name AS business_name FROM {supplier}"),
    (
        "bid",
        """SELECT CAST(l_orderkey AS STRING) AS process_number, CAST(l_suppkey AS STRING) AS provider_cuit,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount,
  CASE WHEN l_suppkey % 10 = 9 THEN NULL WHEN l_suppkey % 4 = 0 THEN 'USD' ELSE 'ARS' END AS currency,
  CAST(NULL AS DATE) AS submitted_at
FROM {lineitem} GROUP BY l_orderkey, l_suppkey""",
    ),
    (
        "bid_line",
        """SELECT CAST(l_orderkey AS STRING) AS process_number, CAST(l_suppkey AS STRING) AS provider_cuit, l_linenumber AS line_number, l_partkey AS alternative_number, CAST(l_quantity * 2000 AS DOUBLE) AS unit_price, l_quantity AS offered_quantity,
  l_extendedprice AS total_per_line, CASE l_linenumber WHEN 2 THEN 'USD' WHEN 3 THEN '-' WHEN 4 THEN 'ARS' END AS currency FROM {lineitem}""",
    ),
    (
        "ranked_bid",
        """SELECT b.*, row_number() OVER (PARTITION BY process_number ORDER BY total_amount, CAST(provider_cuit AS BIGINT)) AS k FROM {bid} b""",
    ),
    (
        "line_facts",
        """SELECT CAST(l_orderkey AS STRING) AS process_number, max(CAST(l_shipdate AS DATE)) AS shipped, max(l_discount) AS discount, max(l_tax) AS tax FROM {lineitem} GROUP BY l_orderkey""",
    ),
    (
        "contract",
        """SELECT 'DOC-' || p.process_number AS document_number, p.source, p.process_number, b.provider_cuit, b.total_amount, b.currency,
  b.total_amount * (1 + f.tax * 4) AS current_amount,
  CASE WHEN CAST(p.process_number AS BIGINT) % 3 = 0 THEN NULL ELSE round(f.discount * 400, 1) END AS variation_pct,
  CASE WHEN CAST(p.process_number AS BIGINT) % 53 = 0 THEN NULL ELSE f.shipped END AS perfection_date,
  CASE WHEN CAST(p.process_number AS BIGINT) % 13 = 0 THEN 'USD' END AS extension_currency,
  CASE WHEN CAST(p.process_number AS BIGINT) % 4 = 0 THEN b.total_amount * 0.25 END AS max_extendable_amount, CASE WHEN CAST(p.process_number AS BIGINT) % 8 = 0 THEN b.total_amount * 0.125 END AS available_extension_amount
FROM {process} p JOIN {ranked_bid} b ON p.process_number = b.process_number AND b.k = 1 JOIN {line_facts} f ON f.process_number = p.process_number
WHERE p.status <> 'P'""",
    ),
    (
        "contract_line",
        """SELECT c.document_number, c.source, l.line_number, l.alternative_number, l.unit_price, l.total_per_line AS total_price, l.currency
FROM {contract} c JOIN {bid_line} l ON l.process_number = c.process_number AND l.provider_cuit = c.provider_cuit""",
    ),
    (
        "provision_request",
        """SELECT 'SPR-' || process_number AS request_number, document_number AS oca_number, CASE WHEN CAST(process_number AS BIGINT) % 30 <> 0 THEN process_number END AS process_number, provider_cuit,
  CASE WHEN CAST(process_number AS BIGINT) % 12 <> 0 THEN CAST(perfection_date + CAST(30 AS INT) AS DATE) END AS created_at, total_amount * 0.5 AS total_amount, currency
FROM {contract} WHERE CAST(process_number AS BIGINT) % 6 = 0""",
    ),
    (
        "provision_line",
        """SELECT r.request_number, l.line_number, l.alternative_number, l.unit_price, l.total_price * 0.5 AS total_price, CAST(NULL AS STRING) AS currency
FROM {provision_request} r JOIN {contract_line} l ON l.document_number = r.oca_number""",
    ),
    (
        "opinion",
        """SELECT p.process_number, p.source, CAST(n.k AS INT) AS sequence, p.opening_date AS issue_date, b.total_amount AS pre_award_total, b.currency
FROM {process} p JOIN {ranked_bid} b ON b.process_number = p.process_number AND b.k = 1 CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) n WHERE CAST(p.process_number AS BIGINT) % 9 IN (0, 1, 2) AND (n.k = 1 OR CAST(p.process_number AS BIGINT) % 9 = 0)""",
    ),
    (
        "pre_award",
        """SELECT o.process_number, o.source, o.sequence, b.provider_cuit, b.k = 1 AS is_primary, CASE WHEN b.k > 1 THEN CAST(b.k AS INT) END AS merit_order
FROM {opinion} o JOIN {ranked_bid} b ON b.process_number = o.process_number WHERE b.k <= 2""",
    ),
    (
        "rejection",
        """SELECT o.process_number, o.source, o.sequence, b.provider_cuit, 'reason ' || b.provider_cuit AS reason
FROM {opinion} o JOIN {ranked_bid} b ON b.process_number = o.process_number WHERE b.k >= 4""",
    ),
    (
        "opinion_signer",
        """SELECT o.process_number, o.source, o.sequence, 'user' || CAST(CAST(o.process_number AS BIGINT) % 50 + s.k AS STRING) AS username, CASE s.k WHEN 0 THEN 'chair' ELSE 'member' END AS role
FROM {opinion} o CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) s WHERE CAST(o.process_number AS BIGINT) % 2 = 0""",
    ),
    ("authorized_by", "SELECT c.document_number, c.source, p.authorizer FROM {contract} c JOIN {process} p ON c.process_number = p.process_number"),
    ("n_suppliers", "SELECT CASE WHEN floor(count(*) * 2 / 5) > 3 THEN CAST(floor(count(*) * 2 / 5) AS BIGINT) ELSE 3 END AS n FROM {supplier}"),
    (
        "contact",
        """SELECT 'provider' AS entity_type, CAST(s_suppkey AS STRING) AS entity_key, CAST(NULL AS STRING) AS source, 'Phone' AS contact_type, CAST(s_suppkey % n AS STRING) AS contact_value FROM {supplier} CROSS JOIN {n_suppliers}
UNION ALL SELECT 'provider', CAST(s_suppkey AS STRING), NULL, 'Email', CAST(s_nationkey AS STRING) || '-' || CAST(CAST(floor(s_acctbal / 1000) AS BIGINT) AS STRING) FROM {supplier} WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'unit', code, source, 'Phone', CAST(rnk % 200 AS STRING) FROM {unit}""",
    ),
    ("official_index", "SELECT 'official' AS series_id, make_date(CAST(1995 + floor(id / 12) AS INT), CAST(1 + id % 12 AS INT), 1) AS period, CAST(28 + 2 * id AS DOUBLE) AS index_value FROM @range(80) WHERE id >= 36"),
    ("monthly_variation", "SELECT id, make_date(CAST(1995 + floor(id / 12) AS INT), CAST(1 + id % 12 AS INT), 1) AS period, CAST(1 + 0.5 * (id % 4) AS DOUBLE) AS pct FROM @range(37) WHERE id >= 1"),
    (
        "price_index",
        """SELECT series_id, period, index_value FROM {official_index} UNION ALL
SELECT 'chained', make_date(CAST(1995 + floor((id - 1) / 12) AS INT), CAST(1 + (id - 1) % 12 AS INT), 1), round(100 * exp(-sum(ln(1 + pct / 100)) OVER (ORDER BY id DESC)), 6) FROM {monthly_variation}""",
    ),
    (
        "fx_rate",
        """SELECT 'USD' AS currency, CAST(DATE '1995-01-01' + CAST(id AS INT) AS DATE) AS observed_date, CAST(1 + 0.25 * floor(id / 7) AS DOUBLE) AS rate FROM @range(2600) WHERE id % 7 NOT IN (0, 6)""",
    ),
]


def _spark_text(sql: str) -> str:
    return re.sub(r"@array\(([^)]*)\)", r"array(\1)", re.sub(r"@range\((\d+)\)", r"range(\1)", sql))


def _duck_text(sql: str) -> str:
    sql = re.sub(r"@array\(([^)]*)\)", r"[\1]", re.sub(r"@range\((\d+)\)", r"(SELECT range AS id FROM range(\1)) g", sql))
    return re.sub(r"\{(\w+)\}", r"\1", sql)


_INDEX: dict[str, DataFrame] = {}


def _price_index(official: DataFrame, variation: DataFrame) -> DataFrame:
    """The price index, a table of some months, built once a session as a run would find it."""
    app = official.sparkSession.sparkContext.applicationId
    if app not in _INDEX:
        _INDEX[app] = materialize(build_price_index(official, variation, str(OFFICIAL_FROM)).coalesce(1), "index")
    return _INDEX[app]


def load(spark: SparkSession, sf_dir: str, written: tuple[str, ...] = ()) -> Tables:
    """The tables as lazy frames over the Parquet inputs; those ``written`` are stored once, as a query that reads
    them many times would find them, and later ones derive from what is stored."""
    known: dict[str, DataFrame] = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in INPUTS}
    buckets = max(spark.sparkContext.defaultParallelism, -(-known["lineitem"].count() // BUCKET_LINES)) if written else 0
    for name, sql in STEPS:
        used = {n: known[n] for n in re.findall(r"\{(\w+)\}", sql)}
        known[name] = spark.sql(_spark_text(sql), **used)
        if name in written:
            known[name] = bucketed(known[name], "process_number", buckets, name) if name in BY_PROCESS else materialize(known[name], name)
    known["price_index"] = _price_index(known["official_index"], known["monthly_variation"])
    return Tables(**{f: known[f] for f in Tables.__dataclass_fields__ if f in known}, official_from=OFFICIAL_FROM)


def ctes(*wanted: str) -> str:
    """``WITH`` and the definitions, for DuckDB, of the tables named and all that they need."""
    text, need = dict(STEPS), set()

    def add(name: str) -> None:
        if name in text and name not in need:
            need.add(name)
            for n in re.findall(r"\{(\w+)\}", text[name]):
                add(n)

    for name in wanted:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({_duck_text(s)})" for n, s in STEPS if n in need)
