"""The disclosure tables as views over the base tables: one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS = {
    "tb_companies": """
  SELECT s_suppkey AS entity_id, s_name AS canonical_name, r_name AS sector, n_name AS country
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "tb_form4_raw": """
  SELECT l_orderkey AS accession, l_linenumber AS txn_index, l_suppkey AS company_id, o_custkey % 200 AS person_id, CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'P' WHEN 'RF' THEN 'P' WHEN 'AO' THEN 'S' WHEN 'NF' THEN 'A' WHEN 'NO' THEN 'F' ELSE 'G' END AS transaction_code, CASE WHEN concat(l_returnflag, l_linestatus) IN ('AF','RF','NF') THEN 'A' ELSE 'D' END AS acquired_disposed, CAST(o_orderdate AS DATE) AS event_time, CAST(o_orderdate AS DATE) + CAST(l_partkey % 46 AS INT) AS publication_time, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(l_partkey % 46 + l_suppkey % 4 AS INT) END AS retrieved_at, CAST(o_orderdate AS DATE) + CAST(l_partkey % 46 + 2 AS INT) AS created_at, CAST(l_quantity AS DECIMAL(20,4)) AS shares, CASE WHEN l_discount = 0 THEN NULL ELSE CAST(p_retailprice AS DECIMAL(20,4)) END AS price, l_tax >= 0.06 AS is_10b5_1, l_partkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "tb_form4": """
  SELECT *
  FROM (SELECT *, accession * 10 + txn_index AS event_id, row_number() OVER (PARTITION BY accession, txn_index ORDER BY l_partkey, company_id, shares, person_id, publication_time, transaction_code, is_10b5_1, price NULLS FIRST) AS rn
  FROM tb_form4_raw) q
  WHERE rn = 1""",
    "tb_roles": """
  SELECT person_id, company_id, min(publication_time) AS start_date, max(CASE WHEN transaction_code = 'P' AND l_partkey % 80 = 0 THEN 1 ELSE 0 END) = 1 AS is_officer, max(CASE WHEN l_partkey % 120 = 0 THEN 1 ELSE 0 END) = 1 AS is_director, max(CASE WHEN l_partkey % 200 = 0 THEN 1 ELSE 0 END) = 1 AS is_ten_percent_owner
  FROM tb_form4
  WHERE l_partkey % 40 = 0
  GROUP BY person_id, company_id""",
    "tb_13f_raw": """
  SELECT o_custkey % 25 AS institution_id, l_suppkey AS company_id, last_day(add_q) AS period_of_report, qty AS shares, mv AS market_value_usd
  FROM (SELECT o_custkey, l_suppkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) + 62 AS add_q, CAST(l_quantity AS DECIMAL(20,4)) AS qty, CAST(l_extendedprice AS DECIMAL(20,2)) AS mv
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q""",
    "tb_short_interest": """
  SELECT company_id, settlement_date, sum(qty) AS current_short_position, CAST(sum(qty) AS DOUBLE) / count(DISTINCT d) AS average_daily_volume
  FROM (SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS d, CASE WHEN day(l_shipdate) <= 15 THEN CAST(date_trunc('month', l_shipdate) AS DATE) + 14 ELSE last_day(CAST(l_shipdate AS DATE)) END AS settlement_date, CAST(l_quantity AS DECIMAL(20,2)) AS qty
  FROM lineitem) q
  GROUP BY company_id, settlement_date""",
    "tb_price_bars": """
  SELECT l_suppkey AS company_id, CAST(l_shipdate AS DATE) AS trade_date, max(CAST(l_extendedprice AS DECIMAL(14,4))) AS high, min(CAST(l_extendedprice AS DECIMAL(14,4))) AS low, max(CAST(l_extendedprice AS DECIMAL(14,4))) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem
  GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "tb_xbrl": """
  SELECT company_id, metric, concept, form, period_start, period_end, CAST(company_id * 1000 + year(period_end) * 10 + bump + 300 * kind AS DECIMAL(24,2)) AS value, period_end + filed_lag AS filed, accession
  FROM (SELECT l_suppkey AS company_id, CASE l_partkey % 5 WHEN 0 THEN 'revenue' WHEN 1 THEN 'net_income' WHEN 2 THEN 'gross_profit' WHEN 3 THEN 'operating_income' ELSE 'eps_diluted' END AS metric, l_partkey % 5 AS kind, CASE l_linestatus WHEN 'F' THEN 'TagA' ELSE 'TagB' END AS concept, CASE WHEN l_linenumber = 7 THEN '10-K' ELSE '10-Q' END AS form, CASE WHEN l_linenumber >= 6 THEN CAST(date_trunc('year', o_orderdate) AS DATE) ELSE CAST(date_trunc('quarter', o_orderdate) AS DATE) END AS period_start, CASE WHEN l_linenumber = 7 THEN CAST(date_trunc('year', o_orderdate) AS DATE) + 364 WHEN l_linenumber = 6 THEN CAST(date_trunc('year', o_orderdate) AS DATE) + 180 ELSE last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + 62) END AS period_end, CASE WHEN l_partkey % 97 = 0 THEN 1 ELSE 0 END AS bump, CAST(l_partkey % 400 AS INT) AS filed_lag, l_orderkey AS accession
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) q""",
    "tb_volatility": """
  SELECT upper(event_type) AS index_code, CAST(ts AS DATE) AS trade_date, min_by(CAST(value AS DECIMAL(14,4)), event_id) AS open, max(CAST(value AS DECIMAL(14,4))) AS high, min(CAST(value AS DECIMAL(14,4))) AS low, max_by(CAST(value AS DECIMAL(14,4)), event_id) AS close
  FROM events
  GROUP BY upper(event_type), CAST(ts AS DATE)""",
    "tb_tone": """
  SELECT user_id AS company_id, CAST(floor(value / 25) AS INT) - 10 AS bin, count(*) AS n
  FROM events
  GROUP BY user_id, CAST(floor(value / 25) AS INT) - 10""",
    "tb_wallet_legs": """
  SELECT user_id AS address, CAST(ts AS DATE) AS tx_date, event_id AS tx_hash, CASE WHEN event_type IN ('purchase', 'signup') THEN 'out' ELSE 'in' END AS leg, CAST(round(value * 100) AS BIGINT) AS satoshis
  FROM events""",
    "tb_identifiers": """
  SELECT concat('T', CAST(s_suppkey % 40 AS INT)) AS ticker, s_suppkey AS company_id, CASE WHEN s_suppkey < 40 THEN NULL ELSE DATE '1995-01-01' + CAST(floor(s_suppkey / 40.0) * 800 AS INT) END AS valid_from, CASE WHEN s_suppkey >= 80 THEN NULL ELSE DATE '1995-01-01' + CAST(floor(s_suppkey / 40.0) * 800 + 799 AS INT) END AS valid_to
  FROM supplier""",
    "tb_8k": """
  SELECT o_custkey % 100 AS company_id, o_orderkey AS accession, CASE WHEN o_orderstatus = 'P' THEN '10-Q' ELSE '8-K' END AS form, CASE o_orderpriority WHEN '1-URGENT' THEN '2.01' WHEN '2-HIGH' THEN '2.02,9.01' WHEN '3-MEDIUM' THEN '2.01, 7.01' WHEN '5-LOW' THEN '8.01' ELSE '' END AS item_codes, CAST(o_orderdate AS DATE) AS filing_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INT) AS publication_time
  FROM orders""",
    "tb_ownership": """
  SELECT accession, person_id AS filer_id, company_id, CASE WHEN txn_index % 2 = 0 THEN 'SCHEDULE 13D' ELSE 'SCHEDULE 13G' END AS form_type, CASE txn_index WHEN 1 THEN 'IN' WHEN 2 THEN 'IN' WHEN 3 THEN 'CO' ELSE NULL END AS type_code, CASE WHEN txn_index = 5 THEN NULL ELSE person_id END AS filer_cik, shares AS shares_owned, CASE WHEN price IS NULL THEN NULL ELSE event_time END AS event_date, publication_time
  FROM tb_form4
  WHERE l_partkey % 5 = 0""",
    "tb_fund_aum": """
  SELECT fund_id, last_day(q + 62) AS period_end, last_day(q + 62) + 60 AS publication_time, sum(v) AS net_assets_usd
  FROM (SELECT o_custkey % 10 AS fund_id, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, CAST(o_totalprice AS DECIMAL(18,2)) AS v
  FROM orders
  WHERE NOT (o_custkey % 10 = 3 AND month(o_orderdate) <= 3)) x
  GROUP BY fund_id, q""",
    "tb_control": """
  SELECT c_nationkey AS company_id, c_custkey AS psc_id, c_name AS psc_name, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'individual' WHEN 'MACHINERY' THEN 'corporate' ELSE 'legal' END AS psc_kind, CASE WHEN c_custkey % 4 = 0 THEN ' England ' WHEN c_custkey % 4 = 1 THEN 'Delaware' ELSE NULL END AS country_registered, DATE '1998-01-01' + CAST(c_custkey % 900 AS INT) AS notified_on, CASE WHEN c_acctbal < 0 THEN DATE '2001-01-01' ELSE NULL END AS ceased_on
  FROM customer""",
    "tb_analyst": """
  SELECT o_custkey % 50 AS company_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS strong_buy, count(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS buy, count(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 END) AS hold, count(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 END) AS sell, count(CASE WHEN o_orderpriority = '5-LOW' THEN 1 END) AS strong_sell
  FROM orders
  GROUP BY o_custkey % 50, CAST(date_trunc('month', o_orderdate) AS DATE)""",
}


def with_views(body: str, *extra: str) -> str:
    """body with the views that it names (and those that they name) as common table expressions before it."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(body + " ".join(extra))
    ctes = [f"{name} AS ({VIEWS[name].strip()})" for name in wanted]
    if not ctes:
        return body
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + text


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ROWS_A_TASK = 250_000  # of the longest table that a view reads


def widen(spark: SparkSession, rows: int) -> None:
    """Let shuffles start with a partition for each ROWS_A_TASK rows, so that a task's memory does not grow with the tables.

    These are the session's adaptive settings: Spark merges partitions below 4 MB again, so small tables get no more tasks
    than before. What the session was submitted with stands.
    """
    submitted = spark.sparkContext.getConf()
    wide = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}
    for key, value in wide.items():
        if not submitted.contains(key):
            spark.conf.set(key, str(value))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    text = with_views(f"SELECT * FROM {name}")
    read = {table: base(spark, sf_dir, table) for table in BASE_TABLES if re.search(rf"\b{table}\b", text)}
    for table, rows in read.items():
        rows.createOrReplaceTempView(table)
    longest = [t for t in ("lineitem", "events", "orders", "customer") if t in read][:1]
    widen(spark, max((read[t].count() for t in longest), default=0))  # counted by the files' footers
    return spark.sql(text)
