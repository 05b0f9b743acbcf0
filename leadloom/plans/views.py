"""Inputs of the registered queries, derived from the given tables.

The tables hold no listings, so a lead is an order with its customer and place; prices, owners, contacts
and texts follow from keys. LEADS is one text that both Spark and DuckDB run, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-08-15 00:00:00"

LEADS = """
SELECT o_orderkey AS id,
  CAST(o_orderkey AS STRING) AS external_id,
  o_orderpriority AS discovery_source,
  n_name AS zone,
  r_name AS municipality,
  CASE o_orderkey % 7 WHEN 0 THEN 'T0' WHEN 1 THEN 'T1' WHEN 2 THEN 'T2' WHEN 3 THEN 'T3' WHEN 4 THEN 'T5+' WHEN 5 THEN 'Moradia' ELSE 'T2' END AS typology,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(30 + o_custkey % 150 AS DOUBLE) END AS area_m2,
  concat(CASE o_orderkey % 4 WHEN 0 THEN 'Apartamento' WHEN 1 THEN 'Moradia' WHEN 2 THEN 'Loja' ELSE 'Andar' END, ' ', lower(c_mktsegment), ' ', lower(n_name)) AS title,
  concat('Anuncio ', CAST(o_custkey % 97 AS STRING), CASE o_orderkey % 9 WHEN 0 THEN ' urgente' WHEN 1 THEN ' com piscina e varanda' WHEN 2 THEN ' para remodelar' WHEN 3 THEN ' aceito propostas' WHEN 4 THEN ' vista mar' ELSE '' END) AS description,
  CASE WHEN o_custkey % 4 = 1 THEN concat('Agency ', CAST(o_custkey % 23 AS STRING)) END AS agency_name,
  CASE o_custkey % 4 WHEN 0 THEN 'fsbo' WHEN 1 THEN 'agency' WHEN 2 THEN 'unknown' ELSE 'developer' END AS owner_type,
  CASE o_custkey % 4 WHEN 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'frbo' ELSE 'fsbo' END WHEN 1 THEN 'agency_listing' WHEN 2 THEN 'unknown' ELSE CASE WHEN o_orderkey % 3 = 0 THEN 'active_owner' ELSE 'developer_listing' END END AS lead_type,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('+35191', lpad(CAST(o_custkey AS STRING), 7, '4')) WHEN 2 THEN concat('+35121', lpad(CAST(o_custkey AS STRING), 7, '3')) WHEN 3 THEN concat('+35166', lpad(CAST(o_custkey AS STRING), 7, '5')) ELSE concat('+35124', lpad(CAST(o_custkey AS STRING), 7, '8')) END AS contact_phone,
  CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'mobile' WHEN 2 THEN 'landline' WHEN 3 THEN 'relay' ELSE 'landline' END AS phone_type,
  CASE WHEN o_custkey % 3 = 0 THEN concat('c', CAST(o_custkey AS STRING), '@mail.pt') WHEN o_custkey % 11 = 0 THEN '' END AS contact_email,
  CASE WHEN o_custkey % 13 = 0 THEN concat('+35193', lpad(CAST(o_custkey AS STRING), 7, '2')) END AS contact_whatsapp,
  CASE WHEN o_custkey % 19 = 0 THEN concat('site', CAST(o_custkey % 50 AS STRING), '.pt') END AS contact_website,
  c_name AS contact_name,
  CASE o_orderkey % 6 WHEN 0 THEN 'cross_portal:x' WHEN 1 THEN 'website:y.pt' WHEN 2 THEN NULL ELSE o_orderpriority END AS contact_source,
  CASE o_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 3 THEN 50 ELSE 70 END AS contact_confidence,
  o_orderdate AS first_seen_at,
  CASE o_custkey % 3 WHEN 0 THEN o_orderdate + INTERVAL '2' DAY WHEN 1 THEN o_orderdate + INTERVAL '45' DAY ELSE o_orderdate + INTERVAL '120' DAY END AS last_seen_at,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(o_orderkey % 130 AS INT) END AS days_on_market,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderkey % 60 AS DOUBLE) - 30 END AS price_delta_pct,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST((o_orderkey * 7 + o_custkey) % 101 AS INT) END AS score,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN (o_orderkey * 7 + o_custkey) % 101 >= 60 THEN 'HOT' WHEN (o_orderkey * 7 + o_custkey) % 101 >= 40 THEN 'WARM' ELSE 'COLD' END AS score_label,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate + INTERVAL '3' DAY END AS scored_at,
  CASE WHEN o_orderkey % 10 < 5 THEN 'novo' WHEN o_orderkey % 10 < 8 THEN 'contactado' WHEN o_orderkey % 10 = 8 THEN 'negociacao' ELSE 'ganho' END AS crm_stage,
  o_orderkey % 23 = 0 AS archived,
  o_orderkey % 47 = 0 AS is_demo,
  o_orderkey % 12 = 0 AS priority_flag,
  CASE WHEN o_orderkey % 15 = 0 THEN 2 ELSE 0 END AS price_changes,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE 38.5 + (n_nationkey % 10) / 10.0 END AS latitude,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL ELSE -9.5 + (n_nationkey % 7) / 10.0 END AS longitude
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

#: Notes and alerts on leads, from events: an event's user stands for the lead of that id.
NOTES = """
SELECT event_id AS id, user_id AS lead_id, concat('note ', event_type) AS note, CASE event_type WHEN 'error' THEN 'price_drop' ELSE 'internal' END AS note_type, ts AS created_at FROM events
"""
PRICES = "SELECT event_id AS id, user_id AS lead_id, value AS price, event_type AS source, ts AS recorded_at FROM events"

TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset on a local master, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A shared SQL text over the given tables."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if f" {t} " in f" {sql} ".replace("\n", " ").replace(")", " ")}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t in named:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **named)


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, LEADS)


def with_leads(sql: str) -> str:
    """An oracle that starts from leads, notes and prices."""
    return f"WITH leads AS ({LEADS}), notes AS ({NOTES}), prices AS ({PRICES}), live AS (SELECT * FROM leads WHERE NOT archived AND NOT is_demo)\n{sql}"
