"""Views derived from the supplied tables, with gaps, copies, outliers and
correlated columns. The same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "fx_quality": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 8 = 1 THEN CAST(100000 + o_orderkey AS DOUBLE) ELSE CAST(100 + o_orderkey % 10 AS DOUBLE) END AS spiky,
  CASE WHEN o_orderkey % 5 = 0 THEN '12d' ELSE CAST(o_custkey AS STRING) END AS cust_text,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS day_text
FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0) o""",
    "fx_dups": "SELECT l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem",
    "fx_outlier": """
SELECT e.event_id AS id, CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.value END AS value,
  CASE WHEN e.event_id % 9 = 0 THEN 1 ELSE 0 END AS rare_flag, e.event_type FROM events e""",
    "fx_corr": """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
  l_extendedprice * (1 - l_discount) AS net,
  l_tax - l_quantity AS neg_qty,
  l_quantity + 35 * l_suppkey / CAST(100 AS DOUBLE) AS mixed,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS gappy,
  CAST(7 AS DOUBLE) AS flat FROM lineitem""",
    "fx_rules": """
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 10 = 0 THEN 'B' ELSE 'A' END AS seg,
  c_mktsegment AS market, CONCAT('N', CAST(c_nationkey AS STRING)) AS nation,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS bal,
  5 + (c_custkey % 2) / CAST(100000 AS DOUBLE) AS nearly_flat,
  CASE WHEN c_custkey % 100 = 0 THEN CAST(900 AS DOUBLE) ELSE CAST(1 + c_custkey % 30 AS DOUBLE) END AS skewed,
  'K' AS const_text, CAST(NULL AS DOUBLE) AS all_null FROM customer""",
    "fx_ml": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS k,
  l_quantity AS q, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS d, l_returnflag AS flag,
  'K' AS const_text, CASE WHEN l_linenumber <= 5 THEN NULL ELSE l_tax END AS sparse,
  2 * l_quantity + 100 * l_tax AS y_num,
  CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 'hi' ELSE 'lo' END AS y_txt FROM lineitem""",
    "fx_nonfinite": """
SELECT event_id AS id,
  CASE WHEN event_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN event_id % 13 = 0 THEN NULL ELSE value END AS v,
  CASE WHEN event_id % 5 = 0 THEN 'NA' WHEN event_id % 5 = 1 THEN '' WHEN event_id % 5 = 2 THEN 'null' ELSE event_type END AS raw_text
FROM events""",
    "fx_step": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS k,
  CASE WHEN l_linenumber > 3 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v,
  CASE WHEN l_linenumber > 3 THEN 'hi' ELSE 'lo' END AS y_txt,
  CASE WHEN l_linenumber > 3 THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y_num FROM lineitem""",
    "fx_step3": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS k,
  CAST(l_linenumber AS DOUBLE) AS v, CASE WHEN l_linenumber < 3 THEN 'few' WHEN l_linenumber < 5 THEN 'more' ELSE 'most' END AS y_txt FROM lineitem""",
    "fx_dates": """
SELECT id, CONCAT(m, '/', d, '/', y) AS us, CONCAT(dd, '.', mm, '.', y) AS dots, CONCAT(y, '-', mm) AS months, CONCAT(SUBSTR(name, 1, 3), ' ', y) AS named,
  CONCAT(TRIM(name), ' ', d, ', ', y) AS long_name, CONCAT(mm, '/', dd, '/', SUBSTR(y, 3, 2)) AS short_year, CONCAT('Thu ', SUBSTR(name, 1, 3), ' ', dd, ' ', y) AS weekday,
  CONCAT(y, '/', mm, '/', dd, ' 10:11:12') AS slashes, CONCAT(d, '-', SUBSTR(name, 1, 3), '-', y) AS dashes, CONCAT(y, '-', mm, '-', dd, ' 10:11:12 AM') AS half_day,
  CONCAT('10:30 AM ', y) AS timed_year, CONCAT(y, '-', mm, '-', dd) AS iso, CONCAT('part ', dd) AS no_date, CAST(day AS DATE) AS day
FROM (SELECT id, day, y, m, d, LPAD(m, 2, '0') AS mm, LPAD(d, 2, '0') AS dd,
    SUBSTR('January  February March    April    May      June     July     August   SeptemberOctober  November December ', 9 * CAST(m AS INT) - 8, 9) AS name
  FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(EXTRACT(YEAR FROM CAST(o_orderdate AS DATE)) AS STRING) AS y,
      CAST(EXTRACT(MONTH FROM CAST(o_orderdate AS DATE)) AS STRING) AS m, CAST(EXTRACT(DAY FROM CAST(o_orderdate AS DATE)) AS STRING) AS d FROM orders) p) q""",
    "fx_far": """
SELECT event_id AS id, CASE WHEN event_id % 20 = 0 THEN CAST(1000000 + event_id AS DOUBLE) ELSE CAST(event_id % 2 AS DOUBLE) END AS v FROM events""",
    "fx_wide": "SELECT o_orderkey AS id, 1234567890123 + 7 * o_orderkey AS big, o_totalprice * 1000000 AS dear FROM orders",
    "fx_code": """
SELECT o_orderkey AS id, CAST(o_custkey AS STRING) AS num_text,
  CASE WHEN o_orderkey % 5 < 3 THEN '12d' ELSE CAST(o_custkey AS STRING) END AS code_text FROM orders""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table, or a view derived from one."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    used = {t for t in TABLES if re.search(rf"\b{t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\b(FROM) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
