"""DuckDB text of the adapters in ``sources.adapters`` (kept in step by hand)."""
from ..sources.adapters import (CATALOG_CATEGORIES, CATALOG_FIXTURE, MERCHANT_NAMES,
                                ORDER_REMARKS, VPA_HANDLES, VPA_TRADES)


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TXN = f"""txn AS (
  SELECT CAST(event_id AS VARCHAR) AS transaction_id,
         CAST(user_id AS VARCHAR) AS user_id,
         {_list(MERCHANT_NAMES)}[(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) + 1] AS merchant_name,
         value AS amount,
         ts AS "timestamp",
         event_type AS category,
         lower(replace({_list(MERCHANT_NAMES)}[(CAST(json_extract_string(props, '$.k') AS INTEGER) % 20) + 1], ' ', ''))
           || '@' || {_list(VPA_HANDLES)}[(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) + 1] AS vpa,
         'events' AS source,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         FALSE AS disputed,
         event_type = 'error' AS refunded,
         CASE WHEN event_type = 'purchase' THEN CAST((CAST(json_extract_string(props, '$.k') AS INTEGER) % 5) + 1 AS DOUBLE) END AS rating,
         CASE WHEN event_type = 'error' THEN 'refund' ELSE 'purchase' END AS type,
         event_type AS memo,
         CASE WHEN event_type = 'signup' THEN 'receive' ELSE 'send' END AS direction,
         CAST(NULL AS VARCHAR) AS caps_state,
         CAST(NULL AS VARCHAR) AS payee_name
  FROM events)"""

PAY = f"""pay AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transaction_id,
         CAST(o_custkey AS VARCHAR) AS user_id,
         s_name AS merchant_name,
         l_extendedprice AS amount,
         l_shipdate AS "timestamp",
         p_type AS category,
         s_name || '.' || {_list(VPA_TRADES)}[CAST(l_suppkey % {len(VPA_TRADES)} AS INTEGER) + 1] || '@' || p_brand AS vpa,
         'orders' AS source,
         CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status,
         (l_returnflag = 'A' AND l_linestatus = 'O') AS disputed,
         l_returnflag = 'R' AS refunded,
         CAST(NULL AS DOUBLE) AS rating,
         CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'purchase' END AS type,
         p_name || ' ' || {_list(ORDER_REMARKS)}[CAST(l_orderkey % {len(ORDER_REMARKS)} AS INTEGER) + 1] AS memo,
         CASE WHEN l_returnflag = 'R' THEN 'receive' ELSE 'send' END AS direction,
         CAST(NULL AS VARCHAR) AS caps_state,
         CAST(NULL AS VARCHAR) AS payee_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN supplier ON l_suppkey = s_suppkey
       JOIN part ON l_partkey = p_partkey)"""

_fix = " UNION ALL ".join(
    f"SELECT {i} AS ord, '{n}' AS \"Merchant Name\", '{c}' AS \"Category\", '{s}' AS \"Subcategory\""
    for i, (n, c, s) in enumerate(CATALOG_FIXTURE))

CATALOG = f"""catalog AS (
  {_fix}
  UNION ALL
  SELECT s_suppkey + {len(CATALOG_FIXTURE)} AS ord, s_name AS "Merchant Name",
         {_list(CATALOG_CATEGORIES)}[(s_nationkey % 13) + 1] AS "Category",
         'Nation ' || CAST(s_nationkey AS VARCHAR) AS "Subcategory"
  FROM supplier WHERE s_acctbal >= 0)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
