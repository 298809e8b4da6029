"""SQL twins of the adapter views (see ``ledgerwatch.adapters``)."""

from ledgerwatch.plans.registry import cte

cte("tx", """
SELECT concat('tx_', CAST(o_orderkey AS VARCHAR)) AS transaction_id, o_custkey AS user_id, COALESCE(sk, 0) AS merchant_id,
  (CASE o_orderkey % 4 WHEN 0 THEN cents // 20 WHEN 1 THEN cents // 200 WHEN 2 THEN cents // 2000
        ELSE cents // 200000 END) / CAST(100 AS DOUBLE) AS amount,
  CASE o_custkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' WHEN 4 THEN 'CAD' ELSE 'AUD' END AS currency,
  CASE o_orderkey % 7 WHEN 0 THEN 'grocery' WHEN 1 THEN 'electronics' WHEN 2 THEN 'gambling' WHEN 3 THEN 'travel'
       WHEN 4 THEN 'crypto' WHEN 5 THEN 'gas' ELSE 'restaurant' END AS category,
  o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS ts,
  ((o_orderkey * 37 + o_custkey * 11) % 1000) / CAST(1000 AS DOUBLE) AS fraud_score,
  ((o_orderkey * 13) % 100 < 5 OR (o_orderkey * 37 + o_custkey * 11) % 1000 > 950) AS is_fraud,
  concat('dev_', CAST(o_custkey % 97 AS VARCHAR)) AS device_id, n_name AS country,
  ((n_nationkey * 37) % 120) - 60 + (o_orderkey % 100) / CAST(100 AS DOUBLE) AS latitude,
  ((n_nationkey * 53) % 300) - 150 + (o_orderkey % 97) / CAST(97 AS DOUBLE) AS longitude,
  10 + o_orderkey % 490 AS processing_time_ms
FROM (SELECT *, CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders) o
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, MIN(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
""")

cte("lim", "SELECT MAX(ts) AS as_of FROM tx")

cte("scored", """
SELECT *, CASE WHEN fraud_score >= 0.8 THEN 'CRITICAL' WHEN fraud_score >= 0.6 THEN 'HIGH' WHEN fraud_score >= 0.4 THEN 'MEDIUM'
  WHEN fraud_score >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
  CASE WHEN fraud_score >= 0.6 THEN 'DECLINED' WHEN fraud_score >= 0.35 THEN 'REVIEW' ELSE 'APPROVED' END AS decision
FROM tx
""")

cte("ev", """
SELECT concat('ev_', CAST(event_id AS VARCHAR)) AS transaction_id, user_id, event_id % 50 AS merchant_id, value AS amount,
  ts, event_type AS channel, event_type AS transaction_type, props FROM events
""")

cte("users", """
SELECT c_custkey AS user_id, c_name AS user_name, c_mktsegment AS segment, (c_custkey * 13 % 100) / CAST(100 AS DOUBLE) AS risk_score
FROM customer
""")

cte("merchants", """
SELECT s_suppkey AS merchant_id, s_name AS merchant_name,
  CASE s_suppkey % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'crypto' WHEN 2 THEN 'travel' WHEN 3 THEN 'gambling' ELSE 'food' END AS merchant_category,
  (s_suppkey * 7 % 100) / CAST(100 AS DOUBLE) AS merchant_risk
FROM supplier
""")
