"""Filter and projection queries."""

import secrets

from pyspark.sql import functions as F

from ledgerwatch.operators import filters as fl
from ledgerwatch.operators.common import event_age
from ledgerwatch.plans.registry import query


@query("FIL-1", uses="tx lim scored merchants", rounded="amount fraud_score", sql="""
SELECT s.transaction_id, s.user_id, s.merchant_id, s.amount, s.currency, s.ts, s.fraud_score, s.country, merchant_name,
  CAST(epoch(as_of) - epoch(s.ts) AS BIGINT) AS seconds_ago,
  (SELECT COUNT(*) FROM scored WHERE risk_level = 'HIGH' AND country = (SELECT MIN(n_name) FROM nation)) AS total_count
FROM (SELECT * FROM scored WHERE risk_level = 'HIGH' AND country = (SELECT MIN(n_name) FROM nation)
      ORDER BY ts DESC, transaction_id DESC LIMIT 20 OFFSET 20) s
CROSS JOIN lim LEFT JOIN merchants m ON s.merchant_id = m.merchant_id
""")
def fil_1(t):
    first = t.raw("nation").agg(F.min("n_name")).scalar()
    page = fl.recent_transactions(t.scored, t.merchants, risk="HIGH", country=first, limit=20, page=2)
    return page.select(
        "transaction_id", "user_id", "merchant_id", "amount", "currency", "ts", "fraud_score", "country",
        "merchant_name", "seconds_ago", "total_count",
    )


@query("FIL-2", uses="tx scored", rounded="amount fraud_score", sql="""
SELECT transaction_id, user_id, merchant_id, amount, fraud_score, risk_level, ts FROM scored
WHERE amount >= 100 AND amount <= 9000 AND fraud_score >= 0.5 AND ts >= TIMESTAMP '1995-01-01' AND ts <= TIMESTAMP '1997-12-31'
  AND risk_level IN ('HIGH', 'CRITICAL')
""")
def fil_2(t):
    return fl.fraud_search(
        t.scored_merchant, min_amount=100, max_amount=9000, min_fraud_score=0.5, start="1995-01-01", end="1997-12-31",
        risk_levels=["HIGH", "CRITICAL"], limit=None,
    ).select("transaction_id", "user_id", "merchant_id", "amount", "fraud_score", "risk_level", "ts")


@query("FIL-3", uses="tx", rounded="amount fraud_score", sql="""
SELECT transaction_id, user_id, amount, fraud_score, ts FROM tx
WHERE fraud_score >= 0.9 AND ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'
""")
def fil_3(t):
    return fl.high_risk_between(t.tx_slim, 0.9, "1996-01-01", "1996-12-31").select(
        "transaction_id", "user_id", "amount", "fraud_score", "ts"
    )


@query("FIL-4", uses="ev", rounded="amount", sql="""
SELECT time_bucket(INTERVAL '1 day', ts) AS bucket, COUNT(*) AS events, SUM(amount) AS amount FROM ev
WHERE user_id = (SELECT MIN(user_id) FROM events) GROUP BY 1
""")
def fil_4(t):
    return fl.user_activity(t.ev, t.raw("events").agg(F.min("user_id")).scalar(), 86400)


@query("FIL-5", uses="tx", rounded="amount score_text", sql="""
SELECT transaction_id, amount, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE fraud_score END AS score_text, CAST(is_fraud AS INTEGER) AS label FROM tx
""")
def fil_5(t):
    raw = t.tx_slim.select(
        "transaction_id",
        F.col("amount").cast("string").alias("amount"),
        F.when(F.col("user_id") % 3 == 0, "n/a").otherwise(F.col("fraud_score").cast("string")).alias("score_text"),
        F.when(F.col("is_fraud"), 7).otherwise(-2).alias("label"),
    )
    return fl.coerce_numeric(raw, ["amount", "score_text"], "label")


@query("FIL-6", uses="tx", sql="""
SELECT CASE WHEN fraud_score <= 0 THEN NULL WHEN fraud_score <= 0.3 THEN 'Low' WHEN fraud_score <= 0.7 THEN 'Medium' ELSE 'High' END AS band,
  GREATEST(0, CAST(CEIL(fraud_score / 0.125e0) AS BIGINT) - 1) AS score_bin, COUNT(*) AS n
FROM tx GROUP BY 1, 2
""")
def fil_6(t):
    s = F.col("fraud_score")
    return t.tx_slim.groupBy(
        fl.bin_right_closed(s, [0, 0.3, 0.7, 1], ["Low", "Medium", "High"]).alias("band"),
        fl.bin_equal_width(s, 0.0, 1.0, 8).alias("score_bin"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("FIL-7", uses="tx", rounded="amount", sql="""
SELECT transaction_id, concat('user-', CAST(user_id AS VARCHAR)) AS account, amount * 1.5e0 AS amount, category, ts, 'card' AS channel
FROM tx WHERE currency = 'EUR' AND category = 'travel'
""")
def fil_7(t):
    base = t.tx_slim.select("transaction_id", "user_id", "amount", "currency", "category", "ts")
    return fl.reshape(
        base, {"currency": "EUR", "category": "travel"}, {"user_id": "account"}, {"channel": "card"}, ["currency"],
        {"amount": 1.5}, {"account": "user-%d"},
    )


@query("FIL-8", uses="tx users", sql="""
SELECT 'transactions' AS table_name, COUNT(*) AS n FROM tx WHERE user_id % 5 = 3
UNION ALL SELECT 'users', COUNT(*) FROM users WHERE user_id % 5 = 3
UNION ALL SELECT 'events', COUNT(*) FROM events WHERE user_id % 5 = 3
UNION ALL SELECT 'merchants', COUNT(*) FROM supplier WHERE s_suppkey % 5 = 3
UNION ALL SELECT 'orders', COUNT(*) FROM orders WHERE o_custkey % 5 = 3
""")
def fil_8(t):
    parts = []
    for name, df, key in (
        ("transactions", t.tx_slim, "user_id"), ("users", t.users, "user_id"), ("events", t.ev, "user_id"),
        ("merchants", t.merchants, "merchant_id"), ("orders", t.raw("orders"), "o_custkey"),
    ):
        owned = df.withColumn("tenant_id", F.concat(F.lit("tenant_"), (F.col(key) % 5).cast("string")))
        parts.append(
            fl.for_tenant(owned, "tenant_3").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("FIL-9", uses="tx", sql="""
SELECT transaction_id, sha256(CAST(user_id AS VARCHAR)) AS user_hash,
  regexp_replace(regexp_replace(device_id, '[a-z]', 'x', 'g'), '[0-9]', 'n', 'g') AS device_masked, currency AS revealed
FROM tx
""")
def fil_9(t):
    # the key comes from the session; without one, a fresh key serves this run
    key = t.spark.conf.get("spark.ledgerwatch.columnKey", None) or secrets.token_hex(8)
    masked = fl.protect(
        t.tx_slim.select(
            "transaction_id", F.col("user_id").alias("user_hash"), F.col("device_id").alias("device_masked"), "currency"
        ),
        {"user_hash": "hash", "device_masked": "mask", "currency": "encrypt"}, key,
    )
    return masked.select(
        "transaction_id", "user_hash", "device_masked", fl.reveal(F.col("currency"), key).alias("revealed")
    )


@query("FIL-10", uses="tx lim", sql="""
SELECT transaction_id, CAST(epoch(as_of) - epoch(ts) AS BIGINT) AS seconds_ago FROM tx CROSS JOIN lim
""")
def fil_10(t):
    return t.tx_slim.select("transaction_id", event_age(t.tx_slim).alias("seconds_ago"))


@query("FIL-11", uses="ev", rounded="amount", sql="""
SELECT transaction_id, user_id, amount, ts FROM ev
WHERE user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'
""")
def fil_11(t):
    metrics = t.ev.withColumn("tenant_id", F.col("user_id") % 4)
    return fl.metrics_between(metrics, 1, "2024-01-05", "2024-01-20").select("transaction_id", "user_id", "amount", "ts")
