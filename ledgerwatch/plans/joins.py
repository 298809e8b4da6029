"""Join queries."""

from pyspark.sql import functions as F

from ledgerwatch.operators import joins as jn
from ledgerwatch.plans.registry import cte, query

HAV = """12742e0 * asin(sqrt(LEAST(1e0, pow(sin((radians({2}) - radians({0})) / 2), 2)
  + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))))"""

# Zones and clusters derived from the nations of the data: one square and one circle around each nation's corner.
ZONES = """
SELECT n_nationkey AS zone_id, CASE n_nationkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
 ((n_nationkey * 37) % 120) - 60 AS south, ((n_nationkey * 53) % 300) - 150 AS west FROM nation
"""
cte("zones", ZONES)


def zones(t):
    south = F.pmod(F.col("n_nationkey") * 37, F.lit(120)) - 60
    west = F.pmod(F.col("n_nationkey") * 53, F.lit(300)) - 150
    corner = lambda dy, dx: F.struct((south + dy).cast("double").alias("lat"), (west + dx).cast("double").alias("lon"))
    m = F.col("n_nationkey") % 4
    return t.raw("nation").select(
        F.col("n_nationkey").alias("zone_id"),
        F.when(m == 0, "CRITICAL").when(m == 1, "HIGH").when(m == 2, "MEDIUM").otherwise("LOW").alias("risk_level"),
        F.array(corner(-0.25, 0.005), corner(-0.25, 0.605), corner(0.355, 0.605), corner(0.355, 0.005)).alias("ring"),
    )


cte("clusters", """
SELECT n_nationkey AS cluster_id, ((n_nationkey * 37) % 120) - 60 + 0.5e0 AS cluster_lat, ((n_nationkey * 53) % 300) - 150 + 0.5e0 AS cluster_lon,
  20e0 + n_nationkey AS radius_km, CASE n_nationkey % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS cluster_level,
  0.5e0 + (n_nationkey % 5) / 10e0 AS confidence, CASE WHEN n_nationkey % 2 = 0 THEN 'hotspot' ELSE 'dbscan' END AS cluster_type FROM nation
""")


def clusters(t):
    k = F.col("n_nationkey")
    return t.raw("nation").select(
        k.alias("cluster_id"),
        (F.pmod(k * 37, F.lit(120)) - 60 + 0.5).alias("cluster_lat"),
        (F.pmod(k * 53, F.lit(300)) - 150 + 0.5).alias("cluster_lon"),
        (k + 20.0).alias("radius_km"),
        F.when(k % 3 == 0, "CRITICAL").when(k % 3 == 1, "HIGH").otherwise("MEDIUM").alias("cluster_level"),
        (F.lit(0.5) + (k % 5) / 10.0).alias("confidence"),
        F.when(k % 2 == 0, "hotspot").otherwise("dbscan").alias("cluster_type"),
    )


@query("JOI-1", uses="tx merchants", rounded="amount merchant_risk", sql="""
SELECT transaction_id, merchant_id, amount, merchant_name, merchant_category, merchant_risk FROM tx LEFT JOIN merchants USING (merchant_id)
""")
def joi_1(t):
    return jn.with_merchant(t.tx_merchant, t.merchants).select(
        "transaction_id", "merchant_id", "amount", "merchant_name", "merchant_category", "merchant_risk"
    )


@query("JOI-2", uses="tx lim merchants", rounded="amount", sql="""
SELECT merchant_id, merchant_name, transaction_id, amount FROM merchants LEFT JOIN tx USING (merchant_id), lim WHERE ts > as_of - INTERVAL 60 DAY
""")
def joi_2(t):
    return jn.merchant_activity(t.tx_merchant, t.merchants, 60 * 86400).select(
        "merchant_id", "merchant_name", "transaction_id", "amount"
    )


@query("JOI-3", uses="tx lim merchants", rounded="merchant_risk transaction_volume avg_fraud_score", places=4, sql="""
SELECT m.merchant_id, merchant_name, merchant_risk, COUNT(transaction_id) AS transaction_count, SUM(amount) AS transaction_volume,
  COUNT(transaction_id) FILTER (WHERE is_fraud) AS fraud_count, AVG(fraud_score) AS avg_fraud_score
FROM merchants m CROSS JOIN lim LEFT JOIN tx ON m.merchant_id = tx.merchant_id AND ts > as_of - INTERVAL 365 DAY
GROUP BY ALL HAVING COUNT(transaction_id) > 10 ORDER BY merchant_risk DESC, fraud_count DESC, m.merchant_id LIMIT 100
""")
def joi_3(t):
    return jn.top_risk_merchants(t.tx_merchant, t.merchants, 365 * 86400).drop("merchant_category")


@query("JOI-4", uses="tx users", rounded="risk_score avg_risk_score", sql="""
SELECT device_id, user_id, risk_score, user_count, avg_risk_score, user_count - 1 AS partners FROM (
 SELECT device_id, user_id, risk_score, COUNT(*) OVER (PARTITION BY device_id) AS user_count, AVG(risk_score) OVER (PARTITION BY device_id) AS avg_risk_score
 FROM (SELECT DISTINCT device_id, user_id FROM tx) JOIN users USING (user_id) WHERE risk_score > 0.6) WHERE user_count >= 2
""")
def joi_4(t):
    return jn.shared_device_members(t.tx_slim, t.users, 0.6).select(
        "device_id", "user_id", "risk_score", "user_count", "avg_risk_score", "partners"
    )


@query("JOI-5", uses="tx merchants", rounded="avg_fraud_score", sql="""
WITH p AS (SELECT user_id, merchant_name, fraud_score FROM tx JOIN merchants USING (merchant_id) WHERE fraud_score > 0.7 AND merchant_risk > 0.5),
u AS (SELECT user_id, COUNT(*) AS suspicious_transactions, AVG(fraud_score) AS avg_fraud_score FROM p GROUP BY 1)
SELECT user_id, merchant_name, COUNT(*) AS merchant_transactions, ANY_VALUE(suspicious_transactions) AS suspicious_transactions,
  ANY_VALUE(avg_fraud_score) AS avg_fraud_score FROM p JOIN u USING (user_id) GROUP BY 1, 2
""")
def joi_5(t):
    return jn.suspicious_paths(t.tx_merchant, t.merchants)


@query("JOI-6", uses="tx users merchants", rounded="amount risk_score", sql="""
SELECT transaction_id, amount, risk_score, merchant_name FROM tx LEFT JOIN users USING (user_id)
LEFT JOIN (SELECT * FROM merchants WHERE merchant_category <> 'food') USING (merchant_id)
""")
def joi_6(t):
    known = t.merchants.filter(F.col("merchant_category") != "food")
    return jn.with_optional_parties(t.tx_merchant, t.users, known).select(
        "transaction_id", "amount", "risk_score", "merchant_name"
    )


@query("JOI-7", uses="tx", rounded="amount group_mean group_std group_min group_max", places=4, sql="""
SELECT transaction_id, amount, COUNT(*) OVER w AS group_count, AVG(amount) OVER w AS group_mean, STDDEV_SAMP(amount) OVER w AS group_std,
  MIN(amount) OVER w AS group_min, MAX(amount) OVER w AS group_max FROM tx WINDOW w AS (PARTITION BY user_id)
""")
def joi_7(t):
    return jn.with_group_stats(t.tx_slim.select("transaction_id", "user_id", "amount"), "user_id", "amount").drop("user_id")


@query("JOI-8", uses="tx", rounded="prev_amount gap_seconds", sql="""
SELECT transaction_id, LAG(transaction_id) OVER w AS prev_transaction_id, LAG(amount) OVER w AS prev_amount,
  (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 1e6 AS gap_seconds FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY ts, transaction_id)
""")
def joi_8(t):
    return jn.with_previous(t.tx_slim, ["transaction_id", "amount"]).select(
        "transaction_id", "prev_transaction_id", "prev_amount", "gap_seconds"
    )


@query("JOI-9", uses="tx clusters", rounded="mean_distance", places=4, sql=f"""
SELECT cluster_id, COUNT(*) AS nearby, COUNT(DISTINCT user_id) AS users, AVG(d) AS mean_distance FROM (
 SELECT cluster_id, user_id, {HAV.format('cluster_lat', 'cluster_lon', 'latitude', 'longitude')} AS d FROM clusters, tx) WHERE d <= 30 GROUP BY 1
""")
def joi_9(t):
    probes = clusters(t).select("cluster_id", F.col("cluster_lat").alias("latitude"), F.col("cluster_lon").alias("longitude"))
    return jn.nearby_transactions(t.tx_place.select("user_id", "latitude", "longitude"), probes, 30.0).groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("nearby"), F.count_distinct("near_user_id").alias("users"),
        F.avg("distance_km").alias("mean_distance"),
    )


@query("JOI-10", uses="tx zones", sql="""
SELECT transaction_id, zone_id, risk_level FROM tx JOIN zones ON latitude > south - 0.25e0 AND latitude < south + 0.355e0
  AND longitude > west + 0.005e0 AND longitude < west + 0.605e0
""")
def joi_10(t):
    return jn.zone_join(t.tx_place, zones(t)).select("transaction_id", "zone_id", "risk_level")


@query("JOI-11", uses="tx clusters", rounded="nearest_km", places=4, sql=f"""
SELECT transaction_id, COUNT(*) AS clusters, MIN(d) AS nearest_km, arg_min(cluster_id, d) AS nearest_cluster FROM (
 SELECT transaction_id, cluster_id, radius_km, {HAV.format('latitude', 'longitude', 'cluster_lat', 'cluster_lon')} AS d FROM tx, clusters) WHERE d <= radius_km
GROUP BY 1
""")
def joi_11(t):
    hits = jn.cluster_join(t.tx_place.select("transaction_id", "latitude", "longitude"), clusters(t))
    return hits.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("clusters"), F.min("cluster_distance_km").alias("nearest_km"),
        F.min_by("cluster_id", "cluster_distance_km").alias("nearest_cluster"),
    )


@query("JOI-12", uses="tx", rounded="avg_fraud_score", sql="""
WITH p AS (SELECT user_id, CAST(FLOOR(latitude / 0.5e0) AS BIGINT) AS y, CAST(FLOOR(longitude / 0.5e0) AS BIGINT) AS x, fraud_score AS s FROM tx WHERE fraud_score > 0.5)
SELECT a.y AS from_y, a.x AS from_x, b.y AS to_y, b.x AS to_x, COUNT(*) AS connection_strength, AVG(a.s + b.s) / 2 AS avg_fraud_score,
  COUNT(DISTINCT a.user_id) AS shared_users
FROM p a JOIN p b ON a.user_id = b.user_id AND (a.y < b.y OR (a.y = b.y AND a.x < b.x)) GROUP BY 1, 2, 3, 4
ORDER BY connection_strength DESC, 1, 2, 3, 4 LIMIT 50
""")
def joi_12(t):
    return jn.location_links(t.tx_place)


@query("JOI-13", uses="tx merchants users", rounded="volume mean rate", places=4, sql="""
SELECT 'merchant' AS kind, m.merchant_id AS id, COUNT(transaction_id) AS n, COALESCE(SUM(amount), 0) AS volume, COALESCE(AVG(amount), 0) AS mean,
  COALESCE(COUNT(transaction_id) FILTER (WHERE is_fraud) / NULLIF(COUNT(transaction_id), 0), 0) AS rate, NULL::TIMESTAMP AS last_at
FROM merchants m LEFT JOIN tx ON m.merchant_id = tx.merchant_id GROUP BY m.merchant_id
UNION ALL SELECT 'user', u.user_id, COUNT(transaction_id), COALESCE(SUM(amount), 0), COALESCE(AVG(amount), 0), COALESCE(AVG(fraud_score), 0), MAX(ts)
FROM users u LEFT JOIN tx ON u.user_id = tx.user_id GROUP BY u.user_id
""")
def joi_13(t):
    m = jn.merchant_statistics(t.tx_merchant, t.merchants).select(
        F.lit("merchant").alias("kind"), F.col("merchant_id").alias("id"), F.col("transaction_count").alias("n"),
        F.col("total_volume").alias("volume"), F.col("avg_transaction_amount").alias("mean"),
        F.col("fraud_rate").alias("rate"), F.lit(None).cast("timestamp").alias("last_at"),
    )
    u = jn.user_statistics(t.tx_slim, t.users).select(
        F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("total_transactions").alias("n"),
        F.col("total_amount").alias("volume"), F.col("avg_transaction_amount").alias("mean"),
        F.col("risk_score").alias("rate"), F.col("last_transaction_at").alias("last_at"),
    )
    return m.unionByName(u)


@query("JOI-14", uses="ev merchants", rounded="merchant_risk", sql="""
SELECT transaction_id, merchant_id, COALESCE(merchant_risk, 0.5e0) AS merchant_risk FROM ev
LEFT JOIN (SELECT * FROM merchants WHERE merchant_risk > 0.2) USING (merchant_id)
""")
def joi_14(t):
    return jn.with_merchant(t.ev, t.merchants.filter(F.col("merchant_risk") > 0.2), 0.5).select(
        "transaction_id", "merchant_id", "merchant_risk"
    )
