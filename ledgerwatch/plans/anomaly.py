"""Anomaly queries."""

from ledgerwatch.operators import anomaly as an
from ledgerwatch.plans.joins import HAV
from ledgerwatch.plans.registry import query


@query("ANO-1", uses="ev", rounded="amount anomaly_score", sql="""
SELECT transaction_id, user_id, amount, z AS anomaly_score FROM (SELECT *, COUNT(*) OVER w AS n, STDDEV_POP(amount) OVER w AS s,
  abs((amount - AVG(amount) OVER w) / NULLIF(STDDEV_POP(amount) OVER w, 0)) AS z FROM ev WINDOW w AS (PARTITION BY user_id)) WHERE n > 3 AND s > 0 AND z > 2.5
""")
def ano_1(t):
    return an.amount_anomalies(t.ev).select("transaction_id", "user_id", "amount", "anomaly_score")


@query("ANO-2", uses="ev", rounded="anomaly_score", sql="""
SELECT transaction_id, bucket, n / 3e0 AS anomaly_score FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id, bucket) AS n FROM (SELECT *, time_bucket(INTERVAL '12 hours', ts) AS bucket FROM ev)) WHERE n > 3
""")
def ano_2(t):
    return an.velocity_anomalies(t.ev, 3, 43200).select("transaction_id", "bucket", "anomaly_score")


@query("ANO-3", uses="tx", rounded="amount anomaly_score", sql="""
SELECT transaction_id, amount, 0.8e0 AS anomaly_score FROM tx WHERE amount > 0 AND amount % 5 = 0
""")
def ano_3(t):
    return an.round_anomalies(t.tx_slim, 5).select("transaction_id", "amount", "anomaly_score")


ANO4 = """
SELECT '{0}' AS kind, user_id, bucket, value, history, typical, (value - typical) / s AS anomaly_score FROM (
 SELECT *, COUNT(value) OVER w AS history, AVG(value) OVER w AS typical, STDDEV_POP(value) OVER w AS s FROM (
  SELECT user_id, time_bucket(INTERVAL '{1}', ts) AS bucket, {2} AS value FROM ev GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY user_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE history >= 5 AND s > 1e-9 AND (value - typical) / s > 2
"""


@query("ANO-4", uses="ev", rounded="value typical anomaly_score", places=4,
       sql=ANO4.format("mean", "15 minutes", "AVG(amount)") + " UNION ALL " + ANO4.format("count", "1 day", "CAST(COUNT(*) AS DOUBLE)"))
def ano_4(t):
    from pyspark.sql import functions as F

    mean = an.bucket_anomalies(t.ev, 900, "mean", 2.0).withColumn("kind", F.lit("mean"))
    count = an.bucket_anomalies(t.ev, 86400, "count", 2.0).withColumn("kind", F.lit("count"))
    return mean.unionByName(count)


@query("ANO-5", uses="tx lim", rounded="normal_value detected_value", places=4, sql=f"""
WITH a AS (SELECT *, (epoch_us(as_of) - epoch_us(ts)) / 1e6 AS age FROM tx, lim),
f AS (SELECT user_id, CAST(COUNT(*) FILTER (WHERE age < 8640000) AS DOUBLE) AS n, COUNT(*) FILTER (WHERE age >= 8640000 AND age < 181440000) / 20e0 AS un,
  AVG(amount) FILTER (WHERE age < 8640000) AS m, AVG(amount) FILTER (WHERE age >= 8640000 AND age < 181440000) AS um FROM a GROUP BY 1),
v AS (SELECT user_id, MAX(d / h) AS v FROM (SELECT user_id, age, {HAV.format('LAG(latitude) OVER w', 'LAG(longitude) OVER w', 'latitude', 'longitude')} AS d, (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 3.6e9 AS h
  FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, transaction_id)) WHERE h > 0 AND age < 8640000 GROUP BY 1),
u AS (SELECT user_id, 'HIGH_FREQUENCY' AS anomaly_type, un AS normal_value, n AS detected_value FROM f WHERE n > 0 AND un > 0 AND n > un * 3
 UNION ALL SELECT user_id, 'AMOUNT_SPIKE', um, m FROM f WHERE n > 0 AND m > um * 3 UNION ALL SELECT user_id, 'GEOGRAPHIC_VELOCITY', 0.1e0, v FROM v WHERE v > 0.1e0)
SELECT *, CASE WHEN detected_value / normal_value >= 9 THEN 'CRITICAL' WHEN detected_value / normal_value >= 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM u
""")
def ano_5(t):
    day = 86400
    return an.user_anomalies(t.tx_place, 100 * day, 2000 * day, 3.0, 0.1)
