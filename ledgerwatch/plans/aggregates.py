"""Aggregate queries."""

from pyspark.sql import functions as F

from ledgerwatch.operators import aggregates as ag
from ledgerwatch.plans.registry import cte, query
from ledgerwatch.sources import writers
from ledgerwatch.sources.files import scratch

DAY = 86400

# Request, model and service metric rows derived from the event stream.
cte("requests", """
SELECT ts, user_id, event_type AS endpoint, CASE WHEN event_id % 17 = 0 THEN 500 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status_code,
  value * 10 AS response_time_ms, 100 + event_id % 900 AS request_bytes, 500 + event_id % 5000 AS response_bytes FROM events
""")
cte("model_metrics", """
SELECT ts, 'model_' || CAST(event_id % 3 AS VARCHAR) AS model_name,
  CASE event_id % 5 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'precision' WHEN 2 THEN 'recall' WHEN 3 THEN 'f1_score' ELSE 'auc_roc' END AS metric_type,
  (event_id % 1000) / 1000e0 AS metric_value, value AS inference_time_ms, (event_id % 97) / 970e0 AS drift_score FROM events
""")
cte("service_metrics", """
SELECT ts, 'service_' || event_type AS service_name, 'i-' || CAST(user_id % 4 AS VARCHAR) AS instance_id,
  CASE event_id % 3 WHEN 0 THEN 'cpu_usage_percent' WHEN 1 THEN 'memory_usage_percent' ELSE 'disk_usage_percent' END AS metric_name,
  CAST(event_id % 101 AS DOUBLE) AS metric_value FROM events
""")
cte("evaluations", """
SELECT ts, 'model_' || CAST(event_id % 3 AS VARCHAR) AS model_name, 'v' || CAST(event_id % 2 AS VARCHAR) AS model_version,
  (event_id % 1000) / 1000e0 AS accuracy, (event_id % 500) / 500e0 AS precision, (event_id % 300) / 300e0 AS recall, (event_id % 200) / 200e0 AS f1_score,
  value AS inference_time_ms, event_id % 1000 > 3 AS is_healthy FROM events
""")


def requests(t):
    e = F.col("event_id")
    return t.raw("events").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("endpoint"),
        F.when(e % 17 == 0, 500).when(e % 11 == 0, 404).otherwise(200).alias("status_code"),
        (F.col("value") * 10).alias("response_time_ms"), (e % 900 + 100).alias("request_bytes"),
        (e % 5000 + 500).alias("response_bytes"),
    )


def model_metrics(t):
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(m) for m in ag.METRIC_TYPES]), (e % 5 + 1).cast("int"))
    return t.raw("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("model_"), (e % 3).cast("string")).alias("model_name"),
        kind.alias("metric_type"), (e % 1000 / 1000.0).alias("metric_value"), F.col("value").alias("inference_time_ms"),
        (e % 97 / 970.0).alias("drift_score"),
    )


def service_metrics(t):
    e = F.col("event_id")
    return t.raw("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("service_"), "event_type").alias("service_name"),
        F.concat(F.lit("i-"), (F.col("user_id") % 4).cast("string")).alias("instance_id"),
        F.when(e % 3 == 0, "cpu_usage_percent").when(e % 3 == 1, "memory_usage_percent").otherwise("disk_usage_percent").alias("metric_name"),
        (e % 101).cast("double").alias("metric_value"),
    )


def evaluations(t):
    e = F.col("event_id")
    return t.raw("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("model_"), (e % 3).cast("string")).alias("model_name"),
        F.concat(F.lit("v"), (e % 2).cast("string")).alias("model_version"), (e % 1000 / 1000.0).alias("accuracy"),
        (e % 500 / 500.0).alias("precision"), (e % 300 / 300.0).alias("recall"), (e % 200 / 200.0).alias("f1_score"),
        F.col("value").alias("inference_time_ms"), (e % 1000 > 3).alias("is_healthy"),
    )


@query("AGG-1", uses="tx scored", rounded="avg_fraud_amount fraud_rate", places=4, sql="""
SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE is_fraud) AS fraud_detected, AVG(amount) FILTER (WHERE is_fraud) AS avg_fraud_amount,
  COUNT(*) FILTER (WHERE risk_level = 'LOW') AS low_risk, COUNT(*) FILTER (WHERE risk_level = 'MEDIUM') AS medium_risk,
  COUNT(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk, COUNT(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_risk,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate,
  (SELECT string_agg(transaction_id, '|' ORDER BY ts DESC, transaction_id DESC) FROM (SELECT * FROM tx ORDER BY ts DESC, transaction_id DESC LIMIT 3)) AS newest
FROM scored
""")
def agg_1(t):
    newest = ag.newest(t.tx_slim, 3).agg(
        F.array_join(
            F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("ts", "transaction_id")))), lambda r: r["transaction_id"]), "|"
        )
    ).scalar()
    return ag.dashboard_kpis(t.scored_slim).withColumn("newest", newest)


@query("AGG-2", uses="tx scored lim", rounded="avg_fraud_score total_amount avg_processing_time", places=4, sql="""
SELECT date_trunc('hour', ts) AS hour, COUNT(*) AS total_transactions, AVG(fraud_score) AS avg_fraud_score, SUM(amount) AS total_amount,
  COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT merchant_id) AS unique_merchants, AVG(processing_time_ms) AS avg_processing_time,
  COUNT(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_risk_count, COUNT(*) FILTER (WHERE risk_level = 'HIGH') AS high_risk_count,
  COUNT(*) FILTER (WHERE decision = 'DECLINED') AS declined_count, COUNT(*) FILTER (WHERE decision = 'APPROVED') AS approved_count,
  COUNT(*) FILTER (WHERE decision = 'REVIEW') AS review_count
FROM scored, lim WHERE ts > as_of - INTERVAL 30 DAY GROUP BY 1
""")
def agg_2(t):
    return ag.hourly_dashboard(t.scored_merchant, 30 * 24)


AGG3 = """
SELECT time_bucket(INTERVAL '{0}', ts) AS bucket, COUNT(*) AS total_detections, AVG(fraud_score) AS avg_fraud_score,
  COUNT(*) FILTER (WHERE decision = 'DECLINED') AS declined_count, COUNT(*) FILTER (WHERE decision = 'APPROVED') AS approved_count,
  COUNT(*) FILTER (WHERE decision = 'REVIEW') AS review_count, COUNT(DISTINCT user_id) AS unique_users,
  COUNT(DISTINCT merchant_id) AS unique_merchants, AVG(processing_time_ms) AS avg_processing_time, MAX(processing_time_ms) AS max_processing_time
FROM scored GROUP BY 1
"""


@query("AGG-3", uses="tx scored", rounded="avg_fraud_score avg_processing_time", sql=AGG3.format("1 hour"))
def agg_3(t):
    return ag.detection_summary(t.scored_merchant)


@query("AGG-4", uses="requests", rounded="avg_response_time max_response_time", places=4, sql="""
SELECT time_bucket(INTERVAL '1 day', ts) AS day, endpoint, COUNT(*) AS request_count, AVG(response_time_ms) AS avg_response_time,
  MAX(response_time_ms) AS max_response_time, COUNT(*) FILTER (WHERE status_code >= 400) AS error_count,
  COUNT(*) FILTER (WHERE status_code = 200) AS success_count, COUNT(DISTINCT user_id) AS unique_users,
  CAST(SUM(request_bytes) AS BIGINT) AS total_request_bytes, CAST(SUM(response_bytes) AS BIGINT) AS total_response_bytes FROM requests GROUP BY 1, 2
""")
def agg_4(t):
    return ag.api_daily(requests(t))


@query("AGG-5", uses="model_metrics", places=4,
       rounded="avg_accuracy avg_precision avg_recall avg_f1_score avg_auc_roc avg_inference_time avg_drift_score", sql="""
SELECT date_trunc('week', ts)::TIMESTAMP AS week, model_name, AVG(CASE WHEN metric_type = 'accuracy' THEN metric_value END) AS avg_accuracy,
  AVG(CASE WHEN metric_type = 'precision' THEN metric_value END) AS avg_precision, AVG(CASE WHEN metric_type = 'recall' THEN metric_value END) AS avg_recall,
  AVG(CASE WHEN metric_type = 'f1_score' THEN metric_value END) AS avg_f1_score, AVG(CASE WHEN metric_type = 'auc_roc' THEN metric_value END) AS avg_auc_roc,
  AVG(inference_time_ms) AS avg_inference_time, AVG(drift_score) AS avg_drift_score, COUNT(*) AS evaluation_count FROM model_metrics GROUP BY 1, 2
""")
def agg_5(t):
    return ag.model_weekly(model_metrics(t))


cte("minutes", """
SELECT time_bucket(INTERVAL '1 minute', ts) AS minute, COUNT(*) AS total_transactions, SUM(amount) AS total_amount, AVG(amount) AS avg_amount,
  COUNT(*) FILTER (WHERE is_fraud) AS fraud_transactions, SUM(CASE WHEN is_fraud THEN amount ELSE 0 END) AS fraud_amount,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate, COUNT(*) / 60e0 AS peak_tps, AVG(processing_time_ms) AS avg_processing_time_ms,
  COUNT(*) FILTER (WHERE processing_time_ms > 450) AS error_count FROM tx GROUP BY 1
""")


@query("AGG-6", uses="tx minutes", rounded="total_amount avg_amount fraud_amount avg_fraud_rate max_tps avg_processing_time", places=4, sql="""
SELECT time_bucket(INTERVAL '5 minutes', minute) AS bucket, CAST(SUM(total_transactions) AS BIGINT) AS total_transactions, SUM(total_amount) AS total_amount,
  AVG(avg_amount) AS avg_amount, CAST(SUM(fraud_transactions) AS BIGINT) AS fraud_transactions, SUM(fraud_amount) AS fraud_amount,
  AVG(fraud_rate) AS avg_fraud_rate, MAX(peak_tps) AS max_tps, AVG(avg_processing_time_ms) AS avg_processing_time, CAST(SUM(error_count) AS BIGINT) AS total_errors
FROM minutes GROUP BY 1
""")
def agg_6(t):
    return ag.volume_5min(ag.volume_rows(t.tx_slim))


@query("AGG-7", uses="tx scored", rounded="avg_fraud_score avg_processing_time", sql=AGG3.format("1 day"))
def agg_7(t):
    facts = t.scored_merchant
    last = facts.agg(F.max("ts")).scalar()
    cutoff = F.date_trunc("day", last - F.expr("INTERVAL 90 DAYS"))
    stale = ag.detection_summary(facts.filter(F.col("ts") < cutoff - F.expr("INTERVAL 7 DAYS")), DAY)
    path = scratch(t.spark, "daily-detections")
    writers.write_partitioned(stale, path, ts="bucket")
    return ag.refresh_table(
        path, facts, lambda d: ag.detection_summary(d, DAY), "bucket", DAY, cutoff - F.expr("INTERVAL 30 DAYS"), last + F.expr("INTERVAL 1 DAY")
    )


@query("AGG-8", uses="tx scored", rounded="fraud_rate avg_fraud_score avg_processing_time", places=4, sql="""
SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE decision = 'DECLINED') AS fraud_transactions,
  ROUND(COUNT(*) FILTER (WHERE decision = 'DECLINED') * 100e0 / COUNT(*), 2) AS fraud_rate, AVG(fraud_score) AS avg_fraud_score,
  AVG(processing_time_ms) AS avg_processing_time FROM scored WHERE ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01'
""")
def agg_8(t):
    return ag.fraud_stats(t.scored_slim, "1995-01-01", "1996-01-01")


@query("AGG-9", uses="requests", rounded="avg_response_time error_rate requests_per_minute", places=4, sql="""
SELECT COUNT(*) AS total_requests, AVG(response_time_ms) AS avg_response_time, COUNT(*) FILTER (WHERE status_code >= 400) * 100e0 / COUNT(*) AS error_rate,
  COUNT(*) / (14400e0) AS requests_per_minute FROM requests WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'
""")
def agg_9(t):
    return ag.api_stats(requests(t), "2024-01-05", "2024-01-15")


@query("AGG-10", uses="service_metrics", sql="""
SELECT service_name, instance_id, MAX(CASE WHEN metric_name = 'cpu_usage_percent' THEN metric_value END) AS cpu_usage,
  MAX(CASE WHEN metric_name = 'memory_usage_percent' THEN metric_value END) AS memory_usage,
  MAX(CASE WHEN metric_name = 'disk_usage_percent' THEN metric_value END) AS disk_usage, MAX(ts) AS last_update
FROM service_metrics WHERE ts > (SELECT MAX(ts) FROM service_metrics) - INTERVAL 6 HOUR GROUP BY 1, 2
""")
def agg_10(t):
    return ag.service_health(service_metrics(t), 6 * 3600)


@query("AGG-11", uses="evaluations", rounded="avg_accuracy avg_precision avg_recall avg_f1_score avg_inference_time", places=4, sql="""
SELECT model_name, model_version, AVG(accuracy) AS avg_accuracy, AVG(precision) AS avg_precision, AVG(recall) AS avg_recall, AVG(f1_score) AS avg_f1_score,
  AVG(inference_time_ms) AS avg_inference_time, COUNT(*) AS evaluation_count, MAX(ts) AS last_evaluation, BOOL_AND(is_healthy) AS all_healthy
FROM evaluations WHERE ts > (SELECT MAX(ts) FROM evaluations) - INTERVAL 2 DAY GROUP BY 1, 2
""")
def agg_11(t):
    return ag.model_performance_summary(evaluations(t), 2)


cte("confusion", """
SELECT category, COUNT(*) AS total_predictions, COUNT(*) FILTER (WHERE fraud_score > 0.5 AND is_fraud) AS true_positives,
  COUNT(*) FILTER (WHERE fraud_score <= 0.5 AND NOT is_fraud) AS true_negatives, COUNT(*) FILTER (WHERE fraud_score > 0.5 AND NOT is_fraud) AS false_positives,
  COUNT(*) FILTER (WHERE fraud_score <= 0.5 AND is_fraud) AS false_negatives, AVG(CASE WHEN is_fraud THEN fraud_score ELSE 1 - fraud_score END) AS avg_confidence
FROM tx GROUP BY 1
""")


@query("AGG-12", uses="tx confusion", rounded="avg_confidence accuracy precision recall f1_score", sql="""
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1_score FROM (
 SELECT *, (true_positives + true_negatives) / total_predictions AS accuracy,
  CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0e0 END AS precision,
  CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0e0 END AS recall FROM confusion)
""")
def agg_12(t):
    return ag.model_quality(t.tx_slim, None, keys=["category"])


@query("AGG-13", uses="tx lim", rounded="avg_fraud_score avg_processing_time", sql="""
SELECT COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 7 DAY) AS total_last_hour, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 7 DAY AND is_fraud) AS fraud_last_hour,
  AVG(fraud_score) FILTER (WHERE ts > as_of - INTERVAL 7 DAY) AS avg_fraud_score, AVG(processing_time_ms) FILTER (WHERE ts > as_of - INTERVAL 7 DAY) AS avg_processing_time,
  COUNT(*) AS total_transactions, COUNT(DISTINCT user_id) AS active_users, COUNT(DISTINCT merchant_id) AS active_merchants
FROM tx, lim WHERE ts > as_of - INTERVAL 60 DAY
""")
def agg_13(t):
    return ag.realtime_metrics(t.tx_merchant, 7 * DAY, 60 * DAY)


@query("AGG-14", uses="tx lim", rounded="fraud_rate avg_fraud_score", sql="""
SELECT CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE is_fraud) AS fraud_transactions,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate, AVG(fraud_score) AS avg_fraud_score FROM tx, lim WHERE ts > as_of - INTERVAL 90 DAY GROUP BY 1
""")
def agg_14(t):
    return ag.hour_of_day_trend(t.tx_slim, 90 * DAY)


PARTY = """
SELECT {0}, COUNT(*) AS transaction_count, COUNT(*) FILTER (WHERE is_fraud) AS fraud_count, COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) * 100 AS fraud_rate,
  AVG(fraud_score) AS avg_fraud_score, SUM(amount) AS total_amount, AVG(amount) AS avg_amount
FROM tx, lim WHERE ts > as_of - INTERVAL {1} DAY GROUP BY 1 HAVING COUNT(*) > {2} ORDER BY ROUND(AVG(fraud_score), 9) DESC, {0} LIMIT 10
"""


@query("AGG-15", uses="tx lim", rounded="fraud_rate avg_fraud_score total_amount avg_amount", places=4, sql=PARTY.format("merchant_id", 365, 10))
def agg_15(t):
    return ag.risky_parties(t.tx_merchant, "merchant_id", 10, 365 * DAY)


cte("risky_users", PARTY.format("user_id", 1825, 5))
cte("hours90", """
SELECT hour(ts) AS hour, COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate FROM tx, lim WHERE ts > as_of - INTERVAL 90 DAY GROUP BY 1
""")


@query("AGG-16", uses="tx lim risky_users hours90", rounded="avg_fraud_score avg_amount", places=4, sql="""
SELECT 'user' AS kind, CAST(user_id AS VARCHAR) AS name, transaction_count AS value, avg_fraud_score, avg_amount FROM risky_users
UNION ALL SELECT 'counter', 'velocity_anomalies', COUNT(*) FILTER (WHERE transaction_count > 50), NULL, NULL FROM risky_users
UNION ALL SELECT 'counter', 'unusual_amounts', COUNT(*) FILTER (WHERE ROUND(avg_fraud_score, 9) > 0.8e0), NULL, NULL FROM risky_users
UNION ALL SELECT 'counter', 'time_patterns', COUNT(*) FILTER (WHERE fraud_rate > 0.1e0), NULL, NULL FROM hours90
""")
def agg_16(t):
    users = ag.risky_parties(t.tx_slim, "user_id", 5, 1825 * DAY)
    counters = ag.anomaly_counters(users, users, ag.hour_of_day_trend(t.tx_slim, 90 * DAY))
    none = F.lit(None).cast("double")
    return users.select(
        F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("name"), F.col("transaction_count").alias("value"),
        "avg_fraud_score", "avg_amount",
    ).unionByName(
        counters.select(F.lit("counter").alias("kind"), F.col("metric").alias("name"), "value",
                        none.alias("avg_fraud_score"), none.alias("avg_amount"))
    )


@query("AGG-17", uses="tx", rounded="avg_risk_score", sql="""
SELECT * FROM (SELECT 'user' AS kind, user_id AS id, AVG(fraud_score) AS avg_risk_score, COUNT(*) AS transaction_count FROM tx WHERE fraud_score > 0.6
  GROUP BY user_id ORDER BY ROUND(AVG(fraud_score), 9) DESC, id LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'merchant', merchant_id AS id, AVG(fraud_score) AS avg_risk_score, COUNT(*) FROM tx WHERE fraud_score > 0.6
  GROUP BY merchant_id ORDER BY ROUND(AVG(fraud_score), 9) DESC, id LIMIT 10)
""")
def agg_17(t):
    u = ag.top_parties_above(t.tx_slim, "user_id").withColumnRenamed("user_id", "id").withColumn("kind", F.lit("user"))
    m = ag.top_parties_above(t.tx_merchant, "merchant_id").withColumnRenamed("merchant_id", "id").withColumn("kind", F.lit("merchant"))
    return u.unionByName(m)


cte("countries", """
SELECT *, CASE WHEN fraud_rate > 10 THEN 'HIGH' WHEN fraud_rate > 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM (
SELECT country, COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE is_fraud) AS fraud_transactions, COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) * 100 AS fraud_rate,
  AVG(fraud_score) AS avg_fraud_score, SUM(amount) AS total_amount, AVG(latitude) AS center_lat, AVG(longitude) AS center_lon
FROM tx, lim WHERE ts > as_of - INTERVAL 365 DAY GROUP BY 1 HAVING COUNT(*) > 10)
""")


@query("AGG-18", uses="tx lim countries", rounded="fraud_rate avg_fraud_score total_amount center_lat center_lon", places=4, sql="SELECT * FROM countries")
def agg_18(t):
    return ag.country_analytics(t.tx_place, 365 * DAY)


cte("points", """
SELECT latitude, longitude, country, COUNT(*) AS transaction_count, COUNT(*) FILTER (WHERE is_fraud) AS fraud_count,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) * 100 AS fraud_rate, AVG(fraud_score) AS avg_fraud_score, LEAST(100, COUNT(*) FILTER (WHERE is_fraud) * 10) AS intensity
FROM tx, lim WHERE ts > as_of - INTERVAL 2400 DAY GROUP BY 1, 2, 3 HAVING COUNT(*) > 1 ORDER BY fraud_count DESC, latitude, longitude, country LIMIT 50
""")


@query("AGG-19", uses="tx lim points", rounded="latitude longitude fraud_rate avg_fraud_score", sql="SELECT * FROM points")
def agg_19(t):
    return ag.point_hotspots(t.tx_place, 2400 * DAY, 1)


@query("AGG-20", uses="tx lim", rounded="avg_fraud_score", sql="""
SELECT COUNT(*) AS total_events, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 5 DAY) AS events_recent, AVG(fraud_score) AS avg_fraud_score,
  COUNT(*) FILTER (WHERE is_fraud) AS fraud_events FROM tx, lim WHERE ts > as_of - INTERVAL 60 DAY
""")
def agg_20(t):
    return ag.stream_activity(t.tx_slim, 60 * DAY, 5 * DAY)


@query("AGG-21", uses="tx lim", rounded="avg_fraud_score", sql="""
SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 5 DAY) AS last_minute, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 30 DAY) AS last_hour,
  COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 30 DAY AND is_fraud) AS fraud_last_hour, AVG(fraud_score) AS avg_fraud_score, COUNT(DISTINCT user_id) AS active_users,
  COUNT(DISTINCT merchant_id) AS active_merchants, COUNT(DISTINCT country) AS countries_active FROM tx, lim WHERE ts > as_of - INTERVAL 90 DAY
""")
def agg_21(t):
    return ag.system_monitor(t.tx, 90 * DAY, 30 * DAY, 5 * DAY)


@query("AGG-22", uses="tx lim", rounded="avg_delay", places=3, sql="""
SELECT AVG(CAST(epoch(as_of) - epoch(ts) AS BIGINT)) AS avg_delay, MAX(CAST(epoch(as_of) - epoch(ts) AS BIGINT)) AS max_delay,
  COUNT(*) FILTER (WHERE epoch(as_of) - epoch(ts) > 86400) AS delayed_transactions FROM tx, lim WHERE ts > as_of - INTERVAL 10 DAY
""")
def agg_22(t):
    return ag.delay_stats(t.tx_slim, 10 * DAY, DAY)


@query("AGG-23", uses="tx lim", rounded="fraud_rate avg_fraud_score total_amount avg_processing_time", places=4, sql="""
SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE fraud_score > 0.7) AS high_risk_transactions, COUNT(*) FILTER (WHERE fraud_score > 0.7) / COUNT(*) AS fraud_rate,
  AVG(fraud_score) AS avg_fraud_score, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT merchant_id) AS unique_merchants, SUM(amount) AS total_amount,
  AVG(processing_time_ms) AS avg_processing_time FROM tx, lim WHERE ts > as_of - INTERVAL 365 DAY
""")
def agg_23(t):
    return ag.graph_statistics(t.tx_merchant, 365 * DAY)


@query("AGG-24", uses="tx scored", places=4, rounded="total_amount avg_amount fraud_amount fraud_rate avg_fraud_score avg_processing_time_ms "
       "false_positive_rate false_negative_rate median_amount p95_processing_time_ms p99_processing_time_ms", sql="""
SELECT CAST(ts AS DATE) AS date, COUNT(*) AS total_transactions, SUM(amount) AS total_amount, AVG(amount) AS avg_amount, COUNT(*) FILTER (WHERE is_fraud) AS fraud_transactions,
  SUM(CASE WHEN is_fraud THEN amount ELSE 0 END) AS fraud_amount, COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate, AVG(fraud_score) AS avg_fraud_score,
  COUNT(DISTINCT s.user_id) AS active_users, COUNT(DISTINCT s.merchant_id) AS active_merchants, COUNT(DISTINCT country) AS unique_countries,
  AVG(processing_time_ms) AS avg_processing_time_ms, COUNT(*) FILTER (WHERE risk_level = 'CRITICAL') AS critical_alerts,
  COUNT(*) FILTER (WHERE decision = 'DECLINED' AND NOT is_fraud) / NULLIF(COUNT(*) FILTER (WHERE NOT is_fraud), 0) AS false_positive_rate,
  COUNT(*) FILTER (WHERE decision <> 'DECLINED' AND is_fraud) / NULLIF(COUNT(*) FILTER (WHERE is_fraud), 0) AS false_negative_rate,
  quantile_cont(amount, 0.5) AS median_amount, quantile_cont(processing_time_ms::DOUBLE, 0.95) AS p95_processing_time_ms, quantile_cont(processing_time_ms::DOUBLE, 0.99) AS p99_processing_time_ms,
  COUNT(DISTINCT CASE WHEN fu.d = CAST(ts AS DATE) THEN s.user_id END) AS new_users, COUNT(DISTINCT CASE WHEN fm.d = CAST(ts AS DATE) THEN s.merchant_id END) AS new_merchants
FROM scored s JOIN (SELECT user_id, MIN(CAST(ts AS DATE)) AS d FROM tx GROUP BY 1) fu ON fu.user_id = s.user_id
JOIN (SELECT merchant_id, MIN(CAST(ts AS DATE)) AS d FROM tx GROUP BY 1) fm ON fm.merchant_id = s.merchant_id GROUP BY 1
""")
def agg_24(t):
    return ag.daily_metrics(t.scored)


@query("AGG-25", uses="tx scored", places=4, rounded="transaction_amount avg_transaction_amount fraud_amount fraud_rate risk_score approval_rate decline_rate review_rate risk_score_trend", sql="""
WITH d AS (SELECT *, CAST(ts AS DATE) AS date, hour(ts) AS h FROM scored),
c AS (SELECT merchant_id, date, string_agg(country || ':' || n, '|' ORDER BY country || ':' || n) AS country_distribution FROM (SELECT merchant_id, date, country, COUNT(*) AS n FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2),
hh AS (SELECT merchant_id, date, h, COUNT(*) AS n FROM d GROUP BY 1, 2, 3),
hd AS (SELECT merchant_id, date, string_agg(h || ':' || n, '|' ORDER BY h || ':' || n) AS hourly_distribution FROM hh GROUP BY 1, 2),
pk AS (SELECT merchant_id, date, string_agg(CAST(h AS VARCHAR), '|' ORDER BY n DESC, h) AS peak_hours FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY merchant_id, date ORDER BY n DESC, h) AS r FROM hh) WHERE r <= 3 GROUP BY 1, 2),
b AS (SELECT merchant_id, date, COUNT(*) AS transaction_count, SUM(amount) AS transaction_amount, AVG(amount) AS avg_transaction_amount, COUNT(DISTINCT user_id) AS unique_customers,
 COUNT(*) FILTER (WHERE is_fraud) AS fraud_count, SUM(CASE WHEN is_fraud THEN amount ELSE 0 END) AS fraud_amount, COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate,
 AVG(fraud_score) AS risk_score, COUNT(*) FILTER (WHERE decision = 'APPROVED') / COUNT(*) AS approval_rate, COUNT(*) FILTER (WHERE decision = 'DECLINED') / COUNT(*) AS decline_rate,
 COUNT(*) FILTER (WHERE decision = 'REVIEW') / COUNT(*) AS review_rate FROM d GROUP BY 1, 2)
SELECT b.*, risk_score - LAG(risk_score) OVER (PARTITION BY merchant_id ORDER BY date) AS risk_score_trend, country_distribution, hourly_distribution, peak_hours
FROM b JOIN c USING (merchant_id, date) JOIN hd USING (merchant_id, date) JOIN pk USING (merchant_id, date)
""")
def agg_25(t):
    return ag.merchant_daily(t.scored)


@query("AGG-26", uses="tx", places=4, rounded="transaction_amount avg_transaction_amount risk_score travel_distance_km", sql="""
WITH d AS (SELECT *, CAST(ts AS DATE) AS date, hour(ts) AS h FROM tx),
l AS (SELECT *, LAG(latitude) OVER w AS pla, LAG(longitude) OVER w AS plo FROM d WINDOW w AS (PARTITION BY user_id, date ORDER BY ts, transaction_id)),
hh AS (SELECT user_id, date, string_agg(CAST(h AS VARCHAR), '|' ORDER BY n DESC, h) AS preferred_hours FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, date ORDER BY n DESC, h) AS r
  FROM (SELECT user_id, date, h, COUNT(*) AS n FROM d GROUP BY 1, 2, 3)) WHERE r <= 3 GROUP BY 1, 2),
mm AS (SELECT user_id, date, string_agg(CAST(merchant_id AS VARCHAR), '|' ORDER BY n DESC, merchant_id) AS preferred_merchants FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, date ORDER BY n DESC, merchant_id) AS r
  FROM (SELECT user_id, date, merchant_id, COUNT(*) AS n FROM d GROUP BY 1, 2, 3)) WHERE r <= 3 GROUP BY 1, 2)
SELECT user_id, date, COUNT(*) AS transaction_count, SUM(amount) AS transaction_amount, AVG(amount) AS avg_transaction_amount, AVG(fraud_score) AS risk_score,
  COUNT(*) FILTER (WHERE is_fraud) AS fraud_incidents, COUNT(DISTINCT merchant_id) AS unique_merchants, COUNT(DISTINCT category) AS unique_categories,
  COUNT(DISTINCT (latitude, longitude)) AS unique_locations, COUNT(DISTINCT device_id) AS unique_devices,
  SUM(COALESCE(12742e0 * asin(sqrt(LEAST(1e0, pow(sin((radians(latitude) - radians(pla)) / 2), 2) + cos(radians(pla)) * cos(radians(latitude)) * pow(sin((radians(longitude) - radians(plo)) / 2), 2)))), 0)) AS travel_distance_km,
  ANY_VALUE(preferred_hours) AS preferred_hours, ANY_VALUE(preferred_merchants) AS preferred_merchants, MIN(device_id) AS primary_device
FROM l JOIN hh USING (user_id, date) JOIN mm USING (user_id, date) GROUP BY 1, 2
""")
def agg_26(t):
    return ag.user_daily(t.tx)


@query("AGG-27", uses="tx merchants", sql="""
SELECT 'merchants' AS kind, merchant_category AS category, COUNT(*) AS n FROM merchants GROUP BY 2
UNION ALL SELECT 'transactions', category, COUNT(*) FROM tx GROUP BY 2
""")
def agg_27(t):
    return ag.category_counts(t.tx_slim, t.merchants)


@query("AGG-28", uses="tx", rounded="total_amount avg_fraud_score total_fraud_amount", places=4, sql="""
SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, COUNT(*) AS doc_count, SUM(amount) AS total_amount, AVG(fraud_score) AS avg_fraud_score,
  COUNT(*) FILTER (WHERE fraud_score >= 0.7) AS fraud_count, SUM(CASE WHEN fraud_score >= 0.7 THEN amount ELSE 0 END) AS total_fraud_amount FROM tx GROUP BY 1
""")
def agg_28(t):
    return ag.date_histogram(t.tx_slim)


@query("AGG-29", uses="tx scored", rounded="avg_fraud_score total_amount", places=4, sql="""
SELECT 'risk_level' AS field, risk_level AS term, COUNT(*) AS doc_count, AVG(fraud_score) AS avg_fraud_score, SUM(amount) AS total_amount FROM scored GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'merchant_id', CAST(merchant_id AS VARCHAR) AS term, COUNT(*) AS n, AVG(fraud_score), SUM(amount) FROM scored GROUP BY 2 ORDER BY n DESC, term LIMIT 10)
""")
def agg_29(t):
    return ag.union(
        [
            ag.terms(t.scored_slim, "risk_level").withColumn("field", F.lit("risk_level")),
            ag.terms(t.scored_merchant, "merchant_id", 10).withColumn("field", F.lit("merchant_id")),
        ]
    )


GEOHASH_SQL = """string_agg(substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(v AS INTEGER) + 1, 1), '' ORDER BY k)"""


@query("AGG-30", uses="tx", rounded="avg_fraud_score", sql=f"""
WITH c AS (SELECT transaction_id, fraud_score, CAST(FLOOR((longitude + 180) / 360 * 8192) AS BIGINT) AS x, CAST(FLOOR((latitude + 90) / 180 * 4096) AS BIGINT) AS y FROM tx),
b AS (SELECT transaction_id, fraud_score, p // 5 AS k, CASE WHEN p % 2 = 0 THEN (x >> (12 - p // 2)) & 1 ELSE (y >> (11 - p // 2)) & 1 END << (4 - p % 5) AS bit FROM c, range(25) r(p)),
l AS (SELECT transaction_id, fraud_score, k, SUM(bit) AS v FROM b GROUP BY 1, 2, 3),
g AS (SELECT transaction_id, fraud_score, {GEOHASH_SQL} AS cell FROM l GROUP BY 1, 2)
SELECT cell, COUNT(*) AS doc_count, AVG(fraud_score) AS avg_fraud_score FROM g GROUP BY 1
""")
def agg_30(t):
    return ag.geohash_grid(t.tx_place)


@query("AGG-31", uses="tx lim users merchants", rounded="risk_score avg_fraud_score total_amount", places=4, sql="""
WITH u AS (SELECT 'User' AS kind, CAST(u.user_id AS VARCHAR) AS entity_id, risk_score, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 365 DAY) AS recent_transactions,
  AVG(fraud_score) FILTER (WHERE ts > as_of - INTERVAL 365 DAY) AS avg_fraud_score, COUNT(transaction_id) AS total_transactions, COALESCE(SUM(amount), 0) AS total_amount, u.user_id AS k
  FROM users u CROSS JOIN lim LEFT JOIN tx ON tx.user_id = u.user_id GROUP BY u.user_id, risk_score ORDER BY ROUND(risk_score, 9) DESC, ROUND(avg_fraud_score, 9) DESC NULLS LAST, k LIMIT 10),
m AS (SELECT 'Merchant' AS kind, CAST(m.merchant_id AS VARCHAR) AS entity_id, merchant_risk AS risk_score, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 365 DAY) AS recent_transactions,
  AVG(fraud_score) FILTER (WHERE ts > as_of - INTERVAL 365 DAY) AS avg_fraud_score, COUNT(transaction_id) AS total_transactions, COALESCE(SUM(amount), 0) AS total_amount, m.merchant_id AS k
  FROM merchants m CROSS JOIN lim LEFT JOIN tx ON tx.merchant_id = m.merchant_id GROUP BY m.merchant_id, merchant_risk ORDER BY ROUND(merchant_risk, 9) DESC, ROUND(avg_fraud_score, 9) DESC NULLS LAST, k LIMIT 10),
d AS (SELECT 'Device' AS kind, device_id AS entity_id, AVG(fraud_score) AS risk_score, COUNT(DISTINCT user_id) AS recent_transactions,
  AVG(fraud_score) FILTER (WHERE ts > as_of - INTERVAL 365 DAY) AS avg_fraud_score, COUNT(*) AS total_transactions, NULL::DOUBLE AS total_amount, 0 AS k
  FROM tx, lim GROUP BY device_id ORDER BY ROUND(AVG(fraud_score), 9) DESC, recent_transactions DESC, device_id LIMIT 10)
SELECT * EXCLUDE (k) FROM u UNION ALL SELECT * EXCLUDE (k) FROM m UNION ALL SELECT * EXCLUDE (k) FROM d
""")
def agg_31(t):
    u = ag.top_risky_entities(t.tx_slim, t.users, "user_id", "risk_score", 365 * DAY).withColumn("kind", F.lit("User"))
    m = ag.top_risky_entities(t.tx_merchant, t.merchants, "merchant_id", "merchant_risk", 365 * DAY).withColumn("kind", F.lit("Merchant"))
    d = ag.top_risky_devices(t.tx_slim, 365 * DAY).select(
        F.col("device_id").alias("entity_id"), "risk_score", F.col("user_count").alias("recent_transactions"), "avg_fraud_score",
        F.col("usage_count").alias("total_transactions"), F.lit(None).cast("double").alias("total_amount"), F.lit("Device").alias("kind"),
    )
    return ag.union([u, m, d])


@query("AGG-32", uses="tx merchants", rounded="avg_fraud_score fraud_rate_pct", places=4, sql="""
SELECT merchant_id, merchant_name, merchant_category, COUNT(*) FILTER (WHERE fraud_score > 0.6) AS fraud_transactions, COUNT(*) AS total_transactions,
  AVG(fraud_score) FILTER (WHERE fraud_score > 0.6) AS avg_fraud_score, COUNT(*) FILTER (WHERE fraud_score > 0.6) * 100e0 / COUNT(*) AS fraud_rate_pct
FROM tx JOIN merchants USING (merchant_id) GROUP BY 1, 2, 3 HAVING COUNT(*) FILTER (WHERE fraud_score > 0.6) > 0
""")
def agg_32(t):
    return ag.merchant_fraud_rate(t.tx_merchant, t.merchants)


@query("AGG-33", uses="tx", rounded="risk_score avg_fraud_score", sql="""
SELECT n_name AS country, (n_nationkey * 17 % 100) / 100e0 AS risk_score, COUNT(transaction_id) AS transaction_count, COUNT(DISTINCT user_id) AS unique_users,
  COALESCE(AVG(fraud_score), 0) AS avg_fraud_score, (n_nationkey * 17 % 100) / 100e0 > 0.7e0 AS high_risk
FROM nation LEFT JOIN tx ON country = n_name GROUP BY n_name, n_nationkey
""")
def agg_33(t):
    places = t.raw("nation").select(F.col("n_name").alias("country"), (F.col("n_nationkey") * 17 % 100 / 100.0).alias("risk_score"))
    return ag.location_summary(t.tx_place, places)


@query("AGG-34", uses="tx users", sql="""
SELECT (SELECT COUNT(*) FROM customer) + (SELECT COUNT(DISTINCT merchant_id) FROM tx) + (SELECT COUNT(DISTINCT device_id) FROM tx) + (SELECT COUNT(*) FROM tx) AS total_nodes,
  (SELECT COUNT(*) FROM tx) * 2 + (SELECT COUNT(*) FROM (SELECT DISTINCT user_id, device_id FROM tx)) + (SELECT COUNT(*) FROM (SELECT DISTINCT user_id, merchant_id FROM tx)) AS total_relationships,
  (SELECT COUNT(DISTINCT user_id) FROM tx JOIN users USING (user_id) WHERE risk_score > 0.7) AS suspicious_users
""")
def agg_34(t):
    from ledgerwatch.operators import graph

    nodes, edges = graph.build_graph(t.tx_merchant, t.users)
    return ag.graph_totals(nodes, edges)


@query("AGG-35", uses="ev", sql="""
SELECT 'severity' AS field, CASE WHEN amount > 15 THEN 'high' WHEN amount > 5 THEN 'medium' ELSE 'low' END AS value, COUNT(*) AS n FROM ev GROUP BY 2
UNION ALL SELECT 'channel', channel, COUNT(*) FROM ev GROUP BY 2
""")
def agg_35(t):
    a = F.col("amount")
    events = t.ev.withColumn("severity", F.when(a > 15, "high").when(a > 5, "medium").otherwise("low"))
    return ag.value_counts(events, ["severity", "channel"])


@query("AGG-36", uses="", sql="""
WITH e AS (SELECT event_type, user_id % 4 AS partition, event_id AS "offset" FROM events),
c AS (SELECT user_id % 4 AS partition, MAX(event_id) AS committed FROM events WHERE ts < (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY AND user_id % 4 <> 3 GROUP BY 1),
l AS (SELECT partition, GREATEST(MAX("offset") - COALESCE(ANY_VALUE(committed), -1), 0) AS lag FROM e LEFT JOIN c USING (partition) GROUP BY 1)
SELECT partition, event_type, COUNT(*) AS events, ANY_VALUE(lag) AS lag FROM e JOIN l USING (partition) GROUP BY 1, 2
""")
def agg_36(t):
    e = t.raw("events").select("event_type", (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("ts"))
    cut = e.agg(F.max("ts")).scalar() - F.expr("INTERVAL 1 DAY")
    done = e.filter((F.col("ts") < cut) & (F.col("partition") != 3)).groupBy("partition").agg(F.max("offset").alias("committed"))
    return ag.stream_health(e.drop("ts"), done)


@query("AGG-37", uses="ev", rounded="utilization_percent", sql="""
SELECT tenant_id, tier, date_trunc('day', ts)::TIMESTAMP AS period_start, COUNT(*) AS current_usage, lim AS usage_limit, COUNT(*) / lim * 100 AS utilization_percent FROM (
 SELECT user_id % 4 AS tenant_id, CASE user_id % 4 WHEN 0 THEN 'FREE' WHEN 1 THEN 'BASIC' WHEN 2 THEN 'PREMIUM' ELSE 'ENTERPRISE' END AS tier, ts,
  CASE user_id % 4 WHEN 0 THEN 1000 WHEN 1 THEN 10000 WHEN 2 THEN 100000 ELSE 1000000 END::BIGINT AS lim FROM ev) GROUP BY 1, 2, 3, lim
""")
def agg_37(t):
    u = F.col("user_id") % 4
    calls = t.ev.select(
        u.alias("tenant_id"), F.when(u == 0, "FREE").when(u == 1, "BASIC").when(u == 2, "PREMIUM").otherwise("ENTERPRISE").alias("tier"), "ts"
    )
    return ag.tenant_usage(calls, "day")


@query("AGG-38", uses="ev", sql="""
SELECT channel, time_bucket(INTERVAL '1 hour', ts) AS window_start, COUNT(*) AS requests, LEAST(COUNT(*), 3) AS allowed, GREATEST(COUNT(*) - 3, 0) AS denied FROM ev GROUP BY 1, 2
""")
def agg_38(t):
    return ag.fixed_window_limit(t.ev, "channel", 3, 3600)


@query("AGG-39", uses="tx", rounded="fraud_score", sql="""
SELECT transaction_id, fraud_score FROM tx ORDER BY fraud_score DESC, transaction_id LIMIT 100
""")
def agg_39(t):
    return ag.best_scores(t.tx_slim.select("transaction_id", "fraud_score"), 100)


@query("AGG-40", uses="tx lim", rounded="value", sql="""
SELECT 'transactions_total' AS metric, CAST(COUNT(*) AS DOUBLE) AS value, 'count' AS unit FROM tx
UNION ALL SELECT 'missing_merchant_ratio', AVG(CASE WHEN merchant_id = 0 THEN 100e0 ELSE 0e0 END), 'percentage' FROM tx
UNION ALL SELECT 'transactions_today', CAST(COUNT(*) AS DOUBLE), 'count' FROM tx, lim WHERE ts >= date_trunc('day', as_of)
""")
def agg_40(t):
    return ag.health_metrics(t.tx_merchant)


@query("AGG-41", uses="tx lim merchants", rounded="fraud_rate avg_fraud_score", sql="""
SELECT merchant_id, merchant_name, merchant_category, COUNT(*) AS transaction_count, COUNT(*) FILTER (WHERE is_fraud) AS fraud_count,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate, AVG(fraud_score) AS avg_fraud_score
FROM merchants JOIN tx USING (merchant_id), lim WHERE ts > as_of - INTERVAL 365 DAY GROUP BY 1, 2, 3 ORDER BY fraud_count DESC, merchant_id LIMIT 10
""")
def agg_41(t):
    return ag.merchant_trend(t.tx_merchant, t.merchants, 365 * DAY)


@query("AGG-42", uses="tx lim countries points", sql="""
SELECT (SELECT COUNT(*) FROM countries) AS total_countries, (SELECT COUNT(*) FROM countries WHERE risk_level = 'HIGH') AS high_risk_countries,
  (SELECT COUNT(*) FROM points) AS active_hotspots, (SELECT COUNT(*) FROM (SELECT (abs(latitude - LAG(latitude) OVER w) + abs(longitude - LAG(longitude) OVER w)) AS d,
    (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 3.6e9 AS h FROM tx WINDOW w AS (PARTITION BY user_id ORDER BY ts, transaction_id)) WHERE h < 240 AND d > 0.5 AND d / NULLIF(h, 0) > 0.01) AS velocity_alerts
""")
def agg_42(t):
    from ledgerwatch.operators import windows

    velocity = windows.impossible_travel(t.tx_place, None, 0.5, 240, 0.01, None)
    return ag.geo_summary(ag.country_analytics(t.tx_place, 365 * DAY), ag.point_hotspots(t.tx_place, 2400 * DAY, 1), velocity)


@query("AGG-43", uses="tx confusion", rounded="accuracy precision recall", sql="""
SELECT AVG((true_positives + true_negatives) / total_predictions) AS accuracy, AVG(true_positives / (true_positives + false_positives)) AS precision,
  AVG(true_positives / (true_positives + false_negatives)) AS recall, COUNT(*) AS models FROM confusion
""")
def agg_43(t):
    return ag.ensemble_figures(ag.model_quality(t.tx_slim, None, keys=["category"]), ["accuracy", "precision", "recall"])


@query("AGG-44", uses="tx lim", rounded="fraud_rate", sql="""
SELECT CAST(d AS DATE) AS date, COUNT(transaction_id) AS total_transactions, COUNT(transaction_id) FILTER (WHERE is_fraud) AS fraud_transactions,
  COALESCE(COUNT(transaction_id) FILTER (WHERE is_fraud) / NULLIF(COUNT(transaction_id), 0), 0) AS fraud_rate
FROM (SELECT CAST(as_of AS DATE) - CAST(i AS INTEGER) AS d FROM lim, range(30) r(i)) LEFT JOIN tx ON CAST(ts AS DATE) = d GROUP BY 1
""")
def agg_44(t):
    return ag.daily_trend(t.tx_slim)


@query("AGG-45", uses="tx", rounded="value", sql="""
SELECT 'weekend_fraud_rate' AS metric, AVG(CASE WHEN isodow(ts) >= 6 THEN CAST(is_fraud AS INTEGER) END) AS value FROM tx
UNION ALL SELECT 'high_value_fraud_rate', AVG(CASE WHEN amount > 5000 THEN CAST(is_fraud AS INTEGER) END) FROM tx
UNION ALL SELECT 'micro_transactions', COUNT(*) FILTER (WHERE amount < 1) FROM tx
UNION ALL SELECT 'round_amounts', COUNT(*) FILTER (WHERE amount > 0 AND amount % 5 = 0) FROM tx
UNION ALL SELECT 'burst_transactions', COUNT(*) FROM (SELECT COUNT(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 863999999999 PRECEDING AND CURRENT ROW) AS n FROM tx) WHERE n >= 2
UNION ALL SELECT 'repeated_amounts', COALESCE(SUM(n), 0) FROM (SELECT COUNT(*) AS n FROM tx GROUP BY user_id, amount HAVING COUNT(*) >= 2)
UNION ALL SELECT * FROM (SELECT 'peak_hour_' || CAST(hour(ts) AS VARCHAR), COUNT(*) AS n FROM tx WHERE is_fraud GROUP BY hour(ts) ORDER BY n DESC, hour(ts) LIMIT 3)
""")
def agg_45(t):
    hours = ag.peak_fraud_hours(t.tx_slim).select(
        F.concat(F.lit("peak_hour_"), F.col("hour").cast("string")).alias("metric"), F.col("fraud_transactions").cast("double").alias("value")
    )
    return ag.pattern_counters(t.tx_slim, burst_seconds=864000, burst_count=2, round_unit=5).unionByName(hours)


@query("AGG-46", uses="tx lim", rounded="fraud_rate total_amount_fraud", places=4, sql="""
SELECT *, CASE WHEN fraud_rate > 0.1 THEN 'HIGH' WHEN fraud_rate > 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM (
SELECT country, CAST(FLOOR(latitude) AS BIGINT) AS area_lat, CAST(FLOOR(longitude) AS BIGINT) AS area_lon, COUNT(*) FILTER (WHERE is_fraud) AS fraud_count, COUNT(*) AS total_transactions,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) AS fraud_rate, SUM(CASE WHEN is_fraud THEN amount ELSE 0 END) AS total_amount_fraud
FROM tx, lim WHERE ts > as_of - INTERVAL 180 DAY GROUP BY 1, 2, 3 HAVING COUNT(*) FILTER (WHERE is_fraud) >= 1)
""")
def agg_46(t):
    return ag.area_hotspots(t.tx_place, 180 * DAY)


@query("AGG-47", uses="tx lim", rounded="transactions_per_second events_per_second fraud_percent", places=8, sql="""
SELECT COUNT(*) / 8640000e0 AS transactions_per_second, COUNT(*) FILTER (WHERE ts > as_of - INTERVAL 10 DAY) / 864000e0 AS events_per_second,
  COUNT(*) FILTER (WHERE is_fraud) / COUNT(*) * 100 AS fraud_percent FROM tx, lim WHERE ts > as_of - INTERVAL 100 DAY
""")
def agg_47(t):
    return ag.live_rates(t.tx_slim, 100 * DAY, 10 * DAY)
