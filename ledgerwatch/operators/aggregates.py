"""Key figures, time buckets, rankings and summary tables.

Distinct counts are exact; pass ``approximate=True`` where the operator offers it.  Quantiles come from
:func:`ledgerwatch.functions.timeline.exact_quantiles`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import by_mean, geohash, haversine_km, micros, safe_ratio, time_bucket
from ledgerwatch.operators.common import anchor, event_age, since
from ledgerwatch.operators.rules import is_round
from ledgerwatch.sources.writers import refresh_partitions

DAY, HOUR, MINUTE = 86_400, 3_600, 60


def row_count() -> Column:
    return F.count(F.lit(1))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def distinct(column: str, approximate: bool = False) -> Column:
    return F.approx_count_distinct(column) if approximate else F.count_distinct(column)


def metric_rows(df: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    return df.unpivot([], [F.col(c).cast("double").alias(c) for c in df.columns], "metric", "value")


def top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


# ---- key figures ----------------------------------------------------------------------------

def dashboard_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        row_count().alias("total_transactions"),
        F.count_if("is_fraud").alias("fraud_detected"),
        F.avg(F.when(F.col("is_fraud"), F.col("amount"))).alias("avg_fraud_amount"),
        *[F.count_if(F.col("risk_level") == r.upper()).alias(f"{r}_risk") for r in ("low", "medium", "high", "critical")],
    ).withColumn("fraud_rate", safe_ratio(F.col("fraud_detected"), F.col("total_transactions")))


def newest(df: DataFrame, k: int = 3) -> DataFrame:
    return top(df, k, F.desc("ts"), F.desc("transaction_id"))


def hourly_dashboard(df: DataFrame, last_hours: float | None = 24, as_of=None, approximate: bool = False) -> DataFrame:
    recent = since(df, None if last_hours is None else last_hours * HOUR, as_of)
    return recent.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        row_count().alias("total_transactions"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.sum("amount").alias("total_amount"),
        distinct("user_id", approximate).alias("unique_users"),
        distinct("merchant_id", approximate).alias("unique_merchants"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_risk_count"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_count"),
        *[F.count_if(F.col("decision") == d.upper()).alias(f"{d}_count") for d in ("declined", "approved", "review")],
    )


def detection_summary(df: DataFrame, bucket_seconds: int = HOUR, approximate: bool = False) -> DataFrame:
    return df.groupBy(time_bucket(bucket_seconds, "ts").alias("bucket")).agg(
        row_count().alias("total_detections"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        *[F.count_if(F.col("decision") == d.upper()).alias(f"{d}_count") for d in ("declined", "approved", "review")],
        distinct("user_id", approximate).alias("unique_users"),
        distinct("merchant_id", approximate).alias("unique_merchants"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
        F.max("processing_time_ms").alias("max_processing_time"),
    )


def api_daily(requests: DataFrame) -> DataFrame:
    """``requests``: ts, endpoint, status_code, response_time_ms, user_id, request_bytes, response_bytes."""
    return requests.groupBy(time_bucket(DAY, "ts").alias("day"), "endpoint").agg(
        row_count().alias("request_count"),
        F.avg("response_time_ms").alias("avg_response_time"),
        F.max("response_time_ms").alias("max_response_time"),
        F.count_if(F.col("status_code") >= 400).alias("error_count"),
        F.count_if(F.col("status_code") == 200).alias("success_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.sum("request_bytes").alias("total_request_bytes"),
        F.sum("response_bytes").alias("total_response_bytes"),
    )


METRIC_TYPES = ["accuracy", "precision", "recall", "f1_score", "auc_roc"]


def model_weekly(metrics: DataFrame) -> DataFrame:
    """Tall metric rows (ts, model_name, metric_type, metric_value, inference_time_ms, drift_score) by Monday week."""
    return metrics.groupBy(F.date_trunc("week", "ts").alias("week"), "model_name").agg(
        *[
            F.avg(F.when(F.col("metric_type") == m, F.col("metric_value"))).alias(f"avg_{m}") for m in METRIC_TYPES
        ],
        F.avg("inference_time_ms").alias("avg_inference_time"),
        F.avg("drift_score").alias("avg_drift_score"),
        row_count().alias("evaluation_count"),
    )


def volume_rows(df: DataFrame) -> DataFrame:
    """Per-minute volume rows, the input of the five-minute roll-up."""
    return df.groupBy(time_bucket(MINUTE, "ts").alias("minute")).agg(
        row_count().alias("total_transactions"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.count_if("is_fraud").alias("fraud_transactions"),
        F.sum(F.when(F.col("is_fraud"), F.col("amount")).otherwise(0.0)).alias("fraud_amount"),
        (F.count_if("is_fraud") / row_count()).alias("fraud_rate"),
        (row_count() / 60.0).alias("peak_tps"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        F.count_if(F.col("processing_time_ms") > 450).alias("error_count"),
    )


def volume_5min(rows: DataFrame) -> DataFrame:
    return rows.groupBy(time_bucket(300, "minute").alias("bucket")).agg(
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("total_amount").alias("total_amount"),
        F.avg("avg_amount").alias("avg_amount"),
        F.sum("fraud_transactions").alias("fraud_transactions"),
        F.sum("fraud_amount").alias("fraud_amount"),
        F.avg("fraud_rate").alias("avg_fraud_rate"),
        F.max("peak_tps").alias("max_tps"),
        F.avg("avg_processing_time_ms").alias("avg_processing_time"),
        F.sum("error_count").alias("total_errors"),
    )


def refresh_table(
    path: str, facts: DataFrame, aggregate: Callable[[DataFrame], DataFrame], bucket: str, bucket_seconds: int, start: Column, end: Column,
    ts: str = "ts", period: str = "month",
) -> DataFrame:
    """The stored bucket table at ``path`` with the buckets of [start, end) computed anew; writes the changed partitions only."""
    low, high = time_bucket(bucket_seconds, start), time_bucket(bucket_seconds, end)
    fresh = aggregate(facts.filter((F.col(ts) >= low) & (F.col(ts) < high)))
    return refresh_partitions(path, fresh, bucket, low, high, period)


def fraud_stats(df: DataFrame, start=None, end=None, as_of=None) -> DataFrame:
    """Totals of a closed time range (default: the last hour)."""
    last = anchor(df, as_of) if end is None else F.lit(end).cast("timestamp")
    first = last - F.expr("INTERVAL 1 HOUR") if start is None else F.lit(start).cast("timestamp")
    return df.filter(F.col("ts").between(first, last)).agg(
        row_count().alias("total_transactions"),
        F.count_if(F.col("decision") == "DECLINED").alias("fraud_transactions"),
        F.round(F.try_divide(F.count_if(F.col("decision") == "DECLINED") * 100.0, row_count()), 2).alias("fraud_rate"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
    )


def api_stats(requests: DataFrame, start, end) -> DataFrame:
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    minutes = (F.unix_seconds(last) - F.unix_seconds(first)) / 60.0
    return requests.filter(F.col("ts").between(first, last)).agg(
        row_count().alias("total_requests"),
        F.avg("response_time_ms").alias("avg_response_time"),
        F.try_divide(F.count_if(F.col("status_code") >= 400) * 100.0, row_count()).alias("error_rate"),
        (row_count() / F.max(minutes)).alias("requests_per_minute"),
    )


def service_health(metrics: DataFrame, seconds: float = 300, as_of=None) -> DataFrame:
    """Metric rows (ts, service_name, instance_id, metric_name, metric_value) turned into one row per instance."""
    names = {"cpu_usage_percent": "cpu_usage", "memory_usage_percent": "memory_usage", "disk_usage_percent": "disk_usage"}
    return since(metrics, seconds, as_of).groupBy("service_name", "instance_id").agg(
        *[F.max(F.when(F.col("metric_name") == m, F.col("metric_value"))).alias(a) for m, a in names.items()],
        F.max("ts").alias("last_update"),
    )


def model_performance_summary(evaluations: DataFrame, days: float = 30, as_of=None) -> DataFrame:
    return since(evaluations, days * DAY, as_of).groupBy("model_name", "model_version").agg(
        *[F.avg(m).alias(f"avg_{m}") for m in ("accuracy", "precision", "recall", "f1_score")],
        F.avg("inference_time_ms").alias("avg_inference_time"),
        row_count().alias("evaluation_count"),
        F.max("ts").alias("last_evaluation"),
        F.bool_and("is_healthy").alias("all_healthy"),
    )


def confusion_counts(score: Column, label: Column, threshold: float = 0.5) -> dict[str, Column]:
    hit = score > threshold
    return {
        "true_positives": F.count_if(hit & label),
        "true_negatives": F.count_if(~hit & ~label),
        "false_positives": F.count_if(hit & ~label),
        "false_negatives": F.count_if(~hit & label),
    }


def rates_from_confusion(df: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    out = df.withColumns(
        {
            "accuracy": safe_ratio(tp + tn, tp + tn + fp + fn),
            "precision": safe_ratio(tp, tp + fp),
            "recall": safe_ratio(tp, tp + fn),
        }
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1_score", safe_ratio(2 * p * r, p + r))


def model_quality(df: DataFrame, seconds: float | None = 7 * DAY, threshold: float = 0.5, keys=(), as_of=None) -> DataFrame:
    s, y = F.col("fraud_score"), F.col("is_fraud")
    counts = since(df, seconds, as_of).groupBy(*keys).agg(
        row_count().alias("total_predictions"),
        *[c.alias(n) for n, c in confusion_counts(s, y, threshold).items()],
        F.avg(F.when(y, s).otherwise(1 - s)).alias("avg_confidence"),
    )
    return rates_from_confusion(counts)


def realtime_metrics(df: DataFrame, recent_seconds: float = HOUR, day_seconds: float = DAY, as_of=None) -> DataFrame:
    """Counts and means of the short window, distinct parties of the long one, in one pass."""
    newest_ts = anchor(df, as_of)
    long = df.filter(F.unix_micros("ts") > F.unix_micros(newest_ts) - F.lit(int(day_seconds * 1e6)))
    short = F.unix_micros("ts") > F.unix_micros(newest_ts) - F.lit(int(recent_seconds * 1e6))
    return long.agg(
        F.count_if(short).alias("total_last_hour"),
        F.count_if(short & F.col("is_fraud")).alias("fraud_last_hour"),
        F.avg(F.when(short, F.col("fraud_score"))).alias("avg_fraud_score"),
        F.avg(F.when(short, F.col("processing_time_ms"))).alias("avg_processing_time"),
        row_count().alias("total_transactions"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_distinct("merchant_id").alias("active_merchants"),
    )


def hour_of_day_trend(df: DataFrame, seconds: float | None = 7 * DAY, as_of=None) -> DataFrame:
    return since(df, seconds, as_of).groupBy(F.hour("ts").alias("hour")).agg(
        row_count().alias("total_transactions"),
        F.count_if("is_fraud").alias("fraud_transactions"),
        (F.count_if("is_fraud") / row_count()).alias("fraud_rate"),
        F.avg("fraud_score").alias("avg_fraud_score"),
    )


def risky_parties(
    df: DataFrame, party: str, min_count: int, seconds: float | None = 7 * DAY, k: int = 10, as_of=None
) -> DataFrame:
    """Merchants or users with enough recent transactions, by mean score."""
    found = since(df, seconds, as_of).groupBy(party).agg(
        row_count().alias("transaction_count"),
        F.count_if("is_fraud").alias("fraud_count"),
        (F.count_if("is_fraud") / row_count() * 100).alias("fraud_rate"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
    ).filter(F.col("transaction_count") > min_count)
    return top(found, k, by_mean("avg_fraud_score"), party)


def anomaly_counters(merchants: DataFrame, users: DataFrame, hours: DataFrame) -> DataFrame:
    """Counters derived from the risky-party lists and the hourly trend."""
    return union(
        [
            merchants.agg(F.count_if(F.round("avg_fraud_score", 9) > 0.8).alias("value")).select(
                F.lit("unusual_amounts").alias("metric"), "value"
            ),
            users.agg(F.count_if(F.col("transaction_count") > 50).alias("value")).select(
                F.lit("velocity_anomalies").alias("metric"), "value"
            ),
            hours.agg(F.count_if(F.col("fraud_rate") > 0.1).alias("value")).select(
                F.lit("time_patterns").alias("metric"), "value"
            ),
        ]
    )


def top_parties_above(df: DataFrame, party: str, score: float = 0.6, k: int = 10) -> DataFrame:
    found = df.filter(F.col("fraud_score") > score).groupBy(party).agg(
        F.avg("fraud_score").alias("avg_risk_score"), row_count().alias("transaction_count")
    )
    return top(found, k, by_mean("avg_risk_score"), party)


def country_analytics(df: DataFrame, seconds: float | None = 30 * DAY, min_count: int = 10, as_of=None) -> DataFrame:
    located = since(df, seconds, as_of).filter(
        F.col("country").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    rate = F.col("fraud_rate")
    return (
        located.groupBy("country")
        .agg(
            row_count().alias("total_transactions"),
            F.count_if("is_fraud").alias("fraud_transactions"),
            (F.count_if("is_fraud") / row_count() * 100).alias("fraud_rate"),
            F.avg("fraud_score").alias("avg_fraud_score"),
            F.sum("amount").alias("total_amount"),
            F.avg("latitude").alias("center_lat"),
            F.avg("longitude").alias("center_lon"),
        )
        .filter(F.col("total_transactions") > min_count)
        .withColumn("risk_level", F.when(rate > 10, "HIGH").when(rate > 5, "MEDIUM").otherwise("LOW"))
    )


def point_hotspots(df: DataFrame, seconds: float | None = HOUR, min_count: int = 5, k: int = 50, as_of=None) -> DataFrame:
    located = since(df, seconds, as_of).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    found = located.groupBy("latitude", "longitude", "country").agg(
        row_count().alias("transaction_count"),
        F.count_if("is_fraud").alias("fraud_count"),
        (F.count_if("is_fraud") / row_count() * 100).alias("fraud_rate"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.least(F.lit(100).cast("long"), F.count_if("is_fraud") * 10).alias("intensity"),
    ).filter(F.col("transaction_count") > min_count)
    return top(found, k, F.desc("fraud_count"), "latitude", "longitude", "country")


def stream_activity(df: DataFrame, seconds: float = HOUR, recent_seconds: float = MINUTE, as_of=None) -> DataFrame:
    newest_us = F.unix_micros(anchor(df, as_of))
    return since(df, seconds, as_of).agg(
        row_count().alias("total_events"),
        F.count_if(F.unix_micros("ts") > newest_us - F.lit(int(recent_seconds * 1e6))).alias("events_recent"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.count_if("is_fraud").alias("fraud_events"),
    )


def system_monitor(df: DataFrame, day: float = DAY, hour: float = HOUR, minute: float = MINUTE, as_of=None) -> DataFrame:
    newest_us = F.unix_micros(anchor(df, as_of))

    def within(seconds):
        return F.unix_micros("ts") > newest_us - F.lit(int(seconds * 1e6))

    return df.filter(within(day)).agg(
        row_count().alias("total_transactions"),
        F.count_if(within(minute)).alias("last_minute"),
        F.count_if(within(hour)).alias("last_hour"),
        F.count_if(within(hour) & F.col("is_fraud")).alias("fraud_last_hour"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_distinct("merchant_id").alias("active_merchants"),
        F.count_distinct("country").alias("countries_active"),
    )


def delay_stats(df: DataFrame, seconds: float = HOUR, late_seconds: float = 60, as_of=None) -> DataFrame:
    age = event_age(df, as_of)
    return since(df, seconds, as_of).agg(
        F.avg(age).alias("avg_delay"),
        F.max(age).alias("max_delay"),
        F.count_if(age > late_seconds).alias("delayed_transactions"),
    )


def graph_statistics(df: DataFrame, seconds: float | None = DAY, as_of=None) -> DataFrame:
    return since(df, seconds, as_of).agg(
        row_count().alias("total_transactions"),
        F.count_if(F.col("fraud_score") > 0.7).alias("high_risk_transactions"),
        (F.count_if(F.col("fraud_score") > 0.7) / F.greatest(row_count(), F.lit(1))).alias("fraud_rate"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("merchant_id").alias("unique_merchants"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_amount"),
        F.avg("processing_time_ms").alias("avg_processing_time"),
    )


# ---- daily tables ---------------------------------------------------------------------------

def first_days(df: DataFrame, party: str, name: str) -> DataFrame:
    """Number of parties first seen on each date."""
    return (
        df.groupBy(party).agg(F.min(F.to_date("ts")).alias("date")).groupBy("date").agg(row_count().alias(name))
    )


def daily_metrics(df: DataFrame) -> DataFrame:
    """One row per date: volumes, quantiles, new and active parties, error rates of the decline decision."""
    dated = df.withColumn("date", F.to_date("ts"))
    declined, fraud = F.col("decision") == "DECLINED", F.col("is_fraud")
    base = dated.groupBy("date").agg(
        row_count().alias("total_transactions"),
        F.sum("amount").alias("total_amount"),
        F.avg("amount").alias("avg_amount"),
        F.count_if(fraud).alias("fraud_transactions"),
        F.sum(F.when(fraud, F.col("amount")).otherwise(0.0)).alias("fraud_amount"),
        (F.count_if(fraud) / row_count()).alias("fraud_rate"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.count_distinct("user_id").alias("active_users"),
        F.count_distinct("merchant_id").alias("active_merchants"),
        F.count_distinct("country").alias("unique_countries"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"),
        F.count_if(F.col("risk_level") == "CRITICAL").alias("critical_alerts"),
        (F.count_if(declined & ~fraud) / F.nullif(F.count_if(~fraud), F.lit(0))).alias("false_positive_rate"),
        (F.count_if(~declined & fraud) / F.nullif(F.count_if(fraud), F.lit(0))).alias("false_negative_rate"),
    )
    # both measures share one counting pass
    tall = dated.select("date", "amount", F.col("processing_time_ms").cast("double").alias("latency")).unpivot(
        ["date"], ["amount", "latency"], "measure", "value"
    )
    ranks = tl.exact_quantiles(tall, ["date", "measure"], "value", {"q50": 0.5, "q95": 0.95, "q99": 0.99})
    of = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))
    quantiles = ranks.groupBy("date").agg(
        of("amount", "q50").alias("median_amount"), of("latency", "q95").alias("p95_processing_time_ms"),
        of("latency", "q99").alias("p99_processing_time_ms"),
    )
    out = base
    for part in (quantiles, first_days(df, "user_id", "new_users"), first_days(df, "merchant_id", "new_merchants")):
        out = out.join(part, "date", "left")
    return out.fillna(0, ["new_users", "new_merchants"])


def histogram_text(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Counts of ``column`` per group as ``value:count`` text, sorted by value (for columns of few values)."""
    counts = df.groupBy(*keys, F.col(column).cast("string").alias("_v")).agg(row_count().alias("_n"))
    entry = F.concat_ws(":", "_v", F.col("_n").cast("string"))
    return counts.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(entry)), "|").alias(name))


def merchant_daily(df: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Merchant and date: rates, change of mean score, distributions and peak hours."""
    dated = df.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts")})
    keys = ["merchant_id", "date"]
    base = dated.groupBy(*keys).agg(
        row_count().alias("transaction_count"),
        F.sum("amount").alias("transaction_amount"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.count_distinct("user_id").alias("unique_customers"),
        F.count_if("is_fraud").alias("fraud_count"),
        F.sum(F.when(F.col("is_fraud"), F.col("amount")).otherwise(0.0)).alias("fraud_amount"),
        (F.count_if("is_fraud") / row_count()).alias("fraud_rate"),
        F.avg("fraud_score").alias("risk_score"),
        *[
            (F.count_if(F.col("decision") == v) / row_count()).alias(n)
            for n, v in (("approval_rate", "APPROVED"), ("decline_rate", "DECLINED"), ("review_rate", "REVIEW"))
        ],
    )
    trend = base.withColumn(
        "risk_score_trend",
        F.col("risk_score") - F.lag("risk_score").over(Window.partitionBy("merchant_id").orderBy("date")),
    )
    hours = dated.groupBy(*keys, "hour").agg(row_count().alias("n")).groupBy(*keys).agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "hour"))), 1, 3).alias("peaks")
    ).select(*keys, F.array_join(F.transform("peaks", lambda p: p["hour"].cast("string")), "|").alias("peak_hours"))
    return (
        trend.join(histogram_text(dated, keys, "country", "country_distribution"), keys, "left")
        .join(histogram_text(dated, keys, "hour", "hourly_distribution"), keys, "left")
        .join(hours, keys, "left")
    )


def user_daily(df: DataFrame, n: int = 3, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """User and date: diversity, preferred hours and merchants, travelled distance, main device."""
    dated = df.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts"), "_us": micros("ts")})
    keys = ["user_id", "date"]
    linked = tl.neighbours(
        dated, keys, ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"_plat": F.col("latitude"), "_plon": F.col("longitude")}, hot_rows=hot_rows,
    )
    step = F.coalesce(haversine_km("_plat", "_plon", "latitude", "longitude"), F.lit(0.0))
    base = linked.withColumn("_step", step).groupBy(*keys).agg(
        row_count().alias("transaction_count"),
        F.sum("amount").alias("transaction_amount"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.avg("fraud_score").alias("risk_score"),
        F.count_if("is_fraud").alias("fraud_incidents"),
        F.count_distinct("merchant_id").alias("unique_merchants"),
        F.count_distinct("category").alias("unique_categories"),
        F.count_distinct("latitude", "longitude").alias("unique_locations"),
        F.count_distinct("device_id").alias("unique_devices"),
        F.sum("_step").alias("travel_distance_km"),
    )

    def favourites(column: str, name: str) -> DataFrame:
        counts = dated.groupBy(*keys, F.col(column).alias("_v")).agg(row_count().alias("_n"))
        first = tl.top_rows(counts, keys, [F.desc("_n"), F.col("_v")], n, F.col("_v"), salts=8, rank="_r")
        return first.groupBy(*keys).agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("_r", "_v"))), lambda e: e["_v"].cast("string")), "|"
            ).alias(name)
        )

    device = dated.groupBy(*keys, "device_id").agg(row_count().alias("_n")).groupBy(*keys).agg(
        F.max_by("device_id", F.struct("_n", "device_id")).alias("primary_device")
    )
    return (
        base.join(favourites("hour", "preferred_hours"), keys, "left")
        .join(favourites("merchant_id", "preferred_merchants"), keys, "left")
        .join(device, keys, "left")
    )


def category_counts(df: DataFrame, merchants: DataFrame) -> DataFrame:
    return union(
        [
            merchants.groupBy(F.col("merchant_category").alias("category")).agg(row_count().alias("n")).withColumn("kind", F.lit("merchants")),
            df.groupBy("category").agg(row_count().alias("n")).withColumn("kind", F.lit("transactions")),
        ]
    )


# ---- search-style aggregations --------------------------------------------------------------

def date_histogram(df: DataFrame, bucket_seconds: int = HOUR, fraud_from: float = 0.7) -> DataFrame:
    risky = F.col("fraud_score") >= fraud_from
    return df.groupBy(time_bucket(bucket_seconds, "ts").alias("bucket")).agg(
        row_count().alias("doc_count"),
        F.sum("amount").alias("total_amount"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.count_if(risky).alias("fraud_count"),
        F.sum(F.when(risky, F.col("amount")).otherwise(0.0)).alias("total_fraud_amount"),
    )


def terms(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("string").alias("term")).agg(
        row_count().alias("doc_count"), F.avg("fraud_score").alias("avg_fraud_score"), F.sum("amount").alias("total_amount")
    )
    return counts if k is None else top(counts, k, F.desc("doc_count"), "term")


def geohash_grid(df: DataFrame, precision: int = 5) -> DataFrame:
    return df.groupBy(geohash("latitude", "longitude", precision).alias("cell")).agg(
        row_count().alias("doc_count"), F.avg("fraud_score").alias("avg_fraud_score")
    )


# ---- entities -------------------------------------------------------------------------------

def top_risky_entities(
    df: DataFrame, entities: DataFrame, key: str, risk: str, seconds: float = 30 * DAY, k: int = 10, as_of=None
) -> DataFrame:
    """Entities by stored risk, with recent and lifetime activity."""
    recent = since(df, seconds, as_of).groupBy(key).agg(
        row_count().alias("recent_transactions"), F.avg("fraud_score").alias("avg_fraud_score")
    )
    life = df.groupBy(key).agg(row_count().alias("total_transactions"), F.sum("amount").alias("total_amount"))
    joined = entities.select(key, F.col(risk).alias("risk_score")).join(recent, key, "left").join(life, key, "left")
    ranked = top(joined, k, by_mean("risk_score"), by_mean("avg_fraud_score"), key)
    return ranked.select(
        F.col(key).cast("string").alias("entity_id"), "risk_score",
        F.coalesce("recent_transactions", F.lit(0)).alias("recent_transactions"), "avg_fraud_score",
        F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
        F.coalesce("total_amount", F.lit(0.0)).alias("total_amount"),
    )


def top_risky_devices(df: DataFrame, seconds: float = 30 * DAY, k: int = 10, as_of=None) -> DataFrame:
    life = df.groupBy("device_id").agg(
        F.count_distinct("user_id").alias("user_count"), F.avg("fraud_score").alias("risk_score"), row_count().alias("usage_count")
    )
    recent = since(df, seconds, as_of).groupBy("device_id").agg(F.avg("fraud_score").alias("avg_fraud_score"))
    return top(life.join(recent, "device_id", "left"), k, by_mean("risk_score"), F.desc("user_count"), "device_id")


def merchant_fraud_rate(df: DataFrame, merchants: DataFrame, score: float = 0.6) -> DataFrame:
    risky = F.col("fraud_score") > score
    facts = df.groupBy("merchant_id").agg(
        F.count_if(risky).alias("fraud_transactions"),
        row_count().alias("total_transactions"),
        F.avg(F.when(risky, F.col("fraud_score"))).alias("avg_fraud_score"),
    ).filter(F.col("fraud_transactions") > 0)
    return facts.join(merchants.select("merchant_id", "merchant_name", "merchant_category"), "merchant_id").withColumn(
        "fraud_rate_pct", F.col("fraud_transactions") * 100.0 / F.col("total_transactions")
    )


def location_summary(df: DataFrame, locations: DataFrame, min_risk: float = 0.7) -> DataFrame:
    """Every location with its transactions, users and mean score; ``high_risk`` marks risky zones."""
    facts = df.groupBy("country").agg(
        row_count().alias("transaction_count"), F.count_distinct("user_id").alias("unique_users"),
        F.avg("fraud_score").alias("avg_fraud_score"),
    )
    return locations.join(facts, "country", "left").select(
        *locations.columns,
        F.coalesce("transaction_count", F.lit(0)).alias("transaction_count"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
        F.coalesce("avg_fraud_score", F.lit(0.0)).alias("avg_fraud_score"),
        (F.col("risk_score") > min_risk).alias("high_risk"),
    )


def graph_totals(nodes: DataFrame, edges: DataFrame, min_risk: float = 0.7) -> DataFrame:
    """Nodes, edges, and risky users with at least one transaction edge."""
    risky = nodes.filter((F.col("type") == "User") & (F.col("risk_score") > min_risk)).select(F.col("id").alias("src"))
    suspicious = edges.filter(F.col("type") == "MADE_TRANSACTION").select("src").distinct().join(risky, "src")
    return nodes.agg(row_count().alias("total_nodes")).select(
        "total_nodes",
        edges.agg(row_count()).scalar().alias("total_relationships"),
        suspicious.agg(row_count()).scalar().alias("suspicious_users"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return union(
        [
            df.groupBy(F.col(c).cast("string").alias("value")).agg(row_count().alias("n")).select(F.lit(c).alias("field"), "value", "n")
            for c in columns
        ]
    )


# ---- stream bookkeeping ---------------------------------------------------------------------

def stream_health(events: DataFrame, offsets: DataFrame) -> DataFrame:
    """Event counts per type and partition with the lag behind the committed offset.

    ``events``: event_type, partition, offset.  ``offsets``: partition, committed.
    """
    ends = events.groupBy("partition").agg(F.max("offset").alias("end_offset"))
    lag = ends.join(offsets, "partition", "left").select(
        "partition", F.greatest(F.col("end_offset") - F.coalesce("committed", F.lit(-1)), F.lit(0)).alias("lag")
    )
    return events.groupBy("event_type", "partition").agg(row_count().alias("events")).join(lag, "partition", "left")


# Resource limits per tenant tier (api calls per minute, api calls per day, maximal users).
TIER_LIMITS = [("FREE", 10, 1_000, 3), ("BASIC", 100, 10_000, 10), ("PREMIUM", 1_000, 100_000, 50), ("ENTERPRISE", 10_000, 1_000_000, 1_000)]


def tenant_usage(calls: DataFrame, period: str = "minute", weight: Column | None = None) -> DataFrame:
    """Consumption per tenant and period against the tier's limit.  ``calls``: tenant_id, tier, ts."""
    index = {"minute": 1, "day": 2}[period]
    limit = F.lit(None).cast("long")
    for row in TIER_LIMITS:
        limit = F.when(F.col("tier") == row[0], F.lit(row[index]).cast("long")).otherwise(limit)
    used = F.sum(weight) if weight is not None else row_count()
    return calls.groupBy("tenant_id", "tier", F.date_trunc(period, "ts").alias("period_start")).agg(
        used.alias("current_usage")
    ).withColumn("usage_limit", limit).withColumn(
        "utilization_percent", F.when(F.col("usage_limit") > 0, F.col("current_usage") / F.col("usage_limit") * 100).otherwise(0.0)
    )


def fixed_window_limit(requests: DataFrame, key: str, limit: int, seconds: int = 60) -> DataFrame:
    """Requests per key and fixed window, and how many of them the limit lets pass."""
    n = F.col("requests")
    return requests.groupBy(key, time_bucket(seconds, "ts").alias("window_start")).agg(row_count().alias("requests")).withColumns(
        {
            "allowed": F.least(n, F.lit(limit).cast("long")),
            "denied": F.greatest(n - limit, F.lit(0).cast("long")),
        }
    )


def best_scores(df: DataFrame, k: int = 10, keep: int = 1000) -> DataFrame:
    """Best ``k`` of the best ``keep`` scores."""
    return top(df, min(k, keep), F.desc("fraud_score"), "transaction_id")


def health_metrics(df: DataFrame, as_of=None) -> DataFrame:
    """Tagged (metric, value, unit) rows about a fact table."""
    newest_ts = anchor(df, as_of)
    today = df.filter(F.col("ts") >= F.date_trunc("day", newest_ts))

    def tagged(source: DataFrame, metric: str, value: Column, unit: str) -> DataFrame:
        return source.agg(value.cast("double").alias("value")).select(
            F.lit(metric).alias("metric"), "value", F.lit(unit).alias("unit")
        )

    return union(
        [
            tagged(df, "transactions_total", row_count(), "count"),
            tagged(df, "missing_merchant_ratio", F.avg(F.when(F.col("merchant_id") == 0, 100.0).otherwise(0.0)), "percentage"),
            tagged(today, "transactions_today", row_count(), "count"),
        ]
    )


def merchant_trend(df: DataFrame, merchants: DataFrame, seconds: float = 7 * DAY, k: int = 10, as_of=None) -> DataFrame:
    facts = since(df, seconds, as_of).groupBy("merchant_id").agg(
        row_count().alias("transaction_count"), F.count_if("is_fraud").alias("fraud_count"),
        (F.count_if("is_fraud") / row_count()).alias("fraud_rate"), F.avg("fraud_score").alias("avg_fraud_score"),
    )
    joined = merchants.select("merchant_id", "merchant_name", "merchant_category").join(facts, "merchant_id")
    return top(joined, k, F.desc("fraud_count"), "merchant_id")


def geo_summary(countries: DataFrame, hotspots: DataFrame, velocity: DataFrame) -> DataFrame:
    return countries.agg(
        row_count().alias("total_countries"), F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_countries")
    ).select(
        "*", hotspots.agg(row_count()).scalar().alias("active_hotspots"), velocity.agg(row_count()).scalar().alias("velocity_alerts")
    )


def ensemble_figures(models: DataFrame, metrics: list[str]) -> DataFrame:
    """The ensemble's figure is the unweighted mean of its models'."""
    return models.agg(*[F.avg(m).alias(m) for m in metrics], row_count().alias("models"))


def daily_trend(df: DataFrame, days: int = 30, as_of=None) -> DataFrame:
    """Totals for each of the last ``days`` dates, empty dates included."""
    last = F.to_date(anchor(df, as_of))
    spine = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date")
    )
    facts = df.filter(F.to_date("ts") >= F.date_sub(last, days - 1)).groupBy(F.to_date("ts").alias("date")).agg(
        row_count().alias("total_transactions"), F.count_if("is_fraud").alias("fraud_transactions")
    )
    total, fraud = (F.coalesce(F.col(c), F.lit(0)) for c in ("total_transactions", "fraud_transactions"))
    return spine.join(facts, "date", "left").select(
        "date", total.alias("total_transactions"), fraud.alias("fraud_transactions"),
        safe_ratio(fraud, total).alias("fraud_rate"),
    )


def pattern_counters(
    df: DataFrame, high_value: float = 5000.0, burst_seconds: int = 3600, burst_count: int = 3, round_unit: int = 100,
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Counters over the whole table as (metric, value) rows."""
    span = burst_seconds * 1_000_000
    base = df.agg(
        F.avg(F.when(F.weekday("ts") >= 5, F.col("is_fraud").cast("int"))).alias("weekend_fraud_rate"),
        F.avg(F.when(F.col("amount") > high_value, F.col("is_fraud").cast("int"))).alias("high_value_fraud_rate"),
        F.count_if(F.col("amount") < 1).alias("micro_transactions"),
        F.count_if(is_round(F.col("amount"), round_unit)).alias("round_amounts"),
    )
    bursts = tl.trailing_sums(
        df.select("user_id", "transaction_id", "ts"), "user_id", micros("ts"), "transaction_id", {"w": (-span + 1, 0)},
        {"n": F.lit(1)}, hot_rows,
    ).agg(F.count_if(F.col("n_w") >= burst_count).alias("burst_transactions"))
    repeated = df.groupBy("user_id", "amount").agg(row_count().alias("n")).filter(F.col("n") >= 2).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_amounts")
    )
    return union([metric_rows(base), metric_rows(bursts), metric_rows(repeated)])


def peak_fraud_hours(df: DataFrame, k: int = 3) -> DataFrame:
    hours = df.filter("is_fraud").groupBy(F.hour("ts").alias("hour")).agg(row_count().alias("fraud_transactions"))
    return top(hours, k, F.desc("fraud_transactions"), "hour")


def area_hotspots(df: DataFrame, seconds: float | None = 30 * DAY, min_fraud: int = 1, as_of=None) -> DataFrame:
    """One-degree areas with fraud, graded by their fraud rate."""
    rate = F.col("fraud_rate")
    return (
        since(df, seconds, as_of)
        .groupBy("country", F.floor("latitude").alias("area_lat"), F.floor("longitude").alias("area_lon"))
        .agg(
            F.count_if("is_fraud").alias("fraud_count"),
            row_count().alias("total_transactions"),
            (F.count_if("is_fraud") / row_count()).alias("fraud_rate"),
            F.sum(F.when(F.col("is_fraud"), F.col("amount")).otherwise(0.0)).alias("total_amount_fraud"),
        )
        .filter(F.col("fraud_count") >= min_fraud)
        .withColumn("risk_level", F.when(rate > 0.1, "HIGH").when(rate > 0.05, "MEDIUM").otherwise("LOW"))
    )


def live_rates(df: DataFrame, hour: float = HOUR, minute: float = MINUTE, as_of=None) -> DataFrame:
    newest_us = F.unix_micros(anchor(df, as_of))
    return since(df, hour, as_of).agg(
        (row_count() / F.lit(float(hour))).alias("transactions_per_second"),
        (F.count_if(F.unix_micros("ts") > newest_us - F.lit(int(minute * 1e6))) / F.lit(float(minute))).alias("events_per_second"),
        (F.count_if("is_fraud") / F.greatest(row_count(), F.lit(1)) * 100).alias("fraud_percent"),
    )
