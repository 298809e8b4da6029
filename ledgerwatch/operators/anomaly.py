"""Anomaly detectors over transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import haversine_km, micros, time_bucket
from ledgerwatch.operators.common import anchor
from ledgerwatch.operators.rules import is_round


def amount_anomalies(df: DataFrame, threshold: float = 2.5, min_rows: int = 3) -> DataFrame:
    """Amounts far from the user's mean (population z-score)."""
    stats = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("amount").alias("_m"), F.stddev_pop("amount").alias("_s")
    ).filter((F.col("_n") > min_rows) & (F.col("_s") > 0))
    scored = df.join(stats, "user_id").withColumn("anomaly_score", F.abs((F.col("amount") - F.col("_m")) / F.col("_s")))
    return scored.filter(F.col("anomaly_score") > threshold).drop("_n", "_m", "_s")


def velocity_anomalies(df: DataFrame, max_count: int = 10, bucket_seconds: int = 900) -> DataFrame:
    """Transactions of users with many transactions in one time bucket."""
    bucketed = df.withColumn("bucket", time_bucket(bucket_seconds, "ts"))
    busy = bucketed.groupBy("user_id", "bucket").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > max_count)
    return bucketed.join(busy, ["user_id", "bucket"]).withColumn("anomaly_score", F.col("_n") / float(max_count)).drop("_n")


def round_anomalies(df: DataFrame, unit: int = 100) -> DataFrame:
    return df.filter(is_round(F.col("amount"), unit)).withColumn("anomaly_score", F.lit(0.8))


def bucket_anomalies(
    df: DataFrame, bucket_seconds: int = 900, measure: str = "mean", threshold: float = 3.0, min_history: int = 5
) -> DataFrame:
    """Buckets whose mean amount or count is high against the earlier buckets of the same user.

    The window runs over one row per user and bucket, so its size is bounded by the time span, not by the rows.
    """
    value = F.avg("amount") if measure == "mean" else F.count(F.lit(1)).cast("double")
    buckets = df.groupBy("user_id", time_bucket(bucket_seconds, "ts").alias("bucket")).agg(value.alias("value"))
    earlier = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rated = buckets.withColumns(
        {
            "history": F.count("value").over(earlier), "typical": F.avg("value").over(earlier),
            "_s": F.stddev_pop("value").over(earlier),
        }
    )
    return rated.filter((F.col("history") >= min_history) & (F.col("_s") > 0)).withColumn(
        "anomaly_score", (F.col("value") - F.col("typical")) / F.col("_s")
    ).filter(F.col("anomaly_score") > threshold).drop("_s")


def user_anomalies(
    df: DataFrame, recent_seconds: float = 3600, history_seconds: float = 30 * 86400, factor: float = 3.0,
    max_kmh: float = 800.0, as_of=None, hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Typed anomalies of users: recent frequency and mean amount against their own history, and travel speed."""
    newest = F.unix_micros(anchor(df, as_of))
    age = (newest - micros("ts")) / 1e6
    windows = history_seconds / recent_seconds
    recent, before = age < recent_seconds, (age >= recent_seconds) & (age < history_seconds + recent_seconds)
    facts = df.groupBy("user_id").agg(
        F.count_if(recent).cast("double").alias("n"), (F.count_if(before) / windows).alias("usual_n"),
        F.avg(F.when(recent, F.col("amount"))).alias("mean"), F.avg(F.when(before, F.col("amount"))).alias("usual_mean"),
    ).filter(F.col("n") > 0)

    def typed(kind, normal, detected):
        return F.struct(F.lit(kind).alias("anomaly_type"), normal.alias("normal_value"), detected.alias("detected_value"))

    often = (F.col("usual_n") > 0) & (F.col("n") > F.col("usual_n") * factor)
    found = F.array(
        F.when(often, typed("HIGH_FREQUENCY", F.col("usual_n"), F.col("n"))),
        F.when(F.col("mean") > F.col("usual_mean") * factor, typed("AMOUNT_SPIKE", F.col("usual_mean"), F.col("mean"))),
    )
    own_history = facts.select("user_id", F.inline(F.filter(found, lambda e: e.isNotNull())))
    located = df.withColumn("_us", micros("ts"))
    steps = tl.neighbours(
        located, "user_id", ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"_y": F.col("latitude"), "_x": F.col("longitude"), "_p": F.col("_us")}, hot_rows=hot_rows,
    ).filter((F.col("_us") > F.col("_p")) & (newest - F.col("_us") < F.lit(int(recent_seconds * 1e6))))
    speeds = steps.withColumn("v", haversine_km("_y", "_x", "latitude", "longitude") / ((F.col("_us") - F.col("_p")) / 3.6e9))
    top = speeds.groupBy("user_id").agg(F.max("v").alias("v"))
    fast = top.filter(F.col("v") > max_kmh).select("user_id", F.inline(F.array(typed("GEOGRAPHIC_VELOCITY", F.lit(max_kmh), F.col("v")))))
    ratio = F.col("detected_value") / F.col("normal_value")
    return own_history.unionByName(fast).withColumn(
        "severity", F.when(ratio >= factor * 3, "CRITICAL").when(ratio >= factor, "HIGH").otherwise("MEDIUM")
    )
