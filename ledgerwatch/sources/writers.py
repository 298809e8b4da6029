"""Batch sinks and table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.sources.files import drop_listed, drop_partitions, written


def save_results(scored: DataFrame, summary: DataFrame, folder: str) -> None:
    """Scored rows as CSV (arrays as JSON text) and the summary as JSON, each in a folder of part files."""
    flat = [
        F.to_json(c).alias(c) if scored.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c)
        for c in scored.columns
    ]
    scored.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/scored")
    summary.write.mode("overwrite").json(f"{folder}/summary")


def derive_dimensions(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct users, and merchants with the category of their first transaction."""
    users = df.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.min("ts").alias("created_at"))
    merchants = df.filter(F.col("merchant_id").isNotNull()).groupBy("merchant_id").agg(
        F.min_by("category", F.struct("ts", "transaction_id")).alias("category"), F.min("ts").alias("created_at")
    )
    return users, merchants


def band_scores(df: DataFrame, score: str = "fraud_score") -> DataFrame:
    """Risk level and decision of a score while loading."""
    from ledgerwatch.operators.rules import stream_decision, stream_level

    return df.withColumns({"risk_level": stream_level(F.col(score)), "decision": stream_decision(F.col(score))})


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is new; the first of several rows with one key is kept."""
    fresh = incoming.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in incoming.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    ).select(*incoming.columns)


def upsert_latest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key: the highest version wins.  An aggregate, so a key with many versions is combined map-side."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.unionByName(incoming)
    tie = F.struct(F.col(version), F.struct(*rest))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), tie).alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    ).select(*existing.columns)


PERIODS = {"month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}


def write_partitioned(df: DataFrame, path: str, period: str = "month", ts: str = "ts", mode: str = "overwrite") -> str:
    """Write by month, day or hour; a rebalance hint lets AQE split periods that hold many rows."""
    column = f"{period}_of"
    parted = df.withColumn(column, F.date_format(ts, PERIODS[period])).hint("rebalance", column)
    parted.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return column


def refresh_partitions(path: str, fresh: DataFrame, bucket: str, low: Column, high: Column, period: str = "month") -> DataFrame:
    """Replace the rows of a table with ``low <= bucket < high`` by ``fresh``; only the partitions of that range change.

    ``path`` was written by ``write_partitioned`` with the bucket as time. Rows of the outermost partitions that lie outside
    the range are read and written again; partitions that get no row are deleted, all others keep their files.
    """
    spark, column = fresh.sparkSession, f"{period}_of"
    stored = spark.read.parquet(path).withColumn(column, F.col(column).cast("string"))
    first, last = (F.date_format(c, PERIODS[period]) for c in (low, high - F.expr("INTERVAL 1 MICROSECOND")))
    touched = stored.filter(F.col(column).between(first, last))
    outside = touched.filter((F.col(bucket) < low) | (F.col(bucket) >= high)).drop(column)
    rows = written(outside.unionByName(fresh), "refreshed")
    old = {r[0] for r in touched.select(column).distinct().collect()}
    new = {r[0] for r in rows.select(F.date_format(bucket, PERIODS[period])).distinct().collect()}
    write_partitioned(rows, path, period, bucket)
    drop_listed(spark, path, column, old - new)
    return spark.read.schema(fresh.schema).parquet(path).drop(column)


def expire(spark: SparkSession, path: str, column: str, before: str) -> list[str]:
    """Retention: delete the partitions older than the cutoff."""
    return drop_partitions(spark, path, column, before)


def compact(spark: SparkSession, path: str, target: str, column: str, before: str) -> None:
    """Copy a table with its cold partitions rewritten into few zstd files; recent partitions keep their layout."""
    table = spark.read.parquet(path).withColumn(column, F.col(column).cast("string"))
    cold, recent = table.filter(F.col(column) < before), table.filter(F.col(column) >= before)
    cold.hint("rebalance", column).sortWithinPartitions(column).write.mode("overwrite").option(
        "compression", "zstd"
    ).partitionBy(column).parquet(target)
    recent.write.mode("append").partitionBy(column).parquet(target)


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table and whether it is empty."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", (F.col("row_count") == 0).alias("is_empty")
        )
        out = row if out is None else out.unionByName(row)
    return out


def label_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if("is_fraud").alias("fraud"), F.count_if(~F.col("is_fraud")).alias("normal"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def index_documents(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write one document per transaction id with a normalised place; return written rows and failed rows."""
    ok = F.col("transaction_id").isNotNull() & F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180)
    ok = F.coalesce(ok, F.lit(False))
    rest = [c for c in df.columns if c != "transaction_id"]
    docs = (
        df.filter(ok).groupBy("transaction_id").agg(F.max_by(F.struct(*rest), F.struct("ts", F.struct(*rest))).alias("_r"))
        .select("transaction_id", *[F.col(f"_r.{c}").alias(c) for c in rest if c not in ("latitude", "longitude")],
                F.struct(F.col("_r.latitude").alias("lat"), F.col("_r.longitude").alias("lon")).alias("location"))
    )
    docs.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path), df.filter(~ok)


