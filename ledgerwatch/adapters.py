"""The shared test tables seen as transactions, events, and their dimensions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import configure


class Tables:
    """Lazy views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def transactions(self, merchant: bool = True, place: bool = True) -> DataFrame:
        """Orders as card transactions; the flags leave out the joins a query does not need."""
        key = F.col("o_orderkey")
        mix = F.pmod(key * 37 + F.col("o_custkey") * 11, F.lit(1000))
        df = self.raw("orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long"))
        if place:
            df = df.join(
                self.raw("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
            ).join(self.raw("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        if merchant:
            lines = self.raw("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("sk"))
            df = df.join(lines, F.col("l_orderkey") == key, "left")
        columns = [
            F.concat(F.lit("tx_"), key.cast("string")).alias("transaction_id"),
            F.col("o_custkey").alias("user_id"),
        ]
        if merchant:
            columns.append(F.coalesce(F.col("sk"), F.lit(0)).alias("merchant_id"))
        columns += [
            F.expr(
                "CASE o_orderkey % 4 WHEN 0 THEN cents DIV 20 WHEN 1 THEN cents DIV 200 "
                "WHEN 2 THEN cents DIV 2000 ELSE cents DIV 200000 END / CAST(100 AS DOUBLE)"
            ).alias("amount"),
            F.expr(
                "CASE o_custkey % 6 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' WHEN 3 THEN 'JPY' "
                "WHEN 4 THEN 'CAD' ELSE 'AUD' END"
            ).alias("currency"),
            F.expr(
                "CASE o_orderkey % 7 WHEN 0 THEN 'grocery' WHEN 1 THEN 'electronics' WHEN 2 THEN 'gambling' "
                "WHEN 3 THEN 'travel' WHEN 4 THEN 'crypto' WHEN 5 THEN 'gas' ELSE 'restaurant' END"
            ).alias("category"),
            F.timestamp_seconds(
                F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.pmod(key * 7919, F.lit(86400))
            ).alias("ts"),
            (mix / F.lit(1000.0)).alias("fraud_score"),
            ((F.pmod(key * 13, F.lit(100)) < 5) | (mix > 950)).alias("is_fraud"),
            F.concat(F.lit("dev_"), F.pmod(F.col("o_custkey"), F.lit(97)).cast("string")).alias("device_id"),
        ]
        if place:
            columns += [
                F.col("n_name").alias("country"),
                (F.pmod(F.col("n_nationkey") * 37, F.lit(120)) - 60 + F.pmod(key, F.lit(100)) / F.lit(100.0)).alias("latitude"),
                (F.pmod(F.col("n_nationkey") * 53, F.lit(300)) - 150 + F.pmod(key, F.lit(97)) / F.lit(97.0)).alias("longitude"),
            ]
        columns.append((F.lit(10) + F.pmod(key, F.lit(490))).alias("processing_time_ms"))
        return df.select(*columns)

    @cached_property
    def tx(self) -> DataFrame:
        return self.transactions()

    @cached_property
    def tx_slim(self) -> DataFrame:
        """Transactions without merchant and place: one scan, no join."""
        return self.transactions(merchant=False, place=False)

    @cached_property
    def tx_merchant(self) -> DataFrame:
        return self.transactions(place=False)

    @cached_property
    def tx_place(self) -> DataFrame:
        return self.transactions(merchant=False)

    @cached_property
    def scored(self) -> DataFrame:
        """Transactions with the risk level and batch decision of their score."""
        from ledgerwatch.operators.rules import with_level_and_decision

        return with_level_and_decision(self.tx)

    @cached_property
    def scored_slim(self) -> DataFrame:
        from ledgerwatch.operators.rules import with_level_and_decision

        return with_level_and_decision(self.tx_slim)

    @cached_property
    def scored_merchant(self) -> DataFrame:
        from ledgerwatch.operators.rules import with_level_and_decision

        return with_level_and_decision(self.tx_merchant)

    @cached_property
    def ev(self) -> DataFrame:
        return self.raw("events").select(
            F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("transaction_id"),
            "user_id",
            F.pmod(F.col("event_id"), F.lit(50)).alias("merchant_id"),
            F.col("value").alias("amount"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_type").alias("channel"),
            F.col("event_type").alias("transaction_type"),
            "props",
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").alias("user_id"),
            F.col("c_name").alias("user_name"),
            F.col("c_mktsegment").alias("segment"),
            (F.pmod(F.col("c_custkey") * 13, F.lit(100)) / F.lit(100.0)).alias("risk_score"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("merchant_id"),
            F.col("s_name").alias("merchant_name"),
            F.expr(
                "CASE s_suppkey % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'crypto' WHEN 2 THEN 'travel' "
                "WHEN 3 THEN 'gambling' ELSE 'food' END"
            ).alias("merchant_category"),
            (F.pmod(F.col("s_suppkey") * 7, F.lit(100)) / F.lit(100.0)).alias("merchant_risk"),
        )
