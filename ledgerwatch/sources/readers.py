"""Batch readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a transaction file.
CSV_SCHEMA = (
    "transaction_id string, user_id string, amount double, currency string, merchant_id string, category string, "
    "country string, timestamp string, lat double, lon double, device_id string, ip_address string, user_age int, "
    "user_income string, transaction_hour int, transaction_day_of_week int, is_fraud int"
)

# Other names of the standard columns.
ALIASES = {
    "transaction_id": ["TransactionID", "id", "ID"],
    "user_id": ["UserID", "account_id", "AccountID", "customer_id"],
    "amount": ["Amount", "TransactionAmt", "transaction_amount"],
    "merchant_id": ["MerchantID", "merchant", "Merchant"],
    "category": ["Category", "merchant_category", "ProductCD"],
    "timestamp": ["Timestamp", "TransactionDT", "transaction_time"],
    "is_fraud": ["isFraud", "Class", "fraud"],
}


def read_transactions_csv(spark: SparkSession, path: str, sample_size: int | None = None, schema=CSV_SCHEMA) -> DataFrame:
    """Delimited transactions with a header; ``schema=None`` keeps whatever columns the file has, as strings."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df if sample_size is None else df.limit(sample_size)


def standardise_columns(df: DataFrame, now: str = "1970-01-01T00:00:00") -> DataFrame:
    """Standard column names; missing columns are derived from a hash of the row, so that reruns agree."""
    renames = {}
    for standard, others in ALIASES.items():
        if standard in df.columns:
            continue
        present = [o for o in others if o in df.columns]
        if present:
            renames[present[0]] = standard
    out = df.withColumnsRenamed(renames)
    whole_row = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in out.columns]))
    number = F.conv(F.substring(whole_row, 1, 12), 16, 10).cast("long")
    kinds = F.array(*[F.lit(c) for c in ("grocery", "electronics", "gas", "restaurant")])
    defaults = {
        "transaction_id": F.concat(F.lit("tx_"), F.substring(whole_row, 1, 16)),
        "user_id": F.concat(F.lit("user_"), F.lpad(F.pmod(number, F.lit(1_000_000)).cast("string"), 6, "0")),
        "amount": F.pmod(number, F.lit(99_000)) / 100.0 + 10.0,
        "merchant_id": F.concat(F.lit("merchant_"), F.lpad(F.pmod(number, F.lit(1000)).cast("string"), 4, "0")),
        "category": F.element_at(kinds, (F.pmod(number, F.lit(4)) + 1).cast("int")),
        "timestamp": F.lit(now),
        "currency": F.lit("USD"),
    }
    return out.withColumns({c: d for c, d in defaults.items() if c not in out.columns})


BATCH_SCHEMA = (
    "transactions array<struct<transactionId: string, userId: string, amount: double, currency: string, merchantId: string, "
    "timestamp: string, location: struct<latitude: double, longitude: double>, deviceId: string, ipAddress: string>>"
)


def read_json_batch(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested batch documents, one row per transaction."""
    raw = spark.read.schema(BATCH_SCHEMA).option("multiLine", multi_line).json(path)
    t = raw.select(F.explode("transactions").alias("t"))
    return t.select(
        F.col("t.transactionId").alias("transaction_id"), F.col("t.userId").alias("user_id"), F.col("t.amount").alias("amount"),
        F.col("t.currency").alias("currency"), F.col("t.merchantId").alias("merchant_id"),
        F.try_to_timestamp(F.col("t.timestamp")).alias("ts"), F.col("t.location.latitude").alias("latitude"),
        F.col("t.location.longitude").alias("longitude"), F.col("t.deviceId").alias("device_id"),
        F.col("t.ipAddress").alias("ip_address"),
    )


REQUIRED = ["transaction_id", "user_id", "merchant_id", "amount", "currency", "ts"]


def rejection_reasons(df: DataFrame, required=REQUIRED, scores=("fraud_score",)) -> Column:
    """Array of the reasons why a row is not acceptable."""
    marks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required if c in df.columns]
    marks.append(F.when(F.col("amount") <= 0, F.lit("amount not positive")))
    marks += [F.when((F.col(s) < 0) | (F.col(s) > 1), F.lit(f"{s} out of range")) for s in scores if s in df.columns]
    return F.filter(F.array(*marks), lambda m: m.isNotNull())


def validate(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected rows with their ``reasons``."""
    checked = df.withColumn("reasons", rejection_reasons(df, **options))
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def training_scan(df: DataFrame, days: float | None = 30, limit: int = 100_000, as_of=None) -> DataFrame:
    """Newest labelled rows of the last ``days``."""
    from ledgerwatch.operators.common import since

    labelled = df.filter(F.col("is_fraud").isNotNull())
    recent = labelled if days is None else since(labelled, days * 86400, as_of)
    return recent.orderBy(F.desc("ts"), F.desc("transaction_id")).limit(limit)


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str], **partitioning) -> DataFrame:
    """A relational table over JDBC, read in parallel ranges where partitioning options are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    return reader.options(**{k: str(v) for k, v in partitioning.items()}).load()
