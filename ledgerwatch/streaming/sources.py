"""Stream sources, envelopes and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The schema of a transaction event.
EVENT_SCHEMA = (
    "transaction_id string, user_id string, merchant_id string, amount double, currency string, timestamp string, "
    "location map<string,double>, device_info map<string,string>, transaction_type string, channel string, "
    "metadata map<string,string>"
)

# Topic, source name and key column per event type.
TOPICS = {
    "transaction": ("transactions", "fraud_api", "user_id"),
    "fraud_alert": ("fraud_alerts", "fraud_detector", "transaction_id"),
    "model_prediction": ("model_predictions", "ml_engine", "transaction_id"),
    "user_event": ("user_events", "user_tracker", "user_id"),
}


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest", **options) -> DataFrame:
    """A topic as a stream of (key, value, topic, partition, offset, timestamp); committed records only."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", starting).option("kafka.isolation.level", "read_committed")
    )
    return reader.options(**options).load()


def table_stream(spark: SparkSession, folder: str, pattern: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is read once from the files present."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def text_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """JSON-lines files of a folder as a stream of ``value`` strings (stands in for a topic)."""
    reader = spark.readStream
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.text(folder)


def parse_events(raw: DataFrame, schema: str = EVENT_SCHEMA, value: str = "value") -> DataFrame:
    """JSON values to columns; missing currency, type and channel take their defaults."""
    parsed = raw.select(F.from_json(F.col(value).cast("string"), schema).alias("e")).select("e.*")
    return parsed.withColumns(
        {
            "ts": F.try_to_timestamp("timestamp"), "currency": F.coalesce("currency", F.lit("USD")),
            "transaction_type": F.coalesce("transaction_type", F.lit("purchase")), "channel": F.coalesce("channel", F.lit("online")),
        }
    )


def split_malformed(raw: DataFrame, schema: str, required: Column | None = None, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed rows, and raw values that are no valid event."""
    text = F.col(value).cast("string")
    parsed = raw.select(text.alias("raw"), F.from_json(text, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    bad = F.col("e").isNull() | F.col("e._corrupt").isNotNull()
    if required is not None:
        bad = bad | F.coalesce(~required, F.lit(True))
    return parsed.filter(~bad).select("e.*").drop("_corrupt"), parsed.filter(bad).select("raw")


def envelope(df: DataFrame, event_type: str, ts: str = "ts") -> DataFrame:
    """Keyed event envelopes (key, value) ready for a topic; ids are reproducible."""
    _, source, key = TOPICS[event_type]
    payload = F.struct(*[F.col(c) for c in df.columns])
    body = F.struct(
        F.concat_ws("_", F.lit(event_type), F.sha2(F.to_json(payload), 256)).alias("event_id"), F.lit(event_type).alias("event_type"),
        F.col(ts).alias("timestamp"), payload.alias("payload"), F.lit(source).alias("source"), F.col(key).cast("string").alias("partition_key"),
    )
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(body).alias("value"))
