"""Streaming jobs: sinks, deduplication, stateful detectors, feature and scoring jobs, run metrics."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ledgerwatch.functions.columns import micros
from ledgerwatch.operators.rules import build_alerts, stream_decision, stream_level, stream_score
from ledgerwatch.streaming import stateful


def run_available(writer, checkpoint: str):
    """Process everything present, then stop; returns the finished query."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream into a parquet table (exactly once by the sink's commit log) and read it."""
    run_available(df.writeStream.outputMode(mode).format("parquet").option("path", path), checkpoint)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_batches(df: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], folder: str, checkpoint: str, mode: str = "append"):
    """Idempotent multi-sink writer: every batch overwrites its own ``batch_id`` partition of each table.

    A batch that is repeated after a failure replaces what its first attempt wrote.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, part in sinks.items():
                part(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return run_available(df.writeStream.outputMode(mode).foreachBatch(store), checkpoint)


def deduplicated(df: DataFrame, key: list[str] | None = None, ts: str = "ts", horizon: str = "24 hours") -> DataFrame:
    """First event per id (or per content hash where no key is given) within the horizon."""
    marked = df.withWatermark(ts, horizon)
    if key:
        return marked.dropDuplicatesWithinWatermark(key)
    content = F.sha2(F.to_json(F.struct(*[F.col(c) for c in df.columns])), 256)
    return marked.withColumn("_content", content).dropDuplicatesWithinWatermark(["_content"]).drop("_content")


def split_late(df: DataFrame, folder: str, checkpoint: str, ts: str = "ts", lateness_seconds: int = 60) -> None:
    """Route events older than the newest event of earlier batches minus the lateness into a table of their own.

    The newest time is kept beside the batches it came from, so a restart sees the same border.
    """
    spark = df.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        border = None
        if batch_id > 0:
            border = (
                spark.read.schema("newest timestamp, batch_id long").parquet(f"{folder}/progress")
                .filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
            )
        late = F.lit(False) if border is None else micros(ts) < F.unix_micros(F.lit(border)) - lateness_seconds * 1_000_000
        batch.persist()
        try:
            batch.filter(~late).write.mode("overwrite").parquet(f"{folder}/on_time/batch_id={batch_id}")
            batch.filter(late).write.mode("overwrite").parquet(f"{folder}/late/batch_id={batch_id}")
            batch.agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{folder}/progress/batch_id={batch_id}")
        finally:
            batch.unpersist()

    run_available(df.writeStream.foreachBatch(store), checkpoint)


# ---- stateful detectors ---------------------------------------------------------------------

def user_velocity_stream(
    events: DataFrame, watermark: str = "1 minute", seconds: int = 300, min_count: int = 5, rows: int = 100, expiry: str = "30 minutes",
    corrections: bool = False,
) -> DataFrame:
    """Alerts of users with many transactions in a short time, among their last ``rows``.

    State is kept by group of users and time bucket of length ``expiry`` (at least 16 windows) until the watermark has passed the
    bucket; a late event takes its place among the others. With ``corrections`` the alerts that it changes go out again
    under a higher ``revision``: ``stateful.latest()`` has the last ones.
    """
    span = seconds * 1_000_000
    length = max(stateful.milliseconds(expiry) * 1000, stateful.SPANS * span)

    def first(us):
        return np.maximum(np.searchsorted(us, us - span, "left"), np.arange(len(us)) - rows + 1)

    columns = {"us": "long", "amount": "double", "merchant": "string", "transaction_id": "string"}
    processor = stateful.Trailing(columns, length, span, first, stateful.velocity(rows, min_count), corrections)
    schema = "user_id long, transaction_id string, transaction_count long, total_amount double, unique_merchants long"
    found = stateful.trailing(
        events, "user_id", watermark, span, length, processor, schema, amount=F.col("amount"),
        merchant=F.col("merchant_id").cast("string"), transaction_id=F.col("transaction_id"),
    )
    last = ["revision"] if corrections else []
    return found.select("transaction_id", "user_id", "transaction_count", "total_amount", "unique_merchants", *last)


def merchant_anomaly_stream(
    events: DataFrame, watermark: str = "1 hour", count_factor: float = 3.0, amount_factor: float = 5.0, buckets: int = 24,
    expiry: str = "30 days", corrections: bool = False,
) -> DataFrame:
    """Alerts of merchants whose current hour is far above their last hours with activity.

    State holds the events of the hours that the watermark has not passed and one sum for each of the last ``buckets``
    before them; it goes, and a merchant begins anew, after ``expiry`` (whole hours) without an event. With ``corrections``
    a late event sends out again all later results it may change, with a ``revision`` and whether they are an ``alert``
    still. Events without a time are left out.
    """
    schema = "transaction_id string, merchant_id long, current_count long, baseline_count double, current_amount double, baseline_amount double"
    idle = -(-stateful.milliseconds(expiry) // 3_600_000)
    processor = stateful.HourlyBaseline(count_factor, amount_factor, buckets, idle, corrections)
    keyed = events.withWatermark("ts", watermark).where("ts IS NOT NULL").select("merchant_id", "ts", micros("ts").alias("us"), "transaction_id", "amount")
    return keyed.groupBy("merchant_id").transformWithStateInPandas(
        processor, schema + (", alert boolean, revision long" if corrections else ""), "append", "EventTime"
    )


def expiring_counters(events: DataFrame, watermark: str = "1 minute", idle: str = "30 minutes") -> DataFrame:
    """Event count of each user's sessions; a counter is emitted and dropped once its user has been idle in event time.

    A session window: however the events are cut into batches, a gap longer than ``idle`` begins a new counter.
    """
    window = F.session_window("ts", idle)
    counted = events.withWatermark("ts", watermark).withColumn("us", micros("ts")).groupBy("user_id", window.alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    return counted.select("user_id", "events", "first_us", "last_us")


def running_features_stream(events: DataFrame, watermark: str = "1 minute", seconds: int = 3600, corrections: bool = False) -> DataFrame:
    """Every event with the user's count and amount in the last ``seconds`` (the event itself included).

    State is kept by group of users and time bucket of 16 times ``seconds`` until the watermark has passed the bucket. With
    ``corrections`` a late event sends out again the events whose window it falls into, under a higher ``revision``.
    """
    span = seconds * 1_000_000

    def first(us):
        return np.searchsorted(us, us - span, "right")

    columns = {"us": "long", "amount": "double", "merchant_id": "long", "transaction_id": "string"}
    processor = stateful.Trailing(columns, stateful.SPANS * span, span, first, stateful.running, corrections)
    schema = "user_id long, transaction_id string, merchant_id long, amount double, ts timestamp, recent_count long, recent_amount double"
    found = stateful.trailing(
        events, "user_id", watermark, span, stateful.SPANS * span, processor, schema, amount=F.col("amount"),
        merchant_id=F.col("merchant_id").cast("long"), transaction_id=F.col("transaction_id"),
    )
    last = ["revision"] if corrections else []
    return found.select("transaction_id", "user_id", "merchant_id", "amount", "ts", "recent_count", "recent_amount", *last)


# ---- jobs -----------------------------------------------------------------------------------

def feature_job(events: DataFrame, merchants: DataFrame, folder: str, checkpoint: str, seconds: int = 3600, corrections: bool = False):
    """Events to features: a table for lookups and envelopes for a topic, one state pass.

    With ``corrections`` the table has a row for every revision, see ``running_features_stream()``.
    """
    from ledgerwatch.streaming.sources import envelope

    enriched = running_features_stream(events, seconds=seconds, corrections=corrections).join(
        merchants.select("merchant_id", "merchant_risk"), "merchant_id", "left"
    ).withColumns({"hour": F.hour("ts"), "amount_log": F.log1p("amount")})
    return write_batches(
        enriched, {"features": lambda b: b, "topic": lambda b: envelope(b, "user_event")}, folder, checkpoint
    )


def scoring_job(
    events: DataFrame, merchants: DataFrame, folder: str, checkpoint: str, seconds: int = 3600, velocity_limit: int = 10, corrections: bool = False
):
    """Events to predictions, and alerts for the risky ones.

    With ``corrections`` predictions have a row for every revision; a late event can only raise the score of others.
    """
    enriched = running_features_stream(events, seconds=seconds, corrections=corrections).join(merchants.select("merchant_id", "merchant_risk"), "merchant_id", "left")
    score = stream_score(F.col("amount"), F.hour("ts"), F.col("recent_count"), F.col("merchant_risk"), velocity_limit)
    scored = enriched.withColumn("fraud_score", score).withColumns(
        {"risk_level": stream_level(F.col("fraud_score")), "decision": stream_decision(F.col("fraud_score"))}
    )
    predictions = lambda b: b.select("transaction_id", "fraud_score", "risk_level", "decision", "ts", *(["revision"] if corrections else []))
    return write_batches(scored, {"predictions": predictions, "alerts": lambda b: build_alerts(b)}, folder, checkpoint)


def retry_ledger(bad: DataFrame, attempts: DataFrame | None = None, max_retries: int = 3) -> DataFrame:
    """Ledger of failed raw records: retry count so far and whether another attempt is due."""
    rows = bad.groupBy("raw").agg(F.count(F.lit(1)).alias("failures")).withColumn("record_id", F.sha2("raw", 256))
    if attempts is not None:
        rows = rows.join(attempts.groupBy("record_id").agg(F.max("retry_count").alias("retry_count")), "record_id", "left")
    else:
        rows = rows.withColumn("retry_count", F.lit(0))
    retries = F.least(F.coalesce("retry_count", F.lit(0)), F.lit(max_retries))
    return rows.withColumn("retry_count", retries).withColumn(
        "processing_status", F.when(F.col("retry_count") < max_retries, "RETRY").otherwise("FAILED")
    )


def progress_table(spark: SparkSession, query) -> DataFrame:
    """Progress records of a streaming query as rows: a handful per run, kept by Spark itself.

    Raises when the run may have had more batches than Spark keeps (spark.sql.streaming.numRecentProgressUpdates).
    """
    _all_kept(spark, query)
    rows = [
        (p.batchId, int(p.numInputRows), float(p.processedRowsPerSecond or 0.0), float(p.durationMs.get("triggerExecution", 0)))
        for p in query.recentProgress
    ]
    return spark.createDataFrame(rows, "batch_id long, input_rows long, rows_per_second double, latency_ms double")


class ProgressLog(StreamingQueryListener):
    """Writes a row for each progress report of the session's streaming queries to a Parquet table, while they run.

    Unlike a query's own list it keeps every batch: rows go out in groups of ``group`` and when a query ends. Use it as a
    context around the runs, then read those of one run with ``rows``.
    """

    SCHEMA = "run_id string, batch_id long, input_rows long, late_rows long, rows_per_second double, latency_ms double"

    def __init__(self, spark: SparkSession, path: str, group: int = 256):
        self.spark, self.path, self.group = spark, path, group
        self.held, self.ended, self.changed = [], set(), threading.Condition()

    def __enter__(self) -> ProgressLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *failure) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators)
        self.held.append(
            (str(p.runId), p.batchId, int(p.numInputRows), late, float(p.processedRowsPerSecond or 0.0), float(p.durationMs.get("triggerExecution", 0)))
        )
        if len(self.held) >= self.group:
            self._write()

    def onQueryTerminated(self, event) -> None:
        self._write()
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def _write(self) -> None:
        if self.held:
            self.spark.createDataFrame(self.held, self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.held = []

    def rows(self, query, seconds: float = 60.0) -> DataFrame:
        """All progress rows of a query that has ended; raises if its end is not reported in time."""
        run = str(query.runId)
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"the end of run {run} was not reported")
        return self.spark.read.schema(self.SCHEMA).parquet(self.path).where(F.col("run_id") == run)


def run_metrics(progress: DataFrame) -> DataFrame:
    """Throughput and latency figures of a run."""
    return progress.agg(
        F.sum("input_rows").alias("events_processed"), F.avg("rows_per_second").alias("throughput"),
        F.avg("latency_ms").alias("latency_mean_ms"), F.percentile("latency_ms", 0.95).alias("latency_p95_ms"),
        F.min("latency_ms").alias("latency_min_ms"), F.max("latency_ms").alias("latency_max_ms"),
    )


def _all_kept(spark: SparkSession, query) -> None:
    kept = int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))
    if len(query.recentProgress) >= kept:
        raise ValueError(f"only the last {kept} batches are known; raise spark.sql.streaming.numRecentProgressUpdates")


def late_rows(query) -> int:
    """Rows a finished query dropped behind its watermark; raises as progress_table() does."""
    _all_kept(SparkSession.active(), query)
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)


def consumer(source: DataFrame, handler: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """One independent consumer of a shared source: its own query, checkpoint and table."""
    return to_table(handler(source), path, checkpoint)


