"""Streaming queries: real structured streams over the event table, run until all data present is processed."""

from pyspark.sql import functions as F

from ledgerwatch.operators import windowed as wd
from ledgerwatch.plans.registry import query
from ledgerwatch.sources.files import scratch
from ledgerwatch.streaming import jobs
from ledgerwatch.streaming import sources as ss

KINDS = ("view", "error", "purchase", "click", "signup")


def event_columns(raw):
    return raw.select(
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("transaction_id"), "user_id",
        F.pmod(F.col("event_id"), F.lit(50)).alias("merchant_id"), F.col("value").alias("amount"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), F.col("event_type").alias("transaction_type"),
    )


def events(t, times: int = 1):
    """The event table as a stream (``times`` copies of it, for duplicate tests)."""
    one = event_columns(ss.table_stream(t.spark, t.sf_dir, "events.parquet"))
    out = one
    for _ in range(times - 1):
        out = out.unionByName(event_columns(ss.table_stream(t.spark, t.sf_dir, "events.parquet")))
    return out


def landed(t, df, name, mode="append"):
    return jobs.to_table(df, scratch(t.spark, name), scratch(t.spark, f"{name}-checkpoint"), mode)


def windowed(t, window, keys, watermark, name, session=None):
    stream = events(t).withWatermark("ts", watermark)
    return landed(t, wd.window_aggregates(stream, window, keys, KINDS, session=session), name).drop("channel_distribution")


MEASURES = """COUNT(*) AS event_count, SUM(amount) AS total_amount, AVG(amount) AS avg_amount, MIN(amount) AS min_amount, MAX(amount) AS max_amount,
  STDDEV_POP(amount) AS std_amount, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT merchant_id) AS unique_merchants,
  CASE WHEN COUNT(*) > 1 THEN (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 / (COUNT(*) - 1) END AS avg_time_between_events"""
FLOATS = "total_amount avg_amount min_amount max_amount std_amount avg_time_between_events"


@query("STR-1", uses="ev", rounded=FLOATS, places=4, sql=f"""
SELECT * FROM (SELECT user_id, time_bucket(INTERVAL '5 minutes', ts) AS window_start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL 5 MINUTE AS window_end, {MEASURES} FROM ev GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT MAX(ts) FROM ev) - INTERVAL 10 SECOND
""")
def str_1(t):
    return windowed(t, F.window("ts", "5 minutes"), ["user_id"], "10 seconds", "tumbling")


@query("STR-2", uses="ev", rounded=FLOATS, places=4, sql=f"""
SELECT * FROM (SELECT user_id, window_start, window_start + INTERVAL 10 MINUTE AS window_end, {MEASURES} FROM (
 SELECT *, time_bucket(INTERVAL '1 minute', ts) - to_minutes(CAST(i AS INTEGER)) AS window_start FROM ev, range(10) r(i)) GROUP BY 1, 2, 3)
WHERE window_end <= (SELECT MAX(ts) FROM ev) - INTERVAL 30 SECOND
""")
def str_2(t):
    size, slide, lateness = wd.SLIDING
    return windowed(t, F.window("ts", size, slide), ["user_id"], lateness, "sliding")


@query("STR-3", uses="ev", rounded=FLOATS, places=4, sql=f"""
SELECT * EXCLUDE (session) FROM (SELECT user_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 6 HOUR AS window_end, session, {MEASURES} FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, transaction_id) AS session FROM (
  SELECT *, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, transaction_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ev)) GROUP BY user_id, session)
WHERE window_end <= (SELECT MAX(ts) FROM ev) - INTERVAL 1 MINUTE
""")
def str_3(t):
    return windowed(t, F.session_window("ts", "6 hours"), ["user_id"], "60 seconds", "session", "6 hours")


@query("STR-4", uses="ev", rounded="total_amount", places=4, sql="""
SELECT channel, window_start, COUNT(*) AS event_count, SUM(amount) AS total_amount FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start FROM ev)
WHERE window_start + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM ev) - INTERVAL 1 DAY GROUP BY 1, 2
""")
def str_4(t):
    late = events(t).withWatermark("ts", "1 day").groupBy("channel", F.window("ts", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("event_count"), F.sum("amount").alias("total_amount")
    )
    return landed(t, late.select("channel", F.col("w.start").alias("window_start"), "event_count", "total_amount"), "lateness")


@query("STR-5", uses="ev", sql="""
SELECT 'on_time' AS route, COUNT(*) AS n FROM ev UNION ALL SELECT 'late', COUNT(*) FROM ev WHERE ts < (SELECT MAX(ts) FROM ev) - INTERVAL 1 HOUR
""")
def str_5(t):
    """The table arrives twice, one copy per batch: the second is late but for its last hour."""
    folder, out, checkpoint = scratch(t.spark, "twice"), scratch(t.spark, "late"), scratch(t.spark, "late-checkpoint")
    for _ in range(2):
        event_columns(t.raw("events")).write.mode("append").parquet(folder)
        jobs.split_late(ss.table_stream(t.spark, folder, "*.parquet"), out, checkpoint, lateness_seconds=3600)
    late = t.spark.read.parquet(f"{out}/late").agg(F.count(F.lit(1)).alias("n"))
    on_time = t.spark.read.parquet(f"{out}/on_time").dropDuplicates(["transaction_id"]).agg(F.count(F.lit(1)).alias("n"))
    return on_time.select(F.lit("on_time").alias("route"), "n").unionByName(late.select(F.lit("late").alias("route"), "n"))


@query("STR-6", uses="ev", rounded=FLOATS + " min_time_between_events max_time_between_events", places=4, sql=f"""
WITH g AS (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS ws FROM ev),
c AS (SELECT user_id, ws, string_agg(channel || ':' || n, '|' ORDER BY channel || ':' || n) AS channels FROM (SELECT user_id, ws, channel, COUNT(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
l AS (SELECT *, (epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id, ws ORDER BY ts, transaction_id))) / 1e6 AS gap FROM g)
SELECT user_id, ws AS window_start, ws + INTERVAL 6 HOUR AS window_end, {MEASURES}, MIN(gap) AS min_time_between_events, MAX(gap) AS max_time_between_events, ANY_VALUE(channels) AS channels
FROM l JOIN c USING (user_id, ws) GROUP BY 1, 2
""")
def str_6(t):
    window = F.window("ts", "6 hours")
    base = wd.window_aggregates(t.ev, window, ["user_id"], KINDS)
    text = F.transform(F.map_entries("channel_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return base.join(wd.gap_extremes(t.ev, window), ["user_id", "window_start"]).withColumn(
        "channels", F.array_join(F.array_sort(text), "|")
    ).drop("channel_distribution")


def features(t):
    return wd.window_features(wd.window_aggregates(t.ev, F.window("ts", "6 hours"), ["user_id"], KINDS))


WINDOWED = """
SELECT *, event_count / 360e0 AS transactions_per_minute, total_amount / 360e0 AS amount_per_minute, max_amount / avg_amount AS amount_deviation_ratio,
 CASE WHEN gap_mean IS NOT NULL THEN 1 / (1 + std_amount) END AS time_regularity FROM (
 SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS window_start, COUNT(*) AS event_count, SUM(amount) AS total_amount, AVG(amount) AS avg_amount, MAX(amount) AS max_amount, STDDEV_POP(amount) AS std_amount,
  CAST(COUNT(DISTINCT channel) AS INTEGER) AS channel_diversity, CASE WHEN COUNT(*) > 1 THEN (epoch_us(MAX(ts)) - epoch_us(MIN(ts))) / 1e6 / (COUNT(*) - 1) END AS gap_mean,
  CASE WHEN COUNT(DISTINCT channel) > 1 THEN entropy(channel) END AS channel_entropy FROM ev GROUP BY 1, 2)
"""


@query("STR-7", uses="ev", places=4, rounded="transactions_per_minute amount_per_minute amount_deviation_ratio channel_entropy time_regularity", sql=f"""
SELECT user_id, window_start, transactions_per_minute, amount_per_minute, amount_deviation_ratio, channel_diversity, channel_entropy, time_regularity FROM ({WINDOWED})
""")
def str_7(t):
    return features(t).select(
        "user_id", "window_start", "transactions_per_minute", "amount_per_minute", "amount_deviation_ratio", "channel_diversity",
        "channel_entropy", "time_regularity",
    )


RISK = """LEAST(1e0, (CASE WHEN transactions_per_minute > 10 THEN 0.3e0 ELSE 0e0 END) + (CASE WHEN amount_per_minute > 10000 THEN 0.2e0 ELSE 0e0 END)
  + (CASE WHEN amount_deviation_ratio > 5 THEN 0.2e0 ELSE 0e0 END) + (CASE WHEN channel_diversity > 3 THEN 0.15e0 ELSE 0e0 END) + (CASE WHEN gap_mean < 5 THEN 0.15e0 ELSE 0e0 END))"""


@query("RUL-12", uses="ev", rounded="risk_score", sql=f"""
SELECT user_id, window_start, {RISK} AS risk_score, CASE WHEN {RISK} >= 0.2 THEN 'LOW' ELSE 'MINIMAL' END AS risk_level FROM ({WINDOWED})
""")
def rul_12(t):
    return wd.scored_windows(features(t)).select("user_id", "window_start", "risk_score", "risk_level")


@query("STR-8", uses="ev", rounded="risk_score window_duration_minutes", sql=f"""
SELECT 'window_' || user_id || '_' || CAST(epoch(window_start) AS BIGINT) AS transaction_id, user_id, {RISK} AS risk_score, event_count AS window_events, 360e0 AS window_duration_minutes
FROM ({WINDOWED}) WHERE {RISK} > 0.1 AND window_start + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM ev) - INTERVAL 10 SECOND
""")
def str_8(t):
    stream = events(t).withWatermark("ts", "10 seconds")
    scored = wd.scored_windows(wd.window_features(wd.window_aggregates(stream, F.window("ts", "6 hours"), ["user_id"], KINDS)))
    folder = scratch(t.spark, "window-alerts")
    jobs.write_batches(scored, {"alerts": lambda b: wd.window_alerts(b, 0.1), "features": lambda b: b}, folder, scratch(t.spark, "window-alerts-checkpoint"))
    return t.spark.read.parquet(f"{folder}/alerts").select("transaction_id", "user_id", "risk_score", "window_events", "window_duration_minutes")


@query("STR-9", uses="ev", rounded="total_amount", places=4, sql="""
SELECT transaction_id, user_id, len(h) AS transaction_count, list_sum([x.a FOR x IN h]) AS total_amount, len(list_distinct([x.m FOR x IN h])) AS unique_merchants FROM (
 SELECT transaction_id, user_id, [x FOR x IN hist IF x.u >= epoch_us(ts) - 21600000000] AS h FROM (
  SELECT *, list({'u': epoch_us(ts), 'a': amount, 'm': merchant_id}) OVER (PARTITION BY user_id ORDER BY ts, transaction_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS hist FROM ev)) WHERE len(h) >= 3
""")
def str_9(t):
    return landed(t, jobs.user_velocity_stream(events(t), "1 minute", 21600, 3), "velocity")


STR10 = """
SELECT transaction_id, merchant_id, c AS current_count, (bn + c) / 24e0 AS baseline_count, a AS current_amount, (ba + a) / 24e0 AS baseline_amount FROM (
 SELECT transaction_id, merchant_id, date_trunc('hour', ts) AS hour, COUNT(*) OVER w AS c, SUM(amount) OVER w AS a FROM ev WINDOW w AS (PARTITION BY merchant_id, date_trunc('hour', ts) ORDER BY epoch_us(ts)))
JOIN (SELECT merchant_id, hour, ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY hour) AS seen, SUM(n) OVER p AS bn, SUM(s) OVER p AS ba FROM (
  SELECT merchant_id, date_trunc('hour', ts) AS hour, COUNT(*) AS n, SUM(amount) AS s FROM ev GROUP BY 1, 2) WINDOW p AS (PARTITION BY merchant_id ORDER BY hour ROWS BETWEEN 23 PRECEDING AND 1 PRECEDING)) USING (merchant_id, hour)
WHERE seen > 24 AND (c > (bn + c) / 24e0 * 3 OR a > (ba + a) / 24e0 * 5)
"""


@query("STR-10", uses="ev", rounded="baseline_count current_amount baseline_amount", places=4, sql=STR10)
def str_10(t):
    return landed(t, jobs.merchant_anomaly_stream(events(t)), "merchant-hours")


@query("STR-11", uses="ev", rounded="amount", places=4, sql="""
SELECT 'id' AS kind, COUNT(*) AS n, SUM(amount) AS amount FROM ev UNION ALL SELECT 'content', COUNT(*), SUM(amount) FROM ev
""")
def str_11(t):
    parts = []
    for kind, key in (("id", ["transaction_id"]), ("content", None)):
        rows = landed(t, jobs.deduplicated(events(t, 2), key), f"dedup-{kind}")
        parts.append(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")).select(F.lit(kind).alias("kind"), "n", "amount"))
    return parts[0].unionByName(parts[1])


@query("STR-12", uses="ev", rounded="amount", places=4, sql="SELECT channel, COUNT(*) AS n, SUM(amount) AS amount FROM ev GROUP BY 1")
def str_12(t):
    """The job runs, stops, and runs again on the same checkpoint: every event is there once."""
    folder, checkpoint = scratch(t.spark, "once"), scratch(t.spark, "once-checkpoint")
    for _ in range(2):
        jobs.write_batches(events(t), {"events": lambda b: b}, folder, checkpoint)
    return t.spark.read.parquet(f"{folder}/events").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


@query("STR-13", uses="ev", sql="""
SELECT user_id, COUNT(*) AS events, MIN(epoch_us(ts)) AS first_us, MAX(epoch_us(ts)) AS last_us FROM (
 SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY ts, transaction_id) AS session FROM (
  SELECT *, CASE WHEN ts <= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, transaction_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ev))
GROUP BY user_id, session HAVING MAX(ts) + INTERVAL 6 HOUR <= (SELECT MAX(ts) FROM ev) - INTERVAL 1 MINUTE
""")
def str_13(t):
    return landed(t, jobs.expiring_counters(events(t), "1 minute", "6 hours"), "expiring")


@query("STR-14", uses="ev merchants", rounded="recent_amount merchant_risk amount_log", places=4, sql="""
SELECT transaction_id, COUNT(*) OVER w AS recent_count, SUM(amount) OVER w AS recent_amount, merchant_risk, ln(1 + amount) AS amount_log, CAST(hour(ts) AS INTEGER) AS hour, true AS published
FROM ev LEFT JOIN merchants USING (merchant_id) WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""".replace("COUNT(*) OVER w AS recent_count, SUM(amount) OVER w AS recent_amount", "(SELECT COUNT(*) FROM ev b WHERE b.user_id = ev.user_id AND (b.ts < ev.ts OR (b.ts = ev.ts AND b.transaction_id <= ev.transaction_id)) AND epoch_us(b.ts) > epoch_us(ev.ts) - 21600000000) AS recent_count, (SELECT SUM(amount) FROM ev b WHERE b.user_id = ev.user_id AND (b.ts < ev.ts OR (b.ts = ev.ts AND b.transaction_id <= ev.transaction_id)) AND epoch_us(b.ts) > epoch_us(ev.ts) - 21600000000) AS recent_amount").replace(" WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", ""))
def str_14(t):
    folder = scratch(t.spark, "features")
    jobs.feature_job(events(t), t.merchants, folder, scratch(t.spark, "features-checkpoint"), 21600)
    table = t.spark.read.parquet(f"{folder}/features")
    topic = t.spark.read.parquet(f"{folder}/topic").select(
        F.get_json_object("value", "$.payload.transaction_id").alias("transaction_id"), F.lit(True).alias("published")
    )
    return table.join(topic, "transaction_id", "left").select(
        "transaction_id", "recent_count", "recent_amount", "merchant_risk", "amount_log", "hour", "published"
    )


@query("STR-15", uses="ev merchants", rounded="fraud_score", sql="""
SELECT transaction_id, s AS fraud_score, CASE WHEN s >= 0.8 THEN 'DECLINED' WHEN s >= 0.6 THEN 'REVIEW' ELSE 'APPROVED' END AS decision, s >= 0.3e0 AND s >= 0.6 AS alerted FROM (
 SELECT transaction_id, LEAST(1e0, GREATEST(0e0, (CASE WHEN amount > 10000 THEN 0.4e0 WHEN amount > 5000 THEN 0.2e0 WHEN amount < 1 THEN 0.3e0 ELSE 0e0 END) + (CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 0.2e0 ELSE 0e0 END)
  + (CASE WHEN (SELECT COUNT(*) FROM ev b WHERE b.user_id = ev.user_id AND (b.ts < ev.ts OR (b.ts = ev.ts AND b.transaction_id <= ev.transaction_id)) AND epoch_us(b.ts) > epoch_us(ev.ts) - 21600000000) > 1 THEN 0.3e0 ELSE 0e0 END)
  + COALESCE(merchant_risk, 0.5e0) * 0.2e0)) AS s FROM ev LEFT JOIN merchants USING (merchant_id))
""")
def str_15(t):
    folder = scratch(t.spark, "scored")
    jobs.scoring_job(events(t), t.merchants, folder, scratch(t.spark, "scored-checkpoint"), 21600, 1)
    alerts = t.spark.read.parquet(f"{folder}/alerts").select("transaction_id", F.lit(True).alias("alerted"))
    return t.spark.read.parquet(f"{folder}/predictions").join(alerts, "transaction_id", "left").select(
        "transaction_id", "fraud_score", "decision", F.coalesce("alerted", F.lit(False)).alias("alerted")
    )


@query("STR-16", uses="ev", sql="SELECT COUNT(*) AS events_processed, true AS has_throughput, true AS has_latency FROM ev")
def str_16(t):
    with jobs.ProgressLog(t.spark, scratch(t.spark, "progress")) as log:
        run = jobs.write_batches(events(t), {"events": lambda b: b}, scratch(t.spark, "measured"), scratch(t.spark, "measured-checkpoint"))
        m = jobs.run_metrics(log.rows(run))
    return m.select(
        "events_processed", (F.col("throughput") > 0).alias("has_throughput"),
        (
            (F.col("latency_min_ms") > 0) & F.col("latency_mean_ms").between(F.col("latency_min_ms"), F.col("latency_max_ms"))
            & F.col("latency_p95_ms").between(F.col("latency_min_ms"), F.col("latency_max_ms"))
        ).alias("has_latency"),
    )


def wire(t):
    """The events as JSON lines; every 20th record is broken."""
    folder = scratch(t.spark, "wire")
    e = t.ev
    body = F.to_json(F.struct("transaction_id", F.col("user_id").cast("string").alias("user_id"), F.col("merchant_id").cast("string").alias("merchant_id"), "amount",
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "channel"))
    broken = F.pmod(F.substring("transaction_id", 4, 20).cast("long"), F.lit(20)) == 7
    e.select(F.when(broken, F.concat(F.lit("{"), body)).otherwise(body).alias("value")).write.text(folder)
    return folder


@query("STR-17", uses="ev", sql="""
SELECT 'parsed' AS outcome, CAST(NULL AS VARCHAR) AS processing_status, COUNT(*) AS n FROM events WHERE event_id % 20 <> 7
UNION ALL SELECT 'dead', 'RETRY', COUNT(*) FROM events WHERE event_id % 20 = 7 AND event_id % 40 <> 7
UNION ALL SELECT 'dead', 'FAILED', COUNT(*) FROM events WHERE event_id % 40 = 7
""")
def str_17(t):
    raw = ss.text_stream(t.spark, wire(t))
    good, bad = ss.split_malformed(raw, ss.EVENT_SCHEMA)
    parsed = landed(t, good.select("transaction_id", "amount"), "parsed")
    dead = landed(t, bad, "dead")
    number = F.regexp_extract("raw", r'"ev_(\d+)"', 1).cast("long")
    attempts = dead.filter(number % 40 == 7).select(F.sha2("raw", 256).alias("record_id"), F.lit(3).alias("retry_count"))
    ledger = jobs.retry_ledger(dead, attempts)
    return parsed.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("parsed").alias("outcome"), F.lit(None).cast("string").alias("processing_status"), "n"
    ).unionByName(ledger.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("outcome"), "processing_status", "n"))


@query("SRC-11", uses="ev", rounded="amount", sql="""
SELECT transaction_id, CAST(user_id AS VARCHAR) AS user_id, amount, 'USD' AS currency, channel, ts FROM ev WHERE CAST(substr(transaction_id, 4) AS BIGINT) % 20 <> 7
""")
def src_11(t):
    good = ss.parse_events(ss.text_stream(t.spark, wire(t))).filter(F.col("transaction_id").isNotNull())
    return landed(t, good.select("transaction_id", "user_id", "amount", "currency", "channel", "ts"), "source")


@query("SRC-12", uses="ev", rounded="amount", sql="""
SELECT CAST(user_id AS VARCHAR) AS key, 'transaction' AS event_type, 'fraud_api' AS source, transaction_id, amount FROM ev
""")
def src_12(t):
    out = landed(t, ss.envelope(events(t), "transaction"), "envelopes")
    return out.select(
        "key", F.get_json_object("value", "$.event_type").alias("event_type"), F.get_json_object("value", "$.source").alias("source"),
        F.get_json_object("value", "$.payload.transaction_id").alias("transaction_id"),
        F.get_json_object("value", "$.payload.amount").cast("double").alias("amount"),
    )


@query("SRC-13", uses="ev", sql="""
SELECT 'transactions' AS consumer, COUNT(*) AS n FROM ev UNION ALL SELECT 'alerts', COUNT(*) FROM ev WHERE amount > 50 UNION ALL SELECT 'errors', COUNT(*) FROM ev WHERE channel = 'error'
""")
def src_13(t):
    handlers = {
        "transactions": lambda d: d, "alerts": lambda d: d.filter(F.col("amount") > 50), "errors": lambda d: d.filter(F.col("channel") == "error"),
    }
    out = None
    for name, handler in handlers.items():
        rows = jobs.consumer(events(t), handler, scratch(t.spark, name), scratch(t.spark, f"{name}-checkpoint"))
        part = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("consumer"), "n")
        out = part if out is None else out.unionByName(part)
    return out
