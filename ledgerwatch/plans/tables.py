"""Source, sink and table-maintenance queries.  Intermediate files are derived from the given tables."""

from pyspark.sql import functions as F

from ledgerwatch.plans.registry import query
from ledgerwatch.sources import readers as rd
from ledgerwatch.sources import writers as wr
from ledgerwatch.sources.files import partitions, scratch


def csv_rows(t):
    return t.tx.select(
        "transaction_id", F.col("user_id").cast("string").alias("user_id"), "amount", "currency",
        F.col("merchant_id").cast("string").alias("merchant_id"), "category", "country",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        "device_id", F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("int").alias("user_age"),
        F.lit(None).cast("string").alias("user_income"), F.hour("ts").alias("transaction_hour"),
        F.weekday("ts").alias("transaction_day_of_week"), F.col("is_fraud").cast("int").alias("is_fraud"),
    )


@query("SRC-1", uses="tx", rounded="amount", sql="""
SELECT transaction_id, CAST(user_id AS VARCHAR) AS user_id, amount, category, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, CAST(is_fraud AS INTEGER) AS is_fraud FROM tx
""")
def src_1(t):
    path = scratch(t.spark, "csv")
    csv_rows(t).write.option("header", True).csv(path)
    return rd.read_transactions_csv(t.spark, path).select("transaction_id", "user_id", "amount", "category", "timestamp", "is_fraud")


@query("SRC-2", uses="tx", sql="""
SELECT *, 'USD' AS currency, 'merchant_' || lpad(CAST(CAST('0x' || substr(md5(concat_ws('|', transaction_id, user_id, amount, category, timestamp, is_fraud)), 1, 12) AS BIGINT) % 1000 AS VARCHAR), 4, '0') AS merchant_id
FROM (SELECT transaction_id, user_id, CAST(ROUND(amount * 100) AS BIGINT) AS amount, category, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, is_fraud FROM tx)
""")
def src_2(t):
    raw = t.tx_slim.select(
        F.col("transaction_id").alias("TransactionID"), F.col("user_id").alias("account_id"),
        F.round(F.col("amount") * 100).cast("long").alias("TransactionAmt"), F.col("category").alias("ProductCD"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("TransactionDT"), F.col("is_fraud").alias("isFraud"),
    )
    return rd.standardise_columns(raw)


@query("SRC-3", uses="tx", rounded="amount latitude longitude", sql="""
SELECT transaction_id, CAST(user_id AS VARCHAR) AS user_id, CAST(merchant_id AS VARCHAR) AS merchant_id, amount, ts, latitude, longitude, device_id FROM tx
""")
def src_3(t):
    path = scratch(t.spark, "json")
    one = F.struct(
        F.col("transaction_id").alias("transactionId"), F.col("user_id").cast("string").alias("userId"), "amount", "currency",
        F.col("merchant_id").cast("string").alias("merchantId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.struct("latitude", "longitude").alias("location"), F.col("device_id").alias("deviceId"),
    )
    # one document per transaction: a document must never grow with its group
    t.tx.select(F.array(one).alias("transactions")).write.json(path)
    return rd.read_json_batch(t.spark, path, multi_line=False).select(
        "transaction_id", "user_id", "merchant_id", "amount", "ts", "latitude", "longitude", "device_id"
    )


@query("SRC-4", uses="tx", sql="""
SELECT CASE WHEN reasons = '' THEN 'valid' ELSE 'quarantine' END AS outcome, reasons, COUNT(*) AS n FROM (
 SELECT concat_ws('; ', CASE WHEN merchant_id = 0 THEN 'missing merchant_id' END, CASE WHEN amount - 1 <= 0 THEN 'amount not positive' END,
  CASE WHEN fraud_score * 1.02e0 > 1 THEN 'fraud_score out of range' END) AS reasons FROM tx) GROUP BY 1, 2
""")
def src_4(t):
    dirty = t.tx_merchant.withColumns(
        {"merchant_id": F.nullif("merchant_id", F.lit(0)), "amount": F.col("amount") - 1, "fraud_score": F.col("fraud_score") * 1.02}
    )
    good, bad = rd.validate(dirty)
    g = good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("valid").alias("outcome"), F.lit("").alias("reasons"), "n")
    b = bad.groupBy(F.array_join("reasons", "; ").alias("reasons")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("quarantine").alias("outcome"), "reasons", "n"
    )
    return g.unionByName(b)


@query("SRC-5", uses="tx ruled ruledl", rounded="value", places=4, sql="""
SELECT 'scored' AS part, verdict AS name, CAST(COUNT(*) AS DOUBLE) AS value FROM ruledl GROUP BY 2
UNION ALL SELECT 'summary', 'total_transactions', COUNT(*) FROM ruledl UNION ALL SELECT 'summary', 'amount_total', SUM(amount) FROM ruledl
""")
def src_5(t):
    from ledgerwatch.operators import rules as rl

    path = scratch(t.spark, "results")
    scored = rl.score_batch(t.tx)
    wr.save_results(scored, rl.batch_summary(scored), path)
    rows = t.spark.read.option("header", True).csv(f"{path}/scored").groupBy(F.col("decision").alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).withColumn("part", F.lit("scored"))
    summary = t.spark.read.json(f"{path}/summary").select(
        F.col("total_transactions").cast("double").alias("total_transactions"), F.col("amount_total").cast("double").alias("amount_total")
    ).unpivot([], ["total_transactions", "amount_total"], "name", "value").withColumn("part", F.lit("summary"))
    return rows.unionByName(summary)


@query("SRC-6", uses="tx", sql="""
SELECT 'user' AS kind, user_id AS id, NULL AS category, MIN(ts) AS created_at FROM tx GROUP BY 2
UNION ALL SELECT 'merchant', merchant_id, arg_min(category, (ts, transaction_id)), MIN(ts) FROM tx GROUP BY 2
""")
def src_6(t):
    users, merchants = wr.derive_dimensions(t.tx_merchant)
    return users.select(
        F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.lit(None).cast("string").alias("category"), "created_at"
    ).unionByName(merchants.select(F.lit("merchant").alias("kind"), F.col("merchant_id").alias("id"), "category", "created_at"))


@query("SRC-7", uses="tx", sql="""
SELECT CASE WHEN fraud_score >= 0.8 THEN 'CRITICAL' WHEN fraud_score >= 0.6 THEN 'HIGH' WHEN fraud_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN fraud_score >= 0.8 THEN 'DECLINED' WHEN fraud_score >= 0.6 THEN 'REVIEW' ELSE 'APPROVED' END AS decision, COUNT(*) AS n FROM tx GROUP BY 1, 2
""")
def src_7(t):
    return wr.band_scores(t.tx_slim).groupBy("risk_level", "decision").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-8", uses="tx", sql="""
SELECT user_id, MIN(transaction_id) AS transaction_id FROM tx WHERE ts >= TIMESTAMP '1995-01-01' AND user_id NOT IN (SELECT user_id FROM tx WHERE ts < TIMESTAMP '1995-01-01') GROUP BY 1
""")
def src_8(t):
    cut = F.lit("1995-01-01").cast("timestamp")
    rows = t.tx_slim.select("user_id", "transaction_id", "ts")
    return wr.insert_ignore(rows.filter(F.col("ts") < cut).drop("ts"), rows.filter(F.col("ts") >= cut).drop("ts"), ["user_id"])


@query("SRC-9", uses="tx", rounded="amount", sql="""
SELECT user_id, MAX(ts) AS ts, arg_max(transaction_id, (ts, transaction_id)) AS transaction_id, arg_max(amount, (ts, transaction_id)) AS amount FROM tx GROUP BY 1
""")
def src_9(t):
    cut = F.lit("1995-01-01").cast("timestamp")
    rows = t.tx_slim.select("user_id", "ts", "transaction_id", "amount")
    return wr.upsert_latest(rows.filter(F.col("ts") < cut), rows.filter(F.col("ts") >= cut), ["user_id"], "ts")


@query("SRC-10", uses="tx lim", rounded="amount fraud_score", sql="""
SELECT transaction_id, amount, fraud_score, is_fraud, ts FROM tx, lim WHERE ts > as_of - INTERVAL 400 DAY ORDER BY ts DESC, transaction_id DESC LIMIT 100000
""")
def src_10(t):
    return rd.training_scan(t.tx_slim, 400).select("transaction_id", "amount", "fraud_score", "is_fraud", "ts")


@query("SRC-14", uses="tx", rounded="amount", places=4, sql="""
SELECT strftime(ts, '%Y-%m') AS month_of, COUNT(*) AS n, SUM(amount) AS amount FROM tx WHERE ts >= TIMESTAMP '1996-01-01' AND ts < TIMESTAMP '1997-01-01' GROUP BY 1
""")
def src_14(t):
    path = scratch(t.spark, "monthly")
    wr.write_partitioned(t.tx_slim, path, "month")
    table = t.spark.read.parquet(path)
    return table.filter(F.col("month_of").between("1996-01", "1996-12")).groupBy("month_of").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )


@query("SRC-15", uses="tx", sql="SELECT strftime(ts, '%Y-%m') AS month_of, COUNT(*) AS n FROM tx WHERE ts >= TIMESTAMP '1997-01-01' GROUP BY 1")
def src_15(t):
    path = scratch(t.spark, "retained")
    column = wr.write_partitioned(t.tx_slim, path, "month")
    wr.expire(t.spark, path, column, "1997-01")
    return t.spark.read.parquet(path).groupBy("month_of").agg(F.count(F.lit(1)).alias("n"))


@query("SRC-16", uses="tx", rounded="amount", places=4, sql="""
SELECT strftime(ts, '%Y-%m') AS month_of, COUNT(*) AS n, SUM(amount) AS amount FROM tx GROUP BY 1
""")
def src_16(t):
    path, target = scratch(t.spark, "loose"), scratch(t.spark, "compacted")
    column = wr.write_partitioned(t.tx_slim, path, "month")
    wr.compact(t.spark, path, target, column, "1998-01")
    assert set(partitions(t.spark, target, column)) == set(partitions(t.spark, path, column))
    return t.spark.read.parquet(target).groupBy(F.col("month_of").cast("string").alias("month_of")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")
    )


@query("SRC-17", uses="tx", sql="""
SELECT 'orders' AS table_name, COUNT(*) AS row_count, COUNT(*) = 0 AS is_empty, NULL::TIMESTAMP AS first_ts, NULL::TIMESTAMP AS last_ts FROM orders UNION ALL SELECT 'customer', COUNT(*), COUNT(*) = 0, NULL, NULL FROM customer
UNION ALL SELECT 'events', COUNT(*), COUNT(*) = 0, NULL, NULL FROM events UNION ALL SELECT 'empty', 0, true, NULL, NULL
UNION ALL SELECT 'fraud', COUNT(*) FILTER (WHERE is_fraud), false, MIN(ts), MAX(ts) FROM tx UNION ALL SELECT 'normal', COUNT(*) FILTER (WHERE NOT is_fraud), false, MIN(ts), MAX(ts) FROM tx
""")
def src_17(t):
    names = {n: t.raw(n) for n in ("orders", "customer", "events")}
    names["empty"] = t.raw("orders").filter(F.lit(False))
    none = F.lit(None).cast("timestamp")
    tables = wr.profile(names).withColumns({"first_ts": none, "last_ts": none})
    labels = wr.label_profile(t.tx_slim).unpivot(["first_ts", "last_ts"], ["fraud", "normal"], "table_name", "row_count")
    return tables.unionByName(labels.withColumn("is_empty", F.col("row_count") == 0))


@query("SRC-18", uses="tx", rounded="mean_lat", sql="""
SELECT 'indexed' AS outcome, COUNT(*) AS n, AVG(latitude) AS mean_lat FROM tx WHERE latitude * 1.6e0 BETWEEN -90 AND 90
UNION ALL SELECT 'failed', 2 * COUNT(*), NULL FROM tx WHERE NOT (latitude * 1.6e0 BETWEEN -90 AND 90)
""")
def src_18(t):
    rows = t.tx_place.select("transaction_id", "ts", "amount", (F.col("latitude") * 1.6).alias("latitude"), "longitude")
    written, failed = wr.index_documents(rows.unionByName(rows), scratch(t.spark, "documents"))
    w = written.agg(F.count(F.lit(1)).alias("n"), (F.avg("location.lat") / 1.6).alias("mean_lat")).withColumn("outcome", F.lit("indexed"))
    f = failed.agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("mean_lat")).withColumn("outcome", F.lit("failed"))
    return w.unionByName(f)
