"""Scalar function queries: one column per helper, over whole tables."""

from pyspark.sql import functions as F

from ledgerwatch.functions import columns as c
from ledgerwatch.functions.registry import apply_operator, register_operator
from ledgerwatch.operators import aggregates as ag
from ledgerwatch.plans.registry import query


@query("FUN-1", uses="tx lim", sql="""
SELECT transaction_id, date_trunc('hour', ts)::TIMESTAMP AS hour_start, time_bucket(INTERVAL '15 minutes', ts) AS quarter_hour, CAST(dayofweek(ts) AS INTEGER) AS dow_sunday0,
  CAST(isodow(ts) - 1 AS INTEGER) AS dow_monday0, CAST(epoch(ts) AS BIGINT) AS epoch_seconds, ts - INTERVAL 90 MINUTE AS earlier FROM tx
""")
def fun_1(t):
    return t.tx_slim.select(
        "transaction_id", c.truncate("hour", "ts").alias("hour_start"), c.time_bucket(900, "ts").alias("quarter_hour"),
        c.weekday_sunday0("ts").alias("dow_sunday0"), c.weekday_monday0("ts").alias("dow_monday0"),
        F.unix_seconds("ts").alias("epoch_seconds"), c.interval_before(F.col("ts"), 5400).alias("earlier"),
    )


@query("FUN-2", uses="tx", rounded="log_amount root log_2 clamped ratio", sql="""
SELECT transaction_id, ln(1 + amount) AS log_amount, sqrt(amount) AS root, ln(amount + 1) / ln(2e0) AS log_2, GREATEST(0e0, LEAST(1e0, amount / 1000)) AS clamped,
  CASE WHEN (user_id % 3) <> 0 THEN amount / (user_id % 3) ELSE 0e0 END AS ratio FROM tx
""")
def fun_2(t):
    a = F.col("amount")
    return t.tx_slim.select(
        "transaction_id", F.log1p(a).alias("log_amount"), F.sqrt(a).alias("root"), c.log2(a + 1).alias("log_2"),
        c.clamp(a / 1000).alias("clamped"), c.safe_ratio(a, F.col("user_id") % 3).alias("ratio"),
    )


@query("FUN-3", uses="tx", sql=r"""
SELECT transaction_id, lower(country) AS lowered, contains(lower(category), 'crypt') OR contains(lower(category), 'gam') AS suspicious, country || '/' || category AS joined,
  regexp_extract(transaction_id, '_(\d+)', 1) AS digits, ts AS parsed FROM tx
""")
def fun_3(t):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t.tx_place.select(
        "transaction_id", F.lower("country").alias("lowered"), c.contains_any(F.lower("category"), ["crypt", "gam"]).alias("suspicious"),
        F.concat("country", F.lit("/"), "category").alias("joined"), F.regexp_extract("transaction_id", r"_(\d+)", 1).alias("digits"),
        c.parse_iso(iso).alias("parsed"),
    )


@query("FUN-4", uses="tx", sql="""
SELECT country, string_agg(category || ':' || n, '|' ORDER BY category) AS histogram, COUNT(*) AS categories FROM (SELECT country, category, COUNT(*) AS n FROM tx GROUP BY 1, 2) GROUP BY 1
""")
def fun_4(t):
    counts = t.tx_place.groupBy("country", "category").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy("country").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return packed.select("country", F.array_join(entries, "|").alias("histogram"), F.size("m").cast("long").alias("categories"))


@query("FUN-5", uses="ev", sql="""
SELECT transaction_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"user_id":' || user_id || ',"channel":"' || channel || '"}' AS packed FROM ev
""")
def fun_5(t):
    return t.ev.select("transaction_id", c.json_field("props", "k", "bigint").alias("k"), c.row_json("user_id", "channel").alias("packed"))


@query("FUN-6", uses="tx", sql="""
SELECT transaction_id, md5(transaction_id) AS md5_key, sha256(transaction_id) AS sha_key, sha256('{"transaction_id":"' || transaction_id || '","user_id":' || user_id || '}') AS content FROM tx
""")
def fun_6(t):
    return t.tx_slim.select(
        "transaction_id", F.md5("transaction_id").alias("md5_key"), F.sha2("transaction_id", 256).alias("sha_key"),
        c.content_key("transaction_id", "user_id").alias("content"),
    )


@query("FUN-7", uses="tx", rounded="mean std_pop std_sample slope entropy median_amount q95", places=4, sql="""
SELECT * FROM (SELECT country, AVG(amount) AS mean, STDDEV_POP(amount) AS std_pop, STDDEV_SAMP(amount) AS std_sample, regr_slope(amount, processing_time_ms) AS slope,
  quantile_cont(amount, 0.5) AS median_amount, quantile_cont(amount, 0.95) AS q95 FROM tx GROUP BY 1)
JOIN (SELECT country, -SUM(n / t * log2(n / t)) AS entropy FROM (SELECT country, category, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY country) AS t FROM tx GROUP BY 1, 2) GROUP BY 1) USING (country)
""")
def fun_7(t):
    from ledgerwatch.functions import timeline as tl

    stats = t.tx_place.groupBy("country").agg(
        F.avg("amount").alias("mean"), F.stddev_pop("amount").alias("std_pop"), F.stddev_samp("amount").alias("std_sample"),
        F.regr_slope("amount", F.col("processing_time_ms").cast("double")).alias("slope"),
    )
    quantiles = tl.exact_quantiles(t.tx_place.select("country", "amount"), "country", "amount", {"median_amount": 0.5, "q95": 0.95})
    counts = t.tx_place.groupBy("country", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("country").agg(F.collect_list("n").alias("ns"))
    entropy = counts.select("country", c.entropy_of_counts(F.col("ns")).alias("entropy"))
    return stats.join(quantiles, "country").join(entropy, "country")


@query("FUN-8", uses="tx", sql="""
SELECT category, COUNT(*) FILTER (WHERE amount > 5000) AS large FROM tx GROUP BY 1
""")
def fun_8(t):
    register_operator("large_by_category", lambda df, limit=5000.0: df.groupBy("category").agg(F.count_if(F.col("amount") > limit).alias("large")))
    return apply_operator("large_by_category", t.tx_slim)


@query("FUN-9", uses="tx scored", rounded="fraud_rate avg_fraud_score", places=4, sql="""
SELECT COUNT(*) AS total_transactions, COUNT(*) FILTER (WHERE decision = 'DECLINED') AS fraud_transactions, ROUND(COUNT(*) FILTER (WHERE decision = 'DECLINED') * 100e0 / COUNT(*), 2) AS fraud_rate,
  AVG(fraud_score) AS avg_fraud_score FROM scored WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01'
""")
def fun_9(t):
    ag.fraud_stats(t.scored_slim, "1997-01-01", "1998-01-01").createOrReplaceTempView("fraud_stats_1997")
    return t.spark.sql("SELECT total_transactions, fraud_transactions, fraud_rate, avg_fraud_score FROM fraud_stats_1997")
