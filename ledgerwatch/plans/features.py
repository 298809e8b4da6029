"""Feature queries."""

from pyspark.sql import functions as F

from ledgerwatch.operators import features as ft
from ledgerwatch.plans.joins import HAV
from ledgerwatch.plans.registry import cte, query

BY_USER = "PARTITION BY user_id ORDER BY ts, transaction_id"


@query("FEA-1", uses="tx", sql="""
SELECT transaction_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(day(ts) AS INTEGER) AS day_of_month, CAST(month(ts) AS INTEGER) AS month,
  CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year, CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend, CAST(day(ts) <= 3 AS INTEGER) AS is_month_start,
  CAST(day(ts) >= 28 AS INTEGER) AS is_month_end, CAST(hour(ts) BETWEEN 9 AND 17 AS INTEGER) AS is_business_hour, CAST(hour(ts) >= 22 OR hour(ts) <= 6 AS INTEGER) AS is_night,
  CAST(hour(ts) < 6 OR hour(ts) > 22 AS INTEGER) AS is_night_time, CAST(hour(ts) BETWEEN 11 AND 14 AS INTEGER) AS is_lunch_time FROM tx
""")
def fea_1(t):
    return ft.calendar(t.tx_slim.select("transaction_id", "ts")).drop("ts")



@query("FEA-2", uses="tx", rounded="hour_sin hour_cos dow_sin dow_cos month_sin month_cos", sql="""
SELECT transaction_id, sin(hour(ts) * 2e0 * pi() / 24e0) AS hour_sin, cos(hour(ts) * 2e0 * pi() / 24e0) AS hour_cos, sin((isodow(ts) - 1) * 2e0 * pi() / 7e0) AS dow_sin,
  cos((isodow(ts) - 1) * 2e0 * pi() / 7e0) AS dow_cos, sin(month(ts) * 2e0 * pi() / 12e0) AS month_sin, cos(month(ts) * 2e0 * pi() / 12e0) AS month_cos FROM tx
""")
def fea_2(t):
    return ft.cyclical(t.tx_slim.select("transaction_id", "ts")).drop("ts")


@query("FEA-3", uses="tx", sql="""
SELECT transaction_id, CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS days_since_epoch,
  CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS seconds_since_midnight FROM tx
""")
def fea_3(t):
    return ft.elapsed(t.tx_slim.select("transaction_id", "ts")).drop("ts")


def _before(w, agg, part="user_id"):
    return f"{agg} OVER (PARTITION BY {part} ORDER BY epoch_us(ts) RANGE BETWEEN {w * 1000000} PRECEDING AND 1 PRECEDING)"


@query("FEA-4", uses="ev", places=4, rounded=" ".join(f"user_amount_{s}" for s in ft.VELOCITY), sql=f"""
SELECT transaction_id, {", ".join(f"{_before(w, 'COUNT(*)')} AS user_tx_count_{s}, COALESCE({_before(w, 'SUM(amount)')}, 0) AS user_amount_{s}" for s, w in ft.VELOCITY.items())} FROM ev
""")
def fea_4(t):
    return ft.velocity(t.ev.select("transaction_id", "user_id", "ts", "amount")).drop("user_id", "ts", "amount")


@query("FEA-5", uses="ev", places=4, rounded="user_avg_amount user_std_amount user_median_amount amount_zscore", sql=f"""
SELECT transaction_id, m AS user_avg_amount, s AS user_std_amount, list_aggregate(h, 'quantile_cont', 0.5) AS user_median_amount,
  CASE WHEN s <> 0 THEN (amount - m) / s ELSE 0 END AS amount_zscore, amount < q1 - (q3 - q1) * 1.5e0 OR amount > q3 + (q3 - q1) * 1.5e0 AS is_amount_outlier FROM (
 SELECT *, list_avg(h) AS m, COALESCE(list_aggregate(h, 'stddev_samp'), 0) AS s, list_aggregate(h, 'quantile_cont', 0.25) AS q1, list_aggregate(h, 'quantile_cont', 0.75) AS q3
 FROM (SELECT transaction_id, amount, list_transform(list_filter(list({{'u': epoch_us(ts), 'v': amount}}) OVER ({BY_USER} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
   lambda p: p.u > epoch_us(ts) - 604800000000), lambda p: p.v) AS h FROM ev))
""")
def fea_5(t):
    return ft.recent_profile(t.ev.select("transaction_id", "user_id", "ts", "amount"), seconds=604_800).drop("user_id", "ts", "amount")


@query("FEA-6", uses="tx", places=4, rounded="amount_sum amount_mean amount_std amount_min amount_max amount_median amount_zscore amount_deviation merchant_diversity category_diversity", sql="""
SELECT transaction_id, n AS amount_count, amount_sum, m AS amount_mean, s AS amount_std, amount_min, amount_max, amount_median, merchant_nunique, category_nunique,
  (amount - m) / (s + 1e-8) AS amount_zscore, abs((amount - m) / (s + 1e-8)) AS amount_deviation, CASE WHEN abs((amount - m) / (s + 1e-8)) > 2 THEN 1 ELSE 0 END AS is_amount_outlier,
  merchant_nunique / n AS merchant_diversity, category_nunique / n AS category_diversity
FROM tx JOIN (SELECT user_id, COUNT(amount) AS n, SUM(amount) AS amount_sum, AVG(amount) AS m, STDDEV_SAMP(amount) AS s, MIN(amount) AS amount_min, MAX(amount) AS amount_max,
  quantile_cont(amount, 0.5) AS amount_median, COUNT(DISTINCT merchant_id) AS merchant_nunique, COUNT(DISTINCT category) AS category_nunique FROM tx GROUP BY 1) USING (user_id)
""")
def fea_6(t):
    return ft.lifetime_profile(t.tx_merchant.select("transaction_id", "user_id", "amount", "merchant_id", "category")).drop(
        "user_id", "amount", "merchant_id", "category"
    )


FEA7 = {"1h": 86400, "24h": 604800, "7d": 2592000, "30d": 15552000}


@query("FEA-7", uses="tx merchants", rounded="merchant_fraud_rate_7d merchant_fraud_rate_30d merchant_risk_score", sql=f"""
SELECT transaction_id, merchant_tx_count_1h, merchant_tx_count_24h, merchant_tx_count_7d, merchant_tx_count_30d, COALESCE(f7 / NULLIF(merchant_tx_count_7d, 0), 0) AS merchant_fraud_rate_7d,
  COALESCE(f30 / NULLIF(merchant_tx_count_30d, 0), 0) AS merchant_fraud_rate_30d, merchant_risk AS merchant_risk_score, category IN ('gambling', 'crypto') AS is_high_risk_category
FROM (SELECT *, {", ".join(f"{_before(w, 'COUNT(*)', 'merchant_id')} AS merchant_tx_count_{s}" for s, w in FEA7.items())},
  {_before(FEA7['7d'], 'SUM(CAST(is_fraud AS INTEGER))', 'merchant_id')} AS f7, {_before(FEA7['30d'], 'SUM(CAST(is_fraud AS INTEGER))', 'merchant_id')} AS f30 FROM tx)
LEFT JOIN merchants USING (merchant_id)
""")
def fea_7(t):
    base = t.tx_merchant.select("transaction_id", "merchant_id", "ts", "is_fraud", "category")
    return ft.merchant_features(base, t.merchants, FEA7).drop("merchant_id", "ts", "is_fraud", "category")


@query("FEA-8", uses="tx", rounded="amount_log amount_sqrt distance_from_equator", sql="""
SELECT transaction_id, ln(1 + amount) AS amount_log, sqrt(amount) AS amount_sqrt, CAST(amount < 1 AS INTEGER) AS is_micro_transaction, CAST(amount >= 1 AND amount < 50 AS INTEGER) AS is_small_transaction,
  CAST(amount >= 50 AND amount < 500 AS INTEGER) AS is_medium_transaction, CAST(amount >= 500 AND amount < 5000 AS INTEGER) AS is_large_transaction,
  CAST(amount >= 5000 AS INTEGER) AS is_very_large_transaction, CAST(currency = 'USD' AS INTEGER) AS is_usd, CAST(currency = 'EUR' AS INTEGER) AS is_eur,
  CAST(currency NOT IN ('USD', 'EUR', 'GBP', 'JPY') AS INTEGER) AS is_exotic_currency, 1 AS has_location, abs(latitude) AS distance_from_equator,
  CAST(abs(latitude) > 60 OR abs(longitude) > 150 AS INTEGER) AS is_unusual_location FROM tx
""")
def fea_8(t):
    return ft.transaction_features(t.tx_place.select("transaction_id", "amount", "currency", "latitude", "longitude")).drop(
        "amount", "currency", "latitude", "longitude"
    )


@query("FEA-9", uses="ev", places=4, rounded="user_amount_24h user_amount_7d time_since_last_tx tx_velocity_24h amount_velocity_24h merchant_diversity_7d spending_consistency", sql=f"""
SELECT transaction_id, c1 AS user_tx_count_24h, a1 AS user_amount_24h, c7 AS user_tx_count_7d, a7 AS user_amount_7d, gap AS time_since_last_tx, mc AS user_merchant_count_7d,
  c1 / 24 AS tx_velocity_24h, a1 / 24 AS amount_velocity_24h, CAST(COALESCE(gap < 60, false) AS INTEGER) AS is_rapid_fire, mc / GREATEST(1, c7) AS merchant_diversity_7d,
  1 / (1 + sd / GREATEST(1e0, mean)) AS spending_consistency FROM (
 SELECT *, {_before(86400, 'COUNT(*)')} AS c1, COALESCE({_before(86400, 'SUM(amount)')}, 0) AS a1, {_before(604800, 'COUNT(*)')} AS c7, COALESCE({_before(604800, 'SUM(amount)')}, 0) AS a7,
  (epoch_us(ts) - epoch_us(LAG(ts) OVER ({BY_USER}))) / 1e6 AS gap, AVG(amount) OVER (PARTITION BY user_id) AS mean, STDDEV_POP(amount) OVER (PARTITION BY user_id) AS sd,
  (SELECT COUNT(DISTINCT b.merchant_id) FROM ev b WHERE b.user_id = ev.user_id AND b.ts <= ev.ts AND epoch_us(b.ts) > epoch_us(ev.ts) - 604800000000) AS mc FROM ev)
""")
def fea_9(t):
    return ft.rate_features(t.ev.select("transaction_id", "user_id", "merchant_id", "ts", "amount")).drop(
        "user_id", "merchant_id", "ts", "amount"
    )


CODES = ", ".join(f"'{k}'" for k in [*ft.COUNTRY_RISK, "JP", "MX"])
RISK = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in ft.COUNTRY_RISK.items())


@query("FEA-10", uses="tx", rounded="country_risk_score", sql=f"""
SELECT transaction_id, CASE [{CODES}][CAST(regexp_extract(country, '(\\d+)', 1) AS INTEGER) % 16 + 1] {RISK} ELSE 0.5e0 END AS country_risk_score, abs(latitude) > 60 OR abs(longitude) > 150 AS is_unusual_location FROM tx
""")
def fea_10(t):
    codes = F.array(*[F.lit(c) for c in [*ft.COUNTRY_RISK, "JP", "MX"]])
    number = F.regexp_extract("country", r"(\d+)", 1).cast("int")
    coded = t.tx_place.withColumn("country", F.get(codes, number % 16))
    return ft.geographic_features(coded).select("transaction_id", "country_risk_score", "is_unusual_location")


@query("FEA-11", uses="tx", places=3, rounded="distance_from_home distance_from_last_tx location_entropy", sql=f"""
WITH c AS (SELECT user_id, ROUND(latitude, 3) AS la, ROUND(longitude, 3) AS lo, COUNT(*) AS n FROM tx GROUP BY 1, 2, 3),
h AS (SELECT user_id, la, lo FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, la, lo) AS r FROM c) WHERE r = 1),
e AS (SELECT user_id, log2(SUM(n)) - SUM(n * log2(n)) / SUM(n) AS location_entropy FROM (SELECT user_id, FLOOR((latitude + 90) / 180 * 4096) AS y, FLOOR((longitude + 180) / 360 * 8192) AS x, COUNT(*) AS n FROM tx GROUP BY 1, 2, 3) GROUP BY 1)
SELECT transaction_id, {HAV.format('la', 'lo', 'latitude', 'longitude')} AS distance_from_home, COALESCE({HAV.format('pla', 'plo', 'latitude', 'longitude')}, 0) AS distance_from_last_tx, location_entropy
FROM (SELECT *, LAG(latitude) OVER w AS pla, LAG(longitude) OVER w AS plo FROM tx WINDOW w AS ({BY_USER})) JOIN h USING (user_id) JOIN e USING (user_id)
""")
def fea_11(t):
    return ft.distance_features(t.tx_place.select("transaction_id", "user_id", "ts", "latitude", "longitude")).select(
        "transaction_id", "distance_from_home", "distance_from_last_tx", "location_entropy"
    )


@query("FEA-12", uses="tx", places=4, rounded="category_fraud_rate category_avg_amount amount_vs_category_avg", sql="""
SELECT transaction_id, cf AS category_fraud_rate, ca AS category_avg_amount, amount / ca AS amount_vs_category_avg, rm = 1 AS is_new_merchant, rd = 1 AS is_new_device, shared_device_count,
  country <> dc AS country_mismatch
FROM (SELECT *, AVG(CAST(is_fraud AS DOUBLE)) OVER (PARTITION BY category) AS cf, AVG(amount) OVER (PARTITION BY category) AS ca,
  ROW_NUMBER() OVER (PARTITION BY user_id, merchant_id ORDER BY ts, transaction_id) AS rm, ROW_NUMBER() OVER (PARTITION BY user_id, device_id ORDER BY ts, transaction_id) AS rd FROM tx)
JOIN (SELECT device_id, COUNT(DISTINCT user_id) AS shared_device_count FROM tx GROUP BY 1) USING (device_id)
JOIN (SELECT device_id, country AS dc FROM (SELECT device_id, country, ROW_NUMBER() OVER (PARTITION BY device_id ORDER BY COUNT(*) DESC, country) AS r FROM tx GROUP BY 1, 2) WHERE r = 1) USING (device_id)
""")
def fea_12(t):
    base = t.tx.select("transaction_id", "user_id", "merchant_id", "device_id", "category", "country", "amount", "is_fraud", "ts")
    return ft.context_features(base).select(
        "transaction_id", "category_fraud_rate", "category_avg_amount", "amount_vs_category_avg", "is_new_merchant",
        "is_new_device", "shared_device_count", "country_mismatch",
    )


@query("FEA-13", uses="tx", rounded="category_frequency_norm currency_frequency_norm", sql="""
WITH a AS (SELECT category, COUNT(*) AS n FROM tx GROUP BY 1), b AS (SELECT currency, COUNT(*) AS n FROM tx GROUP BY 1)
SELECT transaction_id, a.n AS category_frequency, a.n / (SELECT COUNT(*) FROM tx) AS category_frequency_norm, CAST((SELECT COUNT(DISTINCT n) FROM a x WHERE x.n > a.n) + 1 AS INTEGER) AS category_rank,
  b.n AS currency_frequency, b.n / (SELECT COUNT(*) FROM tx) AS currency_frequency_norm, CAST((SELECT COUNT(DISTINCT n) FROM b x WHERE x.n > b.n) + 1 AS INTEGER) AS currency_rank
FROM tx JOIN a USING (category) JOIN b USING (currency)
""")
def fea_13(t):
    return ft.frequency_encoding(t.tx_slim.select("transaction_id", "category", "currency"), ["category", "currency"]).drop("category", "currency")


cte("folded", """
SELECT *, CAST(('0x' || substr(md5(transaction_id), 1, 8)) AS BIGINT) % 5 AS fold, CAST(is_fraud AS DOUBLE) AS y FROM tx
""")


@query("FEA-14", uses="tx folded", rounded="merchant_id_target_encoded", sql="""
SELECT transaction_id, COALESCE((SUM(y) OVER (PARTITION BY merchant_id) - SUM(y) OVER (PARTITION BY merchant_id, fold))
  / NULLIF(COUNT(*) OVER (PARTITION BY merchant_id) - COUNT(*) OVER (PARTITION BY merchant_id, fold), 0), AVG(y) OVER ()) AS merchant_id_target_encoded FROM folded
""")
def fea_14(t):
    return ft.target_encoding(t.tx_merchant.select("transaction_id", "merchant_id", "is_fraud"), ["merchant_id"]).select(
        "transaction_id", "merchant_id_target_encoded"
    )


@query("FEA-15", uses="tx", places=4, sql="""
SELECT transaction_id, a * s AS amount_x_fraud_score, a / (s + 1e-8) AS amount_div_fraud_score, a - s AS amount_diff_fraud_score, a / (a + s + 1e-8) AS amount_ratio_fraud_score,
  a * p AS amount_x_processing_time_ms, a / (p + 1e-8) AS amount_div_processing_time_ms, a - p AS amount_diff_processing_time_ms, a / (a + p + 1e-8) AS amount_ratio_processing_time_ms,
  s * p AS fraud_score_x_processing_time_ms, s / (p + 1e-8) AS fraud_score_div_processing_time_ms, s - p AS fraud_score_diff_processing_time_ms, s / (s + p + 1e-8) AS fraud_score_ratio_processing_time_ms
FROM (SELECT transaction_id, amount AS a, GREATEST(fraud_score, 0.001e0) AS s, processing_time_ms AS p FROM tx)
""", rounded="amount_x_fraud_score amount_div_fraud_score amount_diff_fraud_score amount_ratio_fraud_score amount_x_processing_time_ms amount_div_processing_time_ms "
       "amount_diff_processing_time_ms amount_ratio_processing_time_ms fraud_score_x_processing_time_ms fraud_score_div_processing_time_ms fraud_score_diff_processing_time_ms "
       "fraud_score_ratio_processing_time_ms")
def fea_15(t):
    base = t.tx_slim.select(
        "transaction_id", "amount", F.greatest("fraud_score", F.lit(0.001)).alias("fraud_score"), "processing_time_ms"
    )
    return ft.interactions(base, ["amount", "fraud_score", "processing_time_ms"]).drop("amount", "fraud_score", "processing_time_ms")


@query("FEA-20", uses="tx merchants folded", places=4, rounded="amount_log hour_sin user_amount_30d category_target_encoded category_frequency_norm amount_vs_category_avg amount_ratio_user_amount_30d", sql=f"""
SELECT transaction_id, CAST(hour(ts) AS INTEGER) AS hour, sin(hour(ts) * 2e0 * pi() / 24e0) AS hour_sin, ln(1 + amount) AS amount_log, c30 AS user_tx_count_30d, a30 AS user_amount_30d, m24 AS merchant_tx_count_24h,
  COUNT(*) OVER (PARTITION BY category) / COUNT(*) OVER () AS category_frequency_norm,
  (SUM(y) OVER (PARTITION BY category) - SUM(y) OVER (PARTITION BY category, fold)) / (COUNT(*) OVER (PARTITION BY category) - COUNT(*) OVER (PARTITION BY category, fold)) AS category_target_encoded,
  amount / AVG(amount) OVER (PARTITION BY category) AS amount_vs_category_avg, amount / (amount + a30 + 1e-8) AS amount_ratio_user_amount_30d
FROM (SELECT *, {_before(2592000, 'COUNT(*)')} AS c30, COALESCE({_before(2592000, 'SUM(amount)')}, 0) AS a30, {_before(86400, 'COUNT(*)', 'merchant_id')} AS m24 FROM folded)
""")
def fea_20(t):
    return ft.all_features(t.tx, t.merchants).select(
        "transaction_id", "hour", "hour_sin", "amount_log", "user_tx_count_30d", "user_amount_30d", "merchant_tx_count_24h",
        "category_frequency_norm", "category_target_encoded", "amount_vs_category_avg", "amount_ratio_user_amount_30d",
    )
