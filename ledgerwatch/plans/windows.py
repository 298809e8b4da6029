"""Window queries."""

from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.operators import windows as wn
from ledgerwatch.plans.registry import query

BY_USER = "PARTITION BY user_id ORDER BY ts, transaction_id"


def rng(seconds: int, low: int = 1) -> str:
    return f"(PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {seconds * 1000000 - low} PRECEDING AND CURRENT ROW)"


@query("WIN-1", uses="tx", rounded="latitude longitude prev_lat prev_lon hours_diff distance_approx velocity", sql=f"""
SELECT transaction_id, user_id, latitude, longitude, prev_lat, prev_lon, hours_diff, d AS distance_approx, d / hours_diff AS velocity FROM (
 SELECT *, abs(latitude - prev_lat) + abs(longitude - prev_lon) AS d FROM (
  SELECT *, LAG(latitude) OVER w AS prev_lat, LAG(longitude) OVER w AS prev_lon, (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 3.6e9 AS hours_diff
  FROM tx WINDOW w AS ({BY_USER})))
WHERE hours_diff < 240 AND d > 0.5e0 AND d / NULLIF(hours_diff, 0) > 0.01e0
""")
def win_1(t):
    return wn.impossible_travel(t.tx_place, None, 0.5, 240, 0.01, None)


@query("WIN-2", uses="tx", rounded="time_diff_prev time_diff_next", sql=f"""
SELECT transaction_id, (epoch_us(ts) - epoch_us(LAG(ts) OVER w)) / 1e6 AS time_diff_prev, (epoch_us(LEAD(ts) OVER w) - epoch_us(ts)) / 1e6 AS time_diff_next
FROM tx WINDOW w AS ({BY_USER})
""")
def win_2(t):
    return wn.gaps(t.tx_slim).select("transaction_id", "time_diff_prev", "time_diff_next")


@query("WIN-3", uses="ev", rounded=" ".join(f"tx_velocity_{s}" for s in wn.SPANS), sql=f"""
SELECT transaction_id, {", ".join(f"COUNT(*) OVER {rng(w)} AS tx_count_{s}, COUNT(*) OVER {rng(w)} / {w}e0 * 3600 AS tx_velocity_{s}" for s, w in wn.SPANS.items())} FROM ev
""")
def win_3(t):
    names = [f"tx_{k}_{s}" for s in wn.SPANS for k in ("count", "velocity")]
    return wn.trailing_counts(t.ev.select("transaction_id", "user_id", "ts")).select("transaction_id", *names)


W4 = {s: wn.SPANS[s] for s in ("1h", "6h", "1d")}


@query("WIN-4", uses="ev", places=4, rounded=" ".join(f"amount_sum_{s} amount_velocity_{s}" for s in W4), sql=f"""
SELECT transaction_id, {", ".join(f"SUM(amount) OVER {rng(w)} AS amount_sum_{s}, SUM(amount) OVER {rng(w)} / {w}e0 * 3600 AS amount_velocity_{s}" for s, w in W4.items())} FROM ev
""")
def win_4(t):
    names = [f"amount_{k}_{s}" for s in W4 for k in ("sum", "velocity")]
    return wn.trailing_amounts(t.ev.select("transaction_id", "user_id", "ts", "amount")).select("transaction_id", *names)


@query("WIN-5", uses="ev", sql=f"""
SELECT transaction_id, flag AS is_rapid_fire, CASE WHEN ROW_NUMBER() OVER w >= 10 THEN CAST(SUM(flag) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) END AS rapid_fire_count
FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER ({BY_USER})) < 21600000000 THEN 1 ELSE 0 END AS flag FROM ev)
WINDOW w AS ({BY_USER})
""".replace("(w ROWS", f"({BY_USER} ROWS"))
def win_5(t):
    return wn.rapid_fire_rows(t.ev.select("transaction_id", "user_id", "ts"), max_gap=21600).select(
        "transaction_id", "is_rapid_fire", "rapid_fire_count"
    )


def _roll(n: int) -> str:
    f = f"({BY_USER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    stats = {
        "mean": f"AVG(amount) OVER {f}", "std": f"STDDEV_SAMP(amount) OVER {f}", "min": f"MIN(amount) OVER {f}", "max": f"MAX(amount) OVER {f}",
        "median": f"quantile_cont(amount, 0.5) OVER {f}", "q25": f"quantile_cont(amount, 0.25) OVER {f}", "q75": f"quantile_cont(amount, 0.75) OVER {f}",
        "deviation": f"(amount - AVG(amount) OVER {f}) / (STDDEV_SAMP(amount) OVER {f} + 1e-8)",
    }
    return ", ".join(f"CASE WHEN rn >= {n} THEN {c} END AS rolling_{s}_{n}" for s, c in stats.items())


STATS = ("mean", "std", "min", "max", "median", "q25", "q75", "deviation")


@query("WIN-6", uses="ev", places=4, rounded=" ".join(f"rolling_{s}_{n}" for n in (5, 10, 20, 50) for s in STATS), sql=f"""
SELECT transaction_id, {", ".join(_roll(n) for n in (5, 10, 20, 50))} FROM (SELECT *, ROW_NUMBER() OVER ({BY_USER}) AS rn FROM ev)
""")
def win_6(t):
    return wn.rolling_statistics(t.ev.select("transaction_id", "user_id", "ts", "amount")).drop("user_id", "ts", "amount")


def _ema(a: float) -> str:
    q = f"{1 - a}e0"
    return f"list_sum(list_transform(range(rn), lambda i: hist[rn - i] * pow({q}, i))) / list_sum(list_transform(range(rn), lambda i: pow({q}, i)))"


@query("WIN-7", uses="ev", places=4, rounded="ema_0_1 ema_0_3 ema_0_5 ema_deviation_0_1 ema_deviation_0_3 ema_deviation_0_5", sql=f"""
SELECT transaction_id, ema_0_1, ema_0_3, ema_0_5, (amount - ema_0_1) / ema_0_1 AS ema_deviation_0_1, (amount - ema_0_3) / ema_0_3 AS ema_deviation_0_3,
  (amount - ema_0_5) / ema_0_5 AS ema_deviation_0_5 FROM (
 SELECT transaction_id, amount, {_ema(0.1)} AS ema_0_1, {_ema(0.3)} AS ema_0_3, {_ema(0.5)} AS ema_0_5
 FROM (SELECT *, ROW_NUMBER() OVER ({BY_USER}) AS rn, list(amount) OVER ({BY_USER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hist FROM ev))
""")
def win_7(t):
    return wn.moving_averages(t.ev.select("transaction_id", "user_id", "ts", "amount")).drop("user_id", "ts", "amount")


@query("WIN-8", uses="ev", places=4, rounded="trend_5 trend_10", sql=f"""
SELECT transaction_id, CASE WHEN rn >= 5 THEN regr_slope(amount, rn) OVER ({BY_USER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS trend_5,
  CASE WHEN rn >= 10 THEN regr_slope(amount, rn) OVER ({BY_USER} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS trend_10
FROM (SELECT *, ROW_NUMBER() OVER ({BY_USER}) AS rn FROM ev)
""")
def win_8(t):
    return wn.rolling_slopes(t.ev.select("transaction_id", "user_id", "ts", "amount")).select("transaction_id", "trend_5", "trend_10")


@query("WIN-9", uses="tx", sql="""
SELECT merchant_id, frequency, CAST(DENSE_RANK() OVER (ORDER BY frequency DESC) AS INTEGER) AS rank FROM (SELECT merchant_id, COUNT(*) AS frequency FROM tx GROUP BY 1)
""")
def win_9(t):
    return wn.frequency_ranks(t.tx_merchant, "merchant_id")


@query("WIN-10", uses="ev", rounded="amount_percentile", sql=f"""
SELECT transaction_id, CASE WHEN len(h) > 1 THEN (len(list_filter(h, lambda x: x < amount)) + (len(list_filter(h, lambda x: x = amount)) + 1) / 2) / len(h) ELSE 0.5e0 END AS amount_percentile
FROM (SELECT transaction_id, amount, list_transform(list_filter(list({{'u': epoch_us(ts), 'v': amount}}) OVER ({BY_USER} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW),
   lambda p: p.u > epoch_us(ts) - 604800000000), lambda p: p.v) AS h FROM ev)
""")
def win_10(t):
    return wn.percent_rank(t.ev.select("transaction_id", "user_id", "ts", "amount"), seconds=604_800).select(
        "transaction_id", "amount_percentile"
    )


@query("WIN-11", uses="tx", rounded="fraud_score", sql="""
SELECT * FROM (SELECT merchant_id, transaction_id, fraud_score, CAST(ROW_NUMBER() OVER (PARTITION BY merchant_id ORDER BY fraud_score DESC, transaction_id) AS INTEGER) AS place FROM tx)
WHERE place <= 3
""")
def win_11(t):
    return tl.top_rows(
        t.tx_merchant.select("merchant_id", "transaction_id", "fraud_score"), "merchant_id",
        [F.desc("fraud_score"), F.col("transaction_id")], 3, F.col("transaction_id"), rank="place",
    )


@query("WIN-12", uses="ev", sql="""
SELECT transaction_id, channel, n AS current_count, n < 3 AS allowed, GREATEST(3 - n - 1, 0) AS remaining FROM (
 SELECT transaction_id, channel, COUNT(*) OVER (PARTITION BY channel ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS n FROM ev)
""")
def win_12(t):
    return wn.sliding_limit(t.ev.select("transaction_id", "channel", "ts"), "channel", 3, 3600).select(
        "transaction_id", "channel", "current_count", "allowed", "remaining"
    )


@query("WIN-13")
def win_13(t):
    """Token and leaky bucket replays side by side (a stateful replay: no SQL twin, see tests)."""
    log = t.ev.select("transaction_id", "channel", "ts")
    token = wn.bucket_limit(log, "channel", per_minute=0.05, burst=3.0, kind="token")
    leaky = wn.bucket_limit(log, "channel", per_minute=0.05, burst=3.0, kind="leaky")
    return token.withColumn("kind", F.lit("token")).unionByName(leaky.withColumn("kind", F.lit("leaky")))
