"""Feature engineering: each function adds columns to a table of transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import (
    contains_any,
    flag,
    geohash,
    haversine_km,
    micros,
    safe_ratio,
    weekday_monday0,
)
from ledgerwatch.operators import windows as wn

SECOND = 1_000_000
EPS = 1e-8


# ---- calendar -------------------------------------------------------------------------------

def calendar(df: DataFrame, ts: str = "ts") -> DataFrame:
    hour, day, dow = F.hour(ts), F.dayofmonth(ts), weekday_monday0(ts)
    return df.withColumns(
        {
            "hour": hour, "day_of_week": dow, "day_of_month": day, "month": F.month(ts), "quarter": F.quarter(ts),
            "year": F.year(ts), "is_weekend": flag(dow >= 5), "is_month_start": flag(day <= 3),
            "is_month_end": flag(day >= 28), "is_business_hour": flag(hour.between(9, 17)),
            "is_night": flag((hour >= 22) | (hour <= 6)), "is_night_time": flag((hour < 6) | (hour > 22)),
            "is_lunch_time": flag(hour.between(11, 14)),
        }
    )


def cyclical(df: DataFrame, ts: str = "ts") -> DataFrame:
    def turn(value: Column, period: float):
        angle = value * F.lit(2.0) * F.pi() / F.lit(period)
        return F.sin(angle), F.cos(angle)

    out = {}
    for name, value, period in (("hour", F.hour(ts), 24.0), ("dow", weekday_monday0(ts), 7.0), ("month", F.month(ts), 12.0)):
        out[f"{name}_sin"], out[f"{name}_cos"] = turn(value, period)
    return df.withColumns(out)


def elapsed(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {
            "days_since_epoch": F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")),
            "seconds_since_midnight": F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts),
        }
    )


# ---- history of a user ----------------------------------------------------------------------

# The velocity windows, in seconds.
VELOCITY = {"1h": 3_600, "6h": 21_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}


def velocity(df: DataFrame, spans: dict[str, int] = VELOCITY, row_id: str = "transaction_id", hot_rows=tl.HOT_ROWS):
    """Count and amount of the user's transactions before the current one."""
    frames = {s: (-w * SECOND, -1) for s, w in spans.items()}
    return tl.trailing_sums(
        df, "user_id", micros("ts"), row_id, frames, {"user_tx_count": F.lit(1), "user_amount": F.col("amount")}, hot_rows
    )


def recent_profile(df: DataFrame, rows: int = 100, seconds: int = 2_592_000, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Mean, sample deviation, median, z-score and IQR outlier over the user's recent history."""
    h = F.sort_array("history")
    n = F.size("history")
    base = wn.recent_history(df, rows=rows, seconds=seconds, hot_rows=hot_rows).withColumn("history", h)
    mean = F.aggregate("history", F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate("history", F.lit(0.0), lambda a, x: a + (x - F.col("user_avg_amount")) * (x - F.col("user_avg_amount")))
    q1, q3 = wn.array_quantile(F.col("history"), 0.25), wn.array_quantile(F.col("history"), 0.75)
    amount = F.col("amount")
    with_mean = base.withColumn("user_avg_amount", mean)
    with_std = with_mean.withColumns(
        {
            "user_std_amount": F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(0.0),
            "user_median_amount": wn.array_quantile(F.col("history"), 0.5),
            "_low": q1 - (q3 - q1) * 1.5,
            "_high": q3 + (q3 - q1) * 1.5,
        }
    )
    return with_std.withColumns(
        {
            "amount_zscore": safe_ratio(amount - F.col("user_avg_amount"), F.col("user_std_amount")),
            "is_amount_outlier": (amount < F.col("_low")) | (amount > F.col("_high")),
        }
    ).drop("history", "_low", "_high")


def lifetime_profile(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Statistics of all of a user's rows merged back, with deviation and diversity."""
    stats = df.groupBy(user).agg(
        F.count("amount").alias("amount_count"), F.sum("amount").alias("amount_sum"), F.avg("amount").alias("amount_mean"),
        F.stddev_samp("amount").alias("amount_std"), F.min("amount").alias("amount_min"), F.max("amount").alias("amount_max"),
        F.count_distinct("merchant_id").alias("merchant_nunique"), F.count_distinct("category").alias("category_nunique"),
    )
    medians = tl.exact_quantiles(df.select(user, "amount"), user, "amount", {"amount_median": 0.5})
    profile = tl.null_safe_join(stats, medians, [user])
    joined = tl.null_safe_join(df, profile, [user])
    z = (F.col("amount") - F.col("amount_mean")) / (F.col("amount_std") + EPS)
    return joined.withColumns(
        {
            "amount_zscore": z, "amount_deviation": F.abs(z), "is_amount_outlier": flag(F.abs(z) > 2),
            "merchant_diversity": F.col("merchant_nunique") / F.col("amount_count"),
            "category_diversity": F.col("category_nunique") / F.col("amount_count"),
        }
    )


# Category words with high risk.
RISKY_CATEGORY_WORDS = ["gambling", "crypto", "adult", "forex"]


def merchant_features(
    df: DataFrame, merchants: DataFrame, spans: dict[str, int] | None = None, row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Merchant risk, fraud rate over 7 and 30 days, counts over 1 and 24 hours, all before the current row."""
    spans = spans or {"1h": 3_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}
    frames = {s: (-w * SECOND, -1) for s, w in spans.items()}
    traced = tl.trailing_sums(
        df, "merchant_id", micros("ts"), row_id, frames,
        {"merchant_tx_count": F.lit(1), "_fraud": F.when(F.col("is_fraud"), 1).otherwise(0)}, hot_rows,
    )
    rated = traced.withColumns(
        {
            f"merchant_fraud_rate_{s}": safe_ratio(F.col(f"_fraud_{s}"), F.col(f"merchant_tx_count_{s}"))
            for s in list(spans)[-2:]
        }
    ).drop(*[f"_fraud_{s}" for s in spans])
    return rated.join(
        merchants.select("merchant_id", F.col("merchant_risk").alias("merchant_risk_score")), "merchant_id", "left"
    ).withColumn("is_high_risk_category", contains_any(F.lower("category"), RISKY_CATEGORY_WORDS))


def transaction_features(df: DataFrame) -> DataFrame:
    a, c = F.col("amount"), F.coalesce(F.col("currency"), F.lit("USD"))
    out = {
        "amount_log": F.log1p(a), "amount_sqrt": F.sqrt(a),
        "is_micro_transaction": flag(a < 1), "is_small_transaction": flag((a >= 1) & (a < 50)),
        "is_medium_transaction": flag((a >= 50) & (a < 500)), "is_large_transaction": flag((a >= 500) & (a < 5000)),
        "is_very_large_transaction": flag(a >= 5000), "is_usd": flag(c == "USD"), "is_eur": flag(c == "EUR"),
        "is_exotic_currency": flag(~c.isin("USD", "EUR", "GBP", "JPY")),
    }
    if "latitude" in df.columns:
        lat, lon = F.col("latitude"), F.col("longitude")
        known = lat.isNotNull() & lon.isNotNull()
        out |= {
            "has_location": flag(known), "distance_from_equator": F.when(known, F.abs(lat)).otherwise(0.0),
            "is_unusual_location": flag(known & ((F.abs(lat) > 60) | (F.abs(lon) > 150))),
        }
    return df.withColumns(out)


def rate_features(df: DataFrame, span: str = "24h", hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Rates per hour, time since the last transaction, diversity ratios and spending consistency."""
    hours = VELOCITY[span] / 3600.0
    hot = hot_rows if isinstance(hot_rows, tl.HotKeys) else tl.HotKeys(df, "user_id", hot_rows=hot_rows)
    traced = hot.settle(velocity(df, {span: VELOCITY[span], "7d": VELOCITY["7d"]}, hot_rows=hot))
    linked = wn.gaps(traced, hot_rows=hot).drop("time_diff_next").withColumnRenamed("time_diff_prev", "time_since_last_tx")
    week = VELOCITY["7d"] * SECOND
    merchants = tl.distinct_trailing(
        hot.settle(linked), "user_id", "merchant_id", micros("ts"), "transaction_id", week, "user_merchant_count_7d", hot
    )
    stats = df.groupBy("user_id").agg(F.avg("amount").alias("_mean"), F.stddev_pop("amount").alias("_std"))
    joined = merchants.join(stats, "user_id", "left")
    return joined.withColumns(
        {
            f"tx_velocity_{span}": F.col(f"user_tx_count_{span}") / hours,
            f"amount_velocity_{span}": F.col(f"user_amount_{span}") / hours,
            "is_rapid_fire": flag(F.col("time_since_last_tx") < 60),
            "merchant_diversity_7d": F.col("user_merchant_count_7d") / F.greatest(F.lit(1), F.col("user_tx_count_7d")),
            "spending_consistency": 1.0 / (1.0 + F.col("_std") / F.greatest(F.lit(1.0), F.col("_mean"))),
        }
    ).drop("_mean", "_std")


# Risk per country code; other countries score 0.5.
COUNTRY_RISK = {
    "US": 0.1, "GB": 0.1, "CA": 0.1, "AU": 0.1, "DE": 0.1, "FR": 0.15, "IT": 0.2, "ES": 0.2, "BR": 0.3, "IN": 0.25,
    "CN": 0.4, "RU": 0.6, "NG": 0.7, "UNKNOWN": 0.8,
}


def country_risk(country: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in COUNTRY_RISK.items() for x in pair])
    return F.coalesce(F.get(F.map_values(F.map_filter(known, lambda k, v: k == F.coalesce(country, F.lit("UNKNOWN")))), F.lit(0)), F.lit(0.5))


def geographic_features(df: DataFrame, country: str = "country") -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    return df.withColumns(
        {
            "country_risk_score": country_risk(F.col(country)),
            "is_unusual_location": F.coalesce((F.abs(lat) > 60) | (F.abs(lon) > 150), F.lit(False)),
        }
    )


def home_locations(df: DataFrame, places: int = 3) -> DataFrame:
    """The most visited rounded place of each user (ties: the smallest coordinates)."""
    spots = df.groupBy(
        "user_id", F.round("latitude", places).alias("home_lat"), F.round("longitude", places).alias("home_lon")
    ).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.struct("home_lat", "home_lon"), F.struct(-F.col("_n"), F.col("home_lat"), F.col("home_lon")))
    return spots.groupBy("user_id").agg(best.alias("_h")).select("user_id", "_h.home_lat", "_h.home_lon")


def location_entropy(df: DataFrame, cell: Column) -> DataFrame:
    """Entropy (bits) of each user's visits over places."""
    counts = df.groupBy("user_id", cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n")
    return counts.groupBy("user_id").agg(
        (F.log2(n) - F.sum(F.col("_n") * F.log2("_n")) / n).alias("location_entropy")
    )


def distance_features(df: DataFrame, hot_rows=tl.HOT_ROWS, precision: int = 5) -> DataFrame:
    """Distance from home and from the previous transaction, and the user's location entropy."""
    linked = tl.neighbours(
        df.withColumn("_us", micros("ts")), "user_id", ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"_plat": F.col("latitude"), "_plon": F.col("longitude")}, hot_rows=hot_rows,
    )
    per_user = home_locations(df).join(location_entropy(df, geohash("latitude", "longitude", precision)), "user_id")
    return linked.join(per_user, "user_id", "left").withColumns(
        {
            "distance_from_home": haversine_km("home_lat", "home_lon", "latitude", "longitude"),
            "distance_from_last_tx": F.coalesce(haversine_km("_plat", "_plon", "latitude", "longitude"), F.lit(0.0)),
        }
    ).drop("_us", "_plat", "_plon", "home_lat", "home_lon")


def context_features(df: DataFrame) -> DataFrame:
    """Category rates, first use of a merchant or device, users per device, country against the device's usual one."""
    order = F.struct("ts", "transaction_id")
    category = df.groupBy("category").agg(
        F.avg(F.col("is_fraud").cast("double")).alias("category_fraud_rate"), F.avg("amount").alias("category_avg_amount")
    )
    first_merchant = df.groupBy("user_id", "merchant_id").agg(F.min_by("transaction_id", order).alias("_fm"))
    first_device = df.groupBy("user_id", "device_id").agg(F.min_by("transaction_id", order).alias("_fd"))
    shared = df.groupBy("device_id").agg(F.count_distinct("user_id").alias("shared_device_count"))
    usual = df.groupBy("device_id", "country").agg(F.count(F.lit(1)).alias("_n")).groupBy("device_id").agg(
        F.min_by("country", F.struct(-F.col("_n"), F.col("country"))).alias("device_country")
    )
    return (
        df.join(category, "category", "left")
        .join(first_merchant, ["user_id", "merchant_id"], "left")
        .join(first_device, ["user_id", "device_id"], "left")
        .join(shared.join(usual, "device_id"), "device_id", "left")
        .withColumns(
            {
                "amount_vs_category_avg": safe_ratio(F.col("amount"), F.col("category_avg_amount")),
                "is_new_merchant": F.col("_fm") == F.col("transaction_id"),
                "is_new_device": F.col("_fd") == F.col("transaction_id"),
                "country_mismatch": F.col("country") != F.col("device_country"),
            }
        )
        .drop("_fm", "_fd", "device_country")
    )


# ---- encodings ------------------------------------------------------------------------------

def frequency_encoding(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequency, share of all rows and dense rank of each categorical value."""
    total = df.select(F.count(F.lit(1))).scalar()
    out = df
    for c in columns:
        codes = wn.frequency_ranks(df, c).select(
            c, F.col("frequency").alias(f"{c}_frequency"), F.col("rank").alias(f"{c}_rank")
        )
        out = out.join(codes, c, "left").withColumn(f"{c}_frequency_norm", F.col(f"{c}_frequency") / total)
    return out


def fold_of(row_id: str, folds: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds))


def target_encoding(
    df: DataFrame, columns: Sequence[str], target: str = "is_fraud", folds: int = 5, row_id: str = "transaction_id"
) -> DataFrame:
    """Out-of-fold target mean per category; the global mean where a category has no other fold."""
    y = F.col(target).cast("double")
    out = df.withColumn("_fold", fold_of(row_id, folds))
    overall = df.select(F.avg(y)).scalar()
    for c in columns:
        by_fold = out.groupBy(c, "_fold").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
        whole = by_fold.groupBy(c).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
        codes = tl.null_safe_join(by_fold, whole, [c]).select(
            c, "_fold",
            F.when(F.col("_tn") > F.col("_n"), (F.col("_ts") - F.col("_s")) / (F.col("_tn") - F.col("_n"))).alias(f"{c}_target_encoded"),
        )
        out = tl.null_safe_join(out, codes, [c, "_fold"]).withColumn(
            f"{c}_target_encoded", F.coalesce(F.col(f"{c}_target_encoded"), overall)
        )
    return out.drop("_fold")


def interactions(df: DataFrame, columns: Sequence[str], max_interactions: int = 20) -> DataFrame:
    """Product, quotient, difference and ratio of column pairs, up to ``max_interactions`` new columns."""
    out = {}
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            if len(out) >= max_interactions:
                return df.withColumns(out)
            x, y = F.col(a), F.col(b)
            out |= {
                f"{a}_x_{b}": x * y, f"{a}_div_{b}": x / (y + EPS), f"{a}_diff_{b}": x - y,
                f"{a}_ratio_{b}": x / (x + y + EPS),
            }
    return df.withColumns(out)


def all_features(df: DataFrame, merchants: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Every feature group in sequence; the hot users and merchants are looked up once."""
    hot = tl.HotKeys(df, "user_id", "merchant_id", hot_rows=hot_rows)
    traced = hot.settle(velocity(df, hot_rows=hot))
    priced = hot.settle(merchant_features(traced, merchants, hot_rows=hot))
    return (
        priced.transform(context_features)
        .transform(lambda d: frequency_encoding(d, ["category"]))
        .transform(lambda d: target_encoding(d, ["category"]))
        .transform(calendar)
        .transform(cyclical)
        .transform(elapsed)
        .transform(transaction_features)
        .transform(geographic_features)
        .transform(lambda d: interactions(d, ["amount", "user_tx_count_30d", "user_amount_30d"]))
    )
