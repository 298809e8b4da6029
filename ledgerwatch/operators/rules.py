"""Rule scoring and decisions: one set of column expressions over a table of transactions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import (
    clamp,
    contains_any,
    content_key,
    haversine_km,
    micros,
    present,
    safe_ratio,
    weekday_monday0,
)

# The batch rule set.
SUSPICIOUS_MERCHANTS = [
    "gambling", "casino", "crypto", "bitcoin", "darkweb", "suspicious", "unknown", "offshore", "adult", "cash",
]
SUSPICIOUS_CATEGORIES = ["gambling", "adult", "crypto", "cash_advance", "atm", "casino"]
USUAL_CURRENCIES = ["USD", "EUR", "GBP"]
API_MERCHANT_WORDS = ["gambling", "crypto", "forex", "adult"]

RISK_ORDER = ["MINIMAL", "LOW", "MEDIUM", "HIGH", "CRITICAL"]


def ladder(score: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first step whose threshold the score reaches (steps from high to low)."""
    result = F
    for threshold, label in steps:
        result = result.when(score >= threshold, F.lit(label))
    return result.otherwise(F.lit(otherwise))


def points(cases: list[tuple[Column, float]]) -> Column:
    """Points of the first matching case, else zero."""
    result = F
    for condition, value in cases:
        result = result.when(condition, F.lit(float(value)))
    return result.otherwise(F.lit(0.0))


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


# ---- levels and decisions -------------------------------------------------------------------

def risk_level(score: Column) -> Column:
    return ladder(score, [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.2, "LOW")], "MINIMAL")


def risk_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), level)


def batch_decision(score: Column) -> Column:
    return ladder(score, [(0.6, "DECLINED"), (0.35, "REVIEW")], "APPROVED")


def api_decision(score: Column) -> Column:
    return ladder(score, [(0.8, "DECLINED"), (0.4, "REVIEW")], "APPROVED")


def stream_level(score: Column) -> Column:
    return ladder(score, [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM")], "LOW")


def stream_decision(score: Column) -> Column:
    return ladder(score, [(0.8, "DECLINED"), (0.6, "REVIEW")], "APPROVED")


def with_level_and_decision(df: DataFrame, score: str = "fraud_score") -> DataFrame:
    return df.withColumns({"risk_level": risk_level(F.col(score)), "decision": batch_decision(F.col(score))})


# ---- batch rule score -----------------------------------------------------------------------

def _batch_rules(df: DataFrame) -> list[tuple[Column, float, str]]:
    amount = F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0))
    hour = F.hour("ts")
    rules = [
        (amount > 5000, 0.5, "very_high_amount"),
        ((amount > 1000) & (amount <= 5000), 0.35, "high_amount"),
        (amount < 1, 0.4, "micro_transaction"),
        (contains_any(F.lower(F.col("merchant_id").cast("string")), SUSPICIOUS_MERCHANTS), 0.35, "suspicious_merchant"),
        (F.lower("category").isin(SUSPICIOUS_CATEGORIES), 0.3, "suspicious_category"),
        ((hour >= 23) | (hour <= 6), 0.2, "unusual_hour"),
        (~F.upper(F.coalesce(F.col("currency"), F.lit("USD"))).isin(USUAL_CURRENCIES), 0.15, "unusual_currency"),
        (contains_any(F.lower(F.col("user_id").cast("string")), ["test", "fake"]), 0.3, "suspicious_user_pattern"),
    ]
    if "latitude" in df.columns:
        rules.append(((F.abs("latitude") > 80) | (F.abs("longitude") > 180), 0.2, "invalid_location"))
    return rules


def score_batch(df: DataFrame) -> DataFrame:
    """Rule score, factors, risk level and batch decision of every transaction."""
    rules = _batch_rules(df)
    score = clamp(total([points([(c, w)]) for c, w, _ in rules]))
    return with_level_and_decision(
        df.withColumns({"fraud_score": score, "risk_factors": present(*[(c, label) for c, _, label in rules])})
    )


# ---- temporal and amount patterns -----------------------------------------------------------

def off_hours(ts: str = "ts") -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) > 22)


def temporal_pattern(ts: str = "ts") -> Column:
    unusual = off_hours(ts)
    weekend = weekday_monday0(ts) >= 5
    return F.struct(
        unusual.alias("unusual_hour"),
        points([(unusual, 0.3)]).alias("pattern_score"),
        F.filter(
            F.array(
                F.when(unusual, F.concat(F.lit("night-time, hour "), F.hour(ts))),
                F.when(weekend, F.lit("made on a weekend")),
            ),
            lambda d: d.isNotNull(),
        ).alias("details"),
    )


def amount_pattern(amount: str = "amount") -> Column:
    a = F.col(amount)
    return F.struct(
        F.coalesce(a > 5000, F.lit(False)).alias("high_value_risk"),
        points([(a > 10000, 0.4), (a > 5000, 0.2), (a < 1, 0.1)]).alias("amount_score"),
        F.when(a > 10000, "amount above 10000")
        .when(a > 5000, "amount above 5000")
        .when(a < 1, "amount below 1")
        .alias("detail"),
    )


def score_composite(df: DataFrame, model_score: str = "fraud_score", merchant_text: str = "merchant_id") -> DataFrame:
    """Model score plus temporal, amount, merchant and place rules, capped at 1, with advice per level."""
    a = F.col("amount")
    unusual, high = off_hours(), F.coalesce(a > 5000, F.lit(False))
    big = F.coalesce(a > 10000, F.lit(False))
    merchant = contains_any(F.lower(F.col(merchant_text).cast("string")), API_MERCHANT_WORDS)
    located = (F.col("latitude") != 0) & (F.col("longitude") != 0)
    far = F.coalesce(located & ((F.abs("latitude") > 60) | (F.abs("longitude") > 150)), F.lit(False))
    raw = total(
        [
            F.coalesce(F.col(model_score), F.lit(0.0)),
            points([(unusual, 0.3)]),
            points([(a > 10000, 0.4), (a > 5000, 0.2), (a < 1, 0.1)]),
            points([(big, 0.3)]),
            points([(merchant, 0.25)]),
            points([(far, 0.15)]),
        ]
    )
    scored = df.withColumn("composite_score", F.least(raw, F.lit(1.0)))
    level = risk_level(F.col("composite_score"))
    advice = present(
        (unusual, "ask why it was made at night"),
        (high, "check the sum with the payer"),
        (big, "hand over to an analyst: large sum"),
        (merchant, "look into the merchant"),
        (far, "ask where the payer is"),
    )
    default = (
        F.when(level == "MINIMAL", "let it pass")
        .when(level == "LOW", "keep an eye on the account")
        .when(level == "MEDIUM", "read through the entry")
        .when(level == "HIGH", "call the payer")
        .otherwise("stop it and open a case")
    )
    return scored.withColumns(
        {
            "composite_level": level,
            "composite_decision": api_decision(F.col("composite_score")),
            "composite_factors": present(
                (unusual, "unusual_transaction_hour"),
                (high, "high_transaction_amount"),
                (big, "very_high_amount"),
                (merchant, "suspicious_merchant_category"),
                (far, "unusual_location"),
            ),
            "recommendations": F.when(F.size(advice) > 0, advice).otherwise(F.array(default)),
        }
    )


def ensemble_advice(level: Column, confidence: Column) -> Column:
    """Recommended actions for an ensemble result."""
    base = (
        F.when(
            level == "CRITICAL",
            F.array(*map(F.lit, ["stop the payment now", "call the payer",
                                 "go through the payer's recent entries"])),
        )
        .when(
            level == "HIGH",
            F.array(*map(F.lit, ["hand over to an analyst", "ask the payer whether it is theirs",
                                 "compare with the payer's last weeks"])),
        )
        .when(
            level == "MEDIUM",
            F.array(*map(F.lit, ["watch what follows", "open a case if it happens again"])),
        )
        .otherwise(F.array(F.lit("let it pass")))
    )
    extra = F.array(F.lit("the models are unsure: gather more evidence"))
    return F.when(confidence < 0.6, F.concat(base, extra)).otherwise(base)


def score_fallback(df: DataFrame) -> DataFrame:
    """Score without a model: large amount, then the temporal and amount patterns."""
    a = F.col("amount")
    raw = total(
        [
            points([(a > 10000, 0.4)]),
            points([(off_hours(), 0.3)]),
            points([(a > 10000, 0.4), (a > 5000, 0.2), (a < 1, 0.1)]),
        ]
    )
    return df.withColumns(
        {
            "fallback_score": F.least(raw, F.lit(1.0)),
            "fallback_level": risk_level(raw),
            "fallback_decision": api_decision(raw),
        }
    )


def score_with_history(
    df: DataFrame, merchants: DataFrame, days: int = 30, hot_rows=tl.HOT_ROWS
) -> DataFrame:
    """Amount, hour, amount against the user's trailing mean, and merchant risk."""
    span = days * 86_400_000_000
    traced = tl.trailing_sums(
        df, "user_id", micros("ts"), "transaction_id", {"w": (-span + 1, 0)},
        {"n": F.lit(1), "s": F.col("amount")}, hot_rows,
    )
    mean = F.col("s_w") / F.col("n_w")
    joined = traced.join(merchants.select("merchant_id", "merchant_risk"), "merchant_id", "left")
    a = F.col("amount")
    raw = total(
        [
            points([(a > 10000, 0.4), (a > 5000, 0.2)]),
            points([(off_hours(), 0.2)]),
            points([(a > mean * 3, 0.3)]),
            F.coalesce(F.col("merchant_risk") * 0.2, F.lit(0.0)),
        ]
    )
    return joined.withColumns({"user_mean": mean, "history_score": clamp(raw)}).drop("n_w", "s_w")


def stream_score(amount: Column, hour: Column, recent: Column, merchant_risk: Column, velocity_limit: int = 10) -> Column:
    return clamp(
        total(
            [
                points([(amount > 10000, 0.4), (amount > 5000, 0.2), (amount < 1, 0.3)]),
                points([((hour < 6) | (hour > 22), 0.2)]),
                points([(recent > velocity_limit, 0.3)]),
                F.coalesce(merchant_risk, F.lit(0.5)) * 0.2,
            ]
        )
    )


def score_stream_batch(
    df: DataFrame, merchants: DataFrame, velocity_limit: int = 10, window_seconds: int = 3600,
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Batch twin of the stream score: the user's count over the last hour and the merchant's risk."""
    span = window_seconds * 1_000_000
    traced = tl.trailing_sums(
        df, "user_id", micros("ts"), "transaction_id", {"recent": (-span + 1, 0)}, {"n": F.lit(1)}, hot_rows
    )
    joined = traced.join(merchants.select("merchant_id", "merchant_risk"), "merchant_id", "left")
    score = stream_score(F.col("amount"), F.hour("ts"), F.col("n_recent"), F.col("merchant_risk"), velocity_limit)
    return joined.withColumns({"stream_score": score}).withColumns(
        {"stream_level": stream_level(F.col("stream_score")), "stream_decision": stream_decision(F.col("stream_score"))}
    )


def window_risk(f: dict[str, Column]) -> Column:
    """Risk of one window from its features."""
    return F.least(
        F.lit(1.0),
        total(
            [
                points([(f["transactions_per_minute"] > 10, 0.3)]),
                points([(f["amount_per_minute"] > 10000, 0.2)]),
                points([(f["amount_deviation_ratio"] > 5, 0.2)]),
                points([(f["channel_diversity"] > 3, 0.15)]),
                points([(f["avg_time_between_events"] < 5, 0.15)]),
            ]
        ),
    )


# ---- declarative rules ----------------------------------------------------------------------

# The seeded rules (name, type, category, conditions, actions, priority).
SEED_RULES = [
    ("high_amount_rule", "THRESHOLD", "AMOUNT", '{"amount": {">=": 10000}}', '{"action": "flag", "severity": "HIGH", "require_review": true}', 100),
    ("velocity_rule", "VELOCITY", "BEHAVIORAL", '{"transactions_per_hour": {">=": 10}, "user_type": "standard"}', '{"action": "review", "severity": "MEDIUM", "delay_processing": 300}', 200),
    ("geographic_rule", "THRESHOLD", "LOCATION", '{"distance_from_home": {">=": 1000}, "time_since_last_tx": {"<": 3600}}', '{"action": "verify", "severity": "MEDIUM", "require_2fa": true}', 150),
    ("unusual_hour_rule", "THRESHOLD", "BEHAVIORAL", '{"hour": {"<": 6, ">": 22}, "amount": {">=": 1000}}', '{"action": "flag", "severity": "LOW", "additional_verification": true}', 300),
    ("new_device_rule", "THRESHOLD", "DEVICE", '{"is_new_device": true, "amount": {">=": 500}}', '{"action": "verify", "severity": "MEDIUM", "require_device_verification": true}', 250),
    ("merchant_risk_rule", "THRESHOLD", "MERCHANT", '{"merchant_risk_score": {">=": 0.7}, "amount": {">=": 100}}', '{"action": "review", "severity": "HIGH", "enhanced_monitoring": true}', 120),
]
RULE_SCHEMA = "rule_name string, rule_type string, rule_category string, conditions string, actions string, priority int, weight double, is_active boolean"
#: Rules become one expression per transaction; more of them than this are refused.
MOST_RULES = 1000


def seed_rules(spark) -> DataFrame:
    """The seeded rules as a table; every weight is 1 and every rule is active."""
    return spark.createDataFrame([(*r, 1.0, True) for r in SEED_RULES], RULE_SCHEMA)


_COMPARE = {
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
    "<=": lambda c, v: c <= v,
    "<": lambda c, v: c < v,
    "=": lambda c, v: c == v,
}


def compile_conditions(text: str) -> Column:
    """JSON conditions to a predicate: all fields must hold; a range open to both sides means either side."""
    clauses = []
    for field, wanted in json.loads(text).items():
        column = F.col(field)
        if not isinstance(wanted, dict):
            clauses.append(column == F.lit(wanted))
            continue
        tests = [_COMPARE[op](column, F.lit(v)) for op, v in wanted.items()]
        below = [v for op, v in wanted.items() if op in ("<", "<=")]
        above = [v for op, v in wanted.items() if op in (">", ">=")]
        outside = bool(below and above and max(below) <= min(above))
        clauses.append(reduce(lambda a, b: (a | b) if outside else (a & b), tests))
    return F.coalesce(reduce(lambda a, b: a & b, clauses), F.lit(False))


def rule_facts(df: DataFrame, merchants: DataFrame, users: DataFrame, hot_rows=tl.HOT_ROWS) -> DataFrame:
    """The fields the seeded rules test, derived for every transaction."""
    hour = 3_600_000_000
    hot_rows = hot_rows if isinstance(hot_rows, tl.HotKeys) else tl.HotKeys(df, "user_id", hot_rows=hot_rows)
    traced = tl.trailing_sums(
        df, "user_id", micros("ts"), "transaction_id", {"hour": (-hour + 1, 0)}, {"n": F.lit(1)}, hot_rows
    )
    linked = tl.neighbours(
        traced.withColumn("_us", micros("ts")), "user_id", ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"_before": F.col("_us")}, hot_rows=hot_rows,
    )
    # home is the place a user pays from most often (ties: the smallest); means break at the antimeridian
    visits = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).groupBy("user_id", "latitude", "longitude").agg(F.count(F.lit(1)).alias("_n"))
    homes = visits.groupBy("user_id").agg(F.min(F.struct((-F.col("_n")).alias("n"), "latitude", "longitude")).alias("_h")).select(
        "user_id", F.col("_h.latitude").alias("_hlat"), F.col("_h.longitude").alias("_hlon")
    )
    first_seen = df.groupBy("user_id", "device_id").agg(
        F.min_by("transaction_id", F.struct("ts", "transaction_id")).alias("_first")
    )
    return (
        linked.join(homes, "user_id", "left")
        .join(first_seen, ["user_id", "device_id"], "left")
        .join(merchants.select("merchant_id", F.col("merchant_risk").alias("merchant_risk_score")), "merchant_id", "left")
        .join(users.select("user_id", F.when(F.col("segment") == "BUILDING", "business").otherwise("standard").alias("user_type")), "user_id", "left")
        .withColumns(
            {
                "transactions_per_hour": F.col("n_hour"),
                "time_since_last_tx": (F.col("_us") - F.col("_before")) / 1e6,
                "distance_from_home": haversine_km("latitude", "longitude", "_hlat", "_hlon"),
                "hour": F.hour("ts"),
                "is_new_device": F.col("_first") == F.col("transaction_id"),
            }
        )
        .drop("_us", "_before", "_hlat", "_hlon", "_first", "n_hour")
    )


def apply_rules(df: DataFrame, rules: DataFrame, id_col: str = "transaction_id") -> DataFrame:
    """One row per transaction that hits a rule: the winner (lowest priority number, then name), all hits, their weight.

    ``rules`` is a table of RULE_SCHEMA. Its active rows are read first (MOST_RULES at most) and compiled into column
    expressions, so transactions are neither joined nor collected.
    """
    active = rules.filter(F.coalesce("is_active", F.lit(True))).orderBy("priority", "rule_name").limit(MOST_RULES + 1).collect()
    if len(active) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} active rules")
    nothing = F.lit(None).cast("struct<priority:int,rule_name:string,severity:string,action:string,weight:double>")

    def hit(r) -> Column:
        does = json.loads(r["actions"])
        found = F.struct(
            F.lit(r["priority"]).cast("int").alias("priority"), F.lit(r["rule_name"]).alias("rule_name"), F.lit(does.get("severity")).cast("string").alias("severity"),
            F.lit(does.get("action")).cast("string").alias("action"), F.lit(float(1.0 if r["weight"] is None else r["weight"])).alias("weight"),
        )
        return F.when(compile_conditions(r["conditions"]), found)

    hits = F.filter(F.array(nothing, *map(hit, active)), lambda h: h.isNotNull())
    first = F.get("_hits", F.lit(0))
    return (
        df.withColumn("_hits", hits)
        .filter(F.size("_hits") > 0)
        .select(
            id_col, *(first[c].alias(c) for c in ("rule_name", "severity", "priority", "action")),
            F.transform("_hits", lambda h: h["rule_name"]).alias("rules_hit"),
            F.aggregate("_hits", F.lit(0.0), lambda a, h: a + h["weight"]).alias("rule_weight"),
        )
    )


# ---- seeded patterns ------------------------------------------------------------------------

def rapid_fire(
    df: DataFrame, window_seconds: int = 300, min_count: int = 5, max_variation: float = 0.1,
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Transactions that complete a burst of similar amounts by one user."""
    span = window_seconds * 1_000_000
    traced = tl.trailing_sums(
        df, "user_id", micros("ts"), "transaction_id", {"w": (-span + 1, 0)},
        {"n": F.lit(1), "s": F.col("amount"), "q": F.col("amount") * F.col("amount")}, hot_rows,
    )
    mean = F.col("s_w") / F.col("n_w")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("q_w") / F.col("n_w") - mean * mean))
    return (
        traced.withColumns({"burst_count": F.col("n_w"), "variation": safe_ratio(spread, mean)})
        .filter((F.col("burst_count") >= min_count) & (F.col("variation") <= max_variation))
        .drop("n_w", "s_w", "q_w")
    )


def is_round(amount: Column, unit: int = 100) -> Column:
    return (amount > 0) & (F.pmod(amount, F.lit(float(unit))) == 0)


def round_amounts(df: DataFrame, unit: int = 100, min_share: float = 0.8) -> DataFrame:
    """Per user: the share of round amounts, and whether it reaches the pattern's frequency."""
    return df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if(is_round(F.col("amount"), unit)).alias("round_count"),
    ).withColumns(
        {
            "round_share": F.col("round_count") / F.col("transactions"),
            "is_pattern": F.col("round_count") / F.col("transactions") >= min_share,
        }
    )


def geographic_hopping(
    df: DataFrame, max_kmh: float = 800.0, window_seconds: int = 3600, hot_rows=tl.HOT_ROWS
) -> DataFrame:
    """Consecutive transactions of a user that imply travel faster than ``max_kmh``."""
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withColumn("_us", micros("ts"))
    linked = tl.neighbours(
        located, "user_id", ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"_plat": F.col("latitude"), "_plon": F.col("longitude"), "_pus": F.col("_us")}, hot_rows=hot_rows,
    )
    gap = (F.col("_us") - F.col("_pus")) / 1e6
    return (
        linked.withColumns({"gap_seconds": gap, "distance_km": haversine_km("_plat", "_plon", "latitude", "longitude")})
        .filter((F.col("gap_seconds") <= window_seconds) & (F.col("distance_km") * 3600 > max_kmh * F.col("gap_seconds")))
        .drop("_us", "_plat", "_plon", "_pus")
    )


def merchant_cycling(
    df: DataFrame, min_merchants: int = 10, window_seconds: int = 1800, hot_rows=tl.HOT_ROWS
) -> DataFrame:
    """Transactions at which a user has visited many distinct merchants within the window."""
    return tl.distinct_trailing(
        df, "user_id", "merchant_id", micros("ts"), "transaction_id", window_seconds * 1_000_000, "merchants", hot_rows
    ).filter(F.col("merchants") >= min_merchants)


def card_testing(
    df: DataFrame, low: float = 1.0, high: float = 10.0, min_count: int = 5, window_seconds: int = 600,
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Small amounts that repeat at one merchant within the window."""
    small = df.filter(F.col("amount").between(low, high))
    span = window_seconds * 1_000_000
    return (
        tl.trailing_sums(
            small, "merchant_id", micros("ts"), "transaction_id", {"w": (-span + 1, 0)}, {"n": F.lit(1)}, hot_rows
        )
        .withColumnRenamed("n_w", "small_count")
        .filter(F.col("small_count") >= min_count)
    )


# ---- summaries and alerts -------------------------------------------------------------------

def batch_summary(scored: DataFrame) -> DataFrame:
    """One wide row: counts by decision and level, score and amount statistics, decline rate."""
    decision, level, score, amount = (F.col(c) for c in ("decision", "risk_level", "fraud_score", "amount"))
    base = scored.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        *[F.count_if(decision == d.upper()).alias(d) for d in ("approved", "declined", "review")],
        *[F.count_if(level == r).alias(r.lower()) for r in RISK_ORDER],
        F.avg(score).alias("score_mean"),
        F.stddev_samp(score).alias("score_std"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.avg(amount).alias("amount_mean"),
        F.sum(amount).alias("amount_total"),
        F.max(amount).alias("amount_max"),
    )
    one = F.lit(1).alias("_one")
    medians = tl.exact_quantiles(scored.select(one, "fraud_score"), "_one", "fraud_score", {"score_median": 0.5}).join(
        tl.exact_quantiles(scored.select(one, "amount"), "_one", "amount", {"amount_median": 0.5}), "_one"
    )
    return (
        base.withColumn("_one", F.lit(1))
        .join(medians, "_one", "left")
        .drop("_one")
        .withColumn("fraud_rate", safe_ratio(F.col("declined"), F.col("total_transactions")))
    )


def summary_rows(summary: DataFrame) -> DataFrame:
    """The summary as (section, name, value) rows."""
    return summary.unpivot(
        [], [F.col(c).cast("double").alias(c) for c in summary.columns], "name", "value"
    ).select(F.lit("summary").alias("section"), "name", "value")


def top_factors(scored: DataFrame, k: int = 10) -> DataFrame:
    return (
        scored.select(F.explode("risk_factors").alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "name")
        .limit(k)
        .select(F.lit("factor").alias("section"), "name", F.col("n").cast("double").alias("value"))
    )


def build_alerts(scored: DataFrame, threshold: float = 0.6, strict: bool = False, score: str = "fraud_score") -> DataFrame:
    """Alert rows for scores at (or, if strict, above) the threshold, with a reproducible id."""
    s = F.col(score)
    chosen = scored.filter(s > threshold if strict else s >= threshold)
    return chosen.select(
        content_key(F.lit("alert").alias("kind"), "transaction_id", "user_id").alias("alert_id"),
        "transaction_id",
        "user_id",
        s.alias("risk_score"),
        risk_level(s).alias("risk_level"),
        F.when(s >= 0.8, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.col("ts").alias("alert_time"),
        F.create_map(F.lit("amount"), F.col("amount"), F.lit("fraud_score"), s).alias("features"),
    )


def route_alerts(alerts: DataFrame, score: str = "risk_score") -> DataFrame:
    """Add the handling class and the queue of each alert."""
    s = F.col(score)
    severity = F.when(s >= 0.8, "critical").when(s >= 0.6, "medium").otherwise("low")
    return alerts.withColumn("handling", severity).withColumn(
        "queue", F.when(F.col("handling").isin("critical", "high"), "immediate").otherwise("review")
    )
