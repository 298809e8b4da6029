"""Projection, filtering, paging and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import time_bucket
from ledgerwatch.operators.common import event_age


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def recent_transactions(
    df: DataFrame, merchants: DataFrame, risk: str | None = None, country: str | None = None, limit: int = 1000,
    page: int = 1, as_of=None,
) -> DataFrame:
    """One page of the newest transactions with their merchant, age in seconds and the total count."""
    wanted = [F.col(c) == v for c, v in (("risk_level", risk), ("country", country)) if v is not None]
    chosen = df.filter(all_of(wanted))
    count = chosen.select(F.count(F.lit(1))).scalar()
    aged = chosen.withColumn("seconds_ago", event_age(df, as_of))
    newest = aged.orderBy(F.desc("ts"), F.desc("transaction_id")).offset((page - 1) * limit).limit(limit)
    return newest.join(merchants, "merchant_id", "left").withColumn("total_count", count)


def fraud_search(
    df: DataFrame, user_id=None, merchant_id=None, min_amount=None, max_amount=None, min_fraud_score=None,
    start=None, end=None, risk_levels=None, limit: int | None = 1000,
) -> DataFrame:
    """Conjunction of the given criteria, newest first."""
    tests = []
    if user_id is not None:
        tests.append(F.col("user_id") == user_id)
    if merchant_id is not None:
        tests.append(F.col("merchant_id") == merchant_id)
    if min_amount is not None:
        tests.append(F.col("amount") >= min_amount)
    if max_amount is not None:
        tests.append(F.col("amount") <= max_amount)
    if min_fraud_score is not None:
        tests.append(F.col("fraud_score") >= min_fraud_score)
    if start is not None:
        tests.append(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col("ts") <= F.lit(end).cast("timestamp"))
    if risk_levels:
        tests.append(F.col("risk_level").isin(list(risk_levels)))
    found = df.filter(all_of(tests)).orderBy(F.desc("ts"), F.desc("transaction_id"))
    return found if limit is None else found.limit(limit)


def high_risk_between(df: DataFrame, threshold: float, start, end, limit: int | None = None) -> DataFrame:
    """Rows at or above a score inside a time range, highest score first."""
    found = df.filter(
        (F.col("fraud_score") >= threshold)
        & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    ).orderBy(F.desc("fraud_score"), "transaction_id")
    return found if limit is None else found.limit(limit)


def user_activity(df: DataFrame, user_id, bucket_seconds: int = 3600) -> DataFrame:
    """Activity histogram of one user."""
    return (
        df.filter(F.col("user_id") == user_id)
        .groupBy(time_bucket(bucket_seconds, "ts").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("events"), F.sum("amount").alias("amount"))
    )


def coerce_numeric(df: DataFrame, columns: Sequence[str], label: str | None = None) -> DataFrame:
    """Cast to double with null as 0, and clip the label to 0 or 1."""
    out = {c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns}
    if label:
        number = F.coalesce(F.col(label).cast("string").try_cast("double"), F.col(label).try_cast("boolean").cast("double"), F.lit(0.0))
        out[label] = F.greatest(F.lit(0), F.least(F.lit(1), number.cast("int")))
    return df.withColumns(out)


def bin_right_closed(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge[i], edge[i+1]]; the lowest edge itself is outside."""
    result = F.when(value <= edges[0], F.lit(None))
    for upper, name in zip(edges[1:], labels):
        result = result.when(value <= upper, F.lit(name))
    return result


def bin_equal_width(value: Column, low: float, high: float, bins: int) -> Column:
    """0-based right-closed bin of equal width between ``low`` and ``high``; the low end belongs to the first bin."""
    width = (high - low) / bins
    raw = F.ceil((value - F.lit(low)) / F.lit(width)).cast("long") - 1
    return F.when(value.between(low, high), F.greatest(F.lit(0), raw))


def reshape(
    df: DataFrame, conditions: dict | None = None, rename: dict[str, str] | None = None, add: dict | None = None,
    remove: Sequence[str] = (), multiply: dict[str, float] | None = None, text_format: dict[str, str] | None = None,
) -> DataFrame:
    """Rows that meet the equality conditions, with fields renamed, added, removed, scaled and formatted."""
    out = df.filter(all_of([F.col(c) == v for c, v in (conditions or {}).items()]))
    out = out.withColumnsRenamed(rename or {})
    out = out.withColumns({n: F.lit(v) for n, v in (add or {}).items()})
    out = out.drop(*remove)
    out = out.withColumns({c: F.col(c) * v for c, v in (multiply or {}).items() if c in out.columns})
    return out.withColumns({c: F.format_string(p, F.col(c)) for c, p in (text_format or {}).items() if c in out.columns})


def for_tenant(df: DataFrame, tenant) -> DataFrame:
    """Rows of one tenant; ``tenant_id`` should be a partition column of large tables."""
    return df.filter(F.col("tenant_id") == F.lit(tenant))


def protect(df: DataFrame, rules: dict[str, str], key: str | None = None) -> DataFrame:
    """Encrypt, hash or mask columns: ``rules`` maps a column to ``encrypt``, ``hash`` or ``mask``."""
    ways = {
        "encrypt": lambda c: F.base64(F.aes_encrypt(c.cast("string"), F.lit(key), F.lit("GCM"))),
        "hash": lambda c: F.sha2(c.cast("string"), 256),
        "mask": lambda c: F.mask(c.cast("string"), F.lit("X"), F.lit("x"), F.lit("n")),
    }
    return df.withColumns({c: ways[way](F.col(c)) for c, way in rules.items()})


def reveal(column: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(column), F.lit(key), F.lit("GCM")).cast("string")


def metrics_between(df: DataFrame, tenant=None, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Metric rows of a tenant inside an optional time range."""
    tests = []
    if tenant is not None:
        tests.append(F.col("tenant_id") == F.lit(tenant))
    if start is not None:
        tests.append(F.col(ts) >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col(ts) <= F.lit(end).cast("timestamp"))
    return df.filter(all_of(tests))
