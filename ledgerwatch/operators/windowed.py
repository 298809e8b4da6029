"""Window aggregates, features and risk; the same code serves batch and streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import entropy_of_counts, micros
from ledgerwatch.operators.rules import risk_level, window_risk

# The standard windows (size, slide or session gap, allowed lateness).
TUMBLING = [("1 minute", "5 seconds"), ("5 minutes", "10 seconds")]
SLIDING = ("10 minutes", "1 minute", "30 seconds")
SESSION = ("30 minutes", "60 seconds")

CHANNELS = ("online", "mobile", "pos", "atm")

#: Keys of a stream's window share the state of so many groups: a row of state per group, not per key.
GROUPS = 32


def window_aggregates(
    df: DataFrame, window: Column, keys: Sequence[str] = ("user_id",), channels: Sequence[str] = CHANNELS, exact: bool = True,
    session: str | None = None,
) -> DataFrame:
    """Counts, amounts, parties, mean gap and channel counts per key and window.

    The mean gap needs only the first and last time.  ``exact=False`` counts parties approximately, which keeps the
    state of a streaming query small.

    Give the gap as ``session`` for session windows.  Spark plans a distinct count by adding the counted column to the
    grouping, and pushes later filters on the window bounds below the grouping; both happen before sessions are merged
    and would change them.  So parties are collected as sets, and the bounds are aggregates of the event times.

    The windows of a stream are kept by group of keys (see ``grouped_windows``) where amounts are doubles.
    """
    streaming = df.isStreaming

    def parties(column: str) -> Column:
        if not exact:
            return F.approx_count_distinct(column)
        return F.size(F.collect_set(column)).cast("long") if streaming or session is not None else F.count_distinct(column)

    n = F.count(F.lit(1))
    span = (micros(F.max("ts")) - micros(F.min("ts"))) / 1e6
    start, end = F.col("w.start"), F.col("w.end")
    if session is not None:
        start, end = F.col("_first"), F.col("_last") + F.expr(f"INTERVAL {session}")
    elif streaming and exact and isinstance(df.schema["amount"].dataType, DoubleType):
        measured = grouped_windows(df, window, keys, channels)
        return measured.select(*measured.columns[:-1], _distribution(channels))
    grouped = df.groupBy(*keys, window.alias("w")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), n.alias("event_count"), F.sum("amount").alias("total_amount"), F.avg("amount").alias("avg_amount"),
        F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"), F.stddev_pop("amount").alias("std_amount"),
        parties("user_id").alias("unique_users"), parties("merchant_id").alias("unique_merchants"),
        F.when(n > 1, span / (n - 1)).alias("avg_time_between_events"),
        F.array(*[F.count_if(F.col("channel") == c) for c in channels]).alias("_channels"),
    )
    return grouped.select(
        *keys, start.alias("window_start"), end.alias("window_end"), "event_count", "total_amount",
        "avg_amount", "min_amount", "max_amount", "std_amount", "unique_users", "unique_merchants", "avg_time_between_events",
        _distribution(channels),
    )


def _distribution(channels: Sequence[str]) -> Column:
    """The counts in ``_channels`` above zero, as a map."""
    named = F.filter(
        F.array(*[F.struct(F.lit(c).alias("k"), F.get("_channels", F.lit(i)).alias("v")) for i, c in enumerate(channels)]),
        lambda e: e["v"] > 0,
    )
    return F.map_from_entries(named).alias("channel_distribution")


def grouped_windows(df: DataFrame, window: Column, keys: Sequence[str], channels: Sequence[str], groups: int = GROUPS) -> DataFrame:
    """The measures of ``window_aggregates`` for a stream, with the channels' counts as the array ``_channels``.

    Most keys have an event or two in a window, and every event lies in several sliding windows: a row of state per key and
    window costs far more than the event itself. So the state has a row per window and group of keys, with the events' narrow
    columns as a list. When the watermark closes a window, its lists are laid out as rows and measured by batch.
    """
    schema = df.schema
    parties = {f"_{c}": c for c in ("user_id", "merchant_id") if c not in keys}
    kept = [
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], micros("ts").alias("_us"), F.col("amount").alias("_amount"),
        F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")).cast("byte").alias("_channel"),
        *[F.col(c).alias(n) for n, c in parties.items()],
    ]
    group = F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_g")
    held = df.groupBy(window.alias("w"), group).agg(F.collect_list(F.struct(*kept)).alias("_rows"))
    flat = held.select(F.col("w.start").alias("_start"), F.col("w.end").alias("_end"), "_g", F.inline("_rows"))
    measures = {
        "event_count": LongType(), "total_amount": DoubleType(), "avg_amount": DoubleType(), "min_amount": DoubleType(), "max_amount": DoubleType(),
        "std_amount": DoubleType(), "unique_users": LongType(), "unique_merchants": LongType(), "avg_time_between_events": DoubleType(),
    }
    fields = [StructField(f"_k{i}", schema[k].dataType) for i, k in enumerate(keys)]
    fields += [StructField(n, TimestampType()) for n in ("window_start", "window_end")] + [StructField(n, t) for n, t in measures.items()]
    fields += [StructField(f"_c{i}", LongType()) for i in range(len(channels))]
    found = flat.mapInArrow(_measured([f"_k{i}" for i in range(len(keys))], list(keys), list(parties), len(channels)), StructType(fields))
    return found.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "window_start", "window_end", *measures,
        F.array(*[F.col(f"_c{i}") for i in range(len(channels))]).alias("_channels"),
    )


def _measured(keys: list[str], names: list[str], parties: list[str], channels: int):
    """Measures per window and key; the rows of a window's group come one after the other, and may go on in the next batch."""

    def run(stream: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        def measure(rows: pa.Table) -> pa.RecordBatch:
            amount = rows["_amount"]
            rows = rows.append_column("_nan", pc.cast(pc.is_nan(amount), pa.int64()))
            for i in range(channels):
                hit = pc.fill_null(pc.equal(rows["_channel"], pa.scalar(i + 1, pa.int8())), False)
                rows = rows.append_column(f"_c{i}", pc.cast(hit, pa.int64()))
            wanted = [
                ("_end", "min"), ("_us", "count", pc.CountOptions(mode="all")), ("_us", "min"), ("_us", "max"), ("_nan", "sum"), ("_amount", "count"), ("_amount", "sum"),
                ("_amount", "min"), ("_amount", "max"), ("_amount", "stddev"), *[(p, "count_distinct") for p in parties], *[(f"_c{i}", "sum") for i in range(channels)],
            ]
            got = rows.group_by(["_start", *keys], use_threads=False).aggregate(wanted).combine_chunks()
            n, some, nans = got["_us_count"], got["_amount_count"], pc.fill_null(got["_nan_sum"], 0)
            known = pc.greater(some, 0)
            null, nan = pa.scalar(None, pa.float64()), pa.scalar(float("nan"))
            total = got["_amount_sum"]
            # NaN is above all numbers, as in Spark
            least = pc.if_else(known, pc.if_else(pc.equal(nans, some), nan, got["_amount_min"]), null)
            most = pc.if_else(known, pc.if_else(pc.greater(nans, 0), nan, got["_amount_max"]), null)
            gaps = pc.subtract(n, 1)
            gap = pc.divide(pc.divide(pc.cast(pc.subtract(got["_us_max"], got["_us_min"]), pa.float64(), safe=False), 1e6), pc.if_else(pc.greater(gaps, 0), pc.cast(gaps, pa.float64()), null))
            counts = [
                got[f"_{c}_count_distinct"] if f"_{c}" in parties else pc.cast(pc.is_valid(got[keys[names.index(c)]]), pa.int64())
                for c in ("user_id", "merchant_id")
            ]
            columns = [
                *[got[k] for k in keys], got["_start"], got["_end_min"], n, total, pc.divide(total, pc.cast(some, pa.float64())), least, most,
                got["_amount_stddev"], *counts, gap, *[got[f"_c{i}_sum"] for i in range(channels)],
            ]
            out = [
                *keys, "window_start", "window_end", "event_count", "total_amount", "avg_amount", "min_amount", "max_amount", "std_amount", "unique_users",
                "unique_merchants", "avg_time_between_events", *[f"_c{i}" for i in range(channels)],
            ]
            return pa.Table.from_arrays(columns, names=out).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        for batch in stream:
            if not batch.num_rows:
                continue
            start, group = batch["_start"], batch["_g"]
            last = pc.and_(pc.equal(start, start[-1]), pc.equal(group, group[-1]))
            cut = batch.num_rows - pc.sum(last).as_py()
            if held and (start[0] != held[-1]["_start"][-1] or group[0] != held[-1]["_g"][-1]):
                yield measure(pa.Table.from_batches(held))
                held = []
            if cut:
                yield measure(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield measure(pa.Table.from_batches(held))

    return run


def gap_extremes(df: DataFrame, window: Column, key: str = "user_id", hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Shortest and longest gap per key and (non-overlapping) window, for batch tables."""
    placed = df.withColumns({"w": window, "_us": micros("ts")}).withColumn("_w", micros(F.col("w.start")))
    linked = tl.neighbours(
        placed, [key, "_w"], ["_us", "transaction_id"], tl.time_slice(F.col("_us")), previous={"_p": F.col("_us")}, hot_rows=hot_rows
    )
    gap = (F.col("_us") - F.col("_p")) / 1e6
    return linked.groupBy(key, F.col("w.start").alias("window_start")).agg(
        F.min(gap).alias("min_time_between_events"), F.max(gap).alias("max_time_between_events")
    )


def window_features(aggregates: DataFrame) -> DataFrame:
    """Rates per minute, deviation ratio, channel diversity and entropy, regularity."""
    minutes = (micros("window_end") - micros("window_start")) / 6e7
    counts = F.map_values("channel_distribution")
    return aggregates.withColumns(
        {
            "transactions_per_minute": F.col("event_count") / minutes,
            "amount_per_minute": F.col("total_amount") / minutes,
            "amount_deviation_ratio": F.when(F.col("avg_amount") > 0, F.col("max_amount") / F.col("avg_amount")),
            "channel_diversity": F.size("channel_distribution"),
            "channel_entropy": F.when(F.size("channel_distribution") > 1, entropy_of_counts(counts)),
            "time_regularity": F.when(F.col("avg_time_between_events").isNotNull(), 1.0 / (1.0 + F.col("std_amount"))),
        }
    )


def scored_windows(features: DataFrame) -> DataFrame:
    """Risk and level of each window."""
    names = ["transactions_per_minute", "amount_per_minute", "amount_deviation_ratio", "channel_diversity", "avg_time_between_events"]
    risk = window_risk({n: F.col(n) for n in names})
    return features.withColumn("risk_score", risk).withColumn("risk_level", risk_level(F.col("risk_score")))


def window_alerts(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Alert rows of windows above the threshold."""
    return scored.filter(F.col("risk_score") > threshold).select(
        F.sha2(F.concat_ws("|", F.lit("window"), F.col("user_id").cast("string"), F.col("window_start").cast("string")), 256).alias("alert_id"),
        F.concat_ws("_", F.lit("window"), F.col("user_id").cast("string"), F.unix_seconds("window_start").cast("string")).alias("transaction_id"),
        "user_id", "risk_score", "risk_level", F.col("event_count").alias("window_events"),
        ((micros("window_end") - micros("window_start")) / 6e7).alias("window_duration_minutes"), "window_start", "window_end",
    )


# ---- batch twins of the stateful operators --------------------------------------------------

def user_velocity(
    df: DataFrame, seconds: int = 300, min_count: int = 5, rows: int = 100, row_id: str = "transaction_id", hot_rows=tl.HOT_ROWS
) -> DataFrame:
    """Transactions that find at least ``min_count`` of the user's last ``rows`` within ``seconds`` (both ends included)."""

    def build(window, seq):
        seen = F.collect_list(F.struct(micros("ts").alias("us"), F.col("amount").alias("a"), F.col("merchant_id").alias("m"))).over(
            window.rowsBetween(-(rows - 1), 0)
        )
        return {"_near": F.filter(seen, lambda e: e["us"] >= micros("ts") - F.lit(seconds * 1_000_000))}

    base = df.withColumn("_us", micros("ts"))
    framed = tl.row_frames(base, "user_id", [F.col("_us"), F.col(row_id)], rows, build, tl.time_slice(F.col("_us")), hot_rows)
    return framed.filter(F.size("_near") >= min_count).select(
        row_id, "user_id", F.size("_near").cast("long").alias("transaction_count"),
        F.aggregate("_near", F.lit(0.0), lambda s, e: s + e["a"]).alias("total_amount"),
        F.size(F.array_distinct(F.transform("_near", lambda e: e["m"]))).cast("long").alias("unique_merchants"),
    )


def merchant_anomalies(
    df: DataFrame, count_factor: float = 3.0, amount_factor: float = 5.0, buckets: int = 24, row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Transactions at which the current hour is far above the mean of the last ``buckets`` hours with activity.

    Hours are summed first; the window over them holds one row per merchant and hour.
    """
    from pyspark.sql import Window

    timed = df.withColumns({"_us": micros("ts"), "hour": F.date_trunc("hour", "ts")})
    hours = timed.groupBy("merchant_id", "hour").agg(F.count(F.lit(1)).alias("_n"), F.sum("amount").alias("_a"))
    order = Window.partitionBy("merchant_id").orderBy("hour")
    before = order.rowsBetween(-(buckets - 1), -1)
    base = hours.select(
        "merchant_id", "hour", F.row_number().over(order).alias("_seen"), F.sum("_n").over(before).alias("_bn"),
        F.sum("_a").over(before).alias("_ba"),
    )
    running = tl.running_sums(
        timed.select(row_id, "merchant_id", "hour", "_us", "amount"), ["merchant_id", "hour"], F.col("_us"),
        {"current_count": F.lit(1), "current_amount": F.col("amount")}, tl.time_slice(F.col("_us"), 60), hot_rows,
    )
    joined = running.join(base, ["merchant_id", "hour"]).filter(F.col("_seen") > buckets).withColumns(
        {
            "baseline_count": (F.col("_bn") + F.col("current_count")) / float(buckets),
            "baseline_amount": (F.col("_ba") + F.col("current_amount")) / float(buckets),
        }
    )
    odd = (F.col("current_count") > F.col("baseline_count") * count_factor) | (
        F.col("current_amount") > F.col("baseline_amount") * amount_factor
    )
    return joined.filter(odd).select(
        row_id, "merchant_id", "current_count", "baseline_count", "current_amount", "baseline_amount"
    )
