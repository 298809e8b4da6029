"""Ordered per-key features.  All of them run on :mod:`ledgerwatch.functions.timeline`, so hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import micros
from ledgerwatch.operators.common import since


def impossible_travel(
    df: DataFrame, seconds: float | None = 86_400, min_degrees: float = 5.0, max_hours: float = 24.0,
    min_speed: float = 100.0, k: int | None = 20, as_of=None, hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Consecutive places of a user whose degree distance per hour is beyond ``min_speed``."""
    located = since(df, seconds, as_of).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    linked = tl.neighbours(
        located.withColumn("_us", micros("ts")), "user_id", ["_us", "transaction_id"], tl.time_slice(F.col("_us")),
        previous={"prev_lat": F.col("latitude"), "prev_lon": F.col("longitude"), "_prev": F.col("_us")}, hot_rows=hot_rows,
    )
    distance = F.abs(F.col("latitude") - F.col("prev_lat")) + F.abs(F.col("longitude") - F.col("prev_lon"))
    found = (
        linked.withColumns({"hours_diff": (F.col("_us") - F.col("_prev")) / 3.6e9, "distance_approx": distance})
        .filter((F.col("hours_diff") < max_hours) & (F.col("distance_approx") > min_degrees))
        .withColumn("velocity", F.col("distance_approx") / F.nullif(F.col("hours_diff"), F.lit(0.0)))
        .filter(F.col("velocity") > min_speed)
        .select("transaction_id", "user_id", "latitude", "longitude", "prev_lat", "prev_lon", "hours_diff", "distance_approx", "velocity")
    )
    return found if k is None else found.orderBy(F.desc("velocity"), "transaction_id").limit(k)


SECOND = 1_000_000
# Trailing windows by label, in seconds.
SPANS = {"1h": 3_600, "6h": 21_600, "1d": 86_400, "7d": 604_800, "30d": 2_592_000}


def _ordered(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("_us", micros(ts))


def gaps(df: DataFrame, key: str = "user_id", row_id: str = "transaction_id", hot_rows=tl.HOT_ROWS) -> DataFrame:
    """Seconds to the previous and to the next row of the key."""
    linked = tl.neighbours(
        _ordered(df), key, ["_us", row_id], tl.time_slice(F.col("_us")), previous={"_p": F.col("_us")},
        following={"_n": F.col("_us")}, hot_rows=hot_rows,
    )
    return linked.withColumns(
        {"time_diff_prev": (F.col("_us") - F.col("_p")) / 1e6, "time_diff_next": (F.col("_n") - F.col("_us")) / 1e6}
    ).drop("_us", "_p", "_n")


def trailing_counts(
    df: DataFrame, key: str = "user_id", spans: dict[str, int] = SPANS, row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Rows in (t - w, t] per key, and the same per hour."""
    frames = {s: (-w * SECOND + 1, 0) for s, w in spans.items()}
    out = tl.trailing_sums(df, key, micros("ts"), row_id, frames, {"tx_count": F.lit(1)}, hot_rows)
    return out.withColumns({f"tx_velocity_{s}": F.col(f"tx_count_{s}") / w * 3600 for s, w in spans.items()})


def trailing_amounts(
    df: DataFrame, key: str = "user_id", spans: dict[str, int] | None = None, row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Amount in (t - w, t] per key, and the same per hour."""
    spans = spans or {s: SPANS[s] for s in ("1h", "6h", "1d")}
    frames = {s: (-w * SECOND + 1, 0) for s, w in spans.items()}
    out = tl.trailing_sums(df, key, micros("ts"), row_id, frames, {"amount_sum": F.col("amount")}, hot_rows)
    return out.withColumns({f"amount_velocity_{s}": F.col(f"amount_sum_{s}") / w * 3600 for s, w in spans.items()})


def rapid_fire_rows(
    df: DataFrame, key: str = "user_id", max_gap: float = 300.0, rows: int = 10, row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Flag of a short gap, and its sum over the last ``rows`` rows (null until that many exist)."""
    hot_rows = hot_rows if isinstance(hot_rows, tl.HotKeys) else tl.HotKeys(df, key, hot_rows=hot_rows)
    flagged = gaps(df, key, row_id, hot_rows).withColumn(
        "is_rapid_fire", F.when(F.col("time_diff_prev") < max_gap, 1).otherwise(0)
    )

    def build(window, seq):
        total = F.sum("is_rapid_fire").over(window.rowsBetween(-(rows - 1), 0))
        return {"rapid_fire_count": F.when(seq >= rows, total)}

    return _framed(flagged, key, row_id, rows, build, hot_rows)


def _framed(df, key, row_id, size, build, hot_rows):
    base = _ordered(df)
    order = [F.col("_us"), F.col(row_id)]
    return tl.row_frames(base, key, order, size, build, tl.time_slice(F.col("_us")), hot_rows).drop("_us")


def rolling_statistics(
    df: DataFrame, key: str = "user_id", value: str = "amount", sizes=(5, 10, 20, 50), row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Mean, deviation, extremes and quartiles over the last 5/10/20/50 rows (null until full)."""
    v = F.col(value)

    def build(window, seq):
        out = {}
        for n in sizes:
            frame = window.rowsBetween(-(n - 1), 0)
            mean, std = F.avg(v).over(frame), F.stddev_samp(v).over(frame)
            stats = {
                "mean": mean, "std": std, "min": F.min(v).over(frame), "max": F.max(v).over(frame),
                "median": F.percentile(v, 0.5).over(frame), "q25": F.percentile(v, 0.25).over(frame),
                "q75": F.percentile(v, 0.75).over(frame), "deviation": (v - mean) / (std + 1e-8),
            }
            out.update({f"rolling_{s}_{n}": F.when(seq >= n, c) for s, c in stats.items()})
        return out

    return _framed(df, key, row_id, max(sizes), build, hot_rows)


def ema_rows(alpha: float, tolerance: float = 1e-18) -> int:
    """Rows after which the weight of an older value is below ``tolerance``."""
    rows, weight = 1, 1.0
    while weight > tolerance:
        weight *= 1.0 - alpha
        rows += 1
    return rows


def moving_averages(
    df: DataFrame, key: str = "user_id", value: str = "amount", alphas=(0.1, 0.3, 0.5), row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Exponential moving averages with adjusted weights, and the relative deviation from them.

    A value older than :func:`ema_rows` rows weighs less than the rounding error of a double, so a bounded frame gives
    the same number as the unbounded recursion.
    """
    v = F.col(value)

    def build(window, seq):
        out = {}
        for alpha in alphas:
            values = F.collect_list(v).over(window.rowsBetween(-(ema_rows(alpha) - 1), 0))
            keep = 1.0 - alpha
            sums = F.aggregate(
                values,
                F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
                lambda a, x: F.struct((a["s"] * keep + x).alias("s"), (a["w"] * keep + 1.0).alias("w")),  # noqa: B023
            )
            out[f"ema_{alpha}".replace(".", "_")] = sums["s"] / sums["w"]
        return out

    framed = _framed(df, key, row_id, max(ema_rows(a) for a in alphas), build, hot_rows)
    names = [f"ema_{a}".replace(".", "_") for a in alphas]
    return framed.withColumns({n.replace("ema", "ema_deviation"): (v - F.col(n)) / F.nullif(F.col(n), F.lit(0.0)) for n in names})


def rolling_slopes(
    df: DataFrame, key: str = "user_id", value: str = "amount", sizes=(5, 10), row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Least-squares slope over the last rows (null until full)."""

    def build(window, seq):
        return {
            f"trend_{n}": F.when(seq >= n, F.regr_slope(F.col(value), seq.cast("double")).over(window.rowsBetween(-(n - 1), 0)))
            for n in sizes
        }

    return _framed(df, key, row_id, max(sizes), build, hot_rows)


def frequency_ranks(df: DataFrame, column: str) -> DataFrame:
    """Values with their frequency and dense rank by frequency.

    Only the distinct frequencies are ranked in one task; n rows have at most sqrt(2 n) of them.
    """
    from pyspark.sql import Window

    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
    ranks = counts.select("frequency").distinct().withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("frequency")))
    )
    return counts.join(ranks, "frequency").select(column, "frequency", "rank")


def array_quantile(sorted_values, q: float):
    """Linear-interpolation quantile of a sorted array."""
    at = (F.size(sorted_values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.ceil(at).cast("int"))
    return a + (b - a) * (at - low)


def recent_history(
    df: DataFrame, key: str = "user_id", value: str = "amount", rows: int = 100, seconds: int = 2_592_000,
    row_id: str = "transaction_id", hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Add ``history``: the values of the last ``rows`` rows within ``seconds``, the current one included."""

    def build(window, seq):
        pairs = F.collect_list(F.struct(micros("ts").alias("us"), F.col(value).alias("v"))).over(
            window.rowsBetween(-(rows - 1), 0)
        )
        fresh = F.filter(pairs, lambda p: p["us"] > micros("ts") - F.lit(seconds * SECOND))
        return {"history": F.transform(fresh, lambda p: p["v"])}

    return _framed(df, key, row_id, rows, build, hot_rows)


def percent_rank(df: DataFrame, value: str = "amount", **options) -> DataFrame:
    """Average percent rank of the current value among the recent history of its key."""
    v = F.col(value)
    less = F.size(F.filter("history", lambda x: x < v))
    same = F.size(F.filter("history", lambda x: x == v))
    n = F.size("history")
    return recent_history(df, value=value, **options).withColumn(
        "amount_percentile", F.when(n > 1, (less + (same + 1) / 2) / n).otherwise(0.5)
    ).drop("history")


def sliding_limit(
    requests: DataFrame, key: str, limit: int, seconds: int = 60, row_id: str = "transaction_id",
    hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Earlier requests of the key within the window, and whether the limit lets this one pass."""
    counted = tl.trailing_sums(
        requests, key, micros("ts"), row_id, {"w": (-seconds * SECOND + 1, -1)}, {"n": F.lit(1)}, hot_rows
    )
    return counted.withColumnRenamed("n_w", "current_count").withColumns(
        {
            "allowed": F.col("current_count") < limit,
            "remaining": F.greatest(F.lit(limit) - F.col("current_count") - 1, F.lit(0)),
        }
    )


def busy_periods(
    requests: DataFrame, key: str, idle_seconds: float, row_id: str = "transaction_id", hot_rows=tl.HOT_ROWS
) -> DataFrame:
    """Number the periods of each key that are separated by at least ``idle_seconds`` without requests."""
    hot_rows = hot_rows if isinstance(hot_rows, tl.HotKeys) else tl.HotKeys(requests, key, hot_rows=hot_rows)
    linked = tl.neighbours(
        _ordered(requests), key, ["_us", row_id], tl.time_slice(F.col("_us")), previous={"_p": F.col("_us")},
        hot_rows=hot_rows,
    )
    starts = linked.withColumn(
        "_start", F.when(F.col("_p").isNull() | (F.col("_us") - F.col("_p") >= int(idle_seconds * SECOND)), 1).otherwise(0)
    )
    return tl.running_sums(
        starts, key, F.col("_us"), {"period": F.col("_start")}, tl.time_slice(F.col("_us")), hot_rows
    ).drop("_p", "_start")


def bucket_limit(
    requests: DataFrame, key: str, per_minute: float, burst: float, kind: str = "token",
    row_id: str = "transaction_id", hot_rows=tl.HOT_ROWS,
) -> DataFrame:
    """Replay of a token or leaky bucket per key.

    A bucket is back in its initial state after ``burst / rate`` idle seconds, so the request log falls into
    independent busy periods.  Each period streams through one task in time order, batch by batch, with a single
    number as its state.
    """
    if kind not in ("token", "leaky"):
        raise ValueError(f"unknown bucket kind {kind!r}")
    rate = per_minute / 60.0
    periods = busy_periods(requests, key, burst / rate, row_id, hot_rows).select(
        key, "period", "_us", row_id
    )
    columns = {f.name: f.dataType.simpleString() for f in periods.schema.fields}
    schema = f"{row_id} {columns[row_id]}, allowed boolean, level double"
    ordered = periods.repartition(key, "period").sortWithinPartitions(key, "period", "_us", row_id)

    def replay(batches):
        import pandas as pd

        period, last, level = None, 0, 0.0
        for batch in batches:
            allowed, levels = [], []
            for k, p, us in zip(batch[key], batch["period"], batch["_us"]):
                if period != (k, p):
                    period, last, level = (k, p), us, burst if kind == "token" else 0.0
                moved = (us - last) / 1e6 * rate
                last = us
                if kind == "token":
                    level = min(burst, level + moved)
                    ok = level >= 1.0
                    level -= 1.0 if ok else 0.0
                else:
                    level = max(0.0, level - moved)
                    ok = level < burst
                    level += 1.0 if ok else 0.0
                allowed.append(ok)
                levels.append(level)
            yield pd.DataFrame({row_id: batch[row_id], "allowed": allowed, "level": levels})

    return ordered.mapInPandas(replay, schema)
