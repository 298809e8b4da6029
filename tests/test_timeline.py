"""Hot-key plans give the rows of the ordinary plans."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import micros
from ledgerwatch.operators import features, geo, rules, windowed, windows

from .conftest import rows

COLD = 10**9


@pytest.fixture(scope="module")
def log(spark):
    """One key holds a third of the rows; times repeat, values and merchants are missing now and then."""
    rng = np.random.RandomState(7)
    n = 400
    frame = pd.DataFrame(
        {
            "transaction_id": [f"t{i:04d}" for i in range(n)],
            "user_id": np.where(rng.rand(n) < 0.34, 1, rng.randint(2, 12, n)),
            "merchant_id": rng.randint(0, 6, n),
            "amount": rng.randint(1, 5000, n) / 10.0,
            "ts": [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)) for s in rng.randint(0, 40_000, n) // 20 * 20],
            "latitude": rng.rand(n), "longitude": rng.rand(n),
        }
    )
    return spark.createDataFrame(frame).withColumn(
        "merchant_id", F.when(F.col("transaction_id").endswith("7"), None).otherwise(F.col("merchant_id"))
    ).cache()


def same(build, *columns):
    hot, cold = rows(build(20), *columns), rows(build(COLD), *columns)
    assert hot == cold
    assert hot


def test_hot_keys_are_listed(log):
    assert [r[0] for r in tl.list_hot_keys(log, "user_id", 100).collect()] == [1]
    assert tl.list_hot_keys(log, "user_id", COLD) is None


def test_neighbours(log):
    same(lambda h: windows.gaps(log, hot_rows=h), "transaction_id", "time_diff_prev", "time_diff_next")


def test_running_sums(log):
    us = micros("ts")
    same(lambda h: tl.running_sums(log, "user_id", us, {"s": F.col("amount")}, tl.time_slice(us, 600), h), "transaction_id", "s")


def test_trailing_sums_include_and_exclude_the_row(log):
    spans = {"in": (-3_600_000_000 + 1, 0), "out": (-3_600_000_000, -1)}
    build = lambda h: tl.trailing_sums(log, "user_id", micros("ts"), "transaction_id", spans, {"n": F.lit(1), "s": F.col("amount")}, h, 900)
    same(build, "transaction_id", "n_in", "n_out", "s_in", "s_out")


def test_row_frames_with_small_blocks(log):
    us = micros("ts")

    def build(h):
        frame = lambda w, seq: {"m": F.avg("amount").over(w.rowsBetween(-4, 0)), "q": seq}
        return tl.row_frames(log, "user_id", [us, F.col("transaction_id")], 5, frame, tl.time_slice(us, 600), h, block_rows=7)

    same(build, "transaction_id", "m", "q")


def test_distinct_trailing_against_brute_force(log):
    span = 3_600_000_000
    build = lambda h: tl.distinct_trailing(log, "user_id", "merchant_id", micros("ts"), "transaction_id", span, "d", h)
    same(build, "transaction_id", "d")
    frame = log.toPandas()
    for r in build(20).toPandas().head(60).itertuples():
        near = frame[(frame.user_id == r.user_id) & (frame.ts <= r.ts) & (frame.ts > r.ts - pd.Timedelta(hours=1))]
        assert r.d == near.merchant_id.dropna().nunique()


def test_operators_on_hot_keys(log):
    same(lambda h: windows.rolling_statistics(log, sizes=(5, 10), hot_rows=h), "transaction_id", "rolling_mean_5", "rolling_q25_10")
    same(lambda h: windows.moving_averages(log, hot_rows=h), "transaction_id", "ema_0_1", "ema_0_5")
    same(lambda h: windows.rapid_fire_rows(log, hot_rows=h), "transaction_id", "is_rapid_fire", "rapid_fire_count")
    same(lambda h: features.recent_profile(log, rows=20, hot_rows=h), "transaction_id", "user_avg_amount", "is_amount_outlier")
    same(lambda h: features.rate_features(log, hot_rows=h), "transaction_id", "user_merchant_count_7d", "tx_velocity_24h")
    same(lambda h: rules.rapid_fire(log, 1800, 3, 1.0, h), "transaction_id", "burst_count", "variation")
    same(lambda h: windowed.user_velocity(log, 900, 3, 10, hot_rows=h), "transaction_id", "transaction_count", "total_amount", "unique_merchants")
    same(lambda h: windowed.merchant_anomalies(log, 1.1, 1.1, 3, hot_rows=h), "transaction_id", "current_count", "baseline_amount")
    same(lambda h: geo.location_frequency(log, 20.0, h), "transaction_id", "nearby_visits")
    same(lambda h: geo.velocity_profile(log, hot_rows=h), "transaction_id", "profile_max", "profile_avg")


def test_buckets_on_hot_keys_match_a_plain_replay(log):
    def replay(frame, kind, rate, burst):
        out, last, level = {}, None, burst if kind == "token" else 0.0
        for r in frame.sort_values(["ts", "transaction_id"]).itertuples():
            moved = 0.0 if last is None else (r.ts - last).total_seconds() * rate
            last = r.ts
            level = min(burst, level + moved) if kind == "token" else max(0.0, level - moved)
            ok = level >= 1 if kind == "token" else level < burst
            level += (-1 if kind == "token" else 1) * ok
            out[r.transaction_id] = bool(ok)
        return out

    frame = log.toPandas()
    for kind in ("token", "leaky"):
        expected = {}
        for _, part in frame.groupby("user_id"):
            expected |= replay(part, kind, 0.5 / 60, 2.0)
        for hot in (20, COLD):
            got = {r.transaction_id: r.allowed for r in windows.bucket_limit(log, "user_id", 0.5, 2.0, kind, hot_rows=hot).collect()}
            assert got == expected
    with pytest.raises(ValueError):
        windows.bucket_limit(log, "user_id", 1, 1, "other")


def test_exact_quantiles(log):
    got = {r.user_id: (r.a, r.b) for r in tl.exact_quantiles(log, "user_id", "amount", {"a": 0.5, "b": 0.95}).collect()}
    for user, part in log.toPandas().groupby("user_id"):
        assert got[user][0] == pytest.approx(part.amount.quantile(0.5))
        assert got[user][1] == pytest.approx(part.amount.quantile(0.95))


def test_top_rows(log):
    got = rows(tl.top_rows(log, "user_id", [F.desc("amount"), F.col("transaction_id")], 2, F.col("transaction_id"), salts=4), "user_id", "transaction_id")
    frame = log.toPandas().sort_values(["amount", "transaction_id"], ascending=[False, True]).groupby("user_id").head(2)
    assert got == sorted(zip(frame.user_id, frame.transaction_id))


def test_missing_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (5, 3, "c")], "k int, us long, i string")
    for hot in (1, COLD):
        got = rows(tl.neighbours(df, "k", ["us", "i"], F.col("us"), previous={"p": F.col("us")}, hot_rows=hot), "i", "p")
        assert got == [("a", None), ("b", 1), ("c", None)]


def test_hot_sums_forget_large_old_amounts(spark):
    """A key's old rows are huge; the sums of its last ones must not show them."""
    many = [(1, f"t{i:04d}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=30 * i), 9.7e8 + i / 7 if i < 3000 else i / 1000) for i in range(3200)]
    df = spark.createDataFrame(many, "user_id long, transaction_id string, ts timestamp, amount double")
    spans = {"w": (-300_000_000 + 1, 0)}
    measures = {"s": F.col("amount"), "q": F.col("amount") * F.col("amount")}
    build = lambda h: tl.trailing_sums(df, "user_id", micros("ts"), "transaction_id", spans, measures, h).where("transaction_id >= 't3050'")
    same(build, "transaction_id", "s_w", "q_w")


def test_all_hot_keys_are_listed_however_many(spark, log, monkeypatch):
    monkeypatch.setattr(tl, "BROADCAST_HOT", 3)
    df = spark.range(100).select((F.col("id") % 10).alias("k"))
    assert tl.list_hot_keys(df, "k", 5).count() == 10
    same(lambda h: windows.gaps(log, hot_rows=h), "transaction_id", "time_diff_prev", "time_diff_next")


@pytest.mark.parametrize("size", [1e-11, 1e21, float("inf")])
def test_hot_sums_hold_any_double(spark, size):
    many = [(1, f"t{i:03d}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=37 * (i // 2)), size * (1 + i % 3)) for i in range(60)]
    df = spark.createDataFrame(many, "user_id long, transaction_id string, ts timestamp, amount double")
    spans = {"short": (-100_000_000, 0), "day": (-86_400_000_000 + 1, 0), "before": (-100_000_000, -1), "now": (0, 0)}
    build = lambda h: tl.trailing_sums(df, "user_id", micros("ts"), "transaction_id", spans, {"s": F.col("amount"), "n": F.lit(1)}, h, 300)
    cold = {r.transaction_id: r for r in build(COLD).collect()}
    for r in build(5).collect():
        assert all(r[c] == pytest.approx(cold[r.transaction_id][c], rel=1e-12) for c in r.asDict() if c[:2] in ("s_", "n_"))


def test_slices_are_even_wherever_the_values_lie(spark):
    rng = np.random.RandomState(5)
    for values in (0.3 + 0.1 * rng.rand(4000), np.concatenate([rng.randn(4000) * 1e-9, [1e300, -1e300, np.inf, np.nan]])):
        counts = spark.createDataFrame([(float(v),) for v in values], "v double")
        sliced = counts.withColumn("s", tl.even_slices(counts, "v", slice_values=100))
        rows_ = sliced.groupBy("s").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("s").collect()
        assert len(rows_) > 30 and max(r.n for r in rows_) < 260
        assert all(a.hi < b.lo for a, b in zip(rows_, rows_[1:]) if not np.isnan(b.lo))
    same = spark.createDataFrame([(0.35,)] * 50, "v double")
    assert same.select(tl.even_slices(same, "v", 1).alias("s")).distinct().count() == 1
    assert same.limit(0).select(tl.even_slices(same.limit(0), "v")).count() == 0


def test_dense_keys_take_sums_from_slices(spark, monkeypatch):
    """Keys with many rows in one range are sliced however few rows they have; ids may repeat, keys and times be missing."""
    monkeypatch.setattr(tl, "DENSE_ROWS", 40)
    start = dt.datetime(2024, 1, 1)
    many = [(k, f"t{i // 2:03d}" if i % 7 else None, start + dt.timedelta(seconds=step * (i // 3)), float(i)) for k, step in ((1, 5), (None, 9), (2, 900)) for i in range(240)]
    df = spark.createDataFrame(many + [(1, "late", None, 1.0), (1, "later", None, 2.0)], "k long, transaction_id string, ts timestamp, amount double")
    assert {r.k for r in tl.list_dense_keys(df, "k", micros("ts"), 300_000_000, COLD, 40).collect()} == {1, None}
    spans = {"w": (-300_000_000 + 1, 0), "b": (-60_000_000, -1)}
    build = lambda: tl.trailing_sums(df, "k", micros("ts"), "transaction_id", spans, {"n": F.lit(1), "s": F.col("amount")}, COLD, 100)
    sliced = rows(build().fillna(-1), "amount", "k", "n_w", "n_b", "s_w", "s_b")
    plan = build()._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(tl, "list_dense_keys", lambda *a: None)
    assert sliced == rows(build().fillna(-1), "amount", "k", "n_w", "n_b", "s_w", "s_b") and len(sliced) == 722
    assert "_hot" in plan and "unboundedfollowing" not in plan
