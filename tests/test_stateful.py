"""Detectors with state: late events, any cut into batches, expiry, and hot keys spread over time buckets."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import micros
from ledgerwatch.operators import windowed as wd
from ledgerwatch.streaming import jobs, stateful

from .conftest import rows
from .test_streams import SCHEMA, T0, land, stream


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.fixture(scope="module")
def late():
    """Nine hours of events with ties, in three parts; one event in six arrives a part later than its time says."""
    rng = np.random.RandomState(5)
    at = np.sort(rng.randint(0, 9 * 3600, 240))
    at[100:103] = at[100]
    made = [(f"e{i:03d}", i % 3, i % 2, float(rng.randint(1, 900)), T0 + dt.timedelta(seconds=int(s)), "web") for i, s in enumerate(at)]
    made.append(("none", 1, 1, 5.0, None, "web"))
    part = np.minimum(np.arange(241) // 80 + (rng.rand(241) < 0.17), 2)
    return [[r for r, p in zip(made, part) if p == k] for k in range(3)]


DETECTORS = {
    "velocity": lambda s: jobs.user_velocity_stream(s, "12 hours", 1800, 3, 5, corrections=True),
    "features": lambda s: jobs.running_features_stream(s, "12 hours", 1800, corrections=True),
    "merchants": lambda s: jobs.merchant_anomaly_stream(s, "12 hours", 1.1, 1.2, 2, corrections=True),
}


@pytest.mark.parametrize("name", DETECTORS)
def test_late_events_correct_what_went_out(spark, tmp_path, late, name):
    found = []
    for label, parts in (("one", [[r for p in late for r in p]]), ("many", late)):
        src = stream(spark, land(spark, tmp_path / label, parts))
        out = jobs.to_table(DETECTORS[name](src), str(tmp_path / f"{label}-out"), str(tmp_path / f"{label}-c"))
        if label == "many":
            assert out.count() > out.select("transaction_id").distinct().count()
        last = stateful.latest(out)
        found.append(rows(last.where("alert").drop("alert") if name == "merchants" else last))
    assert found[0] == found[1]
    table = spark.createDataFrame([r for p in late for r in p], SCHEMA).where("ts IS NOT NULL")
    if name == "velocity":
        assert found[0] == rows(wd.user_velocity(table, 1800, 3, 5)) and len(found[0]) > 20
    elif name == "merchants":
        assert found[0] == rows(wd.merchant_anomalies(table, 1.1, 1.2, 2)) and len(found[0]) > 10
    else:
        events = sorted((r.user_id, r.ts, r.transaction_id, r.amount) for r in table.collect())
        near = {i: [a for v, s, j, a in events if v == u and (s, j) <= (t, i) and s > t - dt.timedelta(seconds=1800)] for u, t, i, _ in events}
        assert {r[0]: (r[5], r[6]) for r in found[0]} == {i: (len(a), pytest.approx(sum(a))) for i, a in near.items()}


def test_state_expires(spark, tmp_path):
    """Old buckets and hours leave the state; a merchant that was idle for long begins anew."""
    def part(days, n):
        return [(f"d{days}-{i}", 1, 1, 10.0, T0 + dt.timedelta(days=days, hours=i), "web") for i in range(n)]

    for name, build in (
        ("velocity", lambda s: jobs.user_velocity_stream(s, "1 minute", 60, 1)),
        ("merchants", lambda s: jobs.merchant_anomaly_stream(s, "1 minute", 0.1, 0.1, 2, expiry="5 days")),
    ):
        src = stream(spark, land(spark, tmp_path / name, [part(0, 6), part(10, 3), part(20, 1)]))
        query = jobs.run_available(build(src).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-o")), str(tmp_path / f"{name}-c"))
        held = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
        assert max(held) >= 6 and held[-1] <= 4, (name, held)
        got = {r.transaction_id for r in spark.read.parquet(str(tmp_path / f"{name}-o")).collect()}
        if name == "merchants":
            assert got == {f"d0-{i}" for i in range(2, 6)} | {"d10-2"}
        else:
            assert len(got) == 10


def test_hot_key_is_spread_over_buckets(spark):
    """All rows of one user: no group holds more than its bucket, and every window is whole in the group of its row."""
    base = spark.range(20_000).select(F.lit(1).alias("user_id"), F.timestamp_seconds(F.col("id") * 7 - 50_000).alias("ts"))
    span, length = 300_000_000, 1_800_000_000
    placed = stateful.bucketed(base.withColumn("us", micros("ts")), span, length)
    sizes = placed.groupBy("bucket").agg(F.count_if("guest").alias("g"), F.count_if(~F.col("guest")).alias("n")).collect()
    assert len(sizes) > 70 and max(r.n for r in sizes) <= 258 and max(r.g for r in sizes) <= 43
    assert sum(r.n for r in sizes) == 20_000
    seen = {(r.bucket, r.us) for r in placed.select("bucket", "us").collect()}
    for r in placed.where("NOT guest").sample(0.02, 1).collect():
        assert all((r.bucket, u) in seen for u in range(r.us - r.us % 1, r.us - span - 1, -7_000_000) if u >= -50_000_000_000)


def test_bounds_of_rows_and_merchants():
    """The matrix of windows against plain loops, ties and repeated merchants included."""
    rng = np.random.RandomState(2)
    n, limit = 500, 7
    us = np.sort(rng.randint(0, 400, n)).astype("int64")
    data = {"us": us, "amount": rng.rand(n), "merchant": rng.randint(0, 5, n).astype(object), "transaction_id": np.arange(n).astype(str).astype(object)}
    first = np.maximum(np.searchsorted(us, us - 6, "left"), np.arange(n) - limit + 1)
    found, hit = stateful.velocity(limit, 3)(data, first, np.arange(n))
    for i in range(n):
        window = slice(first[i], i + 1)
        assert hit[i] == (i + 1 - first[i] >= 3)
        if hit[i]:
            assert found["unique_merchants"][i] == len(set(data["merchant"][window])) and found["total_amount"][i] == pytest.approx(data["amount"][window].sum())


def test_keys_share_the_state_but_not_their_sums(spark, tmp_path, monkeypatch):
    """However many users there are, a time bucket has few groups; amounts of one user don't show in those of others."""
    monkeypatch.setattr(stateful, "GROUPS", 3)
    odd = {1: 1e21}
    made = [(f"e{i:04d}", i % 150 if i % 50 else None, i % 2, odd.get(i % 150, i / 7), T0 + dt.timedelta(seconds=40 * i), "web") for i in range(600)]
    src = stream(spark, land(spark, tmp_path / "in", [made]))
    writer = jobs.running_features_stream(src, "12 hours", 9000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    query = jobs.run_available(writer, str(tmp_path / "c"))
    held = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)
    assert held <= 3 * 2 * 4, held  # a list, its size and a timer or two for each group and bucket
    near = {i: [a for _, v, _, a, s, _ in made if v == u and t - dt.timedelta(seconds=9000) < s <= t] for i, u, _, _, t, _ in made}
    got = {r.transaction_id: (r.user_id, r.recent_count, r.recent_amount) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (u, len(near[i]), pytest.approx(sum(near[i]), rel=1e-12)) for i, u, *_ in made}
