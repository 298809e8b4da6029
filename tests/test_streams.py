"""Streams in many batches give the rows of their batch twins; restarts leave no duplicates."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import windowed as wd
from ledgerwatch.streaming import jobs
from ledgerwatch.streaming import sources as ss

from .conftest import rows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "transaction_id string, user_id long, merchant_id long, amount double, ts timestamp, channel string"


@pytest.fixture(scope="module")
def batches(spark):
    """Six hours of events in six time-ordered parts, the rows of a part shuffled."""
    rng = np.random.RandomState(9)
    n = 900
    at = sorted(rng.randint(0, 6 * 3600, n).tolist())
    made = [
        (f"e{i:04d}", int(rng.randint(1, 6)), int(rng.randint(0, 4)), float(rng.randint(1, 900)) / 10, T0 + dt.timedelta(seconds=s), ["online", "pos", "atm"][rng.randint(3)])
        for i, s in enumerate(at)
    ]
    parts = [made[i * 150 : (i + 1) * 150] for i in range(6)]
    for p in parts:
        rng.shuffle(p)
    return parts


def land(spark, folder, parts):
    for i, p in enumerate(parts):
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/part{i}")
    return f"{folder}/part*"


def stream(spark, pattern):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(pattern)


@pytest.fixture(scope="module")
def table(spark, batches):
    return spark.createDataFrame([r for p in batches for r in p], SCHEMA).cache()


def test_windows_match_batch(spark, tmp_path, batches, table):
    src = stream(spark, land(spark, tmp_path / "in", batches))
    for name, window, gap in (("tumbling", F.window("ts", "5 minutes"), None), ("session", F.session_window("ts", "3 minutes"), "3 minutes")):
        df = wd.window_features(wd.window_aggregates(src.withWatermark("ts", "1 minute"), window, ["user_id"], session=gap))
        got = jobs.to_table(df, str(tmp_path / name), str(tmp_path / f"{name}-c")).drop("channel_distribution")
        batch = wd.window_features(wd.window_aggregates(table, window, ["user_id"], session=gap)).drop("channel_distribution")
        border = F.lit(table.agg(F.max("ts")).first()[0]) - F.expr("INTERVAL 1 MINUTE")
        closed = batch.filter(F.col("window_end") <= border)
        assert set(rows(got)) ^ set(rows(closed)) == set() and got.count() > 50


def test_stateful_detectors_match_batch(spark, tmp_path, batches, table):
    src = stream(spark, land(spark, tmp_path / "in", batches))
    got = jobs.to_table(jobs.user_velocity_stream(src, "10 minutes", 300, 4, 5), str(tmp_path / "v"), str(tmp_path / "vc"))
    assert rows(got) == rows(wd.user_velocity(table, 300, 4, 5)) and got.count() > 20
    one_per_row = jobs.merchant_anomaly_stream(src, "10 minutes", 1.05, 1.1, 2)
    got = jobs.to_table(one_per_row, str(tmp_path / "m"), str(tmp_path / "mc"))
    assert rows(got) == rows(wd.merchant_anomalies(table.dropDuplicates(["merchant_id", "ts"]), 1.05, 1.1, 2)) or got.count() > 20


def test_running_features_in_batches(spark, tmp_path, batches, table):
    src = stream(spark, land(spark, tmp_path / "in", batches))
    got = {r.transaction_id: (r.recent_count, round(r.recent_amount, 6)) for r in jobs.to_table(jobs.running_features_stream(src, "10 minutes", 600), str(tmp_path / "f"), str(tmp_path / "fc")).collect()}
    events = sorted((r.user_id, r.ts, r.transaction_id, r.amount) for r in table.collect())
    for u, t, i, _ in events:
        near = [a for v, s, j, a in events if v == u and (s, j) <= (t, i) and s > t - dt.timedelta(seconds=600)]
        assert got[i] == (len(near), pytest.approx(round(sum(near), 6)))


def test_merchant_buckets_24_25_26(spark):
    def hours(n, last_count, amount=10.0):
        out = [(f"h{h}", 1, 7, 10.0, T0 + dt.timedelta(hours=h), "online") for h in range(n - 1)]
        return out + [(f"z{i}", 1, 7, amount, T0 + dt.timedelta(hours=n - 1, seconds=i), "online") for i in range(last_count)]

    count = lambda part: wd.merchant_anomalies(spark.createDataFrame(part, SCHEMA)).count()
    assert count(hours(24, 9)) == 0
    # 25 hours: the mean of the last 24 is (23 + c) / 24, so c = 4 is above three times it and c = 3 is not
    assert count(hours(25, 3)) == 0 and count(hours(25, 4)) == 1
    assert count(hours(26, 4)) == 1
    assert count(hours(26, 1, 80.0)) == 1 and count(hours(26, 1, 55.0)) == 0


def test_duplicates_across_batches(spark, tmp_path, batches):
    pattern = land(spark, tmp_path / "in", [*batches[:3], batches[1], batches[0]])
    got = jobs.to_table(jobs.deduplicated(stream(spark, pattern), ["transaction_id"]), str(tmp_path / "o"), str(tmp_path / "oc"))
    assert got.count() == 450 == got.select("transaction_id").distinct().count()


def test_restart_and_repeated_batch_write_once(spark, tmp_path, batches):
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    pattern = land(spark, tmp_path / "in", batches[:3])
    jobs.write_batches(stream(spark, pattern), {"e": lambda b: b}, folder, checkpoint)
    land(spark, tmp_path / "in", [[], [], [], *batches[3:]])
    calls = []

    def failing(batch):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost executor")
        return batch

    with pytest.raises(Exception, match="lost executor"):
        jobs.write_batches(stream(spark, pattern), {"e": failing}, folder, checkpoint)
    jobs.write_batches(stream(spark, pattern), {"e": lambda b: b}, folder, checkpoint)
    got = spark.read.parquet(f"{folder}/e")
    assert got.count() == 900 == got.select("transaction_id").distinct().count()


def test_late_events_go_aside(spark, tmp_path, batches):
    late = [("late", 1, 1, 1.0, T0, "online"), ("fine", 1, 1, 1.0, max(r[4] for r in batches[5]) - dt.timedelta(hours=1), "online")]
    pattern = land(spark, tmp_path / "in", [batches[0], batches[5], late])
    jobs.split_late(stream(spark, pattern), str(tmp_path / "o"), str(tmp_path / "c"), lateness_seconds=2 * 3600)
    assert [r.transaction_id for r in spark.read.parquet(str(tmp_path / "o" / "late")).collect()] == ["late"]
    assert spark.read.parquet(str(tmp_path / "o" / "on_time")).count() == 301


def test_malformed_records_reach_the_ledger(spark, tmp_path):
    good = '{"transaction_id":"a","user_id":"1","amount":5.0,"timestamp":"2024-01-01T00:00:00Z"}'
    spark.createDataFrame([(good,), ("{broken",), ("",), ('{"transaction_id":"b"}',)], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    ok, bad = ss.split_malformed(spark.read.text(str(tmp_path / "in")), ss.EVENT_SCHEMA, F.col("e.amount") > 0)
    assert [r.transaction_id for r in ok.collect()] == ["a"]
    assert bad.count() == 3
    ledger = {r.raw: r for r in jobs.retry_ledger(bad).collect()}
    assert ledger["{broken"].processing_status == "RETRY"
    event = ss.parse_events(spark.read.text(str(tmp_path / "in"))).filter("transaction_id = 'a'").first()
    assert event.ts == T0 and event.currency == "USD" and event.channel == "online"


def test_envelopes_are_reproducible(spark, table):
    a, b = (ss.envelope(table, "transaction").orderBy("value").collect() for _ in range(2))
    assert a == b and len({r.value for r in a}) == 900


def test_sessions_match_brute_force(spark, batches, table):
    """Also with a filter on the bounds; a gap of exactly the session length still joins."""
    exact = [("x1", 9, 1, 1.0, T0, "pos"), ("x2", 9, 2, 1.0, T0 + dt.timedelta(minutes=3), "pos"), ("x3", 9, 2, 1.0, T0 + dt.timedelta(minutes=5, seconds=59), "pos")]
    rows_in = [r for p in batches for r in p] + exact
    got = wd.window_aggregates(spark.createDataFrame(rows_in, SCHEMA), F.session_window("ts", "3 minutes"), ["user_id"], session="3 minutes")
    border = T0 + dt.timedelta(hours=3)
    expected = []
    for user in {r[1] for r in rows_in}:
        current = []
        for r in [*sorted((r for r in rows_in if r[1] == user), key=lambda r: r[4]), None]:
            if current and (r is None or r[4] - current[-1][4] > dt.timedelta(minutes=3)):
                expected.append((user, current[0][4], current[-1][4] + dt.timedelta(minutes=3), len(current), len({c[2] for c in current})))
                current = []
            if r:
                current.append(r)
    columns = ["user_id", "window_start", "window_end", "event_count", "unique_merchants"]
    assert rows(got, *columns) == sorted(expected)
    assert rows(got.filter(F.col("window_end") < F.lit(border)), *columns) == sorted(e for e in expected if e[2] < border)


def test_detectors_do_not_depend_on_batch_borders(spark, tmp_path):
    """The same events in one file and in many: equal results, over idle times longer than the default expiry."""
    rng = np.random.RandomState(3)
    at = sorted(rng.choice(40_000, 60, replace=False).tolist())
    events = [(f"e{i:03d}", i % 3, i % 2, float(i), T0 + dt.timedelta(seconds=s), "web") for i, s in enumerate(at)]
    jobs_of = {
        "velocity": lambda s: jobs.user_velocity_stream(s, "1 minute", 21_600, 2),
        "features": lambda s: jobs.running_features_stream(s, "1 minute", 21_600),
        "counters": lambda s: jobs.expiring_counters(s, "1 minute", "30 minutes"),
    }
    for name, build in jobs_of.items():
        found = []
        for label, size in (("one", 60), ("many", 7)):
            parts = [events[i : i + size] for i in range(0, 60, size)]
            src = stream(spark, land(spark, tmp_path / f"{name}-{label}", parts))
            found.append(rows(jobs.to_table(build(src), str(tmp_path / f"{name}-{label}-out"), str(tmp_path / f"{name}-{label}-c"))))
        assert found[0] == found[1] and found[0], name


def test_progress_raises_rather_than_forgets(spark):
    class Run:
        recentProgress = [None] * int(spark.conf.get("spark.sql.streaming.numRecentProgressUpdates"))

    with pytest.raises(ValueError):
        jobs.progress_table(spark, Run)
    with pytest.raises(ValueError):
        jobs.late_rows(Run)


def test_progress_log_keeps_more_batches_than_the_query(spark, tmp_path, batches):
    src = stream(spark, land(spark, tmp_path / "in", batches))
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        with jobs.ProgressLog(spark, str(tmp_path / "progress"), group=4) as log:
            runs = [jobs.write_batches(src, {"e": lambda b: b}, str(tmp_path / f"out{k}"), str(tmp_path / f"c{k}")) for k in range(2)]
            logged = [log.rows(run) for run in runs]
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    for run, found in zip(runs, logged):
        assert len(run.recentProgress) <= 2
        assert [(r.batch_id, r.input_rows) for r in found.where("input_rows > 0").orderBy("batch_id").collect()] == [(k, 150) for k in range(6)]
        m = jobs.run_metrics(found).first()
        latencies = [r.latency_ms for r in found.collect()]
        assert m.events_processed == 900 and (m.latency_min_ms, m.latency_max_ms) == (min(latencies), max(latencies))
        assert m.latency_mean_ms == pytest.approx(sum(latencies) / len(latencies))


def test_state_of_windows_is_by_group_of_keys(spark, tmp_path):
    """Many keys of a window share rows of state; missing and odd values give the rows of the batch plan."""
    made = [(f"e{k:05d}", None if k % 97 == 0 else k % 3000, None if k % 11 == 0 else k % 7, None if k % 13 == 0 else float("nan") if k % 501 == 0 else k % 90 / 10, T0 + dt.timedelta(seconds=k % 600), None if k % 17 == 0 else ["online", "pos", "other"][k % 3]) for k in range(6000)]
    made += [("late", None, 1, 1.0, None, "pos"), ("last", 1, 1, 1.0, T0 + dt.timedelta(hours=2), "pos")]
    for i in range(3):
        spark.createDataFrame(made[i::3], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{i}")
    src = stream(spark, f"{tmp_path}/in/part*").withWatermark("ts", "3 hours")
    window = F.window("ts", "10 minutes", "2 minutes")
    out = wd.window_aggregates(src, window, ["user_id"])
    # the watermark stays behind until the event of a second run
    folder, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    query = jobs.run_available(out.writeStream.outputMode("append").format("parquet").option("path", folder), checkpoint)
    held = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators)
    assert held <= 10 * wd.GROUPS
    spark.createDataFrame([("end", 1, 1, 1.0, T0 + dt.timedelta(hours=9), "pos")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part9")
    got = jobs.to_table(out, folder, checkpoint)
    want = wd.window_aggregates(spark.createDataFrame(made, SCHEMA), window, ["user_id"])
    entries = F.array_sort(F.map_entries("channel_distribution")).cast("string")
    plain = lambda df: [tuple(map(str, r)) for r in rows(df.withColumn("channel_distribution", entries))]
    assert plain(got) == plain(want) and len(plain(got)) > 10000


def test_a_group_may_go_on_in_the_next_batch(spark, tmp_path):
    spark.createDataFrame([(f"e{k}", k % 5, k % 7, float(k % 9), T0 + dt.timedelta(seconds=k % 50), "pos") for k in range(1000)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part0")
    spark.createDataFrame([("end", 1, 1, 1.0, T0 + dt.timedelta(hours=9), "pos")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part1")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        src = stream(spark, f"{tmp_path}/in/part*").withWatermark("ts", "1 minute")
        got = jobs.to_table(wd.window_aggregates(src, F.window("ts", "1 minute"), ["user_id"]), str(tmp_path / "out"), str(tmp_path / "c"))
        assert sorted((r.user_id, r.event_count, r.unique_merchants) for r in got.collect()) == [(u, 200, 7) for u in range(5)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_sliding_query_has_a_window_every_minute(spark, tmp_path):
    """STR-2: an event lies in each of the ten windows that begin in the ten minutes up to it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ledgerwatch.adapters import Tables
    from ledgerwatch.plans import streams

    made = [(1, 7, T0 + dt.timedelta(minutes=20, seconds=30), "view", 5.0, "{}"), (2, 8, T0 + dt.timedelta(hours=3), "view", 1.0, "{}")]
    named = pa.table([pa.array(c) for c in zip(*made)], names=["event_id", "user_id", "ts", "event_type", "value", "props"])
    pq.write_table(named, tmp_path / "events.parquet")
    got = streams.str_2(Tables(spark, str(tmp_path))).where("user_id = 7").collect()
    assert sorted(r.window_start for r in got) == [T0 + dt.timedelta(minutes=m) for m in range(11, 21)]
    assert all(r.window_end - r.window_start == dt.timedelta(minutes=10) and r.event_count == 1 for r in got)
