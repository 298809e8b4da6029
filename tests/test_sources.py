"""Readers, writers and table maintenance."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ledgerwatch.sources import readers as rd
from ledgerwatch.sources import writers as wr
from ledgerwatch.sources.files import partitions

from .conftest import rows


def test_alias_headers_and_defaults(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,TransactionAmt,ProductCD,isFraud\n7,12.5,gas,1\n8,3.0,food,0\n")
    out = rd.standardise_columns(rd.read_transactions_csv(spark, str(tmp_path / "a.csv"), schema=None))
    assert {"transaction_id", "amount", "category", "is_fraud", "user_id", "merchant_id", "timestamp", "currency"} <= set(out.columns)
    first, again = rows(out), rows(rd.standardise_columns(rd.read_transactions_csv(spark, str(tmp_path / "a.csv"), schema=None)))
    assert first == again and len(first) == 2
    bare = rd.standardise_columns(spark.createDataFrame([(1, "x"), (2, "y")], "n int, note string"))
    assert bare.select("transaction_id").distinct().count() == 2
    assert bare.filter((F.col("amount") < 10) | (F.col("amount") >= 1000)).count() == 0


def test_csv_scan_with_row_cap(spark, tmp_path):
    header = ",".join(c.split()[0] for c in rd.CSV_SCHEMA.split(", "))
    (tmp_path / "t.csv").write_text(header + "\n" + "\n".join(f"t{i},u,{i}.5,USD,m,c,US,2024-01-01T00:00:00,1,2,d,ip,30,high,0,0,0" for i in range(5)))
    assert rd.read_transactions_csv(spark, str(tmp_path / "t.csv"), 3).count() == 3
    assert rd.read_transactions_csv(spark, str(tmp_path / "t.csv")).agg(F.sum("amount")).first()[0] == 12.5


def test_nested_batch(spark, tmp_path):
    body = {"transactions": [{"transactionId": "t1", "userId": "u", "amount": 5.5, "currency": "USD", "merchantId": "m", "timestamp": "2024-01-01T10:00:00Z",
                              "location": {"latitude": 1.5, "longitude": -2.5}, "deviceId": "d", "ipAddress": "10.0.0.1"}, {"transactionId": "t2"}]}
    (tmp_path / "b.json").write_text(json.dumps(body, indent=2))
    got = rd.read_json_batch(spark, str(tmp_path / "b.json")).orderBy("transaction_id").collect()
    assert got[0].ts == dt.datetime(2024, 1, 1, 10) and (got[0].latitude, got[0].longitude) == (1.5, -2.5) and got[1].amount is None


def test_validation_keeps_every_row(spark):
    made = [("a", "u", "m", 5.0, "USD", dt.datetime(2024, 1, 1), 0.5), ("b", None, "m", -50.0, "USD", dt.datetime(2024, 1, 1), 1.5), ("c'; DROP", "u", "m", 0.0, "USD", None, None)]
    df = spark.createDataFrame(made, "transaction_id string, user_id string, merchant_id string, amount double, currency string, ts timestamp, fraud_score double")
    good, bad = rd.validate(df)
    assert [r.transaction_id for r in good.collect()] == ["a"]
    reasons = {r.transaction_id: r.reasons for r in bad.collect()}
    assert reasons["b"] == ["missing user_id", "amount not positive", "fraud_score out of range"]
    assert reasons["c'; DROP"] == ["missing ts", "amount not positive"]


def test_insert_ignore_and_upsert(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 5, 2)], "k string, version int, v int")
    new = spark.createDataFrame([("a", 2, 9), ("b", 4, 9), ("c", 1, 9), ("c", 3, 8)], "k string, version int, v int")
    assert rows(wr.upsert_latest(old, new, ["k"], "version")) == [("a", 2, 9), ("b", 5, 2), ("c", 3, 8)]
    assert rows(wr.insert_ignore(old, new, ["k"])) == [("c", 1, 9)]


def test_partitions_retention_and_compaction(spark, tmp_path, tables):
    path, target = str(tmp_path / "t"), str(tmp_path / "c")
    column = wr.write_partitioned(tables.tx_slim, path, "month")
    before = partitions(spark, path, column)
    table = spark.read.parquet(path)
    one = table.filter(F.col(column) == "1995-03")
    assert "PartitionFilters: [isnotnull(month_of" in one._jdf.queryExecution().toString()
    wr.compact(spark, path, target, column, "1997-01")
    assert spark.read.parquet(target).count() == tables.tx_slim.count()
    gone = wr.expire(spark, path, column, "1996-01")
    assert gone and all(g < "1996-01" for g in gone) and set(partitions(spark, path, column)) == set(before) - set(gone)
    assert spark.read.parquet(path).filter(F.col("ts") < F.lit("1996-01-01").cast("timestamp")).count() == 0


def test_dynamic_overwrite_replaces_only_its_periods(spark, tmp_path, tables):
    path = str(tmp_path / "t")
    wr.write_partitioned(tables.tx_slim, path, "month")
    part = tables.tx_slim.filter(F.date_format("ts", "yyyy-MM") == "1995-03")
    wr.write_partitioned(part.limit(2), path, "month")
    table = spark.read.parquet(path)
    assert table.filter("month_of = '1995-03'").count() == 2
    assert table.count() == tables.tx_slim.count() - part.count() + 2


def test_filter_and_columns_reach_the_scan(tables):
    plan = tables.raw("orders").filter(F.col("o_totalprice") > 1e5).select("o_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,100000.0)]" in plan
    slim = tables.tx_slim.select("transaction_id", "amount")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in slim


def test_refresh_writes_only_changed_partitions(spark, tmp_path):
    path, day = str(tmp_path / "days"), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    kind = "bucket timestamp, n long"
    assert wr.write_partitioned(spark.createDataFrame([(day(n), n) for n in range(150)], kind), path, ts="bucket") == "month_of"
    files = lambda: {v: sorted(p.name for p in (tmp_path / "days" / f"month_of={v}").glob("part-*")) for v in partitions(spark, path, "month_of")}
    before = files()
    fresh = spark.createDataFrame([(day(n), -n) for n in range(50, 58)], kind)
    got = wr.refresh_partitions(path, fresh, "bucket", F.lit(day(50)), F.lit(day(100)))
    want = [(day(n), -n if 50 <= n < 58 else n) for n in range(150) if n < 58 or n >= 100]
    assert sorted((r.bucket, r.n) for r in got.collect()) == want
    after = files()
    assert {v for v in before if after.get(v) == before[v]} == {"2024-01", "2024-05"}
    assert set(before) - set(after) == {"2024-03"}  # lost all its rows
