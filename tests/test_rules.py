"""Boundaries of the rules and ladders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import aggregates as ag
from ledgerwatch.operators import filters as fl
from ledgerwatch.operators import rules as rl
from ledgerwatch.operators import text as tx
from ledgerwatch.operators import anomaly as an

NOON = dt.datetime(2024, 1, 3, 12)


def tx_rows(spark, **columns):
    base = {
        "transaction_id": "t", "user_id": "u1", "merchant_id": "shop", "amount": 50.0, "currency": "USD", "category": "grocery",
        "ts": NOON, "latitude": 10.0, "longitude": 10.0,
    }
    size = max(len(v) for v in columns.values())
    rows = [{**base, "transaction_id": f"t{i}", **{k: v[i] for k, v in columns.items()}} for i in range(size)]
    schema = ", ".join(f"{k} {'double' if k in ('amount', 'latitude', 'longitude') else 'timestamp' if k == 'ts' else 'string'}" for k in base)
    return spark.createDataFrame([tuple(r[k] for k in base) for r in rows], schema)


def column(df, name):
    return [r[0] for r in df.orderBy("transaction_id").select(name).collect()]


def test_amount_steps(spark):
    amounts = [0.99, 1.0, 1000.0, 1000.01, 2000.5, 5000.0, 5000.01]
    got = column(rl.score_batch(tx_rows(spark, amount=amounts)), "fraud_score")
    assert got == pytest.approx([0.4, 0, 0, 0.35, 0.35, 0.35, 0.5])


def test_hours(spark):
    hours = [0, 6, 7, 22, 23]
    rows = tx_rows(spark, ts=[NOON.replace(hour=h) for h in hours])
    assert column(rl.score_batch(rows), "fraud_score") == pytest.approx([0.2, 0.2, 0, 0, 0.2])
    assert column(rows.withColumn("o", rl.off_hours()), "o") == [True, False, False, False, True]


def test_words_currency_place_and_clamp(spark):
    rows = tx_rows(
        spark, merchant_id=["Big Casino 7", "plain", "crypto-unknown"], category=["ATM", "books", "Gambling"], currency=["eur", "jpy", "xxx"],
        user_id=["TestUser", "u", "fake"], latitude=[81.0, 10.0, -85.0], amount=[6000.0, 5.0, 9000.0],
    )
    got = rl.score_batch(rows).orderBy("transaction_id").collect()
    assert got[0].risk_factors == ["very_high_amount", "suspicious_merchant", "suspicious_category", "suspicious_user_pattern", "invalid_location"]
    assert [r.fraud_score for r in got] == pytest.approx([1.0, 0.15, 1.0])
    assert [r.decision for r in got] == ["DECLINED", "APPROVED", "DECLINED"]


def test_missing_values_do_not_break_the_score(spark):
    rows = tx_rows(spark, merchant_id=[None], category=[None], currency=[None], user_id=[None], amount=[None], latitude=[None])
    row = rl.score_batch(rows).first()
    assert row.fraud_score == pytest.approx(0.4) and row.risk_factors == ["micro_transaction"]


def test_ladders(spark):
    scores = [0.19, 0.2, 0.35, 0.39, 0.4, 0.6, 0.79, 0.8]
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    s = F.col("s")
    table = df.select(rl.risk_level(s), rl.batch_decision(s), rl.api_decision(s), rl.stream_level(s), rl.stream_decision(s), rl.risk_rank(rl.risk_level(s))).collect()
    level, batch, api, slevel, stream, rank = (list(c) for c in zip(*table))
    assert level == ["MINIMAL", "LOW", "LOW", "LOW", "MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    assert batch == ["APPROVED", "APPROVED", "REVIEW", "REVIEW", "REVIEW", "DECLINED", "DECLINED", "DECLINED"]
    assert api == ["APPROVED"] * 4 + ["REVIEW"] * 3 + ["DECLINED"]
    assert slevel == ["LOW"] * 4 + ["MEDIUM", "HIGH", "HIGH", "CRITICAL"]
    assert stream == ["APPROVED"] * 5 + ["REVIEW", "REVIEW", "DECLINED"]
    assert rank == [1, 2, 2, 2, 3, 4, 4, 5]


def test_rules_as_data(spark):
    facts = spark.createDataFrame(
        [("a", 10000.0, 12, 0, "standard", 0.0, 9e9, False, 0.1), ("b", 1000.0, 23, 0, "standard", 0.0, 9e9, False, 0.1),
         ("c", 1000.0, 22, 0, "standard", 0.0, 9e9, False, 0.1), ("d", 600.0, 3, 12, "standard", 2000.0, 60.0, True, 0.9),
         ("e", 5.0, 3, 12, "business", 0.0, 9e9, True, None)],
        "transaction_id string, amount double, hour int, transactions_per_hour int, user_type string, distance_from_home double, "
        "time_since_last_tx double, is_new_device boolean, merchant_risk_score double",
    )
    got = {r.transaction_id: (r.rule_name, r.rules_hit) for r in rl.apply_rules(facts, rl.seed_rules(spark)).collect()}
    assert set(got) == {"a", "b", "d"}
    assert got["a"][0] == "high_amount_rule" and got["b"][0] == "unusual_hour_rule"
    assert got["d"] == ("merchant_risk_rule", ["merchant_risk_rule", "geographic_rule", "velocity_rule", "new_device_rule"])


def test_rule_table_has_actions_weights_and_inactive_rules(spark):
    rules = spark.createDataFrame(
        [("small", "THRESHOLD", None, '{"x": {"<": 5}}', '{"action": "flag", "severity": "LOW"}', 2, 0.5, True),
         ("tiny", "THRESHOLD", None, '{"x": {"<": 2}}', "{}", 1, None, None), ("off", "THRESHOLD", None, '{"x": {"<": 99}}', "{}", 0, 1.0, False)],
        rl.RULE_SCHEMA,
    )
    facts = spark.createDataFrame([("a", 1), ("b", 4), ("c", 9)], "transaction_id string, x int")
    got = {r.transaction_id: (r.rule_name, r.action, r.rules_hit, r.rule_weight) for r in rl.apply_rules(facts, rules).collect()}
    assert got == {"a": ("tiny", None, ["tiny", "small"], 1.5), "b": ("small", "flag", ["small"], 0.5)}
    assert rl.apply_rules(facts, rules.limit(0)).collect() == []


def test_rule_range_inside_needs_both_sides(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "x int")
    assert [r.x for r in df.filter(rl.compile_conditions('{"x": {">": 2, "<": 8}}')).collect()] == [5]
    assert [r.x for r in df.filter(rl.compile_conditions('{"x": {"<": 2, ">": 8}}')).collect()] == [1, 9]


def burst(spark, seconds, amounts=None, merchants=None):
    rows = [(f"t{i}", 1, (merchants or [7] * 99)[i], (amounts or [10.0] * 99)[i], NOON + dt.timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "transaction_id string, user_id int, merchant_id int, amount double, ts timestamp")


def test_five_in_three_hundred_seconds(spark):
    assert rl.rapid_fire(burst(spark, [0, 75, 150, 225, 299])).count() == 1
    assert rl.rapid_fire(burst(spark, [0, 75, 150, 225, 300])).count() == 0
    assert rl.rapid_fire(burst(spark, [0, 75, 150, 225, 299], [1.0, 100.0, 5.0, 70.0, 3.0])).count() == 0


def test_merchant_cycling_and_card_testing(spark):
    ten = burst(spark, [60 * i for i in range(10)], merchants=list(range(10)))
    assert [r.merchants for r in rl.merchant_cycling(ten).collect()] == [10]
    nine = burst(spark, [60 * i for i in range(10)], merchants=[0, 1, 2, 3, 4, 5, 6, 7, 8, 0])
    assert rl.merchant_cycling(nine).count() == 0
    assert rl.card_testing(burst(spark, [0, 100, 200, 300, 599], [1.0, 10.0, 2.0, 3.0, 4.0])).count() == 1
    assert rl.card_testing(burst(spark, [0, 100, 200, 300, 600], [1.0, 10.0, 2.0, 3.0, 4.0])).count() == 0
    assert rl.card_testing(burst(spark, [0, 100, 200, 300, 400], [0.99, 10.0, 2.0, 3.0, 10.01])).count() == 0


def test_new_york_to_london_in_an_hour(spark):
    rows = [("a", 1, NOON, 40.7, -74.0), ("b", 1, NOON + dt.timedelta(hours=1), 51.5, -0.1), ("c", 1, NOON + dt.timedelta(hours=1), 51.5, -0.1)]
    df = spark.createDataFrame(rows, "transaction_id string, user_id int, ts timestamp, latitude double, longitude double")
    assert [r.transaction_id for r in rl.geographic_hopping(df).collect()] == ["b"]


def test_binning_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.7,), (1.0,)], "s double")
    got = [r[0] for r in df.select(fl.bin_right_closed(F.col("s"), [0, 0.3, 0.7, 1], ["Low", "Medium", "High"])).collect()]
    assert got == [None, "Low", "Medium", "Medium", "High"]
    assert [r[0] for r in df.select(fl.bin_equal_width(F.col("s"), 0.0, 1.0, 2)).collect()] == [0, 0, 0, 1, 1]


def test_empty_tables_give_empty_or_zero_results(tables):
    none = tables.scored.filter(F.lit(False))
    assert ag.dashboard_kpis(none).first().fraud_rate == 0.0
    assert ag.fraud_stats(none).first().fraud_rate is None
    assert rl.batch_summary(none).first().total_transactions == 0
    assert ag.daily_metrics(none).count() == 0
    assert an.amount_anomalies(none).count() == 0


def test_single_row_group_has_no_deviation(spark):
    from ledgerwatch.operators.features import lifetime_profile, recent_profile

    df = burst(spark, [0]).withColumn("category", F.lit("x"))
    assert lifetime_profile(df).first().amount_std is None
    row = recent_profile(df).first()
    assert row.user_std_amount == 0.0 and row.amount_zscore == 0.0


def test_encryption_round_trip(spark):
    df = spark.createDataFrame([("4111-Abc",)], "card string")
    out = fl.protect(df.withColumns({"h": F.col("card"), "m": F.col("card")}), {"card": "encrypt", "h": "hash", "m": "mask"}, "0123456789abcdef")
    row = out.select("*", fl.reveal(F.col("card"), "0123456789abcdef").alias("back")).first()
    assert row.back == "4111-Abc" and row.card != "4111-Abc" and row.m == "nnnn-Xxx" and len(row.h) == 64


def test_text_analysis_and_highlights(spark):
    df = spark.createDataFrame([(1, "The Running dogs barked; the DOG's house."), (2, "Élan vital, vitals of élan")], "doc_id int, text string")
    got = dict(df.select("doc_id", tx.terms("text")).collect())
    assert got[1] == ["runn", "dog", "bark", "dog", "s", "house"] and got[2] == ["élan", "vital", "vital", "élan"]
    marked = df.select(tx.highlight(F.col("text"), ["vital", "dog"])).collect()
    assert marked[1][0] == "Élan <em>vital</em>, vitals of élan" and "<em>DOG</em>" in marked[0][0]
    assert [r.doc_id for r in tx.search(df, "barking dog").collect()] == [1]
    assert tx.search(df, "of the").count() == 0


def test_trigram_pairs_match_brute_force(spark):
    names = ["acme shop", "acme shops", "shop acme", "acne shop", "zebra", "zebras", "the zebra shop", "x", "coffee house", "coffe house"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    sets = dict(df.select("name", tx.trigrams("name")).collect())
    for least in (0.2, 0.5, 0.8):
        exact = {(a, b) for a in names for b in names if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= least}
        assert {(r.a, r.b) for r in tx.similar_names(df, least).collect()} == exact
    assert tx.trigram_lookup(df, "acme shop", 0.5).first().name == "acme shop"
