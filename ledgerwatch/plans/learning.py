"""Model, evaluation, ensemble and selection queries."""

from pyspark.sql import functions as F

from ledgerwatch.operators import ensembles as en
from ledgerwatch.operators import evaluation as ev
from ledgerwatch.operators import learning as ln
from ledgerwatch.operators import selection as sel
from ledgerwatch.plans.aggregates import evaluations
from ledgerwatch.plans.registry import cte, query
from ledgerwatch.sources.files import scratch, written

USED = ["amount", "fraud_score", "latitude", "longitude", "processing_time_ms", "hour_of_day", "day_of_week", "is_weekend", "is_business_hour"]


def training(t):
    return ln.training_frame(t.tx_place, days=None, limit=100_000)


def everything(t):
    """All transactions with the training features (no newest-rows cap)."""
    return ln.training_frame(t.tx_place, days=None, limit=None)


cte("train", """
SELECT transaction_id, ts, amount, fraud_score, latitude, longitude, 0e0 AS is_vpn, 0e0 AS is_tor, 0e0 AS confidence_score, CAST(processing_time_ms AS DOUBLE) AS processing_time_ms, CAST(hour(ts) AS DOUBLE) AS hour_of_day,
  CAST(dayofweek(ts) AS DOUBLE) AS day_of_week, CASE WHEN dayofweek(ts) IN (0, 6) THEN 1e0 ELSE 0e0 END AS is_weekend, CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1e0 ELSE 0e0 END AS is_business_hour,
  CAST(is_fraud AS INTEGER) AS label FROM tx
""")
cte("pred", """
SELECT transaction_id, ts, is_fraud, fraud_score AS m1, (CAST(substr(transaction_id, 4) AS BIGINT) * 29 % 1000) / 1000e0 AS m2, 0.3e0 + fraud_score * 0.4e0 AS m3 FROM tx
""")


def predictions(t):
    """Three model scores per transaction in a map."""
    number = F.substring("transaction_id", 4, 20).cast("long")
    scores = F.create_map(
        F.lit("forest"), F.col("fraud_score"), F.lit("linear"), number * 29 % 1000 / 1000.0, F.lit("boosted"), F.lit(0.3) + F.col("fraud_score") * 0.4
    )
    return t.tx_slim.select("transaction_id", "ts", "is_fraud", scores.alias("scores"))


WEIGHTS = {"forest": 0.5, "linear": 0.2, "boosted": 0.3}


@query("ML-1", uses="tx train", rounded="amount latitude longitude processing_time_ms hour_of_day day_of_week is_weekend is_business_hour fraud_score is_vpn is_tor confidence_score", sql="""
SELECT * EXCLUDE (ts) FROM train ORDER BY ts DESC, transaction_id DESC LIMIT 100000
""")
def ml_1(t):
    return training(t).drop("ts")


cte("parts", "SELECT *, CAST('0x' || substr(md5('42|' || transaction_id), 1, 8) AS BIGINT) % 10000 < 8000 AS is_train FROM train")


@query("ML-2", uses="tx train parts", sql="SELECT label, is_train, COUNT(*) AS n FROM parts GROUP BY 1, 2")
def ml_2(t):
    return ev.split_by_hash(everything(t)).groupBy("label", "is_train").agg(F.count(F.lit(1)).alias("n"))


@query("ML-3")
def ml_3(t):
    """Forest, logistic regression and boosted trees on a held-out part (MLlib fits)."""
    return ln.compare_models(training(t), USED, ln.classifiers(10, 5))


@query("ML-4")
def ml_4(t):
    """Isolation forest over all transactions: counts by anomaly flag and label (seeded samples)."""
    rows = everything(t)
    forest = ln.IsolationForest(rows, USED, trees=50)
    return forest.predict(rows).groupBy("is_anomaly", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("probability"))


@query("ML-5")
def ml_5(t):
    """Linear support vectors with calibrated probabilities (MLlib fit)."""
    scored = ln.CalibratedSVM(training(t), USED, 20).score(everything(t))
    return ev.evaluate(scored)


METRICS = """
WITH c AS (SELECT category, COUNT(*) AS total, COUNT(*) FILTER (WHERE fraud_score > 0.5 AND is_fraud) AS tp, COUNT(*) FILTER (WHERE fraud_score <= 0.5 AND NOT is_fraud) AS tn,
  COUNT(*) FILTER (WHERE fraud_score > 0.5 AND NOT is_fraud) AS fp, COUNT(*) FILTER (WHERE fraud_score <= 0.5 AND is_fraud) AS fn,
  -AVG(CASE WHEN is_fraud THEN ln(GREATEST(1e-15, LEAST(1 - 1e-15, fraud_score))) ELSE ln(1 - GREATEST(1e-15, LEAST(1 - 1e-15, fraud_score))) END) AS log_loss FROM tx GROUP BY 1),
a AS (SELECT category, SUM(p * (b - n / 2)) / (SUM(p) * SUM(n)) AS auc_roc FROM (SELECT category, fraud_score, p, n, SUM(n) OVER (PARTITION BY category ORDER BY fraud_score) AS b FROM (
  SELECT category, fraud_score, COUNT(*) FILTER (WHERE is_fraud) AS p, COUNT(*) FILTER (WHERE NOT is_fraud) AS n FROM tx GROUP BY 1, 2)) GROUP BY 1)
SELECT category, total, tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, log_loss, (tp + tn) / total AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall,
  2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1_score, auc_roc FROM c JOIN a USING (category)
"""


@query("ML-6", uses="tx", rounded="log_loss accuracy precision recall f1_score auc_roc", sql=METRICS)
def ml_6(t):
    return ev.evaluate(t.tx_slim.select("category", F.col("fraud_score").alias("score"), F.col("is_fraud").alias("label")), ["category"])


@query("ML-7")
def ml_7(t):
    """Three-fold cross-validation of logistic regression (MLlib fits)."""
    folds = ln.cross_validate(training(t), USED, ln.classifiers()["logistic_regression"])
    return folds.agg(F.avg("f1_score").alias("f1_mean"), F.stddev_pop("f1_score").alias("f1_std"), F.avg("auc_roc").alias("auc_mean"), F.count(F.lit(1)).alias("folds"))


@query("ML-8")
def ml_8(t):
    """Grid search of logistic regression (MLlib fits)."""
    model = ln.classifiers()["logistic_regression"]
    return ln.tune(training(t), USED, model, {"regParam": [0.001, 0.1]}, folds=2)[1]


@query("ML-9", uses="tx pred", rounded="weighted voting dynamic stacking", sql="""
SELECT transaction_id, m1 * 0.5 + m2 * 0.2 + m3 * 0.3 AS weighted, (CAST(m1 > 0.5 AS INTEGER) + CAST(m2 > 0.5 AS INTEGER) + CAST(m3 > 0.5 AS INTEGER)) / 3 AS voting,
  CASE WHEN w1 + w2 + 0.1e0 > 0 THEN (m1 * w1 + m2 * w2 + m3 * 0.1e0) / (w1 + w2 + 0.1e0) ELSE 0 END AS dynamic, m1 * 0.5 + m2 * 0.2 + m3 * 0.3 AS stacking
FROM (SELECT *, 0.8e0 * abs(m1 - 0.5e0) * 2 AS w1, 0.6e0 * abs(m2 - 0.5e0) * 2 AS w2 FROM pred)
""")
def ml_9(t):
    s = F.col("scores")
    return predictions(t).select(
        "transaction_id", en.weighted_average(s, WEIGHTS).alias("weighted"), en.voting(s).alias("voting"),
        en.dynamic(s, {"forest": 0.8, "linear": 0.6, "boosted": 0.9}, {"boosted": False}).alias("dynamic"), en.stacking(s, WEIGHTS).alias("stacking"),
    )


def _pop(a, b, c):
    return f"sqrt(((({a}) - (({a}) + ({b}) + ({c})) / 3) ** 2 + (({b}) - (({a}) + ({b}) + ({c})) / 3) ** 2 + (({c}) - (({a}) + ({b}) + ({c})) / 3) ** 2) / 3)"


C1, C2, C3 = (f"(abs(m{i} - 0.5e0) * 2)" for i in (1, 2, 3))


@query("ML-10", uses="tx pred", rounded="confidence agreement mean_confidence min_confidence max_confidence confidence_std", sql=f"""
SELECT transaction_id, 1 / (1 + {_pop('m1 * 0.5e0', 'm2 * 0.2e0', 'm3 * 0.3e0')} ** 2) AS confidence, GREATEST(0, 1 - {_pop('m1', 'm2', 'm3')} * 2) AS agreement, ({C1} + {C2} + {C3}) / 3 AS mean_confidence,
  LEAST({C1}, {C2}, {C3}) AS min_confidence, GREATEST({C1}, {C2}, {C3}) AS max_confidence, {_pop(C1, C2, C3)} AS confidence_std FROM pred
""")
def ml_10(t):
    s = F.col("scores")
    return predictions(t).select(
        "transaction_id", en.ensemble_confidence(s, WEIGHTS).alias("confidence"), en.agreement(s).alias("agreement"), en.confidence_stats(s).alias("c")
    ).select("transaction_id", "confidence", "agreement", "c.*")


@query("ML-11", uses="tx pred", sql="""
SELECT transaction_id, CASE WHEN m1 >= 0.8e0 * f THEN 'CRITICAL' WHEN m1 >= 0.6e0 * f THEN 'HIGH' WHEN m1 >= 0.4e0 * f THEN 'MEDIUM' WHEN m1 >= 0.2e0 * f THEN 'LOW' ELSE 'MINIMAL' END AS risk_level,
  CASE WHEN m1 >= 0.8e0 * f THEN 'DECLINED' WHEN m1 >= 0.4e0 * f THEN 'REVIEW' ELSE 'APPROVED' END AS decision FROM (SELECT *, GREATEST(0.5e0, m2) AS f FROM pred)
""")
def ml_11(t):
    s = F.col("scores")
    return predictions(t).select("transaction_id", en.scaled_decision(s["forest"], s["linear"]).alias("d")).select("transaction_id", "d.*")


@query("ML-12", uses="tx pred", rounded="first_contribution", sql=f"""
SELECT transaction_id, (SELECT string_agg(n, '>' ORDER BY c DESC, n) FROM (VALUES ('forest', m1 * 0.5e0), ('linear', m2 * 0.2e0), ('boosted', m3 * 0.3e0)) v(n, c)) AS models, GREATEST(m1 * 0.5e0, m2 * 0.2e0, m3 * 0.3e0) AS first_contribution,
  concat_ws('|', CASE WHEN GREATEST(0, 1 - {_pop('m1', 'm2', 'm3')} * 2) < 0.5 THEN 'models disagree' END, CASE WHEN ({C1} + {C2} + {C3}) / 3 < 0.6 THEN 'models are unsure' END,
   CASE WHEN CAST(m1 > 0.7 AS INTEGER) + CAST(m2 > 0.7 AS INTEGER) + CAST(m3 > 0.7 AS INTEGER) > 1.5 THEN 'most models see a high risk' END) AS messages FROM pred
""")
def ml_12(t):
    s = F.col("scores")
    return predictions(t).select("transaction_id", en.top_models(s, WEIGHTS).alias("m"), en.risk_messages(s).alias("r")).select(
        "transaction_id", F.array_join(F.transform("m", lambda e: e["model_name"]), ">").alias("models"),
        F.get("m", F.lit(0))["contribution"].alias("first_contribution"), F.array_join("r", "|").alias("messages"),
    )


def model_values(t):
    e = F.col("event_id")
    return t.raw("events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("model_"), (e % 3).cast("string")).alias("model_name"),
        F.least(F.lit(1.0), F.col("value") / 50.0).alias("value"), e.alias("evaluation_id"),
    )


@query("ML-13", uses="", rounded="performance weight", sql="""
WITH v AS (SELECT 'model_' || CAST(event_id % 3 AS VARCHAR) AS model_name, LEAST(1e0, value / 50) AS value, ROW_NUMBER() OVER (PARTITION BY event_id % 3 ORDER BY ts DESC, event_id DESC) AS r FROM events),
m AS (SELECT model_name, GREATEST(SUM(value * pow(0.95e0, r - 1)) / SUM(pow(0.95e0, r - 1)), 0.05e0) AS performance FROM v GROUP BY 1)
SELECT model_name, performance, GREATEST(0.05e0, LEAST(0.5e0, performance / (SELECT SUM(performance) FROM m))) AS weight FROM m
""")
def ml_13(t):
    return en.decayed_weights(model_values(t))


cte("modelled", "SELECT category AS model_name, ts, transaction_id, fraud_score AS score, is_fraud FROM tx")


@query("ML-14", uses="tx modelled", rounded="drift_score", sql="""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY ts DESC, transaction_id DESC) AS r FROM modelled QUALIFY r <= 1000), n AS (SELECT *, COUNT(*) OVER (PARTITION BY model_name) AS n FROM r)
SELECT model_name, COUNT(*) AS predictions, CASE WHEN COUNT(*) >= 100 THEN LEAST(1, abs(AVG(score) FILTER (WHERE r > n - n // 2) - AVG(score) FILTER (WHERE r <= n - n // 2))) ELSE 0 END AS drift_score FROM n GROUP BY 1
""")
def ml_14(t):
    return ev.drift(t.tx_slim.select(F.col("category").alias("model_name"), "ts", "transaction_id", F.col("fraud_score").alias("score")))


@query("ML-15", uses="tx modelled", rounded="accuracy", sql="""
WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY ts DESC, transaction_id DESC) AS r FROM modelled QUALIFY r <= 1000), n AS (SELECT *, COUNT(*) OVER (PARTITION BY model_name) AS n FROM r),
d AS (SELECT model_name, abs(AVG(score) FILTER (WHERE r > n - n // 2) - AVG(score) FILTER (WHERE r <= n - n // 2)) AS drift FROM n GROUP BY 1),
a AS (SELECT model_name, AVG(CASE WHEN (score > 0.95) = is_fraud THEN 1e0 ELSE 0e0 END) AS accuracy FROM modelled GROUP BY 1)
SELECT model_name, accuracy, accuracy > 0.8 AND drift < 0.1 AS is_healthy FROM a JOIN d USING (model_name)
""")
def ml_15(t):
    rows = t.tx_slim.select(F.col("category").alias("model_name"), "ts", "transaction_id", F.col("fraud_score").alias("score"), F.col("is_fraud").alias("label"))
    quality = ev.evaluate(rows, ["model_name"], threshold=0.95).select("model_name", "accuracy")
    return quality.join(ev.drift(rows), "model_name").select("model_name", "accuracy", ev.healthy(F.col("accuracy"), F.col("drift_score")).alias("is_healthy"))


ARM = "CASE WHEN CAST('0x' || substr(md5('exp1|' || transaction_id), 1, 8) AS BIGINT) % 1000000 < 500000 THEN 'A' ELSE 'B' END"


@query("ML-16", uses="tx", sql=f"SELECT transaction_id, {ARM} AS arm FROM tx")
def ml_16(t):
    return t.tx_slim.select("transaction_id", ev.assign_arm("transaction_id", "exp1").alias("arm"))


@query("ML-17", uses="tx", rounded="accuracy_a accuracy_b t_stat", sql=f"""
WITH r AS (SELECT category AS test_id, {ARM} AS arm, CASE WHEN (CASE WHEN {ARM} = 'A' THEN fraud_score ELSE fraud_score * 0.6e0 END > 0.5e0) = is_fraud THEN 1e0 ELSE 0e0 END AS ok FROM tx),
g AS (SELECT test_id, COUNT(*) FILTER (WHERE arm = 'A') AS n_a, COUNT(*) FILTER (WHERE arm = 'B') AS n_b, AVG(ok) FILTER (WHERE arm = 'A') AS accuracy_a, AVG(ok) FILTER (WHERE arm = 'B') AS accuracy_b,
  VAR_SAMP(ok) FILTER (WHERE arm = 'A') AS va, VAR_SAMP(ok) FILTER (WHERE arm = 'B') AS vb FROM r GROUP BY 1),
t AS (SELECT *, (accuracy_a - accuracy_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1 / n_a + 1 / n_b)) AS t_stat FROM g)
SELECT test_id, n_a, n_b, accuracy_a, accuracy_b, t_stat, CASE WHEN abs(t_stat) < 1.9615 THEN 'inconclusive' WHEN accuracy_a > accuracy_b THEN 'A' ELSE 'B' END AS winner FROM t
""")
def ml_17(t):
    arm = ev.assign_arm("transaction_id", "exp1")
    rows = t.tx_slim.select(
        F.col("category").alias("test_id"), arm.alias("arm"), F.when(arm == "A", F.col("fraud_score")).otherwise(F.col("fraud_score") * 0.6).alias("score"), F.col("is_fraud").alias("label"),
    )
    return ev.ab_result(rows).select("test_id", "n_a", "n_b", "accuracy_a", "accuracy_b", "t_stat", "winner")


LINEAR = {"amount": 0.0001, "fraud_score": 2.0, "processing_time_ms": -0.002}
SECOND = {"amount": 0.0002, "fraud_score": -0.5, "processing_time_ms": 0.001}
cte("contrib", """
SELECT transaction_id, 0.0001e0 * (amount - (SELECT AVG(amount) FROM tx)) AS a, 2e0 * (fraud_score - (SELECT AVG(fraud_score) FROM tx)) AS f, -0.002e0 * (processing_time_ms - (SELECT AVG(processing_time_ms) FROM tx)) AS p,
  0.0002e0 * (amount - (SELECT AVG(amount) FROM tx)) AS a2, -0.5e0 * (fraud_score - (SELECT AVG(fraud_score) FROM tx)) AS f2, 0.001e0 * (processing_time_ms - (SELECT AVG(processing_time_ms) FROM tx)) AS p2 FROM tx
""")


@query("ML-18", uses="tx contrib", rounded="positive_contribution negative_contribution net_contribution", sql="""
SELECT transaction_id, GREATEST(a, 0) + GREATEST(f, 0) + GREATEST(p, 0) AS positive_contribution, LEAST(a, 0) + LEAST(f, 0) + LEAST(p, 0) AS negative_contribution, a + f + p AS net_contribution,
  CASE WHEN abs(a) >= abs(f) AND abs(a) >= abs(p) THEN 'amount' WHEN abs(f) >= abs(p) THEN 'fraud_score' ELSE 'processing_time_ms' END AS top_feature,
  CASE WHEN CASE WHEN abs(a) >= abs(f) AND abs(a) >= abs(p) THEN a WHEN abs(f) >= abs(p) THEN f ELSE p END > 0 THEN 'raises the score' ELSE 'lowers the score' END AS impact FROM contrib
""")
def ml_18(t):
    return en.explanation_summary(en.linear_attribution(t.tx_slim, LINEAR)).drop("top_features", "explanation")


@query("ML-18-trees")
def ml_18_trees(t):
    """Path contributions of a forest: mean absolute contribution per feature (MLlib fit)."""
    rows = everything(t)
    model = ln.train(training(t), USED, ln.classifiers(5, 4)["random_forest"])
    from pyspark.ml.functions import vector_to_array

    scaled = model.transform(rows).withColumn("_f", vector_to_array("features"))
    wide = scaled.select("transaction_id", *[F.col("_f")[i].alias(c) for i, c in enumerate(USED)])
    return ln.tree_contributions(model.stages[-1], wide, USED, scratch(t.spark, "forest")).groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_contribution"), F.count(F.lit(1)).alias("n")
    )


@query("ML-19", uses="tx contrib", rounded="amount fraud_score processing_time_ms agreement_score", sql="""
SELECT transaction_id, (a * 0.6e0 + a2 * 0.4e0) AS amount, (f * 0.6e0 + f2 * 0.4e0) AS fraud_score, (p * 0.6e0 + p2 * 0.4e0) AS processing_time_ms, CASE WHEN t1 = t2 THEN t1 ELSE '' END AS consensus, CASE WHEN t1 = t2 THEN 1e0 ELSE 0e0 END AS agreement_score
FROM (SELECT *, CASE WHEN abs(a) >= abs(f) AND abs(a) >= abs(p) THEN 'amount' WHEN abs(f) >= abs(p) THEN 'fraud_score' ELSE 'processing_time_ms' END AS t1,
  CASE WHEN abs(a2) >= abs(f2) AND abs(a2) >= abs(p2) THEN 'amount' WHEN abs(f2) >= abs(p2) THEN 'fraud_score' ELSE 'processing_time_ms' END AS t2 FROM contrib)
""")
def ml_19(t):
    rows = en.linear_attribution(t.tx_slim, LINEAR, model="first").unionByName(en.linear_attribution(t.tx_slim, SECOND, model="second"))
    blended = en.ensemble_attribution(rows, {"first": 0.6, "second": 0.4})
    wide = blended.groupBy("transaction_id").pivot("feature", list(LINEAR)).agg(F.first("contribution"))
    agreed = en.consensus(rows, top=1).select("transaction_id", F.array_join("consensus_features", "|").alias("consensus"), "agreement_score")
    return wide.join(agreed, "transaction_id")


@query("ML-20", uses="evaluations", rounded="accuracy f1_score", sql="""
SELECT ts, model_name, accuracy, f1_score FROM evaluations WHERE model_name = 'model_1' AND ts > (SELECT MAX(ts) FROM evaluations) - INTERVAL 3 DAY
""")
def ml_20(t):
    return ev.history(evaluations(t), "model_1", 3).select("ts", "model_name", "accuracy", "f1_score")


@query("ML-21", uses="evaluations", rounded="accuracy f1_score inference_time_ms", sql="""
SELECT model_name, COUNT(*) AS points, AVG(accuracy) AS accuracy, AVG(f1_score) AS f1_score, AVG(inference_time_ms) AS inference_time_ms, MIN(ts) AS first_ts, MAX(ts) AS last_ts
FROM evaluations WHERE ts > (SELECT MAX(ts) FROM evaluations) - INTERVAL 24 HOUR GROUP BY 1
""")
def ml_21(t):
    return ev.rolling_points(evaluations(t))


@query("ML-22")
def ml_22(t):
    """All transactions scored by two fitted models and blended (MLlib fits)."""
    fitted = {n: ln.train(training(t), USED, m) for n, m in ln.classifiers(10, 4).items() if n != "boosted_trees"}
    rows = everything(t)
    for name, model in fitted.items():
        rows = ln.score(model, rows, f"score_{name}")
    scores = F.create_map(*[x for n in fitted for x in (F.lit(n), F.col(f"score_{n}"))])
    blended = rows.withColumn("scores", scores).withColumn("probability", en.weighted_average(F.col("scores"), {"random_forest": 0.6, "logistic_regression": 0.4}))
    decided = blended.withColumn("d", en.scaled_decision(F.col("probability"), en.confidence_of(F.col("probability"))))
    return decided.groupBy("d.risk_level", "d.decision").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("probability"))


# ---- clusters, decompositions, selection ----------------------------------------------------

@query("FEA-16")
def fea_16(t):
    """K-means features of the embeddings and density clusters of three transaction features (iterative fits)."""
    sizes = (5, 10, 20)
    vectors = ln.cluster_features(t.raw("embeddings"), "embedding", sizes, max_iter=20)
    fits = F.explode(F.array(*[
        F.struct(F.lit(f"kmeans_{k}").alias("kind"), F.col(f"kmeans_cluster_{k}").cast("string").alias("cluster"), F.col(f"kmeans_distance_ratio_{k}").alias("r"))
        for k in sizes
    ])).alias("f")
    k = vectors.select(fits).groupBy("f.kind", "f.cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("f.r").alias("ratio"))
    d = ln.density_features(t.tx_place.select("transaction_id", "latitude", "longitude"), ["latitude", "longitude"], 0.05, 5)
    return k.unionByName(
        d.groupBy(F.lit("dbscan").alias("kind"), F.col("dbscan_cluster").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.avg("is_dbscan_outlier").alias("ratio"))
    )


def component_variance(df, name, k):
    return df.select("vec_id", F.posexplode(name).alias("component", "value")).groupBy("component").agg(
        F.var_pop("value").alias("variance"), F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")
    )


@query("FEA-17")
def fea_17(t):
    """Variance of the principal components of the embeddings."""
    return component_variance(ln.pca_features(t.raw("embeddings"), "embedding", 10)[0], "pca", 10)


@query("FEA-18")
def fea_18(t):
    """Variance of the independent components of the embeddings."""
    return component_variance(ln.ica_features(t.raw("embeddings"), "embedding", 5, 15), "ica", 5)


@query("FEA-19")
def fea_19(t):
    """Variance of the singular components of the embeddings."""
    return component_variance(ln.svd_features(t.raw("embeddings"), "embedding", 5)[0], "svd", 5)


CHOSEN = ["amount", "fraud_score", "latitude", "hour_of_day", "is_business_hour"]


def _anova(c):
    return (f"SELECT '{c}' AS feature, (SUM(n * (m - g) ** 2) / 1) / (SUM(n * v) / (SUM(n) - 2)) AS score FROM (SELECT label, COUNT(*) AS n, AVG({c}) AS m, VAR_POP({c}) AS v, ANY_VALUE(g) AS g FROM train, (SELECT AVG({c}) AS g FROM train) GROUP BY 1)")


def _mi(c):
    return (f"SELECT '{c}' AS feature, SUM(n / t * ln(n * t / (nb * ny))) AS score FROM (SELECT n, SUM(n) OVER () AS t, SUM(n) OVER (PARTITION BY b) AS nb, SUM(n) OVER (PARTITION BY y) AS ny FROM ("
            f"SELECT LEAST(GREATEST(CAST(FLOOR(({c} - lo) / ((hi - lo) / 10)) AS BIGINT), 0), 9) AS b, label AS y, COUNT(*) AS n FROM train, (SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM train) GROUP BY 1, 2))")


def _corr(c):
    others = ", ".join(f"abs(corr({c}, {o}))" for o in CHOSEN if o != c)
    return f"SELECT '{c}' AS feature, 1 - GREATEST({others}) AS score FROM train"


@query("FEA-21", uses="tx train", rounded="score", places=4, sql=" UNION ALL ".join(
    [f"SELECT 'variance' AS method, '{c}' AS feature, VAR_SAMP({c}) AS score, VAR_POP({c}) > 0.01 AS selected FROM train" for c in CHOSEN]
    + [f"SELECT 'correlation', feature, score, true FROM ({_corr(c)})" for c in CHOSEN]
    + [f"SELECT 'anova', feature, score, true FROM ({_anova(c)})" for c in CHOSEN]
    + [f"SELECT 'mutual_information', feature, score, true FROM ({_mi(c)})" for c in CHOSEN]
))
def fea_21(t):
    rows = everything(t).select("label", *CHOSEN)
    parts = {
        "variance": sel.by_variance(rows, CHOSEN), "correlation": sel.by_correlation(rows, CHOSEN),
        "anova": sel.by_anova(rows, CHOSEN), "mutual_information": sel.by_mutual_information(rows, CHOSEN),
    }
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("method", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def selectable(t):
    """Rows to fit and to measure, all rows both, written once: each pass of a fit would else join and broadcast the tables again."""
    rows = written(everything(t).select("transaction_id", "label", *CHOSEN), "selectable")
    return rows, rows


@query("FEA-21-models")
def fea_21_models(t):
    """Selection by forest, lasso, elimination and principal components (MLlib fits)."""
    fit, rows = selectable(t)
    parts = {
        "random_forest_importance": sel.by_forest(fit, CHOSEN, 3, 5, 4), "lasso": sel.by_lasso(rows, CHOSEN, grid=(0.001, 0.01), folds=2),
        "rfe": sel.by_elimination(fit, CHOSEN, keep=4, step=1, trees=5, depth=3), "pca": sel.by_components(rows, CHOSEN, 3),
    }
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("method", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("FEA-22")
def fea_22(t):
    """Combined selection with cross-validated accuracy and the correlations of the chosen features (MLlib fits)."""
    _, rows = selectable(t)
    chosen = sel.combined(rows, CHOSEN, ["correlation_filter", "random_forest_importance", "mutual_information"], 4)
    names = [r["feature"] for r in chosen.filter("selected").orderBy("feature").collect()]
    accuracy = ln.cross_validate(rows, names, ln.classifiers(5, 4)["random_forest"], 2).agg(F.avg("accuracy").alias("score"))
    table = sel.correlation_table(rows, names).select(F.concat_ws("~", "feature_a", "feature_b").alias("feature"), F.col("correlation").alias("score"))
    return (
        chosen.filter("selected").select(F.lit("feature").alias("kind"), "feature", "score")
        .unionByName(accuracy.select(F.lit("cv_accuracy").alias("kind"), F.lit("").alias("feature"), "score"))
        .unionByName(table.select(F.lit("correlation").alias("kind"), "feature", "score"))
    )


@query("FEA-23", uses="", rounded="mean_score last_score", sql="""
SELECT * FROM (SELECT method, feature, AVG(score) AS mean_score, arg_max(score, ts) AS last_score, COUNT(*) AS runs, CAST(ROW_NUMBER() OVER (PARTITION BY method ORDER BY AVG(score) DESC, feature) AS INTEGER) AS place
 FROM (SELECT event_type AS method, 'f' || CAST(event_id % 13 AS VARCHAR) AS feature, value AS score, ts FROM events) GROUP BY 1, 2) WHERE place <= 4
""")
def fea_23(t):
    rows = t.raw("events").select(
        F.col("event_type").alias("method"), F.concat(F.lit("f"), (F.col("event_id") % 13).cast("string")).alias("feature"),
        F.col("value").alias("score"), F.col("ts").cast("timestamp").alias("ts"),
    )
    return sel.importance_history(rows, k=4)
