"""Model operators against plain formulas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators import ensembles as en
from ledgerwatch.operators import evaluation as ev
from ledgerwatch.operators import learning as ln
from ledgerwatch.operators import selection as sel


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.RandomState(0)
    n = 1200
    x = rng.normal(size=(n, 4))
    x[:, 3] = x[:, 0] * 0.999 + rng.normal(size=n) * 0.01
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) * 0.5 > 0).astype(int)
    frame = pd.DataFrame(x, columns=["a", "b", "c", "d"]).assign(label=y, transaction_id=[f"t{i}" for i in range(n)], flat=1.0)
    return spark.createDataFrame(frame).cache(), frame


def test_auc_with_ties_and_single_class(spark):
    rng = np.random.RandomState(1)
    score, label = rng.randint(0, 20, 300) / 20.0, rng.rand(300) < 0.3
    df = spark.createDataFrame([(float(s), bool(y)) for s, y in zip(score, label)], "score double, label boolean")
    wins = sum((p > q) + 0.5 * (p == q) for p in score[label] for q in score[~label])
    assert ev.auc(df).first().auc_roc == pytest.approx(wins / label.sum() / (~label).sum())
    assert ev.evaluate(df.filter("label")).first().auc_roc == 0.5


def test_t_test_p_values():
    # two-sided values of Student's t from published tables
    assert ev.t_test_p(2.228, 10) == pytest.approx(0.05, abs=2e-4)
    assert ev.t_test_p(2.576, 1e6) == pytest.approx(0.01, abs=1e-4)
    assert ev.t_test_p(0.0, 5) == pytest.approx(1.0)
    assert ev.t_test_p(12.706, 1) == pytest.approx(0.05, abs=2e-4)


def test_ab_winner(spark):
    rows = [("x", "A", 0.9, i % 10 != 0) for i in range(400)] + [("x", "B", 0.9, i % 2 == 0) for i in range(400)] + [("y", "A", 0.9, True)] * 5 + [("y", "B", 0.1, True)] * 5
    got = {r.test_id: r for r in ev.ab_result(spark.createDataFrame(rows, "test_id string, arm string, score double, label boolean")).collect()}
    assert got["x"].winner == "A" and got["x"].p_value < 1e-6
    assert got["y"].winner == "inconclusive" and got["y"].p_value == 1.0


def test_forest_learns_and_contributions_add_up(spark, sample, tmp_path):
    df, _ = sample
    features = ["a", "b", "c"]
    quality = {r.model_name: r for r in ln.compare_models(df, features, ln.classifiers(10, 4)).collect()}
    assert all(r.auc_roc > 0.9 for r in quality.values()) and len(quality) == 3
    model = ln.train(df, features, ln.classifiers(5, 3)["random_forest"])
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df).withColumns({"f": vector_to_array("features"), "p": vector_to_array("probability")[1]})
    wide = scored.select("transaction_id", "p", *[F.col("f")[i].alias(c) for i, c in enumerate(features)])
    sums = ln.tree_contributions(model.stages[-1], wide, features, str(tmp_path / "model")).groupBy("transaction_id").agg(F.sum("contribution").alias("s"))
    gaps = wide.join(sums, "transaction_id").select((F.col("p") - F.col("s")).alias("base")).agg(F.stddev("base"), F.avg("base")).first()
    assert gaps[0] < 1e-6 and 0.3 < gaps[1] < 0.7


def test_calibrated_svm_gives_probabilities(sample):
    df, _ = sample
    rows = ln.CalibratedSVM(df, ["a", "b"], 20).score(df)
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < 0.2 and 0.8 < high <= 1 and ev.evaluate(rows).first().auc_roc > 0.9


def test_isolation_forest_ranks_outliers(spark):
    rng = np.random.RandomState(2)
    rows = [(f"n{i}", float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(900, 2)))] + [(f"out{i}", 8.0 + i, -9.0) for i in range(5)]
    df = spark.createDataFrame(rows, "transaction_id string, a double, b double")
    forest = ln.IsolationForest(df, ["a", "b"], trees=60, sample=128)
    first = forest.predict(df, 0.05).collect()
    again = ln.IsolationForest(df, ["a", "b"], trees=60, sample=128).score(df).collect()
    assert {r.transaction_id: r.anomaly_score for r in first} == {r.transaction_id: r.anomaly_score for r in again}
    top = sorted(first, key=lambda r: -r.anomaly_score)[:5]
    assert all(r.transaction_id.startswith("out") for r in top)
    assert 0.03 < sum(r.is_anomaly for r in first) / len(first) <= 0.06
    assert all(0 <= r.probability <= 1 for r in first)


def test_components_match_numpy(spark):
    rng = np.random.RandomState(3)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + 2.0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>").repartition(5)
    _, share = ln.pca_features(df, "v", 3)
    values = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert share == pytest.approx((values / values.sum())[:3])
    _, singular = ln.svd_features(df, "v", 3)
    assert singular == pytest.approx(np.linalg.svd(x, compute_uv=False)[:3])


def test_ica_separates_sources(spark):
    rng = np.random.RandomState(4)
    s = np.column_stack([rng.uniform(-1, 1, 3000), np.sign(rng.normal(size=3000)) * rng.exponential(size=3000)])
    x = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "id int, v array<double>")
    z = np.array([r.ica for r in ln.ica_features(df, "v", 2).orderBy("id").collect()])
    match = np.abs(np.corrcoef(s.T, z.T)[:2, 2:])
    assert match.max(axis=1).min() > 0.97


def test_cluster_features(spark):
    rng = np.random.RandomState(5)
    x = np.vstack([rng.normal(c, 0.1, (60, 2)) for c in (0, 5, 10)])
    df = spark.createDataFrame([(i, [float(a), float(b)], float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, v array<double>, a double, b double")
    out = ln.cluster_features(df, "v", (3,)).orderBy("id").toPandas()
    assert [out.kmeans_cluster_3[i : i + 60].nunique() for i in (0, 60, 120)] == [1, 1, 1] and out.kmeans_cluster_3.nunique() == 3
    assert out.kmeans_distance_ratio_3.between(0, 1).all()
    dense = ln.density_features(df, ["a", "b"], 0.5, 5).toPandas()
    assert dense.dbscan_cluster.dropna().nunique() == 3


def test_selection_methods(spark, sample):
    df, frame = sample
    got = {r.feature: r for r in sel.by_variance(df, ["a", "flat"]).collect()}
    assert got["a"].selected and not got["flat"].selected
    assert {r.feature for r in sel.by_correlation(df, ["a", "b", "c", "d"]).filter("selected").collect()} == {"a", "b", "c"}
    anova = {r.feature: r.score for r in sel.by_anova(df, ["a", "b", "c"]).collect()}
    groups = [frame[frame.label == k].a for k in (0, 1)]
    grand = frame.a.mean()
    between = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups) / (len(frame) - 2)
    assert anova["a"] == pytest.approx(between / within) and anova["a"] > anova["b"] > anova["c"]
    mi = {r.feature: r.score for r in sel.by_mutual_information(df, ["a", "b", "c"]).collect()}
    assert mi["a"] > mi["b"] > mi["c"] >= 0
    lasso = {r.feature: r.score for r in sel.by_lasso(df, ["a", "b", "c"], grid=(0.01,), folds=2).collect()}
    assert lasso["a"] > lasso["b"] > lasso["c"]
    best = sel.combined(df, ["a", "b", "c", "d"], ["correlation_filter", "mutual_information"], 2).filter("selected")
    assert best.count() == 2


def test_ensemble_edges(spark):
    df = spark.createDataFrame([({"m": 0.7},), ({"m": 0.7, "n": 0.7},), ({},)], "s map<string,double>")
    rows = df.select(
        en.agreement(F.col("s")), en.ensemble_confidence(F.col("s"), {"m": 1.0, "n": 1.0}), en.voting(F.col("s")), en.weighted_average(F.col("s"), {"x": 1.0})
    ).collect()
    assert rows[0][0] == 1.0 and rows[0][1] == 0.5 and rows[1][0] == pytest.approx(1.0) and rows[1][1] == pytest.approx(1.0)
    assert rows[2][2] == 0.5 and all(r[3] == 0.5 for r in rows)


def test_explanations(spark):
    rows = [("t", "first", "x", 0.5), ("t", "first", "y", -0.2), ("t", "first", "z", 0.001), ("t", "second", "y", -0.4), ("t", "second", "x", 0.1)]
    df = spark.createDataFrame(rows, "transaction_id string, model_name string, feature string, contribution double")
    row = en.explanation_summary(df.filter("model_name = 'first'")).first()
    assert (row.top_feature, row.impact) == ("x", "raises the score")
    assert row.explanation == "Risk raised by x. Risk lowered by y" and row.net_contribution == pytest.approx(0.301)
    agreed = en.consensus(df, top=2).first()
    assert agreed.consensus_features == ["x", "y"] and agreed.agreement_score == 1.0


def test_average_path():
    assert ln.average_path(1) == 0 and ln.average_path(2) == 1 and ln.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_only_classifier_fits_are_capped(tables, monkeypatch):
    from ledgerwatch.plans import learning as plans

    monkeypatch.setattr(plans, "training", lambda t: ln.training_frame(t.tx_place, days=None, limit=500))
    whole = plans.everything(tables)
    n = whole.count()
    assert n > 500
    assert plans.ml_5(tables).first().total == n
    assert {r.n for r in plans.ml_18_trees(tables).collect()} == {n}
    got = {(r.kind, r.feature): r.score for r in plans.fea_22(tables).collect()}
    want = {f"{r.feature_a}~{r.feature_b}": r.correlation for r in sel.correlation_table(whole, sorted(f for k, f in got if k == "feature")).collect()}
    assert {f: v for (k, f), v in got.items() if k == "correlation"} == pytest.approx(want)
    found = {(r.method, r.feature): r.score for r in plans.fea_21_models(tables).filter("method IN ('lasso', 'pca')").collect()}
    for method, part in (("pca", sel.by_components(whole, plans.CHOSEN, 3)), ("lasso", sel.by_lasso(whole, plans.CHOSEN, grid=(0.001, 0.01), folds=2))):
        assert {f: v for (m, f), v in found.items() if m == method} == pytest.approx({r.feature: r.score for r in part.collect()})


def test_selection_reads_its_rows_from_files(tables):
    """The passes of the fits read rows that were written once; none joins or broadcasts the tables again."""
    from ledgerwatch.plans import learning

    fit, every = learning.selectable(tables)
    for df, source in ((fit, learning.training(tables)), (every, learning.everything(tables))):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert df.exceptAll(source.select(*df.columns)).isEmpty() and df.count() == source.count() > 100


@pytest.mark.parametrize("name", ["fea_21_models", "fea_22"])
def test_selection_fits_on_all_rows(tables, monkeypatch, name):
    """No fit of the selection queries is cut to the newest rows; each reads all but its own fold."""
    from ledgerwatch.plans import learning as plans

    monkeypatch.setattr(plans, "training", lambda t: ln.training_frame(t.tx_place, days=None, limit=500))
    sizes, fit = [], ln.train
    monkeypatch.setattr(ln, "train", lambda df, *args: sizes.append(df.count()) or fit(df, *args))
    getattr(plans, name)(tables).collect()
    n = plans.everything(tables).count()
    assert n > 1200 and max(sizes) == n and min(sizes) > 500
