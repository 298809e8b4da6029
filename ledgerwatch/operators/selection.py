"""Feature selection: every method returns (feature, score, selected) rows; scores come from distributed aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "feature string, score double, selected boolean"


def _table(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame([(f, None if s is None else float(s), bool(k)) for f, s, k in rows], SCHEMA)


def _top(scores: dict[str, float], k: int) -> set[str]:
    return set(sorted(scores, key=lambda f: (-scores[f], f))[:k])


def by_variance(df: DataFrame, features: Sequence[str], threshold: float = 0.01) -> DataFrame:
    row = df.agg(*[F.var_samp(c).alias(c) for c in features], *[F.var_pop(c).alias(f"_p{c}") for c in features]).first()
    return _table(df, [(c, row[c], (row[f"_p{c}"] or 0.0) > threshold) for c in features])


def correlations(df: DataFrame, features: Sequence[str]) -> dict[tuple[str, str], float]:
    """All pairwise correlations from one aggregate row."""
    pairs = list(combinations(features, 2))
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    return {p: (0.0 if row[f"c{i}"] is None or math.isnan(row[f"c{i}"]) else row[f"c{i}"]) for i, p in enumerate(pairs)}


def by_correlation(df: DataFrame, features: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Drop a feature that is highly correlated with an earlier one; the score is 1 - its largest correlation."""
    found = correlations(df, features)
    strongest = {f: max([abs(v) for p, v in found.items() if f in p] or [0.0]) for f in features}
    dropped = {b for (a, b), v in found.items() if abs(v) > threshold}
    return _table(df, [(f, 1 - strongest[f], f not in dropped) for f in features])


def correlation_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = [(a, b, float(v)) for (a, b), v in correlations(df, features).items()]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def by_anova(df: DataFrame, features: Sequence[str], label: str = "label", k: int = 50) -> DataFrame:
    """F statistic of each feature between the classes."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in features:
        aggs += [F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}")]
    groups = df.groupBy(label).agg(*aggs).collect()
    total = sum(g["n"] for g in groups)
    scores = {}
    for c in features:
        grand = sum(g["n"] * g[f"m_{c}"] for g in groups) / total
        between = sum(g["n"] * (g[f"m_{c}"] - grand) ** 2 for g in groups)
        within = sum(g["n"] * g[f"v_{c}"] for g in groups)
        free = max(len(groups) - 1, 1)
        scores[c] = (between / free) / (within / max(total - len(groups), 1)) if within > 0 else 0.0
    chosen = _top(scores, k)
    return _table(df, [(c, scores[c], c in chosen) for c in features])


def by_mutual_information(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10, k: int = 50) -> DataFrame:
    """Mutual information (nats) between each feature in equal-width bins and the label."""
    edges = df.agg(*[F.min(c).alias(f"l_{c}") for c in features], *[F.max(c).alias(f"h_{c}") for c in features]).first()
    binned = []
    for c in features:
        low, width = float(edges[f"l_{c}"]), (float(edges[f"h_{c}"]) - float(edges[f"l_{c}"])) / bins
        raw = F.floor((F.col(c) - low) / width) if width > 0 else F.lit(0)
        binned.append(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)).cast("int").alias(c))
    table = df.select(F.col(label).alias("_y"), *binned).unpivot(["_y"], list(features), "feature", "bin")
    cells = table.groupBy("feature", "bin", "_y").agg(F.count(F.lit(1)).alias("n")).collect()
    scores = {}
    for c in features:
        mine = [(r["bin"], r["_y"], r["n"]) for r in cells if r["feature"] == c]
        total = sum(n for *_, n in mine)
        by_bin, by_label = {}, {}
        for b, y, n in mine:
            by_bin[b] = by_bin.get(b, 0) + n
            by_label[y] = by_label.get(y, 0) + n
        scores[c] = sum(n / total * math.log(n * total / (by_bin[b] * by_label[y])) for b, y, n in mine)
    chosen = _top(scores, k)
    return _table(df, [(c, scores[c], c in chosen) for c in features])


def by_forest(df: DataFrame, features: Sequence[str], k: int = 50, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    from ledgerwatch.operators.learning import classifiers, train

    model = train(df, features, classifiers(trees, depth, seed)["random_forest"]).stages[-1]
    scores = dict(zip(features, model.featureImportances.toArray()))
    chosen = _top(scores, k)
    return _table(df, [(c, scores[c], c in chosen) for c in features])


def by_elimination(df: DataFrame, features: Sequence[str], keep: int = 5, step: int = 2, trees: int = 10, depth: int = 4) -> DataFrame:
    """Recursive elimination: fit a forest, drop the weakest, keep the subset with the best cross-validated accuracy."""
    from pyspark.sql import functions as F  # noqa: F811

    from ledgerwatch.operators.learning import classifiers, cross_validate

    left, rounds, dropped_at = list(features), [], {}
    while True:
        accuracy = cross_validate(df, left, classifiers(trees, depth)["random_forest"], 3).agg(F.avg("accuracy")).first()[0]
        rounds.append((accuracy, len(rounds), list(left)))
        if len(left) <= keep:
            break
        scores = {r["feature"]: r["score"] for r in by_forest(df, left, trees=trees, depth=depth).collect()}
        for weak in sorted(left, key=lambda f: (scores[f], f))[: min(step, len(left) - keep)]:
            dropped_at[weak] = len(rounds)
            left.remove(weak)
    best = max(rounds, key=lambda r: (r[0], r[1]))[2]
    last = len(rounds) + 1
    return _table(df, [(c, dropped_at.get(c, last) / last, c in best) for c in features])


def by_lasso(df: DataFrame, features: Sequence[str], label: str = "label", grid=(0.001, 0.01, 0.1), folds: int = 3) -> DataFrame:
    """Absolute coefficients of a cross-validated L1 regression on scaled features."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    raw = VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep").transform(df)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True).fit(raw).transform(raw)
    lasso = LinearRegression(elasticNetParam=1.0, labelCol=label, maxIter=50)
    fitted = CrossValidator(
        estimator=lasso, estimatorParamMaps=ParamGridBuilder().addGrid(lasso.regParam, list(grid)).build(),
        evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=42,
    ).fit(scaled).bestModel
    scores = dict(zip(features, np.abs(fitted.coefficients.toArray())))
    return _table(df, [(c, scores[c], scores[c] > 1e-9) for c in features])


def by_components(df: DataFrame, features: Sequence[str], k: int = 50, explained: float = 0.95) -> DataFrame:
    """Mean absolute loading on the principal components that explain ``explained`` of the variance."""
    from ledgerwatch.operators.learning import moments

    vector = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
    _, mean, second = moments(vector, "x")
    cov = second - np.outer(mean, mean)
    std = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    order = values.argsort()[::-1]
    share = np.cumsum(values[order]) / max(values.sum(), 1e-12)
    count = min(int(np.argmax(share >= explained)) + 1, k)
    scores = dict(zip(features, np.abs(vectors[:, order[:count]]).mean(axis=1)))
    chosen = _top(scores, k)
    return _table(df, [(c, scores[c], c in chosen) for c in features])


METHODS = {
    "variance_threshold": by_variance, "correlation_filter": by_correlation, "univariate": by_anova,
    "rfe": by_elimination, "lasso": by_lasso, "random_forest_importance": by_forest,
    "mutual_information": by_mutual_information, "pca": by_components,
}
#: Methods that fit classifiers.
FITTED = {"rfe", "random_forest_importance"}


def combined(df: DataFrame, features: Sequence[str], methods: Sequence[str], n: int = 50, fit: DataFrame | None = None) -> DataFrame:
    """Run the methods one after another on the features left; sum their scores, divide by the largest, keep the top.

    Methods that fit classifiers read ``fit`` where it is given, all others ``df``.
    """
    left, total = list(features), {}
    for name in methods:
        rows = METHODS[name](fit if fit is not None and name in FITTED else df, left).collect()
        for r in rows:
            if r["selected"]:
                total[r["feature"]] = total.get(r["feature"], 0.0) + (r["score"] or 0.0)
        left = [r["feature"] for r in rows if r["selected"]]
    largest = max(total.values(), default=0.0) or 1.0
    scores = {f: s / largest for f, s in total.items()}
    chosen = _top(scores, n)
    return _table(df, [(f, scores.get(f, 0.0), f in chosen) for f in features])


def importance_history(df: DataFrame, feature: str | None = None, k: int = 10) -> DataFrame:
    """``df``: method, feature, score, ts.  Mean, last score and runs per method and feature, top ``k`` per method."""
    from ledgerwatch.functions import timeline as tl

    rows = df if feature is None else df.filter(F.col("feature") == feature)
    stats = rows.groupBy("method", "feature").agg(
        F.avg("score").alias("mean_score"), F.max_by("score", "ts").alias("last_score"), F.count(F.lit(1)).alias("runs")
    )
    return tl.top_rows(stats, "method", [F.desc("mean_score"), F.col("feature")], k, F.col("feature"), salts=4, rank="place")
