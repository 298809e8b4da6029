"""Training sets, MLlib models, isolation forest, clustering and decomposition features.

Everything that sees rows runs on the executors; the driver holds model parameters, whose size depends on the number of
features, trees or clusters and not on the rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.functions.columns import hash_fraction
from ledgerwatch.operators.evaluation import evaluate
from ledgerwatch.operators.filters import coerce_numeric
from ledgerwatch.session import cut_lineage

FEATURES = [
    "amount", "fraud_score", "latitude", "longitude", "is_vpn", "is_tor", "confidence_score", "processing_time_ms",
    "hour_of_day", "day_of_week", "is_weekend", "is_business_hour",
]


def training_frame(df: DataFrame, days: float | None = 30, limit: int | None = 100_000, as_of=None) -> DataFrame:
    """Newest labelled rows with the twelve training features as numbers and a 0/1 label; all rows without a limit."""
    from ledgerwatch.operators.common import since

    recent = since(df.filter(F.col("is_fraud").isNotNull()), None if days is None else days * 86400, as_of)
    hour, dow = F.hour("ts"), F.dayofweek("ts") - 1
    out = recent.withColumns(
        {
            "hour_of_day": hour, "day_of_week": dow, "is_weekend": F.when(dow.isin(0, 6), 1).otherwise(0),
            "is_business_hour": F.when(hour.between(9, 17), 1).otherwise(0), "label": F.col("is_fraud"),
        }
    )
    for missing in (c for c in FEATURES if c not in out.columns):
        out = out.withColumn(missing, F.lit(None).cast("double"))
    newest = out if limit is None else out.orderBy(F.desc("ts"), F.desc("transaction_id")).limit(limit)
    return coerce_numeric(newest.select("transaction_id", "ts", *FEATURES, "label"), FEATURES, "label")


# ---- MLlib models ---------------------------------------------------------------------------

def classifiers(trees: int = 50, depth: int = 6, seed: int = 42) -> dict:
    common = {"featuresCol": "features", "labelCol": "label"}
    return {
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **common),
        "logistic_regression": LogisticRegression(maxIter=100, regParam=0.01, **common),
        "boosted_trees": GBTClassifier(maxIter=max(5, trees // 5), maxDepth=min(depth, 5), seed=seed, **common),
    }


def train(df: DataFrame, features: Sequence[str], model) -> PipelineModel:
    """Assemble, scale and fit."""
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        model,
    ]
    return Pipeline(stages=stages).fit(df)


def score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the probability of the positive class."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


class CalibratedSVM:
    """Linear support vectors with a logistic calibration of the margin."""

    def __init__(self, df: DataFrame, features: Sequence[str], max_iter: int = 50, reg: float = 0.01):
        self.svm = train(df, features, LinearSVC(maxIter=max_iter, regParam=reg, featuresCol="features", labelCol="label"))
        margins = self._margin(df)
        fitted = LogisticRegression(featuresCol="_m", labelCol="label", maxIter=50).fit(
            VectorAssembler(inputCols=["margin"], outputCol="_m").transform(margins)
        )
        self.slope, self.intercept = float(fitted.coefficients[0]), float(fitted.intercept)

    def _margin(self, df: DataFrame) -> DataFrame:
        return self.svm.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).select(*df.columns, "margin")

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        z = F.col("margin") * self.slope + self.intercept
        return self._margin(df).withColumn(name, 1.0 / (1.0 + F.exp(-z))).drop("margin")


def compare_models(df: DataFrame, features: Sequence[str], models: dict) -> DataFrame:
    """Fit each model on the training part and evaluate it on the rest."""
    from ledgerwatch.operators.evaluation import split_by_hash

    parts = split_by_hash(df)
    fit_rows, test_rows = parts.filter("is_train"), parts.filter("NOT is_train")
    out = None
    for name, model in models.items():
        scored = score(train(fit_rows, features, model), test_rows).withColumn("model_name", F.lit(name))
        part = scored.select("model_name", "score", "label")
        out = part if out is None else out.unionByName(part)
    return evaluate(out, ["model_name"])


def cross_validate(
    df: DataFrame, features: Sequence[str], model, folds: int = 3, row_id: str = "transaction_id", fit: DataFrame | None = None
) -> DataFrame:
    """F1 and accuracy per fold, folds by a hash of the id; models are fitted on the rows of ``fit`` (default: all)."""
    from ledgerwatch.operators.features import fold_of

    tagged = df.withColumn("fold", fold_of(row_id, folds))
    learned = tagged if fit is None else fit.withColumn("fold", fold_of(row_id, folds))
    out = None
    for k in range(folds):
        scored = score(train(learned.filter(F.col("fold") != k), features, model), tagged.filter(F.col("fold") == k))
        part = scored.select("fold", "score", "label")
        out = part if out is None else out.unionByName(part)
    return evaluate(out, ["fold"])


def tune(df: DataFrame, features: Sequence[str], model, grid: dict[str, Sequence], folds: int = 3, metric: str = "areaUnderROC", parallelism: int = 2, seed: int = 42):
    """Grid search by cross-validation: the best model and one row per parameter set."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(model.getParam(name), list(values))
    maps = builder.build()
    evaluator = BinaryClassificationEvaluator(labelCol="label", metricName=metric)
    if metric == "f1":
        evaluator = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    fitted = CrossValidator(
        estimator=model, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, parallelism=parallelism, seed=seed
    ).fit(assembled)
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda e: e[0].name)), float(s))
        for m, s in zip(maps, fitted.avgMetrics)
    ]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "parameters string, metric double")


# ---- isolation forest -----------------------------------------------------------------------

def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.RandomState, limit: int) -> list[tuple]:
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((at, -1, 0.0, -1, -1, depth + average_path(len(rows))))
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            return at
        f = int(usable[rng.randint(len(usable))])
        cut = float(rng.uniform(low[f], high[f]))
        left = rows[:, f] < cut
        if not left.any() or left.all():
            return at
        a, b = build(rows[left], depth + 1), build(rows[~left], depth + 1)
        nodes[at] = (at, f, cut, a, b, 0.0)
        return at

    build(values, 0)
    return nodes


class IsolationForest:
    """Isolation forest: one small sample per tree is grown in its own task, the trees score all rows in batches."""

    def __init__(self, df: DataFrame, features: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42, row_id: str = "transaction_id"):
        self.features, self.trees = list(features), trees
        rows = df.select(row_id, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x"))
        total = rows.count()
        self.sample = min(sample, total)
        # each row draws a number per tree; a little more than the sample passes, and the smallest are kept
        share = min(1.0, (self.sample + 6 * math.sqrt(self.sample) + 20) / max(total, 1))
        draws = F.transform(
            F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), hash_fraction(row_id, t, seed=seed).alias("u"))
        )
        picked = rows.withColumn("d", F.explode(F.filter(draws, lambda d: d["u"] < share))).select("d.tree", "d.u", row_id, "x")
        chosen = tl.top_rows(picked, "tree", [F.col("u"), F.col(row_id)], self.sample, F.col(row_id), salts=4)
        limit = max(1, math.ceil(math.log2(max(2, self.sample))))

        def grow(frame):
            import pandas as pd

            frame = frame.sort_values(["u"])
            tree = int(frame["tree"].iloc[0])
            grown = _grow(np.array(frame["x"].tolist(), dtype=float), np.random.RandomState(seed + tree), limit)
            return pd.DataFrame([(tree, *n) for n in grown], columns=["tree", "node", "feature", "cut", "lo", "hi", "path"])

        nodes = chosen.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, lo int, hi int, path double")
        # trees x at most 2 * sample nodes
        table = nodes.orderBy("tree", "node").toPandas()
        self.model = [
            tuple(g[c].to_numpy() for c in ("feature", "cut", "lo", "hi", "path")) for _, g in table.groupby("tree", sort=True)
        ]
        self.context = df.sparkSession.sparkContext

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Add the anomaly score in (0, 1); higher is more anomalous."""
        from pyspark.sql.functions import pandas_udf

        shared, norm = self.context.broadcast(self.model), average_path(self.sample) or 1.0

        @pandas_udf("double")
        def rate(x):
            import pandas as pd

            rows = np.array(x.tolist(), dtype=float)
            depth = np.zeros(len(rows))
            for feature, cut, lo, hi, path in shared.value:
                at = np.zeros(len(rows), dtype=int)
                while True:
                    inner = feature[at] >= 0
                    if not inner.any():
                        break
                    f = np.where(inner, feature[at], 0)
                    below = rows[np.arange(len(rows)), f] < cut[at]
                    at = np.where(inner, np.where(below, lo[at], hi[at]), at)
                depth += path[at]
            return pd.Series(np.power(2.0, -depth / len(shared.value) / norm))

        packed = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])
        return df.withColumn(name, rate(packed))

    def predict(self, df: DataFrame, contamination: float = 0.1) -> DataFrame:
        """Anomaly flag for the most anomalous share, and a probability that rises with the score."""
        scored = cut_lineage(self.score(df))
        border = tl.exact_quantiles(
            scored.select(F.lit(1).alias("_all"), "anomaly_score"), "_all", "anomaly_score", {"q": 1 - contamination}
        ).select("q").scalar()
        return scored.withColumns(
            {"is_anomaly": F.col("anomaly_score") > border, "probability": (1 + F.col("anomaly_score") - border) / 2}
        )


# ---- tree attributions ----------------------------------------------------------------------

def tree_contributions(model, df: DataFrame, features: Sequence[str], folder: str, row_id: str = "transaction_id") -> DataFrame:
    """Path contributions of a fitted MLlib random forest: (id, feature, contribution) rows.

    The saved model is a table of nodes; each step down a tree credits its change of the class share to the split
    feature, averaged over the trees.
    """
    spark = df.sparkSession
    model.write().overwrite().save(folder)
    nodes = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    trees: dict[int, dict[str, np.ndarray]] = {}
    for tree in sorted({n["treeID"] for n in nodes}):
        mine = [n for n in nodes if n["treeID"] == tree]
        share = np.array([n["impurityStats"][1] / max(sum(n["impurityStats"]), 1e-12) for n in mine])
        inner = np.array([n["leftChild"] >= 0 for n in mine])
        trees[tree] = {
            "share": share, "inner": inner, "lo": np.array([n["leftChild"] for n in mine]), "hi": np.array([n["rightChild"] for n in mine]),
            "f": np.array([n["split"]["featureIndex"] if n["leftChild"] >= 0 else 0 for n in mine]),
            "cut": np.array([n["split"]["leftCategoriesOrThreshold"][0] if n["leftChild"] >= 0 else 0.0 for n in mine]),
        }
    shared, count = spark.sparkContext.broadcast(trees), len(features)
    id_type = df.schema[row_id].dataType.simpleString()

    def explain(batches):
        import pandas as pd

        for batch in batches:
            rows = np.array(batch["x"].tolist(), dtype=float)
            credit = np.zeros((len(rows), count))
            index = np.arange(len(rows))
            for t in shared.value.values():
                at = np.zeros(len(rows), dtype=int)
                while True:
                    inner = t["inner"][at]
                    if not inner.any():
                        break
                    down = np.where(rows[index, t["f"][at]] <= t["cut"][at], t["lo"][at], t["hi"][at])
                    step = np.where(inner, down, at)
                    np.add.at(credit, (index, t["f"][at]), np.where(inner, t["share"][step] - t["share"][at], 0.0))
                    at = step
            credit /= len(shared.value)
            yield pd.DataFrame({row_id: batch[row_id], "c": list(credit)})

    out = df.select(row_id, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features]).alias("x")).mapInPandas(
        explain, f"{row_id} {id_type}, c array<double>"
    )
    names = F.array(*[F.lit(f) for f in features])
    return out.select(row_id, F.explode(F.arrays_zip(names.alias("feature"), F.col("c").alias("contribution"))).alias("e")).select(
        row_id, F.col("e.feature").alias("feature"), F.col("e.contribution").alias("contribution")
    )


# ---- clusters and decompositions ------------------------------------------------------------

def cluster_features(df: DataFrame, vector: str, sizes: Sequence[int] = (5, 10, 20), seed: int = 42, max_iter: int = 20) -> DataFrame:
    """K-means cluster, distance to its centre, and that distance over the mean distance, per number of clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.sql.functions import pandas_udf

    out = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(out)
    out = scaler.transform(out)
    for k in sizes:
        centres = np.array(KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_s").fit(out).clusterCenters())

        @pandas_udf("struct<c int, d double, r double>")
        def place(x, centres=centres):
            import pandas as pd

            rows = np.array(x.tolist(), dtype=float)
            far = np.sqrt(np.maximum(0.0, (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)[None, :]))
            least = far.min(axis=1)
            return pd.DataFrame({"c": far.argmin(axis=1).astype("int32"), "d": least, "r": least / np.maximum(far.mean(axis=1), 1e-12)})

        out = out.withColumn("_p", place(vector_to_array("_s"))).withColumns(
            {f"kmeans_cluster_{k}": F.col("_p.c"), f"kmeans_distance_{k}": F.col("_p.d"), f"kmeans_distance_ratio_{k}": F.col("_p.r")}
        ).drop("_p")
    return out.drop("_v", "_s")


def density_features(df: DataFrame, columns: Sequence[str], eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """Density cluster and outlier flag over up to three standardised columns."""
    from ledgerwatch.operators.clustering import AXES, dbscan, standardised

    if len(columns) > 3:
        raise ValueError("density clusters take at most three columns; reduce the dimensions first")
    axes = {a: (F.col(c).cast("double") if c else F.lit(0.0)) for a, c in zip(AXES, [*columns, *[None] * (3 - len(columns))])}
    labelled = dbscan(cut_lineage(standardised(df, axes)), eps, min_points).drop(*AXES)
    return labelled.withColumnRenamed("cluster_id", "dbscan_cluster").withColumn(
        "is_dbscan_outlier", F.col("dbscan_cluster").isNull().cast("int")
    ).drop("is_core")


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and second-moment matrix of an array column: partial sums per task, then one small aggregate."""

    def partial(batches):
        import pandas as pd

        n, s, g = 0, None, None
        for batch in batches:
            x = np.array(batch["x"].tolist(), dtype=float)
            if not len(x):
                continue
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            g = x.T @ x if g is None else g + x.T @ x
        if n:
            whole = np.vstack([np.concatenate([[n], s]), np.hstack([np.zeros((len(s), 1)), g])])
            i, j = np.indices(whole.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": whole.ravel()})

    cells = df.select(F.col(vector).cast("array<double>").alias("x")).mapInPandas(partial, "i int, j int, v double")
    rows = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = max(r["j"] for r in rows)
    whole = np.zeros((size + 1, size + 1))
    for r in rows:
        whole[r["i"], r["j"]] = r["v"]
    n = int(round(whole[0, 0]))
    return n, whole[0, 1:] / n, whole[1:, 1:] / n


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Fix the sign of each column: its largest entry is positive."""
    at = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[at, range(vectors.shape[1])])


def project(df: DataFrame, vector: str, matrix: np.ndarray, shift: np.ndarray | None, name: str) -> DataFrame:
    """Add ``(x - shift) @ matrix`` as an array column."""
    from pyspark.sql.functions import pandas_udf

    offset = np.zeros(matrix.shape[0]) if shift is None else shift

    @pandas_udf("array<double>")
    def apply(x):
        import pandas as pd

        return pd.Series(list((np.array(x.tolist(), dtype=float) - offset) @ matrix))

    return df.withColumn(name, apply(F.col(vector).cast("array<double>")))


def pca_features(df: DataFrame, vector: str, k: int = 10) -> tuple[DataFrame, list[float]]:
    """First principal components and their explained share of the variance."""
    _, mean, second = moments(df, vector)
    values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
    order = values.argsort()[::-1][:k]
    share = (values[order] / max(values.sum(), 1e-300)).tolist()
    return project(df, vector, _signed(vectors[:, order]), mean, "pca"), share


def svd_features(df: DataFrame, vector: str, k: int = 5) -> tuple[DataFrame, list[float]]:
    """Projection on the first right singular vectors (no centring), and the singular values."""
    n, _, second = moments(df, vector)
    values, vectors = np.linalg.eigh(second * n)
    order = values.argsort()[::-1][:k]
    return project(df, vector, _signed(vectors[:, order]), None, "svd"), np.sqrt(np.maximum(values[order], 0)).tolist()


def ica_features(df: DataFrame, vector: str, k: int = 5, iterations: int = 50, tolerance: float = 1e-4, seed: int = 42) -> DataFrame:
    """Independent components: whitening from the covariance, then fixed-point rounds, each one distributed mean."""
    _, mean, second = moments(df, vector)
    values, vectors = np.linalg.eigh(second - np.outer(mean, mean))
    order = values.argsort()[::-1][:k]
    whiten = _signed(vectors[:, order]) / np.sqrt(np.maximum(values[order], 1e-12))
    white = cut_lineage(project(df, vector, whiten, mean, "_white").select("_white"))

    def unmix(w: np.ndarray) -> np.ndarray:
        u, _, v = np.linalg.svd(w, full_matrices=False)
        return u @ v

    w = unmix(np.random.RandomState(seed).normal(size=(k, k)))
    for _ in range(iterations):
        current = w

        def partial(batches, current=current):
            import pandas as pd

            n, first, slope = 0, np.zeros((k, k)), np.zeros(k)
            for batch in batches:
                z = np.array(batch["_white"].tolist(), dtype=float)
                if len(z):
                    g = np.tanh(z @ current.T)
                    n, first, slope = n + len(z), first + g.T @ z, slope + (1 - g**2).sum(0)
            if n:
                whole = np.hstack([np.full((k, 1), n), slope[:, None], first])
                i, j = np.indices(whole.shape)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": whole.ravel()})

        rows = white.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros((k, k + 2))
        for r in rows:
            sums[r["i"], r["j"]] = r["v"]
        n = sums[0, 0]
        fresh = unmix(sums[:, 2:] / n - (sums[:, 1] / n)[:, None] * w)
        moved = np.abs(np.abs((fresh * w).sum(1)) - 1).max()
        w = fresh
        if moved < tolerance:
            break
    return project(df, vector, whiten @ w.T, mean, "ica")
