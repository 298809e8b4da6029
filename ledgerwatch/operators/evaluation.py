"""Model quality from scored tables: metrics, history, drift, A/B tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.operators.aggregates import confusion_counts, rates_from_confusion
from ledgerwatch.operators.common import since
from ledgerwatch.sources.files import written


def auc(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Exact area under the ROC curve per group: counts per distinct score, then running counts over score slices.

    0.5 where a group has one class only.
    """
    key = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    y = F.col(label).cast("boolean")
    counts = written(base.groupBy(*key, score).agg(F.count_if(y).alias("_p"), F.count_if(~y).alias("_n")), "score-counts")
    ranked = tl.running_sums(counts, key, F.col(score), {"_below": F.col("_n")}, tl.even_slices(counts, score), all_hot=True)
    wins = F.sum(F.col("_p") * (F.col("_below") - F.col("_n") / 2.0))
    out = ranked.groupBy(*key).agg(wins.alias("_w"), F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    both = F.col("_tp").cast("double") * F.col("_tn")
    return out.select(*key, F.when(both > 0, F.col("_w") / both).otherwise(0.5).alias("auc_roc"))


def log_loss(score: Column, label: Column, eps: float = 1e-15) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return -F.avg(F.when(label, F.log(p)).otherwise(F.log(1 - p)))


def evaluate(df: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1, AUC and log loss per group."""
    key = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(1))
    s, y = F.col(score), F.col(label).cast("boolean")
    counts = base.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in confusion_counts(s, y, threshold).items()],
        log_loss(s, y).alias("log_loss"),
    )
    out = rates_from_confusion(counts).join(auc(base, key, score, label), key)
    return out if keys else out.drop("_all")


def history(df: DataFrame, model: str | None = None, days: float = 30, as_of=None) -> DataFrame:
    """Performance rows of the last ``days``, newest first."""
    recent = since(df, days * 86400, as_of)
    chosen = recent if model is None else recent.filter(F.col("model_name") == model)
    return chosen.orderBy(F.desc("ts"), "model_name")


def rolling_points(df: DataFrame, hours: float = 24, as_of=None) -> DataFrame:
    """Performance points inside the rolling window, with their count and means per model."""
    return since(df, hours * 3600, as_of).groupBy("model_name").agg(
        F.count(F.lit(1)).alias("points"), F.avg("accuracy").alias("accuracy"), F.avg("f1_score").alias("f1_score"),
        F.avg("inference_time_ms").alias("inference_time_ms"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def drift(df: DataFrame, last: int = 1000, minimum: int = 100, row_id: str = "transaction_id") -> DataFrame:
    """Difference of the mean score between the two halves of each model's last predictions."""
    recent = tl.top_rows(df, "model_name", [F.desc("ts"), F.desc(row_id)], last, F.col(row_id), rank="_r")
    sized = recent.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("model_name")))
    older = F.col("_r") > F.col("_n") - F.floor(F.col("_n") / 2)
    return sized.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("predictions"),
        F.when(
            F.count(F.lit(1)) >= minimum,
            F.least(F.lit(1.0), F.abs(F.avg(F.when(older, F.col("score"))) - F.avg(F.when(~older, F.col("score"))))),
        ).otherwise(0.0).alias("drift_score"),
    )


def healthy(accuracy: Column, drift_score: Column) -> Column:
    return (accuracy > 0.8) & (drift_score < 0.1)


# ---- A/B tests ------------------------------------------------------------------------------

def assign_arm(row_id: str, test: str, split: float = 0.5) -> Column:
    """Sticky arm of a row: the same id always lands in the same arm of a test."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(test), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("long")
    return F.when(F.pmod(bucket, F.lit(1_000_000)) < int(split * 1_000_000), "A").otherwise("B")


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def t_test_p(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if dof <= 0 or t != t:
        return 1.0
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def ab_result(df: DataFrame, minimum: int = 10, level: float = 0.05) -> DataFrame:
    """Outcome per test from rows (test_id, arm, score, label): metrics per arm, pooled t-test on correctness, winner.

    Rows are reduced to counts per test; only those few rows meet Python for the p-value.
    """
    right = ((F.col("score") > 0.5) == F.col("label").cast("boolean")).cast("double")
    arm = lambda a, c: F.when(F.col("arm") == a, c)
    parts = []
    for a in "AB":
        parts += [F.count(arm(a, right)).alias(f"n_{a.lower()}"), F.avg(arm(a, right)).alias(f"accuracy_{a.lower()}"),
                  F.var_samp(arm(a, right)).alias(f"_v{a}")]
    per_test = df.groupBy("test_id").agg(*parts)
    na, nb, ma, mb = F.col("n_a"), F.col("n_b"), F.col("accuracy_a"), F.col("accuracy_b")
    pooled = ((na - 1) * F.col("_vA") + (nb - 1) * F.col("_vB")) / F.nullif(na + nb - 2, F.lit(0))
    t = (ma - mb) / F.nullif(F.sqrt(pooled * (F.lit(1.0) / F.nullif(na, F.lit(0)) + F.lit(1.0) / F.nullif(nb, F.lit(0)))), F.lit(0.0))
    rated = per_test.withColumn("t_stat", t).drop("_vA", "_vB")

    def with_p(batches):
        for batch in batches:
            enough = (batch["n_a"] > minimum) & (batch["n_b"] > minimum)
            batch["p_value"] = [
                t_test_p(float(t), float(a + b - 2)) if e else 1.0
                for t, a, b, e in zip(batch["t_stat"], batch["n_a"], batch["n_b"], enough)
            ]
            yield batch

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rated.schema.fields)
    tested = rated.mapInPandas(with_p, f"{fields}, p_value double")
    return tested.withColumn("significant", F.col("p_value") < level).withColumn(
        "winner", F.when(~F.col("significant"), "inconclusive").when(F.col("accuracy_a") > F.col("accuracy_b"), "A").otherwise("B")
    )


def split_by_hash(df: DataFrame, row_id: str = "transaction_id", share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: the same share of every class, decided by a hash of the id."""
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_train", F.pmod(bucket, F.lit(10_000)) < int(share * 10_000))


