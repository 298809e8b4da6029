"""Blending of model scores held in a map column ``scores`` (model name to probability)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import timeline as tl
from ledgerwatch.operators.rules import present


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _weights(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])


def _weight_of(weights: dict[str, float], name: Column) -> Column:
    out = F.lit(0.0)
    for model, w in weights.items():
        out = F.when(name == model, F.lit(float(w))).otherwise(out)
    return out


def weighted_average(scores: Column, weights: dict[str, float]) -> Column:
    entries = F.map_entries(scores)
    total = _sum(F.transform(entries, lambda e: _weight_of(weights, e["key"])))
    value = _sum(F.transform(entries, lambda e: e["value"] * _weight_of(weights, e["key"])))
    return F.when(total > 0, value / total).otherwise(0.5)


def voting(scores: Column, threshold: float = 0.5) -> Column:
    votes = F.size(F.filter(F.map_values(scores), lambda p: p > threshold))
    return F.when(F.size(scores) > 0, votes / F.size(scores)).otherwise(0.5)


def confidence_of(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def dynamic(scores: Column, f1: dict[str, float], is_healthy: dict[str, bool] | None = None) -> Column:
    """Weights are F1 times confidence for healthy models with a record, else 0.1."""
    usable = {m: v for m, v in f1.items() if (is_healthy or {}).get(m, True)}

    def weight(e):
        out = F.lit(0.1)
        for model, v in usable.items():
            out = F.when(e["key"] == model, F.lit(float(v)) * confidence_of(e["value"])).otherwise(out)
        return out

    entries = F.map_entries(scores)
    total = _sum(F.transform(entries, weight))
    return F.when(total > 0, _sum(F.transform(entries, lambda e: e["value"] * weight(e))) / total).otherwise(0.0)


def stacking(scores: Column, weights: dict[str, float]) -> Column:
    """A weighted average stands in for the meta-model."""
    return weighted_average(scores, weights)


def _mean(values: Column) -> Column:
    return F.try_divide(_sum(values), F.size(values))


def _deviation(values: Column) -> Column:
    mean = _mean(values)
    return F.sqrt(F.try_divide(_sum(F.transform(values, lambda x: (x - mean) * (x - mean))), F.size(values)))


def agreement(scores: Column) -> Column:
    values = F.map_values(scores)
    return F.when(F.size(values) < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - _deviation(values) * 2))


def ensemble_confidence(scores: Column, weights: dict[str, float]) -> Column:
    """1 / (1 + variance of the weighted predictions); 0.5 for a single model."""
    weighted = F.transform(F.map_entries(scores), lambda e: e["value"] * _weight_of(weights, e["key"]))
    deviation = _deviation(weighted)
    return F.when(F.size(scores) < 2, 0.5).otherwise(1.0 / (1.0 + deviation * deviation))


def confidence_stats(scores: Column) -> Column:
    values = F.transform(F.map_values(scores), confidence_of)
    return F.struct(
        _mean(values).alias("mean_confidence"), F.array_min(values).alias("min_confidence"),
        F.array_max(values).alias("max_confidence"), _deviation(values).alias("confidence_std"),
    )


def scaled_decision(p: Column, confidence: Column) -> Column:
    """Level and decision with thresholds scaled by the confidence (at least one half)."""
    f = F.greatest(F.lit(0.5), confidence)
    level = (
        F.when(p >= 0.8 * f, "CRITICAL").when(p >= 0.6 * f, "HIGH").when(p >= 0.4 * f, "MEDIUM").when(p >= 0.2 * f, "LOW").otherwise("MINIMAL")
    )
    decision = F.when(p >= 0.8 * f, "DECLINED").when(p >= 0.4 * f, "REVIEW").otherwise("APPROVED")
    return F.struct(level.alias("risk_level"), decision.alias("decision"))


def top_models(scores: Column, weights: dict[str, float], k: int = 3) -> Column:
    """Models by weighted contribution, largest first."""
    entries = F.transform(
        F.map_entries(scores),
        lambda e: F.struct(
            (-e["value"] * _weight_of(weights, e["key"])).alias("order"), e["key"].alias("model_name"), e["value"].alias("probability"),
        ),
    )
    return F.transform(
        F.slice(F.array_sort(entries), 1, k),
        lambda e: F.struct(e["model_name"].alias("model_name"), e["probability"].alias("probability"), (-e["order"]).alias("contribution")),
    )


def risk_messages(scores: Column) -> Column:
    values = F.map_values(scores)
    return present(
        (agreement(scores) < 0.5, "models disagree"),
        (_mean(F.transform(values, confidence_of)) < 0.6, "models are unsure"),
        (F.size(F.filter(values, lambda p: p > 0.7)) > F.size(values) / 2, "most models see a high risk"),
    )


def weighted_importance(importance: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``importance``: model_name, feature, importance; the sum over models by weight."""
    return importance.groupBy("feature").agg(
        F.sum(F.col("importance") * _weight_of(weights, F.col("model_name"))).alias("importance")
    )


def _newest(performance: DataFrame, rows: int, row_id: str) -> DataFrame:
    return tl.top_rows(performance, "model_name", [F.desc("ts"), F.desc(row_id)], rows, F.col(row_id), rank="_r")


def decayed_weights(
    performance: DataFrame, decay: float = 0.95, floor: float = 0.05, cap: float = 0.5, row_id: str = "evaluation_id"
) -> DataFrame:
    """Model weights from performance values, newest first.

    Values whose weight is below 1e-18 of the newest one's are not read: how many rows that leaves follows from ``decay``,
    and without decay all rows count.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay lies above 0 and at most at 1")
    if decay == 1:
        recent = performance.withColumn("_r", F.lit(1))
    else:
        recent = _newest(performance, math.ceil(math.log(1e-18) / math.log(decay)), row_id)
    w = F.pow(F.lit(decay), F.col("_r") - 1)
    means = recent.groupBy("model_name").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("_m"))
    floored = means.withColumn("_m", F.greatest(F.col("_m"), F.lit(floor)))
    total = floored.select(F.sum("_m")).scalar()
    share = F.greatest(F.lit(floor), F.least(F.lit(cap), F.col("_m") / total))
    return floored.select("model_name", F.col("_m").alias("performance"), share.alias("weight"))


# ---- attribution ----------------------------------------------------------------------------

def linear_attribution(df: DataFrame, coefficients: dict[str, float], row_id: str = "transaction_id", model: str = "linear") -> DataFrame:
    """Exact contributions of a linear model, ``w (x - mean)``, as (id, model_name, feature, contribution) rows."""
    means = df.select(F.struct(*[F.avg(c).alias(c) for c in coefficients]).alias("m")).scalar()
    wide = df.select(row_id, *[(F.lit(float(w)) * (F.col(c) - means[c])).alias(c) for c, w in coefficients.items()])
    return wide.unpivot([row_id], list(coefficients), "feature", "contribution").withColumn("model_name", F.lit(model))


def explanation_summary(contributions: DataFrame, row_id: str = "transaction_id", k: int = 10) -> DataFrame:
    """Per row: positive, negative and net contribution, the strongest feature, the top features and a sentence.

    The number of features per row is fixed by the model, so the lists are short.
    """
    c = F.col("contribution")
    packed = F.struct((-F.abs(c)).alias("o"), F.col("feature"), c.alias("v"))
    base = contributions.groupBy(row_id).agg(
        F.sum(F.when(c > 0, c).otherwise(0.0)).alias("positive_contribution"), F.sum(F.when(c < 0, c).otherwise(0.0)).alias("negative_contribution"),
        F.array_sort(F.collect_list(packed)).alias("_l"),
    )
    first = F.get("_l", F.lit(0))

    def named(test):
        return F.array_join(F.transform(F.slice(F.filter("_l", test), 1, 3), lambda e: e["feature"]), ", ")

    up, down = named(lambda e: e["v"] > 0.01), named(lambda e: e["v"] < -0.01)
    sentence = F.concat_ws(
        ". ", F.when(up != "", F.concat(F.lit("Risk raised by "), up)), F.when(down != "", F.concat(F.lit("Risk lowered by "), down))
    )
    return base.select(
        row_id, "positive_contribution", "negative_contribution", (F.col("positive_contribution") + F.col("negative_contribution")).alias("net_contribution"),
        first["feature"].alias("top_feature"), F.when(first["v"] > 0, "raises the score").otherwise("lowers the score").alias("impact"),
        F.transform(F.slice("_l", 1, k), lambda e: F.struct(e["feature"].alias("feature"), e["v"].alias("contribution"))).alias("top_features"),
        sentence.alias("explanation"),
    )


def ensemble_attribution(contributions: DataFrame, weights: dict[str, float], row_id: str = "transaction_id") -> DataFrame:
    """Weighted mean contribution per feature over the models."""
    total = float(sum(weights.values()))
    w = _weight_of(weights, F.col("model_name"))
    return contributions.groupBy(row_id, "feature").agg((F.sum(F.col("contribution") * w) / total).alias("contribution"))


def consensus(contributions: DataFrame, row_id: str = "transaction_id", top: int = 5) -> DataFrame:
    """Features among the top of more than one model, and their share of all top features, per row."""
    from pyspark.sql import Window

    order = Window.partitionBy(row_id, "model_name").orderBy(F.desc(F.abs("contribution")), "feature")
    best = contributions.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top)
    counts = best.groupBy(row_id, "feature").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(row_id).agg(
        F.array_sort(F.collect_list(F.when(F.col("_n") > 1, F.col("feature")))).alias("consensus_features"),
        (F.count_if(F.col("_n") > 1) / F.count(F.lit(1))).alias("agreement_score"),
    )
