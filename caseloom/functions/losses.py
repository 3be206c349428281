"""Scoring losses as expressions over a logit and a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import sigmoid


def bce_with_logits(logit: Column, y: Column, pos_weight: Column | None = None) -> Column:
    """Binary cross-entropy in the form that does not overflow for large logits."""
    softplus = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    weight = 1 if pos_weight is None else 1 + (pos_weight - 1) * y
    return (1 - y) * logit + weight * softplus


def focal_loss(logit: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = sigmoid(logit)
    hit = p * y + (1 - p) * (1 - y)
    balance = alpha * y + (1 - alpha) * (1 - y)
    return balance * F.pow(1 - hit, gamma) * bce_with_logits(logit, y)


def asymmetric_loss(logit: Column, y: Column, gamma_neg: float = 4.0, gamma_pos: float = 1.0,
                    margin: float = 0.05, eps: float = 1e-8) -> Column:
    """Separate focusing per class; negatives below the margin cost nothing."""
    p = sigmoid(logit)
    negative = F.least(1 - p + margin, F.lit(1.0)) if margin > 0 else 1 - p
    gain = (F.pow(1 - p, gamma_pos) * y * F.log(F.greatest(p, F.lit(eps)))
            + F.pow(1 - negative, gamma_neg) * (1 - y) * F.log(F.greatest(negative, F.lit(eps))))
    return -gain


def masked_mean(loss: Column, y: Column, weight: Column | None = None, floor: float = 1e-6) -> Column:
    """Aggregate: mean over known targets, weighted per case."""
    w = F.when(y.isNotNull(), F.lit(1.0) if weight is None else weight)
    return F.coalesce(F.sum(loss * w), F.lit(0.0)) / F.greatest(F.coalesce(F.sum(w), F.lit(0.0)), F.lit(floor))


def pos_weights(truth: DataFrame, limit: float = 20.0) -> DataFrame:
    """(label, n, positives, pos_weight): negatives per positive, between 1 and `limit`."""
    known = F.count("y")
    pos = F.coalesce(F.sum("y"), F.lit(0.0))
    ratio = (known - pos) / F.greatest(pos, F.lit(1.0))
    return truth.groupBy("label").agg(
        known.alias("n"), pos.alias("positives"),
        F.greatest(F.lit(1.0), F.least(F.lit(limit), ratio)).alias("pos_weight"))


def balanced_weights(truth: DataFrame) -> DataFrame:
    """(label, y, weight): n / (2 n_class), so both classes of a label weigh the same."""
    counts = truth.filter("y is not null").groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("n1"))
    return counts.select("label", F.explode(F.array(
        F.struct(F.lit(0.0).alias("y"), (F.col("n") - F.col("n1")).alias("k")),
        F.struct(F.lit(1.0).alias("y"), F.col("n1").alias("k")))).alias("c"), "n") \
        .filter("c.k > 0").select("label", "c.y", (F.col("n") / (2 * F.col("c.k"))).alias("weight"))
