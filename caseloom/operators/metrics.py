"""Ranking metrics per label: AUC, average precision, F1, bootstrap intervals, error tables.

Scored tables are long: keys (such as source and label), `p` and `y`, with NULL for unknown truth.
Everything works on the histogram of distinct scores, so ties are exact and a score shared by a third
of all rows is a single row after map-side aggregation.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from .prefix import RANGE, running_totals, with_ranges

DIGITS = 5  # to the base 16, of a number of resampled rows


def histogram(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, pos, neg) over known cells with a score; soft truth counts as positive from 0.5."""
    return scored.filter("y is not null and p is not null and not isnan(p)").groupBy(*keys, "p").agg(
        F.count_if(F.col("y") >= 0.5).alias("pos"), F.count_if(F.col("y") < 0.5).alias("neg"))


def auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, positives, auc) for all keys of `scored`; NULL where fewer than two classes are known."""
    return for_all_keys(scored, keys, auc_of_histogram(histogram(scored, keys), keys), {"n": 0, "positives": 0})


def for_all_keys(scored: DataFrame, keys: list[str], found: DataFrame, empty: dict[str, float]) -> DataFrame:
    """`found` with a row for keys that have no known cell, which count as `empty`."""
    found = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    out = scored.select(*keys).distinct().join(found, same, "left").drop(*[f"_{k}" for k in keys])
    return out.fillna(empty)


def auc_of_histogram(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Mid-rank AUC. Each score range counts its own pairs; pairs across ranges follow from range totals."""
    return _auc_of_ranges(hist.repartitionByRange(*keys, "p").withColumn(RANGE, F.spark_partition_id()), keys)


def _auc_of_ranges(ranged: DataFrame, keys: list[str]) -> DataFrame:
    below = Window.partitionBy(*keys, RANGE).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    parts = ranged.withColumn("won", pairs).groupBy(*keys, RANGE).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    total = parts.withColumn("won", won).groupBy(*keys).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("won").alias("won"))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    return total.select(*keys, (F.col("pos") + F.col("neg")).cast("long").alias("n"),
                        F.col("pos").cast("long").alias("positives"),
                        F.when(both, F.col("won") / (F.col("pos").cast("double") * F.col("neg"))).alias("auc"))


def auc_bounds(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, low, high): between which values the AUC lies, from counts in a bounded number of bins in the order of p.

    `scored` has a column `bin`. Only pairs within a bin are open, and not those of a bin with a single score.
    """
    counted = scored.filter("y is not null and p is not null and not isnan(p)").groupBy(*keys, "bin").agg(
        F.count_if(F.col("y") >= 0.5).alias("pos"), F.count_if(F.col("y") < 0.5).alias("neg"),
        F.min("p").alias("first"), F.max("p").alias("last"))
    below = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    apart, inside = F.col("pos") * F.coalesce(F.sum("neg").over(below), F.lit(0)), F.col("pos").cast("double") * F.col("neg")
    one = F.col("first") == F.col("last")
    total = counted.select(*keys, "pos", "neg", (apart + F.when(one, inside / 2).otherwise(0.0)).alias("low"),
                           (apart + F.when(one, inside / 2).otherwise(inside)).alias("high")).groupBy(*keys).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("low").alias("low"), F.sum("high").alias("high"))
    pairs = F.nullif(F.col("pos").cast("double") * F.col("neg"), F.lit(0.0))
    return total.select(*keys, (F.col("low") / pairs).alias("low"), (F.col("high") / pairs).alias("high"))


def macro_auc(per_label: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over labels; labels without a defined AUC are left out."""
    return per_label.groupBy(*(keys or [])).agg(F.avg("auc").alias("macro_auc"))


def label_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, positives, auc, ap, f1_at_half, best_f1) from one pass over the score curve."""
    hist = written_table(histogram(scored, keys), "histogram")
    curve = running_totals(hist, keys, [-F.col("p")], {"tp0": F.col("pos"), "fp0": F.col("neg")})
    size = hist.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    curve = curve.join(size, keys).withColumns({"tp": F.col("tp0") + F.col("pos"), "fp": F.col("fp0") + F.col("neg")})
    tp, fp, n_pos, n_neg = F.col("tp"), F.col("fp"), F.col("n_pos"), F.col("n_neg")
    half = F.col("p") >= 0.5
    stats = curve.groupBy(*keys).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"),
        F.sum(F.col("pos") * (n_neg - fp + F.col("neg") / 2)).alias("won"),
        F.sum(F.col("pos") * tp / (tp + fp)).alias("precision_sum"),
        F.max(2 * tp / (tp + fp + n_pos)).alias("best_f1"),
        F.sum(F.when(half, F.col("pos")).otherwise(0)).alias("tp_half"),
        F.sum(F.when(half, F.col("neg")).otherwise(0)).alias("fp_half"))
    both = (n_pos > 0) & (n_neg > 0)
    called = F.col("tp_half") + F.col("fp_half") + n_pos
    found = stats.select(
        *keys, (n_pos + n_neg).cast("long").alias("n"), n_pos.cast("long").alias("positives"),
        F.when(both, F.col("won") / (n_pos.cast("double") * n_neg)).alias("auc"),
        F.when(both, F.col("precision_sum") / n_pos).alias("ap"),
        F.when(called > 0, 2 * F.col("tp_half") / called).otherwise(0.0).alias("f1_at_half"),
        F.when(both, F.col("best_f1")).alias("best_f1"))
    return for_all_keys(scored, keys, found, {"n": 0, "positives": 0, "f1_at_half": 0.0})


def compare_sources(scored: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per label the metrics of every source side by side, and the macro means per source."""
    table = label_metrics(scored, ["source", "label"])
    measures = ("auc", "f1_at_half", "best_f1")
    side = table.groupBy("label").agg(*[
        F.max(F.when(F.col("source") == s, F.col(m))).alias(f"{s}_{m}") for s in sources for m in measures])
    means = table.groupBy("source").agg(*[F.avg(m).alias(m) for m in ("auc", "ap", "f1_at_half", "best_f1")])
    return side, means


@lru_cache(maxsize=256)
def _poisson_table(mean: int) -> tuple[int, np.ndarray]:
    """(first, cumulative probabilities from there on): all values of a Poisson variable that 53 bits can tell from certain."""
    width = 10 * math.sqrt(mean) + 30
    k = np.arange(max(0, math.floor(mean - width)), math.ceil(mean + width) + 1, dtype=float)
    gamma = np.cumsum(np.log(np.maximum(k, 1)))  # log k! up to the constant log (first)! below
    return int(k[0]), np.cumsum(np.exp(k * math.log(mean) - mean - (gamma - gamma[0]) - math.lgamma(k[0] + 1)))


@F.arrow_udf(T.LongType())
def _poisson(n: pa.Array, uniforms: pa.Array) -> pa.Array:
    """One Poisson draw a row, as a sum of independent ones whose means are the digits of n to the base 16.

    Each is drawn by inversion. Above the last digit, n is cut into as many draws of mean 16 ** DIGITS as it holds.
    """
    n = n.to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(uniforms.value_lengths().to_numpy(zero_copy_only=False))])
    flat, total = uniforms.flatten().to_numpy(zero_copy_only=False), np.zeros(len(n), np.int64)
    for level in range(DIGITS):
        digit = (n >> (4 * level)) & 15
        for d in range(1, 16):
            rows = np.flatnonzero(digit == d)
            if len(rows):
                first, table = _poisson_table(d << (4 * level))
                total[rows] += first + np.searchsorted(table, flat[ends[rows] + level], "left")
    first, table = _poisson_table(1 << (4 * DIGITS))
    for row in np.flatnonzero(n >> (4 * DIGITS)):
        u = flat[ends[row] + DIGITS:ends[row + 1]]
        total[row] += first * len(u) + np.searchsorted(table, u, "left").sum()
    return pa.array(total, pa.int64())


def poisson_weight(n: Column, *identity: Column, seed: int) -> Column:
    """A Poisson(n) draw that depends on nothing but its identity.

    n resampled rows that share one score are n independent Poisson(1) weights, and only their sum matters. The uniforms are
    52 bits of md5 over seed, identity and the number of the digit they serve.
    """
    named = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in identity])
    digits = F.sequence(F.lit(0), F.lit(DIGITS - 1) + F.shiftright(n, 4 * DIGITS).cast("int"))
    uniforms = F.transform(digits, lambda i: F.conv(F.left(F.md5(F.concat(named, F.lit(":"), i.cast("string"))), F.lit(13)), 16, 10).cast("double") / float(2 ** 52))
    return F.when(n > 0, _poisson(n, uniforms)).otherwise(0).cast("long")


def score_name(p: Column) -> Column:
    """A score as a whole number that names it (to a billionth of a thousandth), whatever language prints it."""
    return F.when(F.abs(p) < 1e6, F.floor(p * 1e12).cast("long")).otherwise(F.xxhash64(p))


def bootstrap_auc(scored: DataFrame, keys: list[str], replicates: int = 200, seed: int = 0,
                  alpha: float = 0.05) -> DataFrame:
    """(keys, ci_low, ci_high): percentile interval of the AUC over Poisson resamples.

    The number of rows in a resample varies around n instead of being n, so bounds agree with a
    fixed-size bootstrap statistically, not digit by digit. Single-class resamples are left out.
    """
    # Cells move before they multiply: one task holds a score range, and all its replicates stay there.
    cells = with_ranges(written_table(histogram(scored, keys), "histogram"), keys, [F.col("p")])
    cells = cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    who = [*[F.col(k) for k in keys], score_name(F.col("p")), F.col("rep")]
    drawn = cells.select(*keys, "rep", "p", RANGE, poisson_weight(F.col("pos"), *who, F.lit(1), seed=seed).alias("pos"),
                         poisson_weight(F.col("neg"), *who, F.lit(0), seed=seed).alias("neg"))
    # Empty cells weigh nothing in any resample.
    per_rep = _auc_of_ranges(drawn.filter("pos + neg > 0"), [*keys, "rep"])
    bounds = F.percentile("auc", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return per_rep.groupBy(*keys).agg(bounds.alias("b")).select(
        *keys, F.col("b")[0].alias("ci_low"), F.col("b")[1].alias("ci_high"))


def hardest_cases(scored: DataFrame, k: int = 5) -> DataFrame:
    """(label, hardest_fn, hardest_fp): lowest-scored positives and highest-scored negatives, best first.

    The rank filter lets Spark keep only k rows per group and map task before the shuffle.
    """
    known = scored.filter("y is not null and p is not null and not isnan(p)").select(
        "label", "case_id", (F.col("y") >= 0.5).alias("positive"), "p")
    known = known.withColumn("hard", F.when(F.col("positive"), F.col("p")).otherwise(-F.col("p")))
    order = Window.partitionBy("label", "positive").orderBy("hard", "case_id")
    best = known.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)

    def names(kind: Column) -> Column:
        entry = F.struct("r", F.col("case_id").cast("string").alias("case_id"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind, entry))), lambda x: x["case_id"]), ";")

    return best.groupBy("label").agg(names(F.col("positive")).alias("hardest_fn"),
                                     names(~F.col("positive")).alias("hardest_fp"))


def error_table(scored: DataFrame, top_k: int = 5, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Per label: size, prevalence, AUC with interval, hardest cases (only where both classes occur)."""
    base = auc(scored, ["label"])  # all labels, also those without a known cell
    ci = bootstrap_auc(scored, ["label"], replicates, seed)
    hard = hardest_cases(scored, top_k)
    both = F.col("auc").isNotNull()
    return base.join(ci, "label", "left").join(hard, "label", "left").select(
        "label", F.col("n").alias("n_labeled"), F.col("positives").alias("n_pos"),
        (F.col("positives") / F.nullif("n", F.lit(0))).alias("prevalence"), "auc",
        F.when(both, F.col("ci_low")).alias("ci_low"), F.when(both, F.col("ci_high")).alias("ci_high"),
        F.when(both, F.col("hardest_fn")).otherwise("").alias("hardest_fn"),
        F.when(both, F.col("hardest_fp")).otherwise("").alias("hardest_fp"))


def oof_report(predictions: DataFrame, gold: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions against ground truth: (macro AUC, error table)."""
    scored = predictions.join(gold, ["case_id", "label"])
    return macro_auc(auc(scored, ["label"])), error_table(scored, **options)
