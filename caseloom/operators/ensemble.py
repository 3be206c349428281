"""Rank normalisation, alignment, blending and greedy weights over prediction tables.

Predictions are long: (source, case_id, label, p). A p that is NULL or NaN is unknown: it has no rank, a blend or mean with
it is NULL, and the result fills it with the mean of the known ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clip, known
from ..session import partitions, written_table
from .metrics import auc_bounds, auc_of_histogram, histogram

STEP_GAIN = 1e-6
BINS = (1 << 12, 1 << 16)  # of scores, tried in turn before scores are sorted
ROUNDING = 1e-12  # of sums and means of pairs
BITS = 60  # sources told apart in one number
FEW = 100_000  # distinct scores that every task may hold


def rank_normalize(predictions: DataFrame) -> DataFrame:
    """p becomes its average rank within (source, label) as a fraction in (0, 1]; ties share a rank, unknown ones have none."""
    keys = ["source", "label"]
    # Unknown scores have nothing to join; any share of the rows may be unknown, so a salt spreads them.
    salt = F.when(F.col("p").isNull(), F.pmod(F.xxhash64("case_id"), F.lit(1 << 16))).otherwise(0)
    cleaned = predictions.withColumn("p", known(F.col("p"))).withColumn("_salt", salt)
    ties = written_table(cleaned.filter("p is not null").groupBy(*keys, "p").agg(F.count("*").alias("n")), "scores")
    ranks = _ranks(ties, keys).withColumn("_salt", F.lit(0))
    if ties.count() <= FEW:  # then the predictions need not move
        ranks = F.broadcast(ranks)
    # The score comes first: sorting by it rarely needs to look at the names.
    return cleaned.join(ranks, ["p", *keys, "_salt"], "left").select("source", "case_id", "label", F.col("rank").alias("p"))


def _ranks(ties: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, rank) of distinct scores and their counts `n`: rows go to ranges and are counted there in the order of p."""
    ordered = ties.select(*keys, "p", "n").repartitionByRange(partitions(ties.sparkSession), *keys, "p").sortWithinPartitions("p")
    kinds = ", ".join(f"`{k}` {ties.schema[k].dataType.simpleString()}" for k in keys)
    counted = written_table(ordered.mapInArrow(_counted_in_order(len(keys)), f"{kinds}, p double, n long, below long, _range int"), "ranks")
    totals = counted.groupBy(*keys, "_range").agg(F.sum("n").alias("own"))
    group = Window.partitionBy(*keys)
    earlier = F.coalesce(F.sum("own").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*keys, "_range", earlier.alias("earlier"), F.sum("own").over(group).alias("size"))
    rank = (F.col("earlier") + F.col("below") + (F.col("n") + 1) / 2) / F.col("size")
    return counted.join(F.broadcast(totals), [*keys, "_range"]).select(*keys, "p", rank.alias("rank"))


def _counted_in_order(n_keys: int):
    """Adds, to rows in the order of p whose first columns are keys and whose last is a count, the sum of counts before each in
    its group and task, and the number of the task."""
    def run(parts):
        from pyspark import TaskContext

        number, totals = TaskContext.get().partitionId(), {}
        for part in parts:
            if not part.num_rows:
                continue
            code = np.zeros(part.num_rows, np.int64)
            for i in range(n_keys):
                held = part.column(i).dictionary_encode(null_encoding="encode")
                code = code * len(held.dictionary) + held.indices.to_numpy()
            n = part.column(n_keys + 1).to_numpy()
            below = np.empty(len(n), np.int64)
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            for g, at in enumerate(first.tolist()):
                key = tuple(part.column(i)[at].as_py() for i in range(n_keys))
                own = np.flatnonzero(group == g) if len(first) > 1 else slice(None)
                sums = np.cumsum(n[own]) + totals.get(key, 0)
                below[own] = sums - n[own]
                totals[key] = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(below, pa.int64()), pa.array(np.full(len(n), number, np.int32))],
                                             [*part.schema.names, "below", "_range"])

    return run


def common_cases(predictions: DataFrame, sources: list[str]) -> DataFrame:
    """Cases that every source has predicted."""
    seen = predictions.filter(F.col("source").isin(sources)).groupBy("case_id").agg(*[
        F.bool_or(F.col("source") == s).alias(f"s{i}") for i, s in enumerate(sources)])
    return seen.filter(" and ".join(f"s{i}" for i in range(len(sources)))).select("case_id")


def align(predictions: DataFrame, sources: list[str]) -> DataFrame:
    """Predictions restricted to the common cases."""
    return predictions.filter(F.col("source").isin(sources)).join(
        common_cases(predictions, sources), "case_id", "left_semi")


def alignment_losses(predictions: DataFrame, sources: list[str]) -> DataFrame:
    """(source, cases, used): how many cases of each source alignment keeps."""
    seen = predictions.select("source", "case_id").distinct()
    common = common_cases(predictions, sources).withColumn("kept", F.lit(True))
    return seen.join(common, "case_id", "left").groupBy("source").agg(
        F.count("*").alias("cases"), F.count("kept").alias("used"))


def _lookup(name: Column, values: dict[str, float]) -> Column:
    case = F
    for key, value in values.items():
        case = case.when(name == key, F.lit(float(value)))
    return case


def _bit(name: Column, values: list[str]) -> Column:
    """A bit of its own for each of the values; NULL for others."""
    case = F
    for i, value in enumerate(values):
        case = case.when(name == value, F.lit(1 << i).cast("long"))
    return case


def blend(predictions: DataFrame, weights: dict[str, float], method: str = "rank") -> DataFrame:
    """(case_id, label, p): weighted mean of (rank-normalised) predictions over the common cases.

    Ranks are taken within each full source, before alignment. Sources without weight are left out. A cell that some used
    source has not scored (unknown p) stays, with NULL.
    """
    used = {s: w for s, w in weights.items() if w > 0}
    chosen = predictions.filter(F.col("source").isin(list(used)))
    if method == "rank":
        chosen = rank_normalize(chosen)
    # One aggregate does both: a bit a source tells whether all are there. Distinct counts would take two tables more a task.
    groups = [list(used)[i:i + BITS] for i in range(0, len(used), BITS)]
    weighted = chosen.groupBy("case_id", "label").agg(
        *[F.bit_or(_bit(F.col("source"), g)).alias(f"k{i}") for i, g in enumerate(groups)],
        F.bool_and(known(F.col("p")).isNotNull()).alias("whole"),
        F.sum(_lookup(F.col("source"), used) * F.col("p")).alias("s"))
    for i, g in enumerate(groups):
        weighted = weighted.filter(F.col(f"k{i}") == (1 << len(g)) - 1)
    return weighted.select(
        "case_id", "label", F.when(F.col("whole"), F.col("s") / sum(used.values())).alias("p"))


def equal_mean(predictions: DataFrame) -> DataFrame:
    """(case_id, label, p): plain mean over models, folds or views; NULL where one of them is unknown."""
    whole = F.bool_and(known(F.col("p")).isNotNull())
    return predictions.groupBy("case_id", "label").agg(F.when(whole, F.avg("p")).alias("p"))


def _one_row_per_cell(predictions: DataFrame, sources: list[str]) -> DataFrame:
    """(case_id, label, p0, p1, ...) over the cells that all sources have."""
    wide = predictions.filter(F.col("source").isin(sources)).groupBy("case_id", "label").agg(*[
        F.max(F.when(F.col("source") == s, known(F.col("p")))).alias(f"p{i}") for i, s in enumerate(sources)])
    return wide.filter(" and ".join(f"p{i} is not null" for i in range(len(sources))))


def fit_weights(predictions: DataFrame, gold: DataFrame, sources: list[str], method: str = "rank",
                steps: int = 30) -> tuple[dict[str, float], DataFrame]:
    """Greedy forward selection with replacement on the macro AUC over known truth.

    Every step bounds the AUC of all candidates by counts in bins of the score; only candidates that the bounds do not tell
    apart, and the scores of the table, are settled from sorted scores. The driver sees a few numbers per candidate.
    Returns the weights and a table (model, oof_macro_auc, weight) with a last row for the ensemble.
    """
    if method == "rank":
        predictions = rank_normalize(predictions.filter(F.col("source").isin(sources)))
    # Written once: all further steps read the cells and not what they come from.
    labelled = gold.select("case_id", "label", "y", F.lit(True).alias("_gold"))
    cells = written_table(_one_row_per_cell(predictions, sources).join(labelled, ["case_id", "label"], "left"), "cells")
    alone = cells.filter("_gold is null").select("case_id")
    if not alone.isEmpty():
        missing = alone.join(gold, "case_id", "left_anti").distinct().count()
        if missing:
            raise KeyError(f"{missing} predicted cases are missing from the labels")
    cells = cells.filter("y is not null").select("label", "y", *[f"p{i}" for i in range(len(sources))])
    ends = cells.agg(*[f(f"p{i}").alias(f"{n}{i}") for i in range(len(sources)) for n, f in (("low", F.min), ("high", F.max))]).head()

    def mixed(counts: tuple[int, ...], values: list):
        picked = [c * v for c, v in zip(counts, values, strict=True) if c]
        total = picked[0]
        for part in picked[1:]:
            total = total + part
        return total / sum(counts)

    def mixture(counts: tuple[int, ...]) -> Column:
        return mixed(counts, [F.col(f"p{i}") for i in range(len(sources))])

    def scored(trials: list[tuple[int, ...]], *more) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(i).alias("trial"), mixture(t).alias("p"), *[f(t) for f in more]) for i, t in enumerate(trials)])
        return cells.select("label", "y", F.inline(rows))

    settled: dict[tuple[int, ...], float] = {}

    def exact(trials: list[tuple[int, ...]]) -> list[float]:
        new = [t for t in dict.fromkeys(trials) if t not in settled]
        if new:
            per_label = auc_of_histogram(histogram(scored(new), ["trial", "label"]), ["trial", "label"])
            found = {r["trial"]: r["m"] for r in per_label.groupBy("trial").agg(F.avg("auc").alias("m")).collect()}
            settled.update({t: found[i] if found.get(i) is not None else float("-inf") for i, t in enumerate(new)})
        return [settled[t] for t in trials]

    def bounds(trials: list[tuple[int, ...]], bins: int) -> list[tuple[float, float]]:
        """The least and the largest value that the score of each trial can have."""
        def place(counts: tuple[int, ...]) -> Column:
            low, high = (mixed(counts, [ends[f"{n}{i}"] or 0.0 for i in range(len(sources))]) for n in ("low", "high"))
            share = (mixture(counts) - low) / ((high - low) or 1.0)  # rises with the score, so bins are in its order
            return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * bins).cast("int").alias("bin")

        found = {r["trial"]: r for r in auc_bounds(scored(trials, place), ["trial", "label"]).groupBy("trial").agg(
            F.avg("low").alias("low"), F.avg("high").alias("high")).collect()}
        none = float("-inf")
        return [(settled[t],) * 2 if t in settled else (none, none) if i not in found or found[i]["low"] is None
                else (found[i]["low"] - ROUNDING, found[i]["high"] + ROUNDING) for i, t in enumerate(trials)]

    def first_best(trials: list[tuple[int, ...]]) -> int:
        """The first of the best trials."""
        rest = list(range(len(trials)))
        for bins in BINS:
            if len(rest) > 1:
                found = bounds([trials[i] for i in rest], bins)
                least = max(low for low, _ in found)
                rest = [i for i, (_, high) in zip(rest, found, strict=True) if high >= least]
        if len(rest) == 1:
            return rest[0]
        return rest[int(np.argmax(exact([trials[i] for i in rest])))]

    def gains(trial: tuple[int, ...], old: tuple[int, ...]) -> bool:
        for bins in BINS:
            (low, high), (old_low, old_high) = bounds([trial, old], bins)
            if low > old_high + STEP_GAIN:
                return True
            if high <= old_low + STEP_GAIN:
                return False
        new, reached = exact([trial, old])
        return new > reached + STEP_GAIN

    def plus(counts: tuple[int, ...], i: int) -> tuple[int, ...]:
        return tuple(c + (j == i) for j, c in enumerate(counts))

    everyone = range(len(sources))
    singles = [plus((0,) * len(sources), i) for i in everyone]
    counts = singles[first_best(singles)]
    for _ in range(steps):
        trials = [plus(counts, i) for i in everyone]
        best = trials[first_best(trials)]
        if not gains(best, counts):
            break
        counts = best
    *single, reached = exact([*singles, counts])
    weights = {s: c / sum(counts) for s, c in zip(sources, counts)}
    rows = [(s, single[i], weights[s]) for i, s in enumerate(sources)] + [("ENSEMBLE", reached, 1.0)]
    table = predictions.sparkSession.createDataFrame(rows, "model string, oof_macro_auc double, weight double")
    return weights, table


def spec_json(spark: SparkSession, method: str, weights: dict[str, float]) -> DataFrame:
    """One row `value` holding the ensemble specification as JSON text."""
    spec = spark.createDataFrame([(method, weights)], "method string, weights map<string,double>")
    return spec.select(F.to_json(F.struct("method", "weights")).alias("value"))


def read_spec(spark: SparkSession, path: str) -> tuple[str, dict[str, float]]:
    parsed = spark.read.text(path, wholetext=True).select(
        F.from_json("value", "method string, weights map<string,double>").alias("s")).first()["s"]
    return parsed["method"] or "rank", dict(parsed["weights"] or {})


def choose_sources(scored: DataFrame, order: tuple[str, ...], min_positives: int, fallback: str) -> DataFrame:
    """(label, source): the best AUC per label, the earlier source on a tie.

    Labels with too few positives or a single class take the fallback. `scored` has a source column.
    """
    per_source = auc_of_histogram(histogram(scored, ["source", "label"]), ["source", "label"])
    place = _lookup(F.col("source"), {s: -i for i, s in enumerate(order)})
    best = per_source.groupBy("label").agg(
        F.max("positives").alias("positives"),
        F.max_by("source", F.when(F.col("auc").isNotNull(), F.struct("auc", place.alias("o")))).alias("best"))
    learnable = (F.col("positives") >= min_positives) & F.col("best").isNotNull()
    return best.select("label", F.when(learnable, F.col("best")).otherwise(fallback).alias("source"))


def combine(predictions: DataFrame, chosen: DataFrame) -> DataFrame:
    """(case_id, label, p) of the chosen source of every label. `chosen` has one row per label."""
    return predictions.join(F.broadcast(chosen), ["label", "source"]).select("case_id", "label", "p")


def blend_groups(predictions: DataFrame, spec: tuple[str, dict[str, float]] | None, sources: list[str]) -> DataFrame:
    """Blend as a specification says; without one, or with no weight on any source, the equal mean."""
    method, weights = spec or ("mean", {})
    weights = {s: weights.get(s, 0.0) for s in sources}
    if sum(weights.values()) == 0:
        method, weights = "mean", {s: 1.0 for s in sources}
    if len(sources) == 1 and method != "mean":  # ranks of a single source would change nothing but its scale
        return predictions.filter(F.col("source") == sources[0]).select("case_id", "label", "p")
    return blend(predictions, weights, method)


def assemble_result(cases: DataFrame, blended: DataFrame, labels: list[str]) -> DataFrame:
    """One row per requested case with all labels in order.

    Cases without a known prediction get the column mean of the known ones (0.5 if there is none); values are limited to
    [0, 1]. `cases` may carry further columns such as a row index; they are kept.
    """
    columns = [f"_p{i}" for i in range(len(labels))]
    wide = written_table(blended.groupBy("case_id").agg(*[
        F.max(F.when(F.col("label") == l, known(F.col("p")))).alias(c) for c, l in zip(columns, labels, strict=True)]), "blended")
    # One mean per label comes to the driver and goes into the plan as a constant.
    mean = wide.agg(*[F.avg(c).alias(c) for c in columns]).head() if labels else {}
    fill = [0.5 if mean[c] is None else mean[c] for c in columns]
    return cases.join(wide, "case_id", "left").select(
        *cases.columns, *[clip(F.coalesce(c, F.lit(fill[i]))).alias(labels[i]) for i, c in enumerate(columns)])
