import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caseloom.functions import losses
from caseloom.operators import metrics, prefix


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def brute_curve(y, p):
    ap, best, prev = 0.0, 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, fp = ((p >= t) & (y == 1)).sum(), ((p >= t) & (y == 0)).sum()
        recall = tp / (y == 1).sum()
        ap, prev = ap + (recall - prev) * tp / (tp + fp), recall
        best = max(best, 2 * tp / (tp + fp + (y == 1).sum()))
    return ap, best


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    n = 1200
    pdf = pd.DataFrame({"case_id": [f"c{i}" for i in range(n)], "label": rng.choice(["A", "B"], n)})
    pdf["y"] = (rng.random(n) < 0.3).astype(float)
    pdf["p"] = np.where(rng.random(n) < 0.4, 0.25, np.round(0.6 * rng.random(n) + 0.3 * pdf.y, 2))  # one hot score
    known = rng.random(n) > 0.2
    df = spark.createDataFrame(pdf.assign(known=known)).withColumn("y", F.when(F.col("known"), F.col("y"))).drop("known")
    return pdf[known], df


def test_curve_metrics_equal_brute_force(scored):
    pdf, df = scored
    table = {r["label"]: r for r in metrics.label_metrics(df, ["label"]).collect()}
    fast = {r["label"]: r["auc"] for r in metrics.auc(df, ["label"]).collect()}
    for label, part in pdf.groupby("label"):
        y, p = part.y.to_numpy(), part.p.to_numpy()
        ap, best = brute_curve(y, p)
        tp, fp = ((p >= .5) & (y == 1)).sum(), ((p >= .5) & (y == 0)).sum()
        row = table[label]
        assert row["n"] == len(part) and row["positives"] == y.sum()
        assert row["auc"] == pytest.approx(brute_auc(y, p)) and fast[label] == pytest.approx(brute_auc(y, p))
        assert row["ap"] == pytest.approx(ap) and row["best_f1"] == pytest.approx(best)
        assert row["f1_at_half"] == pytest.approx(2 * tp / (tp + fp + y.sum()))


def test_single_class_and_unknown_cells(spark):
    df = spark.createDataFrame([("A", 1.0, .9), ("A", 0.0, .1), ("A", None, .0), ("B", 0.0, .1), ("B", 0.0, .2)],
                               "label string, y double, p double")
    got = {r["label"]: r for r in metrics.label_metrics(df, ["label"]).collect()}
    assert got["A"]["auc"] == 1.0 and got["A"]["n"] == 2
    assert got["B"]["auc"] is None and got["B"]["f1_at_half"] == 0.0
    assert metrics.macro_auc(metrics.auc(df, ["label"])).first()[0] == 1.0


def test_error_table(spark):
    df = spark.createDataFrame([("A", f"s{i}", y, p) for i, (y, p) in enumerate([(1., .9), (1., .2), (0., .8), (0., .1)], 1)],
                               "label string, case_id string, y double, p double")
    row = metrics.error_table(df, top_k=1, replicates=20).first()
    assert (row["hardest_fn"], row["hardest_fp"], row["auc"], row["prevalence"]) == ("s2", "s3", 0.75, 0.5)


def test_bootstrap_interval(scored):
    pdf, df = scored
    for row in metrics.bootstrap_auc(df, ["label"], 1000).collect():
        part = pdf[pdf.label == row["label"]]
        y, p = part.y.to_numpy(), part.p.to_numpy()
        rng = np.random.default_rng(0)
        draws = [brute_auc(y[i], p[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(1000))]
        assert row["ci_low"] == pytest.approx(np.percentile(draws, 2.5), abs=0.008)
        assert row["ci_high"] == pytest.approx(np.percentile(draws, 97.5), abs=0.008)


def test_poisson_weights(spark):
    df = spark.range(4000).select("id", F.explode(F.array(F.lit(1), F.lit(5), F.lit(80))).alias("n"))
    draws = df.select("n", metrics.poisson_weight(F.col("n"), F.col("id"), F.col("n"), seed=3).alias("w"))
    for r in draws.groupBy("n").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect():
        assert r["m"] == pytest.approx(r["n"], rel=0.06) and r["v"] == pytest.approx(r["n"], rel=0.12)


def test_poisson_draws_of_any_size_follow_their_distribution(spark):
    for n in (1, 3, 16, 31, 100, 4097, 70_000, 3 << 20):  # one digit, several, and above the last
        draws = spark.range(4000).select(metrics.poisson_weight(F.lit(n).cast("long"), F.col("id"), seed=n).alias("w")).toPandas().w.to_numpy()
        assert abs(draws.mean() - n) < 4.5 * np.sqrt(n / 4000), n
        assert abs(draws.var() / n - 1) < .12, n
        cumulative = lambda k, n=n: metrics._poisson_table(n)[1][int(k) - metrics._poisson_table(n)[0]]
        middle = int(n)
        assert abs((draws <= middle).mean() - cumulative(middle)) < .04, n


def test_running_totals_over_hot_and_tiny_groups(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("g"), "id",
                                  (F.col("id") % 7).alias("v"))
    got = prefix.running_totals(df, ["g"], [F.col("id").desc()], {"before": F.col("v")}).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("id", ascending=False)
        assert (part.before.to_numpy() == part.v.cumsum().shift(fill_value=0).to_numpy()).all()
    numbers = prefix.row_numbers(df.select("id"), [], [F.col("id")]).toPandas()
    assert (numbers.id == numbers.row_no).all()


def test_losses(spark):
    data = [(-3.0, 1.0), (0.4, 0.0), (2.0, 1.0), (50.0, 0.0)]
    df = spark.createDataFrame(data, "z double, y double")
    z, y = F.col("z"), F.col("y")
    got = df.select(losses.bce_with_logits(z, y, F.lit(3.0)), losses.focal_loss(z, y), losses.asymmetric_loss(z, y)).collect()
    for (a, b), row in zip(data, got):
        p = 1 / (1 + np.exp(-a))
        ce = -np.log(p) if b else np.logaddexp(0, a)
        pt = p if b else 1 - p
        neg = min(1 - p + .05, 1)
        asl = -(1 - p) * np.log(max(p, 1e-8)) if b else -(1 - neg) ** 4 * np.log(max(neg, 1e-8))
        assert row[0] == pytest.approx(ce * (3 if b else 1), rel=1e-9)
        assert row[1] == pytest.approx((.25 if b else .75) * (1 - pt) ** 2 * ce, rel=1e-9)
        assert row[2] == pytest.approx(asl, rel=1e-9)
    masked = spark.createDataFrame([(2.0, 1.0, .5), (9.0, None, 1.0), (4.0, 0.0, 1.0)], "l double, y double, w double")
    assert masked.select(losses.masked_mean(F.col("l"), F.col("y"), F.col("w"))).first()[0] == pytest.approx(5 / 1.5)
    assert masked.filter("y is null").select(losses.masked_mean(F.col("l"), F.col("y"))).first()[0] == 0.0
