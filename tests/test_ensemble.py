import numpy as np
import pandas as pd
import pytest

from caseloom.operators import ensemble, guards, labels

LABELS = ["A", "B"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    ids = [f"s{i:04d}" for i in range(300)]
    y = (rng.random((300, 2)) < .3).astype(float)
    wide = {"good": y * .6 + np.round(rng.random((300, 2)) * .7, 2), "noise": rng.random((300, 2))}
    rows = [(s, ids[i], l, float(w[i, j])) for s, w in wide.items() for i in range(300) for j, l in enumerate(LABELS)
            if not (s == "noise" and i < 10)]
    truth = [(ids[i], l, float(y[i, j])) for i in range(300) for j, l in enumerate(LABELS)]
    return (pd.DataFrame(rows, columns=["source", "case_id", "label", "p"]),
            spark.createDataFrame(rows, "source string, case_id string, label string, p double"),
            spark.createDataFrame(truth, "case_id string, label string, y double"))


def test_ranks_and_blend_equal_pandas(data):
    pdf, preds, _ = data
    pdf = pdf.assign(r=pdf.groupby(["source", "label"]).p.rank(method="average", pct=True))
    got = ensemble.rank_normalize(preds).toPandas().merge(pdf, on=["source", "case_id", "label"])
    assert len(got) == len(pdf) and np.allclose(got.p_x, got.r)
    both = pdf.pivot(index=["case_id", "label"], columns="source", values="r").dropna()
    expected = (both.good * .7 + both.noise * .3).rename("e").reset_index()
    out = ensemble.blend(preds, {"good": .7, "noise": .3, "other": 0.0}).toPandas().merge(expected, on=["case_id", "label"])
    assert len(out) == len(expected) == 580 and np.allclose(out.p, out.e)


def test_alignment_losses(data):
    got = {r["source"]: (r["cases"], r["used"]) for r in ensemble.alignment_losses(data[1], ["good", "noise"]).collect()}
    assert got == {"good": (300, 290), "noise": (290, 290)}


def test_greedy_weights_prefer_the_better_source(data):
    _, preds, truth = data
    weights, table = ensemble.fit_weights(preds, truth, ["good", "noise"], steps=4)
    score = {r["model"]: r["oof_macro_auc"] for r in table.collect()}
    assert weights["good"] > weights["noise"] and sum(weights.values()) == pytest.approx(1)
    assert score["ENSEMBLE"] >= score["good"] - 1e-9
    with pytest.raises(KeyError):
        ensemble.fit_weights(preds, truth.filter("case_id <> 's0100'"), ["good", "noise"], steps=1)


def test_choice_of_sources(data):
    _, preds, truth = data
    scored = preds.join(truth, ["case_id", "label"])
    assert {r["source"] for r in ensemble.choose_sources(scored, ("noise", "good"), 5, "noise").collect()} == {"good"}
    assert {r["source"] for r in ensemble.choose_sources(scored, ("noise", "good"), 500, "noise").collect()} == {"noise"}


def test_result_fills_missing_cases(spark):
    blended = spark.createDataFrame([("a", "A", .2), ("b", "A", .4), ("a", "B", 1.5), ("b", "B", .5)],
                                    "case_id string, label string, p double")
    cases = spark.createDataFrame([(0, "b"), (1, "x"), (2, "a")], "row_no long, case_id string")
    result = ensemble.assemble_result(cases, blended, LABELS)
    got = {r["case_id"]: (r["A"], r["B"]) for r in result.collect()}
    assert got["a"] == (.2, 1.0) and got["b"] == (.4, .5) and got["x"] == pytest.approx((.3, 1.0))
    guards.validate_result(result, cases, LABELS)
    empty = ensemble.assemble_result(cases, blended.limit(0), LABELS)
    assert {(r["A"], r["B"]) for r in empty.collect()} == {(.5, .5)}
    with pytest.raises(AssertionError, match="order"):
        guards.validate_result(result, cases.replace("x", "y"), LABELS)


def test_special_cases_of_a_specification(data):
    _, preds, _ = data
    single = preds.filter("source = 'good'")
    passed = ensemble.blend_groups(single, ("rank", {"good": 1.0}), ["good"]).toPandas()
    assert np.allclose(sorted(passed.p), sorted(single.toPandas().p))
    equal = ensemble.blend_groups(preds, ("rank", {"none": 1.0}), ["good", "noise"]).toPandas()
    assert len(equal) == 580


def test_specification_round_trip(spark, tmp_path):
    path = str(tmp_path / "spec")
    ensemble.spec_json(spark, "rank", {"a": .7, "b": .3}).write.text(path)
    assert ensemble.read_spec(spark, path) == ("rank", {"a": .7, "b": .3})


def test_merge_and_guard(spark):
    truth = spark.createDataFrame([("a", "A", 1.0), ("a", "B", None), ("b", "A", None), ("b", "B", None), ("c", "A", 0.0), ("c", "B", 1.0)],
                                  "case_id string, label string, y double")
    probs = truth.selectExpr("case_id", "label", "0.9D as p")
    merged = labels.merge_labels(truth, probs, LABELS)
    got = {r["case_id"]: r for r in merged.collect()}
    assert (got["a"]["A"], got["a"]["B"], got["a"]["A__true"], got["a"]["B__true"], got["a"]["label_source"]) == (1.0, .9, 1, 0, "mixed")
    assert got["b"]["label_source"] == "pseudo" and got["c"]["label_source"] == "true"
    assert got["c"]["pseudo_confidence"] is None and got["c"]["sample_weight"] == 1.0
    assert got["b"]["pseudo_confidence"] == pytest.approx(.8) and got["b"]["sample_weight"] == pytest.approx(.4)
    gold = labels.to_wide(truth, LABELS, "y")
    guards.check_no_leakage(merged, gold, LABELS)
    from pyspark.sql import functions as F
    with pytest.raises(guards.LeakageError, match="overwritten"):
        guards.check_no_leakage(merged.withColumn("A", 1 - F.col("A")), gold, LABELS)
    with pytest.raises(guards.LeakageError, match="held-out"):
        guards.check_no_leakage(merged, gold, LABELS, spark.createDataFrame([("b",)], "case_id string"))
    with pytest.raises(guards.LeakageError, match="report.*duplicate|duplicate.*report"):
        guards.check_no_leakage(merged.unionByName(merged).withColumn("Report", F.lit("x")), gold, LABELS)


def test_unknown_scores_stay_unknown(spark):
    nan = float("nan")
    preds = spark.createDataFrame([("s", "a", "A", .2), ("s", "b", "A", nan), ("s", "c", "A", None), ("s", "d", "A", .9),
                                   ("t", "a", "A", .4), ("t", "b", "A", .5), ("t", "c", "A", nan), ("t", "d", "A", None)],
                                  "source string, case_id string, label string, p double")
    ranks = {(r["source"], r["case_id"]): r["p"] for r in ensemble.rank_normalize(preds).collect()}
    assert ranks == {("s", "a"): .5, ("s", "b"): None, ("s", "c"): None, ("s", "d"): 1.0,
                     ("t", "a"): .5, ("t", "b"): 1.0, ("t", "c"): None, ("t", "d"): None}
    for blended in (ensemble.blend(preds, {"s": .5, "t": .5}, "mean"), ensemble.equal_mean(preds)):
        got = {r["case_id"]: r["p"] for r in blended.collect()}
        assert got["a"] == pytest.approx(.3) and got["b"] is got["c"] is got["d"] is None
    blended = spark.createDataFrame([("a", "A", .4), ("b", "A", nan), ("c", "A", None)], "case_id string, label string, p double")
    cases = spark.createDataFrame([("a",), ("b",), ("c",), ("x",)], "case_id string")
    got = {r["case_id"]: (r["A"], r["B"]) for r in ensemble.assemble_result(cases, blended, ["A", "B"]).collect()}
    assert got == dict.fromkeys("abcx", (.4, .5))


def test_ranks_across_batches_and_tasks_equal_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"source": rng.choice(["s", "t"], 30_000), "case_id": np.arange(30_000).astype(str), "label": rng.choice(["A", "B"], 30_000),
                        "p": np.round(rng.random(30_000), 4)})
    pdf["r"] = pdf.groupby(["source", "label"]).p.rank(method="average", pct=True)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = ensemble.rank_normalize(spark.createDataFrame(pdf.drop(columns="r"))).toPandas().merge(pdf, on="case_id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(pdf) and np.allclose(got.p_x, got.r)


def _greedy(wide, y, steps):
    """Plain forward selection on the AUC of one label, ties to the first source."""
    def auc(p):
        r = pd.Series(p).rank().to_numpy()
        n = y.sum()
        return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))
    counts = [0] * len(wide)
    score = lambda c: auc(sum(k * w for k, w in zip(c, wide) if k) / sum(c))
    plus = lambda i: [k + (j == i) for j, k in enumerate(counts)]
    reached = -1.0
    for _ in range(steps + 1):
        found = [score(plus(i)) for i in range(len(wide))]
        best = int(np.argmax(found))
        if found[best] <= reached + ensemble.STEP_GAIN:
            break
        counts, reached = plus(best), found[best]
    return counts, reached


@pytest.mark.parametrize("twin", [False, True])
def test_greedy_steps_sort_no_scores_unless_counts_leave_them_open(spark, monkeypatch, twin):
    rng = np.random.default_rng(5)
    y = (rng.random(4000) < .4).astype(float)
    wide = [rng.random(4000) + y * (np.arange(4000) % 3 == i) * (i + 1) / 4 for i in range(3)]
    if twin:  # no counts tell equal sources apart
        wide[1] = wide[2]
    rows = [(f"s{i}", str(c), "A", float(p)) for i, w in enumerate(wide) for c, p in enumerate(w)]
    preds = spark.createDataFrame(rows, "source string, case_id string, label string, p double")
    truth = spark.createDataFrame([(str(c), "A", float(v)) for c, v in enumerate(y)], "case_id string, label string, y double")
    calls, sorted_scores = [], ensemble.auc_of_histogram
    monkeypatch.setattr(ensemble, "auc_of_histogram", lambda *a: calls.append(1) or sorted_scores(*a))
    weights, table = ensemble.fit_weights(preds, truth, ["s0", "s1", "s2"], method="mean", steps=12)
    counts, reached = _greedy(wide, y, 12)
    assert weights == pytest.approx({f"s{i}": c / sum(counts) for i, c in enumerate(counts)}) and sum(counts) >= 2
    assert {r["model"]: r["oof_macro_auc"] for r in table.collect()}["ENSEMBLE"] == pytest.approx(reached, abs=1e-12)
    assert twin or len(calls) == 1


def test_blend_counts_a_source_once_and_needs_no_distinct(spark):
    preds = spark.createDataFrame([("s", "a", "A", .2), ("s", "a", "A", .2), ("t", "b", "A", .4), ("s", "b", "A", .6)],
                                  "source string, case_id string, label string, p double")
    out = ensemble.blend(preds, {"s": .5, "t": .5}, "mean")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2, plan  # one table before and one after the exchange
    assert [(r["case_id"], r["p"]) for r in out.collect()] == [("b", pytest.approx(.5))]
