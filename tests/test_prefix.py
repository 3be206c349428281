import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import prefix


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "LEAST_ROWS", 20)


def make(spark, n, parts=5):
    r = random.Random(n)
    rows = [(None if r.random() < .1 else r.choice(["a", "b", "é", "c"][:1 + i % 4]), r.choice([None, 1.5, float("nan"), -0.0, 2.0, r.random()]), i, r.randint(-3, 9))
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, x double, i long, n long").repartition(parts)


def expected(rows):
    order = lambda r: (r[1] is not None, r[1] != r[1], 0 if r[1] is None or r[1] != r[1] else r[1], r[2])
    out, sums = {}, {}
    for r in sorted(rows, key=order):
        out[r[2]] = tuple(sums.get(r[0], (0, 0)))
        a, b = sums.get(r[0], (0, 0))
        sums[r[0]] = (a + r[3], b + 1)
    return out


@pytest.mark.parametrize("n", [0, 1, 19, 300, 3000])
def test_running_totals_equal_a_loop(spark, small_ranges, n):
    rows, df = make(spark, n)
    got = prefix.running_totals(df, ["k"], [F.col("x"), F.col("i")], {"s": F.col("n"), "c": F.lit(1)})
    assert {r["i"]: (r["s"], r["c"]) for r in got.collect()} == expected(rows)


def test_descending_order(spark, small_ranges):
    rows, df = make(spark, 1500)
    got = prefix.row_numbers(df, ["k"], [F.col("x").desc(), F.col("i")], "no")
    down = lambda r: (0, 0) if r[1] != r[1] and r[1] is not None else (2, 0) if r[1] is None else (1, -r[1])
    want, seen = {}, {}
    for r in sorted(rows, key=lambda r: (down(r), r[2])):
        want[r[2]] = seen.get(r[0], 0)
        seen[r[0]] = want[r[2]] + 1
    assert {r["i"]: r["no"] for r in got.collect()} == want


def test_a_group_spreads_over_ranges_with_one_exchange_of_rows(spark, small_ranges):
    df = spark.range(4000).withColumn("k", F.lit("one")).withColumn("x", F.sha2(F.col("id").cast("string"), 256))
    ranged = prefix.with_ranges(df, ["k"], [F.col("x")])
    sizes = [r["count"] for r in ranged.groupBy(prefix.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 4000 / len(sizes)
    numbered = prefix.row_numbers(df, ["k"], [F.col("x")], "no")
    assert numbered.filter("no < 0 or no > 3999").count() == 0 and numbered.select("no").distinct().count() == 4000
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    # one exchange of the rows; the others carry totals of ranges
    assert plan.count("shufflepartitionidpassthrough") == 1 and "rangepartitioning" not in plan and "ExistingRDD" not in plan


def test_first_and_sharded_cases(spark, small_ranges):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("case_id"))
    ids = [r[0] for r in df.collect()]
    assert [r[0] for r in prefix.first_cases(df, "case_id", 7).collect()] == ids[:7]
    assert sorted(r[0] for r in prefix.shard(df, "case_id", 2, 3).collect()) == ids[2::3]
