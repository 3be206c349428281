"""Operators on the table of vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm import bond, hyperplane

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # names that the operators use inside
    T.StructField("rid", T.LongType()), T.StructField("n", T.StringType()), T.StructField("key", T.IntegerType()), T.StructField("vec", T.StringType())])


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, y, 7, "n", 1, "x") for i, v, y in rows], VECTORS).repartition(parts)


def grouped(seed, groups, noise, alone=150, dim=24):
    """Vectors around centres, as (vec_id, vector, label); ids are shuffled."""
    r = np.random.default_rng(seed)
    rows = [c + noise * r.standard_normal(dim) / math.sqrt(dim) for n, c in ((n, x / np.linalg.norm(x)) for n, x in ((n, r.standard_normal(dim)) for n in groups)) for _ in range(n)]
    rows += list(r.standard_normal((alone, dim)))
    ids = r.permutation(len(rows))
    return [(int(i), [float(x) for x in np.float32(v)], int(i) % 10) for i, v in zip(ids, rows, strict=True)]


AWKWARD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 2), (9004, [1.0, None] + [0.0] * 22, 3), (9005, [float("nan")] * 24, 4),
           (9006, [float("inf")] + [1.0] * 23, 5), (9007, [1.0, 2.0], None), (9008, [2.0, 4.0], 6), (9009, [3e38] * 24, 1), (9010, [1e-38] * 24, 1),
           (None, [1.0, 2.0], 1), (None, [-1.0, 5.0, 0.5], 1), (9011, [1.0, 2.0], 2), (9011, [1.0, 2.0], 2)]


def brute(rows, least=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, _ in rows]
    unit = [np.array(v, float) / np.abs(v).max() if good else None for (_, v, _), good in zip(rows, ok, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least_id = {}
    for i, (vid, _, _) in enumerate(rows):
        if vid is not None:
            least_id[find(i)] = min(vid, least_id.get(find(i), vid))
    return [(vid, links[i], least_id.get(find(i)), vid is not None and vid == least_id.get(find(i))) for i, (vid, _, _) in enumerate(rows)]


def dedup(df):
    return sorted((tuple(r) for r in hyperplane.near_duplicates(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def test_near_duplicates_equal_brute_force(spark):
    rows = grouped(3, [60, 30, 7, 2, 2], 0.08) + AWKWARD
    want = sorted(brute(rows), key=repr)
    assert dedup(frame(spark, rows)) == want
    assert sum(r[1] for r in want) > 2000


@pytest.mark.parametrize("noise", [0.08, 0.16, 0.2])
def test_crowded_buckets_equal_brute_force(spark, monkeypatch, noise):
    # a group far over the size of a cell: one ball at little noise; at more, balls and single rows that meet in blocks
    monkeypatch.setattr(hyperplane, "CELL", 16)
    rows = grouped(5, [150, 60], noise, alone=100)
    want, got = {r[0]: r for r in brute(rows)}, {r[0]: r for r in dedup(frame(spark, rows))}
    assert want.keys() == got.keys()
    assert all(got[i][1] <= want[i][1] for i in want)  # none below the least cosine, none counted twice
    found = sum(got[i][1] for i in want) / sum(r[1] for r in want.values())
    assert found == 1 if noise == 0.08 else found > 0.99
    assert np.mean([got[i][2:] == want[i][2:] for i in want]) > 0.99


def test_copies_count_without_being_compared(spark):
    rows = [(i, [1.0, 2.0, 2.0], 0) for i in range(3000)] + [(5000, [1.0, 2.0, 2.1], 0), (5001, [-1.0, 0.0, 0.0], 0)]
    got = {r[0]: r for r in dedup(frame(spark, rows))}
    assert got[17] == (17, 3000, 0, False) and got[0] == (0, 3000, 0, True)
    assert got[5000] == (5000, 3000, 0, False) and got[5001] == (5001, 0, 5001, True)


def test_no_vectors(spark):
    assert dedup(frame(spark, [])) == []
    assert dedup(frame(spark, [(1, None, 1), (None, None, None)])) == [(1, 0, 1, True), (None, 0, None, False)]


def test_recall_at_the_least_cosine():
    # pairs at exactly 0.95 share a bucket of some table as often as planned
    bits, tables = hyperplane.plan(50_000, 0.95)
    r = np.random.default_rng(0)
    planes = np.random.default_rng([hyperplane.SEED, 64]).standard_normal((64, bits * tables))
    a = r.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95 ** 2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    same = ((a @ planes >= 0) == (b @ planes >= 0)).reshape(4000, tables, bits).all(2).any(1)
    assert same.mean() > 0.98


def mined(df, positives=5, negatives=3):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = bond.hard_negatives(df, F.col("vec_id") % 50 == 0, moved, positives, negatives)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def brute_mined(rows, positives=5, negatives=3):
    use = [(i, [math.floor(256 * np.float64(np.float32(x))) for x in v], (y + 1) % 10 if i is not None and i % 7 == 0 else y)
           for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, (i, v, y) in enumerate(use):
        if i is None or i % 50:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0, j, z) for m, (j, w, z) in enumerate(use) if m != k and len(w) == len(v)]
        others.sort(key=lambda x: x[:3])
        for p in [x for x in others if x[4] == y][:positives]:
            fit = [x for x in others if x[4] != y and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:negatives]
            out += [(i, p[3], n, x[3], -p[0], -x[0]) for n, x in enumerate(fit, 1)]
    return sorted(out, key=repr)


SMALL = [x for x in AWKWARD if x[0] != 9009]


@pytest.mark.parametrize("block", [8192, 37])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bond, "BLOCK", block)
    monkeypatch.setattr(bond, "ANCHORS", 3)
    rows = grouped(9, [20, 15, 10, 5], 0.9, alone=350) + SMALL + [(50, [1.0, 2.0], 3), (50, [1.0, 2.0], 3), (100, [2.0, 1.0], 3), (150, [], 1), (200, [], 1)]
    want = brute_mined(rows)
    assert len(want) > 20
    assert mined(frame(spark, rows)) == want
    assert mined(frame(spark, rows), 2, 1) == brute_mined(rows, 2, 1)


def test_ties_take_smaller_ids(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(50, 60)] + [(i, [0.75, 0.25 * (i % 3)], 2) for i in range(100, 149)] + [(None, [0.75, 0.0], 2)]
    assert mined(frame(spark, rows)) == brute_mined(rows)


def test_many_columns_prune(spark):
    # wide vectors with a few large components: most columns are never read for most rows
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in r.standard_normal(70) * ([4.0] * 6 + [0.1] * 64)], int(i) % 4) for i in r.permutation(500)]
    assert mined(frame(spark, rows)) == brute_mined(rows)


def test_no_rows_to_mine(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(50, [1.0], None), (100, None, 1)])) == []


def test_components_beyond_exact_scores(spark):
    with pytest.raises(ArithmeticError):
        mined(frame(spark, [(50, [3e38], 1), (51, [1.0], 2)]))


@pytest.mark.parametrize("name", ["op12_hyperplane_dedup", "op13_bond_negatives"])
def test_equals_sql(spark, name):
    import duckdb

    from caseloom.llm import queries, sql

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(sql.SQL[name])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(cur.fetchall())
