import numpy as np
from pyspark.sql import functions as F

from caseloom.operators import pooling


def test_wide_vectors_pool_like_numpy(spark):
    r = np.random.default_rng(0)
    dim, sizes = 1024, {("a", 1): 2500, ("a", None): 3, (None, 1): 40, ("b", 2): 1}
    rows, want = [], {}
    for (g, h), n in sizes.items():
        x, s = r.standard_normal((n, dim)).astype(np.float32), r.standard_normal(n) * 30 + 700
        off = r.random(n) < .2 if n > 1 else np.array([True])
        rows += [(g, h, [float(v) for v in x[i]], float(s[i]), bool(off[i])) for i in range(n)]
        w = np.where(off, 0, np.exp(s - s[~off].max())) if (~off).any() else np.zeros(n)
        want[g, h] = (w[:, None] * x).sum(0) / w.sum() if w.sum() else np.zeros(dim)
    rows += [("nan", 1, [1.0] * dim, float("nan"), False), ("nan", 1, [2.0] * dim, 0.0, False)]
    want["nan", 1] = np.full(dim, 2.0)
    df = spark.createDataFrame(rows, "g string, h int, x array<float>, score double, off boolean").repartition(7)
    got = {(q["g"], q["h"]): q["pooled"] for q in pooling.attention_pool(df, ["g", "h"], "x", dim, masked=F.col("off")).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, x array<float>, score double")
    assert pooling.attention_pool(df, ["g"], "x", 4).collect() == []
