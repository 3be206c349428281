import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.functions import geometry
from caseloom.functions.resample import resize_frame
from caseloom.operators import pooling, volume

SCHEMA = "case_id string, series_id string, slice_idx long, h int, w int, pixels array<float>"


def table(spark, arrays):
    rows = [("c", uid, k, a.shape[1], a.shape[2], a[k].ravel().tolist()) for uid, a in arrays.items() for k in range(len(a))]
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df, column="pixels"):
    out = {}
    for r in df.orderBy("series_id", "slice_idx").collect():
        out.setdefault(r["series_id"], []).append(np.array(r[column], float))
    return {k: np.array(x) for k, x in out.items()}


@pytest.fixture(scope="module")
def vols():
    rng = np.random.default_rng(0)
    big = rng.gamma(2, 300, (20, 6, 5)).astype(np.float32)
    big[:, 0] = 0
    return {"big": big, "small": np.arange(24, dtype=np.float32).reshape(2, 4, 3), "blank": np.zeros((3, 12, 12), np.float32)}


@pytest.mark.parametrize("name", list(volume.WINDOWS))
def test_window_equals_percentiles(spark, vols, name):
    got = arrays(volume.window_volume(table(spark, vols), name))
    for uid, v in vols.items():
        fg = v[v > v.min()]
        sample = fg if fg.size > 100 else v.ravel()
        lo, hi = np.percentile(sample.astype(float), volume.WINDOWS[name])
        expected = np.clip((v - lo) / (hi - lo), 0, 1) if hi > lo else np.zeros_like(v)
        assert np.allclose(got[uid], expected.reshape(len(v), -1), atol=1e-6), uid


@pytest.mark.parametrize("n,m", [(1, 5), (5, 5), (6, 5), (7, 5), (100, 32), (33, 32), (64, 3), (9, 1), (9, 2), (9, 0), (1000, 999)])
def test_even_choice(spark, n, m):
    expected = list(range(n)) if m <= 0 or n <= m else sorted(set(np.round(np.linspace(0, n - 1, m)).astype(int)))
    df = spark.range(n).filter(geometry.is_selected(F.col("id"), F.lit(n), m))
    assert [r[0] for r in df.orderBy("id").collect()] == expected


def test_selection_renumbers(spark, vols):
    got = volume.select_slices(table(spark, vols), 4).filter("series_id = 'big'").orderBy("slice_idx").collect()
    assert [(r["slice_idx"], r["source_idx"]) for r in got] == [(0, 0), (1, 6), (2, 13), (3, 19)]


def test_slabs_and_mip_across_chunks(spark, monkeypatch):
    monkeypatch.setattr(volume, "CHUNK", 4)
    v = np.random.default_rng(1).random((11, 2, 2)).astype(np.float32)
    df, flat = table(spark, {"s": v, "one": v[:1]}), v.reshape(11, 4)
    slabs = volume.make_slabs(df)
    before, after = arrays(slabs, "previous"), arrays(slabs, "following")
    assert np.allclose(before["s"], np.vstack([flat[:1], flat[:-1]])) and np.allclose(after["s"], np.vstack([flat[1:], flat[-1:]]))
    assert np.allclose(before["one"], flat[:1]) and np.allclose(after["one"], flat[:1])
    for t in (1, 2, 3, 4):
        half = t // 2
        padded = np.vstack([np.repeat(flat[:1], half, 0), flat, np.repeat(flat[-1:], max(t - 1 - half, 0), 0)])
        expected = np.array([padded[i:i + t].max(axis=0) for i in range(11)])
        assert np.allclose(arrays(volume.sliding_mip(df, t))["s"], expected), t


def test_letterbox(spark):
    df = table(spark, {"s": np.ones((1, 10, 20), np.float32)})
    out = arrays(volume.resize(df, 8))["s"].reshape(8, 8)
    assert (out.max(axis=1) > 0).sum() == 4 and np.allclose(out[2:6], 1) and out[:2].max() == 0
    assert arrays(volume.resize(df, 8, keep_aspect=False))["s"].min() > 0
    spaced = df.withColumn("pixel_spacing", F.array(F.lit(2.0), F.lit(1.0)))
    assert arrays(volume.resize(spaced, 8))["s"].min() > 0


def test_resampling_keeps_constants_and_ramps():
    assert np.allclose(resize_frame(np.full((7, 9), 3.0), 4, 13), 3.0)
    ramp = np.tile(np.arange(8.0), (8, 1))
    assert np.allclose(resize_frame(ramp, 8, 4)[0, 1:3], [2.5, 4.5])
    assert np.allclose(resize_frame(ramp, 8, 8), ramp)


def test_storage(spark):
    v = np.array([[[0, .5, 1, 2], [.1, -1, 2.5 / 255, 3.5 / 255]]], np.float32)
    stored = volume.to_storage(table(spark, {"s": v}))
    assert list(stored.first()["stored"]) == [0, 128, 255, 255, 26, 0, 2, 4] or list(stored.first()["stored"])[:6] == [0, 128, 255, 255, 26, 0]
    back = arrays(stored.withColumn("pixels", volume.from_storage(F.col("stored"))))["s"][0]
    assert np.allclose(back, np.clip(v, 0, 1).ravel(), atol=.5 / 255 + 1e-6)
    with pytest.raises(ValueError, match="unsupported"):
        volume.to_storage(table(spark, {"s": v}), "int64")


def test_preprocess(spark, vols):
    out = volume.preprocess(table(spark, vols), volume.PreprocessConfig(img_size=8, max_slices=5)).collect()
    counts = {uid: sum(r["series_id"] == uid for r in out) for uid in vols}
    assert counts == {"big": 5, "small": 2, "blank": 3} and all(len(r["stored"]) == 64 for r in out)
    assert max(max(r["stored"]) for r in out if r["series_id"] == "blank") == 0


def test_frame_normalisation(spark):
    rows = [("a", [1.0, 2.0, 3.0], 1, 2.0, -1.0, False), ("b", [1.0, 5.0], 1, 1.0, 0.0, True), ("c", [1.0, 2.0, 6.0, 0.0, 0.0, 3.0], 3, 1.0, 0.0, False)]
    df = spark.createDataFrame(rows, "id string, pixels array<float>, channels int, slope double, intercept double, inverted boolean")
    got = {r["id"]: list(r["pixels"]) for r in volume.normalise_frames(df).collect()}
    assert got == {"a": [1.0, 3.0, 5.0], "b": [4.0, 0.0], "c": [3.0, 1.0]}


def test_flip_dropout_and_jitter(spark, vols):
    df = table(spark, vols)
    assert np.allclose(arrays(volume.flip(df))["small"].reshape(2, 4, 3), vols["small"][:, :, ::-1])
    kept = volume.drop_slices(df, seed=1, probability=1.0)
    sizes = {r["series_id"]: r["count"] for r in kept.groupBy("series_id").count().collect()}
    assert sizes["small"] == 2 and 17 <= sizes["big"] <= 19
    out = arrays(volume.jitter(df, seed=1, probability=1.0))
    assert np.abs(out["big"]).max() <= 3 and np.allclose(out["blank"], 0)
    plain = vols["big"].reshape(20, -1)
    assert (np.argsort(out["big"][3]) == np.argsort(plain[3], kind="stable")).mean() > .5
    assert np.allclose(arrays(volume.jitter(df, seed=1, probability=0.0))["big"], plain)


def test_montage(spark, vols):
    df = table(spark, vols).withColumn("plane", F.col("series_id"))
    got = volume.montage_tiles(df, "plane", 1, 5).orderBy("plane", "tile").collect()
    tiles = lambda p: [r["slice_idx"] for r in got if r["plane"] == p]
    assert tiles("big") == [0, 5, 10, 14, 19] and tiles("small") == [0, 1, None, None, None]


def test_attention_pool_and_fusion(spark):
    rows = [("c", "axial", 0.0, [1.0, 0.0], False), ("c", "axial", np.log(3), [0.0, 1.0], False), ("c", "axial", 900.0, [9.0, 9.0], True),
            ("c", "coronal", 5.0, [4.0, 4.0], True), ("d", "sagittal", 800.0, [2.0, 1.0], False)]
    df = spark.createDataFrame([(a, b, float(s), x, m) for a, b, s, x, m in rows], "case_id string, plane string, score double, vec array<double>, pad boolean")
    pooled = pooling.attention_pool(df, ["case_id", "plane"], "vec", 2, masked=F.col("pad"))
    got = {(r["case_id"], r["plane"]): list(r["pooled"]) for r in pooled.collect()}
    assert got[("c", "axial")] == pytest.approx([.25, .75]) and got[("c", "coronal")] == [0, 0] and got[("d", "sagittal")] == [2, 1]
    fused = {r["case_id"]: list(r["fused"]) for r in pooling.concat_planes(pooled, 2).collect()}
    assert fused["c"] == pytest.approx([0, 0, 0, 0, .25, .75, 0, 1, 1]) and fused["d"] == [2, 1, 0, 0, 0, 0, 1, 0, 0]
    weights = pooling.attention_weights(df, ["case_id", "plane"], masked=F.col("pad")).groupBy("case_id", "plane").agg(F.sum("weight"))
    assert sorted(round(r[2], 9) for r in weights.collect()) == [0, 1, 1]
