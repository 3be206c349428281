import numpy as np
import pytest

from caseloom.operators import radix, volume
from caseloom.functions.geometry import selected_number
from pyspark.sql import functions as F


@pytest.mark.parametrize("kind", ["float", "double"])
def test_values_at_ranks_equal_a_sort(spark, kind):
    r = np.random.default_rng(4)
    pools = {"a": r.standard_normal(900) * 1e3, "b": np.round(r.standard_normal(600)), "c": np.array([0.0, -0.0, 5.0, -5.0] * 30),
             "d": np.array([np.nan, np.inf, -np.inf, 1.0, 2.0]), "e": np.full(50, -3.25)}
    rows, want = [], {}
    for name, values in pools.items():
        values = values.astype(np.float32) if kind == "float" else values
        cuts = sorted(r.integers(0, len(values), 4))
        rows += [(name, [float(x) for x in part]) for part in np.split(values, cuts)]
        ranks = [0, len(values) // 2, len(values) - 1, int(0.005 * (len(values) - 1))]
        want[name] = (ranks, np.sort(values + 0)[ranks])
    df = spark.createDataFrame(rows, f"g string, pixels array<{kind}>").repartition(4)
    ranks = spark.createDataFrame([(g, w[0]) for g, w in want.items()], "g string, ranks array<long>")
    got = {x["g"]: x["values"] for x in radix.values_at(df, ["g"], ranks).collect()}
    for g, (_, values) in want.items():
        assert np.array_equal(np.array(got[g]), values.astype(np.float64), equal_nan=True), g
    size = {x["g"]: (x["total"], x["floor_n"]) for x in radix.extent(df, ["g"]).collect()}
    assert size == {g: (len(v), int((v.astype(np.float32 if kind == "float" else float) == np.nanmin(v.astype(np.float32 if kind == "float" else float))).sum())) for g, v in pools.items()}


def test_bits_keep_the_order():
    for kind in (np.float32, np.float64):
        x = np.array([-np.inf, -1e30, -1.5, -1e-40, 0.0, 1e-40, 2.0, 1e30, np.inf, np.nan], kind)
        bits = radix.ordered_bits(x)
        assert (bits[1:] > bits[:-1]).all()
        assert np.array_equal(radix.floats(bits.astype(np.uint64), kind == np.float32), x, equal_nan=True)


def test_numbers_of_the_choice(spark):
    for n in (1, 2, 7, 31, 32, 33, 50, 1000):
        for limit in (0, 1, 2, 5, 32):
            df = spark.range(n).select(selected_number(F.col("id"), F.lit(n), limit).alias("j"), "id").filter("j is not null")
            got = {x["j"]: x["id"] for x in df.collect()}
            keep = list(range(n)) if limit <= 0 or n <= limit else [round(float(x)) for x in np.linspace(0, n - 1, limit)] if limit > 1 else [0]
            assert got == dict(enumerate(keep)), (n, limit)


def test_no_row_for_each_pixel(spark):
    frames = spark.createDataFrame([("c", "s", i, 4, 4, [float(x) for x in range(16)]) for i in range(3)],
                                   "case_id string, series_id string, slice_idx int, h int, w int, pixels array<float>")
    plan = volume.preprocess(frames)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(pixels" not in plan and "Generate explode(pixels" not in plan


def test_counts_are_summed_over_the_frames_of_a_batch():
    import pyarrow as pa

    from caseloom.operators import radix

    frames = np.random.default_rng(0).random((1000, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None] * 500), pa.array(list(frames)), pa.array([[0, 0]] * 1000)], ["g", "pixels", "prefix"])
    out = pa.Table.from_batches(list(radix._counts(21, 11, 1)([batch]))).to_pandas()
    assert len(out) == len(out.drop_duplicates(["g", "want", "digit"])) and len(out) < 1000  # one a frame would be thousands
    assert out.groupby(["g", "want"], dropna=False).n.sum().tolist() == [4000] * 4
    want = np.bincount((radix.ordered_bits(frames[::2].ravel()) >> np.uint32(21)).astype(int))
    own = out[(out.g == "a") & (out.want == 1)]
    assert {int(d): int(want[d]) for d in np.flatnonzero(want)} == dict(zip(own.digit, own.n))
