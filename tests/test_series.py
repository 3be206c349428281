import pytest
from pyspark.sql import functions as F

from caseloom.functions import geometry
from caseloom.operators import inventory, series
from caseloom.schema import HEADER_SCHEMA

AXIAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def header(case, uid, path, z=None, number=None, orientation=AXIAL, size=(8, 8)):
    position = None if z is None else [0.0, 0.0, float(z)]
    return (case, uid, path, number, position, orientation, [.5, .5], 3.0, *size, "x", "")


@pytest.mark.parametrize("orientation,plane", [
    ([0, 1, 0, 0, 0, -1], "sagittal"), ([1, 0, 0, 0, 0, -1], "coronal"), ([1, 0, 0, 0, 1, 0], "axial"),
    ([.99, .1, 0, 0, .1, -.99], "coronal"), ([1, 0, 0, 1, 0, 0], None), (None, None), ([float("nan")] * 6, None)])
def test_plane(spark, orientation, plane):
    vector = None if orientation is None else [float(x) for x in orientation]
    df = spark.createDataFrame([(vector,)], "o array<double>")
    assert df.select(geometry.plane_from_orientation(F.col("o"))).first()[0] == plane


def test_order_duplicates_and_sizes(spark):
    rows = [header("c", "s", f"f{i}", z) for i, z in enumerate([3, 1, 2, 1.0001, 0])]
    rows += [header("c", "s", "loc", 9, size=(4, 4)), header("c", "t", "a", None, 2), header("c", "t", "b", 5, 1),
             header("c", "u", "b", 1, None), header("c", "u", "a", None, None), header("c", "u", "c", 1, 4)]
    headers = spark.createDataFrame(rows, HEADER_SCHEMA)
    ordered, dropped = series.ordered_and_dropped(headers)
    got = {}
    for r in ordered.orderBy("series_id", "slice_idx").collect():
        got.setdefault(r["series_id"], []).append(r["path"])
        assert r["inferred_plane"] == "axial"
    assert got == {"s": ["f4", "f1", "f2", "f0"], "t": ["b", "a"], "u": ["a", "b", "c"]}
    assert {r["series_id"]: dict(r["dropped"]) for r in dropped.collect()} == {"s": {"off_size": 1, "duplicate_position": 1}}


def test_direction_does_not_depend_on_the_scanner(spark):
    flipped = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0]
    rows = [header("c", "s", f"f{i}", z, orientation=o) for i, (z, o) in enumerate([(2, flipped), (1, flipped), (3, flipped)])]
    ordered = series.order_series(spark.createDataFrame(rows, HEADER_SCHEMA)).orderBy("slice_idx").collect()
    assert [r["position"][2] for r in ordered] == [1, 2, 3]


def test_majority_tie_goes_to_the_first_file(spark):
    rows = [header("c", "s", "b", 1, size=(8, 8)), header("c", "s", "a", 2, size=(4, 4))]
    got = series.majority_size(spark.createDataFrame(rows, HEADER_SCHEMA)).first()
    assert (got["rows"], got["cols"]) == (4, 4)


def test_reconcile_and_route(spark):
    rows = [header("c", "disk", f"d{i}", i) for i in range(3)] + [header("c", "both", f"b{i}", i) for i in range(30)]
    headers = spark.createDataFrame(rows, HEADER_SCHEMA)
    listed = spark.createDataFrame([("c", "both", 1, 1, "axial"), ("c", "t1", 0, 0, "axial"), ("c", "gone", 1, 1, "sagittal")],
                                   "case_id string, series_id string, fluid int, fatsat int, plane string")
    found = {r["series_id"]: r for r in series.reconcile(listed, headers).collect()}
    assert (found["disk"]["fluid"], found["disk"]["plane"], found["disk"]["listed"]) == (0, "axial", False)
    assert found["gone"]["on_disk"] is False and found["both"]["n_files"] == 30
    usable = series.reconcile(listed, headers).filter("on_disk")
    assert {(r["key"], r["series_id"]) for r in series.route(usable, True).collect()} == {("axial", "both"), ("axial_t1", "disk")}


def test_routing_order(spark):
    rows = [("c", "a", 1, 1, "axial", 10), ("c", "b", 1, 1, "axial", 28), ("c", "z", 1, 0, "axial", 30),
            ("d", "a", 0, 1, "coronal", 30), ("d", "b", 0, 1, "coronal", 30), ("e", "a", 1, 1, "oblique", 30)]
    df = spark.createDataFrame(rows, "case_id string, series_id string, fluid int, fatsat int, plane string, n_files long")
    assert sorted((r["case_id"], r["series_id"]) for r in series.route(df).collect()) == [("c", "b"), ("d", "b")]


def test_typed_headers(spark):
    raw = spark.createDataFrame(
        [("c", "s", "p", "7", ["1", "2", "x"], ["1", "0", "0", "0", "1", "0"], ["0.5"], "3.5", None, "12", None, None)],
        "case_id string, series_id string, path string, instance_number string, position array<string>, "
        "orientation array<string>, pixel_spacing array<string>, slice_thickness string, rows string, cols string, "
        "transfer_syntax string, series_description string")
    row = series.typed_headers(raw).first()
    assert row["instance_number"] == 7 and row["position"] is None and row["orientation"] == AXIAL
    assert row["pixel_spacing"] is None and row["slice_thickness"] == 3.5
    assert (row["rows"], row["cols"], row["transfer_syntax"], row["series_description"]) == (0, 12, "unknown", "")


def test_manifest_and_check(spark):
    studies = spark.createDataFrame([("a", 2, 2, None), ("b", 1, 2, None), ("c", 1, 1, "boom")],
                                    "case_id string, n_series_listed long, n_series_stored long, study_error string")
    log = spark.createDataFrame([("a", p, "s" + p, 5, None) for p in ("sagittal", "coronal", "axial", "axial_t1")] +
                                [("b", "axial", "x", 0, "bad")], "case_id string, key string, series_id string, n_saved_slices long, error string")
    table = inventory.manifest(studies, log)
    got = {r["case_id"]: r for r in table.collect()}
    assert got["a"]["has_axial"] == 1 and got["a"]["n_slices_axial"] == 5 and got["b"]["n_series_errors"] == 1
    assert got["c"]["has_axial"] == 0 and got["b"]["axial_series"] == "x" and got["b"]["n_slices_axial"] == 0
    assert [r["case_id"] for r in inventory.with_planes(table).collect()] == ["a"]
    size = spark.createDataFrame([(10,), (20,)], "bytes long")
    total = inventory.summary(table, log, size).first()
    assert (total["n_studies"], total["n_series_cached"], total["n_series_failed"], total["missing_axial"],
            total["studies_all_planes"], total["cache_bytes"]) == (3, 4, 1, 2, 1, 30)
    facts = spark.createDataFrame([("a", "axial", 5, 1, False, 0.0), ("a", "coronal", 4, 1, False, 9.0)],
                                  "case_id string, plane string, n_slices long, n_shapes int, has_non_finite boolean, peak double")
    expected = spark.createDataFrame([("a",), ("z",)], "case_id string")
    problems = {r["kind"]: (r["n"], r["severity"]) for r in inventory.cache_problems(table, facts, expected).collect()}
    assert problems == {"missing_file": (1, "fail"), "all_black": (1, "fail"), "slice_count_mismatch": (1, "fail"),
                        "no_planes": (2, "fail"), "study_error": (1, "fail"), "studies_not_cached": (1, "fail"),
                        "series_count_differs_from_table": (1, "note")}
