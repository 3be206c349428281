import json

import numpy as np
import pytest

from caseloom.operators import volume
from caseloom.plans import study
from caseloom.sources import files
from caseloom.sources.volumes import read_manifest, read_volumes

ORIENTATION = {"sagittal": [0, 1, 0, 0, 0, -1], "coronal": [1, 0, 0, 0, 0, -1], "axial": [1, 0, 0, 0, 1, 0]}


def content(z, plane, size=(8, 8), frames=None, **more):
    r = np.random.default_rng(z)
    pixels = r.gamma(2, 100, (*([frames] if frames else []), *(more.pop("decoded", size))))
    return json.dumps({"instance_number": z, "position": [z, z, z], "orientation": ORIENTATION[plane], "pixel_spacing": [1, 1], "rows": size[0],
                       "cols": size[1], "transfer_syntax": "raw", "pixels": pixels.tolist(), **more}).encode()


@pytest.fixture(scope="module")
def delivered(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("slices")

    def read_header(raw):  # inside, so that workers get it by value
        return json.loads(raw)

    def decode(raw):
        got = json.loads(raw)
        return {"transfer_syntax": got["transfer_syntax"], "pixels": np.array(got["pixels"])}

    def put(case, series, name, data):
        (root / case / series).mkdir(parents=True, exist_ok=True)
        (root / case / series / name).write_bytes(data)

    for z in range(10):
        put("A", "sag", f"{z:02}.dcm", content(9 - z, "sagittal"))  # file names run against the positions
        put("A", "cor", f"{z:02}.dcm", b"corrupt")
    put("A", "sag", "20.dcm", content(3, "sagittal"))  # place of another file
    put("A", "sag", "21.dcm", content(30, "sagittal", (4, 4)))
    put("A", "sag", "22.dcm", content(31, "sagittal", decoded=(4, 16)))
    put("A", "sag", "23.dcm", content(32, "sagittal", pixels="x"))
    put("A", "sag", "24.dcm", b"{")
    for z in range(3):
        put("A", "ax", f"{z}.dcm", content(z, "axial"))
    put("A", "ax", "3.dcm", content(3, "axial", frames=4))  # one file with four frames
    for z in range(4):
        put("B", "one", f"{z}.dcm", content(z, "coronal", (0, 0), decoded=(3 + z, 5)))  # headers without a size, frames of several
        put("B", "two", f"{z}.dcm", content(z, "axial", pixels=[]))
    listed = spark.createDataFrame([("A", "sag", 1, 1, "sagittal"), ("A", "cor", 1, 0, "coronal"), ("A", "gone", 1, 1, "axial"), ("C", "gone", 1, 1, "axial")],
                                   "case_id string, series_id string, fluid int, fatsat int, plane string")
    config = volume.PreprocessConfig(img_size=8, max_slices=5)
    cases = spark.createDataFrame([("A",), ("B",), ("D",)], "case_id string")
    return study.ingest_studies(files.slice_files(spark, str(root)), listed, read_header, [("json", decode)], config, cases=cases)


def test_a_broken_series_leaves_its_study(delivered):
    log = {(r["case_id"], r["key"]): r for r in delivered.log.collect()}
    assert set(log) == {("A", "sagittal"), ("A", "coronal"), ("A", "axial"), ("B", "coronal"), ("B", "axial")}
    sag = log["A", "sagittal"]
    assert sag["dropped"] == {"bad_header": 1, "off_size": 2, "duplicate_position": 1, "decode_failed": 1}
    assert (sag["n_files"], sag["n_raw_slices"], sag["n_saved_slices"], sag["raw_h"], sag["raw_w"], sag["error"]) == (15, 10, 5, 8, 8, None)
    assert json.loads(sag["dropped_json"]) == sag["dropped"] and list(sag["transfer_syntaxes"]) == ["raw"] and sag["inferred_plane"] == "sagittal"
    assert log["A", "coronal"]["error"].startswith("DecodeError") and "bad_header" in log["A", "coronal"]["error"]
    assert (log["A", "axial"]["n_raw_slices"], log["A", "axial"]["n_saved_slices"]) == (7, 5)  # inferred plane, a file of four frames
    assert log["B", "coronal"]["error"] == "ValueError: frames of different sizes"
    assert log["B", "axial"]["error"].startswith("DecodeError") and log["B", "axial"]["dropped"] == {"decode_failed": 4}


def test_records_and_manifest(delivered):
    records = {r["case_id"]: r for r in delivered.studies.collect()}
    assert set(records) == set("ABCD")
    a = records["A"]
    assert (a["n_series_listed"], a["n_series_stored"], a["series_missing_on_disk"], a["series_not_listed"]) == (3, 3, ["gone"], 1)
    assert a["routes"] == {"sagittal": "sag", "coronal": "cor", "axial": "ax"} and a["series"]["axial"]["n_saved_slices"] == 5
    assert a["config"]["max_slices"] == 5 and records["D"]["n_series_listed"] == 0 and records["C"]["routes"] is None
    manifest = {r["case_id"]: r for r in delivered.manifest.collect()}
    assert (manifest["A"]["has_sagittal"], manifest["A"]["has_coronal"], manifest["A"]["n_series_errors"]) == (1, 0, 1)
    assert manifest["B"]["n_series_errors"] == 2 and manifest["D"]["has_axial"] == 0


def test_stored_slices_equal_numpy(delivered):
    raw = np.stack([np.random.default_rng(z).gamma(2, 100, (8, 8)) for z in range(10)]).astype(np.float32)
    values = raw[raw > raw.min()].astype(float)
    lo, hi = np.percentile(values, [0.5, 99.5])
    windowed = np.clip((raw.astype(float) - lo) / (hi - lo), 0, 1).astype(np.float32)
    keep = [round(x) for x in np.linspace(0, 9, 5)]
    got = {r["slice_idx"]: r for r in delivered.stored.filter("plane = 'sagittal' and case_id = 'A'").collect()}
    assert [got[i]["source_idx"] for i in range(5)] == keep
    for i, k in enumerate(keep):
        assert np.abs(np.frombuffer(got[i]["stored"], np.uint8).astype(int) - np.rint(windowed[k].ravel() * 255)).max() <= 1


def test_written_and_read_back(spark, delivered, tmp_path):
    delivered.write(str(tmp_path / "out"))
    assert read_volumes(spark, f"{tmp_path}/out/volumes", ("sagittal",)).count() == 5
    assert [r["case_id"] for r in read_manifest(spark, f"{tmp_path}/out/manifest", ("sagittal", "axial")).collect()] == ["A"]
    assert spark.read.parquet(f"{tmp_path}/out/studies").count() == 4
