import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.operators import inventory, labels, translate
from caseloom.plans import views
from caseloom.schema import Columns
from caseloom.sources import files as sources_files
from caseloom.sources import cases, files, predictions, runlog, volumes
from caseloom.streaming import ingest

COLUMNS = Columns("id", "Report", ("A", "B"))


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_case_table(spark, tmp_path):
    path = write(tmp_path / "train.csv", 'id,Report,A,B\n1,"two\nlines",1,0\n2,,-1,\n3,x,0.5,nan\n')
    held = write(tmp_path / "test.csv", "id\n9\n")
    table, test = cases.load_cases(spark, path, COLUMNS, held)
    assert [r["report"] for r in table.orderBy("case_id").collect()] == ["two\nlines", "", "x"]
    assert [r["case_id"] for r in test.collect()] == ["9"]
    truth = {(r["case_id"], r["label"]): r["y"] for r in labels.truth(table, ["A", "B"]).collect()}
    assert truth == {("1", "A"): 1, ("1", "B"): 0, ("2", "A"): None, ("2", "B"): None, ("3", "A"): None, ("3", "B"): None}
    with pytest.raises(ValueError, match="missing columns"):
        cases.load_cases(spark, held, COLUMNS)
    with pytest.raises(ValueError, match="duplicate"):
        cases.load_cases(spark, write(tmp_path / "d.csv", "id,Report,A,B\n1,a,,\n1,b,,\n"), COLUMNS)


def test_predictions_and_report(spark, tmp_path):
    one = write(tmp_path / "one.csv", "id,A,B\nx,0.1,0.2\n")
    named = predictions.parse_named([f"m={one}", one])
    assert list(named) == ["m", one]
    df = predictions.read_predictions(spark, {"m": one}, ["A", "B"], "id")
    assert sorted(map(tuple, df.collect())) == [("m", "x", "A", .1), ("m", "x", "B", .2)]
    assert predictions.pool_folds([df, df]).count() == 4
    assert "| m | x | A | 0.1000 |" in cases.markdown(df, "Report")


def test_registry(spark):
    rows = [("m", "b", "r", 0, ["A", "B"]), ("m", "a", "r", 0, ["A", "B"]), ("m", "c", "r_smoke", 1, None), ("n", "d", "q_smoke", 0, None)]
    df = spark.createDataFrame(rows, "name string, path string, run string, fold int, labels array<string>")
    assert [r["path"] for r in predictions.usable_runs(df).collect()] == ["a"]
    predictions.check_registry(df, ["m"], ["A", "B"])
    with pytest.raises(FileNotFoundError):
        predictions.check_registry(df, ["n"], ["A", "B"])
    with pytest.raises(ValueError, match="order"):
        predictions.check_registry(df, ["m"], ["B", "A"])


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("r", 0, 1, .5), ("r", 0, 2, .7), ("r", 0, 3, .7), ("r", 1, 1, .9)]
    for part in (rows[:2], rows[2:]):
        runlog.append_rows(spark.createDataFrame(part, "run string, fold int, epoch int, val_macro_auc double"), path)
    best = runlog.best_per_run(spark.read.parquet(path))
    assert sorted(map(tuple, best.collect())) == [("r", 0, .7, 2), ("r", 1, .9, 1)]
    assert runlog.leaderboard(best).first()["mean_score"] == pytest.approx(.8)


def test_decoding_files(spark, tmp_path):
    def raw(content):
        if not content.startswith(b"RAW"):
            raise ValueError("not raw")
        return {"transfer_syntax": "raw", "pixels": np.frombuffer(content[3:], np.uint8).reshape(2, -1)}

    def broken(content):
        raise RuntimeError("no codec")

    for case, name, content in (("c1", "b.dcm", b"RAW\x01\x02\x03\x04"), ("c1", "a.dcm", b"junk"), ("c2", "a.dcm", b"RAW"), ("c2", "x.txt", b"RAW")):
        folder = tmp_path / case / "s1"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(content)
    listed = files.slice_files(spark, str(tmp_path))
    assert sorted((r["case_id"], r["series_id"], r["n_files"], r["first_file"]) for r in files.file_counts(listed).collect()) == [
        ("c1", "s1", 2, "a.dcm"), ("c2", "s1", 1, "a.dcm")]
    decoded = files.decode_files(listed, [("none", broken), ("raw", raw)])
    got = {(r["case_id"], r["path"].rsplit("/", 1)[1]): r for r in decoded.collect()}
    assert got[("c1", "b.dcm")]["ok"] and list(got[("c1", "b.dcm")]["pixels"]) == [1, 2, 3, 4]
    assert got[("c1", "a.dcm")]["error"] == "ValueError: none: RuntimeError: no codec | raw: ValueError: not raw"
    assert not got[("c2", "a.dcm")]["ok"] and "empty" in got[("c2", "a.dcm")]["error"]
    report = {r["transfer_syntax"]: (r["files"], r["decoded"], r["failed"]) for r in inventory.decode_report(decoded).collect()}
    assert report == {"raw": (2, 1, 1), "unknown": (1, 0, 1)}
    assert not inventory.decode_passes(decoded) and inventory.failing_cases(decoded).first()[0] == 2


def test_volume_store(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([("c", p, 0, bytearray([0, 255])) for p in ("axial", "coronal")], "case_id string, plane string, slice_idx int, stored binary")
    volumes.write_volumes(df, path)
    got = volumes.read_volumes(spark, path, ("axial",)).collect()
    assert len(got) == 1 and list(got[0]["pixels"]) == [0.0, 1.0]
    plan = volumes.read_volumes(spark, path, ("axial",))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(plane" in plan


def test_translation(spark):
    def shout(lang, batch):
        assert lang == "de"
        return [s.upper() for s in batch]

    df = spark.createDataFrame([("1", "eins. zwei; drei", "de"), ("2", "one. two", "en"), ("3", "un. deux", "fr"), ("4", "", "de")],
                               "case_id string, report string, lang string")
    done = {r["case_id"]: r["text_en"] for r in translate.translate(df, shout, ["de"], batch_size=2).collect()}
    assert done == {"1": "EINS. ZWEI. DREI", "2": "one. two", "3": "un. deux", "4": ""}
    cache = spark.createDataFrame([(k, "t" + k) for k in "1234"], "case_id string, text_en string")
    assert {r["text_en"] for r in translate.translate(df, None, ["de"], cache=cache).collect()} == {"t1", "t2", "t3", "t4"}


def test_batch_ingestion_resumes(spark, tmp_path):
    path, seen = str(tmp_path / "out"), []
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")

    def process(part):
        seen.append(sorted(r[0] for r in part.collect()))
        return part

    ingest.ingest_batch(df.filter("case_id <> 'c'"), path, process)
    ingest.ingest_batch(df, path, process)
    assert seen == [["a", "b"], ["c"]] and ingest.pending(df, path).count() == 0


def test_stream_ingestion_resumes(spark, tmp_path):
    source, path, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    part = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, n int")
    for expected in (2, 4, 4):
        if expected == 2 or spark.read.parquet(path).count() == 2:
            part.coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_stream(spark, source, part.schema, path, lambda d: d.withColumn("m", F.col("n") * 2), marks).awaitTermination()
        assert spark.read.parquet(path).count() == expected


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_slice_files_of_a_series_have_many_writers(spark):
    files = views.study_files(spark, "/root/testdata/sf0.001").select("series_id", F.regexp_extract("file", r"part-(\d+)", 1).alias("task"))
    assert files.groupBy("series_id").agg(F.count_distinct("task").alias("n")).agg(F.max("n")).first()[0] > 1


def test_decoded_files_are_handed_on_together(spark, monkeypatch):
    monkeypatch.setattr(sources_files, "HELD_PIXELS", 10)
    rows = [("c", "s", f"p{i}", bytes([i])) for i in range(9)]
    df = spark.createDataFrame(rows, "case_id string, series_id string, path string, content binary").withColumn("mark", F.length("path"))

    def decode(content):
        if content[0] == 4:
            raise ValueError("no")
        return {"pixels": np.full((2, 2), content[0])}

    got = sources_files.decode_files(df.coalesce(1), [("d", decode)], ("mark",)).orderBy("path").collect()
    assert [(r["path"], r["ok"], r["mark"]) for r in got] == [(f"p{i}", i != 4, 2) for i in range(9)]
    assert [r["pixels"] for r in got] == [None if i == 4 else [float(i)] * 4 for i in range(9)]
