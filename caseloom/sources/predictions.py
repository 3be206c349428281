"""Prediction tables by name, and the registry of runs that produced them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.labels import to_long
from ..schema import CASE_COLUMN
from .cases import read_table


def parse_named(items: list[str]) -> dict[str, str]:
    """'name=path' entries; a bare path is its own name."""
    pairs = (item.partition("=") for item in items)
    return {name: path or name for name, _, path in pairs}


def read_predictions(spark: SparkSession, named: dict[str, str], labels: list[str],
                     case_id: str = CASE_COLUMN) -> DataFrame:
    """(source, case_id, label, p) of several wide prediction tables."""
    parts = [to_long(read_table(spark, path).withColumn(case_id, F.col(case_id).cast("string")), labels, case_id)
             .withColumn("source", F.lit(name)) for name, path in named.items()]
    return reduce(DataFrame.unionByName, parts).select("source", "case_id", "label", "p")


def pool_folds(parts: list[DataFrame]) -> DataFrame:
    """Out-of-fold tables of all folds under one another."""
    return reduce(DataFrame.unionByName, parts)


def usable_runs(registry: DataFrame) -> DataFrame:
    """One entry per (run, fold) of the registry (name, path, run, fold, labels): the first path.

    Smoke-test runs are left out, so nothing is averaged twice and nothing unfinished is averaged at all.
    """
    first = Window.partitionBy("name", "run", "fold").orderBy("path")
    return (registry.filter(~F.col("run").endswith("_smoke"))
            .withColumn("_no", F.row_number().over(first)).filter("_no = 1").drop("_no"))


def check_registry(registry: DataFrame, names: list[str], labels: list[str]) -> None:
    """Every name has a usable run, and every run predicts the labels in the same order."""
    other = registry.filter(F.col("labels").isNotNull() & (F.col("labels") != F.array(*map(F.lit, labels))))
    wrong = other.select("path").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['path']} was trained with a different label order")
    present = {r["name"] for r in usable_runs(registry).select("name").distinct().collect()}
    absent = [n for n in names if n not in present]
    if absent:
        raise FileNotFoundError(f"no usable run for {absent}")
