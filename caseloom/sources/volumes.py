"""Stored volumes: one Parquet table partitioned by plane, one row per slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import with_planes
from ..operators.volume import from_storage
from ..schema import PLANES


def write_volumes(stored: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with `plane`. The write commits as a whole or not at all, so what is listed is complete."""
    stored.write.mode(mode).partitionBy("plane").parquet(path)


def read_volumes(spark: SparkSession, path: str, planes: tuple[str, ...] = PLANES, cases: DataFrame | None = None,
                 as_unit_float: bool = True) -> DataFrame:
    """Slices of the given planes only, optionally of the given cases only; bytes become floats in [0, 1]."""
    df = spark.read.parquet(path).filter(F.col("plane").isin(*planes))
    if cases is not None:
        df = df.join(cases.select("case_id"), "case_id", "left_semi")
    if not as_unit_float:
        return df
    binary = dict(df.dtypes)["stored"] == "binary"
    return df.withColumn("pixels", from_storage(F.col("stored")) if binary else F.col("stored")).drop("stored")


def read_manifest(spark: SparkSession, path: str, require: tuple[str, ...] = ()) -> DataFrame:
    return with_planes(spark.read.parquet(path), require)
