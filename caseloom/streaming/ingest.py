"""Resumable ingestion: a case that is finished is never done again."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..session import shared_dir


def finished_cases(spark: SparkSession, path: str) -> DataFrame | None:
    """Ids in the output table, None before the first write."""
    try:
        return spark.read.parquet(path).select("case_id").distinct()
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return None
        raise


def pending(cases: DataFrame, path: str) -> DataFrame:
    """Cases not yet in the output table."""
    done = finished_cases(cases.sparkSession, path)
    return cases if done is None else cases.join(done, "case_id", "left_anti")


def ingest_batch(cases: DataFrame, path: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Process what is pending and append it. Stopping and starting again repeats no finished case."""
    process(pending(cases, path)).write.mode("append").parquet(path)


def ingest_stream(spark: SparkSession, source: str, schema, path: str, process: Callable[[DataFrame], DataFrame],
                  checkpoint: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Process all files that arrived since the last run, then stop.

    The checkpoint keeps which files are done, and the file sink lists only committed output, so a run
    that dies half-way is completed by the next one without repeating or losing rows.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = process(reader.parquet(source))
    folder = checkpoint or f"{shared_dir(spark).rstrip('/')}/streams/{hashlib.md5(f'{source}|{path}'.encode()).hexdigest()}"
    return (stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder)
            .outputMode("append").trigger(availableNow=True).start())
