"""Manifests, summaries and checks over stored volumes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PLANES

NOTE_ONLY = ("series_count_differs_from_table",)


def manifest(studies: DataFrame, log: DataFrame, planes: tuple[str, ...] = PLANES) -> DataFrame:
    """One row per case from (case_id, n_series_listed, n_series_stored, study_error) and the series log."""
    ok, here = F.col("error").isNull(), lambda p: F.col("key") == p
    columns: list[Column] = []
    for p in planes:
        columns += [
            F.max(F.when(here(p), ok.cast("int"))).alias(f"has_{p}"),
            F.max(F.when(here(p) & ok, F.col("n_saved_slices"))).alias(f"n_slices_{p}"),
            F.max(F.when(here(p), F.col("series_id"))).alias(f"{p}_series")]
    per_case = log.groupBy("case_id").agg(*columns, F.count_if(~ok).alias("n_series_errors"))
    zero = [f"has_{p}" for p in planes] + [f"n_slices_{p}" for p in planes] + ["n_series_errors"]
    return studies.join(per_case, "case_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def with_planes(table: DataFrame, required: tuple[str, ...] = PLANES) -> DataFrame:
    """Manifest rows that have all required planes."""
    return reduce(lambda df, p: df.filter(F.col(f"has_{p}") == 1), required, table)


def with_any_plane(table: DataFrame, planes: tuple[str, ...] = PLANES) -> DataFrame:
    """Manifest rows that have at least one of the planes."""
    return table.filter(reduce(lambda a, b: a | b, [F.col(f"has_{p}") == 1 for p in planes]))


def summary(table: DataFrame, log: DataFrame, stored_bytes: DataFrame, planes: tuple[str, ...] = PLANES) -> DataFrame:
    """One row of totals over manifest, series log and stored sizes (column `bytes`)."""
    all_planes = reduce(lambda a, b: a & b, [F.col(f"has_{p}") == 1 for p in planes])
    cases = table.agg(F.count("*").alias("n_studies"), F.count("study_error").alias("n_study_errors"),
                      *[F.count_if(F.col(f"has_{p}") == 0).alias(f"missing_{p}") for p in planes],
                      F.count_if(all_planes).alias("studies_all_planes"))
    series = log.agg(F.count_if(F.col("error").isNull()).alias("n_series_cached"),
                     F.count("error").alias("n_series_failed"))
    size = stored_bytes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("cache_bytes"))
    one = cases.unionByName(series, True).unionByName(size, True)  # three rows, each with its own columns
    return one.agg(*[F.max(c).alias(c) for c in one.columns])


def decode_report(files: DataFrame) -> DataFrame:
    """(transfer_syntax, files, decoded, failed) from rows with `ok`."""
    return files.groupBy("transfer_syntax").agg(
        F.count("*").alias("files"), F.count_if("ok").alias("decoded"), F.count_if(~F.col("ok")).alias("failed"))


def failing_cases(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("ok")).agg(F.count_distinct("case_id").alias("failed_cases"))


def top_errors(files: DataFrame, k: int = 10) -> DataFrame:
    return files.filter(~F.col("ok")).groupBy(F.left("error", F.lit(300)).alias("error")).agg(
        F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(k)


def decode_passes(files: DataFrame) -> bool:
    return files.filter(~F.col("ok")).limit(1).count() == 0


def frame_sizes(stored: DataFrame) -> DataFrame:
    """(h, w, dtype, slices)."""
    return stored.groupBy("h", "w", "dtype").agg(F.count("*").alias("slices"))


def plane_coverage(table: DataFrame, planes: tuple[str, ...] = PLANES) -> DataFrame:
    return table.agg(*[F.sum(f"has_{p}").cast("long").alias(p) for p in planes])


def cache_problems(table: DataFrame, volumes: DataFrame, expected: DataFrame | None = None,
                   planes: tuple[str, ...] = PLANES) -> DataFrame:
    """(kind, n, example, severity) over a manifest and per-volume facts.

    `volumes` has one row per stored (case_id, plane): n_slices, n_shapes (distinct frame sizes),
    has_non_finite, peak. A differing series count is a note; all else fails the check.
    """
    claims = table.select("case_id", F.inline(F.array(*[
        F.struct(F.lit(p).alias("plane"), F.col(f"has_{p}").alias("has"), F.col(f"n_slices_{p}").alias("claimed"))
        for p in planes])))
    files = claims.join(volumes, ["case_id", "plane"], "left")
    stored = F.col("n_slices").isNotNull()
    bad_shape = stored & ((F.col("n_slices") == 0) | (F.col("n_shapes") > 1))
    of_file = [
        ("missing_file", (F.col("has") == 1) & ~stored),
        ("bad_shape", bad_shape),
        ("slice_count_mismatch", stored & ~bad_shape & (F.col("n_slices") != F.col("claimed"))),
        ("non_finite", stored & F.col("has_non_finite")),
        ("all_black", stored & (F.col("peak") == 0)),
    ]
    no_plane = reduce(lambda a, b: a & b, [F.col(f"has_{p}") == 0 for p in planes])
    of_case = [
        ("study_error", F.col("study_error").isNotNull()),
        ("no_planes", no_plane),
        ("series_count_differs_from_table", ~F.col("n_series_listed").eqNullSafe(F.col("n_series_stored"))),
    ]

    def hits(df: DataFrame, where: Column, rules: list[tuple[str, Column]]) -> DataFrame:
        kinds = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules]))
        return df.select(F.explode(kinds).alias("kind"), where.alias("where"))

    found = hits(files, F.concat_ws("/", "case_id", "plane"), of_file).unionByName(hits(table, F.col("case_id"), of_case))
    if expected is not None:
        absent = expected.select("case_id").distinct().join(table.select("case_id"), "case_id", "left_anti")
        found = found.unionByName(absent.select(F.lit("studies_not_cached").alias("kind"), F.col("case_id").alias("where")))
    return found.groupBy("kind").agg(F.count("*").alias("n"), F.min("where").alias("example")).withColumn(
        "severity", F.when(F.col("kind").isin(*NOTE_ONLY), "note").otherwise("fail"))


def cache_passes(problems: DataFrame) -> bool:
    return problems.filter("severity = 'fail'").limit(1).count() == 0


def volume_facts(stored: DataFrame) -> DataFrame:
    """Per (case_id, plane) what `cache_problems` needs, from rows (case_id, plane, slice_idx, h, w, pixels)."""
    odd = F.exists("pixels", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    shape = F.struct("h", "w")
    return stored.groupBy("case_id", "plane").agg(
        F.count("*").alias("n_slices"),
        F.when(F.min(shape) == F.max(shape), 1).otherwise(2).alias("n_shapes"),
        F.bool_or(odd).alias("has_non_finite"), F.max(F.array_max("pixels")).alias("peak"))
