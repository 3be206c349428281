"""Series of slices: reconciling inventories, routing one series per plane, ordering and cleaning.

Slice headers are (case_id, series_id, path, ...) rows, see `schema.HEADER_SCHEMA`. A series may be of
any length: order and duplicates are settled with range-partitioned totals, never one task per series.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import along_normal, plane_from_orientation, vector_or_null
from ..schema import PLANES, TYPICAL_SLICES
from ..session import checkpoint, written_table
from .prefix import row_numbers

SERIES = ["case_id", "series_id"]


def typed_headers(raw: DataFrame) -> DataFrame:
    """Header rows with type-safe fields: what is not a finite number or vector of the right size is NULL.

    Rows flagged `readable = false` (or without the flag, none) count as bad headers downstream.
    """
    text = lambda c: F.col(c).cast("string")
    number = text("slice_thickness").try_cast("double")
    return raw.select(
        "case_id", "series_id", "path",
        text("instance_number").try_cast("int").alias("instance_number"),
        vector_or_null(F.col("position"), 3).alias("position"),
        vector_or_null(F.col("orientation"), 6).alias("orientation"),
        vector_or_null(F.col("pixel_spacing"), 2).alias("pixel_spacing"),
        number.alias("slice_thickness"),
        F.coalesce(text("rows").try_cast("int"), F.lit(0)).alias("rows"),
        F.coalesce(text("cols").try_cast("int"), F.lit(0)).alias("cols"),
        F.coalesce(F.nullif(F.col("transfer_syntax"), F.lit("")), F.lit("unknown")).alias("transfer_syntax"),
        F.coalesce("series_description", F.lit("")).alias("series_description"),
        *([F.col("readable")] if "readable" in raw.columns else []))


def reconcile(listed: DataFrame, headers: DataFrame) -> DataFrame:
    """All series of the table and of the files, with presence flags, file counts and inferred planes.

    Series found only as files get flags 0; a missing plane comes from the orientation of the first file.
    """
    stored = headers.groupBy(*SERIES).agg(F.count("*").alias("n_files"),
                                          F.min_by("orientation", "path").alias("first_orientation"))
    rows = listed.withColumn("_listed", F.lit(True)).join(stored, SERIES, "full_outer")
    return rows.select(
        *SERIES, F.coalesce("fluid", F.lit(0)).alias("fluid"), F.coalesce("fatsat", F.lit(0)).alias("fatsat"),
        F.coalesce("plane", plane_from_orientation(F.col("first_orientation"))).alias("plane"),
        F.coalesce("_listed", F.lit(False)).alias("listed"), F.col("n_files").isNotNull().alias("on_disk"),
        F.coalesce("n_files", F.lit(0)).alias("n_files"))


def route(series: DataFrame, extra_t1: bool = False) -> DataFrame:
    """(case_id, key, series_id): the best usable series per case and plane.

    Fluid-sensitive and fat-suppressed first, then the count nearest to a typical series, more slices,
    greater id. With `extra_t1` the best series that is not fluid-sensitive also gets "<plane>_t1".
    """
    k = F.coalesce("n_files", F.lit(TYPICAL_SLICES))
    quality = F.struct((2 * F.col("fluid") + F.col("fatsat")).alias("q"), (-F.abs(k - TYPICAL_SLICES)).alias("d"),
                       k.alias("k"), F.col("series_id").alias("s"))
    usable = series.filter(F.col("plane").isin(*PLANES) & (k > 0))
    best = usable.groupBy("case_id", "plane").agg(
        F.max(quality)["s"].alias("main"),
        F.max(F.when(F.col("fluid") == 0, quality))["s"].alias("t1"))
    entries = [F.struct(F.col("plane").alias("key"), F.col("main").alias("series_id"))]
    if extra_t1:
        entries.append(F.struct(F.concat("plane", F.lit("_t1")).alias("key"), F.col("t1").alias("series_id")))
    return best.select("case_id", F.inline(F.array(*entries))).filter("series_id is not null")


def majority_size(headers: DataFrame) -> DataFrame:
    """(case_id, series_id, rows, cols): the most frequent frame size; on a tie that of the first file."""
    sizes = headers.groupBy(*SERIES, "rows", "cols").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    # The smallest (-n, first) wins.
    return sizes.groupBy(*SERIES).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "rows", "cols")).alias("m")) \
        .select(*SERIES, F.col("m.rows").alias("rows"), F.col("m.cols").alias("cols"))


def with_sort_key(headers: DataFrame) -> DataFrame:
    """Add `key`: position along the normal if all slices have one, else the instance number if all have
    one, else NULL, so that only the file name orders the slices."""
    facts = headers.groupBy(*SERIES).agg(
        F.min_by("orientation", F.when(F.col("orientation").isNotNull(), F.col("path"))).alias("_ref"),
        F.bool_and(F.col("position").isNotNull()).alias("_placed"),
        F.bool_and(F.col("instance_number").isNotNull()).alias("_counted"))
    return headers.join(facts, SERIES).withColumn(
        "key", F.when(F.col("_ref").isNotNull() & F.col("_placed"), along_normal(F.col("position"), F.col("_ref")))
        .when(F.col("_counted"), F.col("instance_number").cast("double"))) \
        .drop("_ref", "_placed", "_counted")


def order_series(headers: DataFrame) -> DataFrame:
    """Cleaned slices in anatomical order: header columns plus `slice_idx` and `inferred_plane`."""
    return ordered_and_dropped(headers)[0]


def ordered_and_dropped(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ordered slices, drops). Drops are (case_id, series_id, dropped MAP reason -> count).

    Dropped are unreadable headers, slices off the majority size, and slices with a position that repeats
    one of the series to a thousandth (the first in order stays).
    """
    ordered, reasons = ordered_with_reasons(headers)
    return ordered, drop_counts(reasons)


def ordered_with_reasons(headers: DataFrame) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """Ordered slices, and for each reason the numbers (case_id, series_id, n) of dropped ones."""
    readable = F.col("readable") if "readable" in headers.columns else F.lit(True)
    good = headers.filter(readable)
    size = majority_size(good).withColumnRenamed("rows", "_r").withColumnRenamed("cols", "_c")
    sized = good.join(size, SERIES).withColumn("_fits", (F.col("rows") == F.col("_r")) & (F.col("cols") == F.col("_c")))
    kept = with_sort_key(sized.filter("_fits").drop("_r", "_c", "_fits"))
    # The steps below each read the keyed slices more than once, so they are fixed here.
    place = checkpoint(kept.withColumn("_at", F.bround("key", 3)))
    # The first slice at a key, by (key, path): an aggregate, so a key may repeat any number of times.
    first = place.filter("_at is not null").groupBy(*SERIES, "_at").agg(F.min(F.struct("key", "path"))["path"].alias("_keep"))
    place = place.join(first, [*SERIES, "_at"], "left")
    repeated = F.col("_at").isNotNull() & (F.col("path") != F.col("_keep")) & F.col("position").isNotNull()
    unique = written_table(place.filter(~repeated).drop("_at", "_keep"), "unique-slices")
    numbered = row_numbers(unique, SERIES, [F.col("key"), F.col("path")], "slice_idx")
    plane = unique.filter("orientation is not null").groupBy(*SERIES).agg(F.min_by("orientation", F.struct("key", "path")).alias("_o"))
    ordered = numbered.join(plane, SERIES, "left").withColumn("inferred_plane", plane_from_orientation(F.col("_o"))).drop("_o")
    return ordered, [
        ("bad_header", headers.filter(~readable).groupBy(*SERIES).agg(F.count("*").alias("n"))),
        ("off_size", sized.filter(~F.col("_fits")).groupBy(*SERIES).agg(F.count("*").alias("n"))),
        ("duplicate_position", place.filter(repeated).groupBy(*SERIES).agg(F.count("*").alias("n"))),
    ]


def drop_counts(reasons: list[tuple[str, DataFrame]]) -> DataFrame:
    """(case_id, series_id, dropped): map of reason to count, positive counts only. A reason may occur in several tables."""
    long = reduce(DataFrame.unionByName, [
        df.select(*SERIES, F.lit(reason).alias("reason"), "n") for reason, df in reasons])
    long = long.groupBy(*SERIES, "reason").agg(F.sum("n").alias("n"))
    return long.filter("n > 0").groupBy(*SERIES).agg(F.map_from_entries(
        F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("dropped"))


def dropped_json(dropped: Column) -> Column:
    return F.coalesce(F.to_json(dropped), F.lit("{}"))
