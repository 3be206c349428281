"""From slice files to stored volumes, a series log, study records and a manifest, in one plan.

Nothing a file holds fails the job: what cannot be read or decoded is counted under one of four reasons, a series without
any slice left has an error in the log, and its study is stored with its other series. Header rows and decoded frames are
written once; after that only narrow tables (positions, bounds, counts) are joined among themselves, and frames move once,
to meet the numbers of the slices that were chosen.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import selected_number
from ..operators import inventory, series, volume
from ..operators.prefix import row_numbers
from ..session import written_table
from ..sources.files import Decoder, HeaderReader, decode_files, read_headers
from ..sources.volumes import write_volumes

SERIES = series.SERIES
KEPT = ("slice_idx", "rows", "cols", "pixel_spacing", "syntax")


@dataclass(frozen=True)
class StudyIngest:
    stored: DataFrame
    log: DataFrame
    studies: DataFrame
    manifest: DataFrame

    def write(self, path: str, mode: str = "append") -> None:
        """Volumes, then the log, then the study records: a study with a record is complete."""
        root = path.rstrip("/")
        write_volumes(self.stored, f"{root}/volumes", mode)
        self.log.write.mode(mode).parquet(f"{root}/series_log")
        self.manifest.write.mode(mode).parquet(f"{root}/manifest")
        self.studies.write.mode(mode).parquet(f"{root}/studies")


def ingest_studies(files: DataFrame, listed: DataFrame, reader: HeaderReader, decoders: list[Decoder],
                   config: volume.PreprocessConfig = volume.PreprocessConfig(), extra_t1: bool = False,
                   cases: DataFrame | None = None) -> StudyIngest:
    """`files` as from `slice_files`, `listed` as from `series_table`; `cases` adds studies that have neither."""
    headers = written_table(series.typed_headers(read_headers(files, reader)), "headers")
    table = written_table(series.reconcile(listed, headers), "series")
    routes = written_table(series.route(table.filter("on_disk and n_files > 0"), extra_t1), "routes")
    routed = headers.join(routes.select(*SERIES).distinct(), SERIES, "left_semi")
    ordered, reasons = series.ordered_with_reasons(routed)
    ordered = written_table(ordered.withColumnRenamed("transfer_syntax", "syntax"), "ordered")

    wanted = files.select("path", "content", *SERIES).join(ordered.select("path", *KEPT), "path")
    decoded = written_table(volume.normalise_frames(decode_files(wanted, decoders, KEPT)), "frames")
    fits = ((F.col("h") == F.col("rows")) & (F.col("w") == F.col("cols"))) | ((F.col("rows") == 0) & (F.col("cols") == 0))
    count = lambda df: df.groupBy(*SERIES).agg(F.count("*").alias("n"))
    dropped = series.drop_counts([*reasons, ("decode_failed", count(decoded.filter("not ok"))),
                                  ("off_size", count(decoded.filter(F.col("ok") & ~fits)))])
    good = decoded.filter(F.col("ok") & fits)

    # One row a series: what its frames have in common. Frames of different sizes (no header gave one) make no volume.
    shape = F.struct("h", "w")
    facts = written_table(good.groupBy(*SERIES).agg(
        F.count("*").alias("n"), F.min(shape).alias("shape"), (F.min(shape) == F.max(shape)).alias("even"),
        F.min_by(F.struct("pixel_spacing"), F.struct("slice_idx", "frame")).alias("first"),
        F.sort_array(F.collect_set("syntax")).alias("transfer_syntaxes")), "series-facts")
    even = facts.filter("even").select(*SERIES, "n", F.col("first.pixel_spacing").alias("pixel_spacing"))
    whole = good.join(even.select(*SERIES), SERIES, "left_semi") if facts.filter("not even").head(1) else good
    narrow = row_numbers(whole.select(*SERIES, "path", "frame", "slice_idx"), SERIES, [F.col("slice_idx"), F.col("frame")], "_at")
    narrow = narrow.join(even, SERIES).withColumn("_no", selected_number(F.col("_at"), F.col("n"), config.max_slices)).filter("_no is not null")
    narrow = narrow.join(volume.window_bounds(whole, config.window), SERIES).select(
        "path", "frame", F.col("_at").alias("source_idx"), F.col("_no").alias("slice_idx"), "pixel_spacing", "lo", "hi")
    chosen = whole.select(*SERIES, "path", "frame", "h", "w", "pixels").join(narrow, ["path", "frame"])
    once = written_table(volume.stored_frames(chosen, config).drop("path", "frame"), "stored")
    stored = once.join(routes, SERIES).withColumnRenamed("key", "plane")

    log = volume.series_log(routes, once, whole.select(*SERIES), dropped)
    own = table.select(*SERIES, "fluid", "fatsat", "n_files")
    planes = ordered.groupBy(*SERIES).agg(F.first("inferred_plane", ignorenulls=True).alias("inferred_plane"))
    uneven = facts.select(*SERIES, F.col("shape.h").alias("raw_h"), F.col("shape.w").alias("raw_w"), "even",
                          F.col("first.pixel_spacing").alias("pixel_spacing"), "transfer_syntaxes")
    ok = F.col("error").isNull()
    log = log.join(own, SERIES).join(planes, SERIES, "left").join(uneven, SERIES, "left")
    log = log.withColumn("error", F.when(F.col("even") == F.lit(False), F.lit("ValueError: frames of different sizes")).otherwise(F.col("error")))
    log = written_table(log.select(
        "case_id", "key", "series_id", "fluid", "fatsat", "n_files", "n_raw_slices", "n_saved_slices", "error",
        *[F.when(ok, F.col(c)).alias(c) for c in ("raw_h", "raw_w", "pixel_spacing", "inferred_plane", "transfer_syntaxes")],
        "dropped", series.dropped_json(F.col("dropped")).alias("dropped_json")), "series-log")
    studies = study_records(table, routes, log, config, cases)
    narrow_studies = studies.select("case_id", "n_series_listed", "n_series_stored", "study_error")
    return StudyIngest(stored, log, studies, inventory.manifest(narrow_studies, log))


def study_records(table: DataFrame, routes: DataFrame, log: DataFrame, config: volume.PreprocessConfig,
                  cases: DataFrame | None = None) -> DataFrame:
    """One nested record a study: counts, series missing on disk, routes, the log by key, and the configuration."""
    counts = table.groupBy("case_id").agg(
        F.count_if("listed").alias("n_series_listed"), F.count_if("on_disk").alias("n_series_stored"),
        F.sort_array(F.collect_list(F.when(~F.col("on_disk"), F.col("series_id")))).alias("series_missing_on_disk"),
        F.count_if(~F.col("listed")).alias("series_not_listed"))
    if cases is not None:
        counts = counts.join(cases.select("case_id").distinct(), "case_id", "full_outer").fillna(
            0, ["n_series_listed", "n_series_stored", "series_not_listed"])
    first = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    by_key = lambda df, value: df.groupBy("case_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", value)), first)).alias("m"))
    ways = by_key(routes, F.col("series_id")).withColumnRenamed("m", "routes")
    entries = by_key(log, F.struct(*[c for c in log.columns if c not in ("case_id", "key")]).alias("entry")).withColumnRenamed("m", "series")
    settings = F.struct(*[F.lit(x).alias(k) for k, x in asdict(config).items()])
    return counts.join(ways, "case_id", "left").join(entries, "case_id", "left").withColumns({
        "series_missing_on_disk": F.coalesce("series_missing_on_disk", F.array().cast("array<string>")),
        "config": settings, "study_error": F.lit(None).cast("string")})
