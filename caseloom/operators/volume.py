"""Volumes as tables with one row per slice: (case_id, series_id, slice_idx, h, w, pixels ARRAY<FLOAT>).

`pixels` is the frame row by row. A volume is a set of rows and may be of any length.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import letterbox, selected_number
from ..functions.numeric import clip
from ..functions.resample import letterboxed
from . import radix
from .prefix import row_numbers, sample_cases, seeded_order

VOLUME = ["case_id", "series_id"]
CHUNK = 256  # slices a window task holds at once

# Percentile windows by name.
WINDOWS = {
    "standard": (0.5, 99.5),
    "fluid": (0.5, 99.9),
    "bone": (1.0, 98.0),
}
SMALL_FOREGROUND = 100


@dataclass(frozen=True)
class PreprocessConfig:
    img_size: int = 128
    max_slices: int = 32
    window: str = "standard"
    keep_aspect: bool = True
    dtype: str = "uint8"


def normalise_frames(frames: DataFrame) -> DataFrame:
    """Rescale, invert and grey raw frames: columns pixels, channels, slope, intercept, inverted.

    Colour frames hold the channels of a pixel next to each other; the first three are averaged.
    """
    size = F.size("pixels") / F.col("channels")
    grey = F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: sum(
        (F.element_at("pixels", (i * F.col("channels") + c + 1).cast("int")).cast("double") for c in range(3)),
        F.lit(0.0)) / 3)
    plain = F.transform("pixels", lambda v: v.cast("double"))
    df = frames.withColumn("_v", F.when(F.col("channels") >= 3, grey).otherwise(plain))
    slope, intercept = F.coalesce(F.nullif("slope", F.lit(0.0)), F.lit(1.0)), F.coalesce("intercept", F.lit(0.0))
    df = df.withColumn("_v", F.transform("_v", lambda v: v * slope + intercept)).withColumn("_max", F.array_max("_v"))
    if "path" in frames.columns:  # the frames of a file are inverted against the largest value of the file
        file = [c for c in (*VOLUME, "path") if c in frames.columns]
        peaks = df.filter("inverted").groupBy(*file).agg(F.max("_max").alias("_peak")).withColumnsRenamed({c: f"_f_{c}" for c in file})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_f_{c}")) for c in file])
        df = df.join(peaks, same, "left").withColumn("_max", F.coalesce("_peak", "_max")).drop("_peak", *[f"_f_{c}" for c in file])
    value = F.when(F.coalesce("inverted", F.lit(False)), F.transform("_v", lambda v: F.col("_max") - v)).otherwise(F.col("_v"))
    return df.withColumn("pixels", F.transform(value, lambda v: v.cast("float"))) \
        .drop("_v", "_max", "channels", "slope", "intercept", "inverted")


def window_bounds(volume: DataFrame, window: str = "standard") -> DataFrame:
    """(case_id, series_id, lo, hi): percentiles of the foreground, that is of all values above the minimum.

    With 100 foreground values or fewer the whole volume counts. Exact and interpolated, see `operators/radix.py`.
    """
    quantiles = [q / 100 for q in WINDOWS[window]]
    size = radix.extent(volume, VOLUME)
    foreground = F.col("total") - F.col("floor_n")
    whole = foreground <= SMALL_FOREGROUND
    size = size.select(*VOLUME, F.when(whole, F.lit(0)).otherwise(F.col("floor_n")).alias("skip"),
                       F.when(whole, F.col("total")).otherwise(foreground).alias("m"))
    places = [F.lit(q) * (F.col("m") - 1) for q in quantiles]
    ranks = size.select(*VOLUME, "m", F.array(*[
        (F.col("skip") + f(p)).cast("long") for p in places for f in (F.floor, F.ceil)]).alias("ranks"))
    found = radix.values_at(volume, VOLUME, ranks.select(*VOLUME, "ranks")).join(ranks.select(*VOLUME, "m"), VOLUME)

    def interpolated(i: int) -> Column:
        low, high = F.col("values")[2 * i], F.col("values")[2 * i + 1]
        return low + (high - low) * (places[i] - F.floor(places[i]))

    return found.select(*VOLUME, interpolated(0).alias("lo"), interpolated(1).alias("hi"))


def _windowed(pixels: str) -> Column:
    """Pixels limited to [lo, hi] and scaled to [0, 1]; zero where the window is empty."""
    lo, hi = F.col("lo"), F.col("hi")
    empty = F.coalesce((hi <= lo) | F.isnan(lo) | F.isnan(hi), F.lit(True))
    return F.transform(pixels, lambda v: F.when(empty, 0.0).otherwise(clip((v - lo) / (hi - lo))).cast("float"))


def apply_window(volume: DataFrame, bounds: DataFrame) -> DataFrame:
    """Pixels limited to [lo, hi] and scaled to [0, 1]; zero where the window is empty."""
    return volume.join(bounds, VOLUME).withColumn("pixels", _windowed("pixels")).drop("lo", "hi")


def window_volume(volume: DataFrame, window: str = "standard") -> DataFrame:
    return apply_window(volume, window_bounds(volume, window))


def select_slices(volume: DataFrame, max_slices: int) -> DataFrame:
    """At most `max_slices` evenly spaced slices per volume, renumbered from 0 as `slice_idx`.

    Slices are numbered from 0 without gaps, so the new number follows from the old one and the count.
    """
    n = volume.groupBy(*VOLUME).agg(F.count("*").alias("_n"))
    return _chosen(volume.join(n, VOLUME), max_slices)


def _chosen(counted: DataFrame, max_slices: int) -> DataFrame:
    """The chosen ones of slices that know the count (`_n`) of their volume."""
    numbered = counted.withColumn("_no", selected_number(F.col("slice_idx"), F.col("_n"), max_slices))
    return numbered.filter("_no is not null").withColumnRenamed("slice_idx", "source_idx").withColumnRenamed("_no", "slice_idx").drop("_n")


def resize(volume: DataFrame, size: int, keep_aspect: bool = True) -> DataFrame:
    """Frames resized to size x size, with the aspect in millimetres kept if `pixel_spacing` is known."""
    has_spacing = "pixel_spacing" in volume.columns
    row_mm = F.coalesce(F.col("pixel_spacing")[0], F.lit(1.0)) if has_spacing else F.lit(1.0)
    col_mm = F.coalesce(F.col("pixel_spacing")[1], F.lit(1.0)) if has_spacing else F.lit(1.0)
    full = F.struct(F.lit(size).alias("new_h"), F.lit(size).alias("new_w"), F.lit(0).alias("top"), F.lit(0).alias("left"))
    box = letterbox(F.col("h"), F.col("w"), size, row_mm, col_mm) if keep_aspect else full
    return volume.withColumn("pixels", letterboxed("pixels", "h", "w", F.lit(size), box)) \
        .withColumn("h", F.lit(size)).withColumn("w", F.lit(size))


def to_storage(volume: DataFrame, dtype: str = "uint8") -> DataFrame:
    """Add `stored`: BINARY of 0..255 rounded half to even, or the floats as they are."""
    if dtype == "uint8":
        return volume.withColumn("stored", _bytes_of(F.col("pixels").cast("array<double>")))
    unit = F.transform("pixels", lambda v: clip(v.cast("double")))
    if dtype == "float":
        return volume.withColumn("stored", F.transform(unit, lambda v: v.cast("float")))
    raise ValueError(f"unsupported dtype {dtype!r}")


def from_storage(stored: Column) -> Column:
    """Stored bytes as floats in [0, 1]."""
    return _floats_of(stored)


@F.arrow_udf(T.BinaryType())
def _bytes_of(pixels: pa.Array) -> pa.Array:
    """Frames of values clipped to [0, 1] as bytes."""
    flat = np.rint(np.nan_to_num(np.clip(pixels.flatten().to_numpy(zero_copy_only=False), 0, 1)) * 255).astype(np.uint8)
    ends = np.concatenate([[0], np.cumsum(pixels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return pa.array([flat[a:b].tobytes() if ok else None for a, b, ok in zip(ends[:-1], ends[1:], pixels.is_valid().to_pylist())], pa.binary())


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _floats_of(stored: pa.Array) -> pa.Array:
    """Stored bytes as floats."""
    return pa.array([None if x is None else np.frombuffer(x, np.uint8).astype(np.float32) / np.float32(255) for x in stored.to_pylist()], pa.list_(pa.float32()))


def preprocess(volume: DataFrame, config: PreprocessConfig = PreprocessConfig()) -> DataFrame:
    """Window over the full series, then choose slices, resize and store.

    Bounds and counts meet the frames in one join, and only chosen frames are windowed.
    """
    n = volume.groupBy(*VOLUME).agg(F.count("*").alias("_n"))
    facts = window_bounds(volume, config.window).join(n, VOLUME)
    chosen = _chosen(volume.join(facts, VOLUME), config.max_slices)
    return stored_frames(chosen, config)


def stored_frames(chosen: DataFrame, config: PreprocessConfig) -> DataFrame:
    """Frames with `lo` and `hi`, windowed, resized and stored."""
    windowed = chosen.withColumn("pixels", _windowed("pixels")).drop("lo", "hi")
    return to_storage(resize(windowed, config.img_size, config.keep_aspect), config.dtype).drop("pixels")


def series_log(routes: DataFrame, stored: DataFrame, raw: DataFrame, dropped: DataFrame) -> DataFrame:
    """One row per routed series: slices read and saved, drops, and an error where nothing survived."""
    raw_n = raw.groupBy(*VOLUME).agg(F.count("*").alias("n_raw_slices"))
    saved_n = stored.groupBy(*VOLUME).agg(F.count("*").alias("n_saved_slices"))
    return routes.join(raw_n, VOLUME, "left").join(saved_n, VOLUME, "left").join(dropped, VOLUME, "left").select(
        "case_id", "key", "series_id", F.coalesce("n_raw_slices", F.lit(0)).alias("n_raw_slices"),
        F.coalesce("n_saved_slices", F.lit(0)).alias("n_saved_slices"), "dropped",
        F.when(F.col("n_saved_slices").isNull(), F.left(F.concat(
            F.lit("DecodeError: no slice could be decoded "), F.coalesce(F.to_json("dropped"), F.lit("{}"))), F.lit(500)))
        .alias("error"))


def _in_chunks(volume: DataFrame, before: int, after: int) -> DataFrame:
    """Slices with their chunk, plus copies of the few slices a neighbouring chunk looks at."""
    if max(before, after) >= CHUNK:
        raise ValueError(f"at most {CHUNK - 1} neighbouring slices")
    own, at = F.floor(F.col("slice_idx") / CHUNK), F.pmod(F.col("slice_idx"), F.lit(CHUNK))
    homes = F.array(own, F.when((at < after) & (own > 0), own - 1), F.when(at >= CHUNK - before, own + 1))
    return volume.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_compact(homes)))


def _neighbours(before: int, after: int):
    base = Window.partitionBy(*VOLUME, "_chunk").orderBy("slice_idx")
    return base, base.rowsBetween(-before, after)


def make_slabs(volume: DataFrame) -> DataFrame:
    """Add `previous` and `following`: the neighbouring frames, or the frame itself at either end."""
    order, _ = _neighbours(1, 1)
    df = _in_chunks(volume, 1, 1).withColumns({
        "previous": F.coalesce(F.lag("pixels").over(order), "pixels"),
        "following": F.coalesce(F.lead("pixels").over(order), "pixels")})
    return df.filter("_chunk = _own").drop("_chunk", "_own")


def sliding_mip(volume: DataFrame, thickness: int = 3) -> DataFrame:
    """Pixels replaced by their maximum over a window of `thickness` slices; ends see fewer slices."""
    if thickness <= 1:
        return volume
    before, after = thickness // 2, thickness - 1 - thickness // 2
    _, frame = _neighbours(before, after)
    df = _in_chunks(volume, before, after).withColumn("_near", F.collect_list("pixels").over(frame))
    brightest = F.aggregate(F.slice("_near", 2, thickness), F.col("_near")[0],
                            lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return df.filter("_chunk = _own").withColumn("pixels", brightest).drop("_chunk", "_own", "_near")


def montage_tiles(volume: DataFrame, plane: str, n_cases: int, per_plane: int = 5, seed: int = 0) -> DataFrame:
    """(case_id, plane, tile, slice_idx): evenly spaced slices of some cases, padded with NULL to a full row.

    `plane` names the column that holds the plane.
    """
    cases = sample_cases(volume.select("case_id").distinct(), "case_id", n_cases, seed)
    part = volume.select("case_id", F.col(plane).alias("plane"), "slice_idx").join(cases, "case_id", "left_semi")
    n = part.groupBy("case_id", "plane").agg(F.count("*").alias("n"))
    tiles = n.select("case_id", "plane", "n", F.explode(F.sequence(F.lit(0), F.lit(per_plane - 1))).alias("tile"))
    step = (F.col("n") - 1) / F.lit(float(max(per_plane - 1, 1)))
    index = F.when(F.col("n") > per_plane, F.rint(F.col("tile") * step).cast("int")).when(
        F.col("tile") < F.col("n"), F.col("tile"))
    return tiles.select("case_id", "plane", "tile", index.alias("slice_idx"))


def flip(volume: DataFrame) -> DataFrame:
    """Every frame mirrored left to right."""
    rows = F.transform(F.sequence(F.lit(0), F.col("h") - 1),
                       lambda r: F.reverse(F.slice("pixels", r * F.col("w") + 1, F.col("w"))))
    return volume.withColumn("pixels", F.flatten(rows))


def _uniform(salt: str, seed: int, low: float, high: float) -> Column:
    """A number per volume that depends on its ids and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(salt), *VOLUME), 11)
    return F.lit(low) + (high - low) * (bits.cast("double") / float(2 ** 53))


def drop_slices(volume: DataFrame, seed: int, probability: float = 0.3, most: float = 0.15, least: int = 15) -> DataFrame:
    """Drop 5 % to `most` of the slices of some volumes with more than `least` slices; order is kept."""
    n = volume.groupBy(*VOLUME).agg(F.count("*").alias("_n"))
    count = F.greatest(F.lit(1), F.floor(F.col("_n") * _uniform("share", seed, 0.05, most)))
    some = (F.col("_n") > least) & (_uniform("slices", seed, 0.0, 1.0) < probability)
    n = n.withColumn("_drop", F.when(some, count).otherwise(0)).drop("_n")
    shuffled = volume.join(n, VOLUME).withColumn("_o", seeded_order(F.concat_ws(":", *VOLUME, "slice_idx"), seed))
    light = row_numbers(shuffled.select(*VOLUME, "slice_idx", "_drop", "_o"), VOLUME, [F.col("_o"), F.col("slice_idx")], "_r")
    gone = light.filter("_r < _drop").select(*VOLUME, "slice_idx")
    return volume.join(gone, [*VOLUME, "slice_idx"], "left_anti")


def jitter(volume: DataFrame, seed: int, probability: float = 0.5) -> DataFrame:
    """Standardise some volumes, then apply a random gain and signed gamma, limited to +-3."""
    pixel = lambda f: F.aggregate("pixels", F.lit(0.0), lambda s, v: s + f(v.cast("double")))
    sums = volume.select(*VOLUME, F.size("pixels").alias("k"), pixel(lambda v: v).alias("s"),
                         pixel(lambda v: v * v).alias("q"))
    stats = sums.groupBy(*VOLUME).agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("k")
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * mean) / (F.col("k") - 1))) + 1e-6
    stats = stats.select(*VOLUME, mean.alias("_mean"), std.alias("_std"),
                         (_uniform("jitter", seed, 0.0, 1.0) < probability).alias("_on"),
                         _uniform("gain", seed, 0.9, 1.1).alias("_gain"), _uniform("gamma", seed, 0.85, 1.15).alias("_gamma"))

    def changed(v: Column) -> Column:
        scaled = (v - F.col("_mean")) / F.col("_std") * F.col("_gain")
        return clip(F.signum(scaled) * F.pow(F.abs(scaled), F.col("_gamma")), -3.0, 3.0).cast("float")

    return volume.join(stats, VOLUME).withColumn(
        "pixels", F.when(F.col("_on"), F.transform("pixels", changed)).otherwise(F.col("pixels"))) \
        .drop("_mean", "_std", "_on", "_gain", "_gamma")
