"""Slice files: listing, decoding with functions supplied by the caller."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# content -> {"transfer_syntax", "pixels" (2-d or 3-d array), "channels", "slope", "intercept", "inverted"}
Decoder = tuple[str, Callable[[bytes], dict]]

# content -> fields of HEADERS (any may be missing); raises if there is no header
HeaderReader = Callable[[bytes], dict]

HEADERS = ("case_id string, series_id string, path string, instance_number string, position array<string>, orientation array<string>, "
           "pixel_spacing array<string>, slice_thickness string, rows string, cols string, transfer_syntax string, "
           "series_description string, readable boolean")
DECODED = ("case_id string, series_id string, path string, transfer_syntax string, ok boolean, error string, "
           "frame int, h int, w int, channels int, slope double, intercept double, inverted boolean, pixels array<float>")


HELD_PIXELS = 1 << 20  # pixels that a decoding task hands on at a time, or more if one file has more
HELD_FRAMES = 2_000


def slice_files(spark: SparkSession, root: str, suffix: str = "*.dcm") -> DataFrame:
    """(case_id, series_id, file, path, length, content) of <root>/<case>/<series>/<file>; folders may be called name=value.

    `content` is not read unless it is used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffix).load(root)
    part = lambda i: F.regexp_extract("path", r"(?:[^/=]+=)?([^/]+)/(?:[^/=]+=)?([^/]+)/([^/]+)$", i)
    return files.select(part(1).alias("case_id"), part(2).alias("series_id"), part(3).alias("file"), "path", "length", "content")


def file_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("case_id", "series_id").agg(F.count("*").alias("n_files"), F.min("file").alias("first_file"))


def read_headers(files: DataFrame, reader: HeaderReader) -> DataFrame:
    """One header row for each file, for `series.typed_headers`; `readable` is false where the reader fails."""
    names = [c.split()[0] for c in HEADERS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for case_id, series_id, path, content in zip(pdf["case_id"], pdf["series_id"], pdf["path"], pdf["content"]):
                row = dict.fromkeys(names) | {"case_id": case_id, "series_id": series_id, "path": path, "readable": False}
                try:
                    got = reader(bytes(content))
                    row |= {"readable": True, **{k: _text(got.get(k)) for k in names[3:-1]}}
                except Exception:  # noqa: BLE001 - whatever a reader raises, the file has no header
                    pass
                rows.append(row)
            yield pd.DataFrame(rows, columns=names)

    return files.select("case_id", "series_id", "path", "content").mapInPandas(run, HEADERS)


def _text(value):
    """Header values as text: their types are settled by `typed_headers`."""
    if value is None or isinstance(value, str):
        return value
    return [str(v) for v in value] if isinstance(value, list | tuple | np.ndarray) else str(value)


def _decode(content: bytes, decoders: list[Decoder]) -> dict:
    """The first decoder that succeeds; the errors of all of them otherwise."""
    errors = []
    for name, decode in decoders:
        try:
            return decode(content)
        except Exception as exc:  # noqa: BLE001 - any failure of one decoder hands over to the next
            errors.append(f"{name}: {exc.__class__.__name__}: {exc}")
    raise ValueError(" | ".join(errors))


def decode_files(files: DataFrame, decoders: list[Decoder], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per frame, or one failed row per undecodable file. Nothing a file holds can fail the job.

    The columns `keep` of `files` come along, so that frames need no join to get them back.
    """
    schema = ", ".join([DECODED, *[f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep]])
    names = [c.split()[0] for c in DECODED.split(", ")] + list(keep)

    def run(batches):
        held, pixels_held = [], 0
        for pdf in batches:
            kept = [pdf[c].tolist() for c in keep]
            for at, (case_id, series_id, path, content) in enumerate(zip(pdf["case_id"], pdf["series_id"], pdf["path"], pdf["content"])):
                rows = []
                own = {c: values[at] for c, values in zip(keep, kept)}
                base = {"case_id": case_id, "series_id": series_id, "path": path, "transfer_syntax": "unknown",
                        "ok": False, "error": None, "frame": 0, "h": 0, "w": 0, "channels": 1, "slope": 1.0,
                        "intercept": 0.0, "inverted": False, "pixels": None, **own}
                try:
                    got = _decode(bytes(content), decoders)
                    base["transfer_syntax"] = str(got.get("transfer_syntax") or "unknown")
                    pixels = np.asarray(got["pixels"], dtype=np.float32)
                    if pixels.size == 0 or not np.isfinite(pixels).all():
                        raise ValueError("empty or non-finite pixels")
                    channels = int(got.get("channels") or 1)
                    frames = pixels[None] if pixels.ndim == (2 if channels == 1 else 3) else pixels
                    for i, frame in enumerate(frames):
                        rows.append({**base, "ok": True, "frame": i, "h": frame.shape[0], "w": frame.shape[1],
                                     "channels": channels, "slope": float(got.get("slope") or 1),
                                     "intercept": float(got.get("intercept") or 0),
                                     "inverted": bool(got.get("inverted")), "pixels": frame.ravel()})
                except Exception as exc:  # noqa: BLE001
                    rows.append({**base, "error": f"{exc.__class__.__name__}: {exc}"[:300]})
                # Some files at a time: what is held does not grow with the batch, beyond the file that fills it.
                held += rows
                pixels_held += sum(1 if r["pixels"] is None else len(r["pixels"]) for r in rows)
                if pixels_held >= HELD_PIXELS or len(held) >= HELD_FRAMES:
                    yield pd.DataFrame(held, columns=names)
                    held, pixels_held = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return files.select("case_id", "series_id", "path", "content", *keep).mapInPandas(run, schema)
