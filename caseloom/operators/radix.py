"""Exact order statistics of array values, by groups, without a row for each value.

Distributed radix selection. A float is read as an integer of the same order; its digits of 11 bits are settled from the
left. Each pass counts, batch by batch and inside the task, the values at every digit under the prefixes that are still
wanted. Counts are summed by group, and the digit that holds the wanted rank joins the prefix. What moves is a count for
each occupied digit, at most 2,048 a batch, group and wanted rank, whatever the number and size of the frames.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table

DIGIT = 11  # bits
FRAMES = 256  # looked at together

COUNT = T.StructType([T.StructField("want", T.IntegerType()), T.StructField("digit", T.IntegerType()), T.StructField("n", T.LongType())])


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the floats; NaN last, both zeros alike."""
    values = np.where(np.isnan(values), np.abs(values), values + values.dtype.type(0))
    kind = np.uint32 if values.dtype == np.float32 else np.uint64
    bits = values.view(kind)
    top = kind(1) << kind(bits.dtype.itemsize * 8 - 1)
    return np.where(bits & top, ~bits, bits | top)


def floats(bits: np.ndarray, single: bool) -> np.ndarray:
    """The floats of such integers."""
    kind = np.uint32 if single else np.uint64
    bits = bits.astype(kind)
    top = kind(1) << kind(bits.dtype.itemsize * 8 - 1)
    return np.where(bits & top, bits & ~top, ~bits).astype(kind).view(np.float32 if single else np.float64)


def _rows(pixels: pa.Array) -> list[np.ndarray]:
    """The frames; unknown values are NaN."""
    flat = pixels.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(pixels.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@F.arrow_udf(T.LongType())
def _floor_count(pixels: pa.Array) -> pa.Array:
    """How often the least value of a frame occurs in it."""
    bits = (ordered_bits(x) for x in _rows(pixels))
    return pa.array([int((x == x.min()).sum()) if len(x) else 0 for x in bits], pa.int64())


def extent(rows: DataFrame, group: list[str], column: str = "pixels") -> DataFrame:
    """(group, total, floor_n): number of values, and how many of them equal the least."""
    least = F.array_min(column)
    each = rows.select(*group, F.size(column).alias("n"), F.when(F.isnan(least), least).otherwise(least + 0).alias("least"), _floor_count(column).alias("floor_n"))
    each = each.filter("n > 0").groupBy(*group, "least").agg(F.sum("n").alias("n"), F.sum("floor_n").alias("floor_n"))
    return each.groupBy(*group).agg(F.sum("n").alias("total"), F.min_by("floor_n", "least").alias("floor_n"))


def _counts(shift: int, digit: int, n_group: int):
    """Counts at the digit above `shift` of values under each wanted prefix (the digits settled so far), a batch and group in
    a row. Columns are those of the group, the frame and its prefixes, which all frames of a group share."""
    def counted(values: np.ndarray, prefix: int) -> np.ndarray:
        bits = ordered_bits(values)
        if shift + digit < bits.dtype.itemsize * 8:
            bits = bits[(bits >> bits.dtype.type(shift + digit)) == bits.dtype.type(prefix)]
        at = ((bits >> bits.dtype.type(shift)) & bits.dtype.type((1 << digit) - 1)).astype(np.int64)
        return np.bincount(at, minlength=1 << digit)

    def run(parts):
        for part in parts:
            if not part.num_rows:
                continue
            code = np.zeros(part.num_rows, np.int64)
            for i in range(n_group):
                held = part.column(i).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(held.dictionary) + held.indices.to_numpy(), return_inverse=True)[1]
            order = np.argsort(code, kind="stable")
            found = []
            for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                wanted = part.column(n_group + 1)[int(own[0])].as_py() or []
                sums = {prefix: np.zeros(1 << digit, np.int64) for prefix in wanted}  # ranks that share a prefix are counted once
                for at in range(0, len(own), FRAMES):
                    values = part.column(n_group).take(pa.array(own[at:at + FRAMES])).flatten().to_numpy(zero_copy_only=False)
                    for prefix, total in sums.items():
                        total += counted(values, prefix)
                for want, prefix in enumerate(wanted):
                    at = np.flatnonzero(sums[prefix])
                    found.append((np.full(len(at), own[0]), np.full(len(at), want, np.int32), at.astype(np.int32), sums[prefix][at]))
            row, *numbers = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(row)) for i in range(n_group)],
                                              *[pa.array(x, t) for x, t in zip(numbers, (pa.int32(), pa.int32(), pa.int64()), strict=True)]],
                                             [*part.schema.names[:n_group], "want", "digit", "n"])

    return run


def _as_float(single: bool):
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def read(prefixes: pa.Array) -> pa.Array:
        return pa.array([floats(np.array(p, np.int64).view(np.uint64), single).astype(np.float64) for p in prefixes.to_pylist()], pa.list_(pa.float64()))
    return read


def values_at(rows: DataFrame, group: list[str], ranks: DataFrame, column: str = "pixels") -> DataFrame:
    """(group, values): the values at some ranks (from 0, ascending, NaN last) of all values of a group.

    `ranks` has one row for each group, with the same number of `ranks` (array of long) in all of them.
    """
    single = isinstance(rows.schema[column].dataType.elementType, T.FloatType)
    bits = 32 if single else 64
    frames = rows.select(*group, column)
    state = ranks.select(*group, F.col("ranks").alias("rank"), F.transform("ranks", lambda r: F.lit(0).cast("long")).alias("prefix"))
    done = 0
    while done < bits:
        digit = min(DIGIT, bits - done)
        shift = bits - done - digit
        counted = frames.join(state.select(*group, "prefix"), group).select(*group, column, "prefix").mapInArrow(
            _counts(shift, digit, len(group)), T.StructType([*[frames.schema[g] for g in group], *COUNT]))
        counted = counted.groupBy(*group, "want", "digit").agg(F.sum("n").alias("n"))
        order = Window.partitionBy(*group, "want").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("below", F.coalesce(F.sum("n").over(order), F.lit(0)))
        old = state.select(*group, F.posexplode(F.arrays_zip("rank", "prefix")).alias("want", "old")).select(*group, "want", "old.*")
        inside: Column = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
        new = counted.join(old, [*group, "want"]).filter(inside).select(
            *group, "want", (F.col("rank") - F.col("below")).alias("rank"), (F.shiftleft("prefix", digit) + F.col("digit")).alias("prefix"))
        listed = F.sort_array(F.collect_list(F.struct("want", "rank", "prefix")))
        state = new.groupBy(*group).agg(listed.alias("l")).select(*group, F.col("l.rank").alias("rank"), F.col("l.prefix").alias("prefix"))
        done += digit
        if done < bits:  # a few numbers a group; the next pass reads them twice
            state = written_table(state, "radix")
    return state.select(*group, _as_float(single)(F.col("prefix")).alias("values"))
