"""Pooling of vectors: attention over the members of a group, and concatenation of planes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PLANES

RUN = 1000  # rows that a task sums up at a time
PART = [T.StructField("_key", T.StringType()), T.StructField("_top", T.DoubleType()), T.StructField("_sum", T.DoubleType()),
        T.StructField("_vector", T.ArrayType(T.DoubleType()))]


def attention_weights(rows: DataFrame, group: list[str], score: str = "score", masked: Column | None = None) -> DataFrame:
    """Rows with `weight`: softmax of the score within the group, masked rows at 0."""
    masked = F.coalesce(masked, F.lit(False)) if masked is not None else F.lit(False)
    open_score = F.when(~masked, F.col(score))
    top = rows.groupBy(*group).agg(F.max(open_score).alias("_top"))
    lifted = rows.join(top, group).withColumn("_e", F.coalesce(F.exp(open_score - F.col("_top")), F.lit(0.0)))
    total = lifted.groupBy(*group).agg(F.sum("_e").alias("_sum"))
    return lifted.join(total, group).withColumn("weight", F.when(F.col("_sum") > 0, F.col("_e") / F.col("_sum"))
                                                .otherwise(0.0)).drop("_top", "_e", "_sum")


def attention_pool(rows: DataFrame, group: list[str], vector: str, dim: int, score: str = "score",
                   masked: Column | None = None) -> DataFrame:
    """(group, pooled): softmax-weighted sum of the vectors; the zero vector if all rows are masked.

    An aggregate in two steps, without a join. A task hands on, for each group of a run of rows, the greatest score and the
    sums of weights and weighted vectors relative to it; such parts add up after scaling to the greater score. The second
    step reads the parts sorted by group and holds one sum at a time, so neither a group's rows nor its parts need fit.
    """
    masked = F.coalesce(masked, F.lit(False)) if masked is not None else F.lit(False)
    open_score = F.when(~masked & ~F.isnan(score), F.col(score).cast("double"))
    given = rows.select(*group, F.to_json(F.struct(*group)).alias("_key"), open_score.alias("_score"), F.col(vector).alias("_vector"))
    fields = [given.schema[g] for g in group]
    parts = given.mapInArrow(_parts(group, dim), T.StructType([*fields, *PART]))
    merged = parts.repartition("_key").sortWithinPartitions("_key").mapInArrow(_merged(group, dim), T.StructType([*fields, T.StructField("pooled", T.ArrayType(T.DoubleType()))]))
    return merged


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of `dim` numbers; missing ones are 0."""
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), copy=False)
    if (n == dim).all():
        return flat.reshape(len(n), dim)
    out, at = np.zeros((len(n), dim)), np.concatenate([[0], np.cumsum(n)])
    for i in range(len(n)):
        own = flat[at[i]:at[i + 1]][:dim]
        out[i, :len(own)] = own
    return out


def _parts(group: list[str], dim: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, RUN):
                part = batch.slice(at, RUN)
                keys = part.column("_key").dictionary_encode()
                code, n = keys.indices.to_numpy(zero_copy_only=False), len(keys.dictionary)
                scores = part.column("_score").to_numpy(zero_copy_only=False).astype(float)  # NULL is NaN
                seen = ~np.isnan(scores)
                top = np.full(n, -np.inf)
                np.maximum.at(top, code[seen], scores[seen])
                weight = np.where(seen, np.exp(np.where(seen, scores - np.where(np.isfinite(top), top, 0)[code], 0)), 0)
                sums = np.zeros((n, dim))
                np.add.at(sums, code, weight[:, None] * _vectors(part.column("_vector"), dim))
                first = pa.array(np.unique(code, return_index=True)[1])
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(g).take(first) for g in group], keys.dictionary, pa.array(top), pa.array(np.bincount(code, weight, n)),
                     pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))], [*group, "_key", "_top", "_sum", "_vector"])
    return run


def _merged(group: list[str], dim: int):
    def run(batches):
        now, held = None, None

        def done() -> pa.RecordBatch:
            owner, _, total, sums = held
            pooled = sums / total if total > 0 else np.zeros(dim)
            return pa.RecordBatch.from_arrays([*[owner.column(g) for g in group], pa.array([pooled], pa.list_(pa.float64()))], [*group, "pooled"])

        for batch in batches:
            tops, totals = batch.column("_top").to_numpy(), batch.column("_sum").to_numpy()
            vectors = _vectors(batch.column("_vector"), dim)
            for i, key in enumerate(batch.column("_key").to_pylist()):
                if key != now:
                    if held is not None:
                        yield done()
                    now, held = key, (batch.slice(i, 1), tops[i], totals[i], vectors[i].copy())
                    continue
                owner, top, total, sums = held
                new = max(top, tops[i])
                a, b = (np.exp(t - new) if np.isfinite(t) else 0.0 for t in (top, tops[i]))
                held = owner, new, a * total + b * totals[i], a * sums + b * vectors[i]
        if held is not None:
            yield done()
    return run


def concat_planes(pooled: DataFrame, dim: int, planes: tuple[str, ...] = PLANES) -> DataFrame:
    """(case_id, fused): plane vectors in fixed order, zeros for a missing one, then presence flags."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    wide = pooled.groupBy("case_id").agg(*[
        F.max(F.when(F.col("plane") == p, F.col("pooled"))).alias(f"_{i}") for i, p in enumerate(planes)])
    vectors = [F.coalesce(f"_{i}", zeros) for i in range(len(planes))]
    flags = F.array(*[F.col(f"_{i}").isNotNull().cast("double") for i in range(len(planes))])
    return wide.select("case_id", F.concat(*vectors, flags).alias("fused"))
