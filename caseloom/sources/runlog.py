"""Append-only log of epochs and finished runs, and the leaderboard over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_rows(rows: DataFrame, path: str) -> None:
    """Add log rows, stamped with the time of writing."""
    rows.withColumn("time", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")).write.mode("append").parquet(path)


def best_per_run(epochs: DataFrame, score: str = "val_macro_auc") -> DataFrame:
    """(run, fold, best, epoch): the best score of every run and the first epoch that reached it. NaN is no score."""
    value = F.when(~F.isnan(score), F.col(score))
    return epochs.groupBy("run", "fold").agg(
        F.max(value).alias("best"),
        F.max_by("epoch", F.when(value.isNotNull(), F.struct(value.alias("s"), (-F.col("epoch")).alias("e")))).alias("epoch"))


def leaderboard(summaries: DataFrame, score: str = "best") -> DataFrame:
    """(run, folds, mean_score, best_score) over the folds of each run that have a score; NaN is no score."""
    value = F.when(~F.isnan(score), F.col(score))
    return summaries.groupBy("run").agg(
        F.count_distinct("fold").alias("folds"), F.avg(value).alias("mean_score"), F.max(value).alias("best_score"))
