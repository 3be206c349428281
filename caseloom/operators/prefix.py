"""Running totals and row numbers that never put a whole group into one task.

Rows are cut into ranges by (keys, order), so a large group spreads over many partitions. A window runs inside each range
only; what precedes the range comes from per-range totals. Those are added by a broadcast of at most one row per range,
because only the group that crosses into a range needs one.

Where the ranges end is settled first, from a sample of bounded size; a row's range is then an expression of the row alone.
So one exchange is enough: rows go to the partition that bears their range's number, and the totals, which are aggregated
before they move, agree with it however often either is computed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import partitions

RANGE = "_range"
SAMPLED = 32  # sampled rows a range, on average
LEAST_ROWS = 500  # a range of its own is not worth less


def _unsorted(order: Column) -> tuple[Column, bool]:
    """A column without its sort direction, and whether that is descending."""
    node = order._jc.node()
    if node.getClass().getSimpleName() != "SortOrder":
        return order, False
    return Column(SparkSession.active()._jvm.org.apache.spark.sql.Column(node.child())), "Descending" in node.sortDirection().toString()


def _ranges(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[Column, int]:
    """(range of a row, number of ranges). NULL sorts as the least value."""
    rows = df.count()
    wanted = min(partitions(df.sparkSession), max(1, rows // LEAST_ROWS))
    if wanted == 1:
        return F.lit(0), 1
    fields = [(F.col(f"`{k}`"), False) for k in keys] + [_unsorted(c) for c in order]
    at = F.struct(*[c.alias(f"f{i}") for i, (c, _) in enumerate(fields)])
    place = df.select(at.alias("place"))
    step = max(1, rows // (wanted * SAMPLED))
    sample = place.filter(F.pmod(F.xxhash64("place"), F.lit(step)) == 0).orderBy(*[
        F.desc(f"place.f{i}") if down else F.asc(f"place.f{i}") for i, (_, down) in enumerate(fields)]).select(F.to_json("place")).collect()
    ends = list(dict.fromkeys(sample[len(sample) * i // wanted][0] for i in range(1, wanted))) if sample else []
    if not ends:
        return F.lit(0), 1
    # Number of range ends up to the row, by bisection in a constant array.
    bounds = F.from_json(F.lit("[" + ",".join(ends) + "]"), f"array<{place.schema['place'].dataType.simpleString()}>")

    def reached(end: Column) -> Column:
        """Whether the row sorts at or after a range end; structs compare field by field, NULL first."""
        if not any(down for _, down in fields):
            return end <= at
        result = F.lit(True)
        for i, (c, down) in reversed(list(enumerate(fields))):
            one, other = F.struct(end[f"f{i}"].alias("f")), F.struct(c.alias("f"))
            result = ((one > other) if down else (one < other)) | ((one == other) & result)
        return result

    def halved(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / 2).cast("int")
        after = (span["low"] < span["high"]) & reached(F.get(bounds, middle))
        return F.struct(F.when(after, middle + 1).otherwise(span["low"]).alias("low"), F.when(after, span["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(math.ceil(math.log2(len(ends) + 1)) + 1))
    whole = F.struct(F.lit(0).alias("low"), F.lit(len(ends)).alias("high"))
    return F.aggregate(steps, whole, halved, lambda span: span["low"]), len(ends) + 1


def with_ranges(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows in the partition of their range, whose number is added."""
    number, count = _ranges(df, keys, order)
    return df.withColumn(RANGE, number).repartitionById(count, RANGE)


def running_totals(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for every entry of `sums`, its total over the rows of the group that sort before this row.

    `order` must be unique within a group; NULL counts as the least value. `df` is read four times (to count, to sample, for totals and for the rows) and must
    give the same rows each time; where it is costly, the caller writes it before.
    """
    number, count = _ranges(df, keys, order)
    ranged = df.withColumn(RANGE, number)
    local = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    if count == 1:
        return ranged.select(*[f"`{c}`" for c in df.columns], *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(n) for n, c in sums.items()])
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, RANGE, *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums])
    # The first range of a group has nothing before it; every other row starts a new partition.
    offsets = offsets.filter(reduce(lambda a, b: a | b, [F.col(f"_o_{n}").isNotNull() for n in sums]))
    # A NULL key is a group like any other.
    offsets = offsets.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, RANGE]})
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`_k_{k}`")) for k in [*keys, RANGE]])
    joined = ranged.repartitionById(count, RANGE).join(F.broadcast(offsets), same, "left")
    return joined.select(*[f"`{c}`" for c in df.columns], *[
        (F.coalesce(F.sum(c).over(local), F.lit(0)) + F.coalesce(f"_o_{n}", F.lit(0))).alias(n)
        for n, c in sums.items()])


def row_numbers(df: DataFrame, keys: list[str], order: list[Column], out: str = "row_no") -> DataFrame:
    """Add the 0-based position within the group (of the whole table if `keys` is empty)."""
    one = df if keys else df.withColumn("_all", F.lit(0))
    numbered = running_totals(one, keys or ["_all"], order, {out: F.lit(1)})
    return numbered if keys else numbered.drop("_all")


def shard(df: DataFrame, case_id: str, index: int, count: int) -> DataFrame:
    """Every `count`-th case in id order, starting at `index`."""
    numbered = row_numbers(df, [], [F.col(case_id)], "_no")
    return numbered.filter(F.pmod(F.col("_no"), F.lit(count)) == index).drop("_no")


def first_cases(df: DataFrame, case_id: str, n: int) -> DataFrame:
    return df.orderBy(case_id).limit(n)


def seeded_order(case_id: Column, seed: int) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), case_id.cast("string")))


def sample_cases(df: DataFrame, case_id: str, n: int, seed: int = 0) -> DataFrame:
    """n cases drawn without replacement; the same ones for the same seed on any cluster."""
    return df.orderBy(seeded_order(F.col(case_id), seed), case_id).limit(n)
