"""Near-duplicate vectors by random-hyperplane sign hashing in several tables.

Identical vectors become one row with a count. Each distinct vector gets, for every table, the signs of its products with
random hyperplanes as a bucket key. Vectors that share a bucket are compared exactly, in double precision; a pair that
shares several buckets counts in the first one only. Tasks hand on a count for each vector and the edges of a spanning
forest, never pairs; `graph.components` joins the edges up.

The number of bits follows the number of distinct vectors, so that unrelated ones fill a bucket with about `FILL`; the
number of tables then brings the chance of finding a pair at exactly the least cosine to `RECALL` (closer pairs: more).

Crowded buckets (over `CELL` rows) are cut into blocks that meet pairwise in tasks of their own. Before that, dense groups
are recognised: the rows of a crowded bucket that lie within half of the largest linking angle of a leader form its ball,
and any two of a ball are linked by the triangle inequality. A ball is counted, not compared: a group of near copies that
holds a third of all rows costs a number of steps in proportion to its size. Leaders are the rows of smallest hash in a
bucket, so that one group has the same leader in all tables.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing and is its
own component, as are vectors of different lengths to each other. Repeated rows are vectors of their own and link with each
other. Rows with a null vec_id link like others; a component's id is its smallest non-null vec_id, so null if there is none,
and then `kept` is false. An empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import partitions, spread, written_table
from .graph import components
from .hashing import mix

FILL = 16  # unrelated vectors in a bucket, on average
RECALL = 0.995
CELL = 1024  # rows of a block; two blocks meet in a task
LEADERS = 4  # of a crowded bucket
MARGIN = 1e-6  # radians, far above rounding
SEED = 20177

BUCKET = ["dim", "tab", "key"]


def plan(rows: int, least: float) -> tuple[int, int]:
    """(bits, tables) for a number of distinct vectors."""
    agree = 1 - math.acos(least) / math.pi
    bits = min(60, max(4, math.ceil(math.log2(max(rows, 1) / FILL)) if rows > FILL else 4))
    return bits, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - agree ** bits)))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length, as unit vectors in double precision."""
    rows = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _signed(bits: int, tables: int):
    """Adds the keys of all tables, as 64-bit integers in one binary value."""
    planes: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            dims, keys = np.asarray(batch.column("dim")), [None] * batch.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, int(dim)]).standard_normal((int(dim), bits * tables))
                signs = matrix(batch.column("vec").take(pa.array(at))) @ planes[dim] >= 0
                packed = (signs.reshape(len(at), tables, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                for i, row in zip(at, packed.astype(">i8"), strict=True):
                    keys[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary()), pa.array(mix(np.asarray(batch.column("rid")).astype(np.uint64)).view(np.int64))],
                                             [*batch.schema.names, "sig", "m"])
    return run


def _near_leader(least: float):
    """Rows (rid, m, leader): a leader within half of the largest linking angle."""
    cos = math.cos(math.acos(least) / 2 - MARGIN)

    def run(batches):
        for batch in batches:
            dims, near = np.asarray(batch.column("dim")), np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                a, b = (matrix(batch.column(c).take(pa.array(at))) for c in ("vec", "lvec"))
                near[at] = np.einsum("ij,ij->i", a, b) >= cos
            yield batch.select(["rid", "lm", "lrid"]).filter(pa.array(near))
    return run


def _pairs(vectors: np.ndarray, two: bool, side: np.ndarray, ball: np.ndarray, keys: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the linked pairs of a cell (of one block, or between `two`) that no ball contains and no earlier table (`keys`) has together."""
    if two:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = np.nonzero(vectors[left] @ vectors[right].T >= least)
        a, b = left[a], right[b]
    else:
        a, b = np.nonzero(np.triu(vectors @ vectors.T >= least, 1))
    keep = (ball[a] != ball[b]) | (ball[a] < 0)
    a, b = a[keep], b[keep]
    first = np.ones(len(a), bool)
    for low in range(0, len(a) if keys.shape[1] else 0, 1 << 16):
        part = slice(low, low + (1 << 16))
        first[part] = ~(keys[a[part]] == keys[b[part]]).any(1)
    return a[first], b[first]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n rows reaches."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def _compared(least: float):
    """Rows (rid, links, root): what a cell adds to a vector's links, and a vector that it reaches there."""
    columns = ["dim", "tab", "key", "ci", "cj"]

    def cells(table: pa.Table, cuts: np.ndarray):
        """The cells between `cuts`; rows are sorted, so those of one length are neighbours."""
        out: list[list] = [[], [], []]
        dim, tab, ci, cj, side, ball, n, rid = (np.asarray(table.column(c)) for c in ("dim", "tab", "ci", "cj", "side", "ball", "n", "rid"))
        start, vectors, keys = 0, np.zeros((0, 0)), np.zeros((0, 0))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high - low < 2:
                continue
            if low >= start + len(vectors):
                start, stop = low, np.searchsorted(dim[:cuts[-1]], dim[low], "right")
                vectors = matrix(table.column("vec").slice(start, stop - start).combine_chunks())
                keys = np.frombuffer(b"".join(table.column("sig").slice(start, stop - start).to_pylist()), ">i8").reshape(stop - start, -1)
            cell, own = slice(low, high), slice(low - start, high - start)
            a, b = _pairs(vectors[own], ci[low] != cj[low], side[cell], ball[cell], keys[own, :tab[low]], least)
            if len(a):
                links = np.bincount(a, n[cell][b], high - low) + np.bincount(b, n[cell][a], high - low)
                have = np.flatnonzero(links)
                for store, values in zip(out, (rid[cell][have], links[have].astype(np.int64), rid[cell][_roots(high - low, a, b)[have]]), strict=True):
                    store.append(values)
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
        return pa.RecordBatch.from_arrays(arrays, ["rid", "links", "root"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            keys = [np.asarray(table.column(c)) for c in columns]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(changes):
                yield cells(table, np.concatenate([[0], changes]))
            rest = table.slice(changes[-1] if len(changes) else 0)
        if rest is not None:
            yield cells(rest, np.array([0, rest.num_rows]))
    return run


def _balls(rows: DataFrame, least: float) -> DataFrame:
    """(rid, ball) of the rows of crowded buckets that lie near a leader; the ball is the leader's rid."""
    at = Window.partitionBy(*BUCKET).orderBy("m", "rid")
    leaders = rows.withColumn("no", F.row_number().over(at)).filter(F.col("no") <= LEADERS).select(
        *BUCKET, F.col("m").alias("lm"), F.col("rid").alias("lrid"), F.col("vec").alias("lvec"))
    found = rows.join(leaders, BUCKET).select("rid", "dim", "vec", "lm", "lrid", "lvec").mapInArrow(
        _near_leader(least), "rid long, lm long, lrid long")
    return found.groupBy("rid").agg(F.min(F.struct("lm", "lrid"))["lrid"].alias("ball"))


def _cells(rows: DataFrame) -> DataFrame:
    """The rows of crowded buckets, once for each cell (ci, cj) of two blocks in which they take part, with their side."""
    same = F.when(F.col("ball") >= 0, F.col("ball"))
    sizes = rows.groupBy(*BUCKET, same.alias("of")).agg(F.count("*").alias("size"))
    # A ball has blocks of its own where it fills a quarter of one; the rest of the bucket shares blocks.
    sizes = sizes.withColumn("of", F.when(F.col("size") >= CELL // 4, F.col("of"))).groupBy(*BUCKET, "of").agg(F.sum("size").alias("size"))
    group = F.struct(F.coalesce("of", F.lit(-1)).alias("of"), F.ceil(F.col("size") / CELL).cast("int").alias("blocks"))
    layout = sizes.groupBy(*BUCKET).agg(F.sort_array(F.collect_list(group)).alias("groups"))
    named = lambda of: F.get(F.filter("groups", lambda g: g["of"] == of), F.lit(0))
    own = F.coalesce(named(F.col("ball")), named(F.lit(-1)))
    first = lambda of: F.aggregate(F.filter("groups", lambda g: g["of"] < of), F.lit(0), lambda s, g: s + g["blocks"])
    total = F.aggregate("groups", F.lit(0), lambda s, g: s + g["blocks"])
    placed = rows.join(layout, BUCKET).withColumn("own", own).withColumn("low", first(F.col("own.of"))).withColumn(
        "i", F.col("low") + F.pmod(F.col("m"), F.col("own.blocks")).cast("int"))
    # Blocks of one ball do not meet each other, nor themselves.
    met = F.filter(F.sequence(F.lit(0), total - 1), lambda j: (F.col("own.of") < 0) | (j < F.col("low")) | (j >= F.col("low") + F.col("own.blocks")))
    return placed.withColumn("j", F.explode(met)).withColumns({
        "ci": F.least("i", "j"), "cj": F.greatest("i", "j"), "side": (F.col("i") > F.col("j")).cast("int")})


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: vectors linked at a cosine of `least` or more."""
    if not 0 < least < 1:
        raise ValueError("least must lie between 0 and 1")
    ids, vec = F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vec_col}`")
    rows = vectors.select(ids, F.when(usable(vec), vec).alias("vec")).withColumns({
        "h1": F.when(F.col("vec").isNotNull(), F.xxhash64("vec")), "h2": F.when(F.col("vec").isNotNull(), F.hash("vec"))})
    distinct = rows.filter("vec is not null").groupBy("h1", "h2").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("vec").alias("vec"))
    distinct = written_table(distinct.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    spark = vectors.sparkSession
    bits, tables = plan(distinct.count(), least)

    base = distinct.select("rid", "n", F.size("vec").alias("dim"), "vec")
    schema = T.StructType([*base.schema.fields, T.StructField("sig", T.BinaryType()), T.StructField("m", T.LongType())])
    signed = written_table(spread(base).mapInArrow(_signed(bits, tables), schema), "signs")
    key = F.conv(F.hex(F.substring("sig", F.col("tab") * 8 + 1, F.lit(8))), 16, 10).cast("long")
    dealt = lambda df: df.withColumn("tab", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("key", key)
    crowded = written_table(dealt(signed).groupBy(*BUCKET).agg(F.count("*").alias("size")).filter(F.col("size") > CELL).select(*BUCKET), "crowded")
    alone = {c: F.lit(0) for c in ("ci", "cj", "side")}
    take = ["dim", "tab", "key", "ci", "cj", "side", "rid", "n", "sig", "vec", "ball"]
    balls = None
    if crowded.head(1):
        balls = written_table(_balls(dealt(signed).join(crowded, BUCKET, "left_semi"), least), "balls")
        hashed = dealt(signed.join(balls, "rid", "left").withColumn("ball", F.coalesce("ball", F.lit(-1))))
        plain = hashed.join(crowded, BUCKET, "left_anti").withColumns(alone).select(take).unionByName(
            _cells(hashed.join(crowded, BUCKET, "left_semi")).select(take))
    else:
        plain = dealt(signed.withColumn("ball", F.lit(-1).cast("long"))).withColumns(alone)
    where = [*BUCKET, "ci", "cj"]
    found = plain.select(take).repartition(partitions(spark), *where).sortWithinPartitions(*where).mapInArrow(
        _compared(least), "rid long, links long, root long")
    found = written_table(found, "links")

    edges = found.select(F.col("rid").alias("a"), F.col("root").alias("b"))
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    of = distinct.select("rid", "h1", "h2", "n", "least_id").join(counts, "rid", "left")
    if balls is None:
        of = of.withColumn("in_ball", F.lit(0))
    else:
        edges = edges.unionByName(balls.select(F.col("rid").alias("a"), F.col("ball").alias("b")))
        sizes = balls.join(distinct.select("rid", "n"), "rid").groupBy("ball").agg(F.sum("n").alias("filled"))
        of = of.join(balls.join(sizes, "ball").select("rid", (F.col("filled")).alias("filled")), "rid", "left").withColumn(
            "in_ball", F.coalesce(F.col("filled") - F.col("n"), F.lit(0)))
    roots = components(edges.filter("a <> b")).select(F.col("node").alias("rid"), "root")
    of = written_table(of.join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid")), "vector-links")
    ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of = of.join(ids, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("in_ball") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.filter("h1 is null").select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("h1 is not null").join(of, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    out = out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
