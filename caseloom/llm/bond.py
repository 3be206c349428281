"""Hard negatives by a vertical scan (BOND) over columns of vector components.

Rows are packed into blocks of bounded size, one integer column a dimension, with each column's least and largest value.
An anchor reads a block's columns in descending order of its own components' magnitude. After every few columns the least
and the most that the unread ones can still add to a product bound each row's score; rows that cannot matter any more leave
the candidate set. What remains in the end has its exact score.

Two scans: the first finds each anchor's positives (most similar rows of its label), the second the best rows of other
labels inside each positive's window. A task meets a bounded number of blocks with a bounded number of anchors; anchors are
a stated query set against all rows, cut in groups of about `ANCHORS`. A task hands on at most the wanted number of rows for
an anchor (or window), and a window function merges those.

Defined results: rows with a null label, a null vector or any null or non-finite component take no part; empty vectors take
part among themselves, with scores of 0. Vectors of different lengths do not meet. Repeated rows are rows of their own: each
anchor row has its own result, and another row with the anchor's id is another row. A null vec_id is no anchor, and comes
last in ties. Equal scores and ids (repeated rows) are told apart by place, which shows in no column. Scores are exact; a
table whose components could bring them beyond 53 bits raises an error. An empty table gives an empty result. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import row_numbers
from ..session import partitions, written_table

BLOCK = 8192  # vectors
BLOCK_BYTES = 4 << 20  # of a block's columns, at most
BLOCKS = 8  # of a task, on average at most
ANCHORS = 2048  # of a task, on average at most
STEP = 16  # columns between two cuts of the candidates
SCALE = 256

PACKED = "dim int, size int, ids binary, nulls binary, labels binary, marks binary, columns binary, low binary, high binary, peak double"
ANCHOR = "dim int, place long, id long, label long, vec binary"
FOUND = "place long, target int, score long, id long, at long"


def usable(vector: Column, label: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return label.isNotNull() & F.coalesce(~F.exists(vector, bad), F.lit(False))


def names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def rows_of_a_block(dim: int) -> int:
    return max(1, min(BLOCK, BLOCK_BYTES // (8 * max(dim, 1))))


def _packed(batches):
    """Blocks of vectors of one length, column by column; rows of a block are sorted by label."""
    held: dict[int, list[pa.RecordBatch]] = {}

    def block(dim: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held.pop(dim)).combine_chunks().sort_by("label")
        ids, vec = table.column("id").combine_chunks(), table.column("vec").combine_chunks()
        columns = np.ascontiguousarray(np.floor(SCALE * np.asarray(vec.flatten(), np.float64)).reshape(len(vec), dim).T)
        low, high = columns.min(1, initial=np.inf), columns.max(1, initial=-np.inf)
        row = [dim, len(vec), np.asarray(ids.fill_null(0)).tobytes(), np.asarray(ids.is_null()).tobytes(),
               np.asarray(table.column("label")).tobytes(), np.asarray(table.column("mark")).tobytes(), columns.tobytes(), low.tobytes(), high.tobytes(),
               float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7, pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names(PACKED))

    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in map(int, np.unique(dims)):
            rows = batch.filter(pa.array(dims == dim))
            while rows.num_rows:
                room = rows_of_a_block(dim) - sum(b.num_rows for b in held.get(dim, []))
                held.setdefault(dim, []).append(rows.slice(0, room))
                if rows.num_rows >= room:
                    yield block(dim)
                rows = rows.slice(room)
    for dim in list(held):
        yield block(dim)


class Block:
    """An unpacked block. The place of its row i is first + i."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.nulls, self.marks = np.frombuffer(row["nulls"], bool), np.frombuffer(row["marks"], bool)
        self.columns = np.frombuffer(row["columns"]).reshape(row["dim"], row["size"])
        self.low, self.high = np.frombuffer(row["low"]), np.frombuffer(row["high"])
        self.first = row["no"] * BLOCK

    def scan(self, anchor: np.ndarray, rows: np.ndarray, cut) -> tuple[np.ndarray, np.ndarray]:
        """The rows that no cut took away, and their scores. `cut` gets bounds of the scores and says which rows stay."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = np.stack([a * self.low[order], a * self.high[order]])
        rest = np.zeros((2, len(order) + 1))
        rest[0, :-1], rest[1, :-1] = ends.min(0)[::-1].cumsum()[::-1], ends.max(0)[::-1].cumsum()[::-1]
        score = np.zeros(len(rows))
        for at in range(0, len(order), STEP):
            read, end = order[at:at + STEP], min(at + STEP, len(order))
            columns = self.columns[read]
            score = score + a[at:end] @ (columns if len(rows) == columns.shape[1] else columns[:, rows])
            stay = cut(score + rest[0, end], score + rest[1, end])
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
        return rows, score

    def first_of(self, rows: np.ndarray, scores: np.ndarray, want: int) -> list[tuple]:
        """The first rows, as (-score, no id, id, place): higher scores, then smaller ids, null ids last."""
        if len(rows) > want:  # ties with the last one stay
            rows, scores = (x[scores >= np.partition(scores, len(rows) - want)[len(rows) - want]] for x in (rows, scores))
        found = zip((-scores).astype(np.int64).tolist(), self.nulls[rows].tolist(), self.ids[rows].tolist(), (self.first + rows).tolist(), strict=True)
        return sorted(found)[:want]


def _positives(want: int):
    """For each anchor the first `want` other rows of its label."""
    def scan(block: Block, anchor: dict, best: dict) -> None:
        low, high = np.searchsorted(block.labels, [anchor["label"], anchor["label"] + 1])
        rows = np.arange(low, high)
        rows = rows[rows != anchor["place"] - block.first]
        have = best.setdefault((anchor["place"], 0), [])

        def cut(least, most):
            if len(have) == want:
                return most >= -have[-1][0]
            return most >= np.partition(least, len(least) - want)[len(least) - want] if len(least) > want else np.ones(len(least), bool)

        rows, scores = block.scan(anchor["values"], rows, cut)
        have[:] = sorted(have + block.first_of(rows, scores, want))[:want]
    return scan


def _negatives(want: int, low: int, high: int):
    """For each anchor and positive the first `want` rows of other labels in the positive's window."""
    def scan(block: Block, anchor: dict, best: dict) -> None:
        # In whole numbers: the window from low % (rounded up) to high % (rounded down) of the positive's score.
        windows = [(w["rank"], -(-low * w["score"] // 100), high * w["score"] // 100) for w in anchor["windows"]]
        windows = [(a, b, best.setdefault((anchor["place"], n), [])) for n, a, b in windows if a <= b]
        if not windows:
            return
        floor = min(max(a, -have[-1][0]) if len(have) == want else a for a, _, have in windows)
        ceiling = max(b for _, b, _ in windows)
        rows, scores = block.scan(anchor["values"], np.flatnonzero(block.labels != anchor["label"]), lambda least, most: (most >= floor) & (least <= ceiling))
        for a, b, have in windows:
            fit = (scores >= a) & (scores <= b)
            if fit.any():
                have[:] = sorted(have + block.first_of(rows[fit], scores[fit], want))[:want]
    return scan


def _scanned(anchors: DataFrame, blocks: DataFrame, scan) -> DataFrame:
    """`scan` of each anchor over each block of vectors of its length, in tasks of bounded size."""
    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        people = left.to_pylist()
        for anchor in people:
            anchor["values"] = np.frombuffer(anchor["vec"])
        best: dict = {}
        for i in range(right.num_rows):
            block = Block(right.slice(i, 1).to_pylist()[0])
            for anchor in people:
                scan(block, anchor, best)
        rows = [(place, target, -s, None if no_id else vid, at) for (place, target), have in best.items() for s, no_id, vid, at in have]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names(FOUND))

    n = partitions(anchors.sparkSession)
    least = F.lit(float(n))
    groups = anchors.groupBy("dim").agg(F.ceil(F.count("*") / ANCHORS).cast("long").alias("groups"))
    chunks = blocks.groupBy("dim").agg(F.greatest(F.ceil(F.count("*") / BLOCKS), F.least(F.count("*"), least)).cast("long").alias("chunks"))
    sizes = groups.join(chunks, "dim")  # a row for each length of vectors

    def dealt(df: DataFrame, own: str, by: str, of: str, other: str, every: str) -> DataFrame:
        """Each row in one of its own parts, once for every part of the other side."""
        out = df.join(sizes, "dim").withColumn(of, F.pmod(F.xxhash64(by), F.col(own)))
        return out.withColumn(every, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop(own, other)

    left = dealt(anchors, "groups", "place", "g", "chunks", "h")
    right = dealt(blocks, "chunks", "no", "h", "groups", "g")
    left, right = (df.repartition(n, "dim", "g", "h").groupBy("dim", "g", "h") for df in (left, right))
    return left.cogroup(right).applyInArrow(lambda key, a, b: met(a, b), FOUND)


def _merged(found: DataFrame, want: int) -> DataFrame:
    order = Window.partitionBy("place", "target").orderBy(F.desc("score"), F.asc_nulls_last("id"), "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= want)


def _anchors(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(batch.slice(i, 1).to_pylist()[0])
            at = np.flatnonzero(block.marks)
            arrays = [pa.array(np.full(len(at), len(block.columns)), pa.int32()), pa.array(block.first + at), pa.array(block.ids[at]),
                      pa.array(block.labels[at]), pa.array([block.columns[:, j].tobytes() for j in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names(ANCHOR))


def hard_negatives(vectors: DataFrame, anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchor` marks the anchors (null: none; rows without an id never are), `label` gives each row's label, a whole number. The
    positives of an anchor are the first rows of its label by score, its negatives the first of other labels with
    low * positive score <= 100 * score <= high * positive score.
    """
    spark = vectors.sparkSession
    own, vec = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`")
    rows = vectors.filter(usable(vec, label)).select(
        F.size(vec).alias("dim"), own.alias("id"), label.cast("long").alias("label"), F.coalesce(anchor & own.isNotNull(), F.lit(False)).alias("mark"), vec.alias("vec"))
    # As many tasks as fill their blocks: tables of many small files would make many small blocks.
    full = sum(-(-r["count"] // rows_of_a_block(r["dim"])) for r in rows.groupBy("dim").count().collect())
    blocks = rows.coalesce(max(full, spark.sparkContext.defaultParallelism)).mapInArrow(_packed, PACKED)
    blocks = written_table(blocks.withColumn("block", F.monotonically_increasing_id()), "packed-vectors")
    peak = blocks.agg(F.max(F.col("dim") * F.col("peak") * F.col("peak"))).head()[0]
    if peak and peak >= 2.0 ** 53 / max(abs(low), abs(high), 100):
        raise ArithmeticError("components are too large for exact scores")
    numbers = row_numbers(blocks.select("block"), [], [F.col("block")], "no")
    blocks = written_table(blocks.join(numbers, "block").drop("block"), "vector-blocks")
    people = written_table(blocks.mapInArrow(_anchors, ANCHOR), "anchors")

    found = written_table(_merged(_scanned(people, blocks, _positives(positives)), positives).drop("target", "at"), "positives")
    windows = found.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("windows"))
    best = _merged(_scanned(people.join(windows, "place"), blocks, _negatives(negatives, low, high)), negatives)
    found = found.select("place", F.col("rank").alias("target"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(found, ["place", "target"]).join(people.select("place", F.col("id").alias("anchor_id")), "place").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
