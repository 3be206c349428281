"""Line dedup over levelled, sorted runs of line hashes.

A line's key is the line with `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z lower-cased, as a 128-bit hash.
The index is a list of levels; a level holds runs, each a table of (key, n) bucketed and sorted by key, so that
runs are merged and anti-joined without moving them. A batch is counted, loses by merge anti-join the keys that the
runs have already settled (n at the threshold), and what is left is written as a run of level 0. A level with
`fanout` runs is compacted into one run of the next level. A settled key is never written again, however often it
occurs later, so hot lines cost one row a run.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written_table
from .hashing import release

BLANK = b" \t\n\x0b\x0c\r"
KEYS = T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("key", T.BinaryType()),
                     T.StructField("n", T.LongType())])
LINKS = T.StructType([T.StructField("text_id", T.LongType()), T.StructField("key", T.BinaryType())])
KEPT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                     T.StructField("n_dropped", T.LongType())])
ROWS = 1000  # texts split into lines at a time
HELD = 400_000  # keys counted in a task before they are handed on


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of the normalised line; None for a line without content, which is never dropped."""
    line = line.strip(BLANK).lower()
    return xxhash.xxh3_128_digest(line) if line else None


def text_keys(text: bytes | None) -> set[bytes]:
    return {k for k in map(line_key, (text or b"").split(b"\n")) if k is not None}


def _count_keys(batches: int):
    def run(parts):
        from pyspark import TaskContext

        batch, counts = TaskContext.get().partitionId() % batches, {}

        def flush():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array([batch] * len(keys), pa.int32()), pa.array(keys, pa.binary()),
                                              pa.array([counts[k] for k in keys], pa.int64())], ["batch", "key", "n"])
            counts.clear()
            return out

        for part in parts:
            for text in part.column(0).cast(pa.binary()):
                for key in text_keys(text.as_py()):
                    counts[key] = counts.get(key, 0) + 1
                if len(counts) >= HELD:
                    yield flush()
        yield flush()
        release()

    return run


def _link_keys(parts):
    for part in (whole.slice(at, ROWS) for whole in parts for at in range(0, whole.num_rows, ROWS)):
        ids, keys = [], []
        for text_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
            found = text_keys(text.as_py())
            ids += [text_id] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["text_id", "key"])
    release()


class LineRuns:
    """The index of line keys. `min_docs` is the count at which a key is settled; 1 keeps every key once."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, df: DataFrame, level: int) -> None:
        table = f"{self.name}_{self.written}"
        self.written += 1
        df.write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of (key, n): n documents of the batch have the key."""
        fresh = batch.repartition(self.buckets, "key").groupBy("key").agg(F.sum("n").alias("n"))
        for run in self.runs():
            fresh = fresh.join(run.filter(F.col("n") >= self.min_docs).select("key").hint("merge"), "key", "left_anti")
        self._write(fresh, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._compact(level)
            level += 1

    def _compact(self, level: int) -> None:
        full = self.levels[level]
        self.levels[level] = []
        self._write(self._merged([self.spark.table(t) for t in full]), level + 1)
        for table in full:
            self.spark.sql(f"DROP TABLE {table}")

    def settled(self) -> DataFrame:
        """The keys that at least `min_docs` documents have."""
        return self._merged(self.runs()).filter(F.col("n") >= self.min_docs).select("key")

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """One row a key. The key is made anew, as Spark takes a union of bucketed scans for bucketed, which it is not."""
        merged = None
        for run in runs:
            run = run.select(F.substring("key", 1, 16).alias("key"), "n")
            merged = run if merged is None else merged.unionByName(run)
        return merged.repartition(self.buckets, "key").groupBy("key").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        for table in [t for level in self.levels for t in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.levels = []


def repeated_keys(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Keys found in at least `min_docs` rows of `docs`, through an index that takes `batches` batches in turn."""
    spark = docs.sparkSession
    counted = written_table(docs.select(F.col(text).alias("text")).mapInArrow(_count_keys(batches), KEYS), "line-keys")
    index = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        index.add(counted.filter(F.col("batch") == batch).select("key", "n"))
    out = written_table(index.settled(), "repeated-lines")
    index.drop()
    return out


def dedup_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """`docs` with `text` less every line whose key is found in at least `min_docs` rows, and two columns more.

    `n_lines` counts the lines before, `n_dropped` those that went. A null text stays null and counts, like an
    empty one, as one empty line; lines without content always stay; a text all of whose lines go becomes empty.
    Equal rows count as separate documents. Columns named n_lines or n_dropped are replaced.
    """
    keys = repeated_keys(docs, text, min_docs, batches, fanout)
    column = F.col(f"`{text}`")
    # Whether a key is repeated holds for the whole corpus, so rows may share a text_id, even by a collision.
    links = docs.select(F.xxhash64(column).alias("text_id"), column.cast("string").alias("text")).mapInArrow(_link_keys, LINKS)
    # Written, so that the join below has a plain exchange on either side and a text with many copies can be split.
    gone = written_table(links.join(keys, "key", "left_semi").groupBy("text_id").agg(F.collect_set("key").alias("keys")), "dropped-lines")
    row = docs.select(F.xxhash64(column).alias("text_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = row.join(gone.hint("shuffle_hash"), "text_id", "left")
    kept = F.col("kept")
    fields = [F.col(f"row.`{c}`").alias(c) if c != text else kept["text"].alias(text)
              for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.withColumn("kept", _kept(F.col(f"row.`{text}`"), F.col("keys"))).select(
        *fields, kept["n_lines"].alias("n_lines"), kept["n_dropped"].alias("n_dropped"))


@F.arrow_udf(KEPT)
def _kept(text: pa.Array, keys: pa.Array) -> pa.Array:
    parts = [_kept_rows(text.slice(at, ROWS), keys.slice(at, ROWS)) for at in range(0, max(1, len(text)), ROWS)]
    release()
    return pa.concat_arrays(parts)


def _kept_rows(text: pa.Array, keys: pa.Array) -> pa.Array:
    texts, before, dropped = [], [], []
    for value, gone in zip(text.cast(pa.binary()).to_pylist(), keys.to_pylist(), strict=True):
        lines = (value or b"").split(b"\n")
        before.append(len(lines))
        if gone:
            gone = set(gone)
            lines = [x for x in lines if line_key(x) not in gone]
            value = b"\n".join(lines)
        texts.append(value)
        dropped.append(before[-1] - len(lines))
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), pa.array(before, pa.int64()),
                                       pa.array(dropped, pa.int64())], ["text", "n_lines", "n_dropped"])
